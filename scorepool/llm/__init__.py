"""Training-data corpus operators: ten operators over a table of documents, their queries and their SQL."""
