"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, personal data, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorepool.llm.common import materialise
from scorepool.llm.decontaminate import clean
from scorepool.llm.language_id import identified, train
from scorepool.llm.ngram_join import one_of_each
from scorepool.llm.packing import pack
from scorepool.llm.pii import redact


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null and empty texts, texts without a letter, and ambiguous ones. Trains on the
    labelled rows of docs; without any, every document goes. Very long texts are judged whole, repeated rows alike; other columns,
    whatever their names, pass through; an empty table stays empty."""
    return identified(docs, train(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that n-gram Jaccard links connect, that of the least id. Documents with a null or empty text
    or a null id stay, as they link with nothing; of rows that share an id, all stay or go together; texts of any length count
    whole; other columns pass through; an empty table stays empty."""
    return one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage. Null and empty texts stay, and all documents where the benchmark is empty;
    repeated rows are judged alike, texts of any length whole; other columns pass through; an empty table stays empty."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text, of any length. Null and empty texts stay as they are; n_chars follows the new text;
    repeated rows are redacted alike; other columns pass through; an empty table stays empty."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 2048 tokens. A null or empty text is one piece, its end id; long texts
    are cut into pieces; each repeated row is packed on its own, null ids too; an empty table gives no rows."""
    return pack(docs)


STAGES = [
    ("language_id", keep_identified),
    ("ngram_join", deduplicated),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("packing", packed),
]

#: Tokenisation and the trained models have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
