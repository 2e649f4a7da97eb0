import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"word{i % 997} sch{i % 13}é" for i in range(9000))
NEAR = " ".join(f"alpha{i} beta{i * 7 % 11}" for i in range(60))
#: Nulls, empty and wordless texts, ties, repeated rows, odd white space, a very long text.
ROWS = [
    (0, NEAR), (1, NEAR), (1, NEAR), (2, NEAR.replace("alpha5 ", "changed ")), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one"), (8, "a b c d e"),
    (9, LONG), (10, LONG + " tail"), (11, "x\x0by\x0cz \x1c é ü  double"), (12, "THE End. 12 34"), (None, "no id here at all"), (None, None),
    (13, " ".join(["again"] * 70)), (14, NEAR + " " + NEAR), (-5, "mail a.b@c.de now +1 (212) 555-0100"), (15, "日本語 テスト"), (16, "!!! 123"),
]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    """ROWS with columns whose names operators also use."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    return frame.select("doc_id", "text", F.lit("src0").alias("source"), F.lit("x").alias("packet"), F.lit(1).alias("bucket"), F.lit(2).alias("part"), F.lit(3).alias("rank"), F.lit(4).alias("rep"), F.lit(5).alias("component_id"), F.lit(6).alias("learns"), F.lit(7).alias("start"))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
