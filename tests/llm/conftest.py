import os

import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with names the operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "a b c", "s", 5), (1, "a b c", "s", 5), (2, "a  b\tc", None, 6), (3, None, "s", None), (4, "", "t", 0), (5, " \n\t", "t", 3),
        (None, "a b c", "u", 5), (None, None, None, None), (6, long, "s", len(long)), (7, long, "t", len(long)), (8, "<|endoftext|> x", "s", 1), (9, "é 漢字 🙂", "", 1),
    ]
    rows = [(*r, "x", 7, 1.5, "k", 9) for r in rows]
    table = spark.createDataFrame(
        rows, "doc_id long, text string, source string, n_chars long, row string, size long, score double, sha string, maybe long"
    )
    # Names that must be quoted.
    return table.withColumn("meta.lang", F.lit("x")).withColumn("a`b", F.lit(1))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def sql():
    def run(query, folder=SF):
        con = duckdb.connect()
        for name in os.listdir(folder):
            con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
        return con.sql(query)

    return run
