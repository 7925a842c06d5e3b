import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DATA = "/root/testdata/sf0.001"
DOCS = "lang string, doc_id long, text string, source string, n_chars long, h long, key string, spans int"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows to documents with clashing further columns, dealt out over some partitions."""

    def make(rows, parts=3):
        full = [("en", d, t, f"s{(d or 0) % 3}", len(t or ""), 7, "k", 1) for d, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
