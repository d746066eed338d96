import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def docs_of(spark):
    def build(rows):
        """documents from (doc_id, text) pairs, with the other columns null."""
        rows = [(i, t, None, None, None) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return build


@pytest.fixture(scope="session")
def tables(spark):
    def read(name, sf="sf0.001"):
        return spark.read.parquet(f"{DATA}/{sf}/{name}.parquet")

    return read
