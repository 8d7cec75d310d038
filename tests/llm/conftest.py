from __future__ import annotations

import os

import pytest

from silvermart.session import local_session

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    return local_session(
        "llm-tests",
        "4",
        **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": shared},
    )


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or longer tuples."""

    def build(*rows):
        full = [(*row, *[None] * (5 - len(row))) for row in rows]
        return spark.createDataFrame(full, DOCUMENT).repartition(3)

    return build


def table(name: str, folder: str = SMALL):
    import pyarrow.parquet as pq

    path = f"{folder}/{name}.parquet"
    assert os.path.exists(path)
    return pq.read_table(path).to_pylist()
