"""Every query of the core runs; those with SQL give the same rows."""

import pytest
from compare import FOLDER, check

from tonelake.plans import all_oracles, all_queries


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_as_sql(spark, name):
    check(spark, all_queries()[name], all_oracles()[name])


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_runs(spark, name):
    assert all_queries()[name](spark, FOLDER).count() >= 0


def test_semantic_chunks_hold_every_sentence(spark):
    from pyspark.sql import functions as F

    from tonelake.functions import text as T

    d = spark.read.parquet(f"{FOLDER}/documents.parquet").where("text <> ''").dropDuplicates(["doc_id"])
    whole = {r["doc_id"]: r["t"] for r in d.select("doc_id", F.array_join(T.sentences(F.col("text")), " ").alias("t")).collect()}
    found = {}
    for r in all_queries()["semantic_chunks"](spark, FOLDER).orderBy("doc_id", "chunk_index").collect():
        found[r["doc_id"]] = f"{found[r['doc_id']]} {r['chunk']}" if r["doc_id"] in found else r["chunk"]
    assert found == {k: v for k, v in whole.items() if v}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_machine_local_checkpoint():
    import pathlib

    for p in pathlib.Path("tonelake").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text() and "crossJoin" not in p.read_text(), p
