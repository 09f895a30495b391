"""Every query of the subpackage runs on the tables; those with SQL give the same rows."""

import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import FOLDER, check

from tonelake.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "p1_found": "transcript_id section turn_index speaker_name speaker_role", "p2_found": "source_table item_key boundary", "p3_found": "accession_a accession_b",
    "p5_found": "accession_number line_no", "p6_ids": "doc_id ids", "p8_found": "doc_id reading_level",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])


def test_roundtrip_of_short_bodies(spark, tmp_path):
    """Short bodies in a row, in the text and at its start, and the tables in which a filing has them."""
    short = "A b c d.\n\nItem 1. Heading of it\nword word "
    texts = ["Words of a sentence here. " * 40 + short + "y" * 9000, short + "y" * 9000, "Hi.\n\n" + "no stop " * 900, "w" * 4000, short, "", None]
    pq.write_table(pa.table({"accession_number": [f"a{i}" for i in range(len(texts))], "raw_text": texts}), tmp_path / "filings.parquet")
    pq.write_table(pa.table({"transcript_id": list(range(len(texts))), "raw_text": texts[::-1]}), tmp_path / "transcripts.parquet")
    check(spark, QUERIES["p2_roundtrip"], ORACLES["p2_roundtrip"], str(tmp_path))
    check(spark, QUERIES["p2_roundtrip"], ORACLES["p2_roundtrip"], "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split()
    if name == "p6_roundtrip":
        assert df.where("not same").isEmpty()


def test_levels_agree_with_ratings(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r["reading_level"] for r in QUERIES["p8_found"](spark, folder).collect()}
    rated = spark.read.parquet(f"{folder}/reading_grades.parquet").groupBy("doc_id").agg({"reading_level": "avg"}).collect()
    both = [(got[r[0]], r[1]) for r in rated if r[0] in got]
    assert sum(abs(a - b) <= 0.5 for a, b in both) / len(both) > 0.85
