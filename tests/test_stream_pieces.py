"""Micro-batches of the merge stream are read by more tasks as the table grows."""

from pathlib import Path

from workload import fixtures, q_files
from workload.queries import QUERIES


def test_four_micro_batches_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "SPREAD_ROWS", 100)
    monkeypatch.setattr(q_files, "folder", lambda t, name: str(tmp_path / name))
    rows = QUERIES["t02_merge_stream"](spark, "/root/testdata/sf0.001").collect()
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert len(rows) == orders.select("o_custkey").distinct().count()
    assert len(list(Path(tmp_path / "in").glob("*.parquet"))) >= orders.count() / 100
    assert len([f for f in Path(tmp_path / "marks" / "commits").iterdir() if f.name.isdigit()]) == 4
