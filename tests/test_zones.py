"""Zone round trip (S1-S3) and lineage cutting."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from scriptorium.schemas import RAW_WORK
from scriptorium.session import cut_lineage
from scriptorium.sources import zones as Z


def test_read_papers_seq_and_zone_round_trip(spark):
    root = tempfile.mkdtemp(prefix="scriptorium-zone-")
    land = os.path.join(root, "raw")
    os.makedirs(land)
    for name, dois in (("p1.json", ["a", "b"]), ("p2.json", ["c"])):
        with open(os.path.join(land, name), "w") as f:
            json.dump([{"doi": d, "title": d.upper()} for d in dois], f)
    raw = Z.read_papers(spark, land, RAW_WORK)
    assert [r["doi"] for r in raw.orderBy("file", "pos").collect()] == ["a", "b", "c"]
    Z.write_zone(raw, root, "raw-zone", "2024-01-01")
    Z.write_zone(raw.filter(F.col("doi") == "c"), root, "raw-zone", "2024-02-01")
    assert Z.read_zone(spark, root, "raw-zone").count() == 1            # latest snapshot
    assert Z.read_zone(spark, root, "raw-zone", "2024-01-01").count() == 3
    assert Z.read_zone(spark, root, "raw-zone", "1999-01-01").count() == 1  # never written: the latest
    assert Z.snapshots(spark, root, "raw-zone") == ["2024-01-01", "2024-02-01"]
    stamped = Z.stamp(raw)
    assert "last_updated" in stamped.columns


def test_mart_is_staged_and_swapped(spark, tmp_path):
    path = str(tmp_path / "mart")
    Z.write_mart(spark.range(5), path)
    Z.write_mart(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception):
        Z.write_mart(broken, path)
    assert spark.read.parquet(path).count() == 7  # the old table stands
    assert not (tmp_path / "mart__old").exists()


def test_a_checkpoint_folder_is_required(spark):
    from scriptorium.session import checkpoint_dir

    class Bare:
        class sparkContext:
            @staticmethod
            def getCheckpointDir():
                return None

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        checkpoint_dir(Bare)


def test_cut_lineage_uses_checkpoint_dir(spark):
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10
    assert spark.sparkContext.getCheckpointDir() is not None
