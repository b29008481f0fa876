import os

import pytest

from genospan.llm import common
from genospan.llm.graph import connected_components


def test_hash_bound_keeps_a_share_at_any_size():
    assert common.hash_bound(0) == -(1 << 63) and common.hash_bound(1) == (1 << 63) - 1
    for total in (10**5, 10**11, 10**15):
        kept = common.hash_bound(20_000 / total) + (1 << 63)
        assert abs(kept / 2**64 * total - 20_000) < 1


def test_sampled_rows(spark):
    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    assert ids.where(common.sampled(1.0, 3, "doc_id")).count() == 200_000
    assert abs(ids.where(common.sampled(0.05, 3, "doc_id")).count() - 10_000) < 600


def test_components_of_a_long_path(spark):
    links = spark.range(300).selectExpr("id + 1 as a", "id as b")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == dict.fromkeys(range(301), 0)


def test_stashes_can_be_purged(spark):
    before = common.purge(spark)
    df = common.stash(spark.range(5), "kept")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert before >= 0 and os.path.isdir(path) and common.purge(spark) == 1 and not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_own_writes_take_small_batches(spark):
    """A worker's memory goes with its batch: 16 MB of text took 410 MB of it."""
    from pyspark.sql import functions as F

    from genospan.llm import common

    def sizes(batches):
        for b in batches:
            yield type(b).from_pydict({"n": [b.nbytes]})

    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
    got = common.stash(texts.mapInArrow(sizes, "n long"), "sizes")
    assert got.agg(F.max("n")).first()[0] <= 5 << 20 and got.count() > 3
