"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Sizes are words. Each source gets a target by weight, held at ``repeat`` times
its own size (water filling). Targets become integer quotas of equal-token
blocks: blocks go to the sources with the highest quotients target/(2k+1), and
a source's blocks go to its shards (seeded hash classes of its documents, so a
large source is spread over many tasks) by the same rule on shard sizes. In a
shard the documents stand in seeded order on a ring cut into blocks; the quota
takes whole rounds of the ring and then a run of blocks from a seeded start. A
document's ``taken`` is its overlap with the blocks taken.

Only quotients near the exact share are listed, not one per block: the divisor
that gives the right total lies within (parties/2)/blocks of the block size,
which bounds how far any quota can be from its rounded share. The lists
together are a few rows per source or shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, stash

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEAT = 2
MAX_BLOCK = 64
SHARD_WORDS = 200_000
MAX_SHARDS = 4096


def _hash(salt: str, key: Column, first: int) -> Column:
    """60 seeded bits as a long; md5 so that any SQL engine agrees."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), first, 15), 16, 10).cast("long")


def _seats(parties: DataFrame, group: list[str], key: list[str], votes: str, blocks: str, limit: str | None = None) -> DataFrame:
    """Sainte-Laguë seats of each party: ``blocks`` seats a group by highest votes/(2k+1), ties to the smaller key."""
    whole = Window.partitionBy(*group)
    p = parties.withColumn("_n", F.count("*").over(whole)).withColumn("_votes", F.sum(votes).over(whole))
    p = p.withColumn("_share", F.when(F.col("_votes") > 0, F.col(blocks) * F.col(votes) / F.col("_votes")).otherwise(0.0))
    p = p.withColumn("_m", F.ceil(F.col("_share") * F.col("_n") / (2.0 * F.greatest(F.col(blocks), F.lit(1)))) + 2)
    p = p.withColumn("_base", F.greatest(F.lit(0), F.floor("_share") - F.col("_m")))
    p = p.withColumn("_rest", F.col(blocks) - F.sum("_base").over(whole))
    listed = p.where(F.col(votes) > 0).select(*group, *key, F.col(votes).alias("_v"), "_rest", "_base", F.explode(F.sequence(F.col("_base"), F.col("_base") + 2 * F.col("_m") + 1)).alias("_k"), *([limit] if limit else []))
    if limit:
        listed = listed.where(F.col("_k") < F.col(limit))
    order = Window.partitionBy(*group).orderBy((F.col("_v") / (2 * F.col("_k") + 1)).desc(), *key, "_k")
    won = listed.withColumn("_nth", F.row_number().over(order)).where("_nth <= _rest").groupBy(*group, *key).agg(F.count("*").alias("_won"))
    on = list(dict.fromkeys([*group, *key]))
    return p.join(won, on, "left").withColumn("seats", F.when(F.col(votes) > 0, F.col("_base") + F.coalesce("_won", F.lit(0))).otherwise(0)).drop("_n", "_votes", "_share", "_m", "_base", "_rest", "_won")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``.

    A null text has size 0, a null source is a source of its own (last in
    order), a null doc_id hashes like an empty one, repeated rows are taken
    each for itself (ties in the seeded order go by doc_id and size, so equal
    rows are interchangeable), an empty table gives no rows. Only doc_id, text
    and source are read.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )
    sized = stash(sized, "mix-sizes")
    every = Window.partitionBy()
    names = ["no_source", "name"]
    src = sized.groupBy(*names).agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.partitionBy().orderBy(*names))
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((nth - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("total", F.sum("source_size").over(every)).withColumn("least", F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(every))
    src = src.withColumn("cap", F.col("source_size") * float(repeat))
    before = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), *names).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    src = src.withColumn("full", F.col("cap") <= level * F.col("weight"))
    rest = F.col("total") * share - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    src = src.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(rest * F.col("weight") / free))
    src = src.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(F.col("least") / MAX_BLOCK))).cast("long"))
    src = src.withColumn("blocks", F.round(F.sum("target").over(every) / F.col("block")).cast("long"))
    src = src.withColumn("shard_words", F.greatest(F.lit(SHARD_WORDS), F.ceil(F.col("total") / MAX_SHARDS)).cast("long"))
    src = src.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("shard_words"))).cast("long"))
    src = _seats(src.withColumn("_all", F.lit(0)), ["_all"], names, "target", "blocks").withColumnRenamed("seats", "quota")
    src = stash(src.select(*names, "source_size", "target", "block", "shards", "quota"), "mix-sources")

    placed = sized.join(src, names).withColumn("shard", _hash(f"{seed}", F.col("doc_id"), 16) % F.col("shards"))
    shard = placed.groupBy(*names, "shard").agg(F.sum("size").alias("words"), F.first("block").alias("block"), F.first("quota").alias("quota"))
    shard = shard.withColumn("ring", F.ceil(F.col("words") / F.col("block")).cast("long")).withColumn("most", F.col("ring") * repeat)
    shard = _seats(shard, names, ["shard"], "words", "quota", "most")
    start = F.when(F.col("ring") > 0, _hash(f"{seed}:ring", F.concat("name", F.lit("/"), "shard"), 1) % F.col("ring")).otherwise(0)
    shard = shard.select(*names, "shard", "words", "ring", "seats", start.alias("first"))

    both = placed.join(shard, [*names, "shard"])
    upto = F.sum("size").over(Window.partitionBy(*names, "shard").orderBy(_hash(f"{seed}", F.col("doc_id"), 1), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("to", upto).withColumn("from", F.col("to") - F.col("size"))
    rounds = F.when(F.col("ring") > 0, F.floor(F.col("seats") / F.col("ring"))).otherwise(0)
    left = F.col("seats") - rounds * F.col("ring")
    last = (F.col("first") + left) * F.col("block")

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("to"), hi) - F.greatest(F.col("from"), lo))

    taken = rounds * F.col("size") + overlap(F.col("first") * F.col("block"), last) + overlap(F.lit(0), last - F.col("ring") * F.col("block"))
    return both.select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("name")).alias("source"),
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        taken.cast("long").alias("taken"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated round(taken/size) times (a size of 0: once).

    Rows that share doc_id, source and size share the mean of their counts.
    The plan goes to the texts where it is small enough to be sent everywhere,
    else both are shuffled. Columns may have any name.
    """
    copies = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(1)
    key = [F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size")]
    plan = mix(docs, **options).groupBy(*key).agg(F.round(F.sum(copies) / F.count("*")).cast("int").alias("p_copies"))
    plan = bounded_broadcast(stash(plan, "mix-plan"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select(row.alias("r"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("words"))
    same = F.col("r.doc_id").cast("long").eqNullSafe(F.col("p_id")) & F.col("r.source").eqNullSafe(F.col("p_source")) & (F.col("words") == F.col("p_size"))
    return sized.join(plan, same).where("p_copies > 0").select("r", F.explode(F.sequence(F.lit(1), "p_copies"))).select("r.*")
