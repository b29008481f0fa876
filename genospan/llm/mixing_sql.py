"""The mix as one DuckDB statement, for the side-by-side check."""

from __future__ import annotations

from .mixing import MAX_BLOCK, MAX_SHARDS, REPEAT, SHARD_WORDS, SHARE, WEIGHTS


def _hash(salt: str, key: str, first: int) -> str:
    return f"CAST('0x' || substr(md5(concat('{salt}:', coalesce(CAST({key} AS VARCHAR), ''))), {first}, 15) AS BIGINT)"


def mix_sql(docs: str = "documents", seed: int = 42) -> str:
    weight = " ".join(f"WHEN {i} THEN {w}.0" for i, w in enumerate(WEIGHTS))

    def seats(name: str, of: str, votes: str, blocks: str, group: str, key: str, limit: str) -> str:
        over = f"OVER (PARTITION BY {group})"
        return f"""
{name}_a AS (SELECT *, count(*) {over} AS n_, sum({votes}) {over} AS votes_ FROM {of}),
{name}_b AS (SELECT *, CASE WHEN votes_ > 0 THEN CAST({blocks} AS DOUBLE) * {votes} / votes_ ELSE 0 END AS share_ FROM {name}_a),
{name}_c AS (SELECT *, CAST(ceil(share_ * n_ / (2.0 * greatest({blocks}, 1))) AS BIGINT) + 2 AS m_ FROM {name}_b),
{name}_d AS (SELECT *, greatest(0, CAST(floor(share_) AS BIGINT) - m_) AS base_ FROM {name}_c),
{name}_e AS (SELECT *, {blocks} - sum(base_) {over} AS rest_ FROM {name}_d),
{name}_f AS (SELECT {group}, {key}, {votes} AS v_, rest_, unnest(range(base_, base_ + 2 * m_ + 2)) AS k_, {limit} AS limit_ FROM {name}_e WHERE {votes} > 0),
{name}_g AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY CAST(v_ AS DOUBLE) / (2 * k_ + 1) DESC, {key}, k_) AS nth_ FROM {name}_f WHERE k_ < limit_),
{name}_w AS (SELECT {group}, {key}, count(*) AS won_ FROM {name}_g WHERE nth_ <= rest_ GROUP BY ALL),
{name} AS (SELECT e.*, CASE WHEN {votes} > 0 THEN base_ + coalesce(won_, 0) ELSE 0 END AS seats FROM {name}_e e LEFT JOIN {name}_w USING ({group}, {key}))"""

    return f"""
WITH sized AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS name,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM {docs}),
s1 AS (SELECT no_source, name, CAST(sum(size) AS BIGINT) AS source_size, 0 AS one FROM sized GROUP BY ALL),
s2 AS (SELECT *, CASE (row_number() OVER (ORDER BY no_source, name) - 1) % {len(WEIGHTS)} {weight} END AS weight,
  CAST(sum(source_size) OVER () AS BIGINT) AS total, min(CASE WHEN source_size > 0 THEN source_size END) OVER () AS least_, source_size * {REPEAT}.0 AS cap FROM s1),
s3 AS (SELECT *, cap <= (total * {SHARE}::DOUBLE - coalesce(sum(cap::DOUBLE) OVER b, 0.0)) / (sum(weight::DOUBLE) OVER () - coalesce(sum(weight::DOUBLE) OVER b, 0.0)) * weight AS full_
  FROM s2 WINDOW b AS (ORDER BY cap / weight, no_source, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, CASE WHEN full_ THEN cap::DOUBLE ELSE (total * {SHARE}::DOUBLE - sum(CASE WHEN full_ THEN cap ELSE 0 END::DOUBLE) OVER ()) * weight / sum(CASE WHEN full_ THEN 0.0 ELSE weight END::DOUBLE) OVER () END AS target FROM s3),
s5 AS (SELECT *, greatest(1, least({MAX_BLOCK}, CAST(floor(least_ / {MAX_BLOCK}) AS BIGINT))) AS block,
  greatest({SHARD_WORDS}, CAST(ceil(total / {MAX_SHARDS}) AS BIGINT)) AS shard_words FROM s4),
s6 AS (SELECT *, CAST(round(sum(target) OVER () / block) AS BIGINT) AS blocks, greatest(1, CAST(ceil(source_size / shard_words) AS BIGINT)) AS shards FROM s5),
{seats("s7", "s6", "target", "blocks", "one", "no_source, name", "9000000000000000000")},
src AS (SELECT no_source, name, source_size, target, block, shards, CAST(seats AS BIGINT) AS quota FROM s7),
placed AS (SELECT sized.*, source_size, target, block, quota, {_hash(str(seed), "doc_id", 16)} % shards AS shard FROM sized JOIN src USING (no_source, name)),
h1 AS (SELECT no_source, name, shard, CAST(sum(size) AS BIGINT) AS words, first(block) AS block, first(quota) AS quota FROM placed GROUP BY ALL),
h2 AS (SELECT no_source, name, shard, words, block, quota, CAST(ceil(words / block) AS BIGINT) AS ring FROM h1),
{seats("h3", "h2", "words", "quota", "no_source, name", "shard", f"ring * {REPEAT}")},
h4 AS (SELECT no_source, name, shard, words, ring, CAST(seats AS BIGINT) AS seats,
  CASE WHEN ring > 0 THEN {_hash(f"{seed}:ring", "concat(name, '/', shard)", 1)} % ring ELSE 0 END AS first_ FROM h3),
laid AS (SELECT p.*, h4.ring, h4.seats, h4.first_, CAST(sum(size) OVER (PARTITION BY p.no_source, p.name, p.shard ORDER BY {_hash(str(seed), "doc_id", 1)}, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS to_
  FROM placed p JOIN h4 ON p.no_source = h4.no_source AND p.name = h4.name AND p.shard = h4.shard),
run AS (SELECT *, CASE WHEN ring > 0 THEN seats // ring ELSE 0 END AS rounds, to_ - size AS from_ FROM laid),
fin AS (SELECT *, (first_ + seats - rounds * ring) * block AS last_ FROM run)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target, CAST(rounds * size
  + greatest(0, least(to_, last_) - greatest(from_, first_ * block))
  + greatest(0, least(to_, last_ - ring * block) - greatest(from_, 0)) AS BIGINT) AS taken FROM fin"""
