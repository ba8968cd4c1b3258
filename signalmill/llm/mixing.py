"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source gets a target number of words by weight, at most `most_repeats`
times its own size.  The mix is made of blocks of equal size; blocks go to
sources, and those of a source to its shards, one after the other by the highest
quotient target / (2 seats + 1), never beyond what the party can give.  Within a
shard, documents lie on a ring in seeded order and the shard's quota is a run of
blocks from a seeded block on, round the ring as often as needed.

No row per block exists: quotas start from the seats that every party has for
certain, and the few left are dealt by sorting candidate quotients, so the cost
follows documents, shards and sources, not blocks.  A source's shards grow in
number with its size, so that no sort meets a hot source whole.

Everything is DataFrame functions.  Numbers are integers until the last
division, so reruns agree.

Defined results: a null text has size 0; a null source is a source, after all
others; documents of size 0 take 0; rows with equal doc_id are documents of
their own, whose texts spread them over the rings (equal rows share a place in the
order, in any sequence); a text counts whole, whatever its length; extra columns come along, and names that begin with
__mix_ are the operator's; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import smaller, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Words to a block; a source's words come within about a block of its target.
BLOCK_WORDS = 4
#: About so many words lie on one ring.
SHARD_WORDS = 1 << 21
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def text_key(text: Column) -> Column:
    """What tells texts under one doc_id apart on a ring."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _big(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """Of (source, source_size): k (from 0, in the order of sources), source, source_size, target (double).

    Sources by code point, null last, take the weights in turn.  In order of
    most_repeats * size / weight, a source whose share by weight of what is then left
    would be more than it can give stops there; the first that doesn't sets the share
    of all after it.  One row per source.
    """
    everything = W.partitionBy()
    out = sizes.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    out = out.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("k", F.lit(len(weights))) + 1))
    out = out.withColumn("__cap", F.col("source_size") * most_repeats)
    out = out.withColumn("__q", F.col("__cap").cast("double") / F.col("__weight"))
    before = W.orderBy("__q", "k").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("__rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
    out = out.withColumn("__share", F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0)))
    out = out.withColumn("__stops", _big(F.col("__cap")) * _big(F.col("__share")) < _big(F.col("__rest")) * _big(F.col("__weight")))
    free = F.when(~F.col("__stops"), F.struct("__q", "k", "__rest", "__share"))
    out = out.withColumn("__first", F.min(free).over(everything))
    shared = (_big(F.col("__weight")) * _big(F.col("__first.__rest"))).cast("double") / F.col("__first.__share").cast("double")
    return out.select(F.col("k").cast("bigint").alias("k"), "source", "source_size", F.when(F.col("__stops"), F.col("__cap").cast("double")).otherwise(shared).alias("target"))


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str], name: str) -> DataFrame:
    """Sainte-Lague: `seats` of each group to its parties by `votes`, as column `name`.

    By the method a party's seats are within rounding of its fair share of a slightly
    smaller or larger house.  All seats of a house smaller by half the number of
    parties are sure; for what is left the next quotients of every party, about three
    a party, are sorted, ties to the earlier party in `order`.
    """
    g = W.partitionBy(*group)
    total, n = F.sum(votes).over(g).cast("double"), F.count(F.lit(1)).over(g)
    fair = F.when(total > 0, F.col(votes) / total * F.col(seats)).otherwise(F.lit(0.0))
    slack = F.when(F.col(seats) > 0, n / (2.0 * F.col(seats))).otherwise(F.lit(0.0))
    out = parties.withColumn("__fair", fair).withColumn("__slack", slack)
    out = out.withColumn("__low", F.greatest(F.floor(F.col("__fair") * (1 - F.col("__slack")) + 0.5), F.lit(0)).cast("bigint"))
    out = out.withColumn("__high", F.floor(F.col("__fair") * (1 + F.col("__slack")) + 0.5).cast("bigint"))
    out = out.withColumn("__left", F.col(seats) - F.sum("__low").over(g))
    asked = out.withColumn("__seat", F.explode(F.sequence("__low", "__high")))
    asked = asked.withColumn("__quotient", F.col(votes).cast("double") / (2 * F.col("__seat") + 1))
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.col("__quotient").desc(), *order, "__seat"))
    asked = asked.withColumn("__won", (place <= F.col("__left")) & (F.col("__quotient") > 0))
    keys = [c for c in parties.columns]
    return asked.groupBy(*keys).agg((F.first("__low") + F.count_if("__won")).alias(name))


def _seeded(*parts: Column) -> Column:
    """A number below 2**52 from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])), 1, 13), 16, 10).cast("bigint")


def _on_rings(documents: DataFrame, sources: DataFrame, key: Column, shard_words: int) -> DataFrame:
    """documents with the number of their source and shard, and their place in the seeded order."""
    side = sources.select(F.col("source").alias("__mix_source"), F.col("k").alias("__mix_k"), F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).alias("__mix_shards"))
    out = documents.join(smaller(side), F.col("source").eqNullSafe(F.col("__mix_source"))).drop("__mix_source")
    out = out.withColumn("__mix_order", _seeded(F.lit("order"), F.col("doc_id"), key))
    return out.withColumn("__mix_shard", F.pmod("__mix_order", "__mix_shards")).drop("__mix_shards")


def quotas(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text_key, source, size): the sources with target and seats, and the shards with quota.

    sources: k, source, source_size, target, seats. shards: __mix_k, __mix_shard,
    __mix_ring (its words), __mix_quota (words to take), __mix_start (on the ring).
    """
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_repeats)
    sources = sources.withColumn("blocks", F.floor(F.sum("source_size").over(W.partitionBy()) / block_words))
    sources = written(apportion(sources, [], "target", "blocks", ["k"], "seats"), "mix-sources")
    shards = _on_rings(sized, sources, F.col("text_key"), shard_words).groupBy("__mix_k", "__mix_shard").agg(F.sum("size").alias("ring"))
    seats = sources.select(F.col("k").alias("__mix_k"), "seats")
    shards = apportion(shards.join(smaller(seats), "__mix_k"), ["__mix_k"], "ring", "seats", ["__mix_shard"], "blocks")
    most = F.floor(F.col("ring") * most_repeats / block_words)
    first = F.pmod(_seeded(F.lit("ring"), F.col("__mix_k"), F.col("__mix_shard")), F.greatest(F.ceil(F.col("ring") / block_words), F.lit(1)))
    shards = shards.select("__mix_k", "__mix_shard", F.col("ring").alias("__mix_ring"), (F.least("blocks", most) * block_words).alias("__mix_quota"), (first * block_words).alias("__mix_start"))
    return sources, written(shards, "mix-shards")


def taken(documents: DataFrame, sources: DataFrame, shards: DataFrame, size: Column, key: Column, *, shard_words: int = SHARD_WORDS) -> DataFrame:
    """All columns of documents and size, source_size, target, taken, copies, each after __mix_.

    taken counts the words of a document in the chosen blocks, repeats included;
    copies counts how often its first word is chosen.  key is the text_key() of a
    document and shard_words that of quotas().
    """
    out = _on_rings(documents.withColumn("__mix_size", size), sources, key, shard_words)
    ring = W.partitionBy("__mix_k", "__mix_shard").orderBy("__mix_order", "doc_id", "__mix_size").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("__mix_a", F.coalesce(F.sum("__mix_size").over(ring), F.lit(0)))
    out = out.join(smaller(shards), ["__mix_k", "__mix_shard"])
    side = sources.select(F.col("k").alias("__mix_k"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"))
    out = out.join(smaller(side), "__mix_k")
    a, b = F.col("__mix_a"), F.col("__mix_a") + F.col("__mix_size")
    rounds = F.when(F.col("__mix_ring") > 0, F.floor(F.col("__mix_quota") / F.col("__mix_ring"))).otherwise(F.lit(0))
    end = F.col("__mix_start") + F.col("__mix_quota") - rounds * F.col("__mix_ring")  # of the last, partial round; beyond the ring it goes on at 0
    none = F.lit(0).cast("bigint")
    part = F.greatest(F.least(b, end) - F.greatest(a, F.col("__mix_start")), none) + F.greatest(F.least(b, end - F.col("__mix_ring")) - a, none)
    inside = ((a >= F.col("__mix_start")) & (a < end)) | (a < end - F.col("__mix_ring"))
    out = out.withColumn("__mix_taken", (rounds * F.col("__mix_size") + part).cast("bigint"))
    out = out.withColumn("__mix_copies", F.when(F.col("__mix_size") > 0, rounds + inside.cast("bigint")).otherwise(none))
    return out.drop("__mix_k", "__mix_shard", "__mix_order", "__mix_a", "__mix_ring", "__mix_quota", "__mix_start")


#: The result of op3 in DuckDB SQL, with the parameters above.
ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM totals
), weighed AS (
  SELECT *, CAST(CASE k % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS HUGEINT) AS w, source_size * {MOST_REPEATS} AS cap FROM ranked
), rests AS (
  SELECT *, CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) AS q,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS HUGEINT) AS rest,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS HUGEINT) AS share
  FROM weighed WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first_free AS (
  SELECT rest, share FROM rests WHERE NOT (cap * share < rest * w) ORDER BY q, k LIMIT 1
), targets AS (
  SELECT k, source, source_size,
    CASE WHEN cap * share < rest * w THEN CAST(cap AS DOUBLE)
      ELSE CAST(w * (SELECT rest FROM first_free) AS DOUBLE) / CAST((SELECT share FROM first_free) AS DOUBLE) END AS target,
    CAST(floor(CAST(sum(source_size) OVER () AS DOUBLE) / {BLOCK_WORDS}) AS BIGINT) AS blocks
  FROM rests
), quotients AS (
  SELECT k, s AS seat, target / (2 * s + 1) AS quotient, blocks FROM (
    SELECT k, target, blocks, unnest(generate_series(CAST(0 AS BIGINT), CAST(floor(target / {BLOCK_WORDS}) AS BIGINT) + (SELECT count(*) FROM targets))) AS s FROM targets)
), seats AS (
  SELECT k, count(*) FILTER (WHERE place <= blocks AND quotient > 0) AS seats FROM (
    SELECT *, row_number() OVER (ORDER BY quotient DESC, k, seat) AS place FROM quotients) GROUP BY k
), placed AS (
  SELECT d.doc_id, d.size, t.k, t.source_size, t.target, s.seats,
    CAST('0x' || substr(md5('{SEED}:order:' || coalesce(CAST(d.doc_id AS VARCHAR), '-') || ':' || d.text_key), 1, 13) AS BIGINT) AS place,
    greatest(CAST(ceil(CAST(t.source_size AS DOUBLE) / {SHARD_WORDS}) AS BIGINT), 1) AS shards
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source JOIN seats s ON s.k = t.k
), ringed AS (
  SELECT *, place % shards AS shard FROM placed
), rings AS (
  SELECT k, shard, seats, CAST(sum(size) AS BIGINT) AS ring FROM ringed GROUP BY k, shard, seats
), ring_quotients AS (
  SELECT k, shard, seats, s AS seat, CAST(ring AS DOUBLE) / (2 * s + 1) AS quotient FROM (
    SELECT r.*, unnest(generate_series(CAST(0 AS BIGINT), CAST(floor(CAST(ring AS DOUBLE) / greatest((SELECT sum(ring) FROM rings x WHERE x.k = r.k), 1) * seats) AS BIGINT) + 64)) AS s FROM rings r)
), ring_seats AS (
  SELECT k, shard, count(*) FILTER (WHERE place <= seats AND quotient > 0) AS blocks FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY quotient DESC, shard, seat) AS place FROM ring_quotients) GROUP BY k, shard
), quotas AS (
  SELECT r.k, r.shard, r.ring,
    least(q.blocks, CAST(floor(CAST(r.ring AS DOUBLE) * {MOST_REPEATS} / {BLOCK_WORDS}) AS BIGINT)) * {BLOCK_WORDS} AS quota,
    CAST('0x' || substr(md5('{SEED}:ring:' || r.k || ':' || r.shard), 1, 13) AS BIGINT) % greatest(CAST(ceil(CAST(r.ring AS DOUBLE) / {BLOCK_WORDS}) AS BIGINT), 1) * {BLOCK_WORDS} AS start
  FROM rings r JOIN ring_seats q ON r.k = q.k AND r.shard = q.shard
), runs AS (
  SELECT d.doc_id, d.size, d.source_size, d.target, q.ring, q.start,
    CASE WHEN q.ring > 0 THEN q.quota // q.ring ELSE 0 END AS rounds, q.quota,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.k, d.shard ORDER BY d.place, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM ringed d JOIN quotas q ON d.k = q.k AND d.shard = q.shard
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(rounds * size
    + greatest(least(a + size, start + quota - rounds * ring) - greatest(a, start), 0)
    + greatest(least(a + size, start + quota - rounds * ring - ring) - a, 0) AS BIGINT) AS taken
FROM runs
"""
