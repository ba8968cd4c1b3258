"""One query for each operator family over the driver tables, with the same in DuckDB SQL.

Doubles are rounded to six places, so that the order of sums doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, fitted, matching, scoring, text
from ..functions.scoring import Economy
from ..operators import annotate, consensus, dispatch, ledger, lifecycle, validation, votes, weights
from ..sources import readers, remote
from ..session import SETTINGS
from ..sources.registries import NO_ASSET, OTHER_SECTOR, SECTORS, SOURCE_CREDIBILITY, Entry, as_table
from ..streaming import epochs, ingest, processors, sink
from ..tables import VersionedTable, shared_folder
from . import inputs as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def as_of() -> Column:
    return F.lit(I.AS_OF).cast("timestamp")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


SPACE_SQL = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(rf"""SELECT doc_id, md5(t) AS text_md5, length(t) AS n FROM (
  SELECT doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '{SPACE_SQL}+', ' ', 'g')) AS t FROM documents)""")
def q_norm_text(spark, sf):
    t = text.norm_text(F.col("text"))
    return I.table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n"))


@query("SELECT c_custkey, lower(trim('  @' || c_name || ' ')) AS author FROM customer")
def q_norm_author(spark, sf):
    return I.table(spark, sf, "customer").select("c_custkey", text.norm_author(F.concat(F.lit("  @"), "c_name", F.lit(" "))).alias("author"))


def _match_sql(registry: tuple[Entry, ...], default: Entry, source: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for place, e in enumerate(registry):
        rows += [(place, e.id, e.symbol, "tag", i, c, c.lower()) for i, c in enumerate(e.cashtags)] if e.id != default.id else []
        words = [(n, "cased", matching.word_pattern(n)) for n in e.cased] + [(n, "plain", matching.word_pattern(n.lower())) for n in e.identifiers]
        rows += [(place, e.id, e.symbol, kind, i, n, p) for i, (n, kind, p) in enumerate(words) if len(n) >= matching.LEAST_LENGTH] if e.id != default.id else []
    values = ",\n    ".join(f"({p}, {i}, {quote(s)}, {quote(k)}, {n}, {quote(c)}, {quote(x)})" for p, i, s, k, n, c, x in rows)
    return f"""WITH reg(place, id, symbol, kind, pos, ident, pattern) AS (VALUES
    {values}
), hit AS (
  SELECT d.{key}, r.* FROM {source} d JOIN reg r ON CASE r.kind WHEN 'tag' THEN contains(lower(d.{column}), r.pattern)
    WHEN 'cased' THEN CASE WHEN contains(d.{column}, r.ident) THEN regexp_matches(d.{column}, r.pattern) ELSE false END
    ELSE CASE WHEN contains(lower(d.{column}), lower(r.ident)) THEN regexp_matches(lower(d.{column}), r.pattern) ELSE false END END
), per AS (
  SELECT {key}, place, id, symbol, count(*) FILTER (WHERE kind = 'tag') AS tags, count(*) AS n,
    list(ident ORDER BY pos) FILTER (WHERE kind = 'tag') AS tag_list, list(ident ORDER BY pos) FILTER (WHERE kind <> 'tag') AS word_list
  FROM hit GROUP BY {key}, place, id, symbol
), scored AS (
  SELECT {key}, id, symbol, CASE WHEN tags > 0 THEN 1.0 WHEN n > 1 THEN 0.9 ELSE 0.8 END AS score, place, CASE WHEN tags > 0 THEN tag_list ELSE word_list END AS evidence FROM per
), best AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, place) AS nth FROM scored
), matched AS (
  SELECT d.{key}, CAST(coalesce(b.id, {default.id}) AS BIGINT) AS id, coalesce(b.symbol, {quote(default.symbol)}) AS symbol,
    CASE WHEN b.score >= 0.9 THEN 'high' WHEN b.score IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence, coalesce(array_to_string(b.evidence, ','), '') AS evidence
  FROM {source} d LEFT JOIN best b ON d.{key} = b.{key} AND b.nth = 1
)
"""


def _matched(df: DataFrame, key: str, column: str, registry: tuple[Entry, ...], default: Entry) -> DataFrame:
    m = df.select(key, matching.match(F.col(column), registry, default).alias("m"))
    return m.select(key, "m.id", "m.symbol", "m.confidence", F.array_join("m.evidence", ",").alias("evidence"))


@query(_match_sql(SECTORS, OTHER_SECTOR) + "SELECT * FROM matched")
def q_match_sector(spark, sf):
    return _matched(I.table(spark, sf, "documents"), "doc_id", "text", SECTORS, OTHER_SECTOR)


@query(_match_sql(I.FIXTURE, I.FIXTURE[-1]) + "SELECT * FROM matched")
def q_match_case_sensitive(spark, sf):
    return _matched(I.table(spark, sf, "documents"), "doc_id", "text", I.FIXTURE, I.FIXTURE[-1])


@query(_match_sql(I.FIXTURE, I.FIXTURE[-1]) + "SELECT doc_id, CAST(id AS BIGINT) AS id, symbol, CAST(score AS DOUBLE) AS score, array_to_string(evidence, ',') AS evidence FROM scored")
def q_match_all(spark, sf):
    """All entries of a registry table that each text matches."""
    registry = as_table(spark, I.FIXTURE[:-1])
    out = matching.all_matches(I.table(spark, sf, "documents"), registry, key="doc_id")
    return out.withColumn("evidence", F.array_join("evidence", ","))


@query("""SELECT doc_id, CAST(doc_id AS VARCHAR) || '|' || lang || '|neutral|none|other|NONE|' || CASE WHEN n_chars > 500 THEN 'high' ELSE 'None' END || '|'
  || array_to_string(list_sort([lower(source), lower('Zeta ' || lang), 'mid']), '|') AS canonical FROM documents""")
def q_canonical_string(spark, sf):
    d = I.table(spark, sf, "documents")
    confidence = F.when(F.col("n_chars") > 500, "high")
    out = text.canonical(F.col("doc_id"), F.col("lang"), F.lit("neutral"), F.lit("none"), F.lit("other"), F.lit("NONE"), confidence, F.array(F.col("source"), F.concat(F.lit("Zeta "), "lang"), F.lit("mid")))
    return d.select("doc_id", out.alias("canonical"))


SOURCE_NAMES = list(SOURCE_CREDIBILITY)[:20]
_source_name = "CASE CAST(substr(source, 4) AS INTEGER) % 24 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCE_NAMES)) + " ELSE source END"
_credibility = "CASE outlet " + " ".join(f"WHEN '{s}' THEN {SOURCE_CREDIBILITY[s]}" for s in SOURCE_NAMES) + " ELSE 0.5 END"


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    named = F.expr(_source_name.replace("INTEGER", "INT"))
    content = F.when(F.pmod("doc_id", F.lit(4)) != 0, F.col("text")).when(F.pmod("doc_id", F.lit(8)) == 0, "")
    return I.posts(spark, sf).select("doc_id", "created_at", named.alias("outlet"), content.alias("content"), (F.pmod("doc_id", F.lit(10)) + 0).alias("sector_id"))


ARTICLES_SQL = f"""WITH a AS (
  SELECT doc_id, created_at, {_source_name} AS outlet, CASE WHEN doc_id % 4 <> 0 THEN text WHEN doc_id % 8 = 0 THEN '' END AS content, doc_id % 10 AS sector_id FROM ({I.POSTS_SQL}) p
), v AS (
  SELECT *, 0.6 * {_credibility} + 0.4 * CASE WHEN length(content) > 0 THEN 1.0 ELSE 0.5 END AS value, epoch(TIMESTAMP '{I.AS_OF}' - created_at) / 3600 AS age FROM a
)
"""
SCORE_SQL = "CASE WHEN created_at IS NULL OR age > 240 THEN 0.0 ELSE greatest(0, least(1, 0.5 * {rel} + 0.4 * value + 0.1 * greatest(0, least(1, 1 - age / 24)))) END"


@query(ARTICLES_SQL + "SELECT doc_id, outlet, round(CAST(value AS DOUBLE), 6) AS value FROM v")
def q_article_value(spark, sf):
    a = scoring.with_credibility(_articles(spark, sf), "outlet")
    return a.select("doc_id", "outlet", r6(scoring.article_value(F.col("credibility"), F.col("content"))).alias("value"))


@query(ARTICLES_SQL + f"SELECT doc_id, round({SCORE_SQL.format(rel='CASE WHEN sector_id <> 9 THEN 1 ELSE 0 END')}, 6) AS score FROM v")
def q_article_score(spark, sf):
    a = scoring.with_credibility(_articles(spark, sf), "outlet")
    value = scoring.article_value(F.col("credibility"), F.col("content"))
    return a.select("doc_id", r6(scoring.total_score(F.col("sector_id") != 9, value, F.col("created_at"), as_of())).alias("score"))


POST_VALUES_SQL = f"""WITH v AS (
  SELECT *, (least(1, like_count / 5000) + least(1, retweet_count / 1000) + least(1, quote_count / 300) + least(1, reply_count / 600) + least(1, followers_count / 200000)) / 5 AS value,
    epoch(TIMESTAMP '{I.AS_OF}' - created_at) / 3600 AS age FROM ({I.POSTS_SQL}) p
)
"""


@query(POST_VALUES_SQL + f"""SELECT doc_id, round(CASE WHEN fresh THEN CASE WHEN asset_id <> 0 THEN 1.0 ELSE 0.0 END ELSE 0.0 END, 6) AS relevance, round(CASE WHEN fresh THEN value ELSE 0 END, 6) AS value,
  round(CASE WHEN fresh THEN greatest(0, least(1, 1 - age / 24)) ELSE 0 END, 6) AS recency, round(score, 6) AS score
  FROM (SELECT *, created_at IS NOT NULL AND age <= 240 AS fresh, {SCORE_SQL.format(rel='CASE WHEN asset_id <> 0 THEN 1 ELSE 0 END')} AS score FROM v)""")
def q_post_score(spark, sf):
    p = I.posts(spark, sf)
    entry = scoring.post_entry(F.col("asset_id"), scoring.post_value({c: F.col(c) for c in scoring.CAPS}), F.col("created_at"), as_of())
    return p.select("doc_id", entry.alias("e")).select("doc_id", *[r6(f"e.{c}").alias(c) for c in ("relevance", "value", "recency", "score")])


@query("SELECT CASE WHEN length(text) >= 2000 THEN 3 WHEN length(text) >= 500 THEN 2 ELSE 1 END AS weight, count(*) AS n FROM documents GROUP BY 1")
def q_article_weight(spark, sf):
    return I.table(spark, sf, "documents").groupBy(scoring.article_weight(F.col("text")).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' ELSE 'A' || (doc_id % 5) || '=1.0' END AS tokens, CASE doc_id % 5 WHEN 0 THEN 0 ELSE 1 END AS top_n,
  CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 WHEN 3 THEN -0.5 ELSE -1.0 END AS sentiment FROM documents""")
def q_tokens(spark, sf):
    a, symbol = F.pmod("doc_id", F.lit(5)), F.concat(F.lit("A"), F.pmod("doc_id", F.lit(5)).cast("string"))
    sentiment = F.element_at(F.array(*[F.lit(s) for s in scoring.SENTIMENT_VALUES]), (a + 1).cast("int"))
    out = I.table(spark, sf, "documents").select("doc_id", scoring.tokens(a, symbol).alias("t"), scoring.top_relevance(a, symbol).alias("top"), scoring.sentiment_value(sentiment).alias("sentiment"))
    return out.select("doc_id", F.array_join(F.transform(F.map_entries("t"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("tokens"), F.size("top").alias("top_n"), "sentiment")


@query("""WITH c AS (SELECT *, lag(turn, 1) OVER w AS t1, lag(role, 1) OVER w AS r1, lag(text, 1) OVER w AS x1, lag(turn, 2) OVER w AS t2, lag(role, 2) OVER w AS r2, lag(text, 2) OVER w AS x2
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, md5(concat_ws(chr(10), r1 || ': ' || x1, r2 || ': ' || x2, role || ': ' || text)) AS lines_md5 FROM c""")
def q_chat_context(spark, sf):
    message = F.struct(F.col("role").alias("user"), F.col("text").alias("content"))
    c = I.table(spark, sf, "conversations").select("conv_id", "turn", text.previous(message, "conv_id", "turn").alias("context"), message.alias("own"))
    return c.select("conv_id", "turn", F.md5(text.conversation_lines(text.with_context(F.col("context"), F.col("own")))).alias("lines_md5"))


@query(_match_sql(I.FIXTURE, I.FIXTURE[-1], "(SELECT conv_id * 1000 + turn AS k, text FROM conversations)", "k") + """
SELECT CAST(floor(k / 1000) AS BIGINT) AS conv_id, array_to_string(list(k % 1000 ORDER BY k) FILTER (WHERE confidence <> 'low'), ',') AS turns
FROM matched GROUP BY 1 HAVING count(*) FILTER (WHERE confidence <> 'low') > 0""")
def q_contributing(spark, sf):
    # message by message, so that only numbers of turns are gathered
    message = F.array(F.struct(F.col("turn").alias("id"), F.col("text").alias("content")))
    m = I.table(spark, sf, "conversations").select("conv_id", F.explode(matching.contributing(message, I.FIXTURE, I.FIXTURE[-1])).alias("turn"))
    return m.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list("turn")).cast("array<string>"), ",").alias("turns"))


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id % 6 ELSE 0 END AS BIGINT) AS id,
  CASE WHEN doc_id % 3 <> 0 THEN 'NONE' WHEN doc_id % 6 = 3 THEN 'SOL' ELSE 'ASSET_0' END AS symbol, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM documents""")
def q_inherited(spark, sf):
    from ..sources.registries import ASSETS

    asset = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.pmod("doc_id", F.lit(6)))
    m = matching.inherited(matching.match(F.lit("x"), ASSETS, NO_ASSET), asset, ASSETS)
    return I.table(spark, sf, "documents").select("doc_id", m.alias("m")).select("doc_id", "m.id", "m.symbol", "m.confidence")


E = f"WITH e AS ({I.EVENTS_SQL})"


@query(f"{E} {I.ledger_sql('reward')}")
def q_epoch_rewards(spark, sf):
    e = I.events(spark, sf).where("kind = 'reward'").select("epoch", "hotkey", F.lit(1).cast("long").alias("amount"))
    return ledger.accumulated(e)


@query(f"{E} {I.ledger_sql('penalty')}")
def q_epoch_penalties(spark, sf):
    e = I.events(spark, sf).where("kind = 'penalty'").select("epoch", "hotkey", F.lit(1).cast("long").alias("amount"))
    return ledger.accumulated(e)


R = f"{E}, r AS ({I.ledger_sql('reward')}), p AS ({I.ledger_sql('penalty')})"


@query(f"{R} SELECT * FROM r WHERE epoch IN (SELECT DISTINCT epoch FROM r ORDER BY epoch DESC LIMIT {ledger.KEEP_EPOCHS})")
def q_epoch_retention(spark, sf):
    return ledger.retained(I.ledger(spark, sf, "reward"))


@query(f"{R} SELECT * FROM r WHERE epoch = (SELECT DISTINCT epoch FROM r ORDER BY epoch DESC LIMIT 1 OFFSET 1)")
def q_relative_epoch(spark, sf):
    return ledger.at_relative_epoch(I.ledger(spark, sf, "reward"), -2)


@query(f"{R} SELECT epoch, array_to_string(list(hotkey || '=' || amount ORDER BY hotkey), ',') AS amounts FROM r GROUP BY epoch")
def q_epoch_maps(spark, sf):
    out = ledger.epoch_maps(I.ledger(spark, sf, "reward"))
    return out.select("epoch", F.array_join(F.transform(F.map_entries("amounts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("amounts"))


@query(f"{R} SELECT p.epoch, p.hotkey, coalesce(r.amount, 0) AS amount FROM p LEFT JOIN r ON r.epoch = p.epoch AND r.hotkey = p.hotkey")
def q_points_of(spark, sf):
    """What those with a penalty earned in its epoch."""
    return ledger.points_of(I.ledger(spark, sf, "reward"), I.ledger(spark, sf, "penalty").select("epoch", "hotkey"))


B = f"""{E}, b AS ({I.BROADCASTS_SQL}), s AS (
  SELECT *, CASE WHEN seq <= greatest(coalesce(max(seq) OVER (PARTITION BY sender ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), -1) THEN 'duplicate_or_old_seq' WHEN value <= 0 THEN 'empty_payload' ELSE 'accepted' END AS reason FROM b
), kept AS (
  SELECT epoch, sender, arg_max(uid, arrival) AS uid, arg_max(value, arrival) AS value FROM s WHERE reason = 'accepted' GROUP BY epoch, sender
), snap AS (
  SELECT * FROM kept WHERE epoch IN (SELECT DISTINCT epoch FROM kept ORDER BY epoch DESC LIMIT {consensus.KEEP_BROADCAST_EPOCHS})
)"""


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.snapshots(consensus.sequenced(I.broadcasts(spark, sf)).where("accepted"))


@query(f"{B} SELECT sender, arrival, seq, reason FROM s")
def q_broadcast_dedup(spark, sf):
    return consensus.sequenced(I.broadcasts(spark, sf)).select("sender", "arrival", "seq", "reason")


@query(f"""WITH RECURSIVE e AS ({I.EVENTS_SQL}), n AS (SELECT sender, arrival, seq, value > 0 AS filled, row_number() OVER (PARTITION BY sender ORDER BY arrival) AS r FROM ({I.BROADCASTS_SQL})),
f AS (
  SELECT sender, r, arrival, seq, filled, CAST(-1 AS BIGINT) AS last FROM n WHERE r = 1
  UNION ALL
  SELECT n.sender, n.r, n.arrival, n.seq, n.filled, CASE WHEN f.seq > f.last OR (f.last > 0 AND f.seq < floor(f.last / 10)) THEN f.seq ELSE f.last END FROM f JOIN n ON n.sender = f.sender AND n.r = f.r + 1
)
SELECT sender, arrival, seq, CASE WHEN seq <= last AND NOT (last > 0 AND seq < floor(last / 10)) THEN 'duplicate_or_old_seq' WHEN NOT filled THEN 'empty_payload' ELSE 'accepted' END AS reason FROM f""")
def q_broadcast_reset(spark, sf):
    return consensus.sequenced_with_reset(I.broadcasts(spark, sf)).select("sender", "arrival", "seq", "reason")


@query(f"{B} SELECT epoch, uid, CAST(sum(value) AS BIGINT) AS value FROM snap GROUP BY epoch, uid")
def q_broadcast_agg(spark, sf):
    return consensus.totals(_snapshots(spark, sf))


@query(f"{B} SELECT epoch, sender, uid, value FROM snap WHERE epoch > (SELECT min(epoch) FROM snap) AND sender <> 'v3'")
def q_flush(spark, sf):
    s = _snapshots(spark, sf)
    first = s.agg(F.min("epoch")).first()[0]
    return consensus.without_sender(consensus.flushed(s, first if first is not None else -1), "v3").select("epoch", "sender", "uid", "value")


# days instead of epochs, so that several validators meet in one
Q = f"""{E}, part AS ({I.PARTICIPANTS_SQL}), votes AS (SELECT CAST(floor(epoch / 72) AS BIGINT) AS day, 'v' || CAST(event_id % 7 AS VARCHAR) AS sender, CAST(user_id AS INTEGER) AS uid, kind FROM e WHERE kind = 'penalty' AND event_id % 3 <> 0),
own AS (SELECT DISTINCT CAST(floor(epoch / 72) AS BIGINT) AS day, CAST(user_id AS INTEGER) AS uid FROM e WHERE kind = 'penalty' AND event_id % 3 = 0),
quorum AS (SELECT day AS epoch, uid, CAST(sum(n) AS BIGINT) AS votes FROM (SELECT day, uid, 1 AS n FROM own UNION ALL SELECT day, uid, count(DISTINCT sender) FROM votes GROUP BY day, uid) GROUP BY day, uid HAVING sum(n) >= {consensus.QUORUM})"""


def _penalised(spark: SparkSession, sf: str) -> DataFrame:
    e = I.events(spark, sf).where("kind = 'penalty'").select(F.floor(F.col("epoch") / 72).cast("long").alias("epoch"), "event_id", F.col("user_id").cast("int").alias("uid"), F.lit(1).alias("value"))
    own = e.where("event_id % 3 = 0").groupBy("epoch", "uid").agg(F.sum("value").alias("value"))
    peers = e.where("event_id % 3 <> 0").select("epoch", F.concat(F.lit("v"), F.pmod("event_id", F.lit(7)).cast("string")).alias("sender"), "uid", "value")
    return consensus.penalised(own, peers)


@query(f"{Q} SELECT * FROM quorum")
def q_quorum(spark, sf):
    return _penalised(spark, sf)


S = f"""{Q}, points AS (SELECT CAST(floor(epoch / 72) AS BIGINT) AS epoch, CAST(user_id AS INTEGER) AS uid, count(*) FILTER (WHERE event_id % 2 = 0) + coalesce(count(*) FILTER (WHERE event_id % 2 = 1 AND user_id % 10 <> 0), 0) AS value FROM e WHERE kind = 'reward' GROUP BY 1, 2),
settled AS (SELECT p.epoch, part.hotkey, CASE WHEN p.value > 0 AND q.uid IS NULL THEN p.value ELSE 0 END AS reward FROM points p JOIN part USING (uid) LEFT JOIN quorum q ON p.epoch = q.epoch AND p.uid = q.uid)"""


def _settled(spark: SparkSession, sf: str) -> DataFrame:
    people = I.participants(spark, sf)
    e = I.events(spark, sf).where("kind = 'reward'").withColumn("day", F.floor(F.col("epoch") / 72).cast("long"))
    own = e.groupBy(F.col("day").alias("epoch"), "hotkey").agg(F.count_if(F.col("event_id") % 2 == 0).alias("amount"))
    peers = e.where("event_id % 2 = 1").groupBy(F.col("day").alias("epoch"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("sender"), F.col("user_id").cast("int").alias("uid")).agg(F.count(F.lit(1)).alias("value"))
    barred = people.where(F.col("uid") % 10 == 0).select("hotkey")
    merged = consensus.merged_rewards(consensus.to_uids(own, people), peers, people, barred)
    return consensus.settled(merged, _penalised(spark, sf), people)


@query(f"{S} SELECT * FROM settled")
def q_settlement(spark, sf):
    return _settled(spark, sf)


@query(f"{R} SELECT epoch, hotkey, coalesce(r.amount, 0) - coalesce(p.amount, 0) AS score, epoch * 100 AS start_block, (epoch + 1) * 100 - 1 AS stop_block FROM r FULL JOIN p USING (epoch, hotkey)")
def q_reward_penalty_score(spark, sf):
    return consensus.net_scores(I.ledger(spark, sf, "reward"), I.ledger(spark, sf, "penalty"))


@query(f"{S} SELECT epoch * 100 AS start_block, epoch * 100 + 99 AS stop_block, hotkey, CAST(reward AS DOUBLE) AS points FROM settled")
def q_reward_payload(spark, sf):
    return readers.reward_rows(_settled(spark, sf))


@query(f"{R} SELECT hotkey, 'epoch=' || epoch || ' count=' || amount AS reason FROM p WHERE amount > 0")
def q_penalty_payload(spark, sf):
    return readers.penalty_rows(I.ledger(spark, sf, "penalty"))


ECONOMY = Economy(token_usd=300.0, subnet_price=0.02, emission=1e9)


def _latest_rewards(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.createDataFrame([("nobody", 500)], "hotkey string, reward long")
    s = _settled(spark, sf)
    return s.join(F.broadcast(s.agg(F.max("epoch").alias("epoch"))), "epoch").select("hotkey", "reward").unionByName(extra)


X = f"""{S}, latest AS (SELECT hotkey, reward FROM settled WHERE epoch = (SELECT max(epoch) FROM settled) UNION ALL SELECT 'nobody', 500),
pct AS (SELECT hotkey, greatest(reward / {ECONOMY.alpha_per_point()!r} / {ECONOMY.worker_alpha() * ECONOMY.epoch_length!r} * 100, reward * {ECONOMY.min_percent_per_point}) AS percent FROM latest), tot AS (SELECT sum(percent) AS total FROM pct),
w AS (SELECT part.uid, CASE WHEN part.uid = 0 THEN 1 - least(tot.total, 100) / 100 ELSE coalesce(pct.percent, 0) * CASE WHEN tot.total > 100 THEN 100 / tot.total ELSE 1 END / 100 END AS weight FROM part CROSS JOIN tot LEFT JOIN pct USING (hotkey))"""


@query(f"{X} SELECT uid, round(weight, 6) AS weight FROM w")
def q_weights_floor_scale_burn(spark, sf):
    out = weights.point_weights(_latest_rewards(spark, sf), I.participants(spark, sf), ECONOMY)
    return out.select("uid", r6("weight").alias("weight"))


def _stakes(spark: SparkSession, sf: str) -> DataFrame:
    return I.participants(spark, sf).select("uid", F.greatest(F.col("stake"), F.lit(0.0)).alias("weight"))


def _length() -> Column:
    """Slots of a registry: as many as it has participants, and enough for its last uid."""
    return F.greatest(F.count(F.lit(1)), F.max("uid") + 1)


STAKES = f"WITH part AS ({I.PARTICIPANTS_SQL}), s AS (SELECT uid, greatest(stake, 0) AS weight FROM part)"


def _cap_sql(source: str, limit: float) -> str:
    return f"""cap1 AS (SELECT *, weight / sum(weight) OVER () AS share, sum(weight) OVER () AS total, count(*) OVER () AS n, row_number() OVER (ORDER BY weight, uid) AS k FROM {source}),
cap2 AS (SELECT *, sum(share) OVER (ORDER BY weight, uid ROWS UNBOUNDED PRECEDING) AS cum FROM cap1),
cap3 AS (SELECT *, count(*) FILTER (WHERE share / ((n - k) * share + cum + 1e-7) < {limit}) OVER () AS below FROM cap2),
cap4 AS (SELECT *, max(cum) FILTER (WHERE k = below) OVER () AS reach FROM cap3),
cap5 AS (SELECT uid, CASE WHEN max(share) OVER () <= {limit} THEN weight ELSE least(weight, ({limit} * reach - 1e-7) / (1 - {limit} * (n - below)) * total) END AS cut FROM cap4),
capped AS (SELECT uid, cut / sum(cut) OVER () AS weight FROM cap5)"""


@query(f"{STAKES}, {_cap_sql('s', 0.01)} SELECT uid, round(weight, 6) AS weight FROM capped")
def q_weights_cap(spark, sf):
    return weights.capped_share(_stakes(spark, sf), 0.01).select("uid", r6("capped").alias("weight"))


@query(f"""{STAKES}, f AS (SELECT uid, CAST(CAST(weight AS FLOAT) AS DOUBLE) AS weight FROM s WHERE CAST(weight AS FLOAT) > 0), q AS (SELECT quantile_cont(weight, 0.25) AS cut FROM f),
kept AS (SELECT f.* FROM f, q WHERE CAST(weight AS FLOAT) >= CAST(cut AS FLOAT)), {_cap_sql('kept', 0.012)} SELECT uid, round(weight, 6) AS weight FROM capped""")
def q_weights_quantile(spark, sf):
    return weights.processed(_stakes(spark, sf), min_allowed=8, max_limit=0.012, quantile=0.25).select("uid", r6("weight").alias("weight"))


@query(f"{STAKES} SELECT uid, CAST(round_even(weight / (SELECT max(weight) FROM s) * 65535, 0) AS INTEGER) AS value FROM s WHERE round_even(weight / (SELECT max(weight) FROM s) * 65535, 0) > 0")
def q_weights_u16(spark, sf):
    return weights.emitted(_stakes(spark, sf))


@query(f"WITH part AS ({I.PARTICIPANTS_SQL}) SELECT uid, round(stake / (SELECT sum(abs(stake)) FROM part), 6) + 0.0 AS raw FROM part")
def q_l1_norm(spark, sf):
    out = weights.l1_normalised(weights.updated_scores(I.participants(spark, sf).select("uid", F.col("stake").alias("score"))))
    return out.select("uid", r6("raw").alias("raw"))


@query(f"WITH part AS ({I.PARTICIPANTS_SQL}) SELECT uid, CASE WHEN uid % 9 = 0 OR uid >= (SELECT greatest(count(*), max(uid) + 1) FROM part) - 10 THEN 0.0 ELSE round(stake, 6) END AS score FROM part")
def q_resync(spark, sf):
    now = I.participants(spark, sf)
    # the last ten of the registry are new
    size = now.agg(_length().alias("size"))
    before = now.crossJoin(F.broadcast(size)).where("uid < size - 10").select("uid", F.when(F.col("uid") % 9 == 0, "old").otherwise(F.col("hotkey")).alias("hotkey"))
    return weights.resynced(now.select("uid", F.col("stake").alias("score")), before, now).select("uid", r6("score").alias("score"))


@query(f"WITH part AS ({I.PARTICIPANTS_SQL}) SELECT CAST(k AS INTEGER) AS uid, coalesce(round(stake, 6), 0.0) AS weight FROM (SELECT unnest(generate_series(0, (SELECT greatest(count(*), max(uid) + 1) FROM part) + 9)) AS k) t LEFT JOIN part ON part.uid = t.k")
def q_dense_weights(spark, sf):
    p = I.participants(spark, sf).select("uid", F.col("stake").alias("weight"))
    # ten free slots behind the registry
    return weights.dense(p, p.agg(_length()).first()[0] + 10).select("uid", r6("weight").alias("weight"))


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in batches of three, a worker's labels and one's own, which mostly agree."""
    d = I.table(spark, sf, "documents")
    k = F.col("doc_id")
    label = lambda odd, name: F.when(F.pmod(k, F.lit(odd)) == 0, f"other_{name}").otherwise(F.upper(F.col("lang")))
    own = F.struct(F.pmod(k, F.lit(5)).alias("asset_id"), F.col("lang").alias("sentiment"), *[F.col("lang").alias(f) for f in validation.LABELS[1:]])
    worker = F.struct(F.when(F.pmod(k, F.lit(31)) != 0, F.pmod(k + F.when(F.pmod(k, F.lit(19)) == 0, 1).otherwise(0), F.lit(5))).alias("asset_id"), label(17, "s").alias("sentiment"), label(23, "c").alias("content_type"), *[F.col("lang").alias(f) for f in validation.LABELS[2:]])
    return d.select(F.floor(k / 3).cast("long").alias("batch"), k.alias("doc_id"), "text", F.when(F.pmod(k, F.lit(29)) != 0, worker).alias("worker"), F.when(F.pmod(k, F.lit(37)) != 0, own).alias("own"))


V = """WITH d AS (SELECT *, CAST(floor(doc_id / 3) AS BIGINT) AS batch FROM documents), s AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY md5('review' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS sample_index FROM d) WHERE sample_index < 2
), c AS (
  SELECT *, CASE WHEN doc_id % 29 = 0 THEN 'missing_miner_classification' WHEN doc_id % 31 = 0 THEN 'miner_needs_update' WHEN doc_id % 37 = 0 THEN 'validator_classification_failed'
    WHEN doc_id % 19 = 0 OR doc_id % 17 = 0 OR doc_id % 23 = 0 THEN 'classification_mismatch' END AS reason FROM s
)"""


@query(f"{V} SELECT batch, count(*) FILTER (WHERE reason IS NULL) AS matches, count(*) AS total_sampled, round(count(*) FILTER (WHERE reason IS NULL) / count(*), 6) AS match_rate, count(*) = count(*) FILTER (WHERE reason IS NULL) AS is_valid, coalesce(array_to_string(list(reason ORDER BY sample_index) FILTER (WHERE reason IS NOT NULL), ','), '') AS reasons FROM c GROUP BY batch")
def q_validate_batch(spark, sf):
    picked = validation.sampled(_reviews(spark, sf), 2, "review", "doc_id", ["batch"])
    out = validation.verdicts(validation.compared(picked))
    return out.select("batch", "matches", "total_sampled", r6("match_rate").alias("match_rate"), "is_valid", F.array_join(F.transform("discrepancies", lambda x: x["reason"]), ",").alias("reasons"))


@query(f"""{V}, v AS (SELECT batch, bool_and(reason IS NULL) AS ok FROM c GROUP BY batch)
  SELECT CAST(doc_id AS VARCHAR) AS item_id, 'hk' || CAST(doc_id % 150 AS VARCHAR) AS hotkey, CASE WHEN ok THEN 'Processed' ELSE 'Unprocessed' END AS status, CASE WHEN ok AND doc_id % 5 <> 0 THEN 1 ELSE 0 END AS reward,
  CASE WHEN NOT ok AND row_number() OVER (PARTITION BY batch ORDER BY CAST(doc_id AS VARCHAR)) = 1 THEN 1 ELSE 0 END AS penalty FROM d JOIN v USING (batch)""")
def q_apply_verdicts(spark, sf):
    reviews = _reviews(spark, sf)
    verdicts = validation.verdicts(validation.compared(validation.sampled(reviews, 2, "review", "doc_id", ["batch"])))
    items = reviews.select("batch", F.col("doc_id").cast("string").alias("item_id"), F.concat(F.lit("hk"), F.pmod("doc_id", F.lit(150)).cast("string")).alias("hotkey"), (F.col("doc_id") % 5 == 0).alias("rewarded"))
    return validation.applied(verdicts, items)


@query(f"""{V}, v AS (SELECT batch, bool_and(reason IS NULL) AS ok FROM c GROUP BY batch), z AS (SELECT batch, bool_and(doc_id % 43 <> 0) AS whole FROM d GROUP BY batch)
  SELECT CAST(doc_id AS VARCHAR) AS item_id, CASE WHEN ok AND whole THEN 'Processed' ELSE 'Unprocessed' END AS status, CASE WHEN ok AND whole AND doc_id % 5 <> 0 THEN doc_id % 3 + 1 ELSE 0 END AS reward,
  CASE WHEN NOT (ok AND whole) AND row_number() OVER (PARTITION BY batch ORDER BY CAST(doc_id AS VARCHAR)) = 1 THEN 1 ELSE 0 END AS penalty FROM d JOIN v USING (batch) JOIN z USING (batch)""")
def q_handled_batches(spark, sf):
    """Batches of which some came back short, whose items weigh 1 to 3."""
    reviews = _reviews(spark, sf)
    verdicts = validation.verdicts(validation.compared(validation.sampled(reviews, 2, "review", "doc_id", ["batch"])))
    k = F.col("doc_id")
    sent = reviews.select("batch", k.cast("string").alias("item_id"), F.concat(F.lit("hk"), F.pmod(k, F.lit(150)).cast("string")).alias("hotkey"), (k % 5 == 0).alias("rewarded"), (k % 3 + 1).alias("weight"))
    returned = reviews.where("doc_id % 43 <> 0").select("batch")
    return validation.handled(sent, returned, verdicts, F.col("weight")).drop("hotkey")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN doc_id % 5 = 0 THEN 'extra' WHEN doc_id % 7 = 0 THEN 'a' ELSE '' END AS furthest FROM documents""")
def q_token_tolerance(spark, sf):
    k = F.col("doc_id")
    worker = F.create_map(F.lit(" A "), F.when(k % 7 == 0, 0.5).otherwise(0.98), F.lit("b"), F.lit(0.01), F.lit("extra"), F.when(k % 5 == 0, 0.9).otherwise(0.03))
    own = F.create_map(F.lit("a"), F.lit(1.0), F.lit("c"), F.lit(0.02))
    d = I.table(spark, sf, "documents").select(k, validation.token_differences(validation.selected_tokens(worker, own)).alias("d"))
    return d.select("doc_id", F.size("d").alias("n"), F.coalesce(F.try_element_at("d", F.lit(1))["key"], F.lit("")).alias("furthest"))


@query("""WITH p AS (SELECT 'h' || CAST(floor(doc_id / 8) AS BIGINT) AS hotkey, doc_id % 8 AS post_index, doc_id,
    CASE WHEN doc_id % 41 = 0 THEN 'missing_post_id' WHEN doc_id % 37 = 0 THEN 'empty_content' WHEN doc_id % 31 = 0 THEN 'analyzer_error' WHEN doc_id % 29 = 0 THEN 'tokens_mismatch' WHEN doc_id % 23 = 0 THEN 'sentiment_mismatch' END AS code FROM documents)
  SELECT hotkey, count(*) AS n_posts, count(code) = 0 AS valid, arg_min(code, post_index) FILTER (WHERE code IS NOT NULL) AS code, min(post_index) FILTER (WHERE code IS NOT NULL) AS post_index FROM p GROUP BY hotkey""")
def q_grade_first_failure(spark, sf):
    k = F.col("doc_id")
    odd = lambda n: k % n == 0
    one = lambda v: F.create_map(F.lit("btc"), v)
    p = I.table(spark, sf, "documents").select(
        F.concat(F.lit("h"), F.floor(k / 8).cast("string")).alias("hotkey"), (k % 8).alias("post_index"), F.when(~odd(41), k.cast("string")).alias("post_id"), F.when(odd(37), " \n ").otherwise(F.lit("words")).alias("content"),
        one(F.when(odd(29), 0.1).otherwise(0.97)).alias("tokens"), F.when(odd(23), 0.9).otherwise(0.03).alias("sentiment"), F.when(~odd(31), one(F.lit(1.0))).alias("own_tokens"), F.lit(0.0).alias("own_sentiment"),
    )
    return validation.graded(p).select("hotkey", "n_posts", "valid", F.col("fault.code").alias("code"), F.col("fault.post_index").alias("post_index"))


L = f"WITH w AS ({I.WORK_ITEMS_SQL})"


def _item_events(spark: SparkSession, sf: str) -> DataFrame:
    return _as_item_events(I.events(spark, sf))


def _as_item_events(e: DataFrame) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in (("signup", "add"), ("view", "process"), ("click", "result"), ("purchase", "done"), ("error", "reset")) for x in pair]), F.col("event_type"))
    owner = F.when(kind == "process", F.concat(F.lit("w"), F.pmod("event_id", F.lit(9)).cast("string")))
    return e.select(F.concat(F.lit("i"), F.pmod(F.col("user_id") * 13 + F.floor("value"), F.lit(500)).cast("string")).alias("item_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.col("ts").alias("at"), owner.alias("hotkey"))


LE = f"""{E}, x AS (SELECT 'i' || CAST(CAST(user_id * 13 + floor(value) AS BIGINT) % 500 AS VARCHAR) AS item_id, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'add' WHEN 'view' THEN 'process' WHEN 'click' THEN 'result' WHEN 'purchase' THEN 'done' ELSE 'reset' END AS event, ts AS at, CASE WHEN event_type = 'view' THEN 'w' || CAST(event_id % 9 AS VARCHAR) END AS hotkey FROM e)"""


@query(f"""{LE} SELECT item_id, coalesce(arg_max(CASE event WHEN 'process' THEN 'Processing' WHEN 'done' THEN 'Processed' ELSE 'Unprocessed' END, seq) FILTER (WHERE event IN ('add', 'process', 'done', 'reset')), 'Unprocessed') AS status,
  arg_max(hotkey, seq) FILTER (WHERE event = 'process') AS hotkey FROM x GROUP BY item_id""")
def q_lifecycle_latest(spark, sf):
    return lifecycle.current(_item_events(spark, sf)).select("item_id", "status", "hotkey")


@query(f"{L} SELECT item_id, hotkey FROM w WHERE status = 'Processing' AND start_time IS NOT NULL AND TIMESTAMP '{I.AS_OF}' - start_time > INTERVAL 300 SECONDS")
def q_timeouts(spark, sf):
    return lifecycle.timed_out(I.work_items(spark, sf), as_of()).select("item_id", "hotkey")


@query(f"{L} SELECT hotkey, count(*) AS penalty FROM w WHERE status = 'Processing' AND start_time IS NOT NULL AND TIMESTAMP '{I.AS_OF}' - start_time > INTERVAL 900 SECONDS GROUP BY hotkey")
def q_requeue_penalties(spark, sf):
    return lifecycle.requeued(I.work_items(spark, sf), as_of(), "article")[1]


@query(f"{L} SELECT item_id FROM w WHERE status = 'Processed' AND NOT submitted")
def q_ready(spark, sf):
    return lifecycle.ready(I.work_items(spark, sf)).select("item_id")


@query(f"{L} SELECT item_id FROM w WHERE NOT submitted AND (start_time IS NULL OR TIMESTAMP '{I.AS_OF}' - start_time <= INTERVAL 1500 SECONDS) ORDER BY start_time DESC NULLS LAST, item_id LIMIT 1000")
def q_prune(spark, sf):
    return lifecycle.pruned(I.work_items(spark, sf), as_of(), 1500).select("item_id")


@query(f"{L} SELECT item_id FROM w WHERE NOT submitted AND (start_time IS NULL OR TIMESTAMP '{I.AS_OF}' - start_time <= INTERVAL 1500 SECONDS) ORDER BY start_time DESC NULLS FIRST, item_id LIMIT 1000")
def q_prune_articles(spark, sf):
    return lifecycle.pruned(I.work_items(spark, sf), as_of(), 1500, nulls_go_first=False).select("item_id")


@query(f"{E} SELECT user_id % 40 AS item_id, min(event_id) AS seq FROM e WHERE kind = 'reward' GROUP BY 1")
def q_idempotent_reward(spark, sf):
    e = I.events(spark, sf).where("kind = 'reward'").select((F.col("user_id") % 40).alias("item_id"), F.col("event_id").alias("seq"))
    return lifecycle.rewarded_once(e)


@query(f"""{L}, b AS (SELECT CAST(floor(CAST(item_id AS BIGINT) / 12) AS BIGINT) AS batch, item_id, status, hotkey, CAST(item_id AS BIGINT) % 50 = 0 AS locked FROM w WHERE CAST(item_id AS BIGINT) % 3 <> 1)
  SELECT batch, bool_and(status = 'Processing' AND NOT locked) AS accepted FROM b GROUP BY batch""")
def q_batch_guard(spark, sf):
    items = I.work_items(spark, sf)
    k = F.col("item_id").cast("long")
    results = items.where(k % 3 != 1).select(F.floor(k / 12).cast("long").alias("batch"), "item_id", "hotkey")
    return lifecycle.accepted_batches(results, items, items.where(k % 50 == 0).select("item_id"))


@query(f"{L} SELECT CAST(c_custkey AS VARCHAR) AS item_id, status, hotkey, coalesce(rewarded, false) AS is_rewarded FROM customer LEFT JOIN w ON w.item_id = CAST(c_custkey AS VARCHAR)")
def q_looked_up(spark, sf):
    ids = I.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("item_id"))
    return lifecycle.looked_up(I.work_items(spark, sf), ids).select("item_id", "status", "hotkey", "is_rewarded")


@query(f"""{L}, s AS (SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier), c AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer)
  SELECT item_id, submitted OR item_id IN (SELECT id FROM c) AS submitted, rewarded OR item_id IN (SELECT id FROM c) AS rewarded FROM w WHERE item_id NOT IN (SELECT id FROM s) AND NOT coalesce(start_time < TIMESTAMP '{I.AS_OF}' - to_seconds(1500), false)""")
def q_point_changes(spark, sf):
    """Items after some were submitted and rewarded, some deleted by id, and some by age."""
    ids = lambda name, key: I.table(spark, sf, name).select(F.col(key).cast("string").alias("item_id"))
    out = lifecycle.rewarded(lifecycle.submitted(I.work_items(spark, sf), ids("customer", "c_custkey")), ids("customer", "c_custkey"))
    out = lifecycle.deleted(out, ids("supplier", "s_suppkey"), F.col("start_time") < as_of() - F.expr("interval 1500 seconds"))
    return out.select("item_id", "submitted", "rewarded")


@query(f"{L} SELECT item_id, status FROM w WHERE status = 'Unprocessed' UNION ALL SELECT item_id, status FROM w WHERE CAST(item_id AS BIGINT) % 97 = 0")
def q_union_pending(spark, sf):
    w = I.work_items(spark, sf).select("item_id", "status")
    return lifecycle.pending(w.where(F.col("item_id").cast("long") % 97 == 0), w)


@query(f"""{L}, old AS (SELECT item_id, CASE WHEN CAST(item_id AS BIGINT) % 2 = 0 THEN hotkey END AS hotkey FROM w WHERE CAST(item_id AS BIGINT) % 3 = 0), new AS (SELECT item_id, hotkey FROM w WHERE CAST(item_id AS BIGINT) % 5 = 0)
  SELECT o.item_id, coalesce(o.hotkey, n.hotkey) AS hotkey FROM old o LEFT JOIN new n USING (item_id) UNION ALL SELECT item_id, hotkey FROM new WHERE item_id NOT IN (SELECT item_id FROM old)""")
def q_insert_if_absent(spark, sf):
    w = I.work_items(spark, sf).select("item_id", "hotkey")
    k = F.col("item_id").cast("long")
    old = w.where(k % 3 == 0).withColumn("hotkey", F.when(k % 2 == 0, F.col("hotkey")))
    return lifecycle.inserted(old, w.where(k % 5 == 0))


@query(f"""{E}, o AS (SELECT hotkey, ts, event_id, event_type <> 'error' AND event_id % 4 = 0 AS ok FROM e WHERE event_type <> 'signup'),
n AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY hotkey ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY hotkey) AS runs FROM o),
g AS (SELECT hotkey, count(*) AS failures, max(ts) AS last FROM n WHERE NOT ok AND run = runs GROUP BY hotkey), l AS (SELECT *, CAST(least(greatest(failures - 9, 0), 5) AS INTEGER) AS level FROM g)
  SELECT hotkey, failures, level, CASE WHEN level > 0 THEN CAST(floor(epoch(last + to_seconds([30, 60, 120, 300, 600][level]))) AS BIGINT) END AS until FROM l""")
def q_cooldown_runs(spark, sf):
    e = I.events(spark, sf).where("event_type <> 'signup'")
    o = e.select("hotkey", F.col("ts").alias("at"), "event_id", ((F.col("event_type") != "error") & (F.col("event_id") % 4 == 0)).alias("ok"))
    return dispatch.cooldowns(o).withColumn("until", F.unix_seconds("until"))


C = f"""{L}, part AS ({I.PARTICIPANTS_SQL}), q AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY CAST(item_id AS BIGINT), item_id) - 1) / 3) AS BIGINT) AS batch FROM (SELECT item_id FROM w WHERE status = 'Unprocessed' ORDER BY CAST(item_id AS BIGINT) LIMIT 768))"""


@query(f"""{C}, k AS (SELECT hotkey, row_number() OVER (ORDER BY md5('poll' || hotkey), hotkey) - 1 AS place FROM part WHERE is_serving AND NOT (validator_permit AND stake > 4096) AND hotkey <> 'hk7' AND uid % 11 <> 0), n AS (SELECT batch, row_number() OVER (ORDER BY batch) - 1 AS place FROM (SELECT DISTINCT batch FROM q))
  SELECT q.item_id, q.batch, k.hotkey FROM q JOIN n USING (batch) JOIN k USING (place)""")
def q_chunk_dispatch(spark, sf):
    items = lifecycle.with_status(I.work_items(spark, sf), "Unprocessed").select("item_id", F.col("item_id").cast("long").alias("arrived"))
    batches = dispatch.numbered_batches(items, "arrived")
    people = I.participants(spark, sf)
    pairs = dispatch.assigned(batches, dispatch.available(people), "poll", me="hk7", barred=people.where("uid % 11 = 0"))
    return batches.join(pairs, "batch").select("item_id", "batch", "hotkey")


POLL_AT = "2024-01-30 23:26:20"
DP = f"""{E}, w AS ({I.WORK_ITEMS_SQL}), part AS ({I.PARTICIPANTS_SQL}), o AS (SELECT hotkey, ts, event_id, event_type <> 'error' AND event_id % 4 = 0 AS ok FROM e WHERE event_type <> 'signup'),
n AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY hotkey ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY hotkey) AS runs FROM o),
g AS (SELECT hotkey, CAST(least(greatest(count(*) - 9, 0), 5) AS INTEGER) AS level, max(ts) AS last FROM n WHERE NOT ok AND run = runs GROUP BY hotkey),
cool AS (SELECT hotkey FROM g WHERE level > 0 AND last + to_seconds([30, 60, 120, 300, 600][level]) > TIMESTAMP '{POLL_AT}'),
busy AS (SELECT hotkey, count(*) AS busy FROM (SELECT DISTINCT hotkey, floor(CAST(item_id AS BIGINT) / 12) AS batch FROM w WHERE status = 'Processing') GROUP BY hotkey),
offer AS (SELECT hotkey, {dispatch.MAX_IN_FLIGHT} - coalesce(busy, 0) AS slots FROM part LEFT JOIN busy USING (hotkey) WHERE is_serving AND NOT (validator_permit AND stake > 4096) AND hotkey <> 'hk7' AND uid % 11 <> 0 AND hotkey NOT IN (SELECT hotkey FROM cool) AND slots > 0),
span AS (SELECT hotkey, sum(slots) OVER (ORDER BY md5('plan' || hotkey), hotkey ROWS UNBOUNDED PRECEDING) AS upto, slots FROM offer),
q AS (SELECT item_id, CAST(floor((row_number() OVER (ORDER BY CAST(item_id AS BIGINT), item_id) - 1) / 3) AS BIGINT) AS batch FROM w WHERE status = 'Unprocessed'),
plan AS (SELECT q.item_id, q.batch, span.hotkey FROM q LEFT JOIN span ON q.batch < span.upto AND q.batch >= span.upto - span.slots)"""


def _dispatch_plan(spark: SparkSession, sf: str) -> DataFrame:
    work = I.work_items(spark, sf)
    items = lifecycle.with_status(work, "Unprocessed").select("item_id", F.col("item_id").cast("long").alias("arrived"))
    people = I.participants(spark, sf)
    busy = lifecycle.with_status(work, "Processing").select("hotkey", F.floor(F.col("item_id").cast("long") / 12).alias("batch")).distinct()
    e = I.events(spark, sf).where("event_type <> 'signup'")
    runs = dispatch.cooldowns(e.select("hotkey", F.col("ts").alias("at"), "event_id", ((F.col("event_type") != "error") & (F.col("event_id") % 4 == 0)).alias("ok")))
    at = F.lit(POLL_AT).cast("timestamp")
    return dispatch.planned(items, dispatch.available(people), busy, runs, at, "plan", me="hk7", barred=people.where("uid % 11 = 0"), each=dispatch.MAX_IN_FLIGHT, pending=None)


@query(f"{DP} SELECT item_id, batch, hotkey FROM plan")
def q_dispatch_plan(spark, sf):
    """Which batch of waiting items goes to which worker's free slot in one poll, and which waits."""
    return _dispatch_plan(spark, sf).select("item_id", "batch", "hotkey")


@query(f"""{DP}, r AS (SELECT *, hotkey IS NOT NULL AND CAST(substr(hotkey, 3) AS BIGINT) % 13 <> 0 AS sent FROM plan)
  SELECT item_id, batch, CASE WHEN sent AND batch % 7 <> 0 AND batch % 11 <> 3 THEN 'Processing' ELSE 'Unprocessed' END AS status, CASE WHEN sent THEN hotkey END AS hotkey FROM r""")
def q_dispatch_outcome(spark, sf):
    """Items after the replies: one batch in seven is refused, some replies are missing, some workers had no slot left."""
    plan = _dispatch_plan(spark, sf)
    k = F.col("batch")
    replies = plan.select("batch").distinct().where(k % 11 != 3).withColumn("code", F.when(k % 7 == 0, 500).otherwise(200))
    full = I.participants(spark, sf).where("uid % 13 = 0")
    return dispatch.delivered(plan, replies, F.lit(POLL_AT).cast("timestamp"), full)[0].select("item_id", "batch", "status", "hotkey")


@query(f"WITH part AS ({I.PARTICIPANTS_SQL}) SELECT uid FROM part WHERE uid <> 5 ORDER BY CASE WHEN uid IN (3, 90) THEN 0 ELSE 1 END, md5('pick' || CAST(uid AS VARCHAR)), uid LIMIT 12")
def q_sample_uids(spark, sf):
    return dispatch.chosen_uids(I.participants(spark, sf), 12, "pick", include=[3, 90], exclude=[5]).select("uid")


@query(f"WITH part AS ({I.PARTICIPANTS_SQL}) SELECT DISTINCT hotkey FROM (SELECT hotkey FROM part WHERE validator_permit AND stake >= 4096 UNION ALL SELECT 'hk' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey <= 8)")
def q_allowlist(spark, sf):
    manual = I.table(spark, sf, "supplier").where("s_suppkey <= 8").select(F.concat(F.lit("hk"), F.col("s_suppkey").cast("string")).alias("hotkey"))
    return dispatch.validators(I.participants(spark, sf), 4096, manual)


@query(f"WITH part AS ({I.PARTICIPANTS_SQL}) SELECT uid, hotkey FROM part WHERE is_serving AND validator_permit AND stake >= 1000 AND hotkey <> 'hk4' ORDER BY md5('cast' || CAST(uid AS VARCHAR)), uid LIMIT 32")
def q_broadcast_targets(spark, sf):
    p = I.participants(spark, sf)
    return dispatch.broadcast_targets(p, dispatch.validators(p, 1000), "hk4", "cast").select("uid", "hotkey")


@query(f"""WITH part AS ({I.PARTICIPANTS_SQL}), q AS (SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN '' ELSE 'hk' || CAST(s_suppkey * 2 AS VARCHAR) END AS hotkey FROM supplier)
  SELECT s_suppkey, CASE WHEN q.hotkey = '' THEN 'missing_hotkey' WHEN p.hotkey IS NULL THEN 'unregistered' WHEN NOT p.validator_permit THEN 'no_permit' END AS reason, round(coalesce(p.stake, 0), 6) AS priority FROM q LEFT JOIN part p USING (hotkey)""")
def q_admission(spark, sf):
    k = F.col("s_suppkey")
    requests = I.table(spark, sf, "supplier").select(k, F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("hk"), (k * 2).cast("string"))).alias("hotkey"))
    return dispatch.admissions(requests, I.participants(spark, sf)).select("s_suppkey", "reason", r6("priority").alias("priority"))


def _commitments(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    uid = F.pmod(k * 7, F.lit(12))
    score = F.when(F.pmod(k, F.lit(4)) != 0, 1).otherwise(0)
    many = votes.multi_commitment(F.create_map(F.lit("0"), score, F.lit("5"), 1 - score))
    data = F.when(F.pmod(k, F.lit(10)) == 0, "no json").when(F.pmod(k, F.lit(3)) == 0, many).otherwise(votes.single_commitment(uid, score))
    return I.table(spark, sf, "supplier").select(F.concat(F.lit("validator-hotkey-"), k.cast("string")).alias("hotkey"), F.pmod(k * 37, F.lit(900)).alias("block"), data.alias("data"))


K = """WITH c AS (SELECT s_suppkey AS k, 'validator-hotkey-' || CAST(s_suppkey AS VARCHAR) AS hotkey, (s_suppkey * 37) % 900 AS block, CASE WHEN s_suppkey % 4 <> 0 THEN 1 ELSE 0 END AS score, (s_suppkey * 7) % 12 AS uid FROM supplier),
v AS (SELECT substr(hotkey, 1, 16) AS voter, 0 AS uid, score FROM c WHERE k % 10 <> 0 AND k % 3 = 0 UNION ALL SELECT substr(hotkey, 1, 16), 5, 1 - score FROM c WHERE k % 10 <> 0 AND k % 3 = 0 UNION ALL SELECT substr(hotkey, 1, 16), uid, score FROM c WHERE k % 10 <> 0 AND k % 3 <> 0)"""


@query(f"{K} SELECT CAST(uid AS INTEGER) AS uid, count(*) FILTER (WHERE score = 1) AS yes, count(*) FILTER (WHERE score <> 1) AS no, array_to_string(list(voter ORDER BY voter), ',') AS voters, round(count(*) FILTER (WHERE score = 1) / count(*), 6) AS weight FROM v GROUP BY uid")
def q_votes(spark, sf):
    out = votes.tallied(votes.votes(_commitments(spark, sf)))
    return out.select("uid", "yes", "no", F.array_join("voters", ",").alias("voters"), r6("weight").alias("weight"))


@query(f"{K} SELECT hotkey, block, CASE WHEN k % 10 <> 0 AND k % 3 <> 0 AND score = 1 THEN 'REWARD' ELSE 'PENALIZE' END AS action FROM c WHERE block > CASE WHEN k % 2 = 0 THEN 450 ELSE 0 END")
def q_new_commits(spark, sf):
    c = _commitments(spark, sf)
    seen = I.table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("validator-hotkey-"), F.col("s_suppkey").cast("string")).alias("hotkey"), F.lit(450).cast("long").alias("block"))
    return votes.changed(c, seen).select("hotkey", "block", "action")


@query("SELECT s_suppkey, '{\"miner_uid\":' || (s_suppkey % 7) || ',\"score\":' || (s_suppkey % 2) || ',\"version\":\"1.0\"}' AS data FROM supplier")
def q_commitment_json(spark, sf):
    k = F.col("s_suppkey")
    return I.table(spark, sf, "supplier").select(k, votes.single_commitment(k % 7, k % 2).alias("data"))


@query(f"""{L}, a AS (SELECT item_id, hotkey, CAST(item_id AS BIGINT) AS k FROM w WHERE CAST(item_id AS BIGINT) % 6 <> 0)
  SELECT item_id, hotkey, CASE WHEN k % 4 = 0 THEN 'neutral' ELSE 'bullish' END AS sentiment, k % 5 AS asset_id FROM a""")
def q_submit_posts(spark, sf):
    k = F.col("item_id").cast("long")
    fields = {"sentiment": F.when(k % 4 != 0, "bullish"), "asset_id": k % 5, "asset_symbol": F.lit("S"), "content_type": F.lit("other"), "technical_quality": F.lit("none"), "market_analysis": F.lit("other"), "impact_potential": F.lit("NONE")}
    items = I.work_items(spark, sf).withColumn("analysis", F.when(k % 6 != 0, F.struct(*[c.alias(n) for n, c in fields.items()])))
    return readers.completed(items, I.participants(spark, sf)).select("item_id", "hotkey", "sentiment", "asset_id")


@query("SELECT 'hk' || CAST(s_suppkey AS VARCHAR) AS hotkey, CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'old' END AS note FROM supplier WHERE s_suppkey % 7 <> 0")
def q_blacklist(spark, sf):
    s = I.table(spark, sf, "supplier")
    rows = s.select(F.concat(F.lit("hk"), F.col("s_suppkey").cast("string")).alias("hotkey"), F.col("s_suppkey"))
    old = rows.select("hotkey", F.lit("old").alias("note"))
    return readers.removed(readers.upserted(old, rows.where("s_suppkey % 4 = 0").select("hotkey", F.lit("new").alias("note"))), rows.where("s_suppkey % 7 = 0"))


def _rules_sql(rules: dict[str, str], default: str) -> str:
    """The first label of whose words the list w holds any."""
    tests = " ".join(f"WHEN list_has_any(w, [{', '.join(map(repr, words.split()))}]) THEN '{label}'" for label, words in rules.items())
    return f"CASE {tests} ELSE '{default}' END"


def _labels_sql(source: str, article: bool = False) -> str:
    """source (k, text) with t, w and the label of each dimension."""
    specifics = " + ".join(f"CAST(regexp_matches(t, '{p}') AS INTEGER)" for p in classify.SPECIFICS)
    technical = f"list_has_any(w, [{', '.join(map(repr, classify.TECHNICAL_WORDS.split()))}])"
    quality = f"CASE {specifics} WHEN 0 THEN CASE WHEN {technical} THEN 'low' ELSE 'none' END WHEN 1 THEN 'medium' ELSE 'high' END"
    rules = {d: _rules_sql(classify.RULES[d], classify.DEFAULTS[d]) for d in ("content_type", "sentiment", "market_analysis", "impact_potential")} | {"technical_quality": quality}
    if article:
        rules["content_type"] = _rules_sql(classify.ARTICLE_CONTENT_RULES, classify.DEFAULTS["content_type"])
    columns = ", ".join(f"{sql} AS {d}" for d, sql in rules.items())
    return f"SELECT k, {columns} FROM (SELECT *, list_distinct(string_split_regex(t, '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM (SELECT k, lower(coalesce(text, '')) AS t FROM {source}))"


CLASSIFIED = _match_sql(I.FIXTURE, I.FIXTURE[-1]) + f", labels AS ({_labels_sql('(SELECT doc_id AS k, text FROM documents)')})"


@query(f"{CLASSIFIED} SELECT m.doc_id, CASE WHEN length(d.text) > 0 THEN m.id END AS id, CASE WHEN length(d.text) > 0 THEN m.confidence END AS confidence, " + ", ".join(f"CASE WHEN length(d.text) > 0 THEN l.{x} END AS {x}" for x in classify.DIMENSIONS) + " FROM matched m JOIN labels l ON l.k = m.doc_id JOIN documents d ON d.doc_id = m.doc_id")
def q_classify_rules(spark, sf):
    d = I.table(spark, sf, "documents")
    c = classify.classify_post(F.col("text"), I.FIXTURE, I.FIXTURE[-1])
    return d.select("doc_id", c.alias("c")).select("doc_id", "c.id", "c.confidence", *[f"c.{x}" for x in classify.DIMENSIONS])


@query(f"{CLASSIFIED} SELECT m.doc_id, l.sentiment, m.id AS asset_id, m.symbol AS asset_symbol, l.content_type, l.technical_quality, l.market_analysis, l.impact_potential FROM matched m JOIN labels l ON l.k = m.doc_id JOIN documents d ON d.doc_id = m.doc_id WHERE length(d.text) > 0")
def q_annotate_batch(spark, sf):
    """What a worker sends back for a batch of posts."""
    d = I.table(spark, sf, "documents")
    out = annotate.annotated(d.select("doc_id", classify.classify_post(F.col("text"), I.FIXTURE, I.FIXTURE[-1]).alias("c")), "c", "post")
    return out.select("doc_id", "analysis.*")


_SENTIMENT_SQL = _rules_sql(classify.RULES["sentiment"], classify.DEFAULTS["sentiment"])


@query(f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 <> 0 THEN coalesce(role, 'unknown') ELSE 'unknown' END AS last_user, lower(coalesce(text, '')) AS own,
    lower(concat_ws(' ', lag(text, 2) OVER w, lag(text, 1) OVER w, text)) AS whole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  o AS (SELECT *, {_SENTIMENT_SQL} AS said FROM (SELECT *, list_distinct(string_split_regex(own, '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM c)),
  a AS (SELECT conv_id, turn, {_SENTIMENT_SQL} AS said FROM (SELECT *, list_distinct(string_split_regex(whole, '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM c))
  SELECT o.conv_id, o.turn, last_user, CASE WHEN o.said <> 'neutral' THEN o.said ELSE a.said END AS sentiment FROM o JOIN a ON a.conv_id = o.conv_id AND a.turn = o.turn""")
def q_last_sentiment(spark, sf):
    """Of every message in its context, which comes as raw messages under either set of names."""
    turn = F.col("turn")
    user = F.when(turn % 5 != 0, F.col("role"))
    raw = F.when(turn % 2 == 0, F.create_map(F.lit("message_id"), turn.cast("string"), F.lit("username"), user, F.lit("content"), F.col("text"))).otherwise(F.create_map(F.lit("id"), turn.cast("string"), F.lit("from"), user, F.lit("text"), F.col("text")))
    c = I.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(text.previous(raw, "conv_id", "turn"), F.array(raw)).alias("raw"))
    c = c.withColumn("messages", text.adapted_messages(F.col("raw")))
    return c.select("conv_id", "turn", F.element_at("messages", -1)["user"].alias("last_user"), classify.last_message_sentiment(F.col("messages")).alias("sentiment"))


_FITTED = {"quality": ("0", "1"), "toxic": ("0", "1")}
_FITTED_SUMS = ", ".join(f"count_if({d} = {x}) AS {d}{x}" for d, values in _FITTED.items() for x in values)
_FITTED_SCORES = ", ".join(f"CAST(round({fitted.UNIT} * ln((c.{d}{x} + CAST({fitted.SHRINK} AS DOUBLE) * (c.{d}0 + c.{d}1) / (t.{d}0 + t.{d}1)) / (t.{d}{x} + CAST({fitted.SHRINK} AS DOUBLE)))) AS BIGINT) AS {d}{x}" for d, values in _FITTED.items() for x in values)
_FITTED_BEST = ", ".join(f"CASE WHEN d.text IS NOT NULL THEN CASE WHEN coalesce(s.{d}1, 0) + CAST(round({fitted.UNIT} * ln(t.{d}1)) AS BIGINT) > coalesce(s.{d}0, 0) + CAST(round({fitted.UNIT} * ln(t.{d}0)) AS BIGINT) THEN '1' ELSE '0' END END AS {d}" for d in _FITTED)


@query(f"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_concat([''], string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')))) AS word FROM documents WHERE text IS NOT NULL),
  c AS (SELECT word, count(*) AS texts, {_FITTED_SUMS} FROM w JOIN labels USING (doc_id) GROUP BY word), t AS (SELECT * FROM c WHERE word = ''),
  m AS (SELECT c.word, c.quality0 AS a0, c.quality1 AS a1, c.toxic0 AS b0, c.toxic1 AS b1, {_FITTED_SCORES} FROM c, t WHERE c.word <> '' AND c.texts >= {fitted.LEAST_TEXTS}),
  x AS (SELECT word, 0 AS label, a0 * (quality0 - least(quality0, quality1)) AS value FROM m UNION ALL SELECT word, 1, a1 * (quality1 - least(quality0, quality1)) FROM m
    UNION ALL SELECT word, 2, b0 * (toxic0 - least(toxic0, toxic1)) FROM m UNION ALL SELECT word, 3, b1 * (toxic1 - least(toxic0, toxic1)) FROM m),
  v AS (SELECT m.* FROM m WHERE word IN (SELECT word FROM (SELECT word, row_number() OVER (PARTITION BY label ORDER BY value DESC, word) AS k FROM x WHERE value > 0) WHERE k <= {fitted.MOST_WORDS // 4})),
  s AS (SELECT doc_id, {", ".join(f"sum({d}{x}) AS {d}{x}" for d, values in _FITTED.items() for x in values)} FROM w JOIN v USING (word) GROUP BY doc_id)
  SELECT d.doc_id, {_FITTED_BEST} FROM documents d CROSS JOIN t LEFT JOIN s ON s.doc_id = d.doc_id""")
def q_fitted_labels(spark, sf):
    """All documents labelled by a classifier fitted on those that have labels."""
    d = I.table(spark, sf, "documents").select("doc_id", "text")
    told = I.table(spark, sf, "labels").select("doc_id", *[F.col(x).cast("string").alias(x) for x in _FITTED])
    model = fitted.fit(d.join(told, "doc_id"), "text", _FITTED, {})
    return model.apply(d, "text").select("doc_id", "labels.*")


def _verdict_sql(picked: str, target: str, worker: dict[str, str], has_worker: str, own_id: str, has_own: str, article: bool = False) -> str:
    """Verdicts by batch of picked (batch, k, nth, text, ...), relabelled, against the worker's labels."""
    source = f"(SELECT k, text FROM ({picked}))"
    agrees = " AND ".join(f"lower({w}) = lower(l.{d})" for d, w in worker.items() if d != target)
    reason = f"CASE WHEN NOT ({has_worker}) THEN 'missing_miner_classification' WHEN {worker[target]} IS NULL THEN 'miner_needs_update' WHEN NOT ({has_own}) THEN 'validator_classification_failed' WHEN NOT ({worker[target]} = {own_id} AND {agrees}) THEN 'classification_mismatch' END"
    return _match_sql(I.FIXTURE, I.FIXTURE[-1], source, "k") + f""", l AS ({_labels_sql(source, article)}),
c AS (SELECT p.batch, p.nth, {reason} AS reason FROM ({picked}) p JOIN matched m USING (k) JOIN l USING (k))
SELECT batch, count(*) FILTER (WHERE reason IS NULL) AS matches, count(*) AS total_sampled, round(count(*) FILTER (WHERE reason IS NULL) / count(*), 6) AS match_rate, count(*) = count(*) FILTER (WHERE reason IS NULL) AS is_valid,
  coalesce(array_to_string(list(reason ORDER BY nth) FILTER (WHERE reason IS NOT NULL), ','), '') AS reasons FROM c GROUP BY batch"""


def _verdict_rows(compared: DataFrame) -> DataFrame:
    out = validation.verdicts(compared)
    return out.select("batch", "matches", "total_sampled", r6("match_rate").alias("match_rate"), "is_valid", F.array_join(F.transform("discrepancies", lambda x: x["reason"]), ",").alias("reasons"))


PLAIN_LABELS = {"sentiment": "NEUTRAL", "content_type": "other", "technical_quality": "none", "market_analysis": "other", "impact_potential": "none"}
_plain_sql = {d: f"'{v}'" for d, v in PLAIN_LABELS.items()}


def _worker(test: Column, target: str, value: Column) -> Column:
    """A worker's labels, the plain ones and a target, where test holds."""
    return F.when(test, F.struct(value.cast("long").alias(target), *[F.lit(v).alias(d) for d, v in PLAIN_LABELS.items()]))


CHAT_PICKED = """SELECT *, concat_ws(' ', x1, x2, own) AS text FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY md5('chat' || conv_id || '-' || turn), conv_id || '-' || turn) AS nth FROM (
  SELECT conv_id, turn, conv_id * 1000 + turn AS k, CAST(floor((conv_id * 8 + turn) / 3) AS BIGINT) AS batch, text AS own, lag(text, 1) OVER c AS x1, lag(text, 2) OVER c AS x2, CASE WHEN (conv_id + turn) % 3 = 0 THEN turn % 6 END AS inherited
  FROM conversations WINDOW c AS (PARTITION BY conv_id ORDER BY turn))) WHERE nth = 1"""


@query(_verdict_sql(CHAT_PICKED, "asset_id", {"asset_id": "CASE WHEN k % 31 <> 0 THEN coalesce(inherited, 2) END"} | _plain_sql, "k % 29 <> 0", "coalesce(p.inherited, m.id)", "true"))
def q_validate_chat(spark, sf):
    """Verdicts on batches of three messages, one of each labelled anew in its conversation."""
    k = F.col("conv_id") * 1000 + F.col("turn")
    inherited = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.col("turn") % 6)
    worker = _worker(k % 29 != 0, "asset_id", F.when(k % 31 != 0, F.coalesce(inherited, F.lit(2))))
    batch = F.floor((F.col("conv_id") * 8 + F.col("turn")) / 3).cast("long")
    c = I.table(spark, sf, "conversations").select(batch.alias("batch"), "conv_id", "turn", F.col("role").alias("user"), F.col("text").alias("content"), inherited.alias("inherited_asset_id"), worker.alias("worker"))
    return _verdict_rows(validation.recomputed_chat(c, 1, "chat", I.FIXTURE, I.FIXTURE[-1], conversation="conv_id", order="turn"))


ARTICLE_PICKED = """SELECT *, concat_ws(chr(10) || chr(10), 'Doc ' || k, CASE WHEN length(content) > 0 THEN substr(content, 1, 3000) END) AS text FROM (
  SELECT doc_id AS k, lang, text AS content, CAST(floor(doc_id / 3) AS BIGINT) AS batch, row_number() OVER (PARTITION BY floor(doc_id / 3) ORDER BY md5('article' || doc_id), doc_id) AS nth FROM documents) WHERE nth <= 2"""


@query(_verdict_sql(ARTICLE_PICKED, "sector_id", {"sector_id": "CASE WHEN k % 31 <> 0 THEN CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 5 ELSE 4 END END"} | _plain_sql, "k % 29 <> 0", "m.id", "k % 41 <> 0", article=True))
def q_validate_articles(spark, sf):
    """Verdicts on batches of three articles, two of each labelled anew; those without a title can't be."""
    k = F.col("doc_id")
    worker = _worker(k % 29 != 0, "sector_id", F.when(k % 31 != 0, F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 5).otherwise(4)))
    title = F.when(k % 41 != 0, F.concat(F.lit("Doc "), k.cast("string")))
    a = I.table(spark, sf, "documents").select(F.floor(k / 3).cast("long").alias("batch"), "doc_id", title.alias("title"), F.lit(None).cast("string").alias("summary"), F.col("text").alias("content"), worker.alias("worker"))
    return _verdict_rows(validation.recomputed_articles(a, 2, "article", I.FIXTURE, I.FIXTURE[-1], key="doc_id"))


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = I.table(spark, sf, "events").schema
    key = "spark.sql.streaming.stateStore.providerClass"  # keyed state needs this store
    spark.conf.set(key, SETTINGS[key])
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")  # a pattern, as the table may be one file


@query(f"""{R} SELECT epoch, hotkey, amount FROM r WHERE (epoch + 1) * {1000 * epochs.SECONDS} <= (SELECT max(epoch_ms(ts)) FROM e WHERE kind = 'reward') - {2000 * epochs.SECONDS}""")
def q_stream_epoch(spark, sf):
    """Rewards by epoch as a stream settles them: all but the last epochs, which the watermark holds back."""
    e = _events_stream(spark, sf).where("event_type IN ('purchase', 'click')")
    rows = e.select(F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("hk"), F.col("user_id").cast("string")).alias("hotkey"), F.lit(1).cast("long").alias("amount"))
    return sink.drained(epochs.epoch_points(rows), "stream-epoch")


@query(f"{B} SELECT sender, arrival, seq, reason FROM s")
def q_stream_dedup(spark, sf):
    """Sequence numbers accepted by keyed state over a stream, as q_broadcast_dedup does by a window."""
    e = _events_stream(spark, sf)
    rows = e.select(
        F.concat(F.lit("v"), F.pmod("user_id", F.lit(20)).cast("string")).alias("sender"), F.col("event_id").alias("arrival"),
        (F.col("event_id") - F.pmod(F.col("event_id") * 31, F.lit(97)) + F.when(F.pmod("event_id", F.lit(500)) == 0, 100).otherwise(0)).alias("seq"), (F.pmod(F.floor("value"), F.lit(5)) > 0).alias("positive"),
    )
    return sink.drained(processors.with_state(rows, "sender", processors.SequenceProcessor()), "stream-dedup").select("sender", "arrival", "seq", "reason")


@query(f"{R} SELECT * FROM r WHERE epoch IN (SELECT DISTINCT epoch FROM r ORDER BY epoch DESC LIMIT {ledger.KEEP_EPOCHS})")
def q_stream_late(spark, sf):
    """The newest epochs of a ledger into which rewards landed in a mixed order, a file to a batch; as q_epoch_retention."""
    e = I.events(spark, sf).where("kind = 'reward'").select(F.col("ts").alias("at"), "hotkey", F.lit(1).cast("long").alias("amount"), F.pmod(F.xxhash64("event_id"), F.lit(6)).alias("file"))
    folder = shared_folder(spark, "late-rows")
    e.repartition(6, "file").drop("file").write.parquet(f"{folder}/in")
    rows = spark.readStream.schema(e.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    table = VersionedTable(spark, f"{folder}/ledger", epochs.LEDGER)
    epochs.into_ledger(rows, table, "rewards", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read()


@query(f"""{LE}, s AS (SELECT *, max(CASE WHEN event IN ('add', 'process', 'done', 'reset') THEN seq END) OVER (PARTITION BY item_id) AS turned FROM x),
z AS (SELECT item_id, coalesce(max(CASE event WHEN 'process' THEN 'Processing' WHEN 'done' THEN 'Processed' ELSE 'Unprocessed' END) FILTER (WHERE seq = turned), 'Unprocessed') AS status, arg_max(hotkey, seq) FILTER (WHERE event = 'process') AS hotkey,
  arg_max(epoch_ms("at"), seq) FILTER (WHERE seq >= turned AND event IN ('process', 'result')) AS clock, max(CASE WHEN event = 'done' THEN 1 ELSE 0 END) AS reward FROM s GROUP BY item_id),
late AS (SELECT *, status = 'Processing' AND (SELECT max(epoch_ms("at")) FROM x) - 3600000 - clock > 300000 AS late FROM z)
  SELECT item_id, CASE WHEN late THEN 'Unprocessed' ELSE status END AS status, hotkey, reward, CASE WHEN late THEN 1 ELSE 0 END AS penalty FROM late""")
def q_stream_lifecycle(spark, sf):
    """Items as keyed state over a stream leaves them once timers have reset what was due at the watermark, as current() and requeued() do."""
    e = _events_stream(spark, sf)
    rows = _as_item_events(e.withColumn("ts", F.col("ts").cast("timestamp")))
    out = sink.drained(processors.with_state(rows, "item_id", processors.LifecycleProcessor(event_time=True)), "stream-lifecycle")
    last = lambda c: F.max_by(c, "version").alias(c)
    return out.groupBy("item_id").agg(last("status"), last("hotkey"), F.max("reward").alias("reward"), F.max("penalty").alias("penalty"))


@query(f"""{E} SELECT CASE WHEN event_id % 50 = 0 THEN 'no object' WHEN event_type = 'view' THEN 'unknown kind' WHEN event_id % 9 = 0 THEN 'no sender' WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'bad body' ELSE '' END AS problem,
  CASE WHEN event_id % 50 = 0 OR event_type = 'view' OR event_id % 9 = 0 OR (event_type = 'click' AND event_id % 4 = 0) THEN 'refused' WHEN event_type = 'signup' THEN 'is_alive' WHEN event_type = 'error' THEN 'penalties' ELSE 'rewards' END AS kind, count(*) AS n FROM e GROUP BY ALL""")
def q_push_ingest(spark, sf):
    """Events as pushed envelopes of several kinds, some of them broken, by what a stream made of them."""
    e = I.events(spark, sf)
    k, kind = F.col("event_id"), F.col("event_type")
    seq = F.when((kind == "click") & (k % 4 == 0), None).otherwise(k)
    points = F.struct("epoch", seq.alias("seq"), F.create_map(F.col("user_id").cast("string"), F.lit(1)).alias("uid_values"))
    body = F.when(kind == "signup", F.lit('{"is_alive":true}')).otherwise(F.to_json(points))
    said = F.when(kind == "signup", "is_alive").when(kind == "view", "gossip").when(kind == "error", "penalties").otherwise("rewards")
    sender = F.when(k % 9 != 0, F.col("hotkey")).otherwise("")
    line = F.concat(F.lit('{"kind":"'), said, F.lit('","sender":"'), sender, F.lit('","body":'), body, F.when(k % 50 == 0, "").otherwise("}"))
    folder = shared_folder(spark, "pushed")
    e.select(line.alias("value")).write.text(f"{folder}/in")
    ingest.pushed(spark.readStream.text(f"{folder}/in"), folder).trigger(availableNow=True).start().awaitTermination()
    return ingest.received(spark, folder).groupBy(F.coalesce("problem", F.lit("")).alias("problem"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{E}, c AS (SELECT ts AS t, event_id, event_type = 'signup' AS pull, CASE WHEN event_type = 'signup' AND user_id % 7 <> 0 THEN user_id % 9 + 1 END AS said_size, CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN event_id % 50 END AS said_limit,
  CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN CAST('0.00' || CAST(event_id % 10 AS VARCHAR) AS DOUBLE) END AS said_percent FROM e)
SELECT event_id, CAST(coalesce(batch_size, 3) AS INTEGER) AS batch_size, CAST(coalesce(fetch_limit, 24) AS INTEGER) AS fetch_limit, coalesce(min_percent, 0.003) AS min_percent FROM (
  SELECT event_id, pull, last_value(said_size IGNORE NULLS) OVER w AS batch_size, last_value(said_limit IGNORE NULLS) OVER w AS fetch_limit, last_value(said_percent IGNORE NULLS) OVER w AS min_percent FROM c
  WINDOW w AS (ORDER BY t, CASE WHEN pull THEN 0 ELSE 1 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE NOT pull""")
def q_settings_in_force(spark, sf):
    """The settings in force at each event, where signups are pulls that change some of them, a few to what isn't of their type."""
    e = I.events(spark, sf)
    k, user = F.col("event_id"), F.col("user_id")
    config = F.create_map(
        F.lit("MINER_BATCH_SIZE"), F.when(user % 7 != 0, (user % 9 + 1).cast("string")).otherwise("many"),
        F.lit("VALIDATION_FETCH_LIMIT"), F.when(k % 3 == 0, (k % 50).cast("string")),
        F.lit("MIN_PERCENT_PER_POINT"), F.when(k % 2 == 0, F.concat(F.lit("0.00"), (k % 10).cast("string"))),
    )
    pulled = e.where("event_type = 'signup'").select(F.col("ts").alias("pulled_at"), config.alias("config"), "event_id")
    names = ["MINER_BATCH_SIZE", "VALIDATION_FETCH_LIMIT", "MIN_PERCENT_PER_POINT"]
    out = remote.with_settings(e.where("event_type <> 'signup'").select("event_id", "ts"), pulled, "ts", names, ["event_id"])
    return out.select("event_id", *[F.col(n).alias(a) for n, a in zip(names, ("batch_size", "fetch_limit", "min_percent"), strict=True)])


@query(_match_sql(I.FIXTURE, I.FIXTURE[-1], "(SELECT doc_id, 'Doc ' || doc_id || chr(10) || chr(10) || substr(text, 1, 3000) AS text FROM documents)") + f"""
, v AS (SELECT m.id, 0.5 * CASE WHEN m.id <> 9 THEN 1 ELSE 0 END + 0.4 * (0.6 * 0.5 + 0.4) AS score FROM matched m)
SELECT id AS label, count(*) AS n, round(avg(score), 6) AS mean_score FROM v GROUP BY id""")
def q_flagship(spark, sf):
    d = I.table(spark, sf, "documents").select("source", text.article_text(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), F.lit(None).cast("string"), F.col("text")).alias("t"), "text")
    m = scoring.with_credibility(d).withColumn("m", matching.match(F.col("t"), I.FIXTURE, I.FIXTURE[-1]))
    score = 0.5 * (F.col("m.id") != 9).cast("double") + 0.4 * scoring.article_value(F.col("credibility"), F.col("text"))
    return m.groupBy(F.col("m.id").alias("label")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(score)).alias("mean_score"))
