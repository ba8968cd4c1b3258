"""Comparing a worker's labels with one's own, exactly or within tolerances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import norm_text, normalised_keys, preview, with_context
from ..sources.registries import Entry

# How far token and sentiment values may be apart, what counts as noise, and tokens compared at most.
TOKEN_TOLERANCE, SENTIMENT_TOLERANCE, NOISE, MAX_TOKENS = 0.05, 0.05, 0.05, 128
LABELS = ("sentiment", "content_type", "technical_quality", "market_analysis", "impact_potential")


def seeded_order(seed: str, key: Column) -> Column:
    """A fixed shuffle: the MD5 of seed and key."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def sampled(df: DataFrame, n: int, seed: str, key: str, group: list[str]) -> DataFrame:
    """n rows of each group without replacement, the same on every run, with their place in `sample_index`."""
    order = W.partitionBy(*group).orderBy(seeded_order(seed, F.col(key)), key)
    return df.withColumn("sample_index", F.row_number().over(order) - 1).where(F.col("sample_index") < n)


def field_results(worker: Column, own: Column, target: str) -> Column:
    """struct of booleans: the target id exactly, labels without case; two nulls agree."""
    same = {target: worker[target].eqNullSafe(own[target])} | {f: F.lower(worker[f]).eqNullSafe(F.lower(own[f])) for f in LABELS}
    return F.struct(*[c.alias(f) for f, c in same.items()])


def compared(items: DataFrame, target: str = "asset_id", text: str = "text") -> DataFrame:
    """items (batch, worker struct, own struct, text) with reason, null for a match, field_results and preview.

    A worker without labels, one whose labels lack the target, one's own failure and a
    difference are told apart, in this order.
    """
    worker, own = F.col("worker"), F.col("own")
    fields = field_results(worker, own, target)
    agrees = fields[target]
    for f in LABELS:
        agrees = agrees & fields[f]
    reason = (
        F.when(worker.isNull(), "missing_miner_classification")
        .when(worker[target].isNull(), "miner_needs_update")
        .when(own.isNull(), "validator_classification_failed")
        .when(~agrees, "classification_mismatch")
    )
    return items.withColumn("reason", reason).withColumn("field_results", F.when(F.col("reason") == "classification_mismatch", fields)).withColumn("preview", preview(F.col(text)))


def frames(messages: DataFrame, picked: DataFrame, conversation: str, order: str, n: int = 2, fields: tuple[str, ...] = ("user", "content")) -> DataFrame:
    """picked (conversation, order) with `context`, the n messages before each, oldest first, as structs of `fields`.

    Only places are computed for all messages; texts are looked up for the rows in some frame.  `order`
    tells the messages of a conversation apart.
    """
    place = F.row_number().over(W.partitionBy(conversation).orderBy(order))
    places = messages.select(conversation, order, place.alias("__place"))
    targets = picked.select(conversation, order).join(places, [conversation, order])
    wanted = targets.select(conversation, F.col(order).alias("__target"), F.explode(F.sequence(F.greatest(F.col("__place") - n, F.lit(1)), F.col("__place"))).alias("__place"))
    rows = wanted.join(places, [conversation, "__place"]).where(F.col(order) != F.col("__target"))
    rows = rows.join(messages.select(conversation, order, F.struct(*fields).alias("__message")), [conversation, order])
    context = F.transform(F.array_sort(F.collect_list(F.struct("__place", "__message"))), lambda x: x["__message"])
    found = rows.groupBy(conversation, F.col("__target").alias(order)).agg(context.alias("context"))
    return picked.join(found, [conversation, order], "left").withColumn("context", F.coalesce("context", F.array().cast(found.schema["context"].dataType)))


def recomputed_chat(messages: DataFrame, n: int, seed: str, registry: tuple[Entry, ...], default: Entry, *, conversation: str = "conversation", order: str = "order") -> DataFrame:
    """n messages of each batch compared with one's own labels: of (batch, conversation, order, user, content, inherited_asset_id, worker).

    The sample is drawn before anything is classified; a sampled message is labelled in its context, which comes in
    reverse, and with the asset that it inherits.  See :func:`compared` for the columns added.
    """
    key = F.concat_ws("-", conversation, order)
    narrow = messages.select("batch", conversation, order, key.alias("__id"))
    picked = sampled(narrow, n, seed, "__id", ["batch"]).drop("__id")
    framed = frames(messages, picked, conversation, order)
    own = messages.select(conversation, order, "user", "content", "inherited_asset_id", "worker")
    rows = framed.join(own, [conversation, order])
    group = with_context(F.col("context"), F.struct("user", "content"))
    found = classify.classify_group(group, F.col("inherited_asset_id"), registry, default)
    return compared(rows.withColumn("own", _labelled(found, "asset_id")), "asset_id", "content")


def recomputed_articles(articles: DataFrame, n: int, seed: str, registry: tuple[Entry, ...], default: Entry, *, key: str = "id") -> DataFrame:
    """n articles of each batch compared with one's own labels: of (batch, key, title, summary, content, worker); previews are titles."""
    picked = sampled(articles.select("batch", key), n, seed, key, ["batch"])
    rows = picked.join(articles.drop("batch"), key)
    found = classify.classify_article(F.col("title"), F.col("summary"), F.col("content"), registry, default)
    return compared(rows.withColumn("own", _labelled(found, "sector_id")), "sector_id", "title")


def _labelled(found: Column, target: str) -> Column:
    """A classification as labels with the target's id, null where there is none; it is computed once, on what was sampled."""
    return classify.once(found, lambda c: F.when(c.isNotNull(), F.struct(c["id"].alias(target), *[c[f].alias(f) for f in LABELS])))


def verdicts(compared: DataFrame) -> DataFrame:
    """Per batch: matches, total_sampled, match_rate, is_valid and the discrepancies in sample order."""
    bad = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("sample_index", "reason", "preview"))))
    out = compared.groupBy("batch").agg(F.count_if(F.col("reason").isNull()).alias("matches"), F.count(F.lit(1)).alias("total_sampled"), bad.alias("discrepancies"))
    return out.withColumn("match_rate", F.col("matches") / F.col("total_sampled")).withColumn("is_valid", F.col("matches") == F.col("total_sampled"))


def whole_batches(sent: DataFrame, returned: DataFrame) -> DataFrame:
    """Per batch sent, of (batch, item) rows: n_sent, n_returned, and whether as many came back; of a batch that never did, 0."""
    n = lambda rows, name: rows.groupBy("batch").agg(F.count(F.lit(1)).alias(name))
    out = n(sent, "n_sent").join(n(returned, "n_returned"), "batch", "left").withColumn("n_returned", F.coalesce("n_returned", F.lit(0).cast("bigint")))
    return out.withColumn("whole", F.col("n_sent") == F.col("n_returned"))


def handled(sent: DataFrame, returned: DataFrame, verdicts: DataFrame, weight: Column | None = None) -> DataFrame:
    """:func:`applied` to what was sent, where a batch of another size than was sent fails whatever its verdict; without a verdict it fails, too."""
    whole = whole_batches(sent, returned)
    judged = whole.join(verdicts.select("batch", "is_valid"), "batch", "left")
    return applied(judged.select("batch", (F.col("whole") & F.coalesce("is_valid", F.lit(False))).alias("is_valid")), sent, weight)


def applied(verdicts: DataFrame, batches: DataFrame, weight: Column | None = None) -> DataFrame:
    """(item_id, hotkey, status, reward, penalty) of every item: a valid batch is processed and rewarded once per item not rewarded yet, another is reset, at a penalty for its first item."""
    out = batches.join(verdicts.select("batch", "is_valid"), "batch")
    first = F.row_number().over(W.partitionBy("batch").orderBy("item_id")) == 1
    reward = F.when(F.col("is_valid") & ~F.col("rewarded"), F.lit(1) if weight is None else weight).otherwise(0)
    return out.select("item_id", "hotkey", F.when(F.col("is_valid"), "Processed").otherwise("Unprocessed").alias("status"), reward.alias("reward"), F.when(~F.col("is_valid") & first, 1).otherwise(0).alias("penalty"))


def selected_tokens(worker: Column, own: Column, cap: int = MAX_TOKENS, noise: float = NOISE) -> Column:
    """struct<worker, own>: without noise; own tokens stay, the worker's others by size until there are `cap`."""
    clean = lambda m: F.map_filter(normalised_keys(m), lambda k, v: F.abs(v) >= noise)
    w, o = clean(worker), clean(own)
    extras = F.map_entries(F.map_filter(w, lambda k, v: ~F.map_contains_key(o, k)))
    ranked = F.array_sort(F.transform(extras, lambda e: F.struct((-F.abs(e["value"])).alias("size"), e["key"].alias("key"))))
    room = F.greatest(F.lit(cap) - F.size(o), F.lit(0))
    keys = F.concat(F.map_keys(o), F.transform(F.slice(ranked, F.lit(1), room), lambda e: e["key"]))
    return F.struct(F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(F.try_element_at(w, k), F.lit(0.0)).alias("value")))).alias("worker"), o.alias("own"))


def token_differences(pair: Column, tolerance: float = TOKEN_TOLERANCE, noise: float = NOISE) -> Column:
    """array<struct<diff, key>> of tokens too far apart, the furthest first; those both below the noise don't count."""
    both = F.map_zip_with(pair["worker"], pair["own"], lambda k, a, b: F.struct(F.coalesce(a, F.lit(0.0)).alias("a"), F.coalesce(b, F.lit(0.0)).alias("b")))
    far = F.map_filter(both, lambda k, v: ~((v["a"] < noise) & (v["b"] < noise)) & (F.abs(v["a"] - v["b"]) > tolerance))
    return F.array_sort(F.transform(F.map_entries(far), lambda e: F.struct(F.abs(e["value"]["a"] - e["value"]["b"]).alias("diff"), e["key"].alias("key"))), lambda x, y: F.when(x["diff"] > y["diff"], -1).when(x["diff"] < y["diff"], 1).when(x["key"] < y["key"], -1).otherwise(1))


def graded(posts: DataFrame) -> DataFrame:
    """Of (hotkey, post_index, post_id, content, tokens, sentiment, own_tokens, own_sentiment): the verdict on each hotkey.

    valid, and of the first post at fault its index, code, id and up to five differences.
    """
    differences = token_differences(selected_tokens(F.col("tokens"), F.col("own_tokens")))
    code = (
        F.when(F.coalesce(F.length("post_id"), F.lit(0)) == 0, "missing_post_id")
        .when(norm_text(F.col("content")) == "", "empty_content")
        .when(F.col("own_tokens").isNull(), "analyzer_error")
        .when(F.size("__d") > 0, "tokens_mismatch")
        .when(F.abs(F.coalesce("sentiment", F.lit(0.0)) - F.col("own_sentiment")) > SENTIMENT_TOLERANCE, "sentiment_mismatch")
    )
    rows = posts.withColumn("__d", differences).withColumn("__code", code)
    fault = F.min_by(F.struct("post_index", F.col("__code").alias("code"), "post_id", F.slice("__d", 1, 5).alias("differences")), F.when(F.col("__code").isNotNull(), F.col("post_index")))
    return rows.groupBy("hotkey").agg(F.count(F.lit(1)).alias("n_posts"), F.count("__code").alias("__faults"), fault.alias("__f")).select("hotkey", "n_posts", (F.col("__faults") == 0).alias("valid"), F.when(F.col("__faults") > 0, F.col("__f")).alias("fault"))
