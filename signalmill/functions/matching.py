"""Which assets or sectors a text is about.

A registry of a few hundred entries is one expression (:func:`match`); one of any size is a
table of postings (:func:`all_matches`).  Either way a text's words are taken once: an identifier is looked
at only in texts that hold its longest word, so no pattern is tried for each entry.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.registries import Entry

#: Identifiers below this length are never looked for.
LEAST_LENGTH = 3
WORD = r"\p{L}\p{N}_"


def word_pattern(identifier: str) -> str:
    """The identifier with a word boundary at both ends.

    Boundaries are spelt out, as engines differ in what \\b means beyond ASCII: at an
    end that is a word character none may be next to it, at any other end one must.
    """
    is_word = lambda c: bool(re.match(r"\w", c))
    left = f"(^|[^{WORD}])" if is_word(identifier[0]) else f"[{WORD}]"
    right = f"($|[^{WORD}])" if is_word(identifier[-1]) else f"[{WORD}]"
    return left + re.sub(r"([^\w\s])", r"\\\1", identifier) + right


def once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def anchor(key: str) -> str:
    """The longest word of an identifier; it stands in each text that the identifier stands in as a word."""
    return max(re.findall(r"\w+", key), key=len, default="")


def words(text: Column) -> Column:
    return F.split(text, f"[^{WORD}]+")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _probes(registry: tuple[Entry, ...], skip: int) -> Column:
    """What to look for, entry by entry, cashtags first: a constant array of structs."""
    quote = _quoted
    rows = []
    for place, e in enumerate(registry):
        if e.id != skip:
            named = [("cased", n, n) for n in e.cased] + [("plain", n, n.lower()) for n in e.identifiers]
            found = [("tag", c, c.lower(), "", "") for c in e.cashtags]
            # an identifier that is a word needs no pattern, nor does one without any word have an anchor
            found += [(k, n, key, anchor(key), "" if anchor(key) == key else word_pattern(key)) for k, n, key in named if len(n) >= LEAST_LENGTH]
            rows += [f"named_struct('place',{place},'id',{e.id}L,'symbol',{quote(e.symbol)},'kind','{k}','name',{quote(n)},'key',{quote(key)},'anchor',{quote(w)},'pattern',{quote(p)})" for k, n, key, w, p in found]
    return F.expr("array(" + ",".join(rows) + ")")


def anchors(registry: tuple[Entry, ...], skip: int) -> tuple[set[str], set[str]]:
    """Anchors of identifiers in lower case, and of those in their own case."""
    kept = [e for e in registry if e.id != skip]
    plain = {anchor(n.lower()) for e in kept for n in e.identifiers if len(n) >= LEAST_LENGTH}
    cased = {anchor(n) for e in kept for n in e.cased if len(n) >= LEAST_LENGTH}
    return plain, cased


def taken(text: Column, plain: set[str], cased: set[str] = frozenset()) -> Column:
    """struct<own, lower, words, cased_words>: a text, in lower case, and which of `plain` are words of that, which of `cased` words of its own.

    The lower case is split once and met with all known words at once; a text in its own case is split only if it holds one of `cased`
    anywhere.  What is asked of a text's words afterwards goes by the few that were found.
    """
    listed = lambda known: F.expr("array(" + ",".join(map(_quoted, sorted(known))) + ")").cast("array<string>")
    found = lambda t, known: F.array_intersect(words(t), listed(known)) if known else listed(known)
    own = F.coalesce(text, F.lit(""))
    both = F.struct(own.alias("own"), F.lower(own).alias("lower"))

    def met(t: Column) -> Column:
        holds = F.exists(listed(cased), lambda w: F.contains(t["own"], w))
        cased_words = F.when(holds, found(t["own"], cased)).otherwise(listed(())) if cased else listed(())
        return F.struct(t["own"].alias("own"), t["lower"].alias("lower"), found(t["lower"], plain).alias("words"), cased_words.alias("cased_words"))

    return once(both, met)


def _score(tagged: Column, evidence: Column) -> Column:
    return F.when(F.size(evidence) == 0, 0.0).when(tagged, 1.0).when(F.size(evidence) > 1, 0.9).otherwise(0.8)


def match(text: Column, registry: tuple[Entry, ...], default: Entry) -> Column:
    """The best entry: struct<id, symbol, confidence, evidence>; the default with low confidence for none.

    A cashtag anywhere scores 1 and stops there; several identifiers as words score 0.9,
    one 0.8; of equal scores the earlier entry is taken.  The text's words are met with all
    anchors at once, and only identifiers whose anchor stands in it are looked at; one fold over what was found
    keeps the best entry.
    """
    return once(taken(text, *anchors(registry, default.id)), lambda t: match_taken(t, registry, default))


def match_taken(text: Column, registry: tuple[Entry, ...], default: Entry) -> Column:
    """:func:`match` of a text as :func:`taken` with the registry's anchors, and any other words, among its words."""

    def hits(t: Column) -> Column:
        def stands(p: Column) -> Column:
            cased = p["kind"] == "cased"
            where = F.when(cased, t["own"]).otherwise(t["lower"])
            there = F.array_contains(F.when(cased, t["cased_words"]).otherwise(t["words"]), p["anchor"])
            whole = (p["pattern"] == "") | (F.contains(where, p["key"]) & F.regexp_like(where, p["pattern"]))
            return F.when(p["kind"] == "tag", F.contains(t["lower"], p["key"])).otherwise(((p["anchor"] == "") | there) & whole)

        return F.filter(_probes(registry, default.id), stands)

    none = F.array().cast("array<string>")
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(default.id).cast("long").alias("id"), F.lit(default.symbol).alias("symbol"), none.alias("evidence"))
    zero = F.struct(F.lit(-1).alias("place"), F.lit(False).alias("tagged"), nothing.alias("now"), nothing.alias("best"))

    def better(acc: Column) -> Column:
        return F.when(acc["now"]["score"] > acc["best"]["score"], acc["now"]).otherwise(acc["best"])

    def add(acc: Column, h: Column) -> Column:
        same = acc["place"] == h["place"]
        tag = h["kind"] == "tag"
        tagged = F.when(same, acc["tagged"]).otherwise(tag)
        evidence = F.when(~same, F.array(h["name"])).when(acc["tagged"] & ~tag, acc["now"]["evidence"]).otherwise(F.concat(acc["now"]["evidence"], F.array(h["name"])))
        now = F.struct(_score(tagged, evidence).alias("score"), h["id"].alias("id"), h["symbol"].alias("symbol"), evidence.alias("evidence"))
        return F.struct(h["place"].alias("place"), tagged.alias("tagged"), now.alias("now"), F.when(same, acc["best"]).otherwise(better(acc)).alias("best"))

    def named(best: Column) -> Column:
        confidence = F.when(best["score"] >= 0.9, "high").when(best["score"] > 0, "medium").otherwise("low")
        return F.struct(best["id"].alias("id"), best["symbol"].alias("symbol"), confidence.alias("confidence"), best["evidence"].alias("evidence"))

    return F.aggregate(hits(text), zero, add, lambda acc: once(better(acc), named))


def inherited(match: Column, asset_id: Column, registry: tuple[Entry, ...]) -> Column:
    """The match, unless the message inherits an asset: that, with high confidence and its symbol as evidence."""
    symbol = F.coalesce(F.element_at(F.create_map(*[x for e in registry for x in (F.lit(e.id).cast("long"), F.lit(e.symbol))]), asset_id.cast("long")), F.concat(F.lit("ASSET_"), asset_id.cast("string")))
    own = F.struct(asset_id.cast("long").alias("id"), symbol.alias("symbol"), F.lit("high").alias("confidence"), F.array(symbol).alias("evidence"))
    return F.when(asset_id.isNotNull(), own).otherwise(match)


def contributing(messages: Column, registry: tuple[Entry, ...], default: Entry) -> Column:
    """Ids of the messages, array<struct<id, content>>, that alone match an entry."""
    return F.transform(F.filter(messages, lambda m: match(m["content"], registry, default)["confidence"] != "low"), lambda m: m["id"])


#: Postings of so many bytes at most are broadcast; larger ones are joined by key.
BROADCAST_BYTES = 1 << 25
# How a key of a posting lies in a text: as a word of its lower case or of its own case, at a word's beginning, end or inside, or between words.
WHOLE, CASED, HEAD, TAIL, INNER, GAP = "whole", "cased", "head", "tail", "inner", "gap"


def postings(registry: DataFrame) -> DataFrame:
    """What to look for of a registry table: id, symbol, kind, pos, name, key, mode, anchor and pattern.

    An identifier has its longest word as anchor.  A cashtag may stand inside words; its anchor is a
    word that it has whole, or else one that it has the end or the beginning of.
    """
    said = lambda kind, column: registry.select("id", "symbol", F.lit(kind).alias("kind"), F.posexplode(column).alias("pos", "name"))
    rows = said("tag", "cashtags").unionByName(said("cased", "case_sensitive_identifiers").where(F.length("name") >= LEAST_LENGTH)).unionByName(said("plain", "unique_identifiers").where(F.length("name") >= LEAST_LENGTH))
    rows = rows.where("name <> ''").withColumn("key", F.when(F.col("kind") == "cased", F.col("name")).otherwise(F.lower("name")))
    is_tag, key = F.col("kind") == "tag", F.col("key")
    longest = lambda found: F.get(F.array_sort(found, lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    known = F.coalesce(longest(F.regexp_extract_all(key, F.lit(f"[{WORD}]+"), F.lit(0))), F.lit(""))
    inside = F.regexp_extract(key, f"[^{WORD}]([{WORD}]+)[^{WORD}]", 1)
    mode = (
        F.when(known == "", GAP)
        .when(~is_tag, F.when(F.col("kind") == "cased", CASED).otherwise(WHOLE))
        .when(inside != "", WHOLE)
        .when(known == key, INNER)
        .when(key.rlike(f"[{WORD}]$"), HEAD)
        .otherwise(TAIL)
    )
    first, last = F.regexp_extract(key, f"^[{WORD}]+", 0), F.regexp_extract(key, f"[{WORD}]+$", 0)
    rows = rows.withColumn("mode", mode)
    chosen = F.when(F.col("mode") == GAP, key).when(~is_tag, known).when(F.col("mode") == WHOLE, inside).when(F.col("mode") == HEAD, last).when(F.col("mode") == TAIL, first).otherwise(key)
    edge = lambda at, alone, none: F.when(key.rlike(f"{'^' if at else ''}[{WORD}]{'' if at else '$'}"), alone).otherwise(none)
    escaped = F.regexp_replace(key, rf"([^{WORD}\s])", r"\\$1")
    pattern = F.concat(edge(True, f"(^|[^{WORD}])", f"[{WORD}]"), escaped, edge(False, f"($|[^{WORD}])", f"[{WORD}]"))
    return rows.withColumn("anchor", chosen).withColumn("pattern", F.when(~is_tag & (F.col("anchor") != key) | ~is_tag & (F.col("mode") == GAP), pattern))


def _cuts(mode: str, n: int) -> str:
    """A pattern whose first group takes n characters of each word's beginning or end, or of any place inside words or between them."""
    return {HEAD: f"(?<![{WORD}])([{WORD}]{{{n}}})", TAIL: f"([{WORD}]{{{n}}})(?![{WORD}])", INNER: f"(?=([{WORD}]{{{n}}}))", GAP: f"(?=([^{WORD}]{{{n}}}))"}[mode]


def _marked(mode: str) -> str:
    """What is put before an anchor, so that one string tells mode and anchor; no word begins so, and a word of the lower case is itself."""
    return "" if mode == WHOLE else f"\x01{mode} "


def _keys(own: Column, lower: Column, shapes: list[tuple[str, int]]) -> Column:
    """Distinct marked anchors of a text, of the modes and lengths that postings have."""
    marked = lambda mode, found: F.transform(F.array_distinct(found), lambda w: F.concat(F.lit(_marked(mode)), w))
    parts = [F.array_distinct(words(lower))]
    for mode, n in shapes:
        if mode != WHOLE:
            parts.append(marked(mode, words(own) if mode == CASED else F.regexp_extract_all(lower, F.lit(_cuts(mode, n)), F.lit(1))))
    return F.concat(*parts)


def all_matches(texts: DataFrame, registry: DataFrame, *, key: str = "id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every entry that a text matches: (key, id, symbol, score, evidence), by the rules of :func:`match`, for a registry table of any size.

    Words of a text meet postings in a join on anchors, and only what they find there is looked at.  Postings
    up to `broadcast_bytes` are broadcast, and no text is shuffled; beyond that anchors are joined by key, and texts
    only with what was found.  Rows are told apart by `key`, so rows of one key match as one; a null or empty text matches nothing.
    """
    listed = postings(registry)
    marks = F.create_map(*[F.lit(x) for m in (WHOLE, CASED, HEAD, TAIL, INNER, GAP) for x in (m, _marked(m))])
    found = listed.select(F.concat(marks[F.col("mode")], "anchor").alias("__anchor"), F.struct("id", "symbol", "kind", "pos", "name", "key", "pattern").alias("__p"))
    size = found.agg(F.coalesce(F.sum(F.octet_length("__anchor") + 2 * F.octet_length("__p.key") + F.octet_length("__p.name") + F.octet_length("__p.symbol") + 64), F.lit(0)).alias("n")).first().n
    shapes = sorted((r["mode"], r["n"]) for r in listed.select("mode", F.when(F.col("mode").isin(WHOLE, CASED), 0).otherwise(F.length("anchor")).alias("n")).distinct().collect())
    own = F.coalesce(F.col(text), F.lit(""))
    rows = texts.select(F.col(key).alias("__key"), own.alias("__own"), F.lower(own).alias("__lower"))
    where = F.when(F.col("__p.kind") == "cased", F.col("__own")).otherwise(F.col("__lower"))
    stands = F.col("__p.pattern").isNull() & (F.col("__p.kind") != "tag") | F.contains(where, F.col("__p.key")) & (F.col("__p.pattern").isNull() | F.regexp_like(where, F.col("__p.pattern")))
    words_of = rows.select("*", F.explode(_keys(F.col("__own"), F.col("__lower"), shapes)).alias("__anchor"))
    if size <= broadcast_bytes:
        met = words_of.join(F.broadcast(found), "__anchor").where(stands).select("__key", "__p")
    else:
        sure = F.col("__p.pattern").isNull() & (F.col("__p.kind") != "tag")
        near = words_of.select("__key", "__anchor").join(found, "__anchor").select("__key", "__p")
        asked = near.where(~sure).groupBy("__key").agg(F.collect_set("__p").alias("__ps")).withColumnRenamed("__key", "__asked")
        again = rows.join(asked, F.col("__key").eqNullSafe(F.col("__asked"))).select("__key", "__own", "__lower", F.explode("__ps").alias("__p"))
        met = near.where(sure).unionByName(again.where(stands).select("__key", "__p"))
    tagged = F.bool_or(F.col("__p.kind") == "tag")
    order = F.when(F.col("__p.kind") == "cased", 0).otherwise(1)
    told = lambda test: F.transform(F.array_sort(F.collect_set(F.when(test, F.struct(order.alias("o"), "__p.pos", "__p.name")))), lambda x: x["name"])
    by_entry = met.groupBy("__key", F.col("__p.id").alias("id"), F.col("__p.symbol").alias("symbol")).agg(tagged.alias("tagged"), told(F.col("__p.kind") == "tag").alias("tags"), told(F.col("__p.kind") != "tag").alias("names"))
    evidence = F.when(F.col("tagged"), F.col("tags")).otherwise(F.col("names"))
    return by_entry.select(F.col("__key").alias(key if key not in ("id", "symbol") else f"text_{key}"), "id", "symbol", _score(F.col("tagged"), evidence).alias("score"), evidence.alias("evidence"))
