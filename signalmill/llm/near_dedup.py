"""MinHash near-duplicates by an LSH forest.

Equal shingle sets are one node from the start, so copies cost no pairs.  Each tree
of the forest is the list of all nodes in the order of another rotation of their
signatures, kept as one range-sorted table.  In a walk along it the longest common
prefix of neighbours tells regions apart: runs of nodes whose first three values are
equal.  A region of few nodes gives its pairs as candidates.  A crowded one is cut
where its common prefix is shortest, again and again, until its parts are small
enough, so each region is as deep as it has to be; neighbours across such a cut stay
candidates, too.  Within a region only the pairs of a spanning forest by estimated
similarity are kept; those are confirmed on full sets.

Nothing is lost in crowds, of which all trees show the same: their members are linked
to few leaders and by the parts of few trees.  What then is still in different
components is looked at once more: in small regions all pairs, in parts of crowds a
spanning forest, and at last in crowds, in blocks, those outside the largest component
against all.
Regions that a boundary of the sorted table cuts count as crowds, whatever their size.

Links come from full sets of 64-bit shingle hashes, in which words of more than 64 bytes
count by a digest; candidates are missed with
the probability that a pair shares no prefix in any tree (for a similarity of
0.85, 16 trees and 3 values: 3e-7).  Sets are one node if their 128-bit digests agree.

Defined results: a null text or one without words has an empty set and is linked
with nothing; fewer words than a shingle are one shingle; a text counts whole,
whatever its length; rows with equal texts share a component, those with equal
doc_id are rows of their own; a null doc_id never names a component unless all its
rows have none; the smallest of tied ids names a component; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .hashing import hasher, shingles, stream, text_batches
from .storage import dropped, smaller, written

#: Values of a signature, trees of the forest, and how far each tree's rotation is from the last.
SIGNATURE, TREES, STEP = 64, 16, 4
#: Values that nodes of a region share at least, and values that a tree is sorted by.
LEAST_DEPTH, MOST_DEPTH = 3, 16
#: A region of more nodes is crowded.
REGION = 64
#: Crowds have so many leaders, each in every LEADERS-th tree; every FIRST-th tree's parts of crowds are looked at first.
LEADERS, FIRST = 3, 8
#: Nodes of a crowd that the walk holds at once.
HELD = 1 << 16
#: Members of a crowd are compared in blocks of about so many.
CROWD_BLOCK = 512
#: Pairs of one node to a key of a join.
HOT = 200

SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("check", T.LongType()), T.StructField("signature", T.BinaryType())])


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, part in text_batches(texts):
        words, at = hasher().words(part, fold=True)
        for i in range(len(part)):
            yield np.unique(shingles(words[at[i] : at[i + 1]], width))


def signature(shingle_set: np.ndarray) -> bytes:
    """SIGNATURE minima of as many hash functions over a non-empty set."""
    factors, terms = stream(101, SIGNATURE) | np.uint64(1), stream(103, SIGNATURE)
    best = np.full(SIGNATURE, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingle_set), 4096):
        x = shingle_set[at : at + 4096, None] * factors + terms
        np.minimum(best, (x >> np.uint64(32)).astype(np.uint32).min(axis=0), out=best)
    return best.tobytes()


def sketcher(width: int):
    """A function of a text column: size, node number and signature of its shingle set; null if empty."""

    @F.arrow_udf(SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        rows = [(len(x), *(node_numbers(x) if len(x) else (None, None)), signature(x) if len(x) else None) for x in shingle_sets(texts, width)]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)], SKETCH.names)

    return sketch


def node_numbers(shingle_set: np.ndarray) -> tuple[int, int]:
    """The halves of a digest of a whole set."""
    digest = blake2b(shingle_set.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _own_sets(width: int):
    """For mapInArrow over (node, check, text): (node, set) of the texts that are their node's.

    Not a function of columns, which the optimiser would compute for all texts, before the join.
    """

    def work(chunks):
        for chunk in chunks:
            nodes, checks = chunk.column("node").to_pylist(), chunk.column("check").to_pylist()
            sets = shingle_sets(chunk.column("text"), width)
            own = [(n, x.tobytes()) for n, c, x in zip(nodes, checks, sets, strict=True) if len(x) and node_numbers(x)[1] == c]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], names=["node", "set"])

    return work


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sets, as sorted 64-bit hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _linked(percent: int):
    """A function of two columns of sets: whether they are similar."""

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similar(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(a, b, strict=True)], pa.bool_())

    return linked


PAIRS = "u bigint, v bigint"


def _forest_pairs(least_equal: int):
    """For mapInArrow over regions: candidate pairs of each between nodes of different roots, by estimated similarity.

    A region is a list of (node, root, signature); where it is spanning, only the pairs
    of a spanning forest over its roots are candidates.
    """

    def work(chunks):
        for chunk in chunks:
            us: list[int] = []
            vs: list[int] = []
            members = chunk.column("members")
            flat = members.flatten()
            bounds = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))]) if len(members) else [0]
            nodes = flat.field("node").to_numpy(zero_copy_only=False)
            roots = flat.field("root").to_numpy(zero_copy_only=False)
            signatures = np.frombuffer(b"".join(flat.field("signature").to_pylist()), np.uint32).reshape(-1, SIGNATURE)
            spanning = chunk.column("spanning").to_pylist()
            for k in range(len(members)):
                a, b = int(bounds[k]), int(bounds[k + 1])
                s = signatures[a:b]
                i, j = np.triu_indices(b - a, 1)
                apart = roots[a + i] != roots[a + j]
                i, j = i[apart], j[apart]
                equal = (s[i] == s[j]).sum(axis=1)
                good = equal >= least_equal
                i, j, equal = i[good], j[good], equal[good]
                if spanning[k] and len(i) > 1:
                    _, tops = np.unique(roots[a:b], return_inverse=True)
                    own, tops = tops.tolist(), list(range(int(tops.max()) + 1))

                    def top(x, tops=tops):
                        while tops[x] != x:
                            tops[x] = x = tops[tops[x]]
                        return x

                    for p in np.lexsort((j, i, -equal)):
                        x, y = top(own[i[p]]), top(own[j[p]])
                        if x != y:
                            tops[x] = y
                            us.append(int(nodes[a + i[p]]))
                            vs.append(int(nodes[a + j[p]]))
                else:
                    us += nodes[a + i].tolist()
                    vs += nodes[a + j].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return work


def _walk(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow along (tree, key, node) in order: members of small regions, and of crowds with their key.

    A crowd's members come with the tree and the prefix they share, other lists with null;
    rank is 0 for a region, 1 for a part of a crowd, and 2 for one that can wait.
    """
    small: list[list[int]] = []
    ranks: list[int] = []
    crowds: list[tuple[bytes, list[int]]] = []

    def close(nodes: np.ndarray, common: np.ndarray, prefix: bytes, crowded: bool) -> None:
        """A region, or a part of one: common[i] is what node i shares with the one before."""
        if crowded or len(nodes) > REGION:
            crowds.extend((prefix, nodes[k : k + 1024].tolist()) for k in range(0, len(nodes), 1024))
        parts, had = [(0, len(nodes))], len(small)
        while parts:
            a, b = parts.pop()
            if b - a <= REGION:
                if b - a > 1:
                    small.append(nodes[a:b].tolist())
                continue
            shortest = common[a + 1 : b].min()
            if shortest >= MOST_DEPTH:  # no order tells these apart: each block with the first node
                small.extend([int(nodes[a]), *nodes[k : k + REGION - 1].tolist()] for k in range(a + 1, b, REGION - 1))
                continue
            cuts = np.flatnonzero(common[a + 1 : b] == shortest) + a + 1
            small.extend(nodes[c - 1 : c + 1].tolist() for c in cuts.tolist())
            parts.extend(zip([a, *cuts.tolist()], [*cuts.tolist(), b], strict=True))
        rank = 0 if len(nodes) <= REGION else 2 if prefix[0] % FIRST else 1
        ranks.extend([rank] * (len(small) - had))

    def batch() -> pa.RecordBatch:
        prefixes = [None] * len(small) + [p for p, _ in crowds]
        columns = [pa.array(prefixes, pa.binary()), pa.array(small + [m for _, m in crowds], pa.list_(pa.int64())), pa.array(ranks + [0] * len(crowds), pa.int32())]
        out = pa.RecordBatch.from_arrays(columns, names=["prefix", "members", "rank"])
        small.clear()
        ranks.clear()
        crowds.clear()
        return out

    last, before, held = None, None, []  # the last row, the open region's prefix, and its parts
    edge, size = True, 0  # whether the open region may have begun in an earlier partition
    for chunk in chunks:
        n = chunk.num_rows
        if not n:
            continue
        trees = chunk.column("tree").to_numpy(zero_copy_only=False)
        keys = np.frombuffer(b"".join(chunk.column("key").to_pylist()), np.uint32).reshape(n, MOST_DEPTH)
        rows = np.column_stack([trees.astype(np.uint32), keys])
        nodes = chunk.column("node").to_numpy(zero_copy_only=False)
        above = rows[:1] + np.uint32(1) if last is None else last
        equal = rows == np.concatenate([above, rows[:-1]])
        common = np.cumprod(equal, axis=1).sum(axis=1) - 1
        starts = np.flatnonzero(common < LEAST_DEPTH).tolist()
        bounds = [0, *starts, n]
        for k in range(len(bounds) - 1):
            a, b = bounds[k], bounds[k + 1]
            if k and before is not None:  # a region ends before a
                if held and (size > 1 or edge):
                    close(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), before, edge)
                edge = last is None and k == 1 and a == 0
            if k:
                held, size, before = [], 0, rows[a, : LEAST_DEPTH + 1].tobytes()
            if a < b:
                held.append((nodes[a:b], common[a:b]))
                size += b - a
                if size > HELD:
                    close(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), before, True)
                    held, size, edge = [], 0, True
        last = rows[-1:]
        if small or crowds:
            yield batch()
    if held:
        close(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), before, True)
    yield batch()


def regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (node, signature): small regions as (members array<bigint>, rank), (u, v) of members of crowds and their leaders, and (key, node) of the crowds."""
    at = F.col("tree") * (4 * STEP) + 1
    key = F.call_function("substring", F.concat("signature", "signature"), at, F.lit(4 * MOST_DEPTH))
    trees = nodes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select("tree", key.alias("key"), "node")
    forest = trees.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = written(forest.mapInArrow(_walk, "prefix binary, members array<bigint>, rank int"), "regions", spread=True)
    # one order is found in many trees
    small = found.where("prefix is null").groupBy(F.array_sort("members").alias("members")).agg(F.min("rank").alias("rank"))
    tree = F.conv(F.hex(F.substring("prefix", 1, 1)), 16, 10).cast("int")
    crowd = found.where("prefix is not null").select(F.xxhash64("prefix").alias("key"), (tree % LEADERS).alias("turn"), F.explode("members").alias("node"))
    crowd = written(crowd, "crowds")
    # not one leader for all trees, lest an odd one lead everywhere
    leaders = crowd.groupBy("key").agg(F.min_by("node", F.xxhash64("node", "turn")).alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    stars = crowd.join(smaller(written(leaders, "leaders")), "key").where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v"))
    return small, stars, crowd


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with the sets of both nodes, a and b; nodes of many pairs, leaders mostly, stand under as many keys as it takes."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("hot"))
    salts = ends.groupBy("hot").count().where(F.col("count") > HOT).select("hot", F.ceil(F.col("count") / HOT).alias("salts"))
    salts = smaller(written(salts, "hot-nodes"))
    zero = F.lit(0).cast("bigint")
    every = sets.join(salts, sets["node"] == salts["hot"], "left").withColumn("salt", F.explode(F.sequence(zero, F.coalesce(F.col("salts"), F.lit(1).cast("bigint")) - 1)))
    out = pairs
    for side, other, name in (("u", "v", "a"), ("v", "u", "b")):
        spread = out.join(salts, out[side] == salts["hot"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("salts")), zero)).drop("hot", "salts")
        out = spread.join(every.select(F.col("node").alias(side), F.col("set").alias(name), "salt"), [side, "salt"]).drop("salt")
    return out


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar_components(documents: DataFrame, *, width: int = 5, percent: int = 80, keepers: bool = False) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id.

    Documents are linked whose sets of `width`-word shingles (lower-cased) have an
    intersection of at least percent % of their union; component_id is the smallest
    doc_id that links reach.  With keepers, also text_hash, and kept: whether the row
    is its component's first by doc_id, null ids last, and text_hash, or has no words or id.
    """
    # estimates vary by some 0.045 around the threshold; four times that below it, one pair in 30,000 is missed
    share = percent / 100
    least_equal = int(SIGNATURE * (share - 4 * (share * (1 - share) / SIGNATURE) ** 0.5))
    spark = documents.sparkSession
    text_hash = F.xxhash64("text").alias("text_hash")
    place = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash")
    extra = ["keeper"] if keepers else []
    sketches = documents.select("doc_id", text_hash, sketcher(width)("text").alias("k")).select("doc_id", "text_hash", "k.*")
    sketches = written(sketches, "sketches")

    def grouped(sketches: DataFrame) -> DataFrame:
        out = sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("signature").alias("signature"), F.min("check").alias("check"), F.max("check").alias("other"), F.min(place).alias("keeper"))
        return written(out, "nodes")

    nodes = grouped(sketches)
    if not nodes.where("`check` <> other").isEmpty():
        # sets that differ have one number: the whole digest tells them apart
        sketches = written(sketches.withColumn("node", F.xxhash64("node", "check")), "sketches")
        nodes = grouped(sketches)
    small, stars, crowd = regions(nodes.select("node", "signature"))
    small = written(small.withColumn("region", F.xxhash64("members")), "members")

    def candidates(roots: DataFrame | None) -> DataFrame:
        asked = small.where("rank < 2") if roots is None else small
        members = asked.select("region", "rank", F.explode("members").alias("node")).join(nodes.select("node", "signature"), "node")
        if roots is None:
            members = members.withColumn("root", F.col("node"))
        else:
            members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        spanning = F.max(F.lit(roots is None) | (F.col("rank") > 0)).alias("spanning")
        grouped = members.groupBy("region").agg(spanning, F.collect_list(F.struct("node", "root", "signature")).alias("members")).select("spanning", "members")
        if roots is not None:
            grouped = grouped.where(F.size(F.array_distinct(F.transform("members", lambda m: m["root"]))) > 1)
        return grouped.mapInArrow(_forest_pairs(least_equal), PAIRS)

    first = written(_ordered(candidates(None).unionByName(stars)), "pairs", spread=True)

    def sets_of(wanted: DataFrame) -> DataFrame:
        homes = wanted.join(nodes.select("node", "check", "keeper"), "node").select("node", "check", F.col("keeper.doc_id").alias("home_id"), F.col("keeper.text_hash").alias("home_text"))
        texts = documents.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
        # a doc_id may have any number of texts, of which only one is this node's; other texts of that hash are told by their check
        own = texts.join(smaller(written(homes, "homes")), F.col("home_id").eqNullSafe(F.col("id")) & (F.col("home_text") == F.col("text_hash"))).select("node", "check", "text")
        return written(own.mapInArrow(_own_sets(width), "node bigint, set binary").dropDuplicates(["node"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        both = _with_sets(pairs, sets)
        links = written(both.where(_linked(percent)("a", "b")).select("u", "v"), "links", spread=True)
        dropped(spark, sets)
        return links

    roots = components(confirmed(first))
    second = written(_ordered(candidates(roots)).join(first, ["u", "v"], "left_anti"), "pairs", spread=True)
    known = lambda: roots.select(F.col("node").alias("u"), F.col("root").alias("v"))  # noqa: E731  as good as all links so far
    if not second.isEmpty():
        roots = components(known().unionByName(confirmed(second)))
    rest = _rest_of_crowds(crowd, roots)
    if rest is not None:
        members, sizes = rest
        sets = sets_of(members.select("node").distinct()).join(nodes.select("node", "signature"), "node")
        roots = components(known().unionByName(_linked_in_crowds(members, sizes, sets, least_equal, percent)))
    rooted = nodes.select("node", "least", *extra).join(roots, "node", "left").select("node", "least", *extra, F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), *[F.min(c).alias(c) for c in extra])
    of_node = rooted.select("node", "root").join(named, "root").select("node", "component_id", *extra)
    kept = [F.col("text_hash"), (F.col("node").isNull() | F.col("doc_id").isNull() | F.col("keeper").eqNullSafe(place)).alias("kept")] if keepers else []
    out = sketches.join(of_node, "node", "left")
    dropped(spark, small, first, second)
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *kept)


def _rest_of_crowds(crowd: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(key, node, root, apart) of the members of crowds that aren't one component, and (key, blocks); None without any.

    Members apart are those outside their crowd's largest component.
    """
    members = crowd.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    members = written(members, "crowd-roots")
    shares = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    crowds = shares.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("c").alias("n")).where("roots > 1")
    crowds = written(crowds, "split-crowds")
    if crowds.isEmpty():
        return None
    sizes = crowds.select("key", F.ceil(F.col("n") / CROWD_BLOCK).alias("blocks"))
    out = members.join(crowds, "key").select("key", "node", "root", (F.col("root") != F.col("main")).alias("apart"))
    return written(out, "rest"), sizes


def _linked_in_crowds(members: DataFrame, sizes: DataFrame, sets: DataFrame, least_equal: int, percent: int) -> DataFrame:
    """Links between members apart and all others of their crowd, in blocks: a spanning forest of each block's.

    A task holds two blocks of a crowd.  Signatures rule most pairs out; the others are
    checked on full sets there and then, unless what was found already joins them.
    """
    rows = members.join(sets, "node").join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    columns = ["node", "root", "signature", "set"]
    left = rows.where("apart").select("key", F.col("block").alias("i"), F.explode(every).alias("j"), *columns)
    right = rows.select("key", F.col("block").alias("j"), F.explode(every).alias("i"), *columns)
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # else their columns are one another's

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        us: list[int] = []
        vs: list[int] = []
        if a.num_rows and b.num_rows:
            (an, ar, asig, aset), (bn, br, bsig, bset) = ([t[c].combine_chunks() for c in columns] for t in (a, b))
            an, ar, bn, br = (x.to_numpy(zero_copy_only=False) for x in (an, ar, bn, br))
            asig, bsig = (np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(-1, SIGNATURE) for x in (asig, bsig))
            tops: dict[int, int] = {}

            def top(x: int) -> int:
                while tops.setdefault(x, x) != x:
                    tops[x] = x = tops[tops[x]]
                return x

            for i in range(len(an)):
                equal = (bsig == asig[i]).sum(axis=1)
                close = np.flatnonzero((equal >= least_equal) & (br != ar[i]))
                for j in close[np.argsort(-equal[close], kind="stable")].tolist():
                    x, y = top(int(ar[i])), top(int(br[j]))
                    if x != y and similar(aset[i].as_buffer(), bset[j].as_buffer(), percent):
                        tops[x] = y
                        us.append(int(an[i]))
                        vs.append(int(bn[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(work, PAIRS)


def oracle_sql(width: int, percent: int) -> str:
    """similar_components() and kept in DuckDB SQL, over all pairs that share a shingle; for small tables."""
    words = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - {width - 1}), lambda i: {words})) END AS s FROM words
), posts AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM posts a JOIN posts b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), edges AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT e.v, r.root FROM reach r JOIN edges e ON r.node = e.u
), least AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least l ON s.doc_id = l.node
"""
