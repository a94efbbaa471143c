"""One document of each group of near copies: SimHash finds most, a complete filter the rest."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postvet.llm.common import Scratch, map_texts, ready, text_hash
from postvet.llm.components import components
from postvet.llm.simhash import SEED, fingerprint, near_links, shingle_hashes
from postvet.session import stored

SHINGLE = 5
SIMILARITY = 0.8
# SimHash only gathers most copies early and cheaply. What it misses is found by the prefix
# filter, so neither the radius nor the number of fingerprints decides what is linked.
PRINT_WORDS = 2
RADIUS = 6
PRINTS = 1
# Bits for each shingle, at least, in the parity map of a set, which bounds how far two sets
# differ from below.
MAP_BITS = 4
# Of the texts one in so many is looked at for common shingles; the most common ones are kept.
SAMPLE = 4
COMMON = 200_000
# Rounds of one partner for each shingle end when one confirms no more links than this.
FEW_LINKS = 256
# Pairs of one node that meet in a task before its others go to another.
PART_PAIRS = 256
# Nodes of one shingle in a part: every two parts meet in a task.
CELL_NODES = 2048
# Shingles that a node's shingle takes along of those before it.
BEFORE = 64


def _remixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, whose bits don't follow the first ones."""
    with np.errstate(over="ignore"):
        hashes = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return hashes ^ (hashes >> np.uint64(33))


def _common(named: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several texts of a sample hold, and in how many.

    They only order shingles, rare ones first; any order gives the same links.
    """
    some = named.filter(F.pmod("text_hash", F.lit(SAMPLE)) == 0).dropDuplicates(["text_hash"])
    sets = map_texts(some, [], text, "items array<bigint>", lambda texts: [pa.array(
        [shingle_hashes(t, shingle, distinct=True).view(np.int64) for t in texts], pa.list_(pa.int64())
    )])
    top = sets.select(F.explode("items").alias("item")).groupBy("item").count().filter("count > 2")
    rows = top.orderBy(F.desc("count"), "item").limit(COMMON).toPandas()
    items = rows["item"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(items)
    return items[order], rows["count"].to_numpy(np.int64)[order]


def prefix(found: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 of the n shingles, rare ones first.

    Two sets of the similarity share at least ceil(similarity n) shingles of either one.
    So in any order that all sets follow, their prefixes have a shingle in common.
    """
    if not len(found):
        return found
    level = np.zeros(len(found), np.int64)
    items, counts = common
    if len(items):
        where = np.minimum(np.searchsorted(items, found), len(items) - 1)
        level = np.where(items[where] == found, counts[where], 0)
    size = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    return found[np.lexsort([found, level])[:size]]


def parity_map(found: np.ndarray) -> bytes:
    """A power of two of bits, each turned over by the shingles that fall on it.

    Bits in which two maps differ are at most the shingles that only one set holds. A map
    folded in half is the map of half the bits.
    """
    size = 1 << max(6, (MAP_BITS * len(found) - 1).bit_length())
    cells = np.bincount((found >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(cells & 1, bitorder="little").tobytes()


def differing_bits(one: bytes, two: bytes) -> int:
    """Bits in which two parity maps differ, the larger one folded to the size of the other."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _marks(
    docs: DataFrame, ids: list[str], text: str, shingle: int, words: int, prints: int, similarity: float, common,
) -> DataFrame:
    """(ids.., fps, node, n, prefix, map): fingerprints, hash of the set of shingles, its size and what finds it."""

    def work(texts):
        fps, nodes, sizes, firsts, maps = [], [], [], [], []
        for t in texts:
            found = shingle_hashes(t, shingle, distinct=True)
            short = shingle_hashes(t, words, distinct=True)
            fps.append([fingerprint(short)])
            for _ in range(prints - 1):
                short = _remixed(short)
                fps[-1].append(fingerprint(short))
            nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63))
            sizes.append(len(found))
            firsts.append(prefix(found, similarity, common.value).view(np.int64))
            maps.append(parity_map(found))
        longs = pa.list_(pa.int64())
        return [pa.array(fps, longs), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(firsts, longs), pa.array(maps, pa.binary())]

    return map_texts(
        docs, ids, text, "fps array<bigint>, node long, n long, prefix array<bigint>, map binary", work
    )


def _beside(pairs: DataFrame, end: str, sets: DataFrame, name: str) -> DataFrame:
    """The pairs with the set of the node at one end.

    A node of many pairs, such as the middle of a group, has its pairs dealt over
    several parts, each with a copy of its set, so that no task gets them all.
    """
    hot = (
        pairs.groupBy(end).agg(F.ceil(F.count("*") / PART_PAIRS).cast("int").alias("parts"))
        .filter("parts > 1")
    )
    salted = pairs.join(hot, end, "left").withColumn(
        "part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int")
    ).drop("parts")
    copies = sets.toDF(end, name).join(hot, end, "left").select(
        end, name, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    )
    return salted.join(copies, [end, "part"]).drop("part")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have the similarity.

    Only pairs whose sizes allow it are compared. Rows without words are one node, so
    no set of a pair is empty on both sides.
    """
    fit = pairs.filter(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity)).select("a", "b", "na", "nb")
    both = _beside(_beside(fit, "a", sets, "first"), "b", sets, "second")
    shared = F.size(F.array_intersect("first", "second"))
    return both.withColumn("shared", shared).filter(
        F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")) >= F.lit(similarity)
    ).select("a", "b")


def _candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b, bits) of nodes: a forest of each of their fingerprints, and all nodes of a fingerprint."""
    prints = stored(nodes.select("node", F.posexplode("fps").alias("kind", "fp")).withColumn("kind", F.col("kind").cast("long")))
    heads = stored(prints.groupBy("kind", "fp").agg(F.min("node").alias("head")))
    near = near_links(heads.select("kind", "fp"), radius, forest=True, kind="kind")
    across = (
        near.join(heads.toDF("kind", "fp", "a"), ["kind", "fp"]).join(heads.toDF("kind", "root", "b"), ["kind", "root"])
        .select("a", "b", F.bit_count(F.col("fp").bitwiseXOR(F.col("root"))).alias("bits"))
    )
    within = prints.join(heads, ["kind", "fp"]).filter("node <> head").select(
        F.col("node").alias("a"), F.col("head").alias("b"), F.lit(0).alias("bits")
    )
    return across.union(within).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.min("bits").alias("bits")
    )


def _tokens(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(shingle, node, at) of the prefixes, `at` the place, but for shingles that nodes of one group alone hold."""
    return _live(nodes.select("node", F.posexplode("prefix").alias("at", "shingle")), roots)


def _live(tokens: DataFrame, roots: DataFrame) -> DataFrame:
    """(shingle, node, at) of the shingles that nodes of different groups hold."""
    every = tokens.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    live = every.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return every.join(live.select("shingle"), "shingle", "left_semi").select("shingle", "node", "at")


def _placed(tokens: DataFrame) -> DataFrame:
    """(shingle, node, at, before, skipped): up to BEFORE shingles of the node before this one, and how many more it has."""
    held = tokens.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "shingle"))).alias("held"))
    each = held.select("node", F.col("held.shingle").alias("all"), F.posexplode("held").alias("k", "one"))
    return each.select(
        "one.shingle", "node", "one.at",
        F.slice("all", F.greatest(F.col("k") - BEFORE, F.lit(0)) + 1, F.least("k", F.lit(BEFORE))).alias("before"),
        F.greatest(F.col("k") - BEFORE, F.lit(0)).alias("skipped"),
    )


def _central(tokens: DataFrame, about: DataFrame, roots: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Of each shingle, the pairs (a, b, na, nb) of one of its nodes with its others of different groups.

    The first time that is the node with the smallest share of shingles of its own, such as
    the original of edited copies, then any. So rows grow with the tokens, whatever a group's size.
    """
    at = (
        tokens.select("shingle", "node").join(about.select("node", "n", "own"), "node").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    chance = F.shiftrightunsigned(F.xxhash64("node", F.lit(turn)), 32)
    share = F.floor(F.col("own") / F.greatest("n", F.lit(1)) * (1 << 20)).cast("long")
    order = F.shiftleft(share, 32) + chance if turn == 1 else chance
    middle = at.withColumn("order", order).groupBy("shingle").agg(
        *(F.min_by(name, "order").alias(to) for name, to in (("node", "b"), ("root", "rb"), ("n", "nb")))
    )
    met = at.join(middle, "shingle").filter(
        (F.col("root") != F.col("rb")) & (F.least("n", "nb") >= F.greatest("n", "nb") * F.lit(similarity))
    )
    first = F.col("node") < F.col("b")
    return met.select(
        F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"),
        F.when(first, F.col("n")).otherwise(F.col("nb")).alias("na"), F.when(first, F.col("nb")).otherwise(F.col("n")).alias("nb"),
    ).distinct()


def _apart(tokens: DataFrame, about: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, ra, rb, na, nb, bits) of nodes in different groups that share a prefix shingle.

    Left out are pairs that can't be similar, no others: by their sizes, and, if `tokens` are
    placed (see `_placed`), by what is left of both sets from the first shingle on that they share. Sets
    that share a shingle share all earlier ones of their prefixes or none of them is common, so
    a placed pair comes for its first shared shingle alone, unless one has skipped some; others
    come once for each shingle. `bits` is how far the fingerprints differ. The c nodes of a frequent
    shingle are dealt over parts, and every two parts meet in a cell of their own: c nodes of
    different groups are compared c * c / 2 times, but a cell has at most about 2 * CELL_NODES
    rows, and a node travels once per part. Both sides of the join are the same rows in the
    same order, so they are shuffled once.
    """
    placed = "before" in tokens.columns
    more = ["after", "skipped", "before"] if placed else []
    at = (
        tokens.join(about.select("node", "n", "fp"), "node").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    if placed:
        at = at.withColumn("after", F.col("n") - F.col("at"))
    live = (
        at.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held"))
        .filter("low <> high").select("shingle", F.ceil(F.col("held") / CELL_NODES).cast("int").alias("parts"))
    )
    own, other = F.col("own"), F.col("other")
    dealt = (
        at.join(live, "shingle").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("shingle", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), "own", "node", "root", "n", "fp", *more)
    )
    cell, side = ["shingle", "i", "j"], ["p{}", "{}", "r{}", "n{}", "f{}", *(name + "_{}" for name in more)]
    left, right = (dealt.toDF(*cell, *(name.format(end) for name in side)) for end in "ab")
    fits = (
        (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))
        # Two nodes of one part meet in that part's own cell alone.
        & ((F.col("i") == F.col("j")) | (F.col("pa") != F.col("pb")))
        & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity))
    )
    if placed:
        # They share this shingle, what follows it in the smaller rest, and of those before it only skipped ones.
        most = F.least("after_a", "after_b") + F.col("skipped_a") + F.col("skipped_b")
        least = (F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
        fits = fits & (most >= least) & ~F.arrays_overlap("before_a", "before_b")
    return left.join(right, cell).filter(fits).select(
        "a", "b", "ra", "rb", "na", "nb", F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))).alias("bits")
    )


def _best(pairs: DataFrame, ends: list[str]) -> DataFrame:
    """Of the pairs that have a value in one of the columns `ends`, the best one: distinct (a, b, na, nb).

    Fewest differing bits come first, then sizes nearest to each other, then a hash of the
    pair. All this is one number and what is picked are numbers, so Spark folds the pairs in
    a hash table of the values; the least of a struct would have all pairs sorted. Every
    `min_by` meets the same rows in the same order, so the four are columns of one pair.
    """
    far = F.abs(F.col("na") - F.col("nb")) / F.greatest(F.col("na") + F.col("nb"), F.lit(1))
    order = (
        F.shiftleft(F.col("bits").cast("long"), 56) + F.shiftleft(F.floor(far * (1 << 23)).cast("long"), 32)
        + F.shiftrightunsigned(F.xxhash64("a", "b"), 32)
    )
    seen = pairs.select("a", "b", "na", "nb", order.alias("order"), F.explode(F.array(*ends)).alias("end"))
    return seen.groupBy("end").agg(
        *(F.min_by(name, "order").alias(name) for name in ("a", "b", "na", "nb"))
    ).drop("end").distinct()


def _possible(pairs: DataFrame, about: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b, na, nb) but for those whose parity maps prove them to be less similar."""
    one, two = about.select(F.col("node").alias("a"), F.col("map").alias("ma")), about.select(F.col("node").alias("b"), F.col("map").alias("mb"))
    share = (1 - similarity) / (1 + similarity)

    def run(batches):
        for batch in batches:
            most = share * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) + 1e-6
            bits = [differing_bits(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            kept = np.flatnonzero(np.array(bits) <= most)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(kept)) for c in batch.columns[:4]], ["a", "b", "na", "nb"])

    return (
        pairs.select("a", "b", "na", "nb").distinct().join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ma", "mb")
        .mapInArrow(run, "a long, b long, na long, nb long")
    )


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    similarity: float = SIMILARITY, words: int = PRINT_WORDS, radius: int = RADIUS, prints: int = PRINTS,
) -> DataFrame:
    """(key, text_hash, node, root) for every row; rows of one root are near copies.

    Two texts are linked if their sets of `shingle`-word shingles (A-Z lowered; fewer
    words: all of them) have a Jaccard similarity of `similarity` or more; `root` names
    the linked group, the same as if all pairs were compared:

    1. A trie join of `prints` SimHash fingerprints gives a forest of near pairs; each text
       is compared with the one nearest to it in bits, which gathers most copies.
    2. Between the groups so found, pairs come from a complete filter: sets that similar
       share a shingle of their prefixes (see `prefix`). First the holders of each shingle
       are compared with one of them, over and over while that gathers many; then every pair
       that is left between different groups. Pairs in one confirmed group can add nothing.

    Every link is confirmed on whole texts, so chance neighbours among many fingerprints
    join nothing. Rows with equal sets of shingles are one node, named by a 64-bit hash,
    so a text with a million copies is compared once. Null, empty and blank texts are one
    node. An empty table gives no rows. Other columns are not looked at.
    """
    spark = ready(docs.sparkSession)
    with Scratch(spark, shuffles=True) as scratch:
        return _near_groups(docs, key, text, shingle, similarity, words, radius, prints, scratch)


def _near_groups(docs, key, text, shingle, similarity, words, radius, prints, scratch: Scratch) -> DataFrame:
    named = docs.select(F.col(key), F.col(text).alias("__body"), text_hash(text).alias("text_hash"))
    common = docs.sparkSession.sparkContext.broadcast(_common(named, "__body", shingle))
    rows = scratch.stored(_marks(named, [key, "text_hash"], "__body", shingle, words, prints, similarity, common), "rows")
    nodes = scratch.stored(
        rows.groupBy("node").agg(F.min_by(
            F.struct("fps", "n", "prefix", "map", F.struct(key, "text_hash").alias("o")), "text_hash"
        ).alias("m")).select("node", "m.*"), "nodes"
    )
    size = nodes.select("node", "n")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        # Narrow tables first, so that Spark knows their size: texts are shuffled only if it is too large.
        pairs = scratch.stored(pairs, f"{name}_pairs")
        ends = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
        chosen = scratch.stored(nodes.join(ends, "node", "left_semi").select(
            "node", F.col(f"o.{key}").alias("__k"), F.col("o.text_hash").alias("__h")
        ), f"{name}_chosen")
        met = (named[key].eqNullSafe(chosen["__k"])) & (named["text_hash"] == chosen["__h"])
        sets = scratch.stored(
            map_texts(named.join(chosen, met).select("node", "__body"), ["node"], "__body", "items array<bigint>", lambda texts: [pa.array(
                [shingle_hashes(t, shingle, distinct=True).view(np.int64) for t in texts], pa.list_(pa.int64())
            )]).dropDuplicates(["node"]), f"{name}_sets"
        )
        links = scratch.stored(_verified(pairs, sets, similarity), name)
        for part in ("pairs", "chosen", "sets"):
            scratch.drop(f"{name}_{part}")
        return links

    # 1. The nearest partner of each node, by bits and then by size.
    pairs = _candidates(nodes.select("node", "fps"), radius)
    pairs = scratch.stored(pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b"), "near")
    links = confirmed(_best(pairs, ["a", "b"]), "first")
    roots = scratch.stored(components(links), "roots0")

    # 2. What is left between different groups.
    tokens = scratch.stored(_tokens(nodes, roots), "tokens")
    about = scratch.stored(
        nodes.select("node", "n", "map", F.col("fps")[0].alias("fp"), F.size("prefix").alias("held"))
        .join(tokens.groupBy("node").agg(F.count("*").alias("live")), "node")
        .select("node", "n", "map", "fp", (F.col("held") - F.col("live")).alias("own")), "about"
    )
    turn = 0
    while True:
        turn += 1
        more = confirmed(_possible(_central(tokens, about, roots, similarity, turn), about, similarity), f"links{turn}")
        links = links.union(more)
        roots = scratch.stored(components(links), f"roots{turn}")
        if more.count() <= FEW_LINKS:
            break
    placed = scratch.stored(_placed(_live(tokens, roots)), "placed")
    rest = _possible(_apart(placed, about, roots, similarity), about, similarity)
    found = components(links.union(confirmed(rest, "rest")))
    return scratch.keep(
        rows.join(found, "node", "left")
        .select(key, "text_hash", "node", F.coalesce("root", "node").alias("root"))
    )


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of each group of near copies, all columns kept: the one with the smallest key.

    `settings` are those of `near_groups`. Of several rows with that key (texts of one
    id, or repeated rows) one stays, by text hash. A group of null keys alone keeps one
    row as well.
    """
    found = near_groups(docs, key, text, **settings)
    order = F.struct(F.col(key).isNull().alias("late"), F.col(key).alias("k"), F.col("text_hash").alias("h"))
    keep = found.groupBy("root").agg(F.min(order).alias("o")).select(
        F.col("o.k").alias("__k"), F.col("o.h").alias("__h")
    )
    # Rows that repeat an id and text of a kept one go too: only those few are compared by content.
    repeated = F.count("*").alias("__n")
    named = found.groupBy(key, "text_hash").agg(repeated)
    kept = stored(
        named.join(keep, named[key].eqNullSafe(keep["__k"]) & (F.col("text_hash") == F.col("__h")))
        .select("__k", "__h", "__n")
    )
    marked = docs.withColumn("__t", text_hash(text))
    met = marked.join(kept, marked[key].eqNullSafe(kept["__k"]) & (F.col("__t") == F.col("__h")))
    once = met.filter("__n = 1").select(*docs.columns)
    twice = met.filter("__n > 1").dropDuplicates([key, "__t"]).select(*docs.columns)
    return once.union(twice)
