"""SimHash near-duplicates: fingerprints, a binary trie self-join, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postvet.llm.common import map_texts, ready, text_hash
from postvet.llm.components import components
from postvet.session import stored

BITS = 64
SEED = 42
# Pairs that two trie nodes may hold between them before their fingerprints are compared outright.
LEAF_PAIRS = 64
# Node pairs and fingerprint pairs handled at once; bounds the memory of a task.
CHUNK = 1 << 18


def shingle_hashes(text: str | None, words: int, distinct: bool = False) -> np.ndarray:
    """XXH64 of each shingle of `words` words, A-Z lowered; fewer words: of all of them."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    cuts = zip(starts[:n].tolist(), ends[len(parts) - n:].tolist())
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(joined[s:e], SEED) for s, e in cuts), np.uint64, n)
    return np.unique(found) if distinct else found


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, lowest bit first; in slices, so memory stays small."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[i:i + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit value whose bits are set where over half the hashes have them; none: 0."""
    if not len(hashes):
        return 0
    return int(np.packbits(bit_sums(hashes) * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(
    docs: DataFrame, ids: list[str], text: str = "text", words: int = 4, distinct: bool = False,
) -> DataFrame:
    """SimHash of every whole text as (ids.., fp long). Null, empty and blank texts give 0."""

    def work(texts):
        return [pa.array(
            [fingerprint(shingle_hashes(t, words, distinct)) for t in texts], pa.int64()
        )]

    return map_texts(docs, ids, text, "fp long", work)


# --- the trie self-join

def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, .. for counts[i] values, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class _Groups:
    """Union-find over positions, by hooking roots and halving paths in whole arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        # The pairs that joined two groups: a forest, in which every pair was given to `join`.
        self.forest: list[np.ndarray] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        given = np.stack([i, j])
        while len(i):
            i, j = self.root[i], self.root[j]
            open_ = i != j
            low, high = np.minimum(i, j)[open_], np.maximum(i, j)[open_]
            given = given[:, open_]
            np.minimum.at(self.root, high, low)
            hooked = np.flatnonzero(self.root[high] == low)
            _, once = np.unique(high[hooked], return_index=True)
            self.forest.append(given[:, hooked[once]])
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
            i, j = low, high

    def runs(self) -> np.ndarray:
        """Prefix sums of the places where the root changes: equal ends mean one group."""
        return np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])])


def trie_groups(keys: np.ndarray, exact: int, radius: int) -> np.ndarray:
    """Group of each sorted distinct key, as the position of its first member.

    Keys link if their first `exact` bits agree and the rest differ in at most
    `radius` bits. The sorted keys are a binary trie: a node is a range of them. Node
    pairs descend together; a pair that took different branches has one more differing
    bit and is dropped beyond the radius. Pairs of small nodes are compared key by key.
    A pair of nodes that lie in one group already can add nothing and is dropped too.
    """
    return _grouped(keys, _by_opening(keys, exact), exact, radius)


def trie_forest(keys: np.ndarray, exact: int, radius: int) -> np.ndarray:
    """Pairs of positions, each a link of its own, that connect what `trie_groups` groups.

    Near pairs come first, in three widening searches, so that a key is tied to keys close to it.
    """
    return _forest(keys, _by_opening(keys, exact), exact, radius)


def _by_opening(keys: np.ndarray, exact: int) -> np.ndarray:
    """Where keys begin whose first `exact` bits are not those of the key before."""
    if not exact or not len(keys):
        return np.arange(min(1, len(keys)))
    top = keys >> np.uint64(BITS - exact)
    return np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))


def _grouped(keys: np.ndarray, tries: np.ndarray, depth: int, radius: int) -> np.ndarray:
    groups = _Groups(len(keys))
    _descend(keys, tries, depth, radius, groups)
    return groups.root


def _forest(keys: np.ndarray, tries: np.ndarray, depth: int, radius: int) -> np.ndarray:
    groups = _Groups(len(keys))
    for reach in sorted({radius // 4, radius // 2, radius}):
        _descend(keys, tries, depth, reach, groups)
    return np.concatenate([np.empty((2, 0), np.int64), *groups.forest], axis=1)


def _descend(keys: np.ndarray, tries: np.ndarray, depth: int, radius: int, groups: _Groups) -> None:
    """Walk tries that lie one after another and join the groups of all keys within the radius.

    A trie begins at each place of `tries`; its keys are sorted and agree in the first `depth` bits.
    """
    first, last = tries, np.append(tries[1:], len(keys))
    some = last - first > 1
    if not some.any():
        return
    one = np.full(int(some.sum()), 0)
    # Node pairs by depth: start and end of either node, and the bits that differ so far.
    stack = [(depth, np.stack([first[some], last[some], first[some], last[some], one]))]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > CHUNK:
            stack.append((depth, pairs[:, CHUNK:]))
            pairs = pairs[:, :CHUNK]
        runs = groups.runs()
        a, b, c, d, off = pairs
        closed = (runs[a] == runs[b - 1]) & (runs[c] == runs[d - 1]) & (groups.root[a] == groups.root[c])
        pairs = pairs[:, ~closed]
        a, b, c, d, off = pairs
        small = ((b - a) * (d - c) <= LEAF_PAIRS) | (depth == BITS)
        _compare(keys, pairs[:, small], radius, groups)
        a, b, c, d, off = pairs[:, ~small]
        if not len(a):
            continue
        # Within a node the keys with a set bit come last.
        ones = np.concatenate([[0], np.cumsum(keys >> np.uint64(BITS - 1 - depth) & np.uint64(1), dtype=np.int64)])
        m, n = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = a == c
        below = [
            np.stack([a, m, c, n, off]), np.stack([m, b, n, d, off]), np.stack([a, m, n, d, off + 1]),
            # A node with itself has only one mixed pair of branches.
            np.stack([m, b, c, n, off + 1])[:, ~same],
        ]
        below = np.concatenate(below, axis=1)
        live = (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= radius)
        stack.append((depth + 1, below[:, live]))


def _compare(keys: np.ndarray, pairs: np.ndarray, radius: int, groups: _Groups) -> None:
    """Join the keys of small node pairs that are within the radius."""
    a, b, c, d, _ = pairs
    sizes = (b - a) * (d - c)
    bounds = np.searchsorted(np.cumsum(sizes), np.arange(CHUNK, sizes.sum() + CHUNK, CHUNK))
    start = 0
    for stop in np.unique(np.minimum(bounds + 1, len(sizes))):
        s, start = slice(start, stop), stop
        # Every key of the left node beside every key of the right one.
        left = _ranges(a[s], (b - a)[s])
        width = np.repeat((d - c)[s], (b - a)[s])
        right = _ranges(np.repeat(c[s], (b - a)[s]), width)
        left = np.repeat(left, width)
        near = np.bitwise_count(keys[left] ^ keys[right]) <= radius
        near &= left < right
        groups.join(left[near], right[near])


def _layouts(radius: int) -> list[list[int]]:
    """Bit orders of the fingerprint, each led by two of `radius + 2` blocks.

    At most `radius` blocks can hold a differing bit, so two blocks at least agree.
    """
    edges = np.linspace(0, BITS, radius + 3).round().astype(int)
    blocks = [list(range(edges[i], edges[i + 1])) for i in range(radius + 2)]
    orders = []
    for i, j in combinations(range(radius + 2), 2):
        lead = blocks[i] + blocks[j]
        orders.append((len(lead), lead + [x for x in range(BITS) if x not in set(lead)]))
    return orders


def _reorder(keys: np.ndarray, order: list[int]) -> np.ndarray:
    """The bits in the given order, first one highest."""
    bits = np.unpackbits(keys.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits[:, order], axis=1)
    return np.ascontiguousarray(packed).view(">u8").astype(np.uint64).ravel()


def near_links(
    distinct: DataFrame, radius: int, hot: int = 1 << 18, forest: bool = False, kind: str | None = None,
) -> DataFrame:
    """Links (fp, root) that join all of the distinct `fp` within `radius` bits, directly or not.

    With `forest` every link is itself within the radius; otherwise it may stand for a chain.
    With `kind`, a column of small integers from 0, only fingerprints of one kind are
    linked, and the links are (kind, fp, root); all kinds share one pass.

    Two blocks of bits must agree (see `_layouts`), so the fingerprints are dealt by
    layout and the leading block of it, and each task joins its share by a trie. A task
    returns at most one link per fingerprint, never the pairs of a group. A share of
    over `hot` fingerprints is cut by hash, and every two of its parts meet in a task of
    their own, so that no task grows with the largest group.
    """
    ends_of = ["fp", "root"] if kind is None else [kind, "fp", "root"]
    if radius == 0:
        return distinct.withColumn("root", F.col("fp")).select(*ends_of).limit(0)
    orders = _layouts(radius)
    edges = np.linspace(0, BITS, radius + 3).round().astype(int)
    leads = list(combinations(range(radius + 2), 2))

    def block(i: int):
        width = int(edges[i + 1] - edges[i])
        return F.shiftrightunsigned("fp", int(edges[i])).bitwiseAND(F.lit((1 << width) - 1))

    offset = F.lit(0) if kind is None else F.col(kind) * len(orders)
    # One number names layout and lead: blocks have at most 22 bits. It sorts by its bits alone.
    shares = F.array(*[
        (offset + k).cast("long") * F.lit(1 << 44) + block(i) * F.lit(1 << 22) + block(j)
        for k, (i, j) in enumerate(leads)
    ])
    dealt = distinct.select("fp", F.explode(shares).alias("share"))
    # A lead can only be large if its first block is, of which there are fewer; mostly none is.
    firsts = F.array(*[offset * F.lit(1 << 32) + F.lit(i << 22) + block(i) for i in range(radius + 1)])
    cells = distinct.select(F.explode(firsts).alias("cell")).groupBy("cell").count().filter(F.col("count") > hot)
    if cells.isEmpty():
        spread = dealt.withColumn("parts", F.lit(0).cast("long"))
    else:
        large = stored(
            dealt.groupBy("share").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
            .select("share", F.ceil(F.col("n") / hot).cast("int").alias("n"))
        )
        n = F.coalesce("n", F.lit(1))
        spread = (
            dealt.join(large, "share", "left")
            .withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), n).cast("long"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
            .select("fp", "share", (F.least("own", "other") * F.lit(1 << 32) + F.greatest("own", "other")).alias("parts"))
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shares(batches):
            keys, moved = rows[:, 0], np.empty(len(rows), np.uint64)
            kinds, layouts = np.divmod(rows[:, 1] >> 44, len(orders))
            for at in np.split(np.arange(len(rows)), _turns(layouts[:, None])):
                moved[at] = _reorder(keys[at].view(np.uint64), orders[layouts[at[0]]][1])
            share = np.zeros(len(rows), np.int64)
            share[_turns(rows[:, 1:])] = 1
            share = np.cumsum(share)
            rank = np.lexsort([moved, share])
            tries = np.append(0, _turns(share[:, None]))
            depth = min(orders[k][0] for k in np.unique(layouts))
            if forest:
                ends = _forest(moved[rank], tries, depth, radius)
            else:
                root = _grouped(moved[rank], tries, depth, radius)
                mine = np.flatnonzero(root != np.arange(len(root)))
                ends = np.stack([mine, root[mine]])
            signed, kinds = keys[rank], kinds[rank]
            for i in range(0, ends.shape[1], 1 << 16):
                left, right = ends[:, i:i + (1 << 16)]
                made = [pa.array(x) for x in (kinds[left], signed[left], signed[right])]
                yield pa.RecordBatch.from_arrays(made[-len(ends_of):], ends_of)

    return (
        spread.repartition("share", "parts").sortWithinPartitions("share", "parts")
        .mapInArrow(run, ", ".join(f"`{name}` long" for name in ends_of)).distinct()
    )


def _turns(rows: np.ndarray) -> np.ndarray:
    """Places of rows that are not the same as the row before."""
    return np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1)) + 1


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows (fp, share, parts) of whole shares, many small ones at once.

    The rows are sorted, so those of a share, which agree in all but `fp`, are next to
    each other and never torn.
    """
    held: list[np.ndarray] = []
    size, enough = 0, 1 << 16
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1).astype(np.int64))
        size += len(held[-1])
        if size < enough:
            continue
        rows = np.concatenate(held)
        turns = _turns(rows[:, 1:])
        if len(turns):
            yield rows[:turns[-1]]
            rows = rows[turns[-1]:]
        held, size = [rows], len(rows)
        # A share that goes on is looked at again when it has doubled.
        enough = max(1 << 16, 2 * size)
    if size:
        yield np.concatenate(held)


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4,
    distinct: bool = False,
) -> DataFrame:
    """Near-duplicate components: (key, text_hash, fp long, root long, component) for every row.

    SimHash over shingles of `words` words (repeats count unless `distinct`), linked at
    `radius` or fewer differing bits; the component is the smallest key reachable, and
    `root` the smallest fingerprint, which tells components apart if keys repeat.

    Equal fingerprints are folded first, so a text with a million copies is one entry of
    the trie. Null, empty and blank texts have fingerprint 0 and link like any other.
    Rows that repeat a key each keep their own fingerprint. Null keys are last: they
    only name a component that has no other. Other columns are not looked at. An empty
    table gives no rows.
    """
    ready(docs.sparkSession)
    named = docs.select(F.col(key), F.col(text).alias("__body"), text_hash(text).alias("text_hash"))
    rows = stored(fingerprints(named, [key, "text_hash"], "__body", words, distinct))
    folded = stored(rows.groupBy("fp").agg(F.min(key).alias("least")))
    reach = stored(components(near_links(folded.select("fp"), radius)))
    least = (
        reach.join(folded.withColumnRenamed("fp", "node"), "node")
        .groupBy("root").agg(F.min("least").alias("least"))
    )
    linked = reach.join(least, "root").select(
        F.col("node").alias("fp"), "root", F.col("least").alias("far")
    )
    groups = folded.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("far")).alias("component"),
    )
    return rows.join(groups, "fp").select(key, "text_hash", "fp", "root", "component")
