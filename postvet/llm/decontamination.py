"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from postvet.llm.common import map_texts, ready

SHINGLE = 5          # words of a shingle
SIMILARITY = 0.8     # weighted-shingle similarity of a leak
# Differing bits of a candidate: at similarity 0.8 about 9.7 of 64 bits differ, with a deviation of 2.9.
RADIUS = 20
BLOCKS = 7           # parts of a fingerprint; one of them differs in RADIUS // BLOCKS bits at most
PASS_BYTES = 32 << 20
MEMO_WORDS = 1 << 18
WORD = regex.compile(r"[\p{L}\p{N}_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-case words of letters and digits: case, white space and punctuation don't count."""
    return WORD.findall((text or "").lower())


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingle_keys(words: list[str]) -> np.ndarray:
    """64-bit key of each run of SHINGLE words; fewer words: of all of them; none: empty."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * _MIX + h[k:len(words) - n + 1 + k]
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
    return total


def window_prints(keys: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of `width` shingles from each start, repeats included. Starts are ascending."""
    if not len(starts):
        return np.empty(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    step = 1 << 14
    for i in range(0, len(starts), step):
        part = starts[i:i + step]
        low, high = int(part[0]), int(part[-1]) + width
        if high - low > 8 * step:  # starts far apart: take a few at a time
            half = max(1, len(part) // 2)
            out[i:i + half] = window_prints(keys, part[:half], width)
            out[i + half:i + len(part)] = window_prints(keys, part[half:], width) if half < len(part) else 0
            continue
        bits = np.unpackbits(keys[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        inside = sums[part - low + width] - sums[part - low]
        out[i:i + len(part)] = np.packbits(inside * 2 > width, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Shingles in common over all, each weighted by how often it occurs."""
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def _shingles(words: list[str]) -> Counter:
    n = max(1, min(SHINGLE, len(words)))
    return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


@dataclass
class Index:
    """The items by window size, with a multi-index over blocks of their fingerprints."""

    ids: list
    words: list[list[str]]
    prints: np.ndarray
    by_width: dict[int, np.ndarray]
    known: np.ndarray       # sorted keys of all item shingles
    coarse: np.ndarray      # low 20 bits of these keys
    edges: list[int]
    tables: dict[int, list[tuple[np.ndarray, np.ndarray]]]   # by size and block: first place of each value, items
    held: dict[int, np.ndarray]                         # by size: sorted keys of the items' shingles
    bags: list[Counter]

    @classmethod
    def build(cls, items: list[tuple]) -> "Index":
        items = [(i, w) for i, t in items if (w := words_of(t))]
        keys = [shingle_keys(w) for _, w in items]
        prints = np.array([window_prints(k, np.zeros(1, int), len(k))[0] for k in keys], np.uint64)
        sizes = np.array([len(w) for _, w in items], int)
        by_width = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        known = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
        coarse = np.zeros(1 << 20, bool)
        coarse[(known & np.uint64((1 << 20) - 1)).astype(int)] = True
        edges = np.linspace(0, 64, BLOCKS + 1).round().astype(int).tolist()
        tables, held = {}, {}
        for width, members in by_width.items():
            tables[width] = []
            for b in range(BLOCKS):
                value = _block(prints[members], edges, b)
                order = np.argsort(value, kind="stable")
                starts = np.searchsorted(value[order], np.arange((1 << edges[b + 1] - edges[b]) + 1))
                tables[width].append((starts, members[order]))
            held[width] = np.unique(np.concatenate([keys[m] for m in members]))
        bags = [_shingles(w) for _, w in items]
        return cls(
            [i for i, _ in items], [w for _, w in items], prints, by_width, known, coarse, edges, tables, held, bags
        )

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Places of shingles that some item holds."""
        at = np.flatnonzero(self.coarse[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(at):
            where = np.minimum(np.searchsorted(self.known, keys[at]), len(self.known) - 1)
            at = at[self.known[where] == keys[at]]
        return at

    def leaks(self, text: str | None) -> list[tuple]:
        """(item, start, similarity) of the best window of each leaked item.

        Sets of m and n shingles that reach the similarity s have at least
        (m + n) s / (1 + s) in common, so only windows with so many item shingles are
        looked at; this leaves out no leak. Their fingerprints find the items. A document
        shorter than the item is one window.
        """
        words = words_of(text)
        keys = shingle_keys(words)
        hits = self.hits(keys) if len(self.known) else []
        short = {len(w) for w in self.words if len(w) < SHINGLE}
        if not len(hits) and not short:
            return []
        best: dict[int, tuple[float, int]] = {}
        for width in self.by_width:
            size = min(width, len(words))
            if size < min(width, SHINGLE):
                continue
            n = max(1, size - SHINGLE + 1)
            own = keys if width >= SHINGLE else _short_keys(words, width)
            near = hits if own is keys else np.flatnonzero(np.isin(own, self.known))
            need = _needed(n, max(1, width - SHINGLE + 1))
            if not len(near):
                continue
            listed = self.held[width]
            near = near[listed[np.minimum(np.searchsorted(listed, own[near]), len(listed) - 1)] == own[near]]
            # Somewhere `need` shingles of items of this size must lie within a window.
            if len(near) < need or (near[need - 1:] - near[:len(near) - need + 1]).min() >= n:
                continue
            held = np.zeros(len(own) + 1, np.int64)
            held[near + 1] = 1
            held = np.cumsum(held)
            starts = np.flatnonzero(held[n:] - held[:-n] >= need)
            if not len(starts):
                continue
            windows: dict[int, Counter] = {}
            for at, m in zip(*self.candidates(width, window_prints(own, starts, n))):
                start = int(starts[at])
                if start not in windows:
                    windows[start] = _shingles(words[start:start + size])
                found = similarity(windows[start], self.bags[m])
                if found >= SIMILARITY and (m not in best or found > best[m][0]):
                    best[m] = (found, start)
        return [(self.ids[m], s, f) for m, (f, s) in sorted(best.items())]

    def candidates(self, width: int, prints: np.ndarray) -> tuple[list[int], list[int]]:
        """All (window, item) of the size whose fingerprints are within RADIUS bits.

        RADIUS bits fall on BLOCKS blocks, so some block differs in few bits: each window
        looks up all values that near to its own, block by block.
        """
        met = []
        for b, (first, items) in enumerate(self.tables[width]):
            near = _near(self.edges[b + 1] - self.edges[b])
            value = (_block(prints, self.edges, b)[:, None] ^ near).ravel()
            counts = first[value + 1] - first[value]
            ends = np.cumsum(counts)
            if not ends[-1]:
                continue
            at = np.arange(ends[-1]) - np.repeat(ends - counts - first[value], counts)
            window, item = np.repeat(np.arange(len(value)) // len(near), counts), items[at]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            met.append(window[close] * len(self.ids) + item[close])
        if not met:
            return [], []
        window, item = np.divmod(np.unique(np.concatenate(met)), len(self.ids))
        return window.tolist(), item.tolist()


def _needed(m: int, n: int) -> int:
    """Shingles that sets of m and n have in common at least if they are a leak."""
    return max(1, math.ceil((m + n) * SIMILARITY / (1 + SIMILARITY) - 1e-9))


def _short_keys(words: list[str], width: int) -> np.ndarray:
    """Keys of runs of `width` words, for items of less than a shingle."""
    if width >= SHINGLE:
        return shingle_keys(words)
    return np.concatenate([shingle_keys(words[i:i + width]) for i in range(len(words) - width + 1)])


def _block(prints: np.ndarray, edges: list[int], b: int) -> np.ndarray:
    width = edges[b + 1] - edges[b]
    return (prints >> np.uint64(edges[b]) & np.uint64((1 << width) - 1)).astype(np.int64)


@cache
def _near(bits: int) -> np.ndarray:
    """All patterns of `bits` bits with at most RADIUS // BLOCKS of them set."""
    every = np.arange(1 << bits)
    return every[np.bitwise_count(every) <= RADIUS // BLOCKS]


def item_passes(benchmark: DataFrame, item: str, text: str) -> list[DataFrame]:
    """The items in parts of bounded size: the documents are read once for each part."""
    sized = benchmark.filter(F.col(text).isNotNull()).select(item, text)
    total = sized.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(total / PASS_BYTES))
    part = F.pmod(F.xxhash64(item, text), F.lit(parts))
    return [sized.filter(part == i) for i in range(parts)]


def _indexes(benchmark: DataFrame, item: str, text: str):
    for part in item_passes(benchmark, item, text):
        rows = part.distinct().orderBy(item, text).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index.build([(r[0], r[1]) for r in rows]))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(key, item, start, similarity): for each row and leaked item the best window.

    `start` is the word at which it starts. A window is as long as the item and slides
    word by word over the whole text; a shorter text is one window. Windows that hold
    enough item shingles to be a leak get a SimHash (five-word shingles, repeats counted),
    which finds every item of their size within 20 bits through a multi-index; the
    similarity of the shingle multisets, at least 0.8, decides. Only rows with a leak
    are returned. Pairs just above 0.8 can lie beyond 20 bits; README has the recall.

    Items are broadcast in parts of at most PASS_BYTES of text, one pass over the
    documents each. Items of fewer than five words are one shingle. Null texts and texts
    or items without words match nothing. Repeated rows and items are reported each
    (repeated items with one id once). Empty tables give no rows. Other columns are not
    looked at.
    """
    ready(docs.sparkSession)
    kind = benchmark.schema[item].dataType.simpleString()
    arrow = to_arrow_type(benchmark.schema[item].dataType)
    out = None
    for index in _indexes(benchmark, item, item_text):
        def work(texts, index=index):
            found = [index.value.leaks(t) for t in texts]
            return [pa.array([[x[0] for x in f] for f in found], pa.list_(arrow)),
                    pa.array([[x[1] for x in f] for f in found], pa.list_(pa.int64())),
                    pa.array([[x[2] for x in f] for f in found], pa.list_(pa.float64()))]

        made = map_texts(
            docs, [key], text, f"items array<{kind}>, starts array<bigint>, sims array<double>", work
        )
        rows = made.select(key, F.explode(F.arrays_zip("items", "starts", "sims")).alias("x")).select(
            key, F.col("x.items").alias(item), F.col("x.starts").alias("start"),
            F.col("x.sims").alias("similarity"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows, with all columns, that hold no window as similar to an item."""
    ready(docs.sparkSession)
    for index in _indexes(benchmark, item, item_text):
        docs = docs.filter(_clean(index)(F.col(text)))
    return docs


def _clean(index):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not index.value.leaks(t) for t in texts])

    return clean
