"""Brown class bigrams: exchange clustering of words, class transitions, word emissions, text scores.

The model of a token w after a token v, with classes k of v and c of w, is
`P(c | k) * P(w | c)`. Every text starts after, and ends with, a boundary token of a class
of its own. All words that were never learned from are one event, the unknown word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postvet.llm.common import Scratch, ready

SEED = 42
BOUNDARY = 0
# Tokens that a task gathers before it passes on their counts.
GATHERED = 1 << 22
# Distinct words that a task remembers before it starts anew.
WORDS_HELD = 1 << 19


@dataclass(frozen=True)
class Shape:
    """Sizes of the model, not of the corpus: what is counted always covers all of it."""

    classes: int = 128  # with the boundary's
    # Words between which classes are exchanged, the most frequent ones. All others join a class afterwards.
    core: int = 1 << 15
    # Words whose classes and counts go to all tasks, the core included; all others are joined.
    hot: int = 1 << 19
    rounds: int = 10
    # One word in so many may move in a round; the others see its move in the next one.
    turns: int = 2
    # A class that follows another is drawn towards its overall share with this weight.
    smoothing: float = 64.0


def held_out(key: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 mod 5. Null ids are learned from."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 1, F.lit(False))


# --- number lists as binary columns, which Spark moves without looking at each number

def _blobs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(values)
    ends = (np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _numbers(blobs: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all lists one after another, and the length of each list."""
    width = np.dtype(kind).itemsize
    sizes = pc.binary_length(blobs).to_numpy(zero_copy_only=False) // width
    return np.frombuffer(b"".join(blobs.to_pylist()), kind), sizes


def _longs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))


def _with_bounds(flat: np.ndarray, sizes: np.ndarray, bound) -> np.ndarray:
    """All rows one after another, with the boundary before, between and after them."""
    made = np.full(len(flat) + len(sizes) + 1, bound, flat.dtype)
    made[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = flat
    return made


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new group starts in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


# --- words

class Numbers(dict):
    """Numbers of distinct words in the order they are met, and the words' ids.

    Ids are XXH64 of A-Z lowered bytes. Two words of one 64-bit hash would count as one,
    which among 10^9 words has a chance of about 3 %.
    """

    def __init__(self):
        super().__init__()
        self.ids = np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        made = self[word] = len(self)
        return made

    def read(self, bodies: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, int]:
        """(numbers of all words, words per text, how many words were known before) of some texts."""
        before, find = len(self), self.__getitem__
        lines = []
        for body in bodies:
            words = (body or b"").lower().split()
            lines.append(np.fromiter(map(find, words), np.int64, len(words)))
        fresh, digest = islice(self, before, None), xxhash.xxh64_intdigest
        ids = np.fromiter((digest(w, SEED) for w in fresh), np.uint64, len(self) - before)
        self.ids = np.concatenate([self.ids, ids.view(np.int64)])
        sizes = np.array([len(line) for line in lines], np.int64)
        return np.concatenate(lines) if lines else np.empty(0, np.int64), sizes, before


def count_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, c): how often each word occurs in what is learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts = Numbers(), np.empty(0, np.int64)
        for batch in batches:
            flat, _, before = numbers.read(batch.column(0).to_pylist())
            counts = np.bincount(flat, minlength=len(numbers)) + np.append(counts, np.zeros(len(numbers) - before, np.int64))
            if len(numbers) > WORDS_HELD:
                yield pa.RecordBatch.from_arrays([pa.array(numbers.ids), pa.array(counts)], ["id", "c"])
                numbers, counts = Numbers(), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(numbers.ids), pa.array(counts)], ["id", "c"])

    return (
        docs.filter(~held_out(F.col(key))).select(F.col(text).cast("binary")).mapInArrow(run, "id long, c long")
        .groupBy("id").agg(F.sum("c").alias("c"))
    )


def _fitting(bins: list[tuple[int, int]], room: int) -> tuple[int | None, int]:
    """(first value whose rows don't fit any more, room left for it) of (value, rows) in order."""
    for value, n in bins:
        if n > room:
            return value, room
        room -= n
    return None, room


def most_frequent(words: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, Column]:
    """(ids, counts, condition) of at most `size` words, the most frequent ones, ties by id.

    Three histograms of bounded size (of steps of the count, of the counts in one step, of
    the leading bits of the ids of one count) tell where to cut, so nothing is sorted. Where
    the last bits of the ids would have to decide, some words fewer are taken.
    """
    step, lead = F.floor(F.log2("c") * 16).cast("int"), F.shiftright("id", 52)

    def bins(rows: DataFrame, by: Column) -> list[tuple[int, int]]:
        return sorted((r[0], r[1]) for r in rows.groupBy(by.alias("v")).count().collect())

    condition = F.lit(True)
    last, room = _fitting(bins(words, step)[::-1], size)
    if last is not None:
        least, room = _fitting(bins(words.filter(step == last), F.col("c"))[::-1], room)
        cut, _ = _fitting(bins(words.filter(F.col("c") == least), lead), room)
        condition = (F.col("c") > least) | ((F.col("c") == least) & (lead < cut))
    rows = words.filter(condition).select("id", "c").toArrow()
    ids, counts = rows["id"].to_numpy(), rows["c"].to_numpy()
    order = np.lexsort([ids, -counts])
    return ids[order], counts[order], condition


def encode(docs: DataFrame, key: str, text: str, ids: np.ndarray) -> DataFrame:
    """(row, key, held_out, codes, others): ranks of the hot words, or -1 - j for the row's j-th other word.

    `codes` are 32-bit and `others`, distinct in the row, 64-bit numbers. `row` tells rows
    apart; it is written with the rest, so it stays the same.
    """
    kind = docs.schema[key].dataType.simpleString()
    order = np.argsort(ids)
    shared = docs.sparkSession.sparkContext.broadcast((ids[order], order.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        numbers, ranks = Numbers(), np.empty(0, np.int32)
        for batch in batches:
            if len(numbers) > WORDS_HELD:
                numbers, ranks = Numbers(), np.empty(0, np.int32)
            flat, sizes, before = numbers.read(batch.column(3).to_pylist())
            words, fresh = numbers.ids, numbers.ids[before:]
            # Each distinct word is looked up once.
            more = np.full(len(fresh), -1, np.int32)
            if len(known):
                at = np.minimum(np.searchsorted(known, fresh), len(known) - 1)
                more = np.where(known[at] == fresh, rank[at], -1).astype(np.int32)
            ranks = np.append(ranks, more)
            codes = ranks[flat]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            outside = np.flatnonzero(codes < 0)
            sort = np.lexsort([flat[outside], owner[outside]])
            o, w = owner[outside][sort], flat[outside][sort]
            new = _runs(o, w)
            counts = np.bincount(o[new], minlength=len(sizes))
            codes[outside[sort]] = -1 - (np.cumsum(new) - 1 - (np.cumsum(counts) - counts)[o])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], _blobs(codes, sizes), _blobs(words[w[new]], counts)],
                ["row", key, "held_out", "codes", "others"],
            )

    return docs.select(
        F.monotonically_increasing_id().alias("row"), key, held_out(F.col(key)).alias("held_out"),
        F.col(text).cast("binary").alias("body"),
    ).mapInArrow(run, f"row long, `{key}` {kind}, held_out boolean, codes binary, others binary")


def _gathered(batches, columns: Callable, give: Callable) -> Iterator[pa.RecordBatch]:
    """Batches of counts: what `columns` makes of each batch, some millions of entries at once."""
    held, size = [], 0
    for batch in batches:
        held.append(columns(batch))
        size += len(held[-1][0])
        if size >= GATHERED:
            yield give(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield give(*map(np.concatenate, zip(*held)))


def core_pairs(coded: DataFrame, core: int) -> DataFrame:
    """(a, b, n): how often core word b follows core word a in what is learned from; `core`: the boundary."""

    def columns(batch):
        flat, sizes = _numbers(batch.column(0), np.int32)
        line = _with_bounds(np.where(flat < core, flat, -1).astype(np.int64), sizes, core)
        inside = line >= 0
        met = inside[:-1] & inside[1:]
        return (line[:-1][met] * (core + 1) + line[1:][met],)

    def give(pairs):
        found, n = np.unique(pairs, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], ["pair", "n"])

    counted = (
        coded.filter("NOT held_out").select("codes")
        .mapInArrow(lambda batches: _gathered(batches, columns, give), "pair long, n long")
        .groupBy("pair").agg(F.sum("n").alias("n"))
    )
    return counted.select(
        F.expr(f"pair div {core + 1}").cast("int").alias("a"), F.pmod("pair", F.lit(core + 1)).cast("int").alias("b"), "n"
    )


def neighbour_lists(pairs: DataFrame) -> DataFrame:
    """One row per core word: (word, others, ns), at most two entries per core word.

    An entry o >= 0 follows the word n times, -1 - o comes before it. All a word's move
    depends on is in its row, so the rounds of exchange need no shuffle.
    """
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), "n").union(
        pairs.select("b", -1 - F.col("a"), "n")
    )

    def give(word, other, n):
        new = _runs(word)
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(word)))
        return pa.RecordBatch.from_arrays(
            [pa.array(word[new], pa.int32()), _blobs(other, sizes), _blobs(n, sizes)], ["word", "others", "ns"]
        )

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy() for c in batch.columns]
            now = now if rest is None else [np.concatenate(c) for c in zip(rest, now)]
            # The last word may go on in the next batch.
            cut = int(np.flatnonzero(_runs(now[0]))[-1])
            rest = [c[cut:] for c in now]
            if cut:
                yield give(*(c[:cut] for c in now))
        if rest is not None:
            yield give(*rest)

    return both.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word int, others binary, ns binary")


# --- exchange

def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


class Board:
    """Counts of class after class, and what an exchange gains on them."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.turned = matrix, np.ascontiguousarray(matrix.T)
        self.worth = _xlogx(matrix)
        self.turned_worth = np.ascontiguousarray(self.worth.T)
        self.rows, self.cols = matrix.sum(1), matrix.sum(0)

    def likelihood(self) -> float:
        """The part of the log likelihood of the corpus that depends on the classes."""
        return float(self.worth.sum() - _xlogx(self.rows).sum() - _xlogx(self.cols).sum())

    def _side(self, matrix, worth, at, own, mine, others, self_n):
        """Gain of the cells [at, class] of each class; `mine` lies in the column of `own`, `others` in its row."""
        cells, value, mine = matrix[at], worth[at], mine[at]
        cells[:, own] -= mine
        j = np.searchsorted(at, own)
        if j < len(at) and at[j] == own:
            cells[j] -= others
            cells[j, own] -= self_n
            value[j] = _xlogx(cells[j])
        value[:, own] = _xlogx(cells[:, own])
        cells += mine[:, None]
        gain = np.maximum(cells, 1.0)
        np.log(gain, out=gain)
        gain *= cells
        gain -= value
        total = gain.sum(0)
        # Where a class meets itself both sides come together; that cell is counted apart.
        total[at] -= gain[np.arange(len(at)), at]
        return total

    def gains(self, own: int, right: np.ndarray, left: np.ndarray, self_n: float) -> np.ndarray:
        """What the likelihood gains if a word leaves class `own` and joins each class.

        `right` and `left` count the classes of its neighbours but for itself, `self_n` counts
        how often it follows itself. The boundary's class can't be joined.
        """
        gain = self._side(self.turned, self.turned_worth, np.flatnonzero(right), own, right, left, self_n)
        gain += self._side(self.matrix, self.worth, np.flatnonzero(left), own, left, right, self_n)
        diagonal = self.matrix.diagonal().copy()
        diagonal[own] -= right[own] + left[own] + self_n
        gain += _xlogx(diagonal + right + left + self_n) - _xlogx(diagonal)
        # Its neighbours stay, so in the margins only its own places move.
        for sums, moved in ((self.rows, right.sum() + self_n), (self.cols, left.sum() + self_n)):
            sums = sums.copy()
            sums[own] -= moved
            gain -= _xlogx(sums + moved) - _xlogx(sums)
        gain[BOUNDARY] = -np.inf
        return gain


def _matrix_of(df: DataFrame, cells: Callable, size: int) -> np.ndarray:
    """Sum of the size x size counts that `cells` makes of each batch; only these come to the driver."""

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            at, n = cells(batch)
            total += np.bincount(at, minlength=size * size) if n is None else (
                np.bincount(at, weights=n, minlength=size * size).astype(np.int64)
            )
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["cell", "n"])

    matrix = np.zeros(size * size)
    for r in df.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        matrix[r["cell"]] = r["n"]
    return matrix.reshape(size, size)


def class_pairs(lists: DataFrame, classes: np.ndarray, size: int) -> np.ndarray:
    """Counts of class after class between core words."""
    shared = lists.sparkSession.sparkContext.broadcast(classes)

    def cells(batch):
        others, sizes = _numbers(batch.column(1), np.int32)
        after = others >= 0
        own = shared.value[np.repeat(batch.column(0).to_numpy(), sizes)][after]
        return own * size + shared.value[others[after]], _numbers(batch.column(2), np.int64)[0][after]

    return _matrix_of(lists.select("word", "others", "ns"), cells, size)


def best_moves(lists: DataFrame, classes: np.ndarray, matrix: np.ndarray, turns: int, turn: int) -> np.ndarray:
    """(word, class) of the words whose turn it is and whose exchange gains most."""
    core, size = len(classes) - 1, len(matrix)
    shared = lists.sparkSession.sparkContext.broadcast((classes, matrix))

    def run(batches):
        classes, matrix = shared.value
        board = Board(matrix)
        for batch in batches:
            words, moved = [], []
            for word, others, ns in zip(*(c.to_pylist() for c in batch.columns)):
                others, ns = np.frombuffer(others, np.int32), np.frombuffer(ns, np.int64).astype(float)
                after = others >= 0
                other = np.where(after, others, -1 - others)
                own, rest = int(classes[word]), other != word
                count = [
                    np.bincount(classes[other[side]], weights=ns[side], minlength=size) for side in (rest & after, rest & ~after)
                ]
                gain = board.gains(own, *count, float(ns[~rest & after].sum()))
                # Equal gains go to the lowest class, whatever the last bits say.
                best = int(gain.round(6).argmax())
                if gain[best] > gain[own] + 1e-6:
                    words.append(word)
                    moved.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(moved, pa.int32())], ["word", "class"])

    mine = lists.filter((F.col("word") < core) & (F.pmod(F.xxhash64("word"), F.lit(turns)) == turn))
    # Each core word moves at most once, so what comes back is bounded by the core.
    return mine.select("word", "others", "ns").mapInArrow(run, "word int, class int").toPandas().to_numpy(np.int64)


def exchange(lists: DataFrame, core: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(classes, matrix): class of each core word, the boundary last, and counts of class after class.

    Words start dealt by rank over the classes. In each round every word whose turn it is
    moves to the class where the likelihood of the corpus gains most, as the classes were
    at the start of the round; so the result does not depend on how rows are dealt over
    tasks. A round that lowers the likelihood is taken back for half of its words.
    """
    classes = np.append(1 + np.arange(core) % (shape.classes - 1), BOUNDARY).astype(np.int64)
    matrix = class_pairs(lists, classes, shape.classes)
    now = Board(matrix).likelihood()
    for turn in range(shape.rounds):
        moves = best_moves(lists, classes, matrix, shape.turns, turn % shape.turns)
        moves = moves[np.argsort(moves[:, 0])]
        while len(moves):
            tried = classes.copy()
            tried[moves[:, 0]] = moves[:, 1]
            made = class_pairs(lists, tried, shape.classes)
            value = Board(made).likelihood()
            if value >= now:
                classes, matrix, now = tried, made, value
                break
            moves = moves[::2] if len(moves) > 1 else moves[:0]
    return classes, matrix


# --- the words outside the core

def other_classes(coded: DataFrame, ids: np.ndarray, classes: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """(id, class) for each learned word outside the core that has a core neighbour.

    Such a word joins the class where the likelihood gains most, to first order in its
    counts; ties go to the lowest class.
    """
    core, size = len(classes) - 1, len(matrix)
    eps = 0.5
    follow = np.log((matrix + eps) / (matrix.sum(1, keepdims=True) + eps * size))  # [own, right]
    precede = np.log((matrix + eps) / (matrix.sum(0, keepdims=True) + eps * size))  # [left, own]
    worth = np.concatenate([precede, follow.T])  # [context, own]
    worth[:, BOUNDARY] = -np.inf
    shared = coded.sparkSession.sparkContext.broadcast((classes, ids, worth))

    def columns(batch):
        classes, ids, _ = shared.value
        flat, sizes = _numbers(batch.column(0), np.int32)
        others, counts = _numbers(batch.column(1), np.int64)
        if not len(ids):
            ids = np.zeros(1, np.int64)
        place = np.repeat(np.cumsum(counts) - counts, sizes) - 1 - flat
        if len(others):
            word = np.where(flat >= 0, ids[np.maximum(flat, 0)], others[np.where(flat < 0, place, 0)])
        else:
            word = ids[np.maximum(flat, 0)]
        # Classes of core words and boundaries; -1 for all others, whose ids are in `word`.
        line = _with_bounds(np.where((flat >= 0) & (flat < core), classes[np.clip(flat, 0, core)], -1), sizes, BOUNDARY)
        word = _with_bounds(word, sizes, 0)
        held = []
        for here, there, shift in ((slice(1, None), slice(None, -1), 0), (slice(None, -1), slice(1, None), size)):
            met = (line[here] < 0) & (line[there] >= 0)
            held.append((word[here][met], line[there][met] + shift))
        return tuple(np.concatenate(c) for c in zip(*held))

    def give(word, ctx):
        order = np.lexsort([ctx, word])
        word, ctx = word[order], ctx[order]
        new = _runs(word, ctx)
        n = np.diff(np.append(np.flatnonzero(new), len(word)))
        return pa.RecordBatch.from_arrays(
            [pa.array(word[new]), pa.array(ctx[new], pa.int32()), pa.array(n, pa.int64())], ["id", "ctx", "n"]
        )

    def join(batches):
        worth = shared.value[2]
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
            ctx, n = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            # Each row has entries, so the sums by row are those between starts.
            total = np.add.reduceat(worth[ctx] * n[:, None], np.concatenate([[0], ends[:-1]]), axis=0) if len(ctx) else np.empty((0, size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total.round(6).argmax(1), pa.int32())], ["id", "class"]
            )

    counted = (
        coded.filter("NOT held_out").select("codes", "others")
        .mapInArrow(lambda batches: _gathered(batches, columns, give), "id long, ctx int, n long")
        # No word outside the core is frequent among all, so one exchange by word serves both steps.
        .repartition("id").groupBy("id", "ctx").agg(F.sum("n").alias("n"))
        .groupBy("id").agg(F.collect_list(F.struct("ctx", "n")).alias("e"))
    )
    return counted.select("id", "e.ctx", "e.n").mapInArrow(join, "id long, class int")


# --- the model

@dataclass
class ClassModel:
    """Emissions of words and probabilities of classes after classes."""

    counts: np.ndarray  # of the hot words
    classes: np.ndarray
    totals: np.ndarray  # tokens of each class
    kinds: np.ndarray  # learned words of each class
    train_tokens: int
    distinct: int
    discount: float
    texts: int

    def emission(self, counts, classes):
        """log10 P(word | class) of learned words: each gives `discount` to the unknown word."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log10((counts - self.discount) / self.totals[classes])

    def base(self, counts):
        return np.log10((counts + 0.5) / (self.train_tokens + 0.5 * (self.distinct + 1)))

    def unknown_share(self) -> np.ndarray:
        """P(unknown word | class)."""
        return self.discount * self.kinds / np.maximum(self.totals, 1)

    def transitions(self, pairs: np.ndarray, smoothing: float) -> np.ndarray:
        """P(class or unknown word | class or unknown word), with the unknown word last.

        Columns are classes, in which words the emission counts, and the unknown word as one
        event: rows sum to more than 1 by the unknown column, which the emissions leave free.
        """
        overall = self.totals / max(1, self.totals.sum())
        after = (pairs + smoothing * overall) / (pairs.sum(1, keepdims=True) + smoothing)
        share = self.kinds / max(1, self.kinds.sum())
        after = np.concatenate([after, (share @ after)[None]])
        return np.concatenate([after, (after @ self.unknown_share())[:, None]], axis=1)


def split_rows(coded: DataFrame, key: str, model: ClassModel) -> DataFrame:
    """Each row's part that the hot words settle, and what has to be joined for the rest.

    (row, key, held_out, n_tokens, n_known, base, emission, line, ids, contexts, ns, firsts, seconds):
    `line` holds classes, -1 for words that are not hot. `ids` are these words, distinct,
    `ns` how often each occurs, and `contexts` the classes next to it: k before it, or
    size + c after it. `firsts` and
    `seconds` are such words that stand side by side.
    """
    kind = coded.schema[key].dataType.simpleString()
    size = len(model.totals)
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        classes = np.append(model.classes, -1).astype(np.int16)
        emission = np.append(model.emission(model.counts, model.classes), 0.0)
        base = np.append(model.base(model.counts), 0.0)
        end = model.base(np.array([float(model.texts)]))[0]
        for batch in batches:
            flat, sizes = _numbers(batch.column(3), np.int32)
            others, counts = _numbers(batch.column(4), np.int64)
            rows = len(sizes)
            code = np.where(flat < 0, len(model.classes), flat)
            owner = np.repeat(np.arange(rows), sizes)
            first = np.cumsum(counts) - counts
            line = classes[code]
            full = _with_bounds(line, sizes, BOUNDARY)
            place = _with_bounds(np.where(flat < 0, np.repeat(first, sizes) - 1 - flat, -1), sizes, -1)
            met = []
            for here, there, shift in ((slice(1, None), slice(None, -1), 0), (slice(None, -1), slice(1, None), size)):
                at = (place[here] >= 0) & (place[there] < 0)
                met.append((place[here][at], full[there][at] + shift))
            who, context = (np.concatenate(c) for c in zip(*met))
            sort = np.argsort(who, kind="stable")
            beside = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0))
            pairs = np.bincount(np.repeat(np.arange(rows), counts)[place[beside]], minlength=rows) if len(beside) else np.zeros(rows, int)
            words = _blobs(context[sort].astype(np.int16), np.bincount(who, minlength=len(others)))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            sums = [np.bincount(owner, weights=v[code], minlength=rows) for v in (base, emission)]
            known = np.bincount(owner, weights=flat >= 0, minlength=rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array(sizes + 1, pa.int64()), pa.array(known + (model.texts > 0)),
                pa.array(sums[0] + end), pa.array(sums[1].astype(float)), _blobs(line, sizes), _longs(others, counts),
                pa.ListArray.from_arrays(pa.array(ends), words),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.bincount(place[place >= 0], minlength=len(others)))),
                _longs(others[place[beside]] if len(beside) else others[:0], pairs),
                _longs(others[place[beside + 1]] if len(beside) else others[:0], pairs),
            ], [n.split()[0].strip("`") for n in schema.split(", ")])

    schema = (
        f"row long, `{key}` {kind}, held_out boolean, n_tokens long, n_known long, base double, emission double, "
        "line binary, ids array<bigint>, contexts array<binary>, ns array<bigint>, firsts array<bigint>, seconds array<bigint>"
    )
    return coded.select("row", key, "held_out", "codes", "others").mapInArrow(run, schema)


def joined_words(parts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(row, held_out, contexts, n, class, c) of the words that are not hot; class -1 if unknown."""
    met = parts.select("row", "held_out", F.explode(F.arrays_zip("ids", "contexts", "ns")).alias("e")).select(
        "row", "held_out", F.col("e.ids").alias("id"), F.col("e.contexts").alias("contexts"), F.col("e.ns").alias("n")
    )
    return met.join(lexicon, "id", "left").select(
        "row", "held_out", "contexts", "n", F.coalesce("class", F.lit(-1)).alias("class"), F.coalesce("c", F.lit(0)).alias("c")
    )


def joined_pairs(parts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(row, held_out, before, after): classes of two words side by side that are not hot; -1 if unknown."""
    met = parts.select("row", "held_out", F.explode(F.arrays_zip("firsts", "seconds")).alias("e"))
    named = met.select("row", "held_out", F.col("e.firsts").alias("first"), F.col("e.seconds").alias("second"))
    one = lexicon.select(F.col("id").alias("first"), F.col("class").alias("before"))
    two = lexicon.select(F.col("id").alias("second"), F.col("class").alias("after"))
    return named.join(one, "first", "left").join(two, "second", "left").select(
        "row", "held_out", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("after", F.lit(-1)).alias("after")
    )


def _contexts(batch, at: int, own: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, class before, class after, whether the first is the word's own) of each context."""
    context, sizes = _numbers(batch.column(at), np.int16)
    mine = np.repeat(batch.column(own).to_numpy().astype(np.int64), sizes)
    context = context.astype(np.int64)
    leads = context >= size
    return (np.repeat(np.arange(batch.num_rows), sizes), np.where(leads, mine, context), np.where(leads, context - size, mine), leads)


def all_pairs(parts: DataFrame, words: DataFrame, pairs: DataFrame, size: int) -> np.ndarray:
    """Counts of class after class over all that is learned from."""

    def lines(batch):
        line = _with_bounds(*_numbers(batch.column(0), np.int16), BOUNDARY).astype(np.int64)
        both = (line[:-1] >= 0) & (line[1:] >= 0)
        return line[:-1][both] * size + line[1:][both], None

    def contexts(batch):
        _, before, after, _ = _contexts(batch, 0, 1, size)
        return before * size + after, None

    learned = "NOT held_out"
    total = _matrix_of(parts.filter(learned).select("line"), lines, size)
    total += _matrix_of(words.filter(learned).select("contexts", "class"), contexts, size)
    for r in pairs.filter(learned).groupBy("before", "after").count().collect():
        total[r["before"], r["after"]] += r["count"]
    return total


def scored_rows(parts: DataFrame, words: DataFrame, pairs: DataFrame, key: str, model: ClassModel, logs: np.ndarray) -> DataFrame:
    """The result of `score_texts` from its parts and log10 of the transitions."""
    size = len(model.totals)
    shared = parts.sparkSession.sparkContext.broadcast((model, logs))

    def of_words(batches):
        model, logs = shared.value
        unseen = model.base(np.zeros(1))[0]
        for batch in batches:
            kinds, counts = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
            ns = batch.column(4).to_numpy()
            owner, before, after, _ = _contexts(batch, 1, 2, size)
            steps = np.bincount(owner, weights=logs[before, after], minlength=batch.num_rows)
            known = kinds >= 0
            emission = np.zeros(batch.num_rows)
            emission[known] = model.emission(counts[known], kinds[known])
            base = np.where(known, model.base(counts), unseen)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.where(known, ns, 0).astype(np.int64)), pa.array(base * ns),
                pa.array(steps + emission * ns),
            ], ["row", "n_known", "base", "score"])

    def of_pairs(batches):
        logs = shared.value[1]
        for batch in batches:
            steps = logs[batch.column(1).to_numpy(), batch.column(2).to_numpy()]
            zero = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(steps.astype(float))],
                ["row", "n_known", "base", "score"],
            )

    def of_lines(batches):
        logs = shared.value[1]
        for batch in batches:
            flat, sizes = _numbers(batch.column(1), np.int16)
            line = _with_bounds(flat, sizes, BOUNDARY)
            both = (line[:-1] >= 0) & (line[1:] >= 0)
            owner = np.repeat(np.arange(batch.num_rows), sizes + 1)
            steps = np.bincount(owner[both], weights=logs[line[:-1][both], line[1:][both]], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:1], *batch.columns[2:7], pa.array(steps + batch.column(7).to_numpy())],
                ["row", key, "held_out", "n_tokens", "n_known", "base", "score"],
            )

    part = "row long, n_known long, base double, score double"
    kind = parts.schema[key].dataType.simpleString()
    added = (
        words.select("row", "contexts", "class", "c", "n").mapInArrow(of_words, part)
        .union(pairs.select("row", "before", "after").mapInArrow(of_pairs, part))
        .groupBy("row").agg(*(F.sum(c).alias(f"more_{c}") for c in ("n_known", "base", "score")))
    )
    settled = parts.select("row", "line", key, "held_out", "n_tokens", "n_known", "base", "emission").mapInArrow(
        of_lines, f"row long, `{key}` {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
    )

    def whole(column: str) -> Column:
        return F.col(column) + F.coalesce(f"more_{column}", F.lit(0))

    return settled.join(added, "row", "left").select(
        key, "held_out", "n_tokens", whole("n_known").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        whole("base").alias("base_score"), whole("score").alias("score"),
    )


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from all rows whose `held_out` is false, then scores all rows. `score` is the
    log10 probability of the whole text with its end under the class model, `base_score`
    the one under smoothed word counts; perplexity is `10 ** (-score / n_tokens)`. Both
    spread their probability over the learned words and one unknown word.

    1. Words are counted. The most frequent `shape.core` ones get classes by exchange: in
       rounds each moves to the class where the corpus gets most likely. All other learned
       words then join the class that fits their neighbours best.
    2. P(class | class) counts all learned tokens, smoothed by the classes' shares.
       P(word | class) = (c - d) / N(class); d = n1 / (n1 + 2 n2) of each word's count goes
       to the unknown word. After an unknown word, classes count by their share of d.
    3. A text's score is a sum over its tokens. The part of the `shape.hot` most frequent
       words is summed where the text lies; the other words are joined, each with the
       classes beside it, and their parts are summed by row. Texts are not shuffled.

    Nulls, empty and blank texts are the end token alone. A null id is learned from.
    Repeated rows count as often as they come and are scored each. Where nothing is learned
    from, both scores are 0. Other columns are not looked at. What reaches the driver: the
    hot words with their classes, and tables of classes by classes, all of fixed size.
    """
    spark = ready(docs.sparkSession)
    with Scratch(spark) as scratch:
        words = scratch.stored(count_words(docs, key, text), "words")
        texts = docs.filter(~held_out(F.col(key))).count()
        stats = words.agg(
            F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
            F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"),
        ).first()
        ids, counts, is_hot = most_frequent(words, max(shape.hot, shape.core))
        core = min(shape.core, len(ids))
        coded = scratch.stored(encode(docs, key, text, ids), "coded")
        lists = scratch.stored(neighbour_lists(core_pairs(coded, core)), "lists")
        classes, matrix = exchange(lists, core, shape)
        scratch.drop("lists")

        outside = words
        if core:
            last, least = int(ids[core - 1]), int(counts[core - 1])
            outside = words.filter(~is_hot | (F.col("c") < least) | ((F.col("c") == least) & (F.col("id") > last)))
        lexicon = scratch.stored(
            outside.join(other_classes(coded, ids, classes, matrix), "id", "left")
            .select("id", "c", F.coalesce("class", F.lit(1)).alias("class")), "lexicon"
        )
        totals = np.bincount(classes[:core], weights=counts[:core], minlength=shape.classes)
        kinds = np.bincount(classes[:core], minlength=shape.classes).astype(float)
        for r in lexicon.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
            totals[r["class"]] += r["c"]
            kinds[r["class"]] += r["v"]
        totals[BOUNDARY] = texts
        # Classes of the hot words outside the core.
        hot = np.append(classes[:core], np.ones(len(ids) - core, np.int64))
        found, cold = lexicon.filter(is_hot).select("id", "class").toArrow(), lexicon.filter(~is_hot)
        if len(found):
            order = np.argsort(ids)
            hot[order[np.searchsorted(ids[order], found["id"].to_numpy())]] = found["class"].to_numpy()
        model = ClassModel(
            counts, hot, totals, kinds, stats["n"] + texts, stats["v"] + (texts > 0),
            stats["n1"] / (stats["n1"] + 2 * stats["n2"]) if stats["n1"] and stats["n2"] else 0.5, texts,
        )
        parts = scratch.stored(split_rows(coded, key, model), "parts")
        scratch.drop("coded")
        met = scratch.stored(joined_words(parts, cold), "met")
        pairs = scratch.stored(joined_pairs(parts, cold), "pairs")
        after = model.transitions(all_pairs(parts, met, pairs, shape.classes), shape.smoothing)
        with np.errstate(divide="ignore"):
            logs = np.log10(after) if model.train_tokens else np.zeros_like(after)
        return scratch.keep(scored_rows(parts, met, pairs, key, model, logs))
