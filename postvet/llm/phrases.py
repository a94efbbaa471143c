"""Phrases of two and three words that belong together, grown best first under admissible bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postvet.llm.common import Scratch, ready

SEED = 42
UNKNOWN = "und"
SCORE_SCALE = 1_000_000
# Words end at these; 0xFF occurs in no UTF-8 text, so it can mark the end of a piece.
BREAK = b"\xff"
FOLDED = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10
)
# Tokens a task gathers before it passes on what it counted.
GATHERED = 1 << 21
# Bits of a broadcast filter: 8 MB whatever it stands for. Full filters let more through, no less.
FILTER_BITS = 26
# In the first round so many times the wanted phrases of a language are contenders.
FIRST = 3


# --- filters of fixed size, with the same hash on both sides

def _turned(h: Column) -> Column:
    return F.shiftleft(h, 21).bitwiseOR(F.shiftrightunsigned(h, 43))


def _place(lang: str, *words: str) -> Column:
    """Place in a filter of a language's word or word pair."""
    z = F.xxhash64(lang)
    for i, word in enumerate(reversed(words)):
        h = F.xxhash64(word)
        z = z.bitwiseXOR(_turned(h) if i else h)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 32)).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def _places(lang: np.uint64, first: np.ndarray | None, last: np.ndarray) -> np.ndarray:
    """The same in a task, from hashes."""
    z = lang ^ last
    if first is not None:
        z = z ^ ((first << np.uint64(21)) | (first >> np.uint64(43)))
    return ((z ^ (z >> np.uint64(32))) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def bit_filter(rows: DataFrame, *words: str) -> np.ndarray:
    """Bits of all (lang, words..) in `rows`: what is in it is found, a few others as well."""
    at = _place("lang", *words) + 1
    parts = (
        rows.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("at"))
        .groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    )
    made = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts:
        start = (r["part"] - 1) * len(r["bits"])
        made[start:start + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return made


def _holds(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


# --- counting

class Numbers(dict):
    """Numbers of distinct words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        made = self[word] = len(self)
        return made


class Gathered:
    """Words of many texts as numbers, by language; 0 ends a piece."""

    def __init__(self):
        self.number = Numbers({BREAK: 0})
        self.lines: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str | None, body: bytes | None) -> None:
        words = (body or b"").translate(FOLDED).replace(BREAK, b" \xff ").split()
        words.append(BREAK)
        line = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.lines.setdefault(UNKNOWN if lang is None else lang, []).append(line)
        self.size += len(line)

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in self.number), np.uint64, len(self.number))


def _counted(
    docs: DataFrame, lang: str, text: str, names: list[str],
    count: Callable[[Gathered, str, np.ndarray], tuple[list[np.ndarray], np.ndarray]],
) -> DataFrame:
    """(lang, names.., n): sums of what `count` finds, as numbers of words and counts, in a language's line.

    A task gathers many texts before it passes on counts, so frequent phrases are folded
    before the shuffle.
    """
    columns = ["lang", *names, "n"]

    def give(held: Gathered) -> Iterator[pa.RecordBatch]:
        # What ends a piece is no text and no word.
        words = pa.array([b"", *list(held.number)[1:]], pa.binary()).cast(pa.string())
        for name, lines in held.lines.items():
            found, n = count(held, name, np.concatenate(lines))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.string()).take(pa.array(np.zeros(len(n), np.int64))),
                 *(words.take(pa.array(f)) for f in found), pa.array(n.astype(np.int64))], columns,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.add(name, body)
                if held.size >= GATHERED:
                    yield from give(held)
                    held = Gathered()
        yield from give(held)

    schema = ", ".join(["lang string", *(f"{n} string" for n in names), "n long"])
    return (
        docs.select(F.col(lang).cast("string"), F.col(text).cast("binary")).mapInArrow(run, schema)
        .groupBy("lang", *names).agg(F.sum("n").alias("n"))
    )


def count_words(docs: DataFrame, lang: str, text: str) -> DataFrame:
    def count(held, name, line):
        n = np.bincount(line, minlength=len(held.number))
        n[0] = 0
        at = np.flatnonzero(n)
        return [at], n[at]

    return _counted(docs, lang, text, ["w1"], count)


def _language(name: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(name.encode(), SEED))


def count_pairs(docs: DataFrame, lang: str, text: str, frequent: np.ndarray) -> DataFrame:
    """Word pairs within pieces, both words in the filter: a phrase is no more frequent than its words."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def count(held, name, line):
        known = _holds(shared.value, _places(_language(name), None, held.hashes()))
        known[0] = False
        met = known[line[:-1]] & known[line[1:]]
        width = len(held.number)
        pairs, n = np.unique(line[:-1][met] * width + line[1:][met], return_counts=True)
        return [pairs // width, pairs % width], n

    return _counted(docs, lang, text, ["w1", "w2"], count)


def count_triples(docs: DataFrame, lang: str, text: str, prefixes: np.ndarray) -> DataFrame:
    """Runs of three words within pieces that start with a pair in the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(prefixes)

    def count(held, name, line):
        hashes = held.hashes()
        at = np.flatnonzero((line[:-2] > 0) & (line[1:-1] > 0) & (line[2:] > 0)) if len(line) > 2 else np.empty(0, np.int64)
        at = at[_holds(shared.value, _places(_language(name), hashes[line[at]], hashes[line[at + 1]]))]
        # Two steps, so that numbers of three words fit into 64 bits.
        width = len(held.number)
        pairs, pair = np.unique(line[at] * width + line[at + 1], return_inverse=True)
        triples, n = np.unique(pair * width + line[at + 2], return_counts=True)
        head = pairs[triples // width]
        return [head // width, head % width, triples % width], n

    return _counted(docs, lang, text, ["w1", "w2", "w3"], count)


# --- scores

def _score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a a / (l r)), exact: 38 digits hold counts of up to 10^16."""
    wide = "decimal(38,0)"
    return F.expr(f"(cast({a} as {wide}) * {a} * {SCORE_SCALE}) div (cast({left} as {wide}) * {right})")


def _scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, w1, w2, a, f1, f2, score, bound); no run that starts with the pair scores over `bound`.

    Cut after its first word such a run of count t gives t t / (f1 r) with r >= t, and t is
    at most a. So t t / (f1 r) <= a / f1.
    """
    first, second = words.toDF("lang", "w1", "f1"), words.toDF("lang", "w2", "f2")
    return (
        pairs.withColumnRenamed("n", "a").join(first, ["lang", "w1"]).join(second, ["lang", "w2"])
        .select("lang", "w1", "w2", "a", "f1", "f2", _score("a", "f1", "f2").alias("score"),
                F.expr(f"(cast(a as decimal(38,0)) * {SCORE_SCALE}) div f1").alias("bound"))
    )


def _scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, w1, w2, w3, a, l, r, score) by the lowest cut, ties to the earlier one."""
    head = pairs.select("lang", "w1", "w2", F.col("a").alias("a12"), "f1")
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"), F.col("f2").alias("f3"))
    return (
        triples.withColumnRenamed("n", "a").join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
        .withColumn("cut", F.least(
            F.struct(_score("a", "f1", "a23").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("a23").alias("r")),
            F.struct(_score("a", "a12", "f3").alias("score"), F.lit(2).alias("k"), F.col("a12").alias("l"), F.col("f3").alias("r")),
        ))
        .select("lang", "w1", "w2", "w3", "a", "cut.l", "cut.r", "cut.score")
    )


# --- growth

def _cuts(pairs: DataFrame, wanted: int) -> DataFrame:
    """(lang, cut): a score that at least `wanted` pairs reach, or 0 where there are fewer.

    Scores are counted in some 640 steps of their logarithm, so no task gets all pairs of
    a language; the cut is the least score of the step that completes the number.
    """
    step = F.floor(F.log2(F.col("score") + 1) * 32).cast("int")
    steps = pairs.groupBy("lang", step.alias("step")).agg(F.count("*").alias("k"), F.min("score").alias("low"))
    so_far = F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    return steps.withColumn("reach", so_far).groupBy("lang").agg(
        F.coalesce(F.max(F.when(F.col("reach") >= wanted, F.col("low"))), F.lit(0)).alias("cut")
    )


def _frontier(pairs: DataFrame, cuts: DataFrame) -> DataFrame:
    """(lang, w1, w2): pairs to expand so that everything from a language's `cut` on is settled.

    1. Pairs whose bound reaches the cut: any other pair starts no run that scores so high.
       A pair's own score is at most its bound, so the contenders are among them.
    2. Pairs (x, w1) before a contender (w1, w2), if they are at least half as frequent as
       the contender: only these can start a run that drops it. As a contender is
       frequent among the runs that start with w1, each has few of them.
    """
    at = pairs.join(cuts.select("lang", "cut"), "lang")
    weakest = at.filter("score >= cut").groupBy("lang", "w1").agg(F.min("a").alias("weakest"))
    before = (
        pairs.join(weakest.withColumnRenamed("w1", "w2"), ["lang", "w2"])
        .filter(F.col("a") * 2 >= F.col("weakest"))
    )
    named = ["lang", "w1", "w2"]
    return at.filter("bound >= cut").select(named).union(before.select(named)).distinct()


def _survivors(pairs: DataFrame, triples: DataFrame, cuts: DataFrame) -> DataFrame:
    """Candidates from the cut on that no longer candidate drops: (lang, phrase, a, l, r, score)."""
    cut = cuts.select("lang", "cut")
    inside = triples.select("lang", "w1", "w2", "a").union(triples.select("lang", "w2", "w3", "a"))
    longest = inside.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    two = (
        pairs.join(cut, "lang").filter("score >= cut").join(longest, ["lang", "w1", "w2"], "left")
        .filter(F.col("longer").isNull() | (F.col("longer") * 2 < F.col("a")))
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    )
    three = triples.join(cut, "lang").filter("score >= cut").select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score"
    )
    return two.union(three)


def top_phrases(
    docs: DataFrame, limit: int = 2000, least: int = 10, lang: str = "lang", text: str = "text", first: int = FIRST,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `limit` best phrases of each language.

    Texts are A-Z lowered, cut into pieces at `[.,;:!?\\x0A-\\x0D]` and these into words
    `[^\\x20\\x09]+`. Candidates are runs of two or three words in a piece, found `least`
    times or more. Cut into a first and a last part of counts l and r, a run of count a
    scores floor(10^6 a a / (l r)); its lowest cut counts, the earlier of equal ones. A pair
    is dropped if it lies in a run of three that is at least half as frequent. Ties rank by
    count, then by the phrase's bytes. n counts all words of the language.

    Growth is best first: pairs are counted where both words are frequent enough. Runs
    of three start from the pairs whose bound (see `_scored_pairs`) reaches a language's
    cut, a score that its best `first * limit` pairs reach. All candidates from the cut on are
    then known, and what drops them. Where fewer than `limit` of them survive, the cut goes
    down and the frontier is expanded further, until each language's last phrase, ties
    included, is settled.

    A null language is `und`, like that name itself; null and empty texts have no words.
    Repeated rows count as often as they come. A language without candidates has no rows,
    an empty table none. Other columns are not looked at. The driver and the tasks hold
    filters of fixed size; they let too much through when full, and exact counts and joins
    follow, so no phrase is lost or added.
    """
    spark = ready(docs.sparkSession)
    with Scratch(spark) as scratch:
        counted = scratch.stored(count_words(docs, lang, text), "words")
        totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
        words = counted.filter(F.col("n") >= least)
        found = count_pairs(docs, lang, text, bit_filter(words, "w1")).filter(F.col("n") >= least)
        pairs = scratch.stored(_scored_pairs(found, words), "pairs")

        named = ["lang", "w1", "w2"]
        triples = done = settled = None
        wanted, turn = first * limit, 0
        while True:
            cuts = _cuts(pairs, wanted)
            if settled is not None:
                cuts = cuts.join(settled.select("lang"), "lang", "left_anti")
            cuts = scratch.stored(cuts, f"cuts{turn}")
            frontier = _frontier(pairs, cuts)
            if done is not None:
                frontier = frontier.join(done, named, "left_anti")
            frontier = scratch.stored(frontier, f"frontier{turn}")
            grown = count_triples(docs, lang, text, bit_filter(frontier, "w1", "w2")).filter(F.col("n") >= least)
            grown = scratch.stored(
                _scored_triples(grown.join(frontier, named, "left_semi"), pairs), f"triples{turn}"
            )
            triples = grown if triples is None else triples.union(grown)
            done = frontier if done is None else done.union(frontier)
            alive = _survivors(pairs, triples, cuts).groupBy("lang").agg(F.count("*").alias("alive"))
            ready_now = scratch.stored(
                cuts.join(alive, "lang", "left").filter((F.col("cut") == 0) | (F.col("alive") >= limit)).select("lang", "cut"),
                f"settled{turn}",
            )
            settled = ready_now if settled is None else settled.union(ready_now)
            # One row per language at most; only whether any is left comes to the driver.
            if cuts.join(ready_now, "lang", "left_anti").isEmpty():
                break
            wanted, turn = wanted * 2, turn + 1
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = (
            _survivors(pairs, triples, settled).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= limit).join(totals, "lang")
        )
        return scratch.keep(best.select(
            "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
        ))
