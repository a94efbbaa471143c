"""Term vectors of texts, and the cosines of given pairs of them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postvet.functions.text import words
from postvet.session import stored

# What a task holds at once: pairs, and entries of vectors, 12 bytes each once they are read.
CELL_PAIRS = 1 << 20
CELL_ENTRIES = 1 << 24
# About so many cells are worked on by one query, whose shuffle files go before the next.
BAND_CELLS = 16
# Pairs of one resume that are multiplied at once, and vectors that are read at once.
TURN = 4_096
# Up to so many terms, a vector is spread over an array of all; else over those of its cell.
FEW_TERMS = 1 << 23
# The most frequent terms, which every task knows; only others are looked up by a join.
HOT_TERMS = 1 << 19

# A vector, or a piece of one: as many numbers of 7 bits a byte in each column.
PIECE = "size int, terms binary, tfs binary, dfs binary"


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of every word of every text."""
    return (
        docs.select("doc_id", F.explode(words(F.col("text"))).alias("term"))
        .groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    )


def _short(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Numbers from 0 as binary, `sizes` of them in a row: 7 bits a byte, the last one under 128."""
    values = values.astype(np.int64)
    length = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        length += values >= 1 << bits
    ends = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(ends[-1], np.uint8)
    for i in range(int(length.max(initial=0))):
        has = length > i
        out[ends[:-1][has] + i] = (values[has] >> (7 * i) & 127) | np.where(length[has] > i + 1, 128, 0)
    rows = ends[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(rows), pa.py_buffer(out)])


def _long(short: pa.Array) -> np.ndarray:
    """The numbers of all rows that `_short` made, one after another."""
    offsets = np.frombuffer(short.buffers()[1], np.int32)[short.offset:short.offset + len(short) + 1]
    held = np.frombuffer(short.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    starts = np.flatnonzero(np.concatenate([[True], held[:-1] < 128])) if len(held) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.int64)
    place = np.arange(len(held)) - np.repeat(starts, np.diff(np.append(starts, len(held))))
    return np.add.reduceat((held & 127).astype(np.int64) << 7 * place, starts)


def compact_vectors(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, size, terms, tfs, dfs) in one or two pieces per text, and the number of texts.

    An entry is the term's number, how often the text has it, and how many texts have it. Numbers
    rise as terms get rarer. A term found in every text has weight 0 and adds nothing to a product,
    so it is left out; a text of such terms alone, or without words, has no vector. Words are counted
    inside their text; those that are not among the frequent ones, and the words of texts that
    share an id, are a piece of their own.
    """
    total = docs.count()
    repeated = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id")))
    once, loose = docs.select("doc_id", "text"), []
    if not repeated.isEmpty():
        shared = F.col("doc_id").eqNullSafe(F.col("_id"))
        loose.append(stored(term_counts(once.join(repeated, shared, "left_semi"))))
        once = once.join(repeated, shared, "left_anti")
    seen = once.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    for some in loose:
        seen = seen.unionByName(some.select("term"))
    # Numbers are written once, so that all later reads agree on them.
    vocabulary = _numbered(stored(
        seen.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") < total)
        .orderBy(F.desc("df"), "term").withColumn("number", F.monotonically_increasing_id())
    ))
    hot = vocabulary.filter(F.col("number") < HOT_TERMS).select("term", "df", "number").toArrow().sort_by("number")
    known = docs.sparkSession.sparkContext.broadcast((hot["term"].combine_chunks(), hot["df"].to_numpy()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, df = known.value
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        for batch in batches:
            n, listed = batch.num_rows, batch.column(1)
            owner = np.repeat(np.arange(n), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = listed.flatten()
            number = pc.index_in(flat, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            found = number >= 0
            key, tf = np.unique(owner[found] * max(1, len(names)) + number[found], return_counts=True)
            row, number = np.divmod(key, max(1, len(names)))
            sizes = np.bincount(row, minlength=n)
            rest = flat.filter(pa.array(~found)).dictionary_encode()
            some = max(1, len(rest.dictionary))
            key, often = np.unique(owner[~found] * some + rest.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, at = np.divmod(key, some)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
            others = pa.StructArray.from_arrays([rest.dictionary.take(pa.array(at)), pa.array(often)], ["term", "tf"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), _short(number, sizes), _short(tf, sizes),
                 _short(df[number], sizes), pa.ListArray.from_arrays(pa.array(offsets), others)],
                ["doc_id", "size", "terms", "tfs", "dfs", "others"],
            )

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            short = [_short(batch.column(i).flatten().to_numpy(zero_copy_only=False), sizes) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), *short], ["doc_id", "size", "terms", "tfs", "dfs"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = stored(once.select("doc_id", words(F.col("text")).alias("words")).mapInArrow(
        counted, f"doc_id {kind}, {PIECE}, others array<struct<term: string, tf: bigint>>"
    ))
    rare = made.select("doc_id", F.inline("others"))
    for some in loose:
        rare = rare.unionByName(some)
    entries = F.sort_array(F.collect_list(F.struct("number", "tf", "df"))).alias("e")
    pieces = stored(
        rare.join(vocabulary, "term").groupBy("doc_id").agg(entries)
        .select("doc_id", "e.number", "e.tf", "e.df").mapInArrow(shortened, f"doc_id {kind}, {PIECE}")
    )
    return made.drop("others").filter("size > 0").unionByName(pieces), total


def term_vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, terms, weights): TF-IDF vectors of length 1, sorted by term number; see `compact_vectors`."""
    vectors, total = compact_vectors(docs)

    def read(pieces: pa.Table) -> pa.Table:
        _, terms, weights = _Vectors(pieces, total).read(np.arange(1))
        return pa.table({
            "doc_id": pieces["doc_id"].slice(0, 1), "terms": pa.array([terms], pa.list_(pa.int64())),
            "weights": pa.array([weights], pa.list_(pa.float64())),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return vectors.groupBy("doc_id").applyInArrow(read, f"doc_id {kind}, terms array<bigint>, weights array<double>")


def _numbered(idf: DataFrame) -> DataFrame:
    """The same terms with gapless numbers from 0, in the order of the ones they have."""
    # The upper bits name the partition: one row for each reaches the driver.
    part = F.shiftright("number", 33).cast("int")
    sizes = {r["part"]: r["n"] for r in idf.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return idf.withColumn("number", F.col("number").cast("int"))
    starts = [0]
    for at in range(max(sizes)):
        starts.append(starts[-1] + sizes.get(at, 0))
    kind = "int" if sum(sizes.values()) < 1 << 31 else "long"
    within = F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    return idf.withColumn("number", (F.get(F.lit(starts).cast("array<long>"), part) + within).cast(kind))


def _whole(lists: pa.ChunkedArray) -> pa.ListArray:
    made = lists.combine_chunks()
    return made.chunk(0) if isinstance(made, pa.ChunkedArray) else made


class _Vectors:
    """The vectors of a cell, read when they are asked for. Ids are `keys`, in rising order."""

    def __init__(self, table: pa.Table, total: int | None):
        self.table, self.total = table.combine_chunks(), total
        ids = table["doc_id"].to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.keys, self.first, self.pieces = np.unique(ids[self.order], return_index=True, return_counts=True)
        held = table["size"] if total is not None else pc.list_value_length(table["terms"])
        self.sizes = np.add.reduceat(held.to_numpy()[self.order].astype(np.int64), self.first)

    def place(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, ids), len(self.keys) - 1)
        return np.where(self.keys[at] == ids, at, -1)

    def read(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, terms, weights) of these vectors, one after another; the length of each is 1."""
        sizes, pieces = self.sizes[places], self.pieces[places]
        skipped = np.cumsum(pieces) - pieces
        rows = self.order[np.arange(pieces.sum()) + np.repeat(self.first[places] - skipped, pieces)]
        part = self.table.take(pa.array(rows))
        if self.total is None:
            flat = [_whole(part[c]).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "weights")]
            return sizes, *flat
        terms, tf, df = (_long(_whole(part[c])) for c in ("terms", "tfs", "dfs"))
        weights = tf * np.log(self.total / df)
        square = np.add.reduceat(weights * weights, np.cumsum(sizes) - sizes)
        return sizes, terms, weights / np.repeat(np.sqrt(square), sizes)


def _products(pairs: pa.Table, vectors: pa.Table, total: int | None = None) -> pa.Table:
    """Cosine of each pair of a cell; 0 where one side has no vector.

    The vectors of the postings are read into sorted arrays. Those of one resume after another
    are spread over the terms, and the arrays of its postings are met with them, many at once.
    """
    resume, posting = (pairs[c].to_numpy() for c in ("resume_id", "posting_id"))
    cosine = np.zeros(len(resume))
    if vectors.num_rows and len(resume):
        held = _Vectors(vectors, total)
        r, p = held.place(resume), held.place(posting)
        usable = np.flatnonzero((r >= 0) & (p >= 0))
        usable = usable[np.argsort(r[usable], kind="stable")]
        used, at = np.unique(p[usable], return_inverse=True)
        sizes = held.sizes[used]
        ends = np.cumsum(sizes)
        starts, entries = ends - sizes, int(sizes.sum())
        terms, weights = np.empty(entries, np.int64 if entries and held.total is None else np.int32), np.empty(entries)
        for i in range(0, len(used), TURN):
            _, some_terms, some_weights = held.read(used[i:i + TURN])
            if len(some_terms) and some_terms.max() >= 1 << 31:
                terms = terms.astype(np.int64)
            span = slice(starts[i], starts[i] + len(some_terms))
            terms[span], weights[span] = some_terms, some_weights
        width, known = int(terms.max(initial=-1)) + 1, None
        if width > FEW_TERMS:
            known, terms = np.unique(terms, return_inverse=True)
            width = len(known)
        spread = np.zeros(width)
        resumes, begin = np.unique(r[usable], return_index=True)
        stop = np.append(begin[1:], len(usable))
        for i in range(0, len(resumes), TURN):
            own_sizes, own_terms, own_weights = held.read(resumes[i:i + TURN])
            if known is None:
                there = own_terms < width
            else:
                spot = np.minimum(np.searchsorted(known, own_terms), max(0, width - 1))
                there, own_terms = known[spot] == own_terms, spot
            own_ends = np.cumsum(own_sizes)
            for j, end in enumerate(own_ends):
                own = slice(end - own_sizes[j], end)
                meets = own_terms[own][there[own]]
                spread[meets] = own_weights[own][there[own]]
                for k in range(begin[i + j], stop[i + j], TURN):
                    some = slice(k, min(k + TURN, stop[i + j]))
                    n = sizes[at[some]]
                    last = np.cumsum(n)
                    entry = np.arange(last[-1]) + np.repeat(starts[at[some]] - (last - n), n)
                    cosine[usable[some]] = np.add.reduceat(spread[terms[entry]] * weights[entry], last - n)
                spread[meets] = 0.0
    return pa.table({"resume_id": pairs["resume_id"], "posting_id": pairs["posting_id"], "cosine": pa.array(cosine)})


def cosines(pairs: DataFrame, vectors: DataFrame, total: int | None = None) -> DataFrame:
    """(resume_id, posting_id, cosine) for distinct pairs with ids; 0 where a vector is missing.

    `vectors` are those of `term_vectors`, or with `total` those of `compact_vectors`. Pairs are
    dealt to the cells of a grid of resumes by postings, and a vector goes once
    to each cell that has a pair of it: so it travels at most as often as it has pairs, and
    at most once per row or column of the grid if it has many. The grid is as coarse as the
    memory of a task allows. A crowded cell, such as one of a posting that many apply to,
    is dealt over several parts. Columns of a large grid are worked on a few at a time, so that
    the copies of the vectors that are on disk at once do not grow with the grid.
    """
    pairs, vectors = stored(pairs), vectors if total is not None else stored(vectors)
    entries = vectors.agg(F.sum(F.size("terms") if total is None else F.col("size"))).first()[0] or 0
    side = max(1, math.ceil(math.sqrt(pairs.count() / CELL_PAIRS)), math.ceil(1.5 * entries / CELL_ENTRIES))
    column = F.pmod(F.xxhash64("posting_id"), F.lit(side))
    celled = pairs.withColumn("column", column).withColumn("cell", F.pmod(F.xxhash64("resume_id"), F.lit(side)) * side + column)
    crowded = (
        celled.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL_PAIRS)).cast("int").alias("parts")).filter("parts > 1")
    )
    dealt = stored(
        celled.join(crowded, "cell", "left")
        .withColumn("part", F.pmod(F.xxhash64("resume_id", "posting_id"), F.coalesce("parts", F.lit(1))).cast("int"))
        .select("column", "cell", "part", "resume_id", "posting_id")
    )

    def products(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        return _products(pairs, vectors, total)

    def worked(some: DataFrame) -> DataFrame:
        ends = F.explode(F.array("resume_id", "posting_id")).alias("doc_id")
        used = some.select(F.col("cell").alias("at"), F.col("part").alias("at_part"), ends).distinct()
        there = used.join(vectors, "doc_id").select("at", "at_part", *vectors.columns)
        return some.drop("column").groupBy("cell", "part").cogroup(there.groupBy("at", "at_part")).applyInArrow(
            products, f"resume_id {pairs.schema['resume_id'].dataType.simpleString()}, "
                      f"posting_id {pairs.schema['posting_id'].dataType.simpleString()}, cosine double"
        )

    columns = max(1, BAND_CELLS // side)
    if columns >= side:
        return worked(dealt)
    bands = [stored(worked(dealt.filter(F.col("column").between(i, i + columns - 1)))) for i in range(0, side, columns)]
    return reduce(DataFrame.unionByName, bands)
