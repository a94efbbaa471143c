"""Token ids in Parquet list columns, written in id order and read back by column."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postvet.llm.common import Memo, ready, text_hash
from postvet.llm.token_counts import byte_letters, tokenizer
from postvet.session import stored

# Pieces of one generation of a worker's memory.
MEMO_PIECES = 1 << 18
# Values of one returned Arrow batch.
BATCH_IDS = 1 << 20
# Row groups of 32 MB hold some thousand texts; pages of 256 KB let the page index skip
# within them. Version 2 pages delta-encode the integers that a dictionary doesn't suit.
LAYOUT = {
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10),
    "parquet.page.write-checksum.enabled": "true", "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0", "compression": "zstd",
}
WORDS = regex.compile(r"[^\p{White_Space}]+")


# The pieces into which the tokenizer's rule splits a word.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
# Signs that every release of Unicode classes, lowers and composes alike, and no special
# string. The short rule for pieces holds for these.
_SIGNS = r"\x09-\x0d\x20-\x3b\x3d-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f"
PLAIN = re.compile(rf"[{_SIGNS}]*(?:<(?!\|)[{_SIGNS}]*)*")


def _ids(word: str, path: str) -> bytes:
    """Ids of a word as little-endian 32-bit bytes, from the tokenizer itself."""
    return np.array(tokenizer(path).encode(word, add_special_tokens=False).ids, "<u4").tobytes()


@cache
def _letters() -> dict[int, str]:
    return {byte: letter for letter, byte in byte_letters().items()}


def _piece_ids(piece: str, path: str) -> bytes:
    """The same for a lower-case piece, which needs only the tokenizer's merges."""
    spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_letters())
    return array("I", [t.id for t in tokenizer(path).model.tokenize(spelt)]).tobytes()


@cache
def piece_memo(path: str) -> Memo:
    return Memo(partial(_piece_ids, path=path), MEMO_PIECES)


def _plain_word_ids(word: str, path: str) -> bytes:
    """The same for a lower-case word of plain signs: no piece holds white space."""
    return b"".join(map(piece_memo(path).__getitem__, PIECES.findall(word)))


@cache
def plain_memo(path: str) -> Memo:
    return Memo(partial(_plain_word_ids, path=path), MEMO_PIECES)


@cache
def word_memo(path: str) -> Memo:
    return Memo(partial(_ids, path=path), MEMO_PIECES)


def encode(text: str | None, path: str, end: int | None = None) -> bytes:
    """All ids of a whole text as little-endian 32-bit values, `end` appended; null: as empty.

    The tokenizer drops white space and its rules never look past it, so a text's ids
    are those of its words, one after another; a special string holds no white space.
    Plain words are looked up in lower case, and where new by their pieces, all others as they stand.
    """
    text = text or ""
    plain, words = plain_memo(path).__getitem__, word_memo(path).__getitem__
    tail = b"" if end is None else np.array([end], "<u4").tobytes()
    # The white space among plain signs is what `split` takes for it.
    if not text or PLAIN.fullmatch(text):
        return b"".join(map(plain, text.lower().split())) + tail
    return b"".join(
        plain(w.lower()) if PLAIN.fullmatch(w) else words(w) for w in WORDS.findall(text)
    ) + tail


def write_tokens(
    docs: DataFrame, target: str, path: str, end: int | None = None, key: str = "doc_id", text: str = "text",
) -> None:
    """Write (key, before, n_tokens, ids_crc32, ids) in ascending key order, one file per task.

    Rows are dealt by ranges of the key, so file order is key order; nulls come first.
    Rows of one key are ordered by text hash. `before` counts the ids of the file's
    earlier rows, which one running sum per task gives.
    """
    ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        held: list[bytes] = []
        keys: list = []

        def give():
            nonlocal before, held, keys
            sizes = np.array([len(b) // 4 for b in held], np.int64)
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                pa.array(np.frombuffer(b"".join(held), "<i4")),
            )
            made = pa.RecordBatch.from_arrays([
                pa.concat_arrays(keys), pa.array(before + ends - sizes), pa.array(sizes),
                pa.array([zlib.crc32(b) for b in held], pa.int64()), ids,
            ], [key, "before", "n_tokens", "ids_crc32", "ids"])
            before += int(sizes.sum())
            held, keys = [], []
            return made

        for batch in batches:
            first, size = 0, 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                held.append(made := encode(text, path, end))
                size += len(made) // 4
                if size >= BATCH_IDS or i == batch.num_rows - 1:
                    keys.append(batch.column(0).slice(first, i + 1 - first))
                    first, size = i + 1, 0
                    yield give()

    schema = f"`{key}` {kind}, before bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>"
    ordered = (
        docs.select(key, F.col(text).alias("__text"))
        .repartitionByRange(F.col(key).asc_nulls_first(), text_hash("__text"))
        .sortWithinPartitions(F.col(key).asc_nulls_first(), text_hash("__text"))
    )
    ordered.mapInArrow(run, schema).write.options(**LAYOUT).parquet(target)


def part_number(name: Column) -> Column:
    """Number of the task that wrote a file; the name itself is not in order from 100,000 files on."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("long")


def token_index(spark: SparkSession, target: str, key: str = "doc_id") -> DataFrame:
    """(part, base): ids in all files before the file of each number. Reads two narrow columns.

    One narrow row per file: the window over all files is small.
    """
    files = (
        spark.read.parquet(target)
        .select(part_number(F.col("_metadata.file_name")).alias("part"), (F.col("before") + F.col("n_tokens")).alias("upto"))
        .groupBy("part").agg(F.max("upto").alias("ids"))
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, target: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) from the files.

    Columns that are not used are not read, and a filter on the key skips row groups
    and pages by their bounds. Without `ids` the ids are left out. The table of files is
    written first, so that Spark knows its size and leaves the ids where they are.
    """
    index = stored(token_index(spark, target, key)).withColumnRenamed("part", "__part")
    rows = spark.read.parquet(target).withColumn("__at", part_number(F.col("_metadata.file_name")))
    found = rows.join(index, F.col("__at") == F.col("__part"))
    columns = [key, (F.col("before") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"]
    return found.select(*columns, *(["ids"] if ids else []))


def ids_checksum(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) with the figures taken from the ids that were read."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy().astype("<u4", copy=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]]).astype(int)
            sums = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists.value_lengths().cast(pa.int64()), pa.array(sums, pa.int64())],
                [key, "start", "n_tokens", "ids_crc32"],
            )

    return rows.select(key, "start", "ids").mapInArrow(
        run, f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def token_files(
    docs: DataFrame, target: str, path: str, end: int | None = None, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Write the ids of every whole text to `target`, read them back, return the digest.

    (key, start, n_tokens, ids_crc32) per row, each figure from the files: `start` is the
    number of ids of all rows before it. Null and empty texts hold only the end id.
    Repeated rows are written each. An empty table gives files without rows. Other
    columns are not looked at.
    """
    write_tokens(docs, target, path, end, key, text)
    return ids_checksum(read_tokens(docs.sparkSession, target, key), key)
