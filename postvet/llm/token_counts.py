"""Token counts of byte-level BPE with a shortcut for pieces that are one token."""

from __future__ import annotations

from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postvet.llm.common import map_texts, ready

# The pieces into which the byte-level pre-tokenizer splits a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Merged pieces a worker remembers; longer ones and any beyond this are merged again.
MEMO_PIECES = 1 << 19
MEMO_LENGTH = 64


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the tokenizer gives back as exactly one token.

    Each string of the vocabulary is encoded once; it counts as proven if it is one
    piece and its own id comes out. Special tokens and byte fragments are left out.
    """
    model = tokenizer(path)
    special = {t.content for t in model.get_added_tokens_decoder().values()}
    letters, texts, ids = byte_letters(), [], []
    for token, number in model.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(letters[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text not in special:
            texts.append(text)
            ids.append(number)
    piece = regex.compile(PIECES)
    found = model.encode_batch(texts, add_special_tokens=False)
    return frozenset(
        t for t, n, e in zip(texts, ids, found) if e.ids == [n] and piece.fullmatch(t)
    )


class PieceCosts(dict):
    """Tokens of each piece: 1 for the proven strings, the merged length for the rest."""

    def __init__(self, path: str):
        super().__init__(dict.fromkeys(whole_tokens(path), 1))
        self.proven = len(self)
        self.path = path

    def __missing__(self, piece: str) -> int:
        n = len(tokenizer(self.path).encode(piece, add_special_tokens=False).ids)
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= self.proven + MEMO_PIECES:
                self.clear()
                self.update(dict.fromkeys(whole_tokens(self.path), 1))
            self[piece] = n
        return n


@cache
def piece_costs(path: str) -> PieceCosts:
    return PieceCosts(path)


@cache
def splitter(path: str):
    """How the text is cut at special tokens, which the tokenizer looks for first."""
    special = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    return regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None


@cache
def doubtful() -> "regex.Pattern":
    """Characters whose class differs between releases of Unicode: not assigned here."""
    return regex.compile(r"\p{Cn}|\p{Co}|\p{Cs}")


def count_tokens(text: str | None, path: str, find=regex.compile(PIECES).findall) -> int:
    """Tokens of a whole text, without begin, end or added special tokens.

    A special string inside the text is one token. A text with characters unknown to
    the piece rule's release of Unicode goes to the tokenizer as it is.
    """
    if not text:
        return 0
    if not text.isascii() and doubtful().search(text):
        return len(tokenizer(path).encode(text, add_special_tokens=False).ids)
    costs, cut = piece_costs(path), splitter(path)
    parts = cut.split(text) if cut else [text]
    return len(parts) - 1 + sum(sum(map(costs.__getitem__, find(p))) for p in parts if p)


def token_counts(
    docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row.

    One pass over the texts, no shuffle. Null and empty texts have 0 bytes and 0 tokens.
    Repeated rows are counted each. An empty table gives no rows. Other columns are not
    looked at. `path` names a tokenizer file that every executor has.
    """
    ready(docs.sparkSession)

    def work(texts):
        return [pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                pa.array([count_tokens(t, path) for t in texts], pa.int64())]

    return map_texts(docs, [key], text, "n_bytes bigint, n_tokens bigint", work).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
