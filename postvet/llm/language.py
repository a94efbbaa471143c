"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postvet.llm.common import map_texts, ready
from postvet.session import stored

WINDOW = 256            # bytes of a window; texts are cut into such, the last one padded
WIDTHS = (2, 3, 4)      # bytes that a filter sees
FILTERS = 16            # filters of each width
EMBED = 8               # numbers that stand for a byte
PAD = 0                 # byte that fills the last window
BATCH_WINDOWS = 512     # windows passed through the network at once
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
CELLS = 16              # hash cells of a language that give training rows, each its share


@dataclass(frozen=True)
class Limits:
    """Bounds of the training sample; prediction has none."""

    rows_per_lang: int = 2_000
    windows_per_row: int = 4
    epochs: int = 8


def windows(data: bytes) -> np.ndarray:
    """All bytes of a text as rows of WINDOW values."""
    rows = max(1, -(-len(data) // WINDOW))
    out = np.full(rows * WINDOW, PAD, np.uint8)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, WINDOW)


@dataclass
class Network:
    """Byte embedding, filters of several widths, max pooling over the window, softmax."""

    langs: list[str]
    embed: np.ndarray                 # 256 x EMBED
    filters: list[np.ndarray]         # per width: width x EMBED x FILTERS
    bias: np.ndarray                  # of all filters
    dense: np.ndarray                 # filters x langs
    out: np.ndarray                   # langs

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 5) -> "Network":
        draw = np.random.default_rng(seed)
        return cls(
            langs, draw.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            [draw.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(len(WIDTHS) * FILTERS, np.float32),
            draw.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32),
            np.zeros(len(langs), np.float32),
        )

    def tables(self) -> list[np.ndarray]:
        """What each byte adds to each filter at each place: embedding times filter."""
        return [np.einsum("be,wef->wbf", self.embed, f) for f in self.filters]

    def pairs(self) -> list[list[tuple[int, np.ndarray]]]:
        """The same for two neighbouring bytes at once, so a filter needs half the look-ups."""
        found = []
        for t in self.tables():
            steps = []
            for k in range(0, len(t) - 1, 2):
                steps.append((k, (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS)))
            if len(t) % 2:
                steps.append((len(t) - 1, t[-1]))
            found.append(steps)
        return found

    def pool(self, batch: np.ndarray, pairs) -> np.ndarray:
        """Largest response of each filter in each window, before the ramp."""
        two = (batch[:, :-1].astype(np.int32) << 8) | batch[:, 1:]
        pooled = []
        for width, steps in zip(WIDTHS, pairs):
            n = WINDOW - width + 1
            total = None
            for k, table in steps:
                source = two if len(table) > 256 else batch
                part = np.take(table, source[:, k:k + n], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(total.max(axis=1))
        return np.concatenate(pooled, axis=1) + self.bias

    def logits(self, batch: np.ndarray, pairs) -> np.ndarray:
        return np.maximum(self.pool(batch, pairs), 0) @ self.dense + self.out

    def predict(self, texts: list[str | None], pairs) -> list[tuple[str, float]]:
        """Language and its probability for each whole text: the mean over its windows.

        A window counts by its bytes. Windows of several texts share a batch.
        """
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        at = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not at or not self.langs:
            return found
        sums = np.zeros((len(texts), len(self.langs)))
        held, owner, weight = [], [], []

        def give():
            batch = np.concatenate(held)
            own, share = np.concatenate(owner), np.concatenate(weight)
            for i in range(0, len(batch), BATCH_WINDOWS):
                s = slice(i, i + BATCH_WINDOWS)
                z = self.logits(batch[s], pairs)
                z = np.exp(z - z.max(axis=1, keepdims=True))
                np.add.at(sums, own[s], z / z.sum(axis=1, keepdims=True) * share[s, None])
            held.clear(), owner.clear(), weight.clear()

        size = 0
        for i in at:
            data = texts[i].encode()
            cut = windows(data)
            held.append(cut)
            owner.append(np.full(len(cut), i))
            share = np.full(len(cut), float(WINDOW))
            share[-1] = len(data) - (len(cut) - 1) * WINDOW
            weight.append(share)
            size += len(cut)
            if size >= 4 * BATCH_WINDOWS:
                give()
                size = 0
        if held:
            give()
        for i in at:
            best = int(sums[i].argmax())
            found[i] = (self.langs[best], float(np.clip(sums[i, best] / sums[i].sum(), 0, 1)))
        return found


def train(rows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int, rate: float = 0.01) -> Network:
    """Adam on the cross entropy; only the place of each maximum passes its slope on."""
    net = Network.fresh(langs)
    names = ["embed", "bias", "dense", "out"]
    params = [getattr(net, n) for n in names] + net.filters
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    draw, step = np.random.default_rng(9), 0
    weight = len(labels) / (len(langs) * np.maximum(1, np.bincount(labels, minlength=len(langs))))
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for start in range(0, len(rows), 64):
            pick = order[start:start + 64]
            batch, want = rows[pick], labels[pick]
            slopes = _slopes(net, batch, want, weight)
            step += 1
            for p, g, m, q in zip(params, slopes, mean, square):
                m += 0.1 * (g - m)
                q += 0.01 * (g * g - q)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.99 ** step)) + 1e-7)
    return net


def _slopes(net: Network, batch: np.ndarray, want: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    tops, places = [], []
    for width, table in zip(WIDTHS, net.tables()):
        n = WINDOW - width + 1
        total = sum(np.take(table[k], batch[:, k:k + n], axis=0) for k in range(width))
        at = total.argmax(axis=1)
        places.append(at)
        tops.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0, :])
    pooled = np.concatenate(tops, axis=1) + net.bias
    hidden = np.maximum(pooled, 0)
    z = hidden @ net.dense + net.out
    z = np.exp(z - z.max(axis=1, keepdims=True))
    off = z / z.sum(axis=1, keepdims=True)
    off[np.arange(len(want)), want] -= 1
    off *= (weight[want] / len(want))[:, None].astype(np.float32)
    back = (off @ net.dense.T) * (pooled > 0)
    embed, filters = np.zeros_like(net.embed), []
    for i, (width, at) in enumerate(zip(WIDTHS, places)):
        mine = back[:, i * FILTERS:(i + 1) * FILTERS]
        slope = np.zeros_like(net.filters[i])
        for k in range(width):
            seen = np.take_along_axis(batch, at + k, axis=1)           # windows x filters
            slope[k] = np.einsum("nfe,nf->ef", net.embed[seen], mine)
            np.add.at(embed, seen, mine[:, :, None] * net.filters[i][k].T[None])
        filters.append(slope)
    return [embed, back.sum(axis=0), hidden.T @ off, off.sum(axis=0), *filters]


def held_out(key):
    """Rows that are never learned from: crc32 of the id as text leaves 2 mod 4."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """Train on a bounded sample of the rows that are not held out and have a language.

    At most `rows_per_lang` rows of each language and evenly spaced windows of each: ids
    fall into CELLS cells by hash, and each cell gives its first ones by hash, so no task
    ranks a whole language. Rows that repeat an id and a language count once, with the
    smallest text. Neither id, source nor language is an input of the network.
    """
    from pyspark.sql import Window

    ready(docs.sparkSession)
    cell = F.pmod(F.xxhash64(key, F.lit(29)), F.lit(CELLS))
    order = Window.partitionBy(lang, cell).orderBy(F.xxhash64(key, F.lit(23)), key)
    usable = docs.filter(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(key).isNotNull())
    picked = stored(
        usable.select(key, lang).distinct().withColumn("__n", F.row_number().over(order))
        .filter(F.col("__n") <= max(1, limits.rows_per_lang // CELLS)).select(key, lang)
    )
    sample = (
        usable.select(key, lang, text).join(F.broadcast(picked), [key, lang], "left_semi")
        .groupBy(key, lang).agg(F.min(text).alias(text))
    )

    def cut(texts):
        rows = []
        for t in texts:
            if not t or not LETTER.search(t):
                rows.append([])
                continue
            every = windows(t.encode())
            at = np.unique(np.linspace(0, len(every) - 1, limits.windows_per_row).astype(int))
            rows.append([every[i].tobytes() for i in at])
        return [pa.array(rows, pa.list_(pa.binary()))]

    rows = (
        map_texts(sample, [key, lang], text, "parts array<binary>", cut)
        .orderBy(key, lang).select(lang, "parts").collect()
    )
    pairs = [(r[0], bytes(p)) for r in rows for p in r[1]]
    langs = sorted({name for name, _ in pairs})
    if not langs:
        return Network.fresh([])
    number = {name: i for i, name in enumerate(langs)}
    data = np.frombuffer(b"".join(p for _, p in pairs), np.uint8).reshape(-1, WINDOW)
    return train(data, np.array([number[name] for name, _ in pairs]), langs, limits.epochs)


def predict_languages(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score) for every row; one pass, no shuffle.

    All windows of the whole text are scored. `und` with score 0 if the text is null or
    has no letter, or if there was nothing to learn from. Null ids are not held out, and
    not learned from. Repeated rows are predicted each. Other columns are not looked at.
    """
    ready(docs.sparkSession)

    def work(texts):
        found = net.predict(texts, _pairs(net))
        return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

    return map_texts(docs, [key], text, "lang_pred string, score double", work).select(
        key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score"
    )


_BUILT: dict = {}


def _pairs(net: Network):
    """The look-up tables, built once in each worker."""
    mark = (net.embed.tobytes(), net.dense.tobytes())
    if _BUILT.get("mark") != mark:
        _BUILT.update(mark=mark, pairs=net.pairs())
    return _BUILT["pairs"]
