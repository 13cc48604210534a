"""Language identification with a byte convolutional network.

A text is cut into fixed-length windows of its UTF-8 bytes. Filters of several widths slide over a window; every
filter has one weight per position and byte value, so a convolution is a sum of looked-up rows. The largest
activation of each filter in a window feeds a softmax over the languages. A text's score for a language is the
mean of its windows, weighed by their bytes; all windows of the whole text count.

The network is trained in numpy on a bounded sample of labelled rows: of each language at most `ROWS` texts,
those with the smallest hash of id and text, and of each text at most `PER_TEXT` windows spread over its length.
Training is seeded, so a repeated run gives the same network. Language, source and id are never inputs.

Defined cases: a null text, and one without any letter, is `und` with score 0, and so is every text if no row
can be learned from; null languages are not learned; rows that repeat are predicted alike; with one language in
the sample that language is predicted with score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
ROWS = 600
PER_TEXT = 4
PARTS = 16
EPOCHS = 6
BATCH = 64
RATE = 0.01
SEED = 11
UNKNOWN = "und"
#: Windows that are scored at once.
SCORED = 256


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, the last one padded by zero bytes."""
    n = -(-len(raw) // size)
    return np.frombuffer(raw.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


@dataclass
class Network:
    """`filters[w]` has the shape (width, byte, filter)."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest activation of each filter in each window, and where it is."""
        tops, places = [], []
        for table in self.filters:
            width = len(table)
            n = x.shape[1] - width + 1
            act = table[0][x[:, :n]]
            for j in range(1, width):
                act += table[j][x[:, j : j + n]]
            at = act.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(act, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(tops, axis=1), np.concatenate(places, axis=1)

    def highest(self, x: np.ndarray) -> np.ndarray:
        """Only the largest activations."""
        tops = []
        for table in self.filters:
            n = x.shape[1] - len(table) + 1
            act = np.take(table[0], x[:, :n], axis=0)
            for j in range(1, len(table)):
                act += np.take(table[j], x[:, j : j + n], axis=0)
            tops.append(act.max(axis=1))
        return np.concatenate(tops, axis=1)

    def probabilities(self, top: np.ndarray) -> np.ndarray:
        z = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def text(self, text: str) -> tuple[str, float]:
        """The language of a whole text, and its score."""
        raw = text.encode()
        total, size = np.zeros(len(self.languages)), SCORED * WINDOW
        for k in range(0, len(raw), size):
            part = raw[k : k + size]
            x = windows(part)
            weight = np.minimum(len(part) - np.arange(len(x)) * WINDOW, WINDOW)
            total += weight @ self.probabilities(self.highest(x)).astype(np.float64)
        best = int(total.argmax())
        return self.languages[best], min(float(total[best] / len(raw)), 1.0)


def train(rows: list[tuple[bytes, str]]) -> Network | None:
    """A network from (window, language) pairs."""
    rng = np.random.default_rng(SEED)
    rows = sorted((w, lang) for w, lang in rows if w)
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    x = np.concatenate([windows(w) for w, _ in rows])
    y = np.array([languages.index(lang) for _, lang in rows])
    k = FILTERS * len(WIDTHS)
    net = Network(
        languages, [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(k, np.float32),
        rng.normal(0, 0.3, (k, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    weights = [*net.filters, net.bias, net.out, net.out_bias]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    # Classes count alike, however many windows each has.
    share = 1 / np.maximum(np.bincount(y, minlength=len(languages)), 1)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            xb, yb = x[pick], y[pick]
            top, at = net.pooled(xb)
            hidden = np.maximum(top + net.bias, 0)
            error = net.probabilities(top)
            error[np.arange(len(yb)), yb] -= 1
            weight = share[yb] / share[yb].sum()
            error *= weight[:, None].astype(np.float32)
            back = (error @ net.out.T) * (top + net.bias > 0)
            grads = []
            for i, table in enumerate(net.filters):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                g = np.zeros_like(table)
                for j in range(len(table)):  # only the place of the largest activation takes part
                    byte = np.take_along_axis(xb, at[:, cols] + j, axis=1)
                    np.add.at(g[j], (byte, np.arange(FILTERS)[None, :]), back[:, cols])
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for w, g, m, s in zip(weights, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS) -> list[tuple[bytes, str]]:
    """Windows of at most `rows` labelled texts of each language, by hash. The rank limit is applied before the shuffle."""
    place = F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(text))
    keyed = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(lang).alias("lang"), place.alias("place"))
    # A language that most rows have is ranked in parts first, so the last ranking sees a bounded number of rows.
    keyed = keyed.withColumn("part", F.pmod("place", F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("place", "id"))
        keyed = keyed.withColumn("rank", rank).filter(F.col("rank") <= rows).drop("rank")
    chosen = keyed.select("lang", "place").distinct()
    # At most `rows` places a language: the table is broadcast for the size it is proven to have.
    texts = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), place.alias("place"))
    found = texts.join(F.broadcast(chosen), ["lang", "place"]).dropDuplicates(["lang", "place"])
    bytes_ = F.encode(F.col("text"), "UTF-8")
    spread = [F.substring(bytes_, 1 + F.floor(F.greatest(F.octet_length("text") - WINDOW, F.lit(0)) * k / max(PER_TEXT - 1, 1)).cast("int"), F.lit(WINDOW)) for k in range(PER_TEXT)]
    taken = found.select(F.explode(F.array_distinct(F.array(*spread))).alias("w"), "lang")
    return [(bytes(w), lang) for w, lang in taken.collect()]


def predicted(docs: DataFrame, net: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, `lang_pred` and `score` of every row. The network has a fixed size."""
    rows = docs.select(*keep, F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def one(x: str | None) -> tuple[str, float]:
        if shared.value is None or x is None or not any(c.isalpha() for c in x):
            return UNKNOWN, 0.0
        return shared.value.text(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x.as_py()) for x in batch.column(len(keep))]
            arrays = [*batch.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
