"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = logistic(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pairs cost
linear time by the identity  sum_{i<j} a_i a_j = ((sum a)^2 - sum a^2) / 2.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices
from .strings import labelled

BUCKETS = 1 << 13
RANK = 6
SAMPLE = 2000  # labelled rows of each class, at most
EPOCHS = 8
ACCEPT = 0.7
_CLASSES = ("upper", "lower", "digit", "blank", "mark", "symbol", "bar", "shout", "wide")
_KIND = np.zeros((256, len(_CLASSES)))
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c, 8 if _c >= 128 else 0 if "A" <= _ch <= "Z" else 1 if "a" <= _ch <= "z" else 2 if _ch.isdigit() else 3 if _ch.isspace() else 6 if _ch == "|" else 7 if _ch == "!" else 5 if _ch in "#$%&*<>{}[]\\^_=~@+/" else 4] = 1
STATS = [*_CLASSES, "length", "words", "distinct", "stutter", "word_length", "line_repeat", "short_lines", "top_word", "constant"]
SIZE = BUCKETS + len(STATS)


def describe(text: bytes) -> tuple[list[int], list[float]]:
    """Feature numbers and values: hashed words (log counts, unit length together), then shares and logs about structure and length (metadata)."""
    n = len(text)
    words = text.lower().split()
    count = Counter(words)
    buckets: dict[int, float] = {}
    for w, c in count.items():
        h = zlib.crc32(w) % BUCKETS
        buckets[h] = buckets.get(h, 0) + c
    at, value = list(buckets), np.log1p(np.fromiter(buckets.values(), float, len(buckets)))
    value /= max(1e-9, float(np.linalg.norm(value)))
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _KIND / max(1, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = len(words)
    stats = [
        *np.sqrt(shares),
        np.log1p(n) / 12,
        np.log1p(m) / 10,
        len(count) / max(1, m),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, m - 1),
        min(2.0, (n - m) / max(1, m) / 8),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        max(count.values(), default=0) / max(1, m),
        1.0,
    ]
    return [*at, *range(BUCKETS, SIZE)], [*value.tolist(), *map(float, stats)]


class FactorisationMachine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v
        self.packed = np.c_[w, v]

    def margins(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        """One margin for each row, in time linear in the features."""
        if not rows:
            return np.zeros(0)
        at = np.concatenate([np.asarray(i, np.int64) for i, _ in rows])
        x = np.concatenate([np.asarray(v, float) for _, v in rows])
        cuts = np.r_[0, np.cumsum([len(i) for i, _ in rows])[:-1]]
        terms = self.packed[at] * x[:, None]
        sums = np.add.reduceat(terms, cuts)
        squares = np.add.reduceat((terms[:, 1:] ** 2).sum(1), cuts)
        return self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)


def train(rows: list[tuple[tuple[list[int], list[float]], int]], rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.1, penalty: float = 2e-4, seed: int = 7) -> FactorisationMachine:
    """Logistic loss by AdaGrad, the classes weighted equally. One class or none: its share (0.5 for none) is every score."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank))
    labels = np.array([y for _, y in rows], float)
    if len(set(labels.tolist())) < 2:
        p = 0.5 if not len(labels) else float(np.clip(labels[0], 1e-6, 1 - 1e-6))
        return FactorisationMachine(float(np.log(p / (1 - p))), w, v * 0)
    data = [(np.asarray(i, np.int64), np.asarray(x, float)) for (i, x), _ in rows]
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    bias, gb, gw, gv = 0.0, 1.0, np.full(SIZE, 1.0), np.full((SIZE, rank), 1.0)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            i, x = data[k]
            vi = v[i]
            a = vi * x[:, None]
            s = a.sum(0)
            f = bias + w[i] @ x + 0.5 * ((s * s).sum() - (a * a).sum())
            d = weight[k] * (1 / (1 + np.exp(-np.clip(f, -30, 30))) - labels[k])
            dw = d * x + penalty * w[i]
            dv = d * x[:, None] * (s - a) + penalty * vi
            gb += d * d
            gw[i] += dw * dw
            gv[i] += dv * dv
            bias -= rate * d / gb**0.5
            w[i] -= rate * dw / np.sqrt(gw[i])
            v[i] -= rate * dv / np.sqrt(gv[i])
    return FactorisationMachine(bias, w, v)


def described(docs: DataFrame, *extra: str, id_col: str, text: str) -> DataFrame:
    def run(batches):
        for b in batches:
            got = [describe(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float64())), *(b.column(e) for e in extra)], ["doc_id", "at", "value", *extra])

    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", {e} {docs.schema[e].dataType.simpleString()}" for e in extra)
    return docs.select(column(id_col).alias("doc_id"), column(text).cast("binary").alias("text"), *extra).mapInArrow(run, f"doc_id {kind}, at array<int>, value array<double>{more}")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> FactorisationMachine:
    """Train on a bounded sample, ``sample`` rows of each class, of the labelled rows whose crc32(id) mod 4 is not 2; only their features come to the driver. No labels: every score is 0.5."""
    got = described(labelled(docs, labels, label, 4, 2, sample, id_col, text), "y", id_col="doc_id", text="text").collect()
    got.sort(key=lambda r: (r.doc_id, r.at, r.value))
    return train([((list(r.at), list(r.value)), r.y) for r in got])


def score(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): a row for each row of ``docs``. A null text scores as an empty one; whole texts are read, very long ones too; repeated rows and null ids stay, with equal scores; other columns are left behind; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))  # SIZE * (RANK + 1) numbers

    def run(batches):
        machine = FactorisationMachine(*shared.value)
        for b in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(1)]
            out = [_logistic(machine.margins([describe(t) for t in texts[lo:hi]])) for lo, hi in slices(texts)]
            yield pa.record_batch([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(column(id_col).alias("doc_id"), column(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, machine: FactorisationMachine, text: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, ties with it among them, all columns as they were, whatever their names. Null texts score as empty ones; repeated rows stay or go together; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))

    @F.arrow_udf("double")
    def judge(texts):
        machine = FactorisationMachine(*shared.value)
        out = [_logistic(machine.margins([describe(x.as_buffer().to_pybytes() if x.is_valid else b"")]))[0] for x in texts]  # a text at a time: a batch is large
        return pa.array(out, pa.float64())

    return docs.where(judge(column(text)) >= least)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
