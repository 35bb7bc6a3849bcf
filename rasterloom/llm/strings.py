"""Subsequence string kernel support vector machine for toxicity.

The kernel of two words is the sum, over the letter triples that both hold as
subsequences, of the product of their weights, over both words' lengths; a triple that spans s letters weighs
DECAY**s, and spans over WINDOW count nothing. An insult with gaps or inserted signs
so keeps most of its triples. Nyström: words are mapped to their kernels with a few
landmark words.

Two linear machines are trained. The first tells words: as the kernel is an inner product
of triple weights, it folds into one table of weights by triple, so a word takes one look-up
per triple, whatever the number of landmarks. The words it suspects, a few of each text, are
compared with the landmarks; a text's row has, for each landmark, its words' greatest kernel
with it and the share of its words that are like it. The second machine, on the labelled
texts' rows, learns which words condemn a text by themselves and which only in numbers.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, hash_mod, slices

WINDOW = 7
DECAY = 0.7
LETTERS = 32
LONGEST = 24
SUSPECTS = 0.06  # share of the harmless words that the first machine lets through to be compared with the landmarks
LANDMARKS = 140
ROUNDS = 2
FIRST = 4  # words of a harmless text that bound the machine from the start
HARDER = 70  # landmarks that each round adds
SAMPLE = 2000  # labelled rows of each class, at most
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")
_PAIRS = [(a, b, DECAY ** (b + 1)) for b in range(2, WINDOW) for a in range(1, b)]


def words_of(text: str) -> Counter:
    """The lower-case words and how often each stands; runs of four or more single signs also count as one word together; long words are cut in overlapping parts."""
    low = text.lower()
    words = Counter(low.split())
    for m in _SPACED.finditer(low):
        words["".join(m[0].split())] += 1
    for w in [w for w in words if len(w) > LONGEST]:
        n = words.pop(w)
        for i in range(0, len(w) - LONGEST // 2, LONGEST // 2):
            words[w[i : i + LONGEST]] += n
    return words


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes 0-31 of all words together, and the number of the word at each place. a-z are 1-26, other letters share 27-30, signs and digits are 0, and 31 begins every word."""
    flat = np.frombuffer("".join("\0" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((flat >= 97) & (flat <= 122), flat - 96, np.where(flat >= 128, 27 + flat % 4, 0)).astype(np.int32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    codes[np.cumsum(sizes) - sizes] = 31
    return codes, np.repeat(np.arange(len(words)), sizes)


def triples(words: list[str]):
    """(word numbers, triple codes, weight) for each pair of steps. Triples of signs only are left out."""
    codes, own = _codes(words)
    n = len(codes)
    for a, b, weight in _PAIRS:
        if n <= b:
            break
        same = np.flatnonzero(own[: n - b] == own[b:])
        x, y, z = codes[same], codes[same + a], codes[same + b]
        some = (x > 0) & (y > 0) & (z > 0)
        same, x, y, z = same[some], x[some], y[some], z[some]
        yield own[same], (x * LETTERS + y) * LETTERS + z, weight


def lengths(words: list[str]) -> np.ndarray:
    """The length of each word's vector of triple weights. Equal triples within a word, which are rare, count apart."""
    out = np.full(len(words), 1e-18)
    for own, _, weight in triples(words):
        out += np.bincount(own, minlength=len(words)) * weight**2
    return np.sqrt(out)


def features(words: list[str]) -> np.ndarray:
    """The triple weights of a few words at unit length, one row each."""
    out = np.zeros((len(words), LETTERS**3), np.float32)
    for own, code, weight in triples(words):
        np.add.at(out, (own, code), weight)
    return out / lengths(words)[:, None].astype(np.float32)


def kernels(words: list[str], marks: np.ndarray) -> np.ndarray:
    """The kernels of words with the landmarks whose features are given, by looking up each word's own triples only."""
    by_triple = np.ascontiguousarray(marks.T)
    out = np.zeros((len(words), len(marks)))
    for i in range(0, len(words), 1000):
        part = words[i : i + 1000]
        squares = np.full(len(part), 1e-18)
        for own, code, weight in triples(part):
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            if len(own):
                out[i + own[first]] += np.float32(weight) * np.add.reduceat(by_triple[code], first)
                squares += np.bincount(own, minlength=len(part)) * weight**2
        out[i : i + 1000] /= np.sqrt(squares)[:, None]
    return out


def folded(words: list[str], table: np.ndarray) -> np.ndarray:
    """The sum of ``table`` over each word's weighted triples, over its length: the machine's value, but for its offset."""
    out, squares = np.zeros(len(words)), np.full(len(words), 1e-18)
    for own, code, weight in triples(words):
        out += np.bincount(own, table[code], len(words)) * weight
        squares += np.bincount(own, minlength=len(words)) * weight**2
    return out / np.sqrt(squares)


class Machine:
    """The first machine's table; the landmarks' triple weights, of the triples that they have; the value above which a word is suspect; the second machine's weights; slope and offset to a probability."""

    def __init__(self, table: np.ndarray, marks: np.ndarray, cut: float, weights: np.ndarray, slope: float, offset: float):
        self.table, self.cut, self.weights, self.slope, self.offset = table.astype(np.float32), cut, weights, slope, offset
        self.codes = np.flatnonzero(marks.any(0))
        self.marks = np.ascontiguousarray(marks[:, self.codes])

    @classmethod
    def constant(cls, share: float) -> Machine:
        share = float(np.clip(share, 1e-6, 1 - 1e-6))
        return cls(np.zeros(LETTERS**3), np.zeros((0, LETTERS**3), np.float32), 0.0, np.zeros(0), 0.0, float(np.log(share / (1 - share))))

    def rows(self, texts: list[Counter]) -> np.ndarray:
        """A row for each text, whose words are given: for each landmark the greatest kernel, squared and to the fourth, and the root of the share of words like it."""
        n = len(self.marks)
        out = np.zeros((len(texts), 3 * n))
        words = list(set().union(*texts)) if texts and n else []
        if not words:
            return out
        suspect = np.flatnonzero(folded(words, self.table) > self.cut).tolist()
        number = {words[i]: k for k, i in enumerate(suspect)}
        marks = np.zeros((n, LETTERS**3), np.float32)
        marks[:, self.codes] = self.marks
        like = np.clip(kernels(list(number), marks), 0, 1) ** 2
        for row, text in zip(out, texts, strict=True):
            if found := text.keys() & number.keys():
                which, times = [number[w] for w in found], np.array([text[w] for w in found])
                row[:n] = like[which].max(0)
                row[n : 2 * n] = row[:n] ** 2
                row[2 * n :] = np.sqrt(50 * (like[which] ** 2 * times[:, None]).sum(0) / (sum(text.values()) + 20))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        value = self.rows([words_of(t) for t in texts]) @ self.weights if len(self.weights) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 3000.0, steps: int = 500) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Nesterov's gradient steps. y is -1 or 1."""
    xb = np.c_[x, np.ones(len(x))]
    w = v = np.zeros(xb.shape[1])
    step = 1 / (1 + 2 * c * np.linalg.eigvalsh(xb.T @ (xb * weight[:, None]))[-1] / weight.sum())
    for i in range(steps):
        slack = np.maximum(0, 1 - y * (xb @ v))
        grad = np.r_[v[:-1], 0] - 2 * c * (xb.T @ (weight * y * slack)) / weight.sum()
        new = v - step * grad
        v, w = new + i / (i + 3) * (new - w), new
    return w[:-1], float(w[-1])


def sureness(pos: list[Counter], neg: list[Counter]) -> dict[str, float]:
    """Of the words that tell toxic texts how surely: the lower bound, two deviations down, of the logarithm of their share of toxic texts over that of harmless ones, where it is over 0. Words of one or two letters don't count."""
    held, calm = Counter(w for b in pos for w in b if len(w) > 2), Counter(w for b in neg for w in b)
    bound = lambda a, b: float(np.log(a / (len(pos) + 1) * (len(neg) + 1) / b) - 2 * (1 / a + 1 / b) ** 0.5)
    sure = {w: bound(n + 0.5, calm[w] + 0.5) for w, n in held.items()}
    return {w: v for w, v in sure.items() if v > 0}


def train(texts: list[tuple[Counter, int]], landmarks: int = LANDMARKS, rounds: int = ROUNDS, first: int = FIRST, harder: int = HARDER) -> Machine:
    """Fit both machines on (words, label) of labelled texts. Texts of the same words count once; ties go by the alphabet.

    The first machine's rows are words: the ``landmarks`` surest, of each toxic text the one it calls worst among those that
    tell toxic texts (before the first round the surest), and of each harmless text the ``first`` words of least hash and each round's worst one.
    Its landmarks are the surest words, common ones for the last quarter, and each round ``harder`` harmless words that it
    called worst. The second machine's rows are all the texts, its landmarks the ``landmarks`` surest words. With one class only, with none, or
    without a word that tells, every score is the share of the toxic texts (0.5 for none).
    """
    texts = [(Counter(dict(b)), y) for y, b in sorted({(y, tuple(sorted(b.items()))) for b, y in texts})]
    pos, neg = [b for b, y in texts if y], [b for b, y in texts if not y]
    p, n = len(pos), len(neg)
    rank = sureness(pos, neg) if p and n else {}
    if not rank:
        return Machine.constant(p / len(texts) if texts else 0.5)
    surest = sorted(rank, key=lambda w: (-rank[w], w))
    calm = Counter(w for b in neg for w in b if len(w) > 2)
    marks = surest[: landmarks * 3 // 4] + sorted(calm.keys() - set(surest), key=lambda w: (-calm[w], w))[: landmarks // 4]
    every = sorted({w for b, _ in texts for w in b})
    worst = lambda b, value: max(sorted(w for w in b if w in value), key=value.__getitem__, default="")
    rows = [worst(b, rank) for b in pos]
    bounds = {w for b in neg for w in sorted((w for w in b if len(w) > 2), key=lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")))[:first]}
    for _ in range(rounds):
        z = features(marks)
        vals, vecs = np.linalg.eigh((z @ z.T).astype(float))
        root = vecs / np.sqrt(np.maximum(vals, 1e-3))  # whitens the kernels with the landmarks
        times = Counter([*(w for w in rows if w), *surest[:landmarks]])
        good = sorted(times)
        bad = sorted(bounds - set(good))
        x, y = kernels(good + bad, z) @ root, np.r_[np.ones(len(good)), -np.ones(len(bad))]
        share = np.array([times[w] ** 0.5 for w in good])
        weight = np.r_[share / share.sum(), np.full(len(bad), 1 / max(1, len(bad)))]
        w, _ = _svm(x, y, weight)
        fold = (z.T @ (root @ w).astype(np.float32)).astype(float)
        value = dict(zip(every, folded(every, fold).tolist(), strict=True))
        rows = [worst(b, {w: value[w] for w in rank.keys() & b.keys()}) for b in pos]
        hard = {w for b in neg if (w := worst(b, {w: value[w] for w in b if len(w) > 2}))}
        bounds |= hard
        marks += sorted(hard - set(marks), key=lambda w: (-value[w], w))[:harder]  # the machine needs directions to tell them apart
    machine = Machine(fold, features(surest[:landmarks]), float(np.quantile([value[w] for w in calm], 1 - SUSPECTS)) if calm else 0.0, np.zeros(0), 1.0, 0.0)
    x, y = machine.rows([*pos, *neg]), np.r_[np.ones(p), -np.ones(n)]
    machine.weights, _ = _svm(x, y, np.full(p + n, 1 / (p + n)), c=300.0, steps=300)
    machine.slope, machine.offset = _cut(x @ machine.weights, (y > 0).astype(float))
    return machine


def _cut(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset with 0.5 at the threshold of fewest errors, in the middle of its gap."""
    order = np.argsort(value, kind="stable")
    v, y = value[order], label[order]
    errors = np.r_[0, np.cumsum(y)] + (len(y) - y.sum()) - np.r_[0, np.cumsum(1 - y)]  # the first i are called harmless
    gaps = np.r_[0, v[1:] - v[:-1], 0]
    free = np.r_[True, v[1:] > v[:-1], True]
    best = min((i for i in range(len(v) + 1) if free[i]), key=lambda i: (errors[i], -gaps[i]))
    at = v[0] - 1e-3 if best == 0 else v[-1] + 1e-3 if best == len(v) else (v[best - 1] + v[best]) / 2
    slope = 4 / max(float(value.std()), 1e-6)
    return slope, -slope * float(at)


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, sample: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of at most ``sample`` rows of each class, by the hash of the id: labelled, and not held out.

    Of several labels of one id the greatest counts, of several rows the one whose text has the least hash. The sample of
    ids is bounded, and so may be broadcast.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (hash_mod("doc_id", mod) != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    part = lambda y: ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = cut(part(0).union(part(1)).withColumnRenamed("doc_id", "labelled_id"))
    rows = docs.select(column(id_col).alias("doc_id"), column(text).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id"))
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Train on a bounded sample, ``sample`` rows of each class, of the labelled rows whose crc32(id) mod 5 is not 0: only their words and counts come to the driver."""
    rows = labelled(docs, labels, label, 5, 0, sample, id_col, text)

    def run(batches):
        for b in batches:
            found = [sorted(words_of(t or "").items()) for t in b.column("text").to_pylist()]
            words, times = [" ".join(w for w, _ in f) for f in found], [[n for _, n in f] for f in found]
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(times, pa.list_(pa.int32())), b.column("y")], ["words", "times", "y"])

    got = rows.mapInArrow(run, "words string, times array<int>, y int").collect()
    return train([(Counter(dict(zip(map(sys.intern, r.words.split(" ")), r.times, strict=True)) if r.times else {}), r.y) for r in got])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): a row for each row of ``docs``. Null and empty texts score as texts without a bad word; whole texts are read, very long ones too; repeated rows and null ids stay, with equal scores; other columns are left behind; an empty table gives no rows."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = [machine.scores(texts[lo:hi]) for lo, hi in slices(texts)]
            yield pa.record_batch([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(column(id_col).alias("doc_id"), column(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
