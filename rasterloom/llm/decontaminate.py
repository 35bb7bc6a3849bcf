"""Benchmark decontamination by suffix arrays of the training text.

A slice of a task's documents is a shard. Its suffix array holds every place in a run of
benchmark words that is long enough for a window (no other place can match), sorted by the
words that follow. It is built by prefix doubling, and the names of the 1, 2, 4, ... words
after each place are kept. Every suffix of every test item is looked up by binary search:
each step narrows an interval of the array by the next 2**j words, so it ends with the
window's places; the names then tell how many words each place goes on to share with the item.

The test items are a stated query set. Up to BLOCK_WORDS of their words go out at once, and
the documents are read once for each such block; what is found is merged.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, slices

WINDOW = 13
BLOCK_WORDS = 4_000_000  # 16 MB of numbers, and a vocabulary
SHARD = 1 << 22  # bytes of text in a shard, about
#: Words are runs of 0-9, a-z and whatever is not ASCII, after lower-casing A-Z; all else becomes a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GAP = b" | "  # between documents: no word has this sign


_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("begin", pa.int64()), ("item_begin", pa.int64()), ("words", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Block:
    """Some test items: one row of word numbers, 0 after each item, and of each window its place, size, item and place in the item."""

    def __init__(self, window: int = WINDOW):
        self.window, self.number = window, {_GAP.strip(): -1}
        self.items: list[str] = []
        self._words, self._sizes = array("i"), array("q")

    def __len__(self) -> int:
        return len(self._words)

    def add(self, name: str, words: list[bytes]) -> None:
        if words:
            self.items.append(name)
            self._sizes.append(len(words))
            self._words.extend(self.number.setdefault(w, len(self.number)) for w in words)
            self._words.append(0)

    def close(self) -> dict:
        """What goes out to the tasks."""
        size = np.array(self._sizes, np.int64)
        begin = np.cumsum(size + 1) - size - 1
        many = np.maximum(1, size - self.window + 1)
        owner = np.repeat(np.arange(len(size)), many)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        return {"words": np.array(self._words, np.int64), "number": self.number, "items": self.items, "longest": int(size.max(initial=1)), "least": int(np.minimum(size, self.window).min(initial=self.window)), "start": begin[owner] + place, "size": np.minimum(size, self.window)[owner], "owner": owner, "place": place}


class SuffixArray:
    """The places of the words ``ids`` in runs of ``least`` benchmark words or more (number over 0), sorted by the ``depth`` words that follow.

    names[j] names the 2**j words from each place on, in their order; keys[j] are the pairs of names that names[j + 1] stands for.
    """

    def __init__(self, ids: np.ndarray, least: int, depth: int, vocabulary: int):
        edge = np.flatnonzero(np.diff(ids > 0, prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        begin, end = begin[end - begin >= least], end[end - begin >= least]
        size = end - begin + 1  # with the 0 behind
        stop = np.cumsum(size)
        self.at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - size), size)
        n = len(self.at)
        words = ids[np.minimum(self.at, len(ids) - 1)] if n else np.zeros(0, np.int64)
        words[stop - 1] = 0
        levels = max(0, (depth - 1).bit_length())
        pad = np.zeros(2 << levels, np.int64)
        self.names, self.keys, array_ = [np.r_[words, pad]], [], np.argsort(words, kind="stable")
        for j in range(levels):
            name, factor = self.names[j], max(vocabulary, n) + 2
            key = name[:n] * factor + name[1 << j : n + (1 << j)]
            array_ = np.argsort(key, kind="stable")
            low = key[array_]
            new = np.r_[True, low[1:] != low[:-1]] if n else np.zeros(0, bool)
            name = np.zeros(n + len(pad), np.int64)
            name[array_] = np.cumsum(new)
            self.names.append(name)
            self.keys.append((factor, low[new]))
        self.array = array_[words[array_] > 0]

    def named(self, words: np.ndarray) -> list[np.ndarray]:
        """The names of the 2**j words from each place of ``words`` on; 0 or less where the shard doesn't have them."""
        out = [words]
        for j, (factor, keys) in enumerate(self.keys):
            a, name = out[j], np.zeros(len(words), np.int64)
            some = np.flatnonzero((a[: len(a) - (1 << j)] > 0) & (a[1 << j :] > 0)) if len(a) > 1 << j else np.zeros(0, np.int64)
            key = a[some] * factor + a[some + (1 << j)]
            i = np.searchsorted(keys, key)
            hit = keys[np.minimum(i, len(keys) - 1)] == key if len(keys) else np.zeros(len(key), bool)
            name[some[hit]] = i[hit] + 1
            out.append(name)
        return out

    def narrow(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, level: int, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each interval of the array the part whose places go on, ``depth`` words later, with the words called ``name``."""
        names = self.names[level]

        def bound(low, high, after):
            low, high = low.copy(), high.copy()
            while (open_ := low < high).any():
                mid = (low + high) >> 1
                has = names[self.array[np.minimum(mid, len(self.array) - 1)] + depth]
                before = (has <= name) if after else (has < name)
                low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
            return low

        low = bound(low, high, False)
        return low, bound(low, high, True)

    def find(self, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, item, place in the item, words shared from there on) of every occurrence of a window of the block."""
        none = np.zeros(0, np.int64)
        if not len(self.array):
            return none, none, none, none, none
        named = self.named(block["words"])
        start, size = block["start"], block["size"]
        ask = np.arange(len(start))
        for j in range(len(named)):  # windows that lack a first stretch of 2**j words have no place
            ask = ask[(size[ask] < 1 << j) | (named[j][start[ask]] > 0)]
        start, size = start[ask], size[ask]
        low, high, depth = np.zeros(len(ask), np.int64), np.full(len(ask), len(self.array)), np.zeros(len(ask), np.int64)
        for j in reversed(range(len(named))):
            step = np.flatnonzero(size >> j & 1 & (low < high))
            name = named[j][start[step] + depth[step]]
            low[step], high[step] = self.narrow(low[step], np.where(name > 0, high[step], low[step]), depth[step], j, name)
            depth[step] += 1 << j
        many = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(ask)), many)
        place = self.array[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(which))]
        shared, begin, at = size[which], start[which], self.at[place]
        for j in reversed(range(len(named))):
            item = np.minimum(begin + shared, len(block["words"]) - 1)
            shared = shared + ((named[j][item] > 0) & (self.names[j][place + shared] == named[j][item])).astype(np.int64) * (1 << j)
        return at, size[which], block["owner"][ask][which], block["place"][ask][which], shared


def _merge(spans: np.ndarray) -> np.ndarray:
    """Union of [begin, end) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > far[:-1]]
    return np.c_[spans[new, 0], far[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]]


def _longest(at: np.ndarray, item: np.ndarray, place: np.ndarray, words: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """(document, item, begin, place in the item, words) of the longest match of each document with each item, the first of equals."""
    order = np.lexsort((place, at, -words, item, doc))
    at, item, place, doc, words = (x[order] for x in (at, item, place, doc, words))
    best = np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])] if len(at) else np.zeros(0, bool)
    return [x[best] for x in (doc, item, at, place, words)]


def _pass(df: DataFrame, block: dict) -> DataFrame:
    """Add one block's findings: n_words, spans (flat begin and end of hit words, merged), matches (the longest with each item), items."""
    shared = df.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_WORDS words and one item more
    names = [x.name for x in df.schema.fields]

    def run(batches):
        block = shared.value
        get = block["number"].get
        for b in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(names.index("__text"))]
            spans, items = b.column(names.index("__spans")).to_pylist(), b.column(names.index("__items")).to_pylist()
            matches = [m or [] for m in b.column(names.index("__matches")).to_pylist()]
            counts: list[int] = []
            for lo, hi in slices(texts, SHARD):
                words = _GAP.join(t.translate(_TABLE) for t in [*texts[lo:hi], b""]).split()
                ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
                ends = np.flatnonzero(ids < 0)
                begins = np.r_[0, ends[:-1] + 1]
                counts += (ends - begins).tolist()
                at, size, item, place, long = SuffixArray(ids, block["least"], block["longest"], len(block["number"])).find(block)
                doc = np.searchsorted(ends, at)
                for k, i, begin, begins_at, n in zip(*(x.tolist() for x in _longest(at, item, place, long, doc)), strict=True):
                    matches[lo + k].append({"item": block["items"][i], "begin": begin - int(begins[k]), "item_begin": begins_at, "words": n})
                order = np.argsort(doc, kind="stable")
                at, size, item, doc = at[order], size[order], item[order], doc[order]
                cuts = [*np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]).tolist(), len(doc)] if len(doc) else []
                for s, e in pairwise(cuts):
                    k = int(doc[s])
                    own = np.c_[at[s:e], at[s:e] + size[s:e]] - begins[k]
                    old = np.array(spans[lo + k] or [], np.int64).reshape(-1, 2)
                    spans[lo + k] = _merge(np.r_[old, own]).ravel().tolist()
                    items[lo + k] = sorted({*(items[lo + k] or []), *(block["items"][i] for i in np.unique(item[s:e]))})
            cols = {n: b.column(i) for i, n in enumerate(names)}
            cols |= {"__n_words": pa.array(counts, pa.int64()), "__spans": pa.array(spans, pa.list_(pa.int64())), "__items": pa.array(items, pa.list_(pa.string())), "__matches": pa.array(matches, _MATCHES)}
            yield pa.record_batch(list(cols.values()), list(cols))

    return df.mapInArrow(run, df.schema)


def find(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """What each row of ``docs`` shares with the benchmark.

    Returns doc_id (or the columns ``keep``), n_words, n_hit, n_items, items_sha256, contaminated, longest (words
    of the longest verbatim match, 0 without one), spans (begin and end of every run of hit words, in words), items, and
    matches (for each item the longest verbatim match: its place in document and item, and its words). A row is contaminated if it has hits and they are
    a twentieth of its words or more. Null and empty texts have no words and no hits, as have items without
    words; an item without an id is named by the empty string; repeated items count once, repeated rows stay;
    an empty benchmark leaves every row clean, an empty table gives no rows. A very long text is a shard of its own, whole.
    Of equally long matches with an item the first in the document counts. Other columns of ``docs`` are left behind.
    """
    keep = keep or [id_col]
    df = docs.select(*[column(c) for c in keep], column(text).cast("binary").alias("__text"), F.lit(0).cast("long").alias("__n_words"), F.lit(None).cast("array<bigint>").alias("__spans"), F.lit(None).cast("array<string>").alias("__items"), F.lit(None).cast("array<struct<item:string,begin:bigint,item_begin:bigint,words:bigint>>").alias("__matches"))
    block, any_ = Block(window), False
    for row in bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t")).distinct().orderBy("i", "t").toLocalIterator():
        if len(block) >= BLOCK_WORDS:  # a further block: what the one before found is written, so that a task never holds two
            df, block, any_ = cut(_pass(df, block.close())), Block(window), True
        block.add(row.i, words_of(row.t.encode("utf-8", "surrogatepass")))
    if len(block) or not any_:
        df = _pass(df, block.close())
    hits = F.aggregate("__spans", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("f")), lambda a, x: F.struct((a["s"] + x * a["f"]).alias("s"), (-a["f"]).alias("f")), lambda a: a["s"])
    df = df.withColumn("__hit", F.coalesce(hits, F.lit(0).cast("long"))).withColumn("__items", F.coalesce("__items", F.array().cast("array<string>")))
    return df.select(
        *([column(id_col).alias("doc_id")] if keep == [id_col] else [column(c) for c in keep]),
        F.col("__n_words").alias("n_words"),
        F.col("__hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("__hit") > 0) & (20 * F.col("__hit") >= F.col("__n_words"))).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("__matches", lambda m: m["words"])), F.lit(0).cast("long")).alias("longest"),
        F.coalesce("__spans", F.array().cast("array<bigint>")).alias("spans"),
        F.col("__items").alias("items"),
        F.col("__matches").alias("matches"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names. Null, empty, long and repeated texts as in ``find``."""
    found = find(docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]), bench, f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text)}", window, [f"c{i}" for i in range(len(docs.columns))])
    return found.where("not contaminated").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
