"""Substring deduplication by content-defined chunking.

Every passage of ``least_words`` words has a key: the least of the rolling hashes of the
shorter word runs in it. A chunk is a stretch of neighbouring passages with one key, so an
insertion moves the chunks around it and no others, and equal passages always share a key,
in periodic text too. Under each key passages are compared by digest: the first place of a
passage keeps it, the others give it up, and neighbouring ones join to spans. Chunks of a key
meet in one task; the passages under a frequent key are dealt by digest and salted instead.

The rolling hash is a gear hash with an odd factor, which forgets nothing, so that the hash
of any stretch follows from two running sums. ``gear`` and ``chunk`` are the plain form in 16 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, free_name

MEAN = 32  # bytes in a chunk, on average
LEAST_WORDS = 51  # words of the shortest passage that counts
BITS = 16
GEAR = np.random.default_rng(20).integers(0, 1 << BITS, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, by doubling: the hash of 2k bytes is that of the last k plus that of the k before, shifted."""
    h = GEAR[data]
    k = 1
    while k < BITS:
        h[k:] += h[:-k] << np.uint16(k)
        k *= 2
    return h


def chunk(text: bytes, mean: int = MEAN) -> np.ndarray:
    """Ends of the chunks of a text, the last at its end. No least or greatest size: both would tie a chunk to what stands before it."""
    if not text:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(gear(np.frombuffer(text, np.uint8)) < (1 << BITS) // mean) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.r_[ends, len(text)]


WIDE = np.random.default_rng(21).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = 0x9E3779B97F4A7C15
SEGMENT = 1 << 20  # bytes hashed at a time
SHARE = 1 / 32  # of the documents, looked at for frequent keys
FREQUENT = 64  # chunks with one key among them that are no burden yet
NONE = np.zeros(0, np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, f, np.uint64)]) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
    return up, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def passages(data: np.ndarray, s: np.ndarray, e: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, digest) of the passage of ``least_words`` words from each word on that has so many after it. s, e: where words begin and end."""
    part = max(1, 2 * least_words // 5)
    up, down = _powers(1 << max(16, len(data).bit_length()))
    sums = np.r_[np.uint64(0), np.cumsum(WIDE[data] * up[: len(data)])]
    of = lambda k: _mixed((sums[e[k - 1 :]] - sums[s[: len(s) - k + 1]]) * down[s[: len(s) - k + 1]])
    key, have, want = of(part), 1, least_words - part + 1
    while have < want:
        step = min(have, want - have)
        key, have = np.minimum(key[:-step], key[step:]), have + step
    return key, of(least_words)


def _segments(text, least_words: int, segment: int):
    """(at, key, digest, begin, end) of the passages of a text in parts of ``segment`` bytes; at: words before the part, begin and end: bytes of each passage."""
    data = np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8)
    edge = np.flatnonzero(np.diff(~_BLANK[data], prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    at = 0
    while at + least_words <= len(starts):  # passages that begin at words from at to upto
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + segment)))
        last = min(upto + least_words - 1, len(starts))
        base = starts[at]
        s, e = starts[at:last], stops[at:last]
        key, digest = passages(data[base : e[-1]], s - base, e - base, least_words)
        yield at, key, digest, s[: len(key)], e[least_words - 1 :]
        at = upto


def _texts(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, str]:
    return docs.select(column(id_col).alias("doc_id"), F.xxhash64(column(text)).alias("place"), column(text).cast("binary").alias("text")), docs.schema[id_col].dataType.simpleString()


def occurrences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, segment: int = SEGMENT, leave: np.ndarray = NONE) -> DataFrame:
    """(key, doc_id, place, begin, end, word, width, digests, begins, ends): a row for each chunk whose key isn't one of ``leave``. begin, end: bytes of its first passage; word: words
    before it; digests: of each of its passages, 8 bytes; begins, ends: how far each passage's moved on, ``width`` bytes; place tells rows of one id apart."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows: list[list] = [[], [], [], [], [], []]
                blobs: list[list] = [[], [], []]
                sizes: list[list] = [[], []]
                for j, x in enumerate(part.column(2)):
                    for at, key, digest, begin, end in _segments(x, least_words, segment):
                        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                        held = np.diff(np.r_[first, len(key)])
                        moved = np.diff(begin, prepend=begin[0]), np.diff(end, prepend=end[0])
                        width = 1 if max(m.max() for m in moved) < 256 else 4
                        if len(leave):
                            stay = ~np.isin(key[first], leave)
                            each = np.repeat(stay, held)
                            first, held, digest, moved = first[stay], held[stay], digest[each], tuple(m[each] for m in moved)
                        for c, v in zip(rows, (np.full(len(first), j), key[first].view(np.int64), begin[first], end[first], at + first, np.full(len(first), width)), strict=True):
                            c.append(v)
                        blobs[0].append(digest.view(np.uint8))
                        for c, v in zip(blobs[1:], moved, strict=True):
                            c.append(v.astype(f"u{width}").view(np.uint8))
                        sizes[0].append(held * 8)
                        sizes[1].append(held * width)
                if rows[0]:
                    j, key, begin, end, word, width = (np.concatenate(c) for c in rows)
                    offsets = [np.r_[0, np.cumsum(np.concatenate(c))].astype(np.int32) for c in sizes]
                    packed = [pa.Array.from_buffers(pa.binary(), len(j), [None, pa.py_buffer(o), pa.py_buffer(np.concatenate(c))]) for c, o in zip(blobs, (offsets[0], offsets[1], offsets[1]), strict=True)]
                    take = pa.array(j)
                    yield pa.record_batch([pa.array(key), part.column(0).take(take), part.column(1).take(take), *(pa.array(v.astype(np.int32)) for v in (begin, end, word, width)), *packed], ["key", "doc_id", "place", "begin", "end", "word", "width", "digests", "begins", "ends"])

    texts, kind = _texts(docs, id_col, text)
    return texts.mapInArrow(run, f"key long, doc_id {kind}, place long, begin int, end int, word int, width int, digests binary, begins binary, ends binary")


def frequent(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, share: float = SHARE, rows: int = FREQUENT) -> np.ndarray:
    """Keys that would make a task long: in a random ``share`` of the documents more than ``rows`` chunks have them, and more than a quarter of what one
    shuffle partition holds on average, so there are at most four for each partition. It only decides how a key's passages meet; every passage of every document meets either way."""
    counts = cut(occurrences(docs.sample(share, seed=1), id_col, text, least_words).groupBy("key").count())
    least = (counts.agg(F.sum("count")).first()[0] or 0) / _limit(docs)
    got = counts.where(F.col("count") > F.lit(max(rows, least))).select("key").collect()
    return np.array([r.key for r in got], np.int64).view(np.uint64)


def _limit(docs: DataFrame) -> int:
    return 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def frequent_repeats(docs: DataFrame, keys: np.ndarray, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, most: int = 4096) -> DataFrame:
    """What ``repeats`` returns, a row for each passage, of the passages under ``keys``, a bounded number of keys.

    Each passage is a row of its own here. The first place of each is a minimum, combined before the shuffle, and goes back to the
    passage's places by a join, in as many salted copies as keep each at ``most`` places, or at a quarter of a partition's mean share if that is more.
    """

    def run(batches):
        for b in batches:
            for j, x in enumerate(b.column(2)):
                for at, key, digest, begin, end in _segments(x, least_words, SEGMENT):
                    i = np.flatnonzero(np.isin(key, keys))
                    if len(i):
                        take = pa.array(np.full(len(i), j))
                        yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), *(pa.array(v[i].view(np.int64)) for v in (key, digest)), *(pa.array(v.astype(np.int32)) for v in (begin[i], end[i], at + i))], names)

    texts, kind = _texts(docs, id_col, text)
    names = ["doc_id", "place", "key", "digest", "begin", "end", "word"]
    found = texts.mapInArrow(run, f"doc_id {kind}, place long, key long, digest long, begin int, end int, word int")
    passage = ["key", "digest"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place", "word")).alias("first")
    firsts = cut(found.groupBy(*passage).agg(first, F.count("*").alias("n")).where("n > 1"))
    most = max(most, (firsts.agg(F.sum("n")).first()[0] or 0) // _limit(docs))
    firsts = firsts.withColumn("salts", F.ceil(F.col("n") / most).cast("int"))
    salted = firsts.where("salts > 1").select(*passage, "salts")  # at most _limit rows
    dealt = found.join(F.broadcast(salted), passage, "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "place", "word"), F.coalesce("salts", F.lit(1))).cast("int"))
    copies = firsts.select(*passage, "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("place").eqNullSafe(F.col("first.place"))
    later = dealt.join(copies, [*passage, "salt"]).where(~(own & (F.col("word") < F.col("first.word") + least_words)))
    return later.select("doc_id", "place", "begin", "end", F.col("word").alias("w0"), (F.col("word") + least_words).cast("int").alias("w1"), F.col("first.doc_id").alias("kept_in"))


def _repeated(digests: bytes, doc: tuple, word: int, seen: dict, least_words: int) -> list[tuple[int, int, object]]:
    """(first, last, kept_in) of the runs of passages seen before; those not seen are noted. A passage that overlaps its own first place is no repeat."""
    out: list = []
    for i, d in enumerate(np.frombuffer(digests, np.uint64).tolist()):
        first = seen.setdefault(d, (doc, word + i))
        if first[0] == doc and word + i < first[1] + least_words:
            continue
        if out and out[-1][1] == i - 1:
            out[-1] = (out[-1][0], i, out[-1][2])
        else:
            out.append((i, i, first[0][0]))
    return out


def repeats(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, place, begin, end, w0, w1, kept_in) of the runs of passages in ``occurrences`` whose first place is elsewhere; w0, w1: words that begin before begin and end."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.withColumn("none", F.col("doc_id").isNull()).repartition("key").sortWithinPartitions("key", "none", "doc_id", "place", "begin")

    def run(batches):
        last, held, seen, whole, before = None, None, {}, {}, None

        def look(key, row):
            nonlocal last, seen, whole, before
            if key != last:
                last, seen, whole, before = key, {}, {}, None
            doc, begin, end, word, width, digests, begins, ends = row
            if before == (doc, word):  # a repeated row
                return []
            before = doc, word
            n = len(digests) // 8
            if whole.setdefault(digests, doc) != doc:
                found = [(0, n - 1, seen[int.from_bytes(digests[:8], "little")][0][0])]
            else:
                found = _repeated(digests, doc, word, seen, least_words)
            if not found:
                return []
            b, e = (np.cumsum(np.r_[0, np.frombuffer(x, f"u{width}")[1:].astype(np.int64)]) for x in (begins, ends))
            return [(*doc, begin + int(b[i]), end + int(e[k]), word + i, word + k + least_words, kept) for i, k, kept in found]

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            same = key[1:] == key[:-1]
            # of keys with one row nothing repeats but what the row itself repeats, and for that it must be long
            many = np.r_[held is not None and key[0] == held[0], same] | np.r_[same, True]
            size = np.diff(np.frombuffer(batch.column(7).buffers()[1], np.int32)[batch.column(7).offset :][: batch.num_rows + 1]) // 8
            take = np.flatnonzero(many | (size > least_words))
            part = batch.take(pa.array(take))
            cols = [part.column(i).to_pylist() for i in range(1, 10)]
            out = []
            for k, *row in zip(key[take].tolist(), *cols, strict=True):
                out += look(k, ((row[0], row[1]), *row[2:]))
            held = (int(key[-1]),)
            if out:
                types = [batch.schema.field("doc_id").type, pa.int64(), *[pa.int32()] * 4, batch.schema.field("doc_id").type]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "place", "begin", "end", "w0", "w1", "kept_in"])

    return dealt.drop("none").mapInArrow(run, f"doc_id {kind}, place long, begin int, end int, w0 int, w1 int, kept_in {kind}")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, share: float = SHARE, rows: int = FREQUENT) -> DataFrame:
    """(doc_id, begin, end, n_words, kept_in, place): spans that stand elsewhere already.

    begin and end are bytes of the UTF-8 text, n_words the words between them. Every passage of ``least_words`` words, the same
    from the first byte of its first word to the last of its last, counts; same is by key and digest, 64 bits each. Its first place, by doc_id (null last), then byte, is
    kept, and kept_in names the document of the span's first passage. A document that repeats a passage of its own, without
    overlap, is listed too. Null and shorter texts have no spans; repeated rows with one id and text count as one;
    an empty table gives no rows; other columns are left behind. A very long text goes in parts of SEGMENT bytes.
    Passages under frequent keys (``share``, ``rows``: see ``frequent``) are split over tasks; the result is the same.
    """
    keys = frequent(docs, id_col, text, least_words, share, rows)
    later = repeats(occurrences(docs, id_col, text, least_words, leave=keys), least_words)
    if len(keys):
        later = later.unionByName(frequent_repeats(docs, keys, id_col, text, least_words))
    w = Window.partitionBy("doc_id", "place").orderBy("begin", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(far.isNull() | (F.col("begin") > far), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    spans = later.groupBy("doc_id", "place", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), (F.max("w1") - F.min("w0")).alias("n_words"), F.min_by("kept_in", "begin").alias("kept_in"))
    return spans.select("doc_id", "begin", "end", F.col("n_words").cast("long").alias("n_words"), "kept_in", "place")


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``. A cut inside a letter of several bytes moves to its end; null stays null.

    Every row stays, repeated rows with the same cuts; texts without a repeated span, empty ones and short ones among them,
    stay as they are; other columns stay, whatever their names; an empty table gives no rows.
    """
    own, doc, place, held = (free_name(docs.columns, x) for x in ("own_place", "span_doc", "span_place", "span_list"))
    spans = cut(duplicates(docs, id_col, text, least_words)).groupBy(F.col("doc_id").alias(doc), F.col("place").alias(place)).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias(held))

    @F.pandas_udf("string")
    def without(texts, spans):
        return texts.to_frame("t").assign(s=spans).apply(lambda r: r.t if r.t is None or r.s is None else _without(r.t, r.s), axis=1) if len(texts) else texts

    marked = docs.withColumn(own, F.xxhash64(column(text)))
    out = marked.join(spans, column(id_col).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(place)), "left")
    return out.withColumn(text, F.when(F.col(held).isNull(), column(text)).otherwise(without(column(text), F.col(held)))).select(*[column(c) for c in docs.columns])


def _without(text: str, spans) -> str:
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for s in spans:
        begin, end = s["begin"], s["end"]
        while begin < len(raw) and raw[begin] & 0xC0 == 0x80:
            begin += 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        if begin >= at:
            out.append(raw[at:begin])
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
