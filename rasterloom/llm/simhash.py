"""SimHash near-duplicates with BK-trees.

A BK-tree's children are keyed by their Hamming distance to the parent, and a search
follows only the edges within the radius. Up to BROADCAST distinct fingerprints make one
tree, which is broadcast, and every fingerprint is looked up in it. All trees of a larger
corpus together are as large as the corpus' fingerprints, so they can't be broadcast: there
every fingerprint goes to four shards, by the value of each 16-bit band, and a shard's tree
lives where the shard is. Fingerprints that differ in at most three bits agree in a band, so
no pair is lost. A hot shard is split by the same argument on its remaining 48 bits, and one
that is still hot into blocks that meet pairwise.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, free_name

SHINGLE = 3
RADIUS = 3
SEED = 42
BROADCAST = 1 << 14  # distinct fingerprints, 8 bytes each, whose tree is broadcast
HOT = 512  # fingerprints of a shard beyond which its other bits split it
BLOCK = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' XXH64. No words: 0."""
    words = text.lower().split()  # on bytes: A-Z only, and the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - shingle + 1)
    hashed = xxhash.xxh64_intdigest
    starts = [0, *ends[: n - 1]]
    h = np.fromiter((hashed(joined[s : e - 1], SEED) for s, e in zip(starts, ends[len(words) - n :], strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, place, fp): place is a hash of the text that tells rows of one id apart. Null and empty texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            out = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in b.column(2)], np.uint64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out.view(np.int64))], ["doc_id", "place", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(column(id_col).alias("doc_id"), F.xxhash64(column(text)).alias("place"), column(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, place long, fp long")


class BKTree:
    """A tree over distinct 64-bit values, built and searched for many values at once.

    The first value is the root; the others hang below it, one child for each distance,
    and so on downwards. A search of a set of queries takes along each edge only those
    queries whose own distance to the node is within the radius of the edge.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[list[tuple[int, int]]] = [[] for _ in values]
        todo = [np.arange(len(values))] if len(values) else []
        while todo:
            part = todo.pop()
            root, rest = part[0], part[1:]
            if not len(rest):
                continue
            d = np.bitwise_count(values[rest] ^ values[root])
            order = np.argsort(d, kind="stable")
            rest, d = rest[order], d[order]
            cuts = np.flatnonzero(d[1:] != d[:-1]) + 1
            for group, edge in zip(np.split(rest, cuts), d[np.r_[0, cuts]], strict=True):
                self.children[root].append((int(edge), int(group[0])))
                todo.append(group)

    def links(self, queries: np.ndarray, radius: int):
        """Arrays (query index, value index) of all pairs within the radius."""
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, who = todo.pop()
            d = np.bitwise_count(queries[who] ^ self.values[node]).astype(np.int64)
            near = who[d <= radius]
            if len(near):
                yield near, node
            for edge, child in self.children[node]:
                go = who[np.abs(d - edge) <= radius]
                if len(go):
                    todo.append((child, go))


def spanning_links(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (value, smallest value of its class) that connect what the pairs within the radius connect, within these values."""
    values = np.sort(values)
    return _spanning(values, values, BKTree(values).links(values, radius))


def _spanning(queries: np.ndarray, values: np.ndarray, found) -> list[tuple[int, int]]:
    """Links (value, smallest value of its class) that connect what ``found``, arrays of (query index, value index), connects."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.get(v, v)) != v:
            parent[v] = parent.get(up, up)
            v = up
        return v

    for near, node in found:
        b = root(int(values[node]))
        for q in queries[near].tolist():
            a = root(q)
            if a != b:
                parent[max(a, b)] = min(a, b)
                b = min(a, b)
    return [(v, root(v)) for v in list(parent)]


def _band(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _rest(fp: Column, band: int) -> Column:
    """The 48 bits that are not in the band."""
    low = F.lit((1 << (16 * band)) - 1)
    return F.shiftleft(F.shiftrightunsigned(fp, 16 * band + 16), 16 * band).bitwiseOR(fp.bitwiseAND(low)) if band < 3 else fp.bitwiseAND(low)


def links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT, block: int = BLOCK, broadcast: int = BROADCAST) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that span every class. All pairs within the radius are found; radius 3 at most."""
    if radius > 3:
        raise ValueError("four bands find pairs of up to three differing bits")
    few = prints.select("fp").limit(broadcast + 1).toPandas()["fp"].to_numpy(np.int64) if broadcast else []
    if 0 < len(few) <= broadcast:
        return _tree_links(prints, np.sort(few.view(np.uint64)), radius)
    fp = F.col("fp")
    bands = F.array(*[F.struct(F.lit(k).alias("band"), _band(fp, 16 * k, 16).alias("value"), _rest(fp, k).alias("rest")) for k in range(4)])
    rows = prints.select("fp", F.explode(bands).alias("s")).select("fp", F.col("s.band").alias("band"), F.col("s.value").alias("value"), F.col("s.rest").alias("rest"))
    sized = lambda df, *key: df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sized(rows, "band", "value"), ["band", "value"])
    subs = F.array(*[F.struct(F.lit(k).alias("sub"), _band(F.col("rest"), 12 * k, 12).alias("subvalue")) for k in range(4)])
    cold = rows.where(F.col("n") <= hot).select("fp", "band", "value", F.lit(-1).alias("sub"), F.lit(0).alias("subvalue"), F.lit(0).alias("p"), F.lit(0).alias("q"))
    keys = ["band", "value", "sub", "subvalue"]
    split = rows.where(F.col("n") > hot).select("fp", "band", "value", F.explode(subs).alias("s")).select("fp", "band", "value", "s.sub", "s.subvalue")
    split = split.join(sized(split, *keys), keys)
    blocks = F.ceil(F.col("n") / block).cast("int")
    split = split.withColumn("own", F.pmod(F.hash("fp"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    split = split.select("fp", *keys, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    keys = [*keys, "p", "q"]
    dealt = cold.unionByName(split).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        last, held = None, []

        def close():
            found = spanning_links(np.unique(np.concatenate(held)), radius) if sum(map(len, held)) > 1 else []
            return found

        found: list[tuple[int, int]] = []
        for b in batches:
            key = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fps):
                continue
            cuts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, len(fps)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                this = tuple(key[:, lo].tolist())
                if this != last and held:
                    found += close()
                    held = []
                last = this
                held.append(fps[lo:hi])
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        if held:
            found += close()
        if found:
            yield _pairs(found)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _tree_links(prints: DataFrame, values: np.ndarray, radius: int) -> DataFrame:
    """The links by one tree of all ``values``, a bounded number, broadcast."""
    tree = prints.sparkSession.sparkContext.broadcast(BKTree(values))

    def run(batches):
        for b in batches:
            queries = b.column(0).to_numpy().view(np.uint64)
            found = _spanning(queries, tree.value.values, tree.value.links(queries, radius))
            if found:
                yield _pairs(found)

    return prints.select("fp").mapInArrow(run, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(found, np.uint64).view(np.int64)
    return pa.record_batch([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges(a, b)``; root is the smallest node of its component.

    Alternates large-star and small-star steps until every node has one edge, to a node that has none upwards; each
    round's edges go to the checkpoint folder. Both steps are a grouped minimum and a join, never a gathered neighbour list.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        ends = now.groupBy("u").agg(F.count("*").alias("n"))
        # a node that is an upper end and not once, or that another node's edge leads to, is no leaf of a star
        loose = ends.where("n > 1").select("u").union(ends.select("u").join(now.select(F.col("v").alias("u")), "u", "left_semi"))
        if not loose.limit(1).count():
            break
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v")
        now = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id, place): a row for each row of ``docs``.

    Null and empty texts and texts of blanks have fingerprint 0 and link as any other. component_id is the
    smallest doc_id reachable; null ids take part but never name a component unless it has no other.
    A very long text is read whole by one task. Repeated rows stay; an empty table gives no rows; other columns are left behind.
    """
    return _rooted(docs, id_col, text, shingle, radius).drop("root")


def _rooted(docs: DataFrame, id_col: str, text: str, shingle: int, radius: int) -> DataFrame:
    """``near_duplicates`` with the root, which names a component of rows without ids too."""
    own = cut(fingerprints(docs, id_col, text, shingle))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = cut(links(distinct.select("fp"), radius))
    groups = components(found)
    named = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = cut(named.join(least, "root").select("fp", "component_id", "root"))
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "place", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of the smallest id stays (then the smallest text hash), once.

    All columns are kept, whatever their names. Null, empty and blank texts are one component; of rows without ids one
    stays for each component that has no id; of repeated rows one stays; an empty table gives no rows.
    """
    all_ = _rooted(docs, id_col, text, shingle, radius)
    first = all_.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("s"))
    # components without any id share a null component_id: tell them apart by root
    none = all_.where("component_id is null").groupBy("root").agg(F.min("place").alias("place")).select(F.lit(None).cast(docs.schema[id_col].dataType).alias("doc_id"), "place")
    keep = first.where("component_id is not null").select("s.doc_id", "s.place").union(none)
    held, place, nth = (free_name(docs.columns, x) for x in ("held_id", "held_place", "nth"))
    keep = keep.select(F.col("doc_id").alias(held), F.col("place").alias(free_name([*docs.columns, held, place], "p")))
    out = docs.withColumn(place, F.xxhash64(column(text))).join(keep, column(id_col).eqNullSafe(F.col(held)) & (F.col(place) == F.col(keep.columns[1])), "left_semi")
    repeated = all_.groupBy("doc_id", "place").count().where("count > 1").limit(1).count()
    if repeated:
        w = Window.partitionBy(column(id_col), place).orderBy(F.lit(0))
        out = out.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)
    return out.drop(place)
