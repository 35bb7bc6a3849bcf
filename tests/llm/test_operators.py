"""Every operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import base64
import hashlib
import random
import re
import struct

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import chat, chunks, common, decontaminate, media, mixing, pii, quality, simhash, strings, warc

LONG = " ".join(f"word{i % 977}" for i in range(20_000))
COPY = "The quick brown fox jumps over the lazy dog while seven wizards mix a potion of green tea leaves and salt"
DOCS = [
    (1, "a b c d e f g", "s1", 9, "x"),
    (2, "A b  C\td e f g", "s1", 9, "x"),
    (3, None, "s2", None, None),
    (4, "", None, 0, "y"),
    (5, " \n\t ", "s2", 1, None),
    (6, "one", "", 2, "z"),
    (7, LONG, "s1", 3, "z"),
    (7, LONG, "s1", 3, "z"),
    (8, COPY, "s3", 3, "z"),
    (9, COPY + ".", "s3", 3, "z"),
    (None, COPY, "s3", 3, "z"),
    (10, "Grüße é ü mail a.b@c-d.example.org 4111 1111 1111 1111 +1 (555) 010-9999, 10.0.0.255 10.0.0.256", None, 3, "z"),
]
SCHEMA = "doc_id long, text string, source string, SIZE int, place string"
ROWS = [(d[0], d[1]) for d in DOCS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def key(x):
    return sorted(x, key=str)


def test_sainte_lague():
    assert mixing.sainte_lague([53, 24, 23], 7, [9, 9, 9]) == [3, 2, 2]
    assert mixing.sainte_lague([100, 1, 1], 10, [4, 9, 9]) == [4, 3, 3]
    assert mixing.sainte_lague([0, 5], 3, [5, 5]) == [0, 3]
    rng = random.Random(1)
    for _ in range(50):
        votes, caps = [rng.randint(0, 50) for _ in range(6)], [rng.randint(0, 8) for _ in range(6)]
        seats, got = rng.randint(0, 20), [0] * 6
        for _ in range(seats):  # the definition: each seat to the highest quotient
            open_ = [i for i in range(6) if got[i] < caps[i] and votes[i]]
            if not open_:
                break
            got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
        ours = mixing.sainte_lague(votes, seats, caps)
        assert sum(ours) == sum(got) and all(abs(a - b) <= 1 for a, b in zip(ours, got, strict=True))


def test_mix(spark, docs, none):
    out = mixing.mix(docs).collect()
    assert len(out) == len(DOCS) and mixing.mix(none).count() == 0
    assert key((r.doc_id, r.size) for r in out) == key((d, len((t or "").split())) for d, t in [(a, (b or "").replace(" ", "_")) for a, b in ROWS])
    total = sum(r["size"] for r in out)
    want = {r.source: r.target for r in out}
    assert abs(sum(want.values()) - 1.5 * total) < 1e-6
    for s in want:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - want[s]) <= max(64, 0.01 * want[s])
        assert all(0 <= r.taken <= 2 * r["size"] for r in own)
    assert rows(mixing.mix(docs.repartition(7))) == rows(mixing.mix(docs))
    wide = mixing.mix(docs, carry=True)
    assert wide.columns == ["doc_id", "text", "source", "SIZE", "place", "_size", "source_size", "target", "taken"]
    assert key((r.doc_id, r.taken) for r in wide.collect()) == key((r.doc_id, r.taken) for r in out)


def test_ogg(docs, none):
    out = media.from_ogg(media.to_ogg(docs)).collect()
    assert key((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == key((d, *brute.payload(t)) for d, t in ROWS)
    assert media.from_ogg(media.to_ogg(none)).count() == 0
    same = {r.media_sha256 for r in out if r.doc_id == 7}
    assert len(same) == 1


@pytest.mark.parametrize("size", [0, 1, 254, 255, 256, 510, 575, 576, 65_025, 200_000])
def test_ogg_packets(size):
    packet = bytes(i * 7 % 256 for i in range(size))
    pages = media.write_stream([(b"head", 0), (packet, 5), (b"", 9)], 3)
    assert [p for p, _ in media.demultiplex(b"".join(pages))[3]] == [b"head", packet, b""]
    data = bytearray(media.encode(packet))
    assert media.decode(bytes(data))[0].startswith(packet)
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(data))


def test_ogg_cut_off():
    """A container without its last pages, or with a page behind the last, is an error, as is padding that doesn't fit."""
    data = media.encode(bytes(200_000))
    at = [i for i in range(len(data)) if data.startswith(b"OggS", i)]
    for bad in (data[: at[-1]], data[: at[1]], data + data[at[-1] :], b""):
        with pytest.raises(ValueError):
            media.decode(bad)
    pages = media.write_stream([(b"PCM8" + struct.pack("<IHH", 8000, 576, 1), 0), (bytes(576), 576)], media.SAMPLES)
    length = lambda n: media.write_stream([(b"LEN8" + struct.pack("<Q", n), 0)], media.LENGTH)
    assert media.decode(b"".join([*pages, *length(576)]))[1] == 576
    for n in (577, 570, 0):
        with pytest.raises(ValueError):
            media.decode(b"".join([*pages, *length(n)]))


def test_ogg_checksum_known():
    def slow(page):
        crc = 0
        for b in page:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        return crc

    for n in (0, 1, 27, 300):
        page = bytes(i * 31 % 256 for i in range(n))
        assert media.page_crc(page) == slow(page)


def test_simhash(docs, none):
    prints = brute.fingerprints(ROWS)
    want = brute.components([d for d, _ in ROWS], prints)
    out = simhash.near_duplicates(docs)
    assert key((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()) == key((d, f"{p:016x}", c) for (d, _), p, c in zip(ROWS, prints, want, strict=True))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert key(r.doc_id for r in kept.collect()) == key({c for c in want})


def test_one_of_each_without_ids(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = {}
    for i in range(400):  # one word changed each: near copies of different fingerprints
        t = " ".join([*words[:i], "changed", *words[i + 1 :]])
        texts.setdefault(brute.fingerprints([(0, t)])[0], t)
    near = next([texts[a], texts[b]] for a in texts for b in texts if 0 < (a ^ b).bit_count() <= 3)
    apart = "something else altogether that stands alone"
    df = spark.createDataFrame([(None, t) for t in [*near, apart]], "doc_id long, text string")
    kept = [r.text for r in simhash.one_of_each(df).collect()]
    assert len(kept) == 2 and apart in kept
    assert simhash.near_duplicates(df).columns == ["doc_id", "fingerprint", "component_id", "place"]


def test_clashing_names(spark):
    """Columns named like those the operators add, with dots and in other cases, come through as they were."""
    names = ["__place", "k_", "p_", "s_", "d_", "__p", "own_place", "Span_Doc", "held_id", "nth", "a.b", "__text", "c0", "taken", "place"]
    table = [(i, t, "s", *[f"{n}{i}" for n in names]) for i, t in enumerate([COPY * 4, COPY * 4, "x", None, "", COPY * 4 + " end", LONG])]
    df = spark.createDataFrame(table + table[-1:], ["doc.id", "the.text", "source", *names])
    ids = {"id_col": "doc.id", "text": "the.text"}
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    machine = quality.train([(quality.describe(b"good text"), 1), (quality.describe(b"BAD!"), 0)])
    for out, same in ((simhash.one_of_each(df, **ids), True), (chunks.remove(df, **ids), False), (decontaminate.decontaminate(df, bench, **ids), True), (pii.redact(df, "the.text"), False), (quality.accepted(df, machine, "the.text", 0.0), True)):
        assert out.columns == df.columns
        was = {r[0]: tuple(r) for r in df.collect()}
        for r in out.collect():
            assert tuple(r)[2:] == was[r[0]][2:] and (not same or r[1] == was[r[0]][1])
    mixed = mixing.mix(df, **ids, carry=True)
    assert mixed.columns == [*df.columns, "size", "source_size", "target", "_taken"] and mixed.count() == 8
    assert pii.detect(df, **ids).count() == strings.score(df, strings.train([]), **ids).count() == media.from_ogg(media.to_ogg(df, **ids)).count() == quality.score(df, machine, **ids).count() == 8


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    machine = quality.train([])
    for out in (simhash.one_of_each(none), chunks.remove(none), decontaminate.decontaminate(none, bench), pii.redact(none), quality.accepted(none, machine)):
        assert out.columns == none.columns and out.count() == 0
    assert quality.score(none, machine).count() == strings.score(none, strings.train([])).count() == pii.summary(pii.detect(none)).count() == mixing.mix(none, carry=True).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert strings.fit(none, labels).scores([""])[0] == pytest.approx(0.5) and quality.fit(none, labels).margins([quality.describe(b"")])[0] == pytest.approx(0)


def test_sample_is_bounded(spark):
    """One labelled id with many rows brings one row to the driver."""
    df = spark.range(5000).select((F.col("id") * 0 + 3).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None)], "doc_id long, toxic int")
    assert [(r.doc_id, r.y) for r in strings.labelled(df, labels, "toxic", 5, 0, 2000).collect()] == [(3, 1)]


def test_links_find_all(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(120)} | {rng.getrandbits(64) for _ in range(200)}
    values = sorted(values)
    want = brute.components(values, values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for hot, block, broadcast in ((10**9, 10**9, 0), (20, 15, 0), (20, 15, 10**6)):  # the last by one broadcast tree
        groups = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(df, hot=hot, block=block, broadcast=broadcast)).collect()}
        classes, ours = {}, {}
        for v, w in zip(values, want, strict=True):
            classes.setdefault(w, set()).add(v)
            ours.setdefault(groups.get(v, v), set()).add(v)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, ours.values()))


def test_bk_tree():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 1 << 16, 300, dtype=np.uint64)
    found = {(int(q), n) for near, n in simhash.BKTree(v).links(v, 3) for q in near}
    assert found == {(i, j) for i in range(300) for j in range(300) if int(v[i] ^ v[j]).bit_count() <= 3}


def test_warc(spark):
    tricky = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", tricky), (6, "u", "x" + tricky + "WARC/1.0"), (6, "u", "x" + tricky + "WARC/1.0"), (7, "u", "WARC/1.0\r\n"), (-8, "u", LONG), (9, "u", LONG), (None, "u", "alone"), (None, "u", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = warc.archive_path(spark)
    warc.write(df.repartition(2), path)
    out = warc.read(spark, path, "bigint").select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(out) == key(brute.warc([(p, h) for p, _, h in pages]))
    path = warc.archive_path(spark)
    warc.write(df.limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_warc_ids(spark):
    pages = [("a1", "same"), ("a2", "same"), ("x>\r\ny %", "same"), ("", "other"), ("é", None), (None, "third")]
    path = warc.archive_path(spark)
    warc.write(spark.createDataFrame([(p, "u", h) for p, h in pages], "page_id string, url string, html string"), path)
    out = warc.read(spark, path).select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(out) == key(brute.warc(pages))
    assert warc.read(spark, path, "bigint").where("id is not null").count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:uuid:{}>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    bodies = [("warcinfo", "7", "software: x"), ("response", "8", "WARC/1.0\r\nContent-Length: 1\r\n\r\na\r\n\r\n"), ("response", "9", "WARC/1.x"), ("response", "10", "")]
    data = "".join(head.format(t, i, len(b), b) for t, i, b in bodies)
    (tmp_path / "a.warc").write_bytes(data.encode())
    out = warc.read(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.name, r.record_type, r.payload_bytes, r.payload_digest, r.id) for r in out] == [("urn:uuid:" + i, t, len(b), base64.b32encode(hashlib.sha1(b.encode()).digest()).decode(), None) for t, i, b in bodies]


def test_toxicity(spark, docs):
    rng = random.Random(2)
    bad = ["gribbler", "snorkit", "flumpet"]
    words = ["".join(rng.choices("aeionrstl", k=rng.randint(2, 8))) for _ in range(300)]
    table, labels = [], []
    for i in range(400):
        t = rng.choices(words, k=40)
        if i % 4 == 0:
            t[rng.randrange(40)] = rng.choice(bad)
        table.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    df, lab = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = strings.fit(df, lab)
    got = {r.doc_id: r.score for r in strings.score(df, machine).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels]) > 0.97
    assert machine.scores(["you snor.kit you"])[0] > 0.5 > machine.scores(["", "nothing of it"]).max()
    assert strings.score(docs, machine).count() == len(DOCS)
    assert strings.fit(df, lab.limit(0)).scores(["x"])[0] == pytest.approx(0.5)


def test_kernel_by_definition():
    def kernel(a, b):
        out = {}
        for w, s in ((0, a), (1, b)):
            c = [31] + [ord(x) - 96 for x in s]
            for i in range(len(c)):
                for j in range(i + 1, len(c)):
                    for k in range(j + 1, min(len(c), i + strings.WINDOW)):
                        out.setdefault((c[i], c[j], c[k]), [0, 0])[w] += strings.DECAY ** (k - i + 1)
        return sum(x * y for x, y in out.values())

    marks = strings.features(["loser", "cat"])
    got = strings.kernels(["looser", "dog"], marks)
    n = strings.lengths(["looser", "dog", "loser", "cat"])
    for i, a in enumerate(("looser", "dog")):
        for j, b in enumerate(("loser", "cat")):
            assert got[i, j] == pytest.approx(kernel(a, b) / n[i] / n[2 + j], rel=1e-4, abs=1e-6)


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    table = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (1, 1, "assistant", said), (2, None, None, None), (2, 5, "assistant", "a</turn>\nb<\\/turn><\\\\/turn>"), (3, 1, "x>y%3E</turn>\n", ""), (None, 1, "assistant", "<"), (4, 2, "assistant", "é "), (4, 1, "user", LONG)]
    df = spark.createDataFrame([(*r, "extra") for r in table], "conv_id long, turn long, role string, text string, piece string")
    out = {r[0]: tuple(r[1:5]) for r in chat.read_back(chat.render(df)).collect()}
    assert out == brute.chat(table)
    assert chat.read_back(chat.render(df.limit(0))).count() == 0


def test_decontamination(spark, docs, none):
    items = [(1, COPY), (2, "a B c"), (2, "a B c"), (3, None), (4, "!!"), (None, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15"), (10, "grüße é"), (5, "x y z " * 300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = key(brute.decontaminate(ROWS, items))
    out = decontaminate.find(docs, bench).drop("spans", "items", "longest", "matches")
    assert rows(out) == want
    block = decontaminate.BLOCK_WORDS
    decontaminate.BLOCK_WORDS = 20  # many blocks
    try:
        assert rows(decontaminate.find(docs, bench).drop("spans", "items", "longest", "matches")) == want
    finally:
        decontaminate.BLOCK_WORDS = block
    assert decontaminate.find(none, bench).count() == 0
    assert decontaminate.find(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and key(r.doc_id for r in kept.collect()) == key(d for d, *_, c in want if not c)


def test_longest_matches(spark):
    rng = random.Random(3)
    words = lambda n: [rng.choice("a b c d".split()) for _ in range(n)]
    items = [(str(i), words(rng.choice([4, 13, 40]))) for i in range(12)]
    texts = [(k, words(30) + items[k % 12][1][: 10 + k] + words(5)) for k in range(30)] + [(98, []), (99, ["z"] * 40)]
    want = {}
    for d, t in texts:
        for i, w in items:
            least, best = min(len(w), 13), 0
            for a in range(len(t)):
                for b in range(len(w)):
                    n = 0
                    while a + n < len(t) and b + n < len(w) and t[a + n] == w[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= least:
                want[d, i] = best
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string")
    for block in (20, decontaminate.BLOCK_WORDS):
        whole, decontaminate.BLOCK_WORDS = decontaminate.BLOCK_WORDS, block
        try:
            out = decontaminate.find(docs, bench).collect()
        finally:
            decontaminate.BLOCK_WORDS = whole
        assert {(r.doc_id, m.item): m.words for r in out for m in r.matches or []} == want
        assert {r.doc_id: r.longest for r in out} == {d: max((n for (e, _), n in want.items() if e == d), default=0) for d, _ in texts}
        for r in out:
            for m in r.matches or []:
                assert dict(texts)[r.doc_id][m.begin : m.begin + m.words] == dict(items)[m.item][m.item_begin : m.item_begin + m.words]


def test_pii(docs, none):
    out = pii.summary(pii.detect(docs)).collect()
    want = key((d, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute.base_pii(t)).encode()).hexdigest()) for d, t in ROWS)
    assert key((r.doc_id, r.base_sha256) for r in out) == want
    assert pii.detect(none).count() == 0
    text = [r.text for r in pii.redact(docs).collect() if r.doc_id == 10][0]
    assert "<EMAIL>" in text and "<CARD>" in text and "<PHONE>" in text and "<IP>" in text and "10.0.0.256" in text
    assert pii.redact(docs).columns == docs.columns


def test_pii_random():
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choices("01259.@-+ ()a_%é4", weights=[6, 6, 6, 6, 6, 8, 3, 4, 3, 4, 1, 1, 6, 1, 1, 1, 6], k=rng.randint(0, 60)))
        assert [(k, s, e) for s, e, k, _ in pii.spans_of(t) if k in pii.KINDS[: pii.BASE]] == brute.base_pii(t)
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert [x[2] for x in pii.spans_of("my iban GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789")] == ["iban", "national_id"]


def test_pii_iban_ends():
    gb, de, far = "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "ZZ33 1234 5678 9012 345"
    assert pii.mod97(far)
    for text in (f"IBAN {gb} BIC WESTGB2L", f"{de} I said", f"{gb} {de}", f"{de} {gb} {de}", f"AB12 CD34 {gb} AND MORE", f"{far} BIC X", f"{gb.replace(' ', '')} A", f"{de}, {gb}. X{gb} {gb}x", f"{gb} 7 GB82 WEST"):
        want = [m.span() for m in re.finditer(rf"(?<![A-Za-z0-9])({gb}|{gb.replace(' ', '')}|{de}|{far})(?![A-Za-z0-9])", text)]
        assert [(s, e) for s, e, k, _ in pii.spans_of(text) if k == "iban"] == want and want, text
    assert pii.redacted(f"to {de} {gb} BIC") == "to <IBAN> <IBAN> BIC"
    assert not [x for x in pii.spans_of("GB82 WEST 1234 5698 7654 33 BIC, GB82 WEST 1234 and GB82") if x[2] == "iban"]


def test_pii_context():
    score = lambda text: {k: s for _, _, k, s in pii.spans_of(text)}
    assert score("my ssn 123-45-6789") == {"national_id": 0.7} and score("the part 123-45-6789, ssn") == {} and score("x 123-45-6789") == {}
    assert score("a ship 10.0.0.1 sails")["ip"] == 0.6 and score("host 10.0.0.1")["ip"] == 0.9 and score("version 10.0.0.1")["ip"] == 0.3
    text = 'see token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" there'
    assert [(k, text[a:b]) for a, b, k, _ in pii.spans_of(text) if k == "secret"] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert "04dbeb" not in pii.redacted(text)
    assert score("API_KEY: AbC1234567890xyz0")["secret"] == 0.8 and "secret" not in score("the token = aaaaaaaaaaaaaaaaaaaaaaaa1 or token: something-or-other")


def test_quality(spark, docs):
    rng = random.Random(4)
    table, labels = [], []
    for i in range(300):
        t = ["".join(rng.choices("aeionrstl", k=rng.randint(2, 8))) for _ in range(60)]
        table.append((i, " ".join(w.upper() + "!!" if i % 5 == 0 else w for w in t)))
        labels.append((i, int(i % 5 != 0)))
    df, lab = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    machine = quality.fit(df, lab)
    got = {r.doc_id: r.score for r in quality.score(df, machine).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, y in labels]) > 0.97
    assert quality.score(docs, machine).count() == len(DOCS)
    assert quality.accepted(docs, machine).columns == docs.columns
    v = quality.describe(b"Some text, to be scored.\nAnd more")
    w, x = machine.w[v[0]], np.array(v[1])
    pairs = sum(machine.v[v[0][i]] @ machine.v[v[0][j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert machine.margins([v])[0] == pytest.approx(machine.bias + w @ x + pairs)


def test_gear():
    data = bytes(random.Random(1).choices(range(256), k=500))
    h, slow = 0, []
    for b in data:
        h = (2 * h + int(chunks.GEAR[b])) & 0xFFFF
        slow.append(h)
    assert chunks.gear(np.frombuffer(data, np.uint8)).tolist() == slow
    ends = chunks.chunk(data)
    moved = chunks.chunk(b"inserted" + data) - 8
    assert set(ends[ends > 20]) <= set(moved) and ends[-1] == len(data)


def test_substring_dedup(spark, docs, none):
    rng = random.Random(3)
    some = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(1, 9))) for _ in range(n))
    table, shared = [], []
    for i in range(30):
        p = some(80)
        shared.append((2 * i, 2 * i + 1))
        table += [(2 * i, some(70) + " " + p + " " + some(70)), (2 * i + 1, some(33) + " " + p + " " + some(50))]
    table += [(1000 + i, some(200)) for i in range(30)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    out = chunks.duplicates(df).collect()
    assert {(r.kept_in, r.doc_id) for r in out} == set(shared)
    text = dict(table)
    for r in out:
        assert text[r.doc_id].encode()[r.begin : r.end] in text[r.kept_in].encode()
    cut = {r.doc_id: r.text for r in chunks.remove(df).collect()}
    assert cut[1000] == text[1000] and cut[0] == text[0] and len(cut[1]) < len(text[1])
    assert chunks.duplicates(none).count() == 0
    got = chunks.remove(docs)
    assert got.columns == docs.columns and got.count() == len(DOCS)


def test_substring_dedup_periodic(spark):
    rng = random.Random(6)
    junk = [" ".join(["Of"] * 300), " ".join(["Ez\u00f1ado"] * 120), " ".join(["a b"] * 90), "x " * 60, " ".join(["la la lu"] * 400)]
    some = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(n))
    table = [(i, t) for i, t in enumerate(junk)] + [(10 + i, f"{some(7 + i)} {t} {some(9)}") for i, t in enumerate(junk)] + [(None, junk[1]), (40, None), (41, ""), (42, junk[0]), (42, junk[0]), (43, some(50))]
    table += [(50 + i, " ".join(rng.choices(["a b c", "b", "c\n", " d"], k=rng.randint(0, 200)))) for i in range(40)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    for least in (51, 5):
        got = rows(chunks.duplicates(df, least_words=least).select("doc_id", "begin", "end", "n_words", "kept_in"))
        assert got == key(brute.repeated_passages(table, least))
        assert {r[0] for r in got} >= {10, 11, 12, 13, 14, 42, None}
    places = lambda found: {(r.doc_id, r.place, i) for r in found.collect() for i in range(r.w0, r.w1 - 50)}
    assert places(chunks.repeats(chunks.occurrences(df, segment=100))) == places(chunks.repeats(chunks.occurrences(df)))  # long texts go in parts


def test_substring_dedup_frequent_keys(spark, none, monkeypatch):
    rng = random.Random(16)
    some = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(n))
    copy, line = some(90), some(25)
    table = [(i, copy) for i in range(40)] + [(100 + i, f"{some(20 + i)} {line} {some(40)}") for i in range(40)] + [(200, "so " * 200), (201, "so " * 150), (202, None), (None, copy), (203, copy + " " + some(30) + " " + copy), (0, copy)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    want = key(brute.repeated_passages(table, 51))
    spans = lambda **more: rows(chunks.duplicates(df, **more).select("doc_id", "begin", "end", "n_words", "kept_in"))
    chunk_rows = chunks.occurrences(df)
    found = chunks.frequent(df, share=1.0, rows=20)
    counts = {r.key & (2**64 - 1): r["count"] for r in chunk_rows.groupBy("key").count().collect()}
    least = max(20, sum(counts.values()) / 32)
    assert set(found.tolist()) == {k for k, n in counts.items() if n > least} and 0 < len(found) <= 32
    assert spans() == want == spans(share=1.0, rows=20)
    all_keys = np.array(sorted(counts), np.uint64)
    assert chunks.occurrences(df, leave=all_keys).count() == 0 == chunks.frequent_repeats(none, all_keys).count()
    assert len(chunks.frequent(none)) == 0
    places = lambda found: {(r.doc_id, r.place, r.kept_in, i) for r in found.collect() for i in range(r.w0, r.w1 - 50)}
    whole = lambda found: {x[:2] + x[3:] for x in found}
    plain, split = places(chunks.repeats(chunk_rows)), places(chunks.frequent_repeats(df, all_keys, most=3))
    assert whole(plain) == whole(split)
    for part in (all_keys, all_keys[::2]):
        monkeypatch.setattr(chunks, "frequent", lambda *a, part=part: part)
        assert spans() == want


def test_substring_dedup_lengths(spark):
    rng = random.Random(9)
    some = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(n))
    table, want = [], {}
    for n in (15, 30, 49, 50, 51, 52, 75, 200):
        p = some(n)
        table += [(2 * n, f"{some(60)} {p} {some(60)}"), (2 * n + 1, f"{some(40)} {p} {some(70)}")]
        if n > 50:
            want[2 * n + 1] = (n, 2 * n, p)
    df = spark.createDataFrame(table, "doc_id long, text string")
    out = chunks.duplicates(df).collect()
    assert {r.doc_id: (r.n_words, r.kept_in, dict(table)[r.doc_id][r.begin : r.end]) for r in out} == want and len(out) == len(want)
    kept = {r.doc_id: r.text for r in chunks.remove(df).collect()}
    assert all(kept[d] == (t.replace(want[d][2], "") if d in want else t) for d, t in table)


def test_names():
    assert common.free_name(["Size", "_size"], "size") == "__size"
