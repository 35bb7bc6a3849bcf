"""The registered queries on the smallest tables: against their SQL, plain versions, and labels held out."""

import hashlib
import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import duckdb
import pandas as pd
import pytest

from rasterloom.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(rows):
    return sorted((tuple("null" if pd.isna(x) else x for x in r) for r in rows), key=str)


def run(spark, name, sf=SF):
    return queries.QUERIES[name](spark, sf)


def rows_of(table, *columns, sf=SF):
    return duckdb.sql(f"SELECT {', '.join(columns)} FROM '{sf}/{table}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = run(spark, name)
    want = con.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert dict(zip(want.columns, map(str, want.types), strict=True)) == {c: KINDS[k] for c, k in df.dtypes}
    got = df.toPandas()[order]
    assert len(got) and plain(got.itertuples(index=False)) == plain(want.df()[order].itertuples(index=False))


def test_mix_bounds(spark):
    out = run(spark, "op1_sainte_lague_mix").collect()
    docs = rows_of("documents", "doc_id", "text", "source")
    words = {d: len((t or "").encode().split()) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    own = defaultdict(int)
    for d, n in words.items():
        own[source[d]] += n
    names = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * sum(own.values())
    while open_:  # the rule, word for word: what a source can't take is shared again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * own[s]}
        want |= {s: 2.0 * own[s] for s in full} if full else share
        left -= sum(2.0 * own[s] for s in full)
        open_ = open_ - full if full else set()
    taken = defaultdict(int)
    for r in out:
        assert r["size"] == words[r.doc_id] and r.source_size == own[source[r.doc_id]] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert len(out) == len(docs) and all(abs(taken[s] - want[s]) <= max(64, 0.01 * want[s]) for s in names)
    assert plain(map(tuple, run(spark, "op1_sainte_lague_mix").collect())) == plain(map(tuple, out))


def test_media(spark):
    out = run(spark, "op2_ogg_media").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()
    assert plain(map(tuple, out)) == plain((d, *brute.payload(t)) for d, t in rows_of("documents", "doc_id", "text"))


def test_simhash(spark):
    docs = rows_of("documents", "doc_id", "text")
    prints = brute.fingerprints(docs)
    want = zip((d for d, _ in docs), (f"{p:016x}" for p in prints), brute.components([d for d, _ in docs], prints), strict=True)
    assert plain(map(tuple, run(spark, "op3_simhash_bktree").select("doc_id", "fingerprint", "component_id").collect())) == plain(want)


def test_warc(spark):
    assert plain(map(tuple, run(spark, "op4_warc_chain").collect())) == plain(brute.warc(rows_of("pages", "page_id", "html")))


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [*rows_of("conversations", "conv_id", "turn", "role", "text"), (-7, 0, "user", said), (-7, 1, "assistant", said)]
    out = {r[0]: tuple(r[1:5]) for r in run(spark, "op6_chat_grammar").collect()}
    assert out == brute.chat(rows) and out[-7][2] == len(said)


def test_decontamination(spark):
    want = brute.decontaminate(rows_of("documents", "doc_id", "text"), rows_of("benchmark", "item_id", "text"))
    assert plain(map(tuple, run(spark, "op7_suffix_array_decontamination").drop("longest").collect())) == plain(want)


def test_pii(spark):
    out = run(spark, "op8_pii_spans").collect()
    want = {d: brute.base_pii(t) for d, t in rows_of("documents", "doc_id", "text")}
    for r in out:
        base = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone"))
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(spans) and len(spans) == len(r.scores.split(",") if r.scores else [])
    assert len(out) == len(want)


@pytest.mark.parametrize(("name", "label", "mod", "held", "least", "cut"), [("op5_string_kernel_toxicity", "toxic", 5, 0, 0.95, 0.5), ("op9_factorisation_quality", "quality", 4, 2, 0.9, 0.7)])
def test_held_out(spark, name, label, mod, held, least, cut):
    sf = SF.replace("0.001", "0.01")
    out = run(spark, name, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(d for (d,) in rows_of("documents", "doc_id", sf=sf))
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1
    truth = dict(rows_of("labels", "doc_id", label, sf=sf))
    test = [(r.score, r.predicted, truth[r.doc_id]) for r in out if r.held_out and truth.get(r.doc_id) is not None]
    assert len(test) > 40 and sum(p == y for _, p, y in test) / len(test) >= least
    good, bad = [s for s, _, y in test if y], [s for s, _, y in test if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / len(good) / len(bad) > 0.97


def test_chunks(spark):
    """Every passage of 51 words, against a dictionary of all passages before it."""
    docs = rows_of("documents", "doc_id", "text")
    want = brute.repeated_passages(docs, 51)
    got = run(spark, "op10_gear_chunks").select("doc_id", "begin", "end", "n_words", "kept_in").collect()
    assert plain(map(tuple, got)) == plain(want) and want


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() and {"doc_id", "text", "lang", "source", "n_chars", "taken"} <= set(out.columns)
