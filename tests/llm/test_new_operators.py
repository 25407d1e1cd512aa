"""Embedding near-duplicates, source audit and token alignment against brute force, and their edges."""

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from takeoff_spark.llm import align, embed_dedup, source_audit
from takeoff_spark.llm.bpe_count import byte_alphabet
from takeoff_spark.llm.common import tokenizer_path

SMALL = "/root/testdata/sf0.001"
ODD = ["", None, "a", "a", "<|endoftext|> x <s></s><unk>", "“Hi”\n\xa0\xa0there", "中\n\xa0\xa0ß", "😀\x0cé\n\xa0", "x▁y", " " * 5000 + "z", "ab" * 9000, "\x00\x01", "é́ ß \u0085x", "日本語" * 500, "  \n\n\t x  ", "ÿ" * 3000 + " ﻿", "A-b_C9dÉ 1É"]


# Embeddings


def clusters() -> list[tuple]:
    """(vec_id, embedding, label): groups of near copies at angles about the threshold, scaled and exact copies, odd rows."""
    draw, rows = np.random.default_rng(3), []
    for group in range(12):
        base = draw.normal(size=16)
        base /= np.linalg.norm(base)
        for spread in draw.uniform(0, 0.5, 12):
            noise = draw.normal(size=16)
            rows.append((base + spread * noise / np.linalg.norm(noise)).tolist())
    rows += [rows[0], [3 * x for x in rows[0]], [1e200 * x for x in rows[1]]]
    out = [(i, r, i % 2) for i, r in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0]]
    return out + [(1000 + i, r, 0) for i, r in enumerate(odd)] + [(2000, rows[0], None), (None, rows[0], 0), (0, rows[0], 0)]


def linked(rows: list[tuple], cosine: float) -> list[tuple]:
    good = [i is not None and l is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, l in rows]
    unit = [np.array(v) / max(np.abs(v)) if g else None for g, (_, v, _) in zip(good, rows, strict=True)]
    unit = [v / np.linalg.norm(v) if v is not None else None for v in unit]
    near = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    out = []
    for i, (name, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := [j for j in near[todo.pop()] if j not in seen])
            seen |= {*new}
        out.append((name, len(near[i]), min(rows[j][0] for j in seen) if good[i] else name))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [512, 4])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)  # the small one makes balls and pairs of chunks
    rows = clusters()
    df = spark.createDataFrame([(i, v, l, "x", 1) for i, v, l in rows], "vec_id long, embedding array<double>, label int, n string, u int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_vectors(df, count=4).collect()]
    assert sorted(got, key=str) == linked(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in embed_dedup.near_vectors(df.where("vec_id IS NOT NULL")).collect())
    assert embed_dedup.near_vectors(df.where("false")).count() == 0


def test_hadamard_and_probes():
    x = np.random.default_rng(0).normal(size=(5, 8))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(8)] for i in range(8)])
    assert np.allclose(embed_dedup.hadamard(x), x @ h)
    codes = embed_dedup.probes(x, 1, 2, 4)
    assert codes.shape == (5, 4) and all(len({*r}) == 4 for r in codes.tolist())
    assert (codes == embed_dedup.probes(2 * x, 1, 2, 4)).all()


# Source audit


def test_audit_odd_texts(spark):
    long = "Ünïcode" * 30
    texts = [*ODD, "The the THE End", "the end é", "end the É", f"{long} sixteenbytesaaaa seventeenbytesaaa eightbyt ninebytes", f"{long} sixteenbytesaaaa seventeenbytesaaa eightbyt ninebytes", long, "seventeenbytesaaa eightbyt ninebytes sixteenbytesaaaa zzz"]
    rows = [(i % 7, t, [None, "en", "de"][i % 3 if i % 5 else 1], f"s{i % 4}" if i % 6 else None, 7) for i, t in enumerate(texts * 3)] + [(1, None, "xx", "only", 7), (2, "once", "yy", "a", 7), (3, "twice", "yy", "b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term int")
    got = sorted(map(tuple, source_audit.audit(df).collect()))
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert got == sorted(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({source_audit.AUDIT_SQL})").fetchall()) and len(got) > 50
    assert source_audit.audit(df.where("false")).count() == 0


def test_terms_by_length(monkeypatch):
    texts = ["Aé b " + "x" * n + " É" + "y" * n for n in (1, 5, 7, 8, 9, 15, 16, 17, 24, 25, 70)] + ["", "\0 1"]
    groups = np.arange(len(texts)) % 3
    got = {(g, t.decode()): (n, d) for part in source_audit.counted([t.encode() for t in texts], groups) for g, t, n, d in zip(*(x if isinstance(x, list) else x.tolist() for x in part), strict=True)}
    n, d = Counter(), Counter()
    for g, t in zip(groups.tolist(), texts, strict=True):
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)]
        n.update((g, x) for x in terms)
        d.update((g, x) for x in {*terms})
    assert got == {k: (n[k], d[k]) for k in n}


def test_tasks_keep_counts_as_words(monkeypatch):
    """A counted term costs its words and three numbers, not Python objects; what is handed on in several goes adds up."""
    tally, n = source_audit.Tally(), 300_000
    words = np.random.default_rng(1).integers(97, 123, (n, 8), np.uint8)
    text = np.hstack([words, np.full((n, 1), 32, np.uint8)]).tobytes()
    tracemalloc.start()
    try:
        tally.add("en", 7, text)
        tally.count()
        assert tracemalloc.get_traced_memory()[0] < 64 * n
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(source_audit, "BUCKETS", 3)
    got, want, tally = Counter(), Counter(), source_audit.Tally()
    for i in range(60):
        (lang, group), terms = ("en", 5 << 33) if i % 3 else ("de", 9), [f"{'w' * (k % 30)}x" for k in range(i)] * 2
        tally.add(lang, group, " ".join(terms).encode())
        want.update({(lang, group, t, "n"): c for t, c in Counter(terms).items()} | {(lang, group, t, "docs"): 1 for t in terms})
        if i % 7 == 6:
            tally.count()
        for b in tally.packets() if i in (20, 59) and not tally.count() else ():
            for lang, width, bucket, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = np.ascontiguousarray(np.frombuffer(rows, np.uint8).reshape(8 * (width + 2), -1).T).view(np.uint64)
                assert bucket < 3
                for t, g, both in zip(source_audit.as_bytes(m[:, :width]).tolist(), m[:, width].tolist(), m[:, -1].tolist(), strict=True):
                    got.update({(lang, g, t.decode(), "n"): both >> 32, (lang, g, t.decode(), "docs"): both & 0xFFFFFFFF})
    assert got == want


def test_shares_of_large_counts(spark):
    counts = [0, 8_999_999_999, 9_000_000_000, 10**13]
    got = spark.createDataFrame([(c,) for c in counts], "c long").selectExpr(source_audit.share("c", "20000000000000L", "7L") + " AS p").collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // (20_000_000_000_000 + 7) for c in counts]


# Alignment


def by_hand(texts: list) -> list[tuple]:
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    byte = {c: i for i, c in enumerate(byte_alphabet())}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], Counter()
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        xb, yb = [bytes(byte[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if not t or b"".join(xb) != (" " + t).encode() or b"".join(yb) != (" " + t).encode():
            docs.append(None)
            continue
        ends = [np.cumsum([*map(len, s)]).tolist() for s in (xb, yb)]
        groups, i, j = [], 0, 0
        for cut in sorted({*ends[0]} & {*ends[1]}):
            p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((x[i:p], y[j:q]))
            i, j = p, q
        docs.append((len(x), len(y), groups))
        count.update({(u, v) for p, q in groups for u in p for v in q})
    best = defaultdict(int)
    for (u, _), n in count.items():
        best[u] = max(best[u], n)
    out = []
    for doc in docs:
        links = [(u, v) for p, q in doc[2] for u in p for v in q] if doc else []
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in doc[2]) if doc else ""
        out.append((*(doc[:2] if doc else (0, 0)), len(doc[2]) if doc else 0, len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if doc else ""))
    return out


@pytest.mark.parametrize("limits", [(4096, 2_000_000, 16 << 20), (2, 10, 2000)])
def test_alignment(spark, monkeypatch, limits):
    for name, value in zip(("LARGE", "COUNTED", "PACKETS"), limits, strict=True):
        monkeypatch.setattr(align, name, value)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    df = spark.createDataFrame([(i, t, 5, "b") for i, t in enumerate(texts)], "doc_id long, text string, slice int, bucket string").repartition(4)
    got = sorted(map(tuple, align.align_tokens(df).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))
    assert [r[1:] for r in got] == by_hand(texts)
    assert align.align_tokens(df.where("false")).count() == 0
    assert align.align_tokens(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")).count() == 2


def test_groups_of_overlapping_tokens():
    a, b = align.coalesced(np.array([2, 5, 6, 9]), np.array([1, 5, 8, 9]))
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 0, 1, 1]
