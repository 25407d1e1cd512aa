"""Operators against brute force on small tables; nulls, empty tables, repeated rows, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeoff_spark.llm import html_text, line_dedup, media, minhash, mixing, piece_codec, topk, toxicity
from takeoff_spark.llm.bpe_count import token_counts
from takeoff_spark.llm.components import components


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = [(i, [float(x) for x in rng.integers(-3, 3, 4) / 8]) for i in range(120)] + [(200, None), (250, [float("nan")] * 4), (None, [0.1] * 4), (50, None)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>"), tile=16, query_tile=2, fan_in=3).collect())
    m = {i: np.floor(np.array(x) * 256).astype(int) for i, x in v[:120]}
    want = []
    for q in (0, 50, 100):
        best = sorted((-int(m[q] @ m[c]), c) for c in m if c != q)[:5]
        want += [(q, k, c, -s) for k, (s, c) in enumerate(best, 1)]
    assert got == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + 1] = rng.choice([[], ["a"], ["b", "c"]])
        b = "".join(b)
        for k in range(4):
            assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


@pytest.mark.parametrize("edits", [1, 2])
def test_lines(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(18, 32))) for _ in range(10)]
    rows, seen, want = [], [], {}
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(5)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(line))
                line[i : i + 1] = rng.choice([[], ["x"], [line[i], "y"]])
            lines.append("".join(line))
        rows.append((d, "\n".join(lines), "k"))
        keep = []
        for x in "\n".join(lines).split("\n"):
            if len(x) < 20 or not any(distance(x, y) <= edits for y in seen):
                keep.append(x)
            if len(x) >= 20:
                seen.append(x)
        want[d] = "\n".join(keep)
    df = spark.createDataFrame([*rows, (70, None, "k"), (None, "abc", "k")], "doc_id long, text string, key string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, edits, repeats=False, reach=None).collect()}
    assert got == {**want, 70: None, None: "abc"}


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([2, 8, 40, 200]))]
        for _ in range(rng.randrange(1, 6)):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs.append((len(docs), " ".join(t), "x"))
    docs += [(900, None, "x"), (901, " \n", "x"), (None, "a b c", "x"), (902, "A b", "x"), (903, "a B", "x")]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, key string"), 3, 85).collect()}
    sets = {}
    for i, t, _ in docs:
        w = (t or "").lower().split()
        if i is not None:
            sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    par = {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    assert got == {i: (find(i), len(s)) for i, s in sets.items()}


def test_blocks_find_every_link(spark, monkeypatch):
    """Without any link from hubs, the blocks alone give the components of one group of near copies."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(90):
        t = list(base)
        for _ in range(rng.randrange(12)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(50)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n_bands, n_rows = minhash.bands(0.85)
    reps = minhash.sketches(docs, 3).groupBy("digest", "n", "regs").agg(F.min("doc_id").alias("rep"))
    key = lambda b: F.xxhash64(F.lit(b), F.substring("regs", 1 + 2 * n_rows * b, 2 * n_rows))
    keys = reps.select("rep", F.posexplode(F.array(*map(key, range(n_bands)))).alias("band", "key"))
    none = spark.createDataFrame([], "node long, component long")
    ids = minhash._undecided(keys, reps, none, 0.85)
    members = minhash._sharable(ids, docs, 3, 85).join(reps.select("rep", "regs"), "rep").withColumn("weight", F.size("s"))
    got = {r.node: r.component for r in components(minhash._block_links(keys, members, none, 85, n_rows)).collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(frozenset(minhash.shingles(t, 3).tolist()), i)
    sets, par = {i: s for s, i in first.items()}, {i: i for i in first.values()}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    want = {i: find(i) for i in sets}
    assert 1 < len(set(want.values())) < len(want)
    assert {i: got.get(i, i) for i in sets} == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 7], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i + 1] == got[i] for i in range(40) if i % 7 and i in got)
    assert components(edges.limit(0)).count() == 0


def test_media(spark):
    import hashlib
    import zlib

    df = spark.createDataFrame([(1, "abc", "s"), (2, "abc", "s"), (3, None, "s"), (4, "é" * 5000, "s")], "doc_id long, text string, shard string")
    for r in media.media_columns(df).collect():
        p = media.padded({1: "abc", 2: "abc", 3: "", 4: "é" * 5000}[r.doc_id].encode())
        assert (r.payload_sha256, r.payload_bytes, r.tail_crc32) == (hashlib.sha256(p).hexdigest(), len(p), zlib.crc32(p[-64:]))
    assert media.media_columns(df.limit(0)).count() == 0


def test_html():
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>T&amp;x</h1><p>One <b>two</b>\n three<br>four<p>Five<script>p</script></article><footer>c</footer></body></html>"
    assert [b.text for b in html_text.blocks(page)] == ["Home", "T&x", "One two three four", "Five", "c"]
    net = html_text.train([page.replace("Five", f"Five {i} words of text, and more. " * (i % 4 + 1)) for i in range(40)], epochs=6)
    parsed = html_text.blocks(page)
    assert [b.text for b, q in zip(parsed, html_text.label(net, [parsed])[0], strict=True) if q >= 0.5] == ["T&x", "One two three four", "Five"]


def test_toxicity(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + (" you moron!" if i % 3 == 0 else ""), "en", int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(a, b, c) for a, b, c, _ in rows] + [(999, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(a, d, 1) for a, _, _, d in rows] + [(5, None, None)], "doc_id long, toxic int, quality int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    held = [(out[a].predicted, d) for a, _, _, d in rows if out[a].held_out]
    assert len(held) > 40 and np.mean([p == d for p, d in held]) > 0.95
    assert 0 <= out[999].score <= 1
    assert toxicity.score_toxicity(docs, toxicity.fit(docs, labels.limit(0))).count() == 401


def test_mixing(spark):
    rng = random.Random(0)
    docs = spark.createDataFrame([(i, " ".join(f"{'a' if i % 4 else 'b'}{rng.randrange(30)}" for _ in range(50)), "z") for i in range(300)] + [(500, None, "z"), (None, "x", "z")], "doc_id long, text string, tokens string")
    labels = spark.createDataFrame([(i, "x" if i % 4 else "y") for i in range(150)] + [(3, None)], "doc_id long, domain string")
    out = mixing.mixing_rates(docs, labels, {"x": 0.5, "y": 0.5}).toPandas()
    total = out.tokens.sum()
    assert (out.rate >= 0).all() and len(out) == 301
    for d in "xy":
        assert abs((out.rate * out.tokens * out[f"p_{d}"]).sum() / total - 0.5) < 1e-3
    assert mixing.mixing_rates(docs.limit(0), labels, {"x": 1.0, "y": 1.0}).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5, "q"), (1, None, 5, "q")], "doc_id long, text string, n_bytes int, digest string")
    assert token_counts(df).count() == 2
    assert [r.n_tokens for r in piece_codec.piece_digests(df).collect()] == [2, 2]
