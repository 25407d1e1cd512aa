"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator and pipeline stage."""

import time

import numpy as np
import pytest

import corpus_pipeline
from takeoff_spark.llm import bpe_count, html_text, line_dedup, media, minhash, mixing, piece_codec, token_files, topk, toxicity

LONG = "uma parede longa de tijolo e vidro\n" * 4000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (1, "outro texto", None), (2, None, "en"), (3, "", "pt"), (4, LONG, "pt"), (None, "sem id", "pt"), (5, " \n\t ", "en")]
    return spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, lang string, all int, key string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 4)) for i in (1, 2, 3, 4, 5, 5)] + [(None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


def test_repeated_vectors_are_candidates_each(spark):
    v = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 2.0]), (1, [3.0, 3.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(v).orderBy("rank").collect()]
    assert got == [(1, 1, 393216), (2, 1, 262144), (3, 2, 65536)]
    assert sorted(r.score for r in topk.top_k(v.union(v.where("vec_id = 0"))).collect()) == [65536, 262144, 262144, 393216, 393216]


def test_scores_beyond_a_long_raise():
    with pytest.raises(OverflowError):
        topk.tile_scores(np.array([[10**18, 10**18]]), np.array([[10**9, 2 * 10**9]]))


@pytest.mark.parametrize("run", [media.media_columns, bpe_count.token_counts, piece_codec.piece_digests, piece_codec.encode_pieces, token_files.token_files, line_dedup.line_digests, line_dedup.dedup_lines])
def test_a_row_for_each_row(docs, run):
    assert sorted(str(r.doc_id) for r in run(docs).collect()) == ["1", "1", "1", "2", "3", "4", "5", "None"]
    assert run(docs.limit(0)).count() == 0


def test_repeated_ids_lose_no_line(spark):
    rows = [(0, "the quick brown fox jumps over"), (1, "the quick brown fox jumps ovr"), (1, "zzz an entirely different unique line here"), (1, "zzz an entirely different unique line hers\nshort")]
    got = sorted(r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got in (["", "", "short", "the quick brown fox jumps over"], ["", "short", "the quick brown fox jumps over", "zzz an entirely different unique line here"], ["", "", "the quick brown fox jumps over", "zzz an entirely different unique line hers\nshort"])
    assert sum("zzz" in t for t in got) == 1


def test_minhash_edges(docs):
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in minhash.near_duplicates(docs, 3, 85).collect())
    assert got == [(1, 1, 1), (1, 1, 4), (1, 1, 4), (2, 2, 0), (3, 3, 0), (4, 4, 7), (5, 5, 0)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_toxicity_and_mixing_edges(docs, labels):
    model = toxicity.fit(docs, labels)
    assert toxicity.score_toxicity(docs, model).count() == 8 and toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.drop_toxic(docs, toxicity.constant(0.1)).count() == 8
    domains = mixing.label_domains(labels)
    rates = mixing.mixing_rates(docs, domains, {"high": 0.5, "low": 0.5})
    assert sorted(r.doc_id for r in rates.collect()) == [1, 2, 3, 4, 5] and rates.columns[-1] == "misfit"
    assert mixing.mix(docs, domains, {"high": 0.5, "low": 0.5}, least=1.0).where("doc_id is null").count() == 1


def test_unreachable_targets_are_reported(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "x") for i in range(9)], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="misses its targets"):
        assert mixing.mixing_rates(docs, labels, {"x": 0.5, "y": 0.5}).first().misfit > 0.01


def test_training_reads_whole_texts(spark):
    """What tells the classes apart stands after 4,000 other words."""
    rows = [(i, "palavra " * 4000 + ("feio " if i % 2 else "lindo ") * 3) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in out]) > 0.95


def test_tokens_of_html():
    text = lambda page: [b.text for b in html_text.blocks(page)]
    assert text("<p data-x=it's>Hello world</p><p>I don't know</p><p>End</p>") == ["Hello world", "I don't know", "End"]
    assert text("a<!-- x > y --><p>b<br>c &amp; 3 < 4 <a href=x>d</a><script>if(a<b){'</p>'}</script>e</p>") == ["a", "b c & 3 < 4 de"]
    assert text("<svg><p>open</p>") == ["open"] and text("<p title='>'>x</p><p") == ["x"]
    for page in ("<p a='" * 30_000, "<div>x" * 30_000, "<svg>x" * 30_000, "<li><div>x</q></li>" * 30_000):
        began = time.time()
        html_text.blocks(page)
        assert time.time() - began < 10


def test_main_text(spark):
    page = "<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>Some words of text, {0}.</p></article><footer>c</footer></body>"
    rows = [(i, "u", page.format("more " * (i % 5 + 1)), "t", 0) for i in range(60)] + [(60, None, None, "t", 0), (61, "u", "", "t", 0), (1, "u", page.format("more " * 2), "t", 0), (62, "u", "<div>" * 3000 + "<p>" + "deep words, " * 70 + "end.", "t", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    net = html_text.fit(pages)
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(pages, net).collect()}
    for i in range(60):
        want = "T\n\nSome words of text, " + " ".join(["more"] * (i % 5 + 1)) + " ."
        assert got[i] == (want, len(want))
    assert got[60] == got[61] == ("", 0) and html_text.main_text(pages, net).count() == 64
    assert html_text.main_text(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0


def test_pages_without_article_still_train(spark):
    page = "<body><ul><li><a href=x>Home</a></li></ul><div><p>{}</p></div><p>ok</p></body>"
    pages = spark.createDataFrame([(i, "u", page.format("A sentence of ten and more words that goes on, " * (i % 3 + 1))) for i in range(40)], "page_id long, url string, html string")
    texts = [r.text for r in html_text.main_text(pages, html_text.fit(pages)).collect()]
    assert all(t.startswith("A sentence") and "Home" not in t for t in texts)


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs.withColumnRenamed("all", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        assert out.where("doc_id is null").count() == 1, name
        assert name == "sentencepiece" or out.columns == rows.columns
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0, name
