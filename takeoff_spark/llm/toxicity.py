"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

Words are hashed to embeddings; filters of several widths slide over the whole text, each keeps its
largest response (max pooling), a logistic layer makes the score. A score never sees language,
source, label or id; only the decision to reject uses a threshold chosen for the row's language.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, hash64, in_slices, map_rows, materialise, parts_of, release

BUCKETS = 1 << 24
WIDTHS = (1, 2, 3)
GAP = max(WIDTHS) - 1
STRIP = string.punctuation + "¡¿«»“”„’‘…–—"
FOLDS = 5
#: Steps of the scores among which thresholds are chosen.
STEPS = 1000
#: Positions of a text that are pooled at once.
CHUNK = 50_000


def bucket(word: str) -> int:
    return hash64(word.strip(STRIP).encode()) % BUCKETS


@dataclass
class Model:
    """Embeddings of the hash buckets that two training documents have (row 0: all others), filters, output layer."""

    rows: dict[int, int]
    emb: np.ndarray
    filters: list[np.ndarray]  # per width: (width, dims, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    _tables: list | None = None
    _memo: Memo | None = None

    def lookup(self) -> Memo:
        if self._memo is None:
            self._memo = Memo(lambda w: self.rows.get(bucket(w), 0), 100_000)
        return self._memo

    def ids(self, text: str) -> np.ndarray:
        look = self.lookup().__getitem__
        return np.concatenate([np.fromiter(map(look, part.lower().split()), np.int32) for part in parts_of(text)])

    def tables(self) -> list[np.ndarray]:
        """Per offset, each embedding row's part in the responses of the filters that reach so far (widest first)."""
        if self._tables is None:
            self._tables = [np.concatenate([self.emb @ f[o] for f in reversed(self.filters) if len(f) > o], axis=1) for o in range(GAP + 1)]
        return self._tables

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        """Largest response of each filter in each document (columns widest first); CHUNK positions at a time."""
        sizes = np.array([len(d) + GAP + 1 for d in docs])
        starts = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        ids = np.zeros(n + GAP, np.int32)
        for s, d in zip(starts, docs, strict=True):
            ids[s : s + len(d)] = d
        tables = self.tables()
        out = np.full((len(docs), tables[0].shape[1]), -np.inf, np.float32)
        for a in range(0, n, CHUNK):
            b = min(n, a + CHUNK)
            act = tables[0][ids[a:b]]
            for o, t in enumerate(tables[1:], 1):
                act[:, : t.shape[1]] += t[ids[a + o : b + o]]
            first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b)
            out[first:last] = np.maximum(out[first:last], np.maximum.reduceat(act, np.maximum(starts[first:last] - a, 0), axis=0))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        width = len(self.bias) // len(WIDTHS)
        order = np.concatenate([np.arange(k * width, (k + 1) * width) for k in reversed(range(len(WIDTHS)))])
        hidden = np.maximum(self.pooled([self.ids(t) for t in texts]) + self.bias[order], 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out[order] + self.out_bias, -30, 30).astype(np.float64)))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.thresholds.get("", 0.5))

    def __getstate__(self):
        return {**self.__dict__, "_tables": None, "_memo": None}


def constant(rate: float) -> Model:
    """The model for labels that are missing or all alike."""
    logit = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    return Model({}, np.zeros((1, 1), np.float32), [np.zeros((w, 1, 1), np.float32) for w in WIDTHS], np.zeros(len(WIDTHS), np.float32), np.zeros(len(WIDTHS), np.float32), logit)


def train(texts: list[str], labels: list[int], dims: int = 8, filters: int = 8, epochs: int = 9, seed: int = 7, rate: float = 0.02) -> Model:
    """Fit by stochastic gradients; gradients run through the pooled positions only."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    words = [np.array([bucket(w) for w in t.lower().split()], np.int64) for t in texts]
    # buckets of one document only tell nothing about others: they share row 0
    seen, count = np.unique(np.concatenate([np.unique(d) for d in words]), return_counts=True)
    buckets = {b: i for i, b in enumerate(seen[count > 1].tolist(), 1)}
    docs = [np.array([buckets.get(b, 0) for b in d.tolist()], np.int64) for d in words]
    n = len(buckets) + 1
    with_pos, with_any = np.zeros(n), np.zeros(n)
    for d, label in zip(docs, y, strict=True):
        u = np.unique(d)
        with_any[u] += 1
        with_pos[u] += label
    base = y.mean()
    odds = np.log((with_pos + 5 * base) / (with_any - with_pos + 5 * (1 - base))) - np.log(base / (1 - base))
    emb = rng.normal(0, 0.05, (n, dims))
    emb[:, 0] = odds  # words start from their smoothed log-odds
    emb[0] = 0
    w = [rng.normal(0, 0.2, (k, dims, filters)) for k in WIDTHS]
    for f in w:
        f[0, 0, : filters // 2] = 1.0
    b, v, c = np.zeros(filters * len(WIDTHS)), np.full(filters * len(WIDTHS), 0.1), float(np.log(base / (1 - base)))
    v += rng.normal(0, 0.02, v.shape)
    cache = [np.zeros_like(x) + 1e-6 for x in (emb, *w, b, v)]
    cache_c = 1e-6
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            g_emb_rows, g_emb = [], []
            g_w, g_b, g_v, g_c = [np.zeros_like(f) for f in w], np.zeros_like(b), np.zeros_like(v), 0.0
            for d in some:
                ids = np.concatenate([docs[d], np.zeros(GAP + 1, np.int64)])
                x = emb[ids]
                m = len(docs[d]) + 1
                best, top = [], []
                for f in w:
                    act = sum(x[o : o + m] @ f[o] for o in range(len(f)))
                    pos = act.argmax(axis=0)
                    best.append(pos)
                    top.append(act[pos, np.arange(filters)])
                z = np.concatenate(top) + b
                h = np.maximum(z, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ v + c, -30, 30)))
                err = p - y[d]
                g_v += err * h
                g_c += err
                dz = err * v * (z > 0)
                g_b += dz
                for k, f in enumerate(w):
                    part = dz[k * filters : (k + 1) * filters]
                    for o in range(len(f)):
                        rows = ids[best[k] + o]
                        g_w[k][o] += emb[rows].T * part
                        g_emb_rows.append(rows)
                        g_emb.append((f[o] * part).T)
            rows = np.concatenate(g_emb_rows)
            u, back = np.unique(rows, return_inverse=True)
            g = np.zeros((len(u), dims))
            np.add.at(g, back, np.concatenate(g_emb))
            g[u == 0] = 0
            cache[0][u] += g**2
            emb[u] -= step * g / np.sqrt(cache[0][u])
            for x, gx, cx in zip((*w, b, v), (*g_w, g_b, g_v), cache[1:], strict=True):
                gx = gx + 1e-4 * x
                cx += gx**2
                x -= step * gx / np.sqrt(cx)
            cache_c += g_c**2
            c -= step * g_c / np.sqrt(cache_c)
    return Model(buckets, emb.astype(np.float32), [f.astype(np.float32) for f in w], b.astype(np.float32), v.astype(np.float32), c)


def calibrate(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold of most right decisions, from the counts of clean and toxic documents by step of the score; the nearest to 0.5 of ties."""
    below = np.concatenate([[0], np.cumsum(clean)])
    above = toxic.sum() - np.concatenate([[0], np.cumsum(toxic)])
    right = (below + above)[1:-1]  # neither all nor none are rejected
    best = np.flatnonzero(right == right.max()) + 1
    return float(best[np.argmin(np.abs(best - STEPS / 2))]) / STEPS


def fold() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"))


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (1 wins where labels of an id differ) outside fold 0, which no part of the fit sees."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    return known.where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def training_texts(docs: DataFrame, known: DataFrame, clean: int, toxic: int, most_chars: int) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most so many documents of each class in folds 2 to 4, of ``most_chars`` characters together.

    Ids of the smallest hashes come first; a text that doesn't fit into what is left of ``most_chars`` is passed
    over. Of rows that repeat an id the smallest text stands, so the driver gets a bounded number of rows.
    """
    known = known.where(fold() > 1)
    pick = lambda x, n: known.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(0, clean).unionByName(pick(1, toxic))  # at most clean + toxic rows, so it may be broadcast
    sample = materialise(_texts(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    left, some = most_chars, []
    for doc, n in sample.select("doc_id", F.length("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if n <= left:
            left -= n
            some.append((doc,))
    chosen = sample.sparkSession.createDataFrame(some, "doc_id long")
    rows = sample.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").select("text", "toxic").collect()
    return [r.text for r in rows], [r.toxic for r in rows]


def thresholds(docs: DataFrame, known: DataFrame, model: Model, least: int = 20, languages: int = 1000) -> dict[str, float]:
    """Per language the threshold of most right decisions over all labelled documents of fold 1, scored whole; '' is for all others.

    Languages with fewer than ``least`` such rows or only one label take the common threshold, as do those after the
    ``languages`` most frequent. The driver sees counts by language and step of the score only.
    """
    ids = known.where(fold() == 1)
    few = ids.count() <= 1_000_000  # 12 MB at most, a shuffle beyond
    rows = _texts(docs).join(F.broadcast(ids) if few else ids, "doc_id")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda b: {"lang": b.column("lang"), "toxic": b.column("toxic"), "step": np.floor(shipped.value.scores(b.column("text").to_pylist()) * STEPS).astype(np.int32)}

    steps = map_rows(rows.select("text", "lang", "toxic"), make, "lang string, toxic int, step int")
    counts = materialise(steps.groupBy("lang", "step").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")), "counts")
    some = counts.groupBy("lang").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.expr(f"lang != '' and c > 0 and t > 0 and c + t >= {least}")).orderBy(F.expr("c + t").desc(), "lang").limit(languages)
    every = counts.groupBy(F.lit("").alias("lang"), "step").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = counts.join(F.broadcast(some.select("lang")), "lang").select("lang", "step", "clean", "toxic").union(every).collect()
    table: dict[str, np.ndarray] = {}
    for lang, step, c, t in got:
        table.setdefault(lang, np.zeros((2, STEPS + 1), np.int64))[:, step] = c, t
    return {lang: calibrate(*x) for lang, x in table.items() if x.any(axis=1).all() and x.sum() >= least}


def fit(docs: DataFrame, labels: DataFrame, clean: int = 3300, toxic: int = 1650, most_chars: int = 30_000_000) -> Model:
    """Train on a bounded sample of whole texts (see ``training_texts``), then choose thresholds on all labelled documents of fold 1.

    Without labelled documents, or with one label only, every score is the same.
    """
    known = materialise(known_labels(labels), "known")
    model = train(*training_texts(docs, known, clean, toxic, most_chars))
    release()  # the driver's training took some hundred MB
    if len(model.emb) > 1:
        model.thresholds = thresholds(docs, known, model)
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (fold 0), score in [0, 1], predicted (score >= 0.5), threshold of the row's language, rejected.

    A null text is the empty one and gets the score of a text without words; repeated rows give repeated
    rows; a null or unknown language takes the common threshold. No shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def make():
        m = shipped.value
        return lambda b: {"doc_id": b.column("doc_id"), "score": m.scores(b.column("text").to_pylist()), "threshold": list(map(m.threshold, b.column("lang").to_pylist()))}

    out = map_rows(_texts(docs), make, "doc_id long, score double, threshold double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, all columns as they came: scored in place, without a join. Rows with a null doc_id are scored, too."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        m = shipped.value
        for b in batches:
            texts = [t or "" for t in b.column(names.index("text")).to_pylist()]
            langs = b.column(names.index("lang")).to_pylist() if "lang" in names else [""] * len(texts)
            yield b.filter(pa.array(m.scores(texts) < np.array(list(map(m.threshold, langs))), pa.bool_()))

    return docs.mapInArrow(in_slices(run), docs.schema)
