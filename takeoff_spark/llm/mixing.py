"""Mixing sources to target weights, with DataFrame functions only.

A word table fitted on labelled documents gives every document soft memberships in the domains. A
projected-gradient least-squares fit then finds a nonnegative rate for each document so that the expected
tokens of each domain meet its target. Per round the driver sees one number a domain.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def words_of(text: Column) -> Column:
    """Words between ASCII white space (and empty strings where several follow each other)."""
    return F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), "\n\t\r\x0b\x0c", "     "), " ")


def word_weights(docs: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int = 1500, smoothing: float = 3.0) -> tuple[DataFrame, list[float]]:
    """(h, w0, w1, ...): for each word (by its hash) the logs of how much oftener a domain's documents have it than all, less their mean; and the log priors.

    Fitted on at most ``per_domain`` labelled documents of each domain (those of the smallest id hash), whole texts,
    every word of theirs. ``smoothing`` is added to the documents found and expected, so rare words weigh little in
    domains of any size.
    """
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = None
    for d in domains:
        part = known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        sample = part if sample is None else sample.unionByName(part)
    sample = materialise(sample, "sample")
    size = dict(sample.groupBy("domain").count().collect())
    total = dict(known.groupBy("domain").count().collect())
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("domain", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).where("word != ''")
    per = seen.groupBy(F.xxhash64("word").alias("h")).agg(*[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)])
    n, sampled = sum((F.col(f"n{k}") for k in range(1, len(domains))), F.col("n0")), max(1, sum(size.values()))
    logs = [F.log((F.col(f"n{k}") + smoothing) / (n * (size.get(d, 0) / sampled) + smoothing)) for k, d in enumerate(domains)]
    mean = sum(logs[1:], logs[0]) / len(domains)
    priors = [(total.get(d, 0) + 1.0) / (sum(total.values()) + len(domains)) for d in domains]
    return materialise(per.select("h", *[(x - mean).alias(f"w{k}") for k, x in enumerate(logs)]), "words"), [math.log(p) for p in priors]


def memberships(docs: DataFrame, weights: DataFrame, priors: list[float]) -> DataFrame:
    """doc_id, tokens (words between blanks and line ends) and p0, p1, ...: posteriors, tempered by the root of the words known."""
    k = range(len(priors))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode_outer(words_of(F.col("text"))).alias("word")).where("doc_id is not null")
    few = weights.count() <= 1_000_000  # numbers only, 8 bytes a domain and word; joined by a shuffle beyond
    hits = words.withColumn("h", F.xxhash64("word")).join(F.broadcast(weights) if few else weights, "h", "left")
    sums = hits.groupBy("doc_id").agg(F.count_if(F.col("word") != "").alias("tokens"), F.count("w0").alias("known"), *[F.sum(f"w{i}").alias(f"s{i}") for i in k])
    logit = [F.lit(priors[i]) + F.coalesce(F.col(f"s{i}") / F.sqrt(F.greatest(F.col("known"), F.lit(1))), F.lit(0.0)) for i in k]
    sums = sums.select("doc_id", "tokens", *[x.alias(f"z{i}") for i, x in enumerate(logit)])
    top = F.greatest(*[F.col(f"z{i}") for i in k]) if len(priors) > 1 else F.col("z0")
    sums = sums.select("doc_id", "tokens", *[F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in k])
    norm = sum((F.col(f"e{i}") for i in k[1:]), F.col("e0"))
    return sums.select("doc_id", "tokens", *[(F.col(f"e{i}") / norm).alias(f"p{i}") for i in k])


def fit_rates(members: DataFrame, targets: list[float], least: float = 0.0, budget: float | None = None, rounds: int = 120, tolerance: float = 1e-4) -> DataFrame:
    """Adds ``rate`` >= least: expected tokens sum(rate * tokens * p_k) come to budget * target_k; and ``misfit``.

    ``misfit`` is the largest deviation of a domain from its target when the fit ended, as a part of the budget. It
    stays above ``tolerance`` where targets can't be met (no tokens, memberships that are all alike, or more than
    ``rounds`` rounds needed); the fit warns of that.

    Without a budget: all tokens, or for least > 0 a twentieth more than the smallest total that needs no rate below
    it (at that total itself, documents of several domains leave a domain above its target). Each round
    moves every rate against the gradient of the squared misfit and projects it to its bound; the gradient is
    preconditioned by the domains' Gram matrix over the rates above their bound (domains x domains numbers).
    """
    k = range(len(targets))
    have = members.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col(f"p{i}")) for i in k]).first()
    total, mass = float(have[0] or 0), [float(x or 0) for x in have[1:]]
    if not total:
        return members.withColumn("rate", F.lit(max(1.0, least))).withColumn("misfit", F.lit(1.0))
    share = [t / sum(targets) for t in targets]
    if budget is None:
        budget = total if not least else 1.05 * max(total, *(least * m / s for m, s in zip(mass, share, strict=True) if s > 0))
    goal = [budget * s for s in share]
    now = members.withColumn("rate", F.lit(max(1.0, least)))
    history: list[list[float]] = []

    def moved() -> Column:
        if not history:
            return F.col("rate")
        steps = F.array(*[F.array(*map(F.lit, s)) for s in history])
        return F.aggregate(steps, F.col("rate"), lambda r, s: F.greatest(F.lit(float(least)), r - sum((F.col(f"p{i}") * s[i] for i in k[1:]), F.col("p0") * s[0])))

    def at_work() -> Column:
        return F.when(F.col("rate") > least, F.col("tokens")).otherwise(0)

    pairs = [(i, j) for i in k for j in range(i, len(targets))]
    step, before, best = 1.0, float("inf"), []
    for _ in range(rounds):
        sums = [F.sum(F.col("rate") * F.col("tokens") * F.col(f"p{i}")) for i in k] + [F.sum(at_work() * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs]
        got = [float(x or 0) for x in now.select("tokens", *[f"p{i}" for i in k], moved().alias("rate")).agg(*sums).first()]
        off = [x - g for x, g in zip(got, goal, strict=False)]
        misfit = max(map(abs, off))
        best.append(min([misfit, *best[-1:]]))
        if misfit <= tolerance * budget or (len(best) > 12 and best[-1] > 0.98 * best[-13]):
            break  # met, or twelve rounds without progress: the targets are out of reach
        step, before = (step / 2 if misfit > before else min(1.0, step * 1.5)), misfit
        gram = np.zeros((len(targets), len(targets)))
        for (i, j), x in zip(pairs, got[len(targets) :], strict=True):
            gram[i, j] = gram[j, i] = x
        gram += np.diag([1e-6 * total + 1e-3 * m for m in mass])
        history.append([float(step * x) for x in np.linalg.solve(gram, off)])
        if len(history) == 12:
            now = materialise(now.withColumn("rate", moved()), "rates")
            history = []
    if misfit > tolerance * budget:
        warnings.warn(f"the mixture misses its targets by {misfit / budget:.4f} of the tokens", stacklevel=2)
    return now.withColumn("rate", moved()).withColumn("misfit", F.lit(misfit / budget))


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0, budget: float | None = None) -> DataFrame:
    """doc_id, tokens, p_<domain> for each target, rate, copies (whole numbers whose mean is the rate) and misfit (see ``fit_rates``).

    ``labelled``: doc_id and domain of some documents. A null or empty text has no tokens and the prior as its
    memberships; rows with a null doc_id are left out; rows that repeat a doc_id are one document (tokens add
    up); a document labelled twice takes its first domain by name. Without labels all memberships are equal.
    Copies are drawn by a hash of the id, so a rerun draws the same.
    """
    domains = list(targets)
    weights, priors = word_weights(docs, labelled, domains)
    members = materialise(memberships(docs, weights, priors), "members")
    rates = fit_rates(members, [targets[d] for d in domains], least, budget)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return rates.select("doc_id", "tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)], "rate", F.floor(F.col("rate") + draw).cast("int").alias("copies"), "misfit")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0, budget: float | None = None) -> DataFrame:
    """The documents, each as often as its rate says (``copies`` of ``mixing_rates``), all columns as they came; rows with a null doc_id stay once."""
    rates = materialise(mixing_rates(docs, labelled, targets, least, budget).select(F.col("doc_id").alias("id"), "copies"), "copies")
    few = rates.count() <= 1_000_000  # at most 16 MB; joined by a shuffle beyond
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("all"), F.col("doc_id").cast("long").alias("id"))
    joined = rows.join(F.broadcast(rates) if few else rates, "id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return joined.where("copies > 0").select("all", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"all.`{c}`") for c in docs.columns])


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic, else high or low quality."""
    return labels.where("doc_id is not null and coalesce(toxic, quality) is not null").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain")).where("domain is not null")
