"""MinHash near-duplicates: HyperMinHash registers, banding, corrected estimates, exact verification.

A document's set of word shingles is dealt into REGISTERS buckets by its hashes' first bits; of each
bucket's smallest hash only the number of leading zeros and a few mantissa bits are kept (2 bytes).
Bands of registers propose pairs, the collision-corrected estimate drops the hopeless ones, full sets
decide. Copies of one set collapse first. Inside a band key documents are compared with hubs before
all others, so groups of copies need links in proportion to their size; what the hubs leave apart is
compared in blocks of bounded size, which hold the shingles that others share and give links only, no candidates.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, clean_text, hash64, keep_ids, map_rows, materialise, parts_of, released
from .components import components

REGISTERS = 128
MANTISSA = 10
BLOCK = 256
#: Shingles that a side of a block holds, about, where sets are compared (16 MB of longs).
BLOCK_HASHES = 2_000_000
#: Odd multipliers of the hash (fixed values, any odd numbers do).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_words = Memo(hash64, 100_000)


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, words end at ASCII white space.

    Fewer words than ``width``: the whole sequence is one shingle. No words: an empty set.
    """
    look = _words.__getitem__
    h = np.concatenate([np.fromiter(map(look, part.encode().lower().split()), np.uint64) for part in parts_of(text)])
    if not len(h):
        return np.zeros(0, np.uint64)
    n = min(width, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = mixed(total * np.uint64(MULTIPLIERS[i % 3]) + h[i : i + len(total)])
    return np.unique(total)


def _sources() -> np.ndarray:
    """For each register the order in which an empty one asks others (the same for all documents)."""
    i = np.arange(REGISTERS, dtype=np.uint64)
    return np.argsort(mixed(i[:, None] * np.uint64(REGISTERS) + i[None, :] + np.uint64(1)), axis=1)


SOURCES = _sources()


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (leading zeros and mantissa) of a non-empty set; empty buckets take another's."""
    bits = REGISTERS.bit_length() - 1
    place = (hashes >> np.uint64(64 - bits)).astype(np.int64)  # ascending, as the hashes are
    first = np.flatnonzero(np.diff(place, prepend=-1))
    rest = hashes[first] << np.uint64(bits)
    # leading zeros of the remaining bits: exponent of the float that they make
    mantissa, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.where(rest == 0, 63, 64 - exponent).clip(0, 63)
    kept = ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.int64).clip(0, (1 << MANTISSA) - 1)
    value = (zeros << MANTISSA | kept).astype("<u2")
    out = np.zeros(REGISTERS, "<u2")
    full = np.zeros(REGISTERS, bool)
    out[place[first]], full[place[first]] = value, True
    if len(first) < REGISTERS:
        empty = np.flatnonzero(~full)
        asked = full[SOURCES[empty]]
        out[empty] = out[SOURCES[empty, asked.argmax(axis=1)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers: equal ones, less the accidental collisions expected."""
    equal = (a == b).sum(axis=-1)
    n, m = np.maximum(na, nb).astype(float), np.minimum(na, nb).astype(float)
    phi = 4 * (n / m) / (1 + n / m) ** 2
    accidental = 0.1699 * REGISTERS / 2.0**MANTISSA * phi
    return np.clip((equal - accidental) / REGISTERS, 0, 1)


def least_estimate(threshold: float, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Below this no pair of the threshold is lost in practice: five standard deviations of the sketch."""
    return threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.minimum(REGISTERS, np.minimum(na, nb)))


def bands(threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, registers a band): the longest bands that miss a pair at the threshold with at most that probability."""
    for rows in range(8, 0, -1):
        n = REGISTERS // rows
        if (1 - threshold**rows) ** n <= miss:
            return n, rows
    return REGISTERS, 1


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), digest of the set, registers; no shuffle."""

    def make():
        def batch(b: pa.RecordBatch) -> dict:
            n, digest, regs = [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                regs.append(registers(s).tobytes() if len(s) else b"")
            return {"doc_id": b.column(0), "n": n, "digest": digest, "regs": regs}

        return batch

    return map_rows(clean_text(docs).where("doc_id is not null"), make, "doc_id long, n long, digest binary, regs binary")


def _fits(threshold: float) -> F.Column:
    """Sizes that allow the threshold."""
    return F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9)


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with their estimate, those out of reach left out."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(_fits(threshold))

    def run(batches):
        for t in batches:
            if t.num_rows:
                ra, rb = (np.frombuffer(b"".join(t.column(x).to_pylist()), "<u2").reshape(-1, REGISTERS) for x in ("ra", "rb"))
                na, nb = t.column("na").to_numpy(), t.column("nb").to_numpy()
                est = estimate(ra, rb, na, nb)
                keep = est >= least_estimate(threshold, na, nb)
                yield pa.RecordBatch.from_arrays([t.column("a").filter(pa.array(keep)), t.column("b").filter(pa.array(keep)), pa.array(est[keep])], names=["a", "b", "est"])

    return rows.mapInArrow(released(run), "a long, b long, est double")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def make():
        return lambda b: {"doc_id": b.column(0), "s": [shingles(t, width).view(np.int64) for t in b.column(1).to_pylist()]}

    # rows that repeat an id are one document: here the first text stands for it
    sets = materialise(map_rows(keep_ids(clean_text(docs), ids, "doc_id"), make, "doc_id long, s array<long>"), "sets")
    joined = pairs.select("a", "b").join(sets.withColumnsRenamed({"doc_id": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "s": "sb"}), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return joined.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct()


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose two ends are not in one component yet."""
    side = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _dealt(keys: DataFrame, members: DataFrame, comps: DataFrame) -> DataFrame:
    """Blocks (band, m) of the keys with several components: documents outside the key's largest component (q)
    against all its documents, up to BLOCK of each, fewer where their sets are long. members: rep, weight, further columns."""
    cols = [x for x in members.columns if x not in ("rep", "weight")]
    member = keys.join(members.select("rep", "weight"), "rep").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "band", "rep", "weight", F.coalesce("component", "rep").alias("c"))
    of_key = member.groupBy("key", "c").agg(F.count("*").alias("count"), F.sum("weight").alias("weight")).groupBy("key").agg(F.max(F.struct("count", "c", "weight")).alias("top"), F.sum("count").alias("total"), F.sum("weight").alias("weight"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n, weight: F.ceil(F.greatest(n / BLOCK, weight / BLOCK_HASHES)).cast("int")
    of_key = of_key.select("key", F.col("top.c").alias("top"), blocks(F.col("total"), F.col("weight")).alias("nb"), blocks(F.col("total") - F.col("top.count"), F.col("weight") - F.col("top.weight")).alias("nq"))
    rows = member.join(of_key, "key")
    at = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    right = rows.select("key", "band", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), at(1, "nb").alias("bb"), F.lit(False).alias("q"), "rep", "c")
    left = rows.where("c != top").select("key", "band", at(2, "nq").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bb"), F.lit(True).alias("q"), "rep", "c")
    dealt = left.union(right).join(members.drop("weight"), "rep")
    return dealt.groupBy("key", "band", "qb", "bb").agg(F.collect_list(F.struct("q", "rep", "c", *cols)).alias("m")).where("exists(m, x -> x.q)").select("m", "band")


def _block_arrays(t: pa.RecordBatch):
    """Of a batch of blocks: members as arrays, and (first, end, band) of each block."""
    m = t.column(0)
    flat, offsets = m.flatten(), m.offsets.to_numpy() - m.offsets[0].as_py()
    cols = {x: flat.field(x).to_numpy(zero_copy_only=False) for x in ("q", "rep", "c", "n")}
    regs = np.frombuffer(b"".join(flat.field("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
    return flat, cols["q"], cols["rep"], cols["c"], cols["n"], regs, zip(offsets[:-1], offsets[1:], t.column(1).to_pylist(), strict=True)


def _not_earlier(regs: np.ndarray, y: np.ndarray, x: int, band: int, n_rows: int) -> np.ndarray:
    """Which of ``y`` share no earlier band with ``x``: a pair is looked at in its first shared band."""
    same = (regs[y, : band * n_rows] == regs[x, : band * n_rows]).reshape(len(y), band, n_rows)
    return ~same.all(axis=2).any(axis=1)


def _undecided(keys: DataFrame, reps: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """doc_id of the documents that share a key with one of another component whose estimate is in reach."""

    def run(batches):
        for t in batches:
            flat, q, rep, c, n, regs, blocks = _block_arrays(t)
            seen = np.zeros(len(flat), bool)
            for i, j, _ in blocks:
                right = i + np.flatnonzero(~q[i:j])
                for x in i + np.flatnonzero(q[i:j]):
                    y = right[(c[right] != c[x]) & (np.minimum(n[right], n[x]) >= (threshold - 1e-9) * np.maximum(n[right], n[x]))]
                    if len(y):
                        y = y[estimate(regs[y], regs[x], n[y], n[x]) >= least_estimate(threshold, n[y], n[x])]
                        seen[y], seen[x] = True, seen[x] or len(y) > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(rep[seen]).astype(np.int64))], names=["doc_id"])

    groups = _dealt(keys, reps.select("rep", F.lit(REGISTERS // 4).alias("weight"), "n", "regs"), comps)
    return groups.mapInArrow(released(run), "doc_id long").distinct()


def _sharable(ids: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """rep, n (size of the set), s (its shingles that another of ``ids`` has too), for those that may have a link.

    An intersection within ``ids`` lies inside both s, so s decides as the full set does; and a document whose
    s is less than the threshold's part of its own set can't have a link.
    """

    def make():
        return lambda b: {"doc_id": b.column(0), "s": [shingles(t, width).view(np.int64) for t in b.column(1).to_pylist()]}

    sets = materialise(map_rows(keep_ids(clean_text(docs), ids, "doc_id"), make, "doc_id long, s array<long>"), "sets")
    lone = sets.select("doc_id", F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("k"), F.min("doc_id").alias("doc_id")).where("k = 1")
    lone = lone.groupBy("doc_id").agg(F.collect_list("h").alias("lone"))
    shared = F.array_except("s", F.coalesce("lone", F.array().cast("array<long>")))
    out = sets.join(lone, "doc_id", "left").select(F.col("doc_id").alias("rep"), F.size("s").cast("long").alias("n"), shared.alias("s"))
    return out.where(100 * F.size("s") >= percent * F.col("n"))


def _block_links(keys: DataFrame, members: DataFrame, comps: DataFrame, percent: int, n_rows: int) -> DataFrame:
    """(a, b): components that a link joins. Full sets decide inside the blocks; a block gives a spanning forest of its links."""

    def run(batches):
        for t in batches:
            flat, q, _, c, n, regs, blocks = _block_arrays(t)
            s = flat.field("s")
            at, hashes = s.offsets.to_numpy() - s.offsets[0].as_py(), s.flatten().to_numpy()
            size, found = np.diff(at), []
            for i, j, band in blocks:
                codes = np.unique(hashes[at[i] : at[j]], return_inverse=True)[1].ravel()
                mark, start = np.zeros(len(codes) + 1, bool), at[i]
                root = {x: x for x in c[i:j].tolist()}

                def find(x, root=root):
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                right = i + np.flatnonzero(~q[i:j])
                for x in i + np.flatnonzero(q[i:j]):
                    # what can be shared at most, against what the threshold asks of these sizes
                    y = right[(c[right] != c[x]) & ((100 + percent) * np.minimum(size[right], size[x]) >= percent * (n[right] + n[x]))]
                    if not len(y):
                        continue
                    y = y[_not_earlier(regs, y, x, band, n_rows)]
                    own = codes[at[x] - start : at[x + 1] - start]
                    mark[own] = True
                    for z in y.tolist():
                        a, b = find(int(c[x])), find(int(c[z]))
                        if a != b and (100 + percent) * int(np.count_nonzero(mark[codes[at[z] - start : at[z + 1] - start]])) >= percent * int(n[x] + n[z]):
                            root[max(a, b)] = min(a, b)
                            found.append((int(c[x]), int(c[z])))
                    mark[own] = False
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return _dealt(keys, members, comps).mapInArrow(released(run), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where 100 * intersection >= percent * union of shingle sets.

    component_id is the smallest doc_id that links reach (the document itself included); kept marks the
    documents that are their component's. Null or empty texts and texts of white space have an empty set
    and are linked with nothing. Rows with a null doc_id are left out (they have no name to report);
    rows that repeat a doc_id are one document. No caps: every pair that shares a band is settled by a
    full comparison unless its ends are in one component already or its estimate is five deviations low.
    """
    threshold = percent / 100
    n_bands, n_rows = bands(threshold)
    rows = materialise(sketches(docs, width), "sketches")
    reps = materialise(rows.where("n > 0").groupBy("digest", "n", "regs").agg(F.min("doc_id").alias("rep")), "reps")
    key = lambda b: F.xxhash64(F.lit(b), F.substring("regs", 1 + 2 * n_rows * b, 2 * n_rows))
    keys = reps.select("rep", F.posexplode(F.array(*map(key, range(n_bands)))).alias("band", "key"))
    hubs = keys.groupBy("key").agg(F.count("*").alias("k"), F.min(F.struct(F.xxhash64("key", "rep").alias("o"), "rep")).alias("hub")).where("k > 1").select("key", F.col("hub.rep").alias("hub"))
    keys = materialise(keys.join(hubs, "key"), "keys")  # those of more than one document
    pairs = keys.where("rep != hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"), "rep").distinct()
    pairs = _estimated(pairs.select("a", "b").distinct(), reps, threshold)
    pairs = materialise(pairs, "pairs")

    # each document with its best partners first
    best = pairs.select(F.explode(F.array("a", "b")).alias("x"), "a", "b", "est").groupBy("x").agg(F.max(F.struct("est", "a", "b")).alias("t")).select("t.a", "t.b").distinct()
    links = materialise(_verified(materialise(best, "best"), docs, width, percent), "links")
    comps = materialise(components(links), "components")

    def joined(found: DataFrame) -> DataFrame:
        if found.isEmpty():
            return comps
        stars = comps.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a < b")
        return materialise(components(stars.union(found.select("a", "b"))), "components")

    rest = materialise(_apart(pairs.join(best, ["a", "b"], "left_anti"), comps).select("a", "b"), "rest")
    if not rest.isEmpty():
        comps = joined(materialise(_verified(rest, docs, width, percent), "links"))
    # what hubs didn't settle: keys with several components
    keys = keys.select("key", "band", "rep")
    ids = materialise(_undecided(keys, reps, comps, threshold), "undecided")
    if not ids.isEmpty():
        members = materialise(_sharable(ids, docs, width, percent).join(reps.select("rep", "regs"), "rep").withColumn("weight", F.size("s")), "members")
        comps = joined(materialise(_block_links(keys, members, comps, percent, n_rows), "links"))

    classes = reps.select("digest", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "digest").join(classes, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, all columns as they came: one of each group, that of the smallest doc_id."""
    gone = materialise(near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    few = gone.count() <= 1_000_000  # 8 MB of ids, a shuffle beyond
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long") == F.col("gone"), "left_anti")
