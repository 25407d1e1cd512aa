"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A hash flips signs, applies the fast Hadamard transform, three times over, and takes the axis of the largest component
with its sign; ``hashes`` of them make the code of a table. A vector lies in its own bucket and is probed in the
buckets of its next best codes. Equal vectors collapse first. Of a bucket over BLOCK vectors those within half the
angle of its mean form a ball: all pairs in a ball are links for sure and are counted, not compared, so that a group of
near copies costs no squares. All other pairs that share a bucket are compared in blocks, as products of matrices;
blocks give numbers of links and roots, no pairs. A pair counts in the first table that finds it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_slices, materialise
from .components import components

#: Vectors on a side of a block.
BLOCK = 512
#: Distinct buckets whose sums a task holds at once.
HELD = 4096
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two wide), not scaled."""
    n, width, half = *x.shape, 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x


def probes(x: np.ndarray, table: int, hashes: int, count: int, seed: int = 7) -> np.ndarray:
    """Codes of unit vectors in one table: the own one, then the ``count - 1`` that lose least by another axis in one hash."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    best, others, losses = [], [], []
    for k in range(hashes):
        signs = np.random.default_rng((seed, table, k)).choice((-1.0, 1.0), (ROUNDS, width))
        y = padded
        for s in signs:
            y = hadamard(y * s) / math.sqrt(width)
        size = np.abs(y)
        top = np.argsort(-size, axis=1, kind="stable")[:, : min(count, width)]
        axis = 2 * top + (np.take_along_axis(y, top, 1) < 0)
        best.append(axis[:, 0])
        others.append(axis[:, 1:])
        at = np.take_along_axis(size, top, 1)
        losses.append(at[:, :1] - at[:, 1:])
    weights = [(2 * width) ** k for k in range(hashes)]
    own = sum(w * b for w, b in zip(weights, best, strict=True))
    changed = np.concatenate([own[:, None] + w * (o - b[:, None]) for w, b, o in zip(weights, best, others, strict=True)], axis=1)
    order = np.argsort(np.concatenate(losses, axis=1), axis=1, kind="stable")[:, : count - 1]
    return np.concatenate([own[:, None], np.take_along_axis(changed, order, 1)], axis=1).astype(np.int64)


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of codes meet: the own code of one among the codes of the other."""
    return (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)


def tables_for(width: int, cosine: float, hashes: int, count: int, miss: float) -> int:
    """Tables that miss a pair at the threshold with a probability of ``miss`` at most, by pairs drawn at that angle."""
    draw = np.random.default_rng(1)
    a, b = draw.normal(size=(2, 4000, max(2, width)))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = cosine * a + math.sqrt(1 - cosine**2) * b
    found = np.mean([met(probes(a, t, hashes, count), probes(b, t, hashes, count)).mean() for t in range(4)])
    return max(1, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - 0.97 * found))))


def unit_rows(column) -> np.ndarray:
    """Rows of a list column (equal lengths) as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1)[:, None]  # no overflow, no underflow
    return x / np.linalg.norm(x, axis=1)[:, None]


def code_rows(column, count: int) -> np.ndarray:
    """Rows x tables x probes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1, count)


def by_width(batch: pa.RecordBatch, column: int):
    """(positions, rows) of the batch for each length of the list column."""
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    for w in np.unique(sizes):
        at = np.flatnonzero(sizes == w)
        yield at, batch.take(pa.array(at))


def compare(t: pa.Table, table: int, same: bool, first: int, cosine: float, count: int) -> list[np.ndarray]:
    """(vector, links, root) of the vectors of one block that have a link. ``same``: a chunk with itself."""
    u, n, ball, own = (t[c].to_numpy() for c in ("u", "n", "ball", "own"))
    x, codes = unit_rows(t["v"]), code_rows(t["codes"], count)
    left = np.arange(len(u)) if same else np.flatnonzero(t["chunk"].to_numpy() == first)
    right = left if same else np.flatnonzero(t["chunk"].to_numpy() != first)
    a, b = np.nonzero(x[left] @ x[right].T >= cosine)
    a, b = left[a], right[b]
    keep = (own[a] | own[b]) & ((ball[a] != ball[b]) | (ball[a] < 0))
    if same:
        keep &= a < b
    a, b = a[keep], b[keep]
    links, root = np.zeros(len(u), np.int64), u.copy()
    new = np.ones(len(a), bool)
    for earlier in range(table):
        new &= ~met(codes[a, earlier], codes[b, earlier])
    # in one table a pair may meet in the bucket of either: the smaller code counts
    for p, q in ((a, b), (b, a)):
        here, there = codes[p, table, 0], codes[q, table, 0]
        new &= ~(own[p] & ~own[q] & (there < here) & (codes[p, table] == there[:, None]).any(axis=1))
    np.add.at(links, a[new], n[b[new]])
    np.add.at(links, b[new], n[a[new]])
    while len(a):
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        if (least == root).all():
            break
        root = least
    some = np.flatnonzero((links > 0) | (root != u))
    return [u[some], links[some], root[some]]


def near_vectors(vectors: DataFrame, cosine: float = 0.93, hashes: int = 3, count: int = 4, miss: float = 1e-6, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept and n_copies of every row; rows of one label are linked from ``cosine`` on.

    Rows with a null label, a null or empty vector, only zeros or null or non-finite components link with nothing, nor do
    vectors of different lengths; such rows, and those with a null id, come back with 0 links, themselves as component
    and kept. Rows that repeat an id or a vector are vectors each (n_copies: rows with the same label and
    vector). An empty table gives no rows. Further columns don't matter. Pairs at the threshold are missed with a
    probability of ``miss``, closer ones less; what is linked is verified in double precision.
    """
    x, finite = F.col("v"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(F.col(vec_col).cast("array<double>"), lambda e: e + F.lit(0.0)).alias("v"))
    fits = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, finite) & F.exists(x, lambda e: e != 0), F.lit(False))
    key = F.when(fits, F.sha2(F.concat_ws("|", F.to_json(F.struct("label")), F.to_json(F.struct("v"))), 256)).alias("key")
    keyed = materialise(rows.select("vec_id", "label", "v", key), "keyed")
    classes = keyed.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialise(classes.withColumn("u", F.monotonically_increasing_id()).withColumn("space", F.xxhash64("label", F.size("v"))), "classes")
    width = classes.agg(F.max(F.size("v"))).first()[0] or 1
    tables = tables_for(width, cosine, hashes, count, miss)

    def coded(batches):
        for b in batches:
            for _, part in by_width(b, 3):
                codes = np.stack([probes(unit_rows(part.column(3)), t, hashes, count) for t in range(tables)], axis=1).reshape(len(part), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["u", "n", "space", "v", "codes"])

    hashed = materialise(classes.select("u", "n", "space", "v").mapInArrow(in_slices(coded), "u long, n long, space long, v array<double>, codes array<long>"), "hashed")
    places = hashed.select("u", "space", F.posexplode("codes").alias("at", "code")).select("u", "space", F.floor(F.col("at") / count).cast("int").alias("t"), (F.col("at") % count == 0).alias("own"), "code")
    bucket = ["space", "t", "code"]
    members = materialise(balls(hashed, places.where("own"), cosine), "balls").select("u", "ball")

    # Buckets in which two vectors meet, their chunks of one ball each (or of none) and the pairs of chunks
    few = places.groupBy(*bucket).agg(F.count("*").alias("all"), F.count_if("own").alias("mains")).where("all > 1 AND mains > 0").select(*bucket)
    shared = places.join(few, bucket).join(members, "u", "left").withColumn("ball", F.coalesce("ball", F.lit(-1)))
    groups = shared.groupBy(*bucket, "ball").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    by_bucket = Window.partitionBy(*bucket)
    groups = groups.select("*", F.sum("chunks").over(by_bucket).alias("all"), (F.sum("chunks").over(by_bucket.orderBy("ball")) - F.col("chunks")).alias("from")).where("ball < 0 OR all > chunks")
    chunk = F.col("from") + F.pmod(F.xxhash64("u"), "chunks")
    own_ball = (F.col("ball") >= 0) & (F.col("other") >= F.col("from")) & (F.col("other") < F.col("from") + F.col("chunks"))
    dealt = shared.join(groups, [*bucket, "ball"]).withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1))).where(~own_ball)
    dealt = dealt.select("u", "ball", "own", "t", "space", "code", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    full = dealt.join(hashed.select("u", "n", "v", "codes"), "u")

    def block(key, t):
        i, j = key[3].as_py(), key[4].as_py()
        found = compare(t, key[1].as_py(), i == j, i, cosine, count)
        return pa.table(found, names=["u", "links", "root"])

    linked = materialise(full.groupBy("space", "t", "code", "i", "j").applyInArrow(block, "u long, links long, root long"), "linked")
    of_ball = members.join(hashed.select("u", "n"), "u").groupBy("ball").agg(F.sum("n").alias("in_ball"), F.min("u").alias("root"))
    in_balls = members.join(of_ball, "ball").join(hashed.select("u", "n"), "u").select("u", (F.col("in_ball") - F.col("n")).alias("links"), "root")
    every = linked.unionByName(in_balls)
    parts = components(every.where("u <> root").select(F.col("u").alias("a"), F.col("root").alias("b")))
    parts = parts.join(classes.select(F.col("u").alias("node"), "least"), "node")
    named = parts.select("node", "component").join(parts.groupBy("component").agg(F.min("least").alias("id")), "component").select(F.col("node").alias("u"), "id")
    result = classes.select("key", "u", "n", "least").join(every.groupBy("u").agg(F.sum("links").alias("links")), "u", "left").join(named, "u", "left").select("key", "n", "links", F.coalesce("id", "least").alias("id"))
    out = keyed.select("vec_id", "key").join(result, "key", "left")
    component = F.coalesce("id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"), F.coalesce("n", F.lit(1)).alias("n_copies"))


def balls(hashed: DataFrame, own: DataFrame, cosine: float) -> DataFrame:
    """(u, ball) of vectors within half the angle of the mean of their largest bucket of more than BLOCK vectors; a ball's name is a hash of the bucket."""
    bucket, half = ["space", "t", "code"], math.cos(math.acos(cosine) / 2) + 1e-9
    hot = own.groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    name = F.shiftrightunsigned(F.xxhash64(*bucket), 1)
    largest = own.join(hot, bucket).groupBy("u").agg(F.max(F.struct("size", -F.col("t"), name.alias("ball"))).alias("most")).select("u", F.col("most.ball").alias("ball"))
    members = largest.join(hashed.select("u", "v"), "u")

    def sums(batches):
        held: dict[int, np.ndarray] = {}

        def given():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tolist() for x in held.values()], pa.list_(pa.float64()))], names=["ball", "total"])

        for b in batches:
            for _, part in by_width(b, 2):
                ball, x = part.column(1).to_numpy(), unit_rows(part.column(2))
                for k in np.unique(ball):
                    s = x[ball == k].sum(axis=0)
                    held[int(k)] = held[int(k)] + s if int(k) in held else s
                if len(held) > HELD:
                    yield from given()
                    held.clear()
        if held:
            yield from given()

    total = members.select("u", "ball", "v").mapInArrow(in_slices(sums), "ball long, total array<double>")
    # a partial sum a task and ball; components are added one by one
    means = total.select("ball", F.posexplode("total").alias("i", "x")).groupBy("ball", "i").agg(F.sum("x").alias("x")).groupBy("ball").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    near = members.join(means, "ball").where(dot(F.col("v"), F.col("mean")) >= half * F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("mean"), F.col("mean"))))
    return near.select("u", "ball")
