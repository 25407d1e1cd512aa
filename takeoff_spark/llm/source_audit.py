"""Source divergence audit: exact term counts of every (lang, source) and how far they lie apart.

Terms are counted in tasks by length-bucketed packing: a term of up to 8 bytes is one uint64 word, one of up to 16 is
two; words are radix-sorted by 16-bit digits in numpy and runs are counted. Longer terms are sorted as bytes, in buckets of
8 bytes of length. What the tasks counted travels as packets of rows for each language, length and hash of the term, and is
added up in the same way; shares and divergences are integer arithmetic in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import in_slices, materialise, released

#: Bytes of text after which a task counts what it holds, distinct counts it keeps before it hands them on, and bytes of text after which it does so at the latest (counts have 32 bits till then).
HELD, KEPT, TOLD = 8 << 20, 1_000_000, 1 << 30
#: Buckets of the terms of a language and length, and bytes of packets that a task adds up at once, about (a bucket at least).
BUCKETS, MERGED = 1024, 8 << 20
#: Parts of a whole.
SCALE = 1_000_000_000

_byte = np.arange(256)
IN_TERM = (_byte >= 128) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122))
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by unsigned columns, the first counting most: passes over 16-bit digits (numpy's radix sort); digits that are all alike cost no pass."""
    order = np.arange(len(columns[0]))
    for c in reversed(columns):
        digits = np.ascontiguousarray(c).view("<u2").reshape(len(c), -1)
        for k in range(digits.shape[1]):
            d = digits[:, k]
            if len(d) and (d != d[0]).any():
                order = order[np.argsort(d[order], kind="stable")]
    return order


def run_counts(columns: list[np.ndarray], doc: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each run, occurrences, distinct documents) of ordered rows; equal columns make a run, in which ``doc`` ascends."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    d = doc[order]
    other = new.copy()
    other[1:] |= d[1:] != d[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order))), np.add.reduceat(other.astype(np.int64), first) if len(first) else first


def packed(data: np.ndarray, start: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
    """Terms of 8 * words bytes or up to 7 fewer as rows of big-endian uint64 words, filled up with zeros."""
    eights = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(7, np.uint8)), 8)
    out = np.empty((len(start), words), np.uint64)
    for k in range(words):
        out[:, k] = eights[start + 8 * k].view(">u8")[:, 0]
    spare = (8 * (8 * words - size)).astype(np.uint64)
    out[:, -1] = out[:, -1] >> spare << spare
    return out


def as_bytes(words: np.ndarray) -> np.ndarray:
    """Rows of words as byte strings; no term holds a zero byte."""
    return np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * words.shape[1]}")[:, 0]


def term_order(words: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Stable order by term, then group: digits for short terms, bytes for longer ones."""
    if words.shape[1] <= 2:
        return radix_order([*words.T, groups])
    return np.lexsort((groups, as_bytes(words)))


def packed_counts(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, words of the term, occurrences, documents) of texts, terms of as many words at a time; ``groups``: a number for each text."""
    data = LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    inside = IN_TERM[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, size = edge[::2], edge[1::2] - edge[::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    doc = np.searchsorted(begins, start, side="right") - 1
    width = (size + 7) // 8
    for w in np.flatnonzero(np.bincount(width)).tolist():
        at = np.flatnonzero(width == w)
        words, g = packed(data, start[at], size[at], w), groups[doc[at]].astype(np.uint32)
        first, n, docs = run_counts([*words.T, g], doc[at], term_order(words, g))
        yield g[first], words[first], n, docs


def counted(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """``packed_counts`` with terms as bytes."""
    for g, words, n, docs in packed_counts(texts, groups):
        yield g, as_bytes(words).tolist(), n, docs


def added(groups: np.ndarray, words: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (term, group) added up, ordered by term, then group."""
    order = term_order(words, groups)
    groups, words, n, docs = (x[order] for x in (groups, words, n, docs))
    new = np.ones(len(groups), bool)
    new[1:] = (groups[1:] != groups[:-1]) | (words[1:] != words[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return groups[first], words[first], np.add.reduceat(n, first), np.add.reduceat(docs, first)


class Tally:
    """Counts of a task: texts wait until there are HELD bytes, counts until there are KEPT, or come from TOLD bytes."""

    def __init__(self):
        self.groups: dict[int, int] = {}
        self.names, self.langs, self.lang_of = [], {}, []
        self.texts, self.of, self.size = [], [], 0
        self.counts: dict[int, list[tuple]] = {}
        self.kept, self.told = 0, 0

    def add(self, lang: str, group: int, text: bytes) -> None:
        g = self.groups.setdefault(group, len(self.groups))
        if g == len(self.names):
            self.names.append(group)
            self.lang_of.append(self.langs.setdefault(lang, len(self.langs)))
        self.texts.append(text)
        self.of.append(g)
        self.size += len(text) + 1

    def count(self) -> None:
        for part in packed_counts(self.texts, np.array(self.of)) if self.texts else ():
            self.counts.setdefault(part[1].shape[1], []).append(part)
            self.kept += len(part[0])
        self.told += self.size
        self.texts, self.of, self.size = [], [], 0

    def full(self) -> bool:
        return self.kept >= KEPT or self.told >= TOLD

    def packets(self, most: int = 500) -> Iterator[pa.RecordBatch]:
        """What was counted, as packets (lang, width, bucket, rows of term, group and counts, byte by byte); starts anew."""
        names, langs, of = np.array(self.names, np.int64).view(np.uint64), list(self.langs), np.array(self.lang_of, np.int64)
        counts, self.counts, self.kept, self.told = self.counts, {}, 0, 0
        for width in sorted(counts):
            g, words, n, docs = added(*(np.concatenate(x) for x in zip(*counts.pop(width), strict=True)))
            key = of[g] * BUCKETS + buckets(words)
            order = np.argsort(key, kind="stable")
            rows = np.empty((len(g), width + 2), np.uint64)
            rows[:, :width], rows[:, width], rows[:, width + 1] = words[order], names[g[order]], (n << 32 | docs).view(np.uint64)[order]
            keys, first = np.unique(key[order], return_index=True)
            ends = np.append(first, len(rows)).tolist()
            for i in range(0, len(keys), most):
                some = keys[i : i + most]
                parts = [rows[ends[k] : ends[k + 1]].view(np.uint8).T.tobytes() for k in range(i, i + len(some))]
                yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in (some // BUCKETS).tolist()], pa.string()), pa.array(np.full(len(some), width, np.int32)), pa.array((some % BUCKETS).astype(np.int32)), pa.array(parts, pa.binary())], names=["lang", "width", "bucket", "rows"])


def buckets(words: np.ndarray) -> np.ndarray:
    """A bucket for each term."""
    h = np.zeros(len(words), np.uint64)
    for w in words.T:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % BUCKETS


def term_packets(docs: DataFrame) -> DataFrame:
    """Packets of the terms that tasks counted; docs: lang, g (a number for lang and source), text."""

    def run(batches):
        tally = Tally()
        for b in batches:
            for lang, g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                tally.add(lang, g, t)
                if tally.size >= HELD:
                    tally.count()
                    if tally.full():
                        yield from tally.packets()
        tally.count()
        yield from tally.packets()

    return docs.select("lang", "g", "text").mapInArrow(in_slices(run), "lang string, width int, bucket int, rows binary")


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, whole (occurrences) and by (group and occurrences, ordered by group) of the terms in at least ``least_docs`` documents of their language."""
    schema = StructType.fromDDL("lang string, term string, whole long, by array<struct<g: long, n: long>>")
    out = to_arrow_schema(schema)

    def terms(lang, width, packets):
        m = np.concatenate([np.frombuffer(x, np.uint8).reshape(8 * (width + 2), -1).T for x in packets])
        m = np.ascontiguousarray(m).view(np.uint64)
        g, words, n, docs = added(m[:, width], m[:, :width], (m[:, -1] >> np.uint64(32)).astype(np.int64), (m[:, -1] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        new = np.ones(len(g), bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        stay = np.add.reduceat(docs, first) >= least_docs
        each = np.repeat(stay, np.diff(np.append(first, len(g))))
        ends = np.append(0, np.cumsum(np.diff(np.append(first, len(g)))[stay]))
        by = pa.StructArray.from_arrays([pa.array(g[each].view(np.int64)), pa.array(n[each])], names=["g", "n"])
        term = pa.array(as_bytes(words[first[stay]]).tolist(), pa.binary()).cast(pa.string())
        columns = [pa.array([lang] * len(term), pa.string()), term, pa.array(np.add.reduceat(n, first)[stay]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), by)]
        t = pa.RecordBatch.from_arrays([c.cast(x.type) for c, x in zip(columns, out, strict=True)], schema=out)
        for i in range(0, len(term), 20_000):
            yield t.slice(i, 20_000)

    def run(batches):
        now, bucket, held, size = None, None, [], 0
        for b in batches:
            for lang, width, k, rows in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True):
                # several buckets at once while they are small
                if held and ((lang, width) != now or (k != bucket and size >= MERGED)):
                    yield from terms(*now, held)
                    held, size = [], 0
                now, bucket = (lang, width), k
                held.append(rows.as_py())
                size += len(held[-1])
        if held:
            yield from terms(*now, held)

    keys = ["lang", "width", "bucket"]
    return term_packets(docs).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(run), schema)


def share(count: str, total: str, terms: str) -> str:
    """SQL: parts of SCALE that a count has, one added to each of ``terms`` counts; decimals where a long would overflow."""
    plain = f"({SCALE}L * ({count} + 1L)) div ({total} + {terms})"
    large = f"(cast({SCALE} AS decimal(10, 0)) * cast({count} + 1 AS decimal(20, 0))) div cast({total} + {terms} AS decimal(20, 0))"
    return f"(1 + CASE WHEN {count} < 9000000000L THEN {plain} ELSE {large} END)"


def distance(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def audit(docs: DataFrame, least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank: sources of a language set against each other, and terms that a source uses most beyond its language.

    A null text, lang or source is ''. Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII; a
    language keeps those in at least ``least_docs`` of its documents (rows that repeat are documents each). Part
    'pair' has all other sources of the language (value 0 without kept terms), part 'term' the ``ranks`` highest.
    Ties go to the smaller item by UTF-8. An empty table gives no rows. Any length of text is counted whole.

    Terms are pre-aggregated in tasks, so a hot source or term has a few rows a task; sources of a language are gathered by term
    (as many as there are, whose square the result holds). A pair's sum runs over the terms that both sources have; terms that
    one or both lack come from what each has alone and from the number of all terms.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(name("lang"), name("source"), name("text"))
    found = materialise(rows.select("lang", "source").distinct().withColumn("g", F.monotonically_increasing_id()), "sources")
    kept = materialise(kept_terms(rows.join(found, ["lang", "source"]), least_docs), "kept")
    langs = found.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("all_n")), "lang", "left").na.fill(0, ["v", "all_n"])
    each = kept.select("term", "whole", F.inline("by"))
    sums = each.groupBy("g").agg(F.sum("n").alias("total"))
    groups = found.join(sums, "g", "left").na.fill(0, ["total"]).join(langs, "lang")
    # the share of a term that the source lacks
    groups = materialise(groups.withColumn("lacking", F.expr(f"CASE WHEN v > 0 THEN {share('0L', 'total', 'v')} END")), "groups")

    # f over all terms is f of both counts where both have the term; elsewhere f of one count or none, which what each has alone gives, less what it gives where both have the term
    side = lambda x: groups.select(F.col("g").alias(x), F.col("total").alias(f"{x}_total"), F.col("v").alias(f"{x}_v"), F.col("lacking").alias(f"{x}0"))
    own = lambda x: F.expr(share(f"{x}_n", f"{x}_total", f"{x}_v")).alias(f"{x}1")
    one = kept.where(F.size("by") > 1).select("by", F.posexplode("by").alias("i", "e")).where(F.col("i") < F.size("by") - 1).select("by", "i", F.col("e.g").alias("x"), F.col("e.n").alias("x_n"))
    one = one.join(side("x"), "x").select("x", own("x"), "x0", F.explode(F.slice("by", F.col("i") + 2, F.size("by"))).alias("e"))
    both = one.select("x", "x1", "x0", F.col("e.g").alias("y"), F.col("e.n").alias("y_n")).join(side("y"), "y").select("x", "y", "x1", "x0", own("y"), "y0")
    beyond = lambda x, y: F.sum(F.expr(f"{distance(f'{x}1', f'{y}1')} - {distance(f'{x}1', f'{y}0')} - {distance(f'{x}0', f'{y}1')} + {distance(f'{x}0', f'{y}0')}"))
    both = both.groupBy("x", "y").agg(beyond("x", "y").alias("there"), beyond("y", "x").alias("back"))
    both = materialise(both.select(F.explode(F.array(F.struct("x", "y", F.col("there").alias("value")), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.col("back").alias("value")))).alias("p")).select("p.*"), "both")
    pairs = groups.select("lang", F.col("g").alias("x"), F.col("v"), F.col("lacking").alias("x0")).join(groups.select("lang", F.col("g").alias("y"), F.col("lacking").alias("y0")), "lang").where("x <> y")
    alone = materialise(each.groupBy("g", "n").agg(F.count("*").alias("terms")).join(groups, "g").select("lang", "g", "lacking", "terms", F.expr(share("n", "total", "v")).alias("p")), "alone")
    others = groups.select("lang", F.col("g").alias("other"), F.col("lacking").alias("q"))
    alone = alone.join(others, "lang").where("g <> other")
    mine = alone.groupBy(F.col("g").alias("x"), F.col("other").alias("y")).agg(F.sum(F.expr(f"terms * ({distance('p', 'q')} - {distance('lacking', 'q')})")).alias("value"))
    theirs = alone.groupBy(F.col("other").alias("x"), F.col("g").alias("y")).agg(F.sum(F.expr(f"terms * ({distance('q', 'p')} - {distance('q', 'lacking')})")).alias("value"))
    none = pairs.select("x", "y", F.expr(f"CASE WHEN v > 0 THEN v * ({distance('x0', 'y0')}) ELSE 0L END").alias("value"))
    summed = both.unionByName(mine).unionByName(theirs).unionByName(none).groupBy("x", "y").agg(F.sum("value").alias("value"))
    named = lambda c, g: found.select(*(["lang"] if g == "x" else []), F.col("source").alias(c), F.col("g").alias(g))
    pair = summed.join(named("source", "x"), "x").join(named("item", "y"), "y").select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    shares = each.join(groups, "g").select("lang", "source", F.col("term").alias("item"), F.expr(share("n", "total", "v")).alias("p"), F.expr(share("whole", "all_n", "v")).alias("q"))
    term = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr(distance("p", "q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = term.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= ranks)
    return pair.withColumn("rank", F.row_number().over(ranked)).unionByName(top).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


#: The same by DuckDB: every term of a language against every pair of its sources.
AUDIT_SQL = """
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    o AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
    k AS MATERIALIZED (SELECT lang, term, count(*) AS whole FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 3),
    c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
    l AS (SELECT lang, count(*) AS v, sum(whole) AS all_n FROM k GROUP BY ALL),
    g AS MATERIALIZED (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(all_n, 0) AS all_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
    p AS MATERIALIZED (SELECT g.lang, g.source, k.term, whole, coalesce(n, 0) AS n, all_n, g.v, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // (total + g.v) AS BIGINT) AS p FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    t AS (SELECT lang, source, term AS item, p, CAST(1 + (CAST(1000000000 AS HUGEINT) * (whole + 1)) // (all_n + v) AS BIGINT) AS q FROM p WHERE n > 0),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL SELECT lang, source, 'term', item, CAST((p - q) * (p - q) // q AS BIGINT) FROM t WHERE p > q)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""
