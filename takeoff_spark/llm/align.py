"""Cross-tokenizer alignment: which tokens of two vocabularies share bytes, and which pairs of identifiers belong together.

The tokens of both sides are intervals of one text's bytes. Sorted by start (lexsort), with the running
maximum of their ends (maximum.accumulate), a group breaks where a start reaches that maximum; inside a group every token of
one side is linked with every one of the other. Texts of a slice lie one behind the other, so one pass aligns them all.
Documents that hold a pair of identifiers are counted corpus-wide; what each document's links then add up to is
looked up bucket by bucket of pairs, in packets of many documents.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe_count import byte_alphabet
from .common import clean_text, in_slices, materialise, tokenizer_path
from .piece_codec import Codec, codec
from .token_files import Encoder, encoder, merges_by_rank

#: Buckets of identifier pairs (a prime), bytes of packets that meet a bucket's counts in one task, pairs of a task counted at once.
BUCKETS, PACKETS, COUNTED = 31, 16 << 20, 2_000_000
#: Groups of more links than this are expanded over their distinct identifiers.
LARGE = 4096


class Side:
    """Identifiers of texts and the bytes of each token."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes[ids]
        return self.bytes[np.repeat(self.starts[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


class ByteSide(Side):
    """A byte-level vocabulary; special tokens' strings are plain text."""

    def __init__(self, path: str, ranked: bool):
        self.encoder: Encoder = encoder(path, ranked, True)
        byte, vocab = {c: b for b, c in enumerate(byte_alphabet())}, self.encoder.lib.get_vocab()
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        super().__init__(tokens)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(" " + text), self.encoder.dtype).astype(np.int64)


class PieceSide(Side):
    """A sentencepiece vocabulary, which puts a blank before the text itself."""

    def __init__(self, path: str):
        self.codec: Codec = codec(path)
        c = self.codec
        super().__init__([c.bytes[s : s + n].tobytes() for s, n in zip(c.starts.tolist(), c.sizes.tolist(), strict=True)])

    def ids(self, text: str) -> np.ndarray:
        return np.concatenate([np.array(x, np.int64) for x in self.codec.plain(text)])


@lru_cache(2)
def sides(a: str, b: str, ranked: bool) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a, ranked), PieceSide(b)


def coalesced(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the group of each A and each B token; the tokens of each side follow one another without gaps."""
    starts = [np.concatenate([[0], e[:-1]]) if len(e) else e for e in (a_ends, b_ends)]
    start, end = np.concatenate(starts), np.concatenate([a_ends, b_ends])
    side = np.repeat([0, 1], [len(a_ends), len(b_ends)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(a_ends)], group[len(a_ends) :]


def expanded(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, position of the A token, of the B token) of all links, groups being runs of na and nb tokens."""
    links = na * nb
    group = np.repeat(np.arange(len(na)), links)
    k = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
    i, j = np.divmod(k, nb[group])
    return group, a[group] + i, b[group] + j


def links_of(ids_a: np.ndarray, ids_b: np.ndarray, na: np.ndarray, nb: np.ndarray, doc: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of the distinct pairs a * wide + b of each document; ``doc`` per group, ascending."""
    a, b = np.cumsum(na) - na, np.cumsum(nb) - nb
    small = na * nb <= LARGE
    g, i, j = expanded(a[small], b[small], na[small], nb[small])
    keys = [doc[small][g].astype(np.uint64) << np.uint64(32) | (ids_a[i] * wide + ids_b[j]).astype(np.uint64)]
    times = [np.ones(len(g), np.int64)]
    for k in np.flatnonzero(~small).tolist():
        ua, ta = np.unique(ids_a[a[k] : a[k] + na[k]], return_counts=True)
        ub, tb = np.unique(ids_b[b[k] : b[k] + nb[k]], return_counts=True)
        keys.append(np.uint64(doc[k]) << np.uint64(32) | (ua[:, None] * wide + ub).ravel().astype(np.uint64))
        times.append((ta[:, None] * tb).ravel())
    if len(keys) == 1:
        key = np.sort(keys[0])
        first = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)) != 0) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(key)))
    else:
        key, t = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)) != 0)
        n = np.add.reduceat(t[order], first)
    key = key[first]
    return (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), n


def written(ids_a: np.ndarray, ids_b: np.ndarray, na: np.ndarray, nb: np.ndarray, groups: np.ndarray, digits: Side) -> list[bytes]:
    """For each document 'a1,a2|b1;a3|b2,b3': decimal identifiers of its groups in order. ``groups``: how many each document has."""
    ga, gb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    at_a = np.arange(len(ids_a)) + (np.cumsum(nb) - nb)[ga]  # place among the tokens of both sides, group by group
    at_b = np.arange(len(ids_b)) + np.cumsum(na)[gb]
    every = np.empty(len(ids_a) + len(ids_b), np.int64)
    every[at_a], every[at_b] = ids_a, ids_b
    mark = np.full(len(every), ord(","), np.uint8)
    mark[at_a[np.cumsum(na) - 1]], mark[at_b[np.cumsum(nb) - 1]] = ord("|"), ord(";")
    ends = np.cumsum(digits.sizes[every])
    data = digits.joined(every)
    data[ends - 1] = mark
    stops = ends[at_b[np.cumsum(nb) - 1]][np.cumsum(groups) - 1].tolist() if len(groups) else []
    whole = data.tobytes()
    return [whole[s : e - 1] for s, e in zip([0, *stops[:-1]], stops, strict=True)]


@lru_cache(2)
def decimals(n: int) -> Side:
    """Decimal digits of each identifier and a place for the mark behind it."""
    return Side([b"%d," % i for i in range(n)])


def aligned(texts: list[str], a: ByteSide, b: PieceSide):
    """Per text (n_a, n_b, n_groups, n_links, sha256) and the (text, pair, links) of all of them.

    A text that either side doesn't give back byte for byte has no tokens.
    """
    rows: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
    good, all_a, all_b, size = [], [], [], []
    for k, text in enumerate(texts):
        if text:
            data = (" " + text).encode()
            x, y = a.ids(text), b.ids(text)
            if a.sizes[x].sum() == len(data) == b.sizes[y].sum() and a.joined(x).tobytes() == data == b.joined(y).tobytes():
                good.append(k)
                all_a.append(x)
                all_b.append(y)
                size.append(len(data))
    if not good:
        return rows, np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    ids_a, ids_b = np.concatenate(all_a), np.concatenate(all_b)
    ga, gb = coalesced(np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b]))
    na, nb = np.bincount(ga), np.bincount(gb)
    # a text's last tokens end together, so groups don't cross texts
    doc = np.repeat(np.arange(len(good)), [len(x) for x in all_a])[np.cumsum(na) - 1]
    groups = np.bincount(doc, minlength=len(good))
    links = np.add.reduceat(na * nb, np.cumsum(groups) - groups)
    strings = written(ids_a, ids_b, na, nb, groups, decimals(max(len(a.sizes), len(b.sizes))))
    for i, k in enumerate(good):
        rows[k] = (len(all_a[i]), len(all_b[i]), int(groups[i]), int(links[i]), hashlib.sha256(strings[i]).hexdigest())
    of, pair, n = links_of(ids_a, ids_b, na, nb, doc, len(b.sizes))
    return rows, np.array(good, np.uint32)[of], pair, n


class PairCounts:
    """Documents by pair, merged in sorted arrays."""

    def __init__(self):
        self.pairs, self.counts, self.held = np.zeros(0, np.uint32), np.zeros(0, np.int64), []
        self.size = 0

    def add(self, pairs: np.ndarray) -> bool:
        """Whether it is time to hand on what is there."""
        self.held.append(pairs)
        self.size += len(pairs)
        if self.size > COUNTED:
            self.merge()
        return len(self.pairs) > COUNTED

    def merge(self) -> None:
        every = [np.unique(x, return_counts=True) for x in [np.concatenate(self.held)]] if self.held else []
        pairs = np.concatenate([self.pairs, *(p for p, _ in every)])
        counts = np.concatenate([self.counts, *(c for _, c in every)])
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.diff(pairs.astype(np.int64), prepend=-1) != 0)
        self.pairs, self.counts = pairs[first], np.add.reduceat(counts, first) if len(first) else counts
        self.held, self.size = [], 0

    def given(self):
        self.merge()
        for i in range(0, len(self.pairs), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(self.pairs[i : i + (1 << 18)].astype(np.int64)), pa.array(self.counts[i : i + (1 << 18)])], names=["pair", "docs"])
        self.__init__()


def align_tokens(docs: DataFrame, byte_model: str | None = None, piece_model: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A (byte-level) encodes a blank and the text, B (sentencepiece) the text, before which it puts the blank itself; neither with
    special tokens. Null and empty texts, and those that either side doesn't give back byte for byte, have
    no tokens: zeros and an empty string. Rows that repeat a doc_id or have none are documents each. Long
    texts are aligned whole; a slice of a task is one text then. An empty table gives no rows.

    Each text is encoded once. Of its links the distinct pairs travel, with their numbers, in packets of a slice by bucket of
    pairs; a bucket holds 1 of BUCKETS pairs, and its packets are dealt over as many groups as their counted bytes ask for.
    """
    a, b = byte_model or tokenizer_path("byte_bpe_50k.json"), piece_model or tokenizer_path("piece_bpe_32k.model")
    ranked = merges_by_rank(a)
    wide = len(codec(b).sizes)
    schema = "slice long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, docs binary, pairs binary, times binary"
    kinds = pa.schema([("slice", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("bucket", pa.int32()), *((n, pa.binary()) for n in ("docs", "pairs", "times"))])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, doc, pair, n = aligned(batch.column(1).to_pylist(), *sides(a, b, ranked))
            head = pa.table({"slice": pa.array([number] * len(rows), pa.int64()), "row": pa.array(range(len(rows)), pa.int32()), "doc_id": batch.column(0), **dict(zip(kinds.names[3:8], map(list, zip(*rows, strict=True)), strict=True))})
            order = np.argsort((pair % BUCKETS).astype(np.uint8), kind="stable")
            cuts = np.searchsorted((pair % BUCKETS)[order], np.arange(BUCKETS + 1))
            packets = [(k, doc[o].tobytes(), pair[o].tobytes(), n[o].astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64).tobytes()) for k in range(BUCKETS) if len(o := order[cuts[k] : cuts[k + 1]])]
            for t in (head, pa.table({"slice": pa.array([number] * len(packets), pa.int64()), **dict(zip(kinds.names[8:], map(list, zip(*packets, strict=True)), strict=True))}) if packets else None):
                if t is not None:
                    yield from pa.table([t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in kinds], schema=kinds).combine_chunks().to_batches()
            number += 1

    found = materialise(clean_text(docs).mapInArrow(in_slices(run), schema), "aligned")
    packets = found.where("bucket IS NOT NULL").select("slice", "bucket", "docs", "pairs", "times")

    def count(batches):
        seen = PairCounts()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if seen.add(np.frombuffer(x, np.uint32)):
                    yield from seen.given()
        yield from seen.given()

    counts = packets.select("pairs").mapInArrow(in_slices(count), "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    token = F.floor(F.col("pair") / wide)
    best = F.max("docs").over(Window.partitionBy("token")) == F.col("docs")
    known = materialise(counts.withColumn("token", token).withColumn("best", best).select((F.col("pair") % BUCKETS).cast("int").alias("bucket"), "pair", "docs", "best"), "pairs")
    size = packets.agg(F.sum(F.length("docs") + F.length("pairs") + F.length("times"))).first()[0] or 0
    salts = max(1, -(-size // (BUCKETS * PACKETS)))
    left = packets.withColumn("salt", F.pmod(F.xxhash64("slice"), F.lit(salts)).cast("int"))
    right = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def look_up(key, p, c):
        order = np.argsort(c["pair"].to_numpy())
        pair, docs, top = c["pair"].to_numpy()[order].astype(np.uint32), c["docs"].to_numpy()[order], np.array(c["best"])[order]
        out = []
        for s, d, x, t in zip(*(p[n].to_pylist() for n in ("slice", "docs", "pairs", "times")), strict=True):
            doc, x = np.frombuffer(d, np.uint32), np.frombuffer(x, np.uint32)
            times = np.frombuffer(t, np.uint32 if len(t) == len(d) else np.uint64).astype(np.int64)
            at = np.searchsorted(pair, x)
            first = np.flatnonzero(np.diff(doc.astype(np.int64), prepend=-1) != 0)
            out.append((s, doc[first].tobytes(), np.add.reduceat(docs[at] * times, first).tobytes(), np.add.reduceat(top[at] * times, first).tobytes()))
        return pa.table(dict(zip(("slice", "docs", "sums", "bests"), map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in ("slice", "docs", "sums", "bests")}).cast(pa.schema([("slice", pa.int64()), *((n, pa.binary()) for n in ("docs", "sums", "bests"))]))

    parts = left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInArrow(look_up, "slice long, docs binary, sums binary, bests binary")

    def add_up(key, p):
        doc = np.frombuffer(b"".join(p["docs"].to_pylist()), np.uint32).astype(np.int64)
        total = np.zeros((2, int(doc.max(initial=-1)) + 1), np.int64)
        for k, name in enumerate(("sums", "bests")):
            np.add.at(total[k], doc, np.frombuffer(b"".join(p[name].to_pylist()), np.int64))
        rows = np.unique(doc)
        return pa.table({"slice": pa.array([key[0].as_py()] * len(rows), pa.int64()), "row": pa.array(rows, pa.int32()), "count_sum": total[0][rows], "n_best": total[1][rows]})

    added = parts.groupBy("slice").applyInArrow(add_up, "slice long, row int, count_sum long, n_best long")
    whole = found.where("bucket IS NULL").join(added, ["slice", "row"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
