"""Helpers that the operators share: the shared folder, written tables, small caches."""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"

#: Ids that may be broadcast for a semi-join: 8 MB of longs at most.
BROADCAST_IDS = 1_000_000

_own_dirs: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach.

    Only where that setting is unset in local mode (tests, a laptop) a temporary folder stands in for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="takeoff-")
        root = _own_dirs[app]
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{os.path.abspath(root)}"
    return f"{root.rstrip('/')}/takeoff-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(filesystem, path) of a folder or file in the shared store, for tasks."""
    import pyarrow.fs as pafs

    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def clean_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as the empty one; further columns don't matter."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Bytes of text that a task turns into Python objects at once, about.
SLICE = 2 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of strings; a longer row is a run of its own."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(size) - size) // most
    cuts = [*(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    at = 0
    for end in cuts:
        if end > at:
            yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Empty the caches and give freed memory back to the system: a worker that is used again would keep it into the next stage."""
    for memo in list(_memos):
        memo.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """For mapInArrow: ``f``, and ``release`` when the task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def in_slices(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``released`` with slices of bounded size for ``f``."""
    return released(lambda batches: f(x for b in batches for x in slices(b)))


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow: ``make`` runs once a task, what it returns once a slice of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            cols = f(batch)
            yield pa.RecordBatch.from_arrays([pa.array(cols[x.name], x.type) if not isinstance(cols[x.name], (pa.Array, pa.ChunkedArray)) else cols[x.name].cast(x.type) for x in out], schema=out)

    return df.mapInArrow(in_slices(run), schema)


def keep_ids(df: DataFrame, ids: DataFrame, on: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """Semi-join with distinct ids: broadcast while they are few (counted), by a shuffle beyond."""
    few = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if few else ids, on, "left_semi")


_SPACE = re.compile(r"[ \t-\r]")


def parts_of(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A long text in parts that end at white space, so that the words of one part at a time are in memory."""
    at = 0
    while len(text) - at > most:
        m = _SPACE.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Memo(dict):
    """A dict that computes what it lacks; of ``most`` entries the older half goes, and all do when the task ends."""

    __hash__ = object.__hash__

    def __init__(self, compute: Callable, most: int = 100_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest
        _memos.add(self)

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                for old in list(islice(self, self.most // 2)):
                    del self[old]
            self[key] = value
        return value


#: The caches of this process.
_memos: weakref.WeakSet = weakref.WeakSet()


def hash64(b: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")
