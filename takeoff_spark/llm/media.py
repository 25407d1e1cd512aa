"""Media columns: content-addressed payloads in tar shards, rows with digest, offset and length.

The payload of a row is stored as a lossless 8-bit greyscale PNG, 64 samples wide, as member
``<sha256>.png`` of a tar shard in the shared folder. A reader needs the shard's name, an offset
and a length only: metadata come from a range read of the image's first bytes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, in_slices, map_rows, materialise, open_fs, shared_dir

WIDTH = 64
HEADER = 33  # signature, IHDR chunk
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG, WIDTH samples a line; the length must be a positive multiple of WIDTH."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(lines), WIDTH + 1), np.uint8)
    raw[:, 1:] = lines
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from an image's first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(media: bytes) -> bytes:
    width, height, _ = read_header(media)
    i, data = 8, []
    while i < len(media):
        n, kind = struct.unpack(">I4s", media[i : i + 8])
        if kind == b"IDAT":
            data.append(media[i + 8 : i + 8 + n])
        i += n + 12
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("only unfiltered lines are written here")
    return raw[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean sample and a 64-bit mark of the columns that lie above it."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sums = lines.sum(axis=0, dtype=np.int64)
    bits = np.packbits(sums * WIDTH > sums.sum()).tobytes().hex()
    return f"{WIDTH}x{len(lines)} mean={sums.sum() / lines.size:.4f} mark={bits}"


class ShardWriter:
    """Appends members to tar shards, a new one once a shard has ``most`` bytes; a digest is stored once in each shard."""

    def __init__(self, folder: str, most: int = 256 << 20):
        self.folder, self.most, self.tar, self.seen = folder, most, None, {}

    def add(self, payload: bytes) -> tuple[str, str, int, int]:
        digest = hashlib.sha256(payload).hexdigest()
        if digest not in self.seen:
            media = encode_png(payload)
            if self.tar and self.tar.offset > self.most:
                self.close()
            if not self.tar:
                fs, path = open_fs(self.folder)
                fs.create_dir(path, recursive=True)
                self.name = f"{uuid.uuid4().hex}.tar"  # a retried task writes another file, rows name the one they mean
                self.out = fs.open_output_stream(f"{path}/{self.name}")
                self.tar = tarfile.open(fileobj=self.out, mode="w|", format=tarfile.USTAR_FORMAT)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            at = self.tar.offset + tarfile.BLOCKSIZE
            self.tar.addfile(info, io.BytesIO(media))
            self.seen[digest] = (self.name, at, len(media))
        return (digest, *self.seen[digest])

    def close(self) -> None:
        if self.tar:
            self.tar.close()
            self.out.close()
            self.tar, self.seen = None, {}


def write_media(docs: DataFrame) -> tuple[DataFrame, str]:
    """Store every text; returns one row per document (doc_id, n_bytes, digest, shard, start, length) and the folder.

    Some 2 MB of text at a time, or one longer text, are in a task's memory.
    """
    folder = f"{shared_dir(docs.sparkSession)}/media"
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def run(batches):
        out = ShardWriter(folder)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                rows.append((i, len(data), *out.add(padded(data))))
            yield pa.RecordBatch.from_arrays([pa.array(x, y.type) for x, y in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], y.type) for y in schema], schema=schema)
        out.close()

    rows = clean_text(docs).mapInArrow(in_slices(run), "doc_id long, n_bytes long, digest string, shard string, start long, length long")
    return materialise(rows, "media_rows"), folder


def read_media(rows: DataFrame, folder: str) -> DataFrame:
    """Each distinct stored payload of ``rows``, read back by range: header for the metadata, then all bytes."""
    one = rows.groupBy("digest").agg(F.min("shard").alias("shard"), F.min_by("start", "shard").alias("start"), F.min_by("length", "shard").alias("length"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = one.repartition(n, "shard", F.floor(F.col("start") / (4 << 20))).sortWithinPartitions("shard", "start")

    def make():
        files: dict = {}

        def read(shard: str):
            if shard not in files:
                for f in files.values():
                    f.close()
                files.clear()
                fs, path = open_fs(folder)
                files[shard] = fs.open_input_file(f"{path}/{shard}")
            return files[shard]

        def batch(b: pa.RecordBatch) -> dict:
            out: dict = {k: [] for k in ("digest", "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for digest, shard, start, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f = read(shard)
                f.seek(start)
                width, height, _ = read_header(f.read(HEADER))
                f.seek(start)
                media = f.read(length)
                payload = decode_png(media)
                for k, x in zip(out, (digest, width, height, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)), strict=True):
                    out[k].append(x)
            return out

        return batch

    return map_rows(one, make, "digest string, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Media columns of every document: see ``write_media`` and ``read_media``.

    A null text is the empty one (64 zero bytes). Repeated rows give repeated rows. Equal payloads share
    a digest and the address of one stored copy; further copies that other tasks wrote stay unread.
    """
    rows, folder = write_media(docs)
    return rows.select("doc_id", "n_bytes", "digest").join(materialise(read_media(rows, folder), "media_read"), "digest")
