"""Token files: Arrow IPC files of fixed-size lists, for random access without copies.

A file holds the identifiers of a run of documents, ascending by doc_id, cut into sequences of
equal length; a mask of the same shape marks the real ones (the last sequence is filled up), another one
the last of each document. Values lie in one buffer a batch, so a memory-mapped reader addresses any token by
its position, and a document by its number in the file.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe_count import byte_alphabet
from .common import Memo, clean_text, in_slices, map_rows, materialise, open_fs, shared_dir, tokenizer_path

SEQUENCE = 2048
ROWS = 256  # sequences a batch
FILE_BYTES = 64 << 20  # text of a file at most, about


#: The byte-level pattern of the tokenizers library (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the two libraries' tables may class differently (letters of later Unicode versions lie there), and long blanks.
OTHER = re.compile(r"[^\x00-\u052f]|\s{200}")
#: White space besides " " and line ends, in either library's sense.
BLANK = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
LONGEST = 2000  # characters of a word; longer ones are merged by the tokenizers library


class Encoder:
    """Identifiers of whole texts, equal to the tokenizers library's.

    Where merging by rank is the same (``ranked``, see ``merges_by_rank``), tiktoken does it over the same vocabulary.
    Texts with characters that the two may class differently are looked up word by word in a bounded cache.
    """

    def __init__(self, path: str, ranked: bool, plain: bool = False):
        """``plain``: strings of special tokens inside a text are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = plain
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [] if plain else [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.ranked, self.words = ranked, Memo(self.word)
        self.line_end = self.whole("\n")
        if ranked:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            byte = {c: b for b, c in enumerate(byte_alphabet())}
            tokens = [*byte, *(a + b for a, b in model["merges"])]
            self.ids = np.array([model["vocab"][t] for t in tokens], self.dtype)
            self.by_rank = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(map(byte.__getitem__, t)): i for i, t in enumerate(tokens)}, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, text: str) -> bytes:
        if self.ranked and len(text) < LONGEST and not OTHER.search(text):
            return self.ids[self.by_rank.encode_ordinary(text)].tobytes()
        return self.whole(text)

    def single_spaced(self, text: str) -> bool:
        """Whether every white space is one blank or one line end between two other characters."""
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
            return False
        return not BLANK.search(text)

    def encode(self, text: str) -> bytes:
        """Identifiers as bytes."""
        if not (self.ranked and text) or any(s in text for s in self.special):
            return self.whole(text)
        if not OTHER.search(text) and max(map(len, text.split()), default=0) < LONGEST:
            return self.ids[self.by_rank.encode_ordinary(text)].tobytes()
        if not self.single_spaced(text):
            return self.whole(text)
        parts = []  # a single blank starts a new piece, a single line end is one
        for line in text.split("\n"):
            head, *words = line.split(" ")
            parts += (self.line_end, self.words[head], *(self.words[" " + w] for w in words))
        return b"".join(parts[1:])


def merges_by_rank(path: str) -> bool:
    """Whether merging the adjacent pair whose joined bytes rank lowest gives what the file's list of merges gives.

    It does in a byte-level vocabulary of the plain pattern whose every token is what its own bytes merge to: a
    pair that joins to a token then is that token's listed pair, as any other state of these bytes never arises.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
        return False
    lib, made = Tokenizer.from_file(path).model, [a + b for a, b in model["merges"]]
    return len({*made}) == len(made) and all(len(got := lib.tokenize(t)) == 1 and got[0].value == t for t in [*byte_alphabet(), *made])


@lru_cache(2)
def encoder(path: str, ranked: bool, plain: bool = False) -> Encoder:
    return Encoder(path, ranked, plain)


class SequenceWriter:
    """Packs a stream of identifiers into batches of equal sequences and masks."""

    def __init__(self, folder: str, dtype: np.dtype, length: int):
        self.dtype, self.length, self.name = dtype, length, f"{uuid.uuid4().hex}.arrow"
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        self.out = fs.open_output_stream(f"{path}/{self.name}")
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length)), ("last", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held, self.ends, self.size, self.docs = [], [], 0, 0

    def add(self, ids: bytes) -> int:
        """Append a document (one identifier at least); returns its number in the file."""
        self.held.append(ids)
        self.size += len(ids)
        self.ends.append(self.size // self.dtype.itemsize)
        self.docs += 1
        if self.size >= (block := self.length * ROWS * self.dtype.itemsize):
            data, ends = b"".join(self.held), np.array(self.ends) - 1
            whole, each = len(data) // block * block, self.length * ROWS
            for i in range(0, whole, block):
                first = i // self.dtype.itemsize
                self.put(data[i : i + block], ends[(ends >= first) & (ends < first + each)] - first)
            first = whole // self.dtype.itemsize
            self.held, self.size, self.ends = [data[whole:]], len(data) - whole, (ends[ends >= first] + 1 - first).tolist()
        return self.docs - 1

    def put(self, data: bytes, ends: np.ndarray) -> None:
        ids = np.frombuffer(data, self.dtype)
        rows = -(-len(ids) // self.length)
        full, last = np.zeros(rows * self.length, self.dtype), np.zeros(rows * self.length, bool)
        full[: len(ids)], last[ends] = ids, True
        mask = np.arange(len(full)) < len(ids)
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask, last)], schema=self.schema))

    def close(self) -> None:
        if self.size:
            self.put(b"".join(self.held), np.array(self.ends) - 1)
        self.file.close()
        self.out.close()


class SequenceReader:
    """Random access to a token file; memory-mapped where the store allows, so slices are views."""

    def __init__(self, folder: str, name: str):
        fs, path = open_fs(folder)
        local = getattr(fs, "type_name", "") == "local"
        self.open = lambda: pa.memory_map(f"{path}/{name}") if local else fs.open_input_file(f"{path}/{name}")
        self.file = pa.ipc.open_file(self.open())
        self.length = self.file.schema.field("ids").type.list_size
        self.block, self.batches = self.length * ROWS, {}

    def batch(self, k: int) -> np.ndarray:
        if k not in self.batches:
            self.batches = {k: self.file.get_batch(k).column(0).flatten().to_numpy()}
        return self.batches[k]

    def tokens(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            k, i = divmod(start, self.block)
            part = self.batch(k)[i : i + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, "<u2")

    def ends(self) -> np.ndarray:
        """For each document of the file the position after its last identifier, read from its mask."""
        file = pa.ipc.open_file(self.open(), options=pa.ipc.IpcReadOptions(included_fields=[2]))
        marks = [np.flatnonzero(file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=False)) + k * self.block for k in range(file.num_record_batches)]
        return np.concatenate(marks) + 1 if marks else np.zeros(0, np.int64)


def write_tokens(docs: DataFrame, end_id: int = 0, length: int = SEQUENCE, model: str | None = None) -> tuple[DataFrame, str]:
    """Encode and write every text, ascending by doc_id; returns (doc_id, part, file, number) and the folder.

    One shuffle: a range partitioning by doc_id, each range becomes one file. A null text is the empty one (its end
    identifier only); a null doc_id comes first. Rows that repeat a doc_id are written each, ordered by a hash of
    their texts, and may be dealt over several ranges, however many they are.
    """
    path = model or tokenizer_path("byte_bpe_50k.json")
    folder, ranked = f"{shared_dir(docs.sparkSession)}/tokens", merges_by_rank(path)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("file", pa.string()), ("number", pa.int32())])

    def run(batches):
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), None
        for b in batches:
            e = encoder(path, ranked)
            out = out or SequenceWriter(folder, e.dtype, length)
            end = np.array([end_id], e.dtype).tobytes()
            numbers = [out.add(e.encode(text) + end) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(numbers), pa.int32()), pa.array([out.name] * len(numbers)), pa.array(numbers, pa.int32())], schema=schema)
        if out:
            out.close()

    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(clean_text(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    keyed = clean_text(docs).select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    rows = keyed.repartitionByRange(n, "doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m").select("doc_id", "text").mapInArrow(in_slices(run), "doc_id long, part int, file string, number int")
    return materialise(rows, "token_rows"), folder


def read_tokens(rows: DataFrame, folder: str) -> DataFrame:
    """doc_id with start (tokens of all documents before), n_tokens and ids_crc32, all read back from the files."""
    files = map_rows(rows.select("part", "file").distinct(), lambda: lambda b: {"part": b.column(0), "n": [int(SequenceReader(folder, x).ends()[-1]) for x in b.column(1).to_pylist()]}, "part int, n long")
    before = files.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches):
        reader, name, ends = None, None, None
        for b in batches:
            found = []
            for file, k in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if file != name:
                    reader, name = SequenceReader(folder, file), file
                    ends = np.concatenate([[0], reader.ends()])
                at, n = int(ends[k]), int(ends[k + 1] - ends[k])
                found.append((at, n, zlib.crc32(reader.tokens(at, n).astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))], names=["doc_id", "part", "position", "n_tokens", "ids_crc32"])

    read = rows.mapInArrow(in_slices(run), "doc_id long, part int, position long, n_tokens long, ids_crc32 long")
    return read.join(before, "part").select("doc_id", (F.col("before") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, end_id: int = 0, model: str | None = None) -> DataFrame:
    """Write all documents as token files and read them back: doc_id, start, n_tokens (with the end), ids_crc32. An empty table gives no rows."""
    return read_tokens(*write_tokens(docs, end_id, model=model))
