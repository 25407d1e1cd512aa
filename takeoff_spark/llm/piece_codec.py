"""SentencePiece encoding and decoding that keeps every piece's source bytes.

Text is normalised by longest-prefix matches in the model's compiled character map; an alignment
records for each normalised character the source byte where it starts. Pieces are laid along the
normalised text and so projected to byte spans of the original one. The piece merging is the sentencepiece
library's; very long texts are cut before words that don't depend on what is before them. Decoding rebuilds the text
from the identifiers. A model whose map is empty, or has no entry that a text's bytes could start, maps every
character to itself.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import clean_text, map_rows, tokenizer_path

SPACE = "▁"  # stands for a blank in pieces
CONTROL, BYTE = 3, 6  # piece types of the model format
#: Characters that are merged at once, about, where a text can be cut.
CHUNK = 32_768
#: A single blank or line end between two words.
CUT = re.compile(r"(?<=[^ \n])[ \n](?=[^ \n])")


def fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            x = data[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[i : i + n]
            i += n


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 bytes and zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""
        #: Bytes that start an entry.
        self.firsts = {c for c in range(256) if self.units and (at := self._offset(self.units[0]) ^ c) < len(self.units) and self.units[at] & 0x800000FF == c}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """(source bytes, replacement) of the longest entry that starts at ``at``; (0, None) without one."""
        found, units = (0, None), self.units
        if not units:
            return found
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (units[node] & 0x800000FF) != data[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return found


class Codec:
    """One model: encoding with begin and end identifiers, spans, decoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, norm, denorm = [], {}, {}
        for number, value in fields(open(path, "rb").read()):
            if number == 1:
                pieces.append(dict(fields(value)))
            elif number == 3:
                norm = dict(fields(value))
            elif number == 5:
                denorm = dict(fields(value))
        if denorm.get(2):
            raise ValueError("maps for decoding are not handled")
        self.map = CharMap(norm.get(2, b""))
        self.prefix, self.squeeze, self.escape = norm.get(3, 1), norm.get(4, 1), norm.get(5, 1)
        self.bos, self.eos, self.blank = self.lib.bos_id(), self.lib.eos_id(), self.lib.piece_to_id(SPACE)
        texts, kind = [p[1].decode() for p in pieces], [p.get(3, 1) for p in pieces]
        self.chars = np.array([1 if k == BYTE else len(t) for t, k in zip(texts, kind, strict=True)])  # of the normalised text
        self.byte = np.array([int(t[3:-1], 16) if k == BYTE else -1 for t, k in zip(texts, kind, strict=True)])
        surface = [bytes([int(t[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else t.replace(SPACE, " ").encode() for t, k in zip(texts, kind, strict=True)]
        self.sizes = np.array([len(x) for x in surface], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        #: Without an own map, and where no piece holds a line end or goes on into a new word, words don't depend on each other.
        self.by_word = not self.map.units and self.prefix and not self.squeeze and self.escape and not any(SPACE in t.lstrip(SPACE) or "\n" in t for t in texts)

    # Normalisation and alignment

    def normalise(self, text: str, prefix: bool = True) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its characters and the end, the source byte where it starts."""
        data = text.encode()
        if self.map.firsts.isdisjoint(data):  # no entry can match: every character stands for itself
            out, at = list(text) if self.squeeze else text, np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        else:
            out, places, i = [], [], 0
            while i < len(data):
                n, to = self.map.longest(data, i)
                if not n:
                    n = 1
                    while i + n < len(data) and data[i + n] & 0xC0 == 0x80:
                        n += 1
                    to = data[i : i + n]
                out += to.decode()
                places += [i] * (len(out) - len(places))
                i += n
            at = np.array(places, np.int64)
        end = len(data)
        if self.squeeze:
            keep = [j for j, c in enumerate(out) if c != " " or (j and out[j - 1] != " ")]
            while keep and out[keep[-1]] == " ":
                end = at[keep.pop()]
            out, at = [out[j] for j in keep], at[keep]
        s = "".join(out)
        if s and prefix and self.prefix:
            s, at = " " + s, np.concatenate([at[:1], at])
        return s.replace(" ", SPACE) if self.escape else s, np.append(at, end)

    def laid(self, ids: np.ndarray, text: str, prefix: bool = True) -> np.ndarray:
        """For each piece the source byte where its span ends: pieces are laid along the normalised text, byte pieces end with the last of their character."""
        _, at = self.normalise(text, prefix)
        byte, size = self.byte[ids], self.chars[ids]
        goes_on = np.zeros(len(ids), bool)
        goes_on[:-1] = (byte[:-1] >= 0) & (byte[1:] & 0xC0 == 0x80) & (byte[1:] >= 0)
        return at[np.cumsum(np.where(goes_on, 0, size))]

    def chunks(self, text: str) -> Iterator[str]:
        """The text, cut before words where that makes no difference."""
        at = 0
        while self.by_word and len(text) - at > CHUNK and (m := CUT.search(text, at + CHUNK)) and SPACE not in text:
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def plain(self, text: str) -> Iterator[list[int]]:
        """Identifiers of the text's chunks, without begin and end."""
        for k, chunk in enumerate(self.chunks(text)):
            if not k:
                yield self.lib.encode(chunk)
            elif chunk[0] == "\n":
                yield self.lib.encode(chunk)[1:]  # without the blank that the library puts first
            else:
                yield self.lib.encode(chunk[1:])  # the blank that it puts first is the chunk's own

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers with begin and end, and for each the source byte where its span ends."""
        ids, ends, before = [np.array([self.bos])], [np.array([0])], 0
        for k, (chunk, found) in enumerate(zip(self.chunks(text), self.plain(text), strict=True)):
            ids.append(np.array(found, np.int64))
            ends.append(self.laid(ids[-1], chunk, not k) + before)
            before += len(chunk.encode())
        return np.concatenate([*ids, [self.eos]]).astype("<u4"), np.concatenate([*ends, [before]])

    def decode(self, ids: np.ndarray) -> str:
        """The text of identifiers: control pieces vanish, the added blank goes, broken bytes become replacement characters."""
        sizes = self.sizes[ids]
        n = np.cumsum(sizes)
        data = self.bytes[np.repeat(self.starts[ids] - n + sizes, sizes) + np.arange(n[-1] if len(n) else 0)].tobytes()
        return data[1 if self.prefix and data[:1] == b" " else 0 :].decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Identifiers (with begin and end), each piece's byte span in the source and the decoded text.

    Returns doc_id, ids (binary, little-endian unsigned 32 bit), ends (binary, the same: byte where each
    piece's span ends; it starts where the one before ends) and decoded. A null text is the empty one;
    repeated rows give repeated rows; long texts are encoded whole. No shuffle.
    """
    return _pieces(docs, model, "doc_id long, ids binary, ends binary, decoded string", lambda c, i, ids, ends: (i, ids.tobytes(), ends.astype("<u4").tobytes(), c.decode(ids)))


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_crc32 of ``encode_pieces``, row by row."""

    def digests(c: Codec, i: int, ids: np.ndarray, ends: np.ndarray) -> tuple:
        return i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest(), zlib.crc32(ends.astype("<u4").tobytes())

    return _pieces(docs, model, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long", digests)


def _pieces(docs: DataFrame, model: str | None, schema: str, row) -> DataFrame:
    path = model or tokenizer_path("piece_bpe_32k.model")

    def make():
        c = codec(path)

        def batch(b: pa.RecordBatch) -> dict:
            rows = [row(c, i, *c.encode(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            return dict(zip([x.split()[0] for x in schema.split(", ")], map(list, zip(*rows, strict=True)), strict=True))

        return batch

    return map_rows(clean_text(docs), make, schema)
