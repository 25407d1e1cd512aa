"""Token counts: heap-and-linked-list byte-pair merging that emits no identifiers."""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from tokenizers import Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, clean_text, map_rows, parts_of, tokenizer_path

#: White space as the vocabulary's patterns mean it (fixed values of the Unicode property).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def merge_count(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Merges that byte-pair encoding makes of ``symbols``: a heap of ranked pairs over a linked list."""
    n = len(symbols)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = following[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        merges += 1
        symbols[i], symbols[j] = ranks[a, b][1], -1
        following[i] = k = following[j]
        if k < n:
            before[k] = i
            if r := ranks.get((symbols[i], symbols[k])):
                heapq.heappush(heap, (r[0], i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))):
            heapq.heappush(heap, (r[0], h, symbols[h], symbols[i]))
    return merges


class WordCounter:
    """Counts tokens as the tokenizers library does with a lower-casing, word-end BPE vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            whole = a + b
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[whole])
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + end] for c in alphabet]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", SPACE)
        self.pieces = regex.compile(pattern)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, self.special)))
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.piece_counts, self.word_counts = Memo(self.of_piece, 100_000), Memo(self.of_word, 300_000)
        self.normaliser = Tokenizer.from_file(path).normalizer

    def of_piece(self, piece: str) -> int:
        data = piece.encode()
        symbols = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return len(symbols) - merge_count(symbols, self.ranks)

    def of_word(self, word: str) -> int:
        return sum(map(self.piece_counts.__getitem__, self.pieces.findall(word)))

    def plain(self, text: str) -> int:
        if text.isascii():
            text = text.lower()
        elif any(unicodedata.category(c) == "Cn" for c in set(text)):
            text = self.normaliser.normalize_str(text)  # the library's tables may have letters that Python's lack
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # by character: no final sigma
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # white space for str.split only
        words = [w for w in self.spaces.split(text) if w] if odd else text.split()
        return sum(map(self.word_counts.__getitem__, words))

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            parts = self.specials.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return sum(map(self.plain, parts_of(text)))


@lru_cache(2)
def word_counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(docs: DataFrame, limit: int = 2048, model: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text, without special tokens.

    A null text is the empty one (0 tokens); repeated rows are counted each; long texts are read whole.
    Special strings inside a text are one token each, as the library takes them by default.
    Runs inside the scan's tasks: no shuffle. Counts of frequent words are kept in a bounded cache.
    """
    path = model or tokenizer_path("word_bpe_49k.json")

    def make():
        count = word_counter(path).count

        def batch(b: pa.RecordBatch) -> dict:
            texts = b.column(1).to_pylist()
            return {"doc_id": b.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": list(map(count, texts))}

        return batch

    return map_rows(clean_text(docs), make, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
