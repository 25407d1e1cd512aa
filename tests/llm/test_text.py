"""Tokenizers and codecs against their libraries, whole-text round trips, odd texts."""

import random

import numpy as np
import pytest

from takeoff_spark.llm.bpe_count import WordCounter
from takeoff_spark.llm.common import tokenizer_path
from takeoff_spark.llm.media import decode_png, encode_png, padded
from takeoff_spark.llm import piece_codec
from takeoff_spark.llm.piece_codec import CharMap, Codec, fields
from takeoff_spark.llm.token_files import Encoder, merges_by_rank, token_files, write_tokens

ODD = ["", " ", "  ", "a", "\n", "a  b", " a b ", "a\n\nb", "\t", "İstanbul ΣΑΣ Σ", "é café ﬁ", "<|endoftext|> foo<|startoftext|>bar", "it's 'sure I'LL 123abc 4½", "日本語 テキスト 😀", "a▁b ▁▁ c", "\x00 \x1c a\x1db", "a　d\x85e", "x" * 3000, "a \n b", "́ a", " " * 40]


def texts():
    rng, letters = random.Random(1), "ab 'sT\n\t.,1é▁😀<|>ß İΣ́\x1f "
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(800)]


def test_counts_equal_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), WordCounter(path)
    assert [own.count(t) for t in texts()] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts()]


def test_pieces_equal_library_with_spans():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path)
    for t in texts():
        ids, ends = own.encode(t)
        assert ids.tolist() == lib.encode(t, add_bos=True, add_eos=True)
        assert own.decode(ids) == lib.decode(ids.tolist())
        assert (np.diff(ends) >= 0).all() and ends[-1] == len(t.encode())
        if not (own.byte[ids] >= 0).any():
            assert ends[1:-1].tolist() == [p.end for p in lib.encode(t, return_type="proto").pieces]


def test_ids_equal_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert merges_by_rank(path)
    lib = Tokenizer.from_file(path)
    for own in (Encoder(path, True), Encoder(path, False)):
        for t in [*texts(), *(f"ab{chr(c)} {chr(c)}a\n{chr(c)}{chr(c)}1" for c in [*range(0x600), 0xA7CB, 0xA7DC, 0x10D50])]:
            assert np.frombuffer(own.encode(t), own.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_counts_of_letters_that_python_does_not_know():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), WordCounter(path)
    for c in (0xA7CB, 0xA7DC, 0x1C89, 0x10D50, 0x16EA0, 0x378):
        t = f"Ab{chr(c)} {chr(c)}É \u00a0{chr(c)}"
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids)


def test_texts_are_cut_where_it_makes_no_difference(monkeypatch):
    own = Codec(tokenizer_path("piece_bpe_32k.model"))
    whole = [own.encode(t) for t in texts()]
    monkeypatch.setattr(piece_codec, "CHUNK", 3)
    for t, (ids, ends) in zip(texts(), whole, strict=True):
        assert [x.tolist() for x in own.encode(t)] == [ids.tolist(), ends.tolist()]


def test_compiled_map_against_library():
    """The library's own compiled map: same normalised text, same source places."""
    import sentencepiece

    lib, own, rng = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc"), Codec(tokenizer_path("piece_bpe_32k.model")), random.Random(4)
    spec = next(dict(fields(v)) for k, v in fields(lib.serialized_model_proto()) if k == 3)
    own.map, own.prefix, own.squeeze, own.escape = CharMap(spec[2]), spec.get(3, 1), spec.get(4, 1), spec.get(5, 1)
    for _ in range(1500):
        t = "".join(rng.choice("ａｂ① ﬁx  ếｶﾞ한\t㌔½A") for _ in range(rng.randrange(1, 14)))
        want, offsets = lib.normalize(t, with_offsets=True)
        got, at = own.normalise(t)
        assert (got, at.tolist() if got else []) == (want, [len(t[:k].encode()) for k in offsets] if want else [])


def test_png_round_trip():
    for t in ODD:
        p = padded(t.encode())
        assert len(p) % 64 == 0 and p and decode_png(encode_png(p)) == p


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(3, None, "x", 1), (1, "a b c", "y", 2), (1, "a b c", "y", 2), (2, "", None, None)], "doc_id long, text string, ids string, n_tokens int")


def test_token_files(docs):
    """Against the library, document by document in their order."""
    import zlib

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = sorted(tuple(r) for r in token_files(docs.union(docs.sparkSession.createDataFrame([(7, "word " * 5000 + "中" * 3000, "", 0)], docs.schema))).collect())
    want, start = [], 0
    for i, t in [(1, "a b c"), (1, "a b c"), (2, ""), (3, ""), (7, "word " * 5000 + "中" * 3000)]:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows == want
    assert token_files(docs.limit(0)).count() == 0


def test_masks(docs):
    import pyarrow as pa

    from takeoff_spark.llm.common import open_fs

    rows, folder = write_tokens(docs)
    fs, path = open_fs(folder)
    got = {k: sum(pa.compute.sum(pa.compute.list_flatten(b.column(k)).cast("int64")).as_py() for r in rows.select("file").distinct().collect() for b in [pa.ipc.open_file(fs.open_input_file(f"{path}/{r.file}")).get_batch(0)]) for k in ("mask", "last")}
    assert got == {"mask": token_files(docs).agg({"n_tokens": "sum"}).first()[0], "last": 4}


def test_ids_where_blanks_stand_beside_line_ends():
    path = tokenizer_path("byte_bpe_50k.json")
    own, lib = Encoder(path, True), Encoder(path, False)
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace()] + ["᠎", "​", "⁠", "﻿"]
    assert all(own.encode(t) == lib.whole(t) for t in ("“Hi”\n\xa0\xa0there", "中\n\xa0\xa0ß", "😀\x0cé\n\xa0"))
    draw = random.Random(5)
    pool = [*blanks, "\n", "\n", " ", " ", "中", "ß", "“", "a", "1", "."]
    for _ in range(4000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(1, 9)))
        assert own.encode(text) == lib.whole(text), repr(text)
        assert own.encode("中" + text) == lib.whole("中" + text), repr(text)
