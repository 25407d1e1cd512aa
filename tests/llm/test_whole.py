"""The pipeline from end to end, and stored payloads over slices and shards."""

import hashlib
import io
import tarfile
import zlib

import sentencepiece

import corpus_pipeline
from takeoff_spark.llm import media
from takeoff_spark.llm.common import SLICE, open_fs, tokenizer_path

DIR = "/root/testdata/sf0.001"


def test_pipeline_from_end_to_end(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    rows = corpus_pipeline.run(spark, DIR).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    whole = 0
    for r in rows:
        ids = memoryview(r.ids).cast("I").tolist()
        decoded = sp.decode(ids)
        assert r.n_tokens == len(ids) and hashlib.sha256(decoded.encode()).hexdigest() == r.decoded_sha256
        if decoded == texts[r.doc_id]:  # no line of it went
            whole += 1
            assert ids == sp.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        else:
            assert len(decoded) < len(texts[r.doc_id])
    kept = {r.doc_id for r in rows}
    assert whole > len(rows) // 2 and len(texts) // 2 < len(kept) < len(texts)
    assert len({r.decoded_sha256 for r in rows if r.n_tokens > 12}) == len({r.doc_id for r in rows if r.n_tokens > 12})  # no copies of each other


def test_media_over_slices(spark):
    long = "parede é longa " * (SLICE // 8)
    texts = [long, "a", long, None, "", "b" * 64, "c" * 65, "a", long + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 AS digest", "'k' AS shard", "1L AS n_bytes").coalesce(1)
    got = {r.doc_id: r for r in media.media_columns(df).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = media.padded(data)
        image = media.encode_png(payload)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest())
        assert (r.width, r.height, r.feature) == (64, len(payload) // 64, media.feature_of(payload))


def test_shards_roll_over(tmp_path):
    out = media.ShardWriter(f"file://{tmp_path}", most=3000)
    payloads = [bytes([i % 7]) * 640 for i in range(40)] + [bytes(range(256)) * 40] * 2 + [b"z" * 64]
    places = [(p, *out.add(p)) for p in payloads]
    out.close()
    fs, path = open_fs(f"file://{tmp_path}")
    shards = {x[2] for x in places}
    assert len(shards) > 1
    for payload, digest, shard, start, length in places:
        with fs.open_input_file(f"{path}/{shard}") as f:
            f.seek(start)
            stored = f.read(length)
        assert hashlib.sha256(payload).hexdigest() == digest and media.decode_png(stored) == payload
    for shard in shards:
        with fs.open_input_file(f"{path}/{shard}") as f:
            names = tarfile.open(fileobj=io.BytesIO(f.read())).getnames()
        assert len(set(names)) == len(names)  # once in each shard
