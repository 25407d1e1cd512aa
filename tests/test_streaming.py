"""Streams against batch, in any order of arrival; batches that are tried again; late rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from takeoff_spark.streaming import messages as msg
from takeoff_spark.streaming import sink

T0 = datetime(2024, 1, 1)


def events(n: int, days: int = 4) -> list[tuple]:
    """Messages of some days, a fifth sent again, some empty, some the account's own."""
    draw = random.Random(n)
    times = sorted(draw.uniform(0, days * 86400) for _ in range(n))
    rows = [(i, T0 + timedelta(seconds=int(t)), str(draw.randint(1, 4)), f"m{i if draw.random() < 0.8 else draw.randint(0, i)}", draw.choice(["", None, "a", "b", "c"])) for i, t in enumerate(times)]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, msg.EVENT)


def streamed(spark, path, parts, make, mode="append"):
    """Each part is a batch; a row without text long after them ends all days."""
    for i, rows in enumerate([*parts, [(None, T0 + timedelta(days=400), None, None, None)]]):
        table(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
    out = make(spark.readStream.schema(msg.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    query = sink.append_once(out, f"{path}/out", f"{path}/state", mode)
    query.awaitTermination()
    return sink.read_batches(spark, f"{path}/out", out.schema), query


def by_hand(rows, cap, own):
    """One after the other in the order of seq."""
    seen, sent, out = set(), {}, {}
    for seq, ts, sender, mid, text in sorted(rows):
        if not text or mid in seen:
            continue
        seen.add(mid)
        day = ts.date()
        out[seq] = sender != own and sent.get(day, 0) < cap
        sent[day] = sent.get(day, 0) + out[seq]
    return out


@pytest.mark.parametrize("at_once", [100_000, 3])
def test_quota_in_batch(spark, at_once):
    rows = events(120)
    got = msg.daily_quota(table(spark, rows), 7, "2", at_once=at_once).collect()
    assert {r.seq: r.sent for r in got} == by_hand(rows, 7, "2")
    assert msg.daily_quota(table(spark, rows), 7, agent_on=False).count() == 0
    assert msg.daily_quota(table(spark, rows).where("false"), 7).count() == 0


def test_quota_stream_equals_batch_in_any_order(spark, tmp_path):
    rows = events(90)
    shuffled = random.Random(1).sample(rows, len(rows))
    parts = [shuffled[i::3] for i in range(3)]
    first, _ = streamed(spark, f"{tmp_path}/1", parts, lambda e: msg.once(e, "30 days"))
    again = [tuple(r) for r in first.select("seq", "ts", "sender_id", "mid", "text").collect()]
    assert {r[3] for r in again} == {r[3] for r in rows if r[4]} and len({r[3] for r in again}) == len(again)
    random.Random(2).shuffle(again)
    got, _ = streamed(spark, f"{tmp_path}/2", [again[::2], again[1::2]], lambda e: msg.quota_stream(e, 7, "2", delay="30 days"))
    assert sorted((r.seq, r.sent) for r in got.collect()) == sorted(by_hand(rows, 7, "2").items())


def test_counters_drop_and_count_late_rows(spark, tmp_path):
    at = lambda h, i: (i, T0 + timedelta(hours=h), "1", f"m{i}", "x")
    parts = [[at(1, 1), at(2, 2)], [at(80, 3)], [at(81, 5)], [at(3, 4)]]  # a batch sees the watermark of the one before
    got, query = streamed(spark, tmp_path, parts, lambda e: msg.daily_counters(e, "1 day"))
    assert sorted((r.day.day, r.messages) for r in got.collect()) == [(1, 2), (4, 2)]
    assert msg.late_rows(query) == 1


def test_posts_stream_equals_batch(spark, tmp_path):
    rows = [r for r in events(200, 9)]
    want, last = [], {}
    for _, ts, sender, _, _ in rows:
        if sender not in last or (ts - last[sender]).total_seconds() >= 20 * 3600:
            last[sender] = ts
            want.append((sender, ts))
    epoch = lambda df: sorted((r.sender_id, r.posted) for r in df.collect())
    want = sorted((s, int((t - datetime(1970, 1, 1)).total_seconds())) for s, t in want)
    assert epoch(msg.posts_due(table(spark, rows), 20)) == want
    got, _ = streamed(spark, tmp_path, [random.Random(i).sample(rows[i : i + 40], 40) for i in range(0, 200, 40)], lambda e: msg.posts_due_stream(e.where(F.coalesce("sender_id", F.lit("")) != ""), 20))
    assert epoch(got) == want


def test_a_batch_tried_again_repeats_no_row(spark, tmp_path):
    write, path = sink.batch_writer(f"{tmp_path}/t"), f"{tmp_path}/t"
    one, two = spark.createDataFrame([(1,), (2,)], "x long"), spark.createDataFrame([(3,)], "x long")
    for batch, df in ((0, one), (1, two), (1, two), (0, one)):
        write(df, batch)
    assert sorted(r.x for r in sink.read_batches(spark, path, "x long").collect()) == [1, 2, 3]
    assert sink.read_batches(spark, f"{tmp_path}/none", "x long").count() == 0


def test_history_stream_equals_batch_in_any_order(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=i), str(draw), f"m{i}", f"t{i}") for i, draw in enumerate(random.Random(5).choices([1, 1, 1, 2, 3, 4], k=150))]
    want = {}
    for seq, _, sender, _, text in rows:
        want[int(sender)] = [*want.get(int(sender), []), text][-20:]
    some = random.Random(6).sample(rows, len(rows))
    longs = F.col("sender_id").cast("long")
    streamed(spark, str(tmp_path), [some[:60], some[60:61], some[61:]], lambda m: msg.sender_history(m.where("text is not null").withColumn("sender_id", longs)), "update")
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("sender_id").agg(F.max_by("texts", "batch").alias("texts")).collect()
    assert {r.sender_id: r.texts for r in got} == want
    batch = msg.sender_history(table(spark, some).withColumn("sender_id", longs))
    assert {r.sender_id: r.texts for r in batch.collect()} == want
    assert msg.sender_history(table(spark, rows).where("false")).count() == 0


def test_first_of_an_id_asks_no_python(spark, tmp_path):
    table(spark, events(5)).write.parquet(f"{tmp_path}/in")
    plan = msg.once(spark.readStream.schema(msg.EVENT).parquet(f"{tmp_path}/in"), "30 days")._jdf.queryExecution().analyzed().toString()
    assert "InPandas" not in plan and "session_window" in plan  # a call an id took a millisecond
