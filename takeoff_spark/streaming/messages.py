"""Message events: gates, counters and histories, on streams and on tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.window import Window

from ..sources.io import read_message_events

EVENT = "seq long, ts timestamp, sender_id string, mid string, text string"


def _said(events: DataFrame) -> DataFrame:
    """Events with a sender and a text, by a predicate on the time as well, which stays above the watermark: rows without text move it on."""
    return events.where(F.when(F.col("ts").isNull(), False).otherwise((F.coalesce("sender_id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")))


def messages(payloads: DataFrame) -> DataFrame:
    """Events with a sender and a text (batch or stream)."""
    return read_message_events(payloads).where("coalesce(sender_id, '') <> '' and coalesce(text, '') <> ''")


def dedupe(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each mid once. Stream: within the watermark, later rows are dropped. Batch: the first by seq."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["mid"])
    return events.withColumn("r", F.row_number().over(Window.partitionBy("mid").orderBy("seq"))).where("r = 1").drop("r")


# Quota of replies a day


def replies(events: DataFrame, own_id: str | None = None) -> DataFrame:
    """Adds ``day`` (UTC) and ``own``: whether the message is one of the account itself, which is never answered and doesn't count."""
    return events.withColumns({"day": F.to_date("ts"), "own": F.coalesce(F.col("sender_id").cast("string") == F.lit(own_id), F.lit(False))})


def numbered(rows: DataFrame, key: str, order: str, name: str, at_once: int = 100_000) -> DataFrame:
    """The rank of each row in its key by ``order`` (a long), as a distributed prefix count.

    Ranges of ``order`` with about ``at_once`` rows are counted by key, the counts of earlier ranges are added up, and
    rows are numbered inside their range; so no task holds a key, unless one value of ``order`` repeats that often.
    """
    least, most, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    width = max(1, -(-((most or 0) - (least or 0) + 1) * at_once // max(1, n)))
    ranged = rows.withColumn("range", F.floor((F.col(order) - F.lit(least or 0)) / width))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(key, "range").agg(F.count("*").alias("n")).select(key, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(key, "range").orderBy(order))
    return ranged.withColumn("inside", inside).join(offsets, [key, "range"]).withColumn(name, F.col("inside") + F.col("offset")).drop("range", "inside", "offset")


def daily_quota(events: DataFrame, cap: int = 200, own_id: str | None = None, agent_on: bool = True, at_once: int = 100_000) -> DataFrame:
    """Messages that get a reply (``sent``), in the order of seq.

    The gates: the agent is on (else nothing is consumed: no rows), a text, the first of its mid, fewer than ``cap``
    replies on its UTC day, not from the account itself. An id over the cap stays consumed. ``day_rank`` numbers a
    day's messages that would be answered; own ones have none.
    """
    first = replies(dedupe(events.where("coalesce(text, '') <> ''")), own_id).where(F.lit(agent_on))
    counted = numbered(first.where("NOT own"), "day", "seq", "day_rank", at_once)
    rows = counted.unionByName(first.where("own").withColumn("day_rank", F.lit(None).cast("long")))
    return rows.withColumn("sent", F.coalesce(F.col("day_rank") <= cap, F.lit(False))).drop("day", "own")


def once(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stream: of each mid the earliest event by seq, whatever the order of arrival within ``delay``; ids are forgotten ``delay`` after their last event.

    Spark's own session windows keep the earliest event of each id, so nothing runs in Python for every id.
    """
    rows = _said(events.withWatermark("ts", delay))
    kept = F.struct("ts", "sender_id", "text")
    best = rows.groupBy(F.session_window("ts", delay), "mid").agg(F.min("seq").alias("seq"), F.min_by(kept, "seq").alias("e"))
    return best.select("seq", F.col("e.ts").alias("ts"), F.col("e.sender_id").alias("sender_id"), "mid", F.col("e.text").alias("text"))


def quota_of_day(cap: int):
    """Keyed state of one day: the ``cap`` messages of the smallest seq. What falls out is over the cap for sure and leaves at once; the rest is sent when the day has ended."""

    def rows(pairs, sent: bool) -> pd.DataFrame:
        return pd.DataFrame({"seq": [s for s, _ in pairs], "mid": [m for _, m in pairs], "sent": [sent] * len(pairs)})

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield rows(held, True)
            return
        for f in frames:
            own = f[f.own]
            if len(own):
                yield rows(list(zip(own.seq, own.mid, strict=True)), False)
            held = sorted([*held, *((int(s), m) for s, m in zip(f.seq[~f.own], f.mid[~f.own], strict=True))])
            if len(held) > cap:
                yield rows(held[cap:], False)
                held = held[:cap]
        state.update(([s for s, _ in held], [m for _, m in held]))
        ends = pd.Timestamp(key[0]) + pd.Timedelta(days=1)
        state.setTimeoutTimestamp(max(int(ends.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    return step


def quota_stream(first: DataFrame, cap: int = 200, own_id: str | None = None, agent_on: bool = True, delay: str = "1 day") -> DataFrame:
    """Stream of first messages (``once``) to (seq, mid, sent): ``daily_quota`` with keyed state by day, of ``cap`` rows at most.

    The order of arrival doesn't matter within ``delay``: a day is settled when the watermark has passed its end.
    """
    rows = replies(_said(first.withWatermark("ts", delay)), own_id).where(F.lit(agent_on)).select("ts", "day", "own", "seq", "mid")
    return rows.groupBy("day").applyInPandasWithState(quota_of_day(cap), "seq long, mid string, sent boolean", "seqs array<long>, mids array<string>", "append", "EventTimeTimeout")


# Counters, posts, histories


def daily_counters(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events with sender and text per UTC day; on a stream the day closes with the watermark, later rows are dropped (``late_rows``)."""
    rows = _said(events.withWatermark("ts", delay) if events.isStreaming else events)
    return rows.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("messages")).select(F.to_date("w.start").alias("day"), "messages")


def late_rows(query) -> int:
    """Rows that a stream's stateful operators dropped because their time lay before the watermark, over the progress that is kept."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])


def posts_due(rows: DataFrame, hours: int = 24) -> DataFrame:
    """Of each account's times those at least ``hours`` after the last one taken (the first is due).

    Times are made distinct before the shuffle, sorted inside partitions and folded: a task holds one
    batch and the last time taken, and jumps from a time taken to the next one that is due by binary search.
    """
    gap = hours * 3600
    times = rows.select("sender_id", F.unix_timestamp("ts").alias("posted")).where("posted IS NOT NULL").distinct()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sender, last = None, None
        for f in frames:
            keys = f.sender_id.astype(object).where(f.sender_id.notna(), None).to_numpy()
            t, taken = f.posted.to_numpy(), []
            starts = [0, *(i for i in range(1, len(f)) if keys[i] != keys[i - 1]), len(f)]
            for at, end in zip(starts, starts[1:], strict=False):
                if keys[at] != sender or last is None:
                    sender, last = keys[at], None
                while at < end:
                    if last is not None:
                        at += int(t[at:end].searchsorted(last + gap))
                    if at < end:
                        last = int(t[at])
                        taken.append(at)
            yield f.iloc[taken]

    return times.repartition("sender_id").sortWithinPartitions("sender_id", "posted").mapInPandas(fold, times.schema)


def post_step(gap: int):
    """Keyed state of one account: the last time taken. Once the gap is over it is dropped, as any later time is due then."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times, taken = sorted(t for f in frames for t in f.posted.tolist()), []
        for t in times:
            if last is None or t >= last + gap:
                last = t
                taken.append(t)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap) * 1000, state.getCurrentWatermarkMs() + 1))
        if taken:
            yield pd.DataFrame({"sender_id": [key[0]] * len(taken), "posted": taken})

    return step


def posts_due_stream(events: DataFrame, hours: int = 24, delay: str = "0 seconds") -> DataFrame:
    """Stream: ``posts_due`` where times arrive in order from batch to batch (inside a batch any order will do)."""
    rows = events.withWatermark("ts", delay).select("sender_id", "ts", F.unix_timestamp("ts").alias("posted"))
    return rows.groupBy("sender_id").applyInPandasWithState(post_step(hours * 3600), "sender_id string, posted long", "last long", "append", "EventTimeTimeout")


def history_of_sender(most: int):
    """Keyed state of one sender: its ``most`` messages of the largest seq, in order of seq."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:  # one chunk at a time, so that a batch of one busy sender needs no more memory
            last = f.sort_values("seq", kind="stable").tail(most)
            held = sorted([*held, *zip(map(int, last.seq), last.text, strict=True)], key=lambda x: x[0])[-most:]
        seqs, texts = [s for s, _ in held], [t for _, t in held]
        state.update((seqs, texts))
        yield pd.DataFrame({"sender_id": [key[0]], "seqs": [seqs], "texts": [texts]})

    return step


def sender_history(events: DataFrame, most: int = 20) -> DataFrame:
    """Each sender's last ``most`` texts in order of seq. Stream: after every batch, whatever the order of arrival."""
    if events.isStreaming:
        return events.groupBy("sender_id").applyInPandasWithState(history_of_sender(most), "sender_id long, seqs array<long>, texts array<string>", "seqs array<long>, texts array<string>", "update", "NoTimeout").select("sender_id", "texts")
    last = events.withColumn("r", F.row_number().over(Window.partitionBy("sender_id").orderBy(F.desc("seq")))).where(F.col("r") <= most)
    return last.groupBy("sender_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("m")).select("sender_id", F.col("m.text").alias("texts"))


def append_activity(events: DataFrame, path: str, checkpoint: str):
    """Append action rows to a log table as they come (``sink.append_once``)."""
    from .sink import append_once

    return append_once(events.select("ts", F.lit("message").alias("action"), F.to_json(F.struct("sender_id", "mid")).alias("details")), path, checkpoint)
