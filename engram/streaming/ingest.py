"""Streams of pushed sessions and of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from engram.functions.coerce import rfc3339
from engram.operators.lookups import exclude_boards
from engram.sources.store import Store, latest_per_key

PUSH = "agent_id string, session_id string, turn_count int, raw_turns string, session_date string, kanban_board string, kanban_board_name string, received_at timestamp"


def read_pushes(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON files of pushed sessions; the number of files per trigger holds back what comes too fast."""
    return spark.readStream.schema(PUSH).option("maxFilesPerTrigger", files_per_trigger).json(path)


def accept_pushes(pushes: DataFrame, excluded_boards: list[str]) -> DataFrame:
    """Pushes with a session id and turns whose board isn't excluded, as rows of session_transcripts; an invalid date is null."""
    ok = exclude_boards(pushes, "kanban_board", "kanban_board_name", excluded_boards)
    ok = ok.filter((F.coalesce("session_id", F.lit("")) != "") & (F.coalesce("raw_turns", F.lit("")) != ""))
    return ok.select(
        "session_id",
        "agent_id",
        "turn_count",
        "raw_turns",
        "received_at",
        rfc3339("session_date").alias("session_date"),
        F.lit(None).cast("timestamp").alias("processed_at"),
    )


def ingest(
    pushes: DataFrame,
    store: Store,
    checkpoint: str,
    excluded_boards: list[str] | None = None,
    process: Callable[[DataFrame], None] | None = None,
    mode: str = "both",
) -> StreamingQuery:
    """Upserts accepted pushes into session_transcripts, batch by batch, then hands the new ones to `process`, in order of receipt per agent. A batch that
    is run again writes the same rows; a session that fails to process stays unprocessed. A client that only reads (mode output) pushes nothing."""
    if mode == "output":
        raise ValueError("this client only reads")

    def batch(df: DataFrame, _: int) -> None:
        rows = latest_per_key(accept_pushes(df, excluded_boards or []), ["agent_id", "session_id"], [F.col("received_at"), F.col("turn_count")])
        store.upsert("session_transcripts", rows)
        if process:
            process(rows.repartition("agent_id").sortWithinPartitions("agent_id", "received_at"))

    return pushes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Sessions that a client remembers of an agent, and how long it remembers one that nothing more is pushed of.
KEPT_SESSIONS, KEPT_MS = 10, 30 * 24 * 3600 * 1000
CHANGED = "agent_id string, session_id string, fingerprint string, received_at timestamp"


class PushMemory(StatefulProcessor):
    """Per agent the fingerprints of its KEPT_SESSIONS newest sessions, each for KEPT_MS at most: so the state of an agent is bounded, and that of one that is gone ends."""

    def __init__(self, sessions: int, ttl_ms: int):
        self.sessions, self.ttl_ms = sessions, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "session_id string", "fingerprint string, received_at timestamp", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: (v[0], pd.Timestamp(v[1])) for k, v in self.last.iterator()}
        kept, changed = [], set()
        for r in pd.concat(list(rows)).sort_values(["received_at", "session_id"]).itertuples():
            before = known.get(r.session_id)
            if before is None or before[0] != r.fingerprint:
                kept.append((key[0], r.session_id, r.fingerprint, r.received_at))
            known[r.session_id] = (r.fingerprint, pd.Timestamp(r.received_at))
            changed.add(r.session_id)
        newest = sorted(known, key=lambda x: (known[x][1], x), reverse=True)
        for x in newest[self.sessions :]:
            if self.last.containsKey((x,)):
                self.last.removeKey((x,))
        for x in newest[: self.sessions]:
            if x in changed:
                self.last.updateValue((x,), (known[x][0], known[x][1].to_pydatetime()))
        yield pd.DataFrame(kept, columns=["agent_id", "session_id", "fingerprint", "received_at"])

    def close(self) -> None:
        pass


def changed_pushes(pushes: DataFrame, sessions: int = KEPT_SESSIONS, ttl_ms: int = KEPT_MS) -> DataFrame:
    """Pushes (agent_id, session_id, fingerprint, received_at) whose fingerprint differs from the session's last one that is remembered (see PushMemory). The state moves on with the
    batch, so a push that was lost is taken when it comes again. The state lies in RocksDB, which the session's conf is set to."""
    spark = pushes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = pushes.select("agent_id", "session_id", "fingerprint", "received_at")
    return rows.groupBy("agent_id").transformWithStateInPandas(PushMemory(sessions, ttl_ms), CHANGED, "Append", "ProcessingTime")


def usage_windows(events: DataFrame, ts: str, sums: dict[str, Column], late: str = "1 day") -> DataFrame:
    """Daily sums of a stream of usage events; nothing is lost at the turn of a day."""
    days = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"))
    return days.agg(*[F.sum(c).cast("long").alias(n) for n, c in sums.items()]).select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), *sums)


def idle_sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of events of a session that end after `gap` without another one."""
    bursts = events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return bursts.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
