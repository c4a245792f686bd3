"""Processing of many agents at once, in which one that fails or takes too long doesn't hold up the others."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB = "agent_id string, session_id string, status string, error string"
#: Seconds that interrupted work gets to end.
GRACE = 60.0


class Failures(RuntimeError):
    """Some agents (rows: agent_id, error) can't be processed, and it is known which; the others can go on without them."""

    def __init__(self, rows: DataFrame):
        super().__init__("some agents failed")
        self.rows = rows


def attempt(spark: SparkSession, work: Callable[[Callable[[], bool]], None], seconds: float, grace: float = GRACE) -> Exception | None:
    """Runs work(still) in a thread of its own, and returns what it raised. After `seconds` the Spark jobs it has started are interrupted, still() says no from then on, and a TimeoutError is
    returned as soon as the work has ended, or after `grace`."""
    tag, raised, late, context = f"engram-{uuid.uuid4().hex}", [], threading.Event(), spark.sparkContext

    def run() -> None:
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            work(lambda: not late.is_set())
        except Exception as e:  # noqa: BLE001  whatever it is, it is this work's own
            raised.append(e)
        finally:
            context.removeJobTag(tag)
            context.setInterruptOnCancel(False)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not thread.is_alive():
        return raised[0] if raised else None
    late.set()
    until = time.monotonic() + grace
    while thread.is_alive() and time.monotonic() < until:
        context.cancelJobsWithTag(tag)
        thread.join(0.2)
    return TimeoutError(f"took over {seconds:g} s")


def run_isolated(
    sessions: DataFrame,
    process: Callable[[DataFrame, Callable[[], bool]], None],
    seconds: float,
    write: Callable[[DataFrame, str], DataFrame],
) -> DataFrame:
    """What became of each of sessions (agent_id, session_id, ...; one of each agent): JOB, with status done or failed.

    process(sessions, still) takes all agents at once, in `seconds` at most, and has to leave nothing behind if it raises. Where it says which agents failed (Failures), the others are
    processed again without them. Where it doesn't, or takes too long, the agents are split in two halves by the bits of a hash, until what fails is one agent: so f failing agents among n
    cost about f * log2(n) further attempts, and nothing of any other agent is lost.
    """
    spark = sessions.sparkSession
    keys = ["agent_id", "session_id"]
    groups, found, step = [(sessions, 0)], [], 0
    state = lambda rows, status, error: rows.select(*keys, F.lit(status).alias("status"), error.alias("error"))
    while groups:
        rows, depth = groups.pop()
        rows, step = write(rows, f"group{step}"), step + 1
        agents = rows.select("agent_id").distinct().limit(2).count()
        if not agents:
            continue
        error = attempt(spark, lambda still, rows=rows: process(rows, still), seconds)
        if error is None:
            found.append(state(rows, "done", F.lit("")))
        elif isinstance(error, Failures):
            failed = write(error.rows.groupBy("agent_id").agg(F.min("error").alias("error")), f"failed{step}")
            lost = write(rows.join(failed, "agent_id"), f"lost{step}")
            found.append(state(lost, "failed", F.col("error")))
            if lost.limit(1).count():
                groups.append((rows.join(failed, "agent_id", "left_anti"), depth))
            else:  # it names agents that aren't here
                found.append(state(rows, "failed", F.lit(str(error))))
        elif agents == 1 or depth == 64:
            found.append(state(rows, "failed", F.lit(f"{type(error).__name__}: {str(error)[:500]}")))
        else:
            bit = F.shiftrightunsigned(F.xxhash64("agent_id"), depth).bitwiseAND(F.lit(1))
            groups += [(rows.filter(bit == 1), depth + 1), (rows.filter(bit == 0), depth + 1)]
    out = spark.createDataFrame([], JOB)
    for df in found:
        out = out.unionByName(df)
    return write(out, "jobs")
