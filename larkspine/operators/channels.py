"""Channels of a search that run by themselves, so that one that fails or stalls while it runs leaves the others' results."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("larkspine.channels")
HITS = "query_id long, doc_id long, score double, rank int"


@dataclass
class Outcome:
    """What a channel found, or none and why."""

    hits: DataFrame
    error: str | None = None
    seconds: float = 0.0


def run(spark: SparkSession, searches: dict[str, Callable[[], DataFrame]], folder: str, timeout_s: float) -> dict[str, Outcome]:
    """Runs all searches at once, each in a thread and under a job tag of its own, and writes their results (queries x k rows of HITS) under
    ``folder``, which driver and executors share.  A search that raises, when planned or in a task, or that takes more than ``timeout_s``, is
    cancelled alone and gives no rows and an error.  A cancelled search may go on until Spark has killed its tasks, but is not waited for.
    Channels share the cluster's slots, in pools of their own where ``spark.scheduler.mode`` is FAIR: one whose stalled tasks fill all of them
    holds up the others too."""
    folder = f"{folder}/channels-{uuid.uuid4().hex}"
    began, threads = time.monotonic(), {}
    done: dict[str, Outcome] = {}
    none = lambda why: Outcome(spark.createDataFrame([], HITS), why, time.monotonic() - began)

    def search(name: str, tag: str) -> None:
        sc = spark.sparkContext
        sc.addJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", f"channel-{name}")
        sc.setInterruptOnCancel(True)
        try:
            path = f"{folder}/{name}"
            searches[name]().selectExpr("cast(query_id as long) as query_id", "cast(doc_id as long) as doc_id", "cast(score as double) as score", "cast(rank as int) as rank").write.parquet(path)
            done[name] = Outcome(spark.read.schema(HITS).parquet(path), None, time.monotonic() - began)
        except Exception as e:  # whatever a channel raises is its result
            done[name] = none(f"{type(e).__name__}: {e}")

    for name in searches:
        tag = f"channel-{name}-{uuid.uuid4().hex}"
        threads[name] = tag, InheritableThread(target=search, args=(name, tag), daemon=True)
        threads[name][1].start()
    out = {}
    for name, (tag, thread) in threads.items():
        thread.join(max(0.0, timeout_s - (time.monotonic() - began)))
        if name not in done:
            spark.sparkContext.cancelJobsWithTag(tag)
        out[name] = done.get(name) or none(f"no result within {timeout_s:g} s")
        if out[name].error:
            log.warning("channel %s: %s", name, out[name].error.split("\n")[0])
    return out
