"""The file-change feed: debounced, deduplicated and applied to the tables in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import repo_path
from ..operators.changes import file_changes
from ..operators.tables import one_per_key

# Folders that are never watched, and the quiet and longest waits in milliseconds.
SKIPPED_FOLDERS = ["node_modules", ".git"]
QUIET_MS, HOLD_MS, LEAST_MS = 80, 500, 10


def is_watched(path: Column, ignored: list[str] | None = None) -> Column:
    """`.ts` and `.tsx` files but not declarations, outside skipped folders and ignored path patterns (regular expressions).

    Of the patterns that match the last one counts; one that begins with `!` takes the path back in.
    """
    clean = repo_path(path)
    kept = clean.rlike(r"\.tsx?\z") & ~F.endswith(clean, F.lit(".d.ts")) & ~F.arrays_overlap(F.split(clean, "/"), F.array(*[F.lit(f) for f in SKIPPED_FOLDERS]))
    skipped = F.lit(False)
    for pattern in ignored or []:
        skipped = F.when(clean.rlike(pattern.removeprefix("!")), not pattern.startswith("!")).otherwise(skipped)
    return kept & ~skipped


def flush_delay(first_ms: int, now_ms: int, quiet_ms: int = QUIET_MS, hold_ms: int = HOLD_MS) -> int:
    """How long to wait after an event: the quiet time, less when the first event has waited long, never under 10 ms."""
    waited = now_ms - first_ms
    return max(LEAST_MS, hold_ms - waited) if waited + quiet_ms > hold_ms else quiet_ms


def _debounce(quiet_ms: int, hold_ms: int):
    """State per key: first event, due time and pending paths. A flush is emitted when an event or the clock passes the due time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, due, paths = state.get if state.exists else (0, 0, [])
        out: list[dict[str, Any]] = []
        if state.hasTimedOut:
            out.append({"repo": key[0], "flush_ms": due, "paths": sorted(set(paths))})
            state.remove()
        else:
            events = pd.concat(list(frames)).sort_values(["at_ms", "path"])
            for at, path in zip(events["at_ms"], events["path"]):
                if paths and at >= due:
                    out.append({"repo": key[0], "flush_ms": due, "paths": sorted(set(paths))})
                    paths = []
                if not paths:
                    first = int(at)
                paths = [*paths, path]
                due = int(at) + flush_delay(first, int(at), quiet_ms, hold_ms)
            state.update((first, due, paths))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["repo", "flush_ms", "paths"])

    return run


def debounced(events: DataFrame, quiet_ms: int = QUIET_MS, hold_ms: int = HOLD_MS, late: str = "0 milliseconds") -> DataFrame:
    """(repo, flush_ms, paths) from a stream of (repo, path, at timestamp): one row per flush of each repository.

    State is kept per repository and is as large as what waits in one; repositories are spread over the cluster.
    """
    timed = events.withWatermark("at", late).select("repo", "path", "at", F.unix_millis("at").alias("at_ms"))
    return timed.groupBy("repo").applyInPandasWithState(
        _debounce(quiet_ms, hold_ms), "repo string, flush_ms long, paths array<string>", "first long, due long, paths array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def quiet_sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, started, ended, n_events): runs of events with gaps of at most `gap`; batch or stream (with a watermark)."""
    grouped = events.groupBy(F.col(key), F.session_window(at, gap).alias("s"))
    return grouped.agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n_events")).drop("s")


def flush_changes(batch: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status, content_hash) of a micro-batch of (path, content_hash, seq); a null hash means the file is gone.

    Of several events of one path the last counts. Unchanged files are left out, as is the removal of an unknown file.
    """
    last = one_per_key(batch.withColumn("path", repo_path(F.col("path"))), ["path"], [F.col("seq").desc()])
    there = last.where("content_hash IS NOT NULL").select("path", "content_hash")
    known = current.join(last.select("path"), "path", "left_semi")
    status = file_changes(known, there).where("status <> 'unchanged'")
    return status.join(there, "path", "left")


def flush_outcomes(outcomes: DataFrame) -> DataFrame:
    """(status, n): the outcomes of a flush by status, without unchanged files."""
    return outcomes.where("status <> 'unchanged'").groupBy("status").agg(F.count("*").alias("n"))


def watch(changes: DataFrame, read_current: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run `apply(changes, batch_id)` on every micro-batch of a stream of (path, content_hash, seq).

    `apply` must be idempotent per batch id, as a batch may be delivered again after a failure.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        apply(flush_changes(batch.where(is_watched(F.col("path"))), read_current()), batch_id)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{HOLD_MS} milliseconds")).start()
