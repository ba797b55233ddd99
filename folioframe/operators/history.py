"""Edit history: gestures, state at a step, retention, recent files. The order of edits is ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.operators.scale import first_per_key, previous, running


def collapse_gestures(edits: DataFrame) -> DataFrame:
    """Neighbouring edits with one token become one step: (doc_id, step, annot_id, before, after, edits).

    Each mark of a step keeps its first before and its last after. Steps are numbered by chunked running sums
    over ``seq``, so one busy document spreads over tasks.
    """
    marked = previous(edits.select("doc_id", "seq", "annot_id", "merge_token", "before", "after"), ["doc_id"], "seq", ["merge_token"])
    starts = F.when(F.col("merge_token").isNotNull() & (F.col("merge_token") == F.col("prev_merge_token")), 0).otherwise(1)
    steps = running(marked, ["doc_id"], "seq", {"step": ("sum", starts)})
    return steps.groupBy("doc_id", "step", "annot_id").agg(
        F.min_by("before", "seq").alias("before"), F.max_by("after", "seq").alias("after"), F.count("*").alias("edits"))


def state_at(edits: DataFrame, step: DataFrame | None = None) -> DataFrame:
    """The marks as they stood after edit n (doc_id, n), or now; undo and redo are a choice of n."""
    seen = edits if step is None else edits.join(step, "doc_id").where(F.col("seq") <= F.col("n"))
    last = seen.groupBy("doc_id", "annot_id").agg(F.max_by(F.struct("op", "after"), "seq").alias("l"))
    return last.where(F.col("l.op") != "delete").select("doc_id", "annot_id", "l.after")


def retained(snapshots: DataFrame, count: int = 15, size: int = 300_000_000) -> DataFrame:
    """The newest snapshots, at most ``count`` and ``size`` bytes together; the newest always stays.

    Each task first cuts to ``count`` rows a document, so the running size covers that many rows at most.
    """
    newest = first_per_key(snapshots, ["doc_id"], [F.col("seq").desc()], count)
    total = F.sum("bytes").over(Window.partitionBy("doc_id").orderBy("_rank"))
    return newest.withColumn("_total", total).where((F.col("_rank") == 1) | (F.col("_total") <= size)).drop("_rank", "_total")


def recent_files(opened: DataFrame, keep: int = 8) -> DataFrame:
    """The last files of each user, newest first, every file once: (user_id, entry, at, position)."""
    latest = opened.groupBy("user_id", "entry").agg(F.max("at").alias("at"))
    return first_per_key(latest, ["user_id"], [F.col("at").desc(), F.col("entry")], keep, "position")


def live_drafts(drafts: DataFrame, now, days: int = 30) -> DataFrame:
    """Drafts not older than their time limit; ``now`` is a timestamp column."""
    return drafts.where(F.col("saved_at") >= now - F.expr(f"interval {days} days"))
