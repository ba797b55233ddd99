"""Edit events as a stream: sessions, save points, ordered apply, latest state, expiry, duplicates.

Every operator takes and returns a streaming DataFrame (most work on a batch one as well); ``to_table`` runs
one to the end of what is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioframe.session import ROCKSDB_PROVIDER, cut_lineage, scratch_folder


def to_table(stream: DataFrame, mode: str = "append", name: str = "stream", out: str | None = None) -> DataFrame:
    """Run a stream over all input there is, into files in the shared folder; gives the table it wrote.

    With the folder ``out`` of an earlier run the stream goes on from where that one ended.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    out = out or scratch_folder(spark, name)
    query = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/progress")
             .trigger(availableNow=True).start(f"{out}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def replay(table: DataFrame, part: str, parts: list[int], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Deliver a table part by part (column ``part``, in the order of ``parts``) and run a stream after each delivery.

    ``run`` gets the stream of all deliveries; it is started anew each time, from its own progress folder, so a part is a
    trigger and a restart. Gives the result of the last run.
    """
    spark = table.sparkSession
    source, held = scratch_folder(spark, "deliveries"), cut_lineage(table)
    schema = table.drop(part).schema
    for number in parts:
        held.where(F.col(part) == number).drop(part).write.mode("append").parquet(source)
        out = run(spark.readStream.schema(schema).parquet(source))
    return out


def typing_sessions(edits: DataFrame, gap: str = "1200 milliseconds", late: str | None = "1 minute") -> DataFrame:
    """Bursts of edits of a document; a pause ends the burst: (doc_id, start, end, edits, first_seq, last_seq).

    ``late`` is None where the edits have a watermark already, as after ``without_duplicates``.
    """
    timed = edits.withWatermark("ts", late) if late else edits
    return (timed.groupBy("doc_id", F.session_window("ts", gap).alias("w"))
            .agg(F.count("*").alias("edits"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
            .select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "edits", "first_seq", "last_seq"))


def save_points(edits: DataFrame, quiet: str = "20 seconds", retry: str | None = None, late: str = "1 minute") -> DataFrame:
    """When to save: a quiet time after the last change, with what the last change left.

    An edit made while the editor is busy (column ``busy``) holds the save off for the retry time instead.
    """
    wait = F.when(F.col("busy"), retry or quiet).otherwise(quiet) if "busy" in edits.columns else F.lit(quiet)
    return (edits.withWatermark("ts", late).groupBy("doc_id", F.session_window("ts", wait).alias("w"))
            .agg(F.max("seq").alias("seq"), F.max_by("after", "seq").alias("after"), F.count("*").alias("edits"))
            .select("doc_id", F.col("w.end").alias("saved_at"), "seq", "after", "edits"))


def without_duplicates(edits: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Deliveries repeated within the watermark are dropped."""
    return edits.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class _InOrder(StatefulProcessor):
    """Holds requests back until all earlier ones of the document are there. Numbers start at zero."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turn = handle.getValueState("turn", "n bigint")
        self.waiting = handle.getMapState("waiting", "seq bigint", "op string, annot_id string, after string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        turn = self.turn.get()[0] if self.turn.exists() else 0
        for row in rows:
            if row.seq >= turn:
                self.waiting.updateValue((row.seq,), (row.op, row.annot_id, row.after))
        while self.waiting.containsKey((turn,)):
            op, annot_id, after = self.waiting.getValue((turn,))
            self.waiting.removeKey((turn,))
            yield Row(doc_id=key[0], seq=turn, op=op, annot_id=annot_id, after=after)
            turn += 1
        self.turn.update((turn,))

    def close(self) -> None:
        pass


def apply_in_order(requests: DataFrame) -> DataFrame:
    """One request of a document after the other, whatever order they arrive in; ``seq`` counts from zero."""
    return requests.groupBy("doc_id").transformWithState(
        statefulProcessor=_InOrder(), outputStructType="doc_id bigint, seq bigint, op string, annot_id string, after string",
        outputMode="Append", timeMode="None")


class _Latest(StatefulProcessor):
    """The newest form of a mark; says something only when it really differs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, op string, form string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: r.seq)
        old = self.last.get() if self.last.exists() else None
        if old is not None and old[0] >= newest.seq:
            return
        self.last.update((newest.seq, newest.op, newest.after))
        gone, was_gone = newest.op == "delete", old is None or old[1] == "delete"
        if gone and was_gone:
            return
        action = "delete" if gone else "insert" if was_gone else "update"
        if action == "update" and old[2] == newest.after:
            return
        yield Row(doc_id=key[0], annot_id=key[1], seq=newest.seq, action=action, after=newest.after)

    def close(self) -> None:
        pass


def latest_state(edits: DataFrame) -> DataFrame:
    """Changes to the state of every mark as edits arrive: insert, update, delete, nothing where nothing changed.

    The key is one mark, so a busy document spreads over tasks; a batch combines to its newest edit per mark
    before it meets the state.
    """
    return edits.select("doc_id", "annot_id", "seq", "op", "after").groupBy("doc_id", "annot_id").transformWithState(
        statefulProcessor=_Latest(), outputStructType="doc_id bigint, annot_id string, seq bigint, action string, after string",
        outputMode="Append", timeMode="None")


_KEY = ["doc_id", "annot_id"]


def merge_latest(edits: DataFrame, target: str) -> None:
    """Keep the newest form of every mark in ``target``: (doc_id, annot_id, seq, op, after) in ``state``, what each trigger
    changed in ``changes``, both by trigger.

    A trigger is combined to its newest edit per mark in the tasks that read it, then joined to the state of the trigger
    before. Its folders are named by its number and written anew if it has to be repeated, so nothing counts twice.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*_KEY).agg(F.max_by(F.struct("seq", "op", "after"), "seq").alias("n"))
        state = spark.read.parquet(f"{target}/state/trigger={number - 1}") if number else spark.createDataFrame([], batch.select(*_KEY, "seq", "op", "after").schema)
        both = newest.join(state.select(*_KEY, F.struct("seq", "op", "after").alias("o")), _KEY, "full")
        won = F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n.seq") > F.col("o.seq")))
        gone, was_gone = F.col("n.op") == "delete", F.col("o").isNull() | (F.col("o.op") == "delete")
        action = (F.when(~won | (gone & was_gone), None).when(gone, "delete").when(was_gone, "insert")
                  .when(~F.col("n.after").eqNullSafe(F.col("o.after")), "update"))
        now = cut_lineage(both.select(*_KEY, F.when(won, F.col("n")).otherwise(F.col("o")).alias("s"), action.alias("action")))
        now.select(*_KEY, "s.*").write.mode("overwrite").parquet(f"{target}/state/trigger={number}")
        now.where(F.col("action").isNotNull()).select(*_KEY, "s.seq", "action", "s.after").write.mode("overwrite").parquet(f"{target}/changes/trigger={number}")

    edits.select(*_KEY, "seq", "op", "after").writeStream.foreachBatch(merge).option("checkpointLocation", f"{target}/progress").trigger(
        availableNow=True).start().awaitTermination()


def merged_marks(spark: SparkSession, target: str) -> DataFrame:
    """The marks that ``merge_latest`` holds: those of its last trigger that were not deleted."""
    state = spark.read.parquet(f"{target}/state")
    last = state.agg(F.max("trigger").alias("trigger"))
    return state.join(F.broadcast(last), "trigger").where(F.col("op") != "delete").select(*_KEY, "after", "seq")


def current_marks(changes: DataFrame) -> DataFrame:
    """The table of marks that a log of changes leaves."""
    last = changes.groupBy("doc_id", "annot_id").agg(F.max_by(F.struct("action", "after", "seq"), "seq").alias("l"))
    return last.where(F.col("l.action") != "delete").select("doc_id", "annot_id", "l.after", "l.seq")


def expired_drafts(drafts: DataFrame, days: int = 30, late: str = "1 hour") -> DataFrame:
    """Drafts nobody saved again within the limit, told when the stream's time passes it: (doc_id, seq, saved_ms).

    Saves of a document closer than the limit are one session; it ends, and the draft with it, when none follows. Saves are
    combined in the tasks that read them.
    """
    return (drafts.withWatermark("ts", late).groupBy("doc_id", F.session_window("ts", f"{days} days").alias("w"))
            .agg(F.max(F.struct(F.unix_millis("ts").alias("at"), "seq")).alias("s"))
            .select("doc_id", "s.seq", F.col("s.at").alias("saved_ms")))


def read_events(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the given folder as a stream, be it one file or a folder of files: a pattern may stand for either."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}.parquet")
