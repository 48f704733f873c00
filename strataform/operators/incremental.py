"""Taking in only what is new or changed, with the target as the only state.

Rows of the target carry the source key and version they were made from.  What
a run must do follows from the target alone: the source is reduced to the
newest version of each key and anti-joined against the target.  A run that
dies before it publishes leaves the target, and hence the next run's work, as
it was; a run that publishes does it in one step.  Nothing is skipped or
repeated, and there is no cursor to lose.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.text import instant
from strataform.sources.versions import BUCKET_ROWS, VersionedTable, bucket_of, buckets_for
from strataform.workspace import run_dir, staged


def newest(rows: DataFrame, key: Column, version: Column) -> DataFrame:
    """``key, version``: the greatest version of each key, null if no row has one.

    Rows without a key are left out.  The maximum is combined before the
    shuffle, so a hot key costs one row per input split.
    """
    return rows.select(key.alias("key"), version.alias("version")).where("key is not null").groupBy("key").agg(F.max("version").alias("version"))


def pending(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source keys that the target doesn't hold in this version or a later one.

    Both sides have ``key, version``, one row a key.  A key whose source
    version is unknown is pending only while the target has none for it.
    """
    have = target.where("version is not null").select(F.col("key").alias("t_key"), F.col("version").alias("t_version"))
    up_to_date = (F.col("key") == F.col("t_key")) & (F.col("version").isNull() | (F.col("t_version") >= F.col("version")))
    return source.join(have, up_to_date, "left_anti")


def succeeded_runs(runs: DataFrame, status: str = "succeeded") -> DataFrame:
    """``run_id`` of the runs whose latest status is ``status``."""
    last = F.max_by("status", F.struct("status_at", "status"))
    return runs.where("run_id is not null and status_at is not null").groupBy("run_id").agg(last.alias("final")).where(F.col("final") == status).select("run_id")


def taken_in(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Log rows that count: outcome done, of a run that succeeded in the end."""
    return log.where("outcome = 'done'").join(succeeded_runs(runs), "run_id", "left_semi")


def listings(doc_meta: DataFrame) -> DataFrame:
    """``key, version``: listed documents and the times they were modified, null where unreadable."""
    return doc_meta.select(F.col("id").alias("key"), instant(F.col("modified_time")).alias("version"))


def changes_of(feed: DataFrame) -> DataFrame:
    """``key, version``: files of the change feed and their sequences."""
    return feed.select(F.col("file_id").alias("key"), F.col("seq").alias("version"))


def taken_listings(counting: DataFrame) -> DataFrame:
    return counting.select(F.col("file_id").alias("key"), instant(F.col("modified_time")).alias("version"))


def taken_changes(counting: DataFrame) -> DataFrame:
    return counting.select(F.col("file_id").alias("key"), F.col("last_seq").alias("version"))


def targets_of(log: DataFrame, runs: DataFrame, folder: str | None = None) -> dict[str, IncrementalTarget]:
    """A published target for listings and one for the feed, holding what the log says was taken in."""
    spark = log.sparkSession
    folder = folder or f"{run_dir(spark)}/taken-{uuid.uuid4().hex[:10]}"
    counting = taken_in(log, runs)
    out = {}
    for kind, taken in (("listing", taken_listings(counting)), ("feed", taken_changes(counting))):
        out[kind] = IncrementalTarget(VersionedTable(spark, f"{folder}/{kind}"))
        out[kind].adopt(taken.where("version is not null"))
    return out


def next_run(doc_meta: DataFrame, changes: DataFrame, log: DataFrame, runs: DataFrame, folder: str | None = None) -> DataFrame:
    """``record_kind, file_id, version``: what the next run must take in.

    What was taken in becomes the first version of two targets; what is pending
    follows from them.  Listings and the feed keep versions of their own (a
    time, a sequence); the version comes out as text for both to share a
    column.  Null keys, times and sequences, repeated and late rows are allowed
    everywhere; an empty log makes everything pending, an empty source nothing.
    """
    sources = {"listing": listings(doc_meta), "feed": changes_of(changes)}
    parts = [
        target.pending(sources[kind]).select(F.lit(kind).alias("record_kind"), F.col("key").alias("file_id"), F.col("version").cast("string").alias("version"))
        for kind, target in targets_of(log, runs, folder).items()
    ]
    return parts[0].unionByName(parts[1])


#: Marks the row that stands for a key whose transform gave none.
EMPTY = "_empty"


class IncrementalTarget:
    """A published table of results, each row with the ``key`` and ``version`` it was made from.

    A key whose transform gives no rows has one that says so and that readers
    don't see; so every key taken in has a version here.  Rows are kept in
    buckets by key, and a run reads and writes only those it touches.
    """

    def __init__(self, table: VersionedTable):
        self.table = table

    def _all(self) -> DataFrame | None:
        return self.table.read()

    def rows(self) -> DataFrame | None:
        """The results; None before the first version."""
        rows = self._all()
        return None if rows is None else rows.where(~F.col(EMPTY)).drop(EMPTY)

    def state(self) -> DataFrame | None:
        rows = self._all()
        return None if rows is None else newest(rows, F.col("key"), F.col("version"))

    def pending(self, source: DataFrame) -> DataFrame:
        """Newest source rows (``key, version`` and payload) not yet in the target.

        A key without any version gives one of its rows.  As in ``pending``, it
        counts as done once the target has a version for it; until then nothing
        tells whether it changed, so every run takes it in and replaces it.
        """
        order = F.struct(F.col("version").isNotNull(), "version")
        latest = source.where("key is not null").groupBy("key").agg(F.max_by(F.struct("*"), order).alias("row"), F.max("version").alias("version"))
        state = self.state()
        left = latest if state is None else pending(latest, state)
        return left.select("row.*")

    def adopt(self, taken: DataFrame) -> int:
        """Publish ``key, version`` of what others have taken in, as a first version without results."""
        if self.table.current():
            raise ValueError("the target has a version already")
        rows = newest(taken, F.col("key"), F.col("version")).withColumn(EMPTY, F.lit(True))
        return self._publish(staged(rows, "taken"), None, 0)

    def run(self, source: DataFrame, transform) -> int:
        """Process what is pending and publish it; returns the new version number.

        ``transform`` gets the pending rows and must keep ``key`` and
        ``version``.  Its rows replace the target's rows of all pending keys.
        If it fails nothing is published, and the next run finds the same work.
        """
        base = self.table.current()
        work = staged(self.pending(source), "pending")
        made = staged(transform(work).withColumn(EMPTY, F.lit(False)), "made")
        none = work.join(made.select("key"), "key", "left_anti").select("key", "version").withColumn(EMPTY, F.lit(True))
        return self._publish(made.unionByName(none, allowMissingColumns=True), work.select("key"), base)

    def _publish(self, fresh: DataFrame, handled: DataFrame | None, base: int) -> int:
        held = self.table.bucketed(version=base) if base else None
        keys = fresh.select("key") if handled is None else handled
        n = held["buckets"] if held else buckets_for(keys.count())
        stored = held["rows"] if held else 0
        if held and stored > 2 * BUCKET_ROWS * n:
            n, old = buckets_for(stored), self._all()
            touched, held = list(range(n)), None
        else:
            touched = [r["b"] for r in keys.select(bucket_of(F.col("key"), n).alias("b")).distinct().collect()]  # n numbers at most
            old = self.table.read_buckets(touched, version=base) if held else None
        if old is not None:
            fresh = fresh.unionByName(old.join(handled.distinct(), "key", "left_anti"), allowMissingColumns=True)
        part = self.table.rewrite(fresh, "key", touched, n, held)
        return self.table.publish({"data": part | {"rows": stored + keys.count()}}, expected=base)
