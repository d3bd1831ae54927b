"""State between micro-batches as plain Parquet tables, one partition per batch.

Every batch writes only what it changed: store rows added, ids refreshed, keys
remembered and a Bloom filter of these.  A row in ``commits``, written last, makes the batch visible.  A
batch reads the commits before its own number, so running it again, after a
failure or from a checkpoint, reads the same past and replaces its own files.

``fold`` writes what is still in date as a snapshot, and all stories, merged; ``reset``
writes an empty one.  Snapshots are numbered apart from batches and say after which batch they stand: later batches
start from the latest one, a batch that is run again from the one it had before it.
The term model is written by the first batch that fits one and read by all later ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.vectors import VECTOR_TYPE, TermModel
from tidewire.operators.embedders import TermEmbedder
from tidewire.operators.membership import FILTER, build_filter
from tidewire.operators.stories import log_segments, story_log
from tidewire.plans.dedup import Outcome, process
from tidewire.plans.state import State, stamped, store_schema
from tidewire.schemas import SEEN, STORY_LOG
from tidewire.session import cut, small_broadcasts

TOUCH = "id string, at timestamp"
COMMIT = "store_from long, seen_from long, last_add_at timestamp"
FOLD = "upto long, last_add_at timestamp"
# A stream folds its state after so many batches.
FOLD_EVERY = 100
# Later than any batch.
END = 1 << 62


@dataclass
class Commit:
    v: int
    store_from: int
    seen_from: int
    last_add_at: datetime | None


@dataclass
class StateFolder:
    """State tables under ``root`` on the cluster's shared file system."""

    spark: SparkSession
    root: str
    vector_type: str = VECTOR_TYPE

    def __post_init__(self) -> None:
        """Give every table an empty first partition, unless the folder is in use."""
        for name, ddl in self._tables().items():
            empty = self.spark.createDataFrame([], ddl)
            empty.coalesce(1).write.mode("ignore").parquet(f"{self.root}/{name}/v=-1")

    def _tables(self) -> dict[str, str]:
        return {
            "adds": store_schema(self.vector_type),
            "touches": TOUCH,
            "seen": SEEN,
            "commits": COMMIT,
            "snap_store": store_schema(self.vector_type),
            "snap_seen": SEEN,
            "folds": FOLD,
            "filters": FILTER,
            "snap_filters": FILTER,
            "stories": STORY_LOG,
            "snap_stories": STORY_LOG,
        }

    def _read(self, name: str) -> DataFrame:
        ddl = self._tables()[name]
        return self.spark.read.schema(f"{ddl}, v long").parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str, v: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={v}")

    def _filter(self, keys: str, name: str, v: int, part: int) -> None:
        """Write the filter of the keys that partition ``v`` has got."""
        written = self._read(keys).where(F.col("v") == v).select("kind", "value")
        self._write(build_filter(written, written.count(), part), name, v)

    def last_commit(self, before: int) -> Commit | None:
        rows = (
            self._read("commits")
            .where(F.col("v") < before)
            .orderBy(F.desc("v"))
            .limit(1)
            .collect()
        )
        if not rows:
            return None
        r = rows[0]
        return Commit(r["v"], r["store_from"], r["seen_from"], r["last_add_at"])

    def last_fold(self, before: int) -> tuple[int, int, datetime | None]:
        """Number of the latest snapshot that batch ``before`` may read, the batch that it
        follows, and its time of the last addition; -1 without one."""
        rows = (
            self._read("folds")
            .where((F.col("upto") < before) & (F.col("v") >= 0))
            .orderBy(F.desc("upto"), F.desc("v"))
            .limit(1)
            .collect()
        )
        return (rows[0]["v"], rows[0]["upto"], rows[0]["last_add_at"]) if rows else (-1, -1, None)

    def load(self, before: int) -> tuple[State, Commit | None]:
        """State as of the last commit below ``before``: a snapshot and the batches after it."""
        snap, upto, folded_at = self.last_fold(before)
        last = self.last_commit(before)
        if last is None or (last.v <= upto and snap < 0):
            return State.empty(self.spark, self.vector_type), None
        later = last.v > upto
        # A batch that died before its commit left files but no commit row.
        done = self._read("commits").where(F.col("v").between(upto + 1, last.v)).select("v")

        def since(name: str, first: int) -> DataFrame:
            rows = self._read(name).where(F.col("v").between(max(first, upto + 1), last.v))
            return rows.join(done, "v", "left_semi").drop("v")

        def with_base(name: str, table: str, first: int) -> DataFrame:
            rows = since(table, first)
            if snap < 0 or (later and first > upto):
                return rows
            return self._read(name).where(F.col("v") == snap).drop("v").unionByName(rows)

        adds = with_base("snap_store", "adds", last.store_from)
        touches = (
            since("touches", last.store_from)
            .groupBy("id")
            .agg(F.max("at").alias("_at"))
        )
        newer = F.col("_at") > F.col("last_update")
        store = adds.join(touches, "id", "left").select(
            *[c for c in adds.columns if c not in ("metadata", "last_update")],
            F.when(newer, stamped(F.col("metadata"), F.col("_at"))).otherwise(F.col("metadata")).alias("metadata"),
            F.greatest("last_update", "_at").alias("last_update"),
        )
        seen = with_base("snap_seen", "seen", last.seen_from).select("kind", "value")
        filters = with_base("snap_filters", "filters", last.seen_from)
        return State(store, seen.distinct(), last.last_add_at if later else folded_at, filters=filters), last

    def _story_rows(self, before: int) -> DataFrame:
        """The log below ``before``: the latest snapshot and the committed batches after it."""
        snap, upto, _ = self.last_fold(before)
        done = self._read("commits").where((F.col("v") > upto) & (F.col("v") < before) & (F.col("v") >= 0)).select("v")
        rows = self._read("stories").where((F.col("v") > upto) & (F.col("v") < before)).join(done, "v", "left_semi")
        if snap >= 0:
            rows = rows.unionByName(self._read("snap_stories").where(F.col("v") == snap))
        return rows.drop("v")

    def stories(self, before: int = END, total: int = 0) -> DataFrame:
        """Every story's segments as of the last commit below ``before``."""
        return log_segments(self._story_rows(before), total)

    def tell(self, articles: DataFrame, results: DataFrame, v: int, total: int = 0) -> None:
        """Write what batch ``v`` adds to the stories; its commit makes it visible."""
        known = self._story_rows(v).where("starts").select("id").distinct()
        log, _ = story_log(known, articles, results, total, v)
        self._write(log, "stories", v)

    def model(self) -> TermModel | None:
        """The term model of this state, if a batch has written one."""
        try:
            found = TermModel.load(self.spark, f"{self.root}/model")
            return None if found.table.isEmpty() else found
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def keep_model(self, model: TermModel) -> None:
        model.table.write.mode("ignore").parquet(f"{self.root}/model")

    def commit(self, v: int, store_from: int, seen_from: int, last_add_at: datetime | None) -> None:
        row = self.spark.createDataFrame(
            [(store_from, seen_from, last_add_at)], COMMIT
        )
        self._write(row.coalesce(1), "commits", v)

    def advance(self, v: int, last: Commit | None, before: State, outcome: Outcome, now: datetime) -> None:
        """Write what batch ``v`` changed, then commit it."""
        self._write(outcome.added, "adds", v)
        self._write(outcome.touched.withColumn("at", F.lit(now)), "touches", v)
        self._write(outcome.new_keys, "seen", v)
        self._filter("seen", "filters", v, v)
        if last is None:
            self.commit(v, v, v, outcome.state.last_add_at)
            return
        expired = before.last_add_at is not None and before.seen_at(now) is not before.seen
        self.commit(
            v, last.store_from, v if expired else last.seen_from, outcome.state.last_add_at
        )

    def _fold(self, state: State | None, upto: int, last_add_at: datetime | None, now: datetime | None) -> None:
        number = (self._read("folds").agg(F.max("v")).first()[0] or 0) + 1
        stories = self.stories(upto + 1)
        if state is None:
            state = State.empty(self.spark, self.vector_type)
            store, seen, stories = state.store, state.seen, stories.limit(0)
        else:
            store, seen = state.fresh_store(now), state.seen_at(now)
        self._write(stories, "snap_stories", number)
        self._write(store, "snap_store", number)
        self._write(seen, "snap_seen", number)
        # Numbered below the batches' filters, so that none is like another.
        self._filter("snap_seen", "snap_filters", number, -number)
        row = self.spark.createDataFrame([(upto, last_add_at)], FOLD)
        self._write(row.coalesce(1), "folds", number)

    def fold(self, now: datetime) -> None:
        """Write what is still in date as the snapshot after the last committed batch."""
        state, last = self.load(END)
        if last is not None:
            self._fold(state, last.v, state.last_add_at, now)

    def reset(self) -> None:
        """Forget everything: batches after the last committed one start from nothing."""
        last = self.last_commit(END)
        if last is not None:
            self._fold(None, last.v, None, None)


def run_batch(
    folder: StateFolder,
    articles: DataFrame,
    v: int,
    now: datetime,
    embedder,
    results_path: str,
    reset: bool = False,
    stories: bool = False,
    **options,
) -> Outcome:
    """Deduplicate batch ``v`` against the state before it and record the next state.

    ``reset`` is a full run: it starts from nothing.  Without it the run refreshes.  With ``stories``
    new articles start stories and similar ones are appended to them, in the folder's log.
    """
    with small_broadcasts(folder.spark, articles.sparkSession):
        return _run_batch(folder, articles, v, now, embedder, results_path, reset, stories, **options)


def _run_batch(
    folder: StateFolder,
    articles: DataFrame,
    v: int,
    now: datetime,
    embedder,
    results_path: str,
    reset: bool,
    stories: bool,
    **options,
) -> Outcome:
    state, last = (State.empty(folder.spark, folder.vector_type), None) if reset else folder.load(v)
    fits = isinstance(embedder, TermEmbedder)
    if fits and embedder.model is None:
        embedder.model = folder.model()
    outcome = process(articles, state, now, embedder, **options)
    if fits:
        folder.keep_model(embedder.model)
    outcome.results.write.mode("overwrite").parquet(f"{results_path}/v={v}")
    if stories:
        folder.tell(articles, outcome.results, v)
    folder.advance(v, last, state, outcome, now)
    return outcome


def dedup_stream(
    stream: DataFrame,
    folder: StateFolder,
    embedder,
    results_path: str,
    checkpoint: str,
    clock,
    order_by: list[str],
    every: str | None = None,
    fold_every: int = FOLD_EVERY,
    **options,
):
    """Start the dedup stream.  ``every`` such as '5 minutes' keeps it running on that
    interval; without it the stream takes what has landed and stops.

    ``clock(batch_id)`` gives the batch its ``now``; ``order_by`` its processing order.
    The state is folded after every ``fold_every`` batches, so that a batch reads one
    snapshot and few partitions however long the stream has run.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        ordered = cut(
            batch.orderBy(*order_by).withColumn("seq", F.monotonically_increasing_id()), "batch"
        )
        if not ordered.isEmpty():
            run_batch(folder, ordered, batch_id, clock(batch_id), embedder, results_path, **options)
            if (batch_id + 1) % fold_every == 0:
                with small_broadcasts(folder.spark):
                    folder.fold(clock(batch_id))

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
