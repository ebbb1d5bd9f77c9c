"""Watching folders: events of files, the last of each path in a step, and indexing what they name.

Structured Streaming reads the events; each micro-batch keeps one event per path and hands it to an action. Paths are
spread over the batch's partitions by one combined aggregation, so a busy path costs one row per task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslens import schema

#: Fixed value: how long events gather before they are acted on.
STEP = "2 seconds"
EVENTS = "path string, dest_path string, event_type string, is_directory boolean, seq long"


def relevant(events: DataFrame) -> DataFrame:
    """Events of files of a known kind. A move is a deletion of its source and a creation of its destination."""
    one = events.filter(~F.coalesce("is_directory", F.lit(False)))
    moved = F.array(
        F.struct(F.col("path").alias("path"), F.lit("deleted").alias("event_type")), F.struct(F.col("dest_path").alias("path"), F.lit("created").alias("event_type"))
    )
    same = F.array(F.struct("path", "event_type"))
    rest = [c for c in events.columns if c not in ("path", "dest_path", "event_type", "is_directory")]
    each = one.select(*rest, F.explode(F.when(F.col("event_type") == "moved", moved).otherwise(same)).alias("e")).select(*rest, "e.*")
    return each.filter(F.col("path").isNotNull() & schema.kind_of(F.col("path")).isNotNull())


def last_events(events: DataFrame, by: tuple[str, ...] = ("path",), order: str = "seq") -> DataFrame:
    """The last event of each path, and how many there were."""
    return events.groupBy(*by).agg(F.max_by("event_type", order).alias("event_type"), F.count("*").alias("events"))


def by_step(events: DataFrame, time: str = "ts", step: str = STEP) -> DataFrame:
    """The last event of each path in each step of event time; the batch form of what a watch does."""
    window = F.window(F.col(time).cast("timestamp"), step)["start"].alias("step")
    return events.groupBy("path", window).agg(F.max_by("event_type", F.struct(time, "seq")).alias("event_type"), F.count("*").alias("events"))


def watch(
    events: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, name: str, step: str | None = STEP, once: bool = False
) -> StreamingQuery:
    """Starts a watch over a stream of EVENTS. ``action`` gets (path, event_type, events) of each step. ``once`` works off what
    there is and stops."""

    def act(batch: DataFrame, number: int) -> None:
        action(last_events(relevant(batch)), number)

    writer = events.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=step)).start()


#: A step that fails is halved so often at most; what is left of it then fails together.
HALVINGS = 20


def in_halves(batch: DataFrame, work: Callable[[DataFrame], None], done: Callable[[int], None], failed: Callable[[str, Exception], None], depth: int = 0) -> None:
    """Works off a step's paths; if that fails, each half of them by itself (by bits of the path's hash), down to single paths. Good paths
    are worked off again with each half, which a change of the store allows: it has the same result. ``done`` hears how many were."""
    try:
        n = batch.count()
        if n:
            work(batch)
            done(n)
        return
    except Exception as e:  # noqa: BLE001
        first = batch.first()
        if batch.limit(2).count() < 2 or depth >= HALVINGS:
            return failed(first.path, e)
    for bit in (0, 1):
        in_halves(batch.filter(F.getbit(F.xxhash64("path"), F.lit(depth)) == bit), work, done, failed, depth + 1)


class Watches:
    """The running watches of a session, one for each workspace."""

    def __init__(self, spark: SparkSession):
        self.spark, self.queries, self.done = spark, {}, {}

    def count(self, workspace_id: str, paths: int) -> None:
        """Adds paths that a watch has worked off."""
        self.done[workspace_id] = self.done.get(workspace_id, 0) + paths

    def start(self, workspace_id: str, make: Callable[[], StreamingQuery]) -> StreamingQuery:
        """The workspace's watch, which ``make`` starts if it has none."""
        query = self.queries.get(workspace_id)
        if query is None or not query.isActive:
            query = self.queries[workspace_id] = make()
        return query

    def stop(self, workspace_id: str) -> bool:
        query = self.queries.pop(workspace_id, None)
        if query is not None:
            query.stop()
        return query is not None

    def stop_all(self) -> None:
        for workspace_id in list(self.queries):
            self.stop(workspace_id)

    def list(self) -> list[dict]:
        return [{"workspace_id": w, "active": q.isActive, "events_processed": self.done.get(w, 0)} for w, q in self.queries.items()]
