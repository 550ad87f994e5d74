"""The sequential operators over streams: the same steps as in batch, with their state in the state store.

Rows of a micro-batch are sorted within each key before they are stepped through; the sources deliver in order of
arrival, as the reference model asks: a gap is a new epoch, not late data. A key's state is a pickled value of bounded size
(a few tracks, or a few numbers).
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..kernels import track
from ..kernels.recursions import rate_step, sample_step
from ..model import RateConfig, TrackerConfig
from ..operators.acoustics import track_rows, track_schema

_STATE = "state binary"


def _stepped(df: DataFrame, key: str, schema: str, step: Callable, start: Callable, freeze: Callable = lambda s: s, thaw: Callable = lambda s: s) -> DataFrame:
    """step(state, rows) -> (state, list of dicts); start() -> the state of a new key; freeze and thaw: from and to a state of plain values."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(_key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = thaw(pickle.loads(held.get[0])) if held.exists else start()
        rows = pd.concat(list(batches), ignore_index=True)
        state, out = step(state, rows)
        held.update((pickle.dumps(freeze(state)),))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def tracks(decisions: DataFrame, key: str = "session", cfg: TrackerConfig = TrackerConfig()) -> DataFrame:  # noqa: B008
    """As operators.acoustics.tracks, over a stream."""

    def step(state, rows):
        return state, track_rows(state, rows, key, cfg)

    return _stepped(decisions, key, track_schema(key), step, track.Stream, track.frozen, track.thawed)


def adaptive_rate(timings: DataFrame, key: str, order: str, slowest: str, cfg: RateConfig = RateConfig()) -> DataFrame:  # noqa: B008
    """key, order and period_ms after each computed window."""

    def step(state, rows):
        out = []
        for r in rows.sort_values(order).itertuples():
            state = rate_step(state, 0.0, getattr(r, slowest), cfg)
            out.append({key: getattr(r, key), order: getattr(r, order), "period_ms": state[0]})
        return state, out

    return _stepped(timings, key, f"{key} long, {order} long, period_ms long", step, lambda: None)


def sampled(points: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """key and at of the points that lie at least gap after the last one kept."""

    def step(anchor, rows):
        out = []
        for x in sorted(rows[at]):
            anchor, kept = sample_step(anchor, int(x), gap)
            out += [{key: rows[key].iloc[0], at: x}] if kept else []
        return anchor, out

    return _stepped(points, key, f"{key} long, {at} long", step, lambda: None)


def deduplicated(events: DataFrame, key: str, at: str, horizon: str) -> DataFrame:
    """The first of each event id; ids are forgotten after the horizon."""
    return events.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])


def read_blocks(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder that blocks arrive in; the rate limit takes the place of a bounded hand-off queue."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _property(spark: SparkSession, view: str, name: str) -> str | None:
    if not spark.catalog.tableExists(view):
        return None
    found = [r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {view}").collect() if r["key"] == name]
    return found[0] if found else None


def publish_latest(stream: DataFrame, session: str, order: str, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest row of each session in a view of the catalog.

    A micro-batch writes a new version, under a name of its own, from the version in use, and then switches the view to it in one
    step, which also records the query and the batch: readers see the one or the other as a whole, and a batch that is run again
    after the switch changes nothing. The version before stays readable; older ones, and those that an attempt left behind, go.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        done, used = _property(spark, table, "latest.batch"), _property(spark, table, "latest.version")
        if done and done.rsplit(":", 1)[0] == query and int(done.rsplit(":", 1)[1]) >= number:
            return
        newest = batch.groupBy(session).agg(F.max_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
        if used:
            newest = spark.table(used).unionByName(newest).groupBy(session).agg(F.max_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
        own = f"{table}_v{number}_{uuid.uuid4().hex[:12]}"
        newest.write.saveAsTable(own)
        spark.sql(f"CREATE OR REPLACE VIEW {table} TBLPROPERTIES ('latest.batch' = '{query}:{number}', 'latest.version' = '{own}') AS SELECT * FROM {own}")
        short, base = own.split(".")[-1], table.split(".")
        for t in spark.catalog.listTables(*base[:-1], pattern=f"{base[-1]}_v*"):
            if t.name not in (short, (used or "").split(".")[-1]):
                spark.sql(f"DROP TABLE IF EXISTS {'.'.join([*base[:-1], t.name])}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fanout(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, capacity: dict[str, int] | None = None, order: str | None = None) -> StreamingQuery:
    """Each micro-batch to several sinks, read once. A sink with a capacity gets the newest so many rows of a batch by order, and loses the oldest."""
    capacity = capacity or {}
    if capacity and order is None:
        raise ValueError("a capacity needs an order")

    def publish(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                own = batch.orderBy(F.desc(order)).limit(capacity[name]) if name in capacity else batch
                sink(own, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_track_log(rows: DataFrame, path: str) -> None:
    """A small report, one line per track by id: track_id, duration and trajectory; replaced as a whole. rows is bounded by the log's own limits."""
    lines = ["track_id\tduration_s\ttrajectory"]
    for r in rows.orderBy("track_id").collect():
        lines.append(f"{r['track_id']}\t{r['duration_s']:.3f}\t" + ",".join(f"{s}:{d:.1f}" for s, d in r["trajectory"]))
    new = Path(f"{path}.new")
    new.write_text("\n".join(lines) + "\n")
    new.replace(path)
