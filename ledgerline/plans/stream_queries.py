"""The live operators run over the event log, which arrives in several micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.plans import derived as D
from ledgerline.plans import inputs as I
from ledgerline.plans.registry import query
from ledgerline.plans.run_queries import _LAGS, _REPEATS, _SHOWN, _TRACE
from ledgerline.streaming import live
from ledgerline.streaming.folders import work_folder


PARTS = 2
PART_ROWS = 1_000_000
ROW_GROUP_BYTES = 2 << 20  # a span is one file, which several tasks read
BUCKETS = 8


def _part(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Events with the number of the span of time they fall into, and how many spans there are.

    Spans follow the number of events, so that none grows with the table. Events without a time are in the first.
    """
    events = I.source(spark, d, "events")
    n, low, high = events.agg(F.count(F.lit(1)), F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    parts = max(PARTS, -(-n // PART_ROWS))
    place = F.expr(f"(unix_micros(ts) - {low or 0}) * {parts} div {(high or 0) - (low or 0) + 1}")
    return events.withColumn("__part", F.coalesce(place, F.lit(0))), parts


def _arrivals(
    spark: SparkSession, d: str, path: str, start: Callable[[DataFrame], StreamingQuery], slow: int | None = None
) -> None:
    """Let all events arrive, one file per span of time, one file per micro-batch.

    After the first file the query stops and is started again from its checkpoint, so state is stored and read
    back. Every ``slow``-th event arrives a span after its time. The events are dealt to their spans once, so that a
    span reads its own rows and not the whole table.
    """
    events, parts = _part(spark, d)
    if slow:
        behind = (F.col("event_id") % slow == 0).cast("long")
        events, parts = events.withColumn("__part", F.col("__part") + behind), parts + 1
    arrived, dealt = f"{path}/arrived", f"{path}/dealt"
    # Four tasks and files to a span, so that few spans do not mean few tasks.
    spread = F.pmod(F.xxhash64("event_id"), F.lit(4))
    events.repartition(parts * 4, "__part", spread).write.partitionBy("__part").parquet(dealt)
    spans = spark.read.schema(f"{I.SOURCES['events']}, __part int").parquet(dealt)

    def run() -> None:
        stream = spark.readStream.schema(I.SOURCES["events"]).option("maxFilesPerTrigger", 1)
        start(stream.parquet(arrived)).awaitTermination()

    for part in range(parts):
        arriving = spans.where(F.col("__part") == part).drop("__part").coalesce(1)
        arriving.write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).parquet(arrived)
        if part == 0:
            run()
    run()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid4().hex}"


@query(
    "live_recent_actions",
    f"""WITH {D.ACTIONS} SELECT * FROM actions
    QUALIFY row_number() OVER (PARTITION BY persona ORDER BY ts DESC, id DESC) <= 20""",
)
def _(spark, d):
    path = _folder(spark, "recent")
    _arrivals(spark, d, path, lambda events: live.live_recent(I.as_actions(events), path, once=True, buckets=BUCKETS))
    return live.recent_actions(spark, path, buckets=BUCKETS)


@query(
    "live_stuck_alerts",
    f"""WITH {D.steps('user_id')}, s AS (SELECT * REPLACE (event_id AS step) FROM steps), l AS (
      SELECT *, {_LAGS} FROM s WINDOW w AS (PARTITION BY run_id ORDER BY step))
    SELECT run_id, min(step) AS stuck_step, arg_min(action_taken, step) AS action_taken,
      arg_min(page_type, step) AS page_type FROM l WHERE {_REPEATS} GROUP BY run_id""",
)
def _(spark, d):
    path = _folder(spark, "stuck")
    # Event ids grow with time, so they number the steps of a run.
    def start(events):
        steps = I.as_steps(events, F.col("user_id")).withColumn("step", F.col("event_id"))
        return live.live_stuck(steps, path, once=True, buckets=BUCKETS)

    _arrivals(spark, d, path, start)
    return live.stuck_alerts(spark, path)


_FROM_NOTHING = _TRACE.replace("FROM customer)", "FROM customer WHERE false)")


@query(
    "live_confidence",
    f"""{_FROM_NOTHING}, last AS (
      SELECT * FROM trace QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) = 1)
    SELECT domain, {_SHOWN} FROM last WHERE confidence IS NOT NULL""",
)
def _(spark, d):
    path = _folder(spark, "confidence")
    _arrivals(spark, d, path, lambda events: live.live_confidence(I.as_outcomes(events), path, once=True, buckets=BUCKETS))
    never = F.lit(datetime(1970, 1, 1))
    return live.current_confidence(spark, path, buckets=BUCKETS).select(
        "domain",
        "confidence",
        *[F.coalesce(c, never).alias(c) for c in ("created", "last_verified", "last_failed")],
    )


_DELAY = 86_400


@query(
    "live_milestones",
    f"""WITH {D.MILESTONES}, ends AS (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high, count(*) AS n FROM events),
    sized AS (SELECT *, greatest({PARTS}, ceil(n / {PART_ROWS}))::BIGINT AS parts FROM ends),
    placed AS (SELECT event_id, ts, coalesce((epoch_us(ts) - low) * parts // (high - low + 1), 0)
      + (event_id % 5 = 0)::INT AS part FROM events, sized),
    tops AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
      FROM placed GROUP BY part)
    SELECT id, persona, event, milestones.ts, coalesce(milestones.ts < newest - INTERVAL {_DELAY} SECOND, false) AS late
    FROM milestones JOIN placed ON event_id = id JOIN tops USING (part)""",
)
def _(spark, d):
    path = _folder(spark, "milestones")

    def start(events):
        return live.live_milestones(I.as_milestones(events), path, _DELAY, once=True)

    _arrivals(spark, d, path, start, slow=5)
    return live.marked_milestones(spark, path)
