"""Live operators: the batch operators, advanced by micro-batches over a bounded state.

Each operator keeps what later rows can depend on (the newest n rows of a key, a run's last k - 1 steps, one recipe
and its failed runs) in a ``BucketedState`` and treats a micro-batch with the operators that work on whole tables,
so a key with a large share of a batch is spread as it is there, and no key's rows are gathered in a worker. The
size of a micro-batch is the source's limit (``maxFilesPerTrigger``, ``maxBytesPerTrigger``). A batch that is repeated
after a failure changes nothing.

Rows of a key may come in any order within a micro-batch. Rows older than what a key has already seen cannot be
replayed: order-dependent operators put them aside as ``late`` rows, which have readers of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.functions import scalars as X
from ledgerline.operators import confidence, log, runs
from ledgerline.streaming import state as S

ACTIONS = "id bigint, persona string, action string, detail string, ts timestamp"
STEPS = "run_id bigint, step bigint, action_taken string, page_type string"
OUTCOMES = "id bigint, domain string, action string, run_id bigint, outcome string, ts timestamp"
MILESTONES = "id bigint, persona string, event string, ts timestamp"
_RUNS = "run_id bigint, last bigint, fired boolean, tail array<struct<step:bigint,action_taken:string,page_type:string>>, seen timestamp"
_RECIPES = (
    "domain string, action string, run_id bigint, confidence int, created timestamp, last_verified timestamp, "
    "last_failed timestamp, ts timestamp, id bigint, last timestamp"
)
_SPLIT = f"late boolean, {MILESTONES}"

DAY_MS = 24 * 3_600 * 1_000
BUCKETS = 64


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


# --- recent actions ---


def _recent(path: str, buckets: int) -> S.BucketedState:
    return S.BucketedState(f"{path}/rows", ACTIONS, ["persona"], buckets)


def live_recent(
    actions: DataFrame, path: str, n: int = 20, once: bool = False, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep the newest n actions per persona; read them with ``recent_actions``.

    No order of arrival is needed; a row without a time is older than all others. Personas without a name are one.
    """
    names = _names(ACTIONS)

    def advance(fresh: DataFrame, batch: int) -> None:
        newest = log.recent_n(fresh, n=n)
        _recent(path, buckets).advance(batch, fresh, lambda base: log.recent_n(base.unionByName(newest), n=n).select(*names))

    return S.start(actions.select(*names), path, once, "live_recent", advance)


def recent_actions(spark: SparkSession, path: str, n: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """The newest n actions of every persona that the stream has seen."""
    return log.recent_n(_recent(path, buckets).read(spark), n=n)


# --- stuck runs ---


def live_stuck(
    steps: DataFrame, path: str, k: int = 3, once: bool = False, idle_ms: int = DAY_MS, buckets: int = BUCKETS
) -> StreamingQuery:
    """Write one alert per run when its last k steps first are equal; read them with ``stuck_alerts``.

    The state is a run's last k - 1 steps and whether it was reported; it goes when the run had no rows for
    ``idle_ms`` by the time one of its bucket comes. Steps at or below the newest step of earlier micro-batches are
    late. Rows without a run or a step are left out.
    """
    names = _names(STEPS)
    held = S.BucketedState(f"{path}/state", _RUNS, ["run_id"], buckets)

    def advance(fresh: DataFrame, batch: int) -> None:
        def fold(base: DataFrame) -> DataFrame:
            now = F.current_timestamp()
            alive = base.where(F.col("seen") >= now - F.make_dt_interval(secs=F.lit(idle_ms / 1_000)))
            placed = fresh.join(alive.select("run_id", "last"), "run_id", "left")
            late = F.coalesce(F.col("step") <= F.col("last"), F.lit(False))
            before = alive.select("run_id", F.explode("tail").alias("t")).select("run_id", "t.*")
            both = placed.where(~late).select(*names).unionByName(before)
            one = F.struct("step", "action_taken", "page_type")
            newest = log.newest(both, ["run_id"], ["step"], max(1, k - 1))
            tails = newest.groupBy("run_id").agg(
                F.max("step").alias("last"),
                F.slice(F.sort_array(F.collect_list(one)), 1, k - 1).alias("tail"),  # k - 1 rows at most
            )
            found = runs.stuck_points(both, k)
            known = alive.select("run_id", F.col("last").alias("__last"), F.col("fired").alias("__fired"), "seen")
            summary = tails.join(known, "run_id", "left").join(found, "run_id", "left").persist()
            used.append(summary)
            told = summary.where("stuck_step IS NOT NULL AND NOT coalesce(__fired, false)")
            alerts = told.select(F.lit(False).alias("late"), "run_id", F.col("stuck_step").alias("step"), "action_taken", "page_type")
            aside = placed.where(late).select(F.lit(True).alias("late"), *names)
            S.record(alerts.unionByName(aside), batch, f"{path}/rows")
            moved = F.coalesce(F.col("last") > F.col("__last"), F.lit(True))
            return summary.select(
                "run_id", "last", F.coalesce(F.col("__fired") | F.col("stuck_step").isNotNull(), F.col("stuck_step").isNotNull()).alias("fired"),
                "tail", F.when(moved, now).otherwise(F.col("seen")).alias("seen"),
            )

        used: list[DataFrame] = []
        held.advance(batch, fresh, fold)
        for frame in used:
            frame.unpersist()

    rows = steps.select(*names).where("run_id IS NOT NULL AND step IS NOT NULL")
    return S.start(rows, path, once, "live_stuck", advance)


_FOUND = f"late boolean, {STEPS}"


def stuck_alerts(spark: SparkSession, path: str) -> DataFrame:
    found = S.recorded(spark, f"{path}/rows", _FOUND).where("NOT late")
    return found.select("run_id", F.col("step").alias("stuck_step"), "action_taken", "page_type")


def late_steps(spark: SparkSession, path: str) -> DataFrame:
    return S.recorded(spark, f"{path}/rows", _FOUND).where("late").drop("late")


# --- confidence ---


def _held_recipes(path: str, buckets: int) -> S.BucketedState:
    return S.BucketedState(f"{path}/state", _RECIPES, confidence.KEYS, buckets)


def live_confidence(
    outcomes: DataFrame, path: str, once: bool = False, run_ms: int = 7 * DAY_MS, buckets: int = BUCKETS
) -> StreamingQuery:
    """Advance the state of each recipe; read it with ``current_confidence``.

    The state is the recipe, the place of its newest event, and the runs whose fast path failed: a later success of
    such a run does not count. A failed run is forgotten when its own last event is ``run_ms`` older than the
    recipe's newest one. Events before the newest one of earlier micro-batches are late. Rows without a time or an id
    are left out.
    """
    names, keys, run = _names(OUTCOMES), confidence.KEYS, confidence.RUN

    def advance(fresh: DataFrame, batch: int) -> None:
        def fold(base: DataFrame) -> DataFrame:
            recipes, failed = base.where("run_id IS NULL"), base.where("run_id IS NOT NULL")
            newest = recipes.select(*keys, F.struct("ts", "id").alias("__newest"))
            placed = keep(fresh.join(newest, keys, "left"))
            late = F.coalesce(F.struct("ts", "id") < F.col("__newest"), F.lit(False))
            S.record(placed.where(late).select(*names), batch, f"{path}/late")
            timely = placed.where(~late).select(*names)

            marked = keep(confidence.with_failed(timely, failed))
            counted = confidence.effective_outcomes(marked)
            after = confidence.replay_state(counted, recipes.where("confidence IS NOT NULL")).drop("tier")
            moved = timely.groupBy(*keys).agg(F.max(F.struct("ts", "id")).alias("__at")).select(*keys, "__at.*")
            changed = counted.select(*keys).distinct().withColumn("__changed", F.lit(True))
            stored = ["confidence", "created", "last_verified", "last_failed"]
            before = recipes.select(*keys, *[F.col(c).alias(f"__{c}") for c in stored])
            states = moved.join(after, keys, "left").join(changed, keys, "left").join(before, keys, "left")
            fresh_recipes = keep(states.select(
                *keys, "ts", "id", *[F.when(F.col("__changed"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in stored]
            ))
            resting = recipes.join(moved.select(*keys), keys, "left_anti")

            # A failed run's rows bring their place of failure along; runs without rows in this batch keep theirs.
            met = marked.where("__failed IS NOT NULL").select(*run, "__failed", F.col("ts").alias("last"))
            known = failed.select(*run, F.struct("ts", "id").alias("__failed"), "last")
            kept_runs = met.unionByName(known).groupBy(*run).agg(F.min("__failed").alias("__first"), F.max("last").alias("last"))
            tops = fresh_recipes.unionByName(resting, allowMissingColumns=True).select(*keys, F.col("ts").alias("__top"))
            kept = kept_runs.join(tops, keys, "left").where(
                F.coalesce(F.col("last") >= F.col("__top") - F.make_dt_interval(secs=F.lit(run_ms / 1_000)), F.lit(True))
            )
            return (
                fresh_recipes.unionByName(resting, allowMissingColumns=True)
                .unionByName(kept.select(*run, "__first.*", "last"), allowMissingColumns=True)
                .select(*_names(_RECIPES))
            )

        used: list[DataFrame] = []  # what several steps read is worked out once
        keep = lambda df: used.append(df.persist()) or used[-1]
        _held_recipes(path, buckets).advance(batch, fresh, fold)
        for frame in used:
            frame.unpersist()

    rows = outcomes.select(*names).where("ts IS NOT NULL AND id IS NOT NULL")
    return S.start(rows, path, once, "live_confidence", advance)


def current_confidence(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Recipes that exist, with their state."""
    known = _held_recipes(path, buckets).read(spark).where("run_id IS NULL AND confidence IS NOT NULL")
    names = ["confidence", "created", "last_verified", "last_failed"]
    return known.select(*confidence.KEYS, *names, X.confidence_tier("confidence").alias("tier"))


def late_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return S.recorded(spark, f"{path}/late", OUTCOMES)


# --- late milestones ---


def live_milestones(
    milestones: DataFrame, path: str, delay_seconds: int = 3_600, once: bool = False
) -> StreamingQuery:
    """Mark arrivals before the watermark as late; ``all_milestones`` folds them in at their event time.

    The watermark is the newest time of earlier micro-batches less the delay, as Spark's own is; a stateful operator
    of Spark would drop such rows. Every batch records its newest time in one row. Rows without a time are not late.
    """
    names = _names(MILESTONES)

    def advance(fresh: DataFrame, batch: int) -> None:
        spark = fresh.sparkSession
        S.record(fresh.agg(F.max("ts").alias("newest")), batch, f"{path}/marks")
        marks = spark.read.schema(f"newest timestamp, {S.BATCH} bigint").parquet(f"{path}/marks")
        newest = marks.where(F.col(S.BATCH) < batch).agg(F.max("newest")).first()[0]
        mark = F.lit(newest).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay_seconds))
        late = F.coalesce(F.col("ts") < mark, F.lit(False)).alias("late")
        S.record(fresh.select(late, *names), batch, f"{path}/rows")

    return S.start(milestones.select(*names), path, once, "live_milestones", advance)


def late_milestones(spark: SparkSession, path: str) -> DataFrame:
    return S.recorded(spark, f"{path}/rows", _SPLIT).where("late").drop("late")


def all_milestones(spark: SparkSession, path: str) -> DataFrame:
    """Live and late rows together, ordered by event time per persona."""
    return S.recorded(spark, f"{path}/rows", _SPLIT).drop("late").orderBy("persona", "ts", "id")


def marked_milestones(spark: SparkSession, path: str) -> DataFrame:
    """All rows, with whether they came late."""
    return S.recorded(spark, f"{path}/rows", _SPLIT)
