"""Run logs: repeat detection, outcome classes, replays and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as X
from ledgerline.operators import joins, ordered

# Logged results after which a run went on.
CONTINUED = ("recaptcha_checkbox_passed", "recaptcha_challenge_solved")
LOW_CONFIDENCE = 0.5


def repeats(steps: DataFrame, k: int = 3) -> DataFrame:
    """Flag steps that end k equal (action_taken, page_type) rows in a row.

    Here and below, steps numbered by ``ordered.ordinal`` may bring their ranges along.
    """
    same = ["action_taken", "page_type"]
    seen = ordered.previous_rows(steps, ["run_id"], ["step"], k - 1, same, "__prev")
    equal = F.forall(
        "__prev",
        lambda p: p["action_taken"].eqNullSafe(F.col("action_taken"))
        & p["page_type"].eqNullSafe(F.col("page_type")),
    )
    return seen.withColumn("repeats", (F.size("__prev") == k - 1) & equal).drop("__prev")


def stuck_points(steps: DataFrame, k: int = 3) -> DataFrame:
    """First step per run at which the last k steps had equal action and page type."""
    hits = repeats(steps, k).where("repeats")
    return hits.groupBy("run_id").agg(
        F.min("step").alias("stuck_step"),
        F.min_by("action_taken", "step").alias("action_taken"),
        F.min_by("page_type", "step").alias("page_type"),
    )


def with_history(steps: DataFrame, n: int = 3) -> DataFrame:
    """Add the last n steps before each step as text lines."""
    cols = ["step", "description", "action_taken", "confidence"]
    seen = ordered.previous_rows(steps, ["run_id"], ["step"], n, cols, "__prev")

    def text(name):
        return lambda p: F.coalesce(p[name].cast("string"), F.lit("?"))

    line = F.transform(
        "__prev",
        lambda p: F.concat(
            F.lit("  Step "),
            text("step")(p),
            F.lit(": "),
            text("description")(p),
            F.lit(" -> "),
            text("action_taken")(p),
            F.lit(" (conf: "),
            text("confidence")(p),
            F.lit(")"),
        ),
    )
    return seen.withColumn("history", F.array_join(line, "\n")).drop("__prev")


def _label(step: Column, repeated: Column) -> Column:
    """Why a step ends its run, or NULL when the run goes on."""
    action = step["action_taken"]
    went_on = F.coalesce(action.isin(*CONTINUED), F.lit(False))
    return (
        F.when(action == "done", "done")
        .when(repeated & ~went_on, "stuck")
        .when(
            (step["confidence"] < LOW_CONFIDENCE) & (step["tier"] == "heuristics"),
            "needs_guidance",
        )
        .when(action == "abort", "aborted")
    )


def classify_runs(
    steps: DataFrame,
    runs: DataFrame | None = None,
    max_steps: int = 10,
    k: int = 3,
) -> DataFrame:
    """One row per run: outcome, the step that ended it, and its label inputs.

    The smallest step with a terminal label decides. Without one the run is
    'max_steps' when it used them all, else 'in_progress'. ``runs`` (run_id,
    navigate_ok, fast_path_ok) adds the outcomes decided before the first step;
    its column ``max_steps``, where there is one, holds the limit of each run.

    Runs may have any number of steps: repeats are flagged in ranges, and the
    first label and last step of a run are aggregates with map-side partials.
    """
    label = _label({f: F.col(f) for f in ("action_taken", "tier", "confidence")}, F.col("repeats"))
    fields = ["step", "label", "page_type", "action_taken"]
    per_run = (
        repeats(steps, k)
        .withColumn("label", label)
        .groupBy("run_id")
        .agg(
            F.min(F.when(F.col("label").isNotNull(), F.struct(*fields))).alias("__end"),
            F.max("step").alias("__last"),
        )
    )
    limit = F.lit(max_steps)
    if runs is not None and "max_steps" in runs.columns:
        limit = F.coalesce("max_steps", limit)
    outcome = F.coalesce(
        F.col("__end.label"), F.when(F.col("__last") >= limit, "max_steps").otherwise("in_progress")
    )
    early = F.lit(None).cast("string")
    if runs is not None:
        per_run = runs.join(per_run, "run_id", "left")
        early = F.when(~F.col("navigate_ok"), "navigate_failed").when(
            F.col("fast_path_ok"), "fast_path"
        )
    from_steps = early.isNull()
    return per_run.select(
        "run_id",
        F.coalesce(early, outcome).alias("outcome"),
        F.when(from_steps, F.coalesce("__end.step", "__last")).alias("end_step"),
        F.when(from_steps, F.col("__end.page_type")).alias("page_type"),
        F.when(from_steps, F.col("__end.action_taken")).alias("action_taken"),
    )


def replay_summary(recipes: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome of each logged replay.

    ``recipes``: (run_id, total_steps). ``results``: (run_id, step from 0, ok,
    cause, reason). A URL mismatch counts its own step as completed; a missing
    selector or an error does not. An empty recipe fails with no index.
    """
    failed = F.when(~F.col("ok"), F.col("step"))
    first = results.groupBy("run_id").agg(
        F.min(failed).alias("failed_at"),
        F.min_by("cause", failed).alias("__cause"),
        F.min_by("reason", failed).alias("__reason"),
    )
    empty = F.coalesce(F.col("total_steps"), F.lit(0)) == 0
    at = F.when(~empty, F.col("failed_at"))
    return recipes.join(first, "run_id", "left").select(
        "run_id",
        (~empty & at.isNull()).alias("success"),
        F.when(empty, 0)
        .when(at.isNull(), F.col("total_steps"))
        .when(F.col("__cause") == "url_mismatch", at + 1)
        .otherwise(at)
        .cast("bigint")
        .alias("steps_completed"),
        F.coalesce("total_steps", F.lit(0)).cast("bigint").alias("total_steps"),
        at.cast("bigint").alias("failed_at"),
        F.when(empty, "No steps in recipe")
        .when(at.isNull(), "")
        .otherwise(F.col("__reason"))
        .alias("reason"),
    )


def _signature(df: DataFrame) -> DataFrame:
    target = F.coalesce(
        F.nullif(F.col("selector"), F.lit("")), F.nullif(F.col("url"), F.lit("")), F.lit("")
    )
    return df.withColumn("__target", target)


def flag_steps(playbook: DataFrame, log: DataFrame) -> DataFrame:
    """Add ``backed``: the log of the same run has the same action on the same target.

    The target is the selector, or the URL where there is no selector.
    """
    keys = ["run_id", "action", "__target"]
    return joins.flag_known(_signature(playbook), _signature(log), keys, "backed").select(
        *playbook.columns, "backed"
    )


def verify_steps(playbook: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps backed by the run's log, steps that are not)."""
    flagged = flag_steps(playbook, log)
    return flagged.where("backed").drop("backed"), flagged.where(~F.col("backed")).drop("backed")


def verify_caveats(caveats: DataFrame, log: DataFrame) -> DataFrame:
    """Caveats of runs whose log has a failure (``ok`` false)."""
    return caveats.join(log.where(~F.col("ok")).select("run_id").distinct(), "run_id", "left_semi")


def audit_checkpoints(steps: DataFrame, observed: DataFrame) -> DataFrame:
    """First step per run whose page domain differs from the expected one.

    Steps without an expected URL are skipped, and so are steps with no
    observation: the check is best effort.
    """
    expected = X.extract_domain("expected_url")
    actual = X.extract_domain("url")
    checked = (
        steps.join(observed.select("run_id", "step", "url"), ["run_id", "step"], "left")
        .withColumns({"expected_domain": expected, "observed_domain": actual})
        .withColumn(
            "__bad",
            F.when(
                (F.col("expected_domain") != "")
                & F.col("url").isNotNull()
                & (F.col("expected_domain") != F.col("observed_domain")),
                F.col("step"),
            ),
        )
    )
    return checked.groupBy("run_id").agg(
        F.min("__bad").alias("failed_step"),
        F.min_by("expected_domain", "__bad").alias("expected_domain"),
        F.min_by("observed_domain", "__bad").alias("observed_domain"),
        F.count(F.when(F.col("expected_domain") != "", 1)).alias("checkpoints"),
    )
