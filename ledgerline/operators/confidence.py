"""Recipe confidence replayed from ordered outcomes.

Outcomes per (domain, action): save and fast_fail set the confidence to 1, a
success adds 1 up to 10, delete removes the recipe. Outcomes of a recipe that
does not exist change nothing. The value after any event is
``min(10, start + successes since the last reset)``, so it needs running counts
only, never the list of a key's events.
"""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as X
from ledgerline.operators import ordered

KEYS = ["domain", "action"]
ORDER = ["ts", "id"]
MAX_CONFIDENCE = 10
# Marks the stored state among a key's events.
START = "__start"


RUN = [*KEYS, "run_id"]


def failed_runs(outcomes: DataFrame) -> DataFrame:
    """First fast-path failure of each run: (domain, action, run_id, ts, id)."""
    first = F.min(F.struct(*ORDER)).alias("__first")
    failures = outcomes.where((F.col("outcome") == "fast_fail") & F.col("run_id").isNotNull())
    return failures.groupBy(*RUN).agg(first).select(*RUN, "__first.*")


def with_failed(outcomes: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Add ``__failed``: place (ts, id) of the first fast-path failure of a row's run, NULL without one.

    ``earlier`` are failed runs known from before this batch.
    """
    failures = failed_runs(outcomes)
    if earlier is not None:
        failures = failures.unionByName(earlier.select(*RUN, *ORDER))
    failed = failures.groupBy(*RUN).agg(F.min(F.struct(*ORDER)).alias("__failed"))
    return outcomes.join(failed, RUN, "left")


def effective_outcomes(outcomes: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Drop successes that follow a fast-path failure within the same run.

    Such a run read its confidence before the failure, so its later finish is
    not counted. Rows without a run are always kept. ``earlier`` are failed runs
    known from before this batch. Rows that ``with_failed`` has marked are taken as marked.
    """
    marked = outcomes if "__failed" in outcomes.columns else with_failed(outcomes, earlier)
    late = (F.col("outcome") == "success") & (F.struct(*ORDER) > F.col("__failed"))
    return marked.where(~F.coalesce(late, F.lit(False))).drop("__failed")


def _is(outcome: str) -> Column:
    return F.col("outcome") == outcome


def _seen(column: str, window) -> Column:
    return F.max(column).over(ordered.before(window))


def _total_before(window, column: str) -> Column:
    return F.coalesce(F.sum(column).over(ordered.before(window)), F.lit(0))


def replay_confidence(
    outcomes: DataFrame,
    base: DataFrame | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """State after every event: confidence, tier, created, last_verified, last_failed.

    ``base`` holds stored recipes (domain, action, confidence, created,
    last_verified, last_failed) from before the first event. State columns are
    NULL while the recipe does not exist. ``sized_by`` is a table with the same
    keys, ``ts`` and ``id`` that is cheaper to read than ``outcomes``, such as the unfiltered log.
    """
    stored = ["confidence", "created", "last_verified", "last_failed"]
    held = [f"__b_{c}" for c in stored]
    kinds = ["int", "timestamp", "timestamp", "timestamp"]
    events = outcomes.withColumns({h: F.lit(None).cast(k) for h, k in zip(held, kinds)})
    if base is not None:
        # The stored state enters as one row before the first event of its key,
        # so it needs no join with the events.
        start = base.select(
            *KEYS,
            F.lit(START).alias("outcome"),
            F.lit(datetime(1, 1, 2)).alias("ts"),
            *[F.col(c).cast(k).alias(h) for c, h, k in zip(stored, held, kinds)],
        )
        events = events.unionByName(start, allowMissingColumns=True)
    ranged = ordered.chunked(events, KEYS, ORDER, outcomes if sized_by is None else sized_by)
    w = ordered.so_far(ranged, KEYS, ORDER)
    step = (
        ranged.withColumns(
            {
                "__reset": _is("save") | _is("fast_fail"),
                "__n_success": F.count(F.when(_is("success"), 1)).over(w),
                "__n_save": F.count(F.when(_is("save"), 1)).over(w),
                "__verified": F.max(F.when(_is("save") | _is("success"), F.col("ts"))).over(w),
                **{h: F.max(h).over(w) for h in held},
            }
        )
        # The counts never fall, so the highest count seen at a reset is the
        # count at the latest reset.
        .withColumns(
            {
                "__at_reset": F.max(F.when(F.col("__reset"), F.col("__n_success"))).over(w),
                "__at_delete": F.max(F.when(_is("delete"), F.col("__n_save"))).over(w),
            }
        )
    )
    step = ordered.carry(
        step,
        KEYS,
        {
            "__s_success": F.max("__n_success"),
            "__s_save": F.max("__n_save"),
            "__s_reset": F.max("__at_reset"),
            "__s_delete": F.max("__at_delete"),
            "__s_verified": F.max("__verified"),
            **{f"__s{h}": F.max(h) for h in held},
        },
        {
            "__o_success": lambda o: F.sum("__s_success").over(ordered.before(o)),
            "__o_save": lambda o: F.sum("__s_save").over(ordered.before(o)),
            "__o_verified": lambda o: F.max("__s_verified").over(ordered.before(o)),
            "__o_reset": lambda o: F.max("__g_reset").over(ordered.before(o)),
            "__o_delete": lambda o: F.max("__g_delete").over(ordered.before(o)),
            **{f"__o{h}": partial(_seen, f"__s{h}") for h in held},
        },
        {
            "__g_reset": lambda o: F.col("__s_reset") + _total_before(o, "__s_success"),
            "__g_delete": lambda o: F.col("__s_delete") + _total_before(o, "__s_save"),
        },
    )
    zero = F.lit(0).cast("bigint")
    off_success = F.coalesce("__o_success", zero)
    off_save = F.coalesce("__o_save", zero)
    step = step.withColumns(
        {
            "__n_success": F.col("__n_success") + off_success,
            "__n_save": F.col("__n_save") + off_save,
            "__at_reset": F.coalesce(F.col("__at_reset") + off_success, F.col("__o_reset")),
            "__at_delete": F.coalesce(F.col("__at_delete") + off_save, F.col("__o_delete")),
            "__verified": F.greatest("__verified", "__o_verified"),
            **{h: F.coalesce(h, f"__o{h}") for h in held},
        }
    )
    # Saves since the latest delete; the base row counts until the first delete.
    saves = F.col("__n_save") - F.coalesce("__at_delete", zero)
    from_base = F.col("__at_delete").isNull() & F.col("__b_confidence").isNotNull()
    step = step.withColumns(
        {
            "__exists": ~_is("delete") & ((saves > 0) | from_base),
            "__create": _is("save") & (saves == 1) & ~from_base,
            "__from_base": from_base,
        }
    )
    at = F.struct(*ORDER)
    step = step.withColumns(
        {
            "__created": F.max(F.when(F.col("__create"), at)).over(w),
            "__failed": F.max(F.when(F.col("__exists") & _is("fast_fail"), at)).over(w),
        }
    )
    step = ordered.carry(
        step,
        KEYS,
        {"__s_created": F.max("__created"), "__s_failed": F.max("__failed")},
        {
            "__o_created": lambda o: F.max("__s_created").over(ordered.before(o)),
            "__o_failed": lambda o: F.max("__s_failed").over(ordered.before(o)),
        },
    )
    created = F.greatest("__created", "__o_created")
    failed = F.greatest("__failed", "__o_failed")
    start = F.when(F.col("__at_reset").isNotNull(), F.lit(1)).otherwise(F.col("__b_confidence"))
    value = F.least(
        F.lit(MAX_CONFIDENCE), start + F.col("__n_success") - F.coalesce("__at_reset", zero)
    )
    on_base = F.col("__from_base")
    exists = F.col("__exists")
    result = step.withColumns(
        {
            "confidence": F.when(exists, value.cast("int")),
            "created": F.when(
                exists, F.when(on_base, F.col("__b_created")).otherwise(created["ts"])
            ),
            "last_verified": F.when(
                exists,
                F.coalesce("__verified", F.when(on_base, F.col("__b_last_verified"))),
            ),
            "last_failed": F.when(
                exists,
                F.when(on_base, F.coalesce(failed["ts"], F.col("__b_last_failed"))).when(
                    failed > created, failed["ts"]
                ),
            ),
        }
    ).withColumn("tier", F.when(exists, X.confidence_tier("confidence")))
    return result.where(~_is(START)).select(
        *outcomes.columns, "confidence", "tier", "created", "last_verified", "last_failed"
    )


STATE = ["confidence", "tier", "created", "last_verified", "last_failed"]


def last_states(trace: DataFrame) -> DataFrame:
    """State after the last event per recipe; NULL state where the recipe is gone."""
    last = trace.groupBy(*KEYS).agg(F.max_by(F.struct(*STATE), F.struct(*ORDER)).alias("__state"))
    return last.select(*KEYS, "__state.*")


def confidence_state(trace: DataFrame) -> DataFrame:
    """Recipes that exist after the last event, with their state."""
    return last_states(trace).where(F.col("confidence").isNotNull())


def replay_state(outcomes: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """What ``confidence_state`` of the full trace holds, from aggregates only.

    The state after the last event needs the latest delete, reset and failure of a key, then what came after them:
    the successes since the reset and the first save since the delete. Both passes combine rows before they move,
    and only saves and successes meet the marks of the first one, so a busy key is one row per task of input.
    """
    at = F.struct(*ORDER)

    def latest(*kinds: str) -> Column:
        return F.max(F.when(F.col("outcome").isin(*kinds), at))

    marks = outcomes.groupBy(*KEYS).agg(
        latest("delete").alias("__deleted"),
        latest("save", "fast_fail").alias("__reset"),
        latest("fast_fail").alias("__failed"),
        latest("save", "success").alias("__verified"),
    )
    stored = ["confidence", "created", "last_verified", "last_failed"]
    if base is None:
        kinds = ["int", "timestamp", "timestamp", "timestamp"]
        known = marks.withColumns({f"__b_{c}": F.lit(None).cast(k) for c, k in zip(stored, kinds)})
    else:
        held = base.select(*KEYS, *[F.col(c).alias(f"__b_{c}") for c in stored])
        known = marks.join(held, KEYS, "left")
    gains = outcomes.where(F.col("outcome").isin("save", "success")).select(*KEYS, "outcome", *ORDER)
    after = gains.join(marks.select(*KEYS, "__deleted", "__reset"), KEYS).groupBy(*KEYS).agg(
        F.count(F.when(_is("success") & F.coalesce(at > F.col("__reset"), F.lit(True)), 1)).alias("__successes"),
        F.min(F.when(_is("save") & F.coalesce(at > F.col("__deleted"), F.lit(True)), at)).alias("__created"),
    )
    step = known.join(after, KEYS, "left")
    on_base = F.col("__deleted").isNull() & F.col("__b_confidence").isNotNull()
    start = F.when(F.col("__reset").isNotNull(), F.lit(1)).otherwise(F.col("__b_confidence"))
    value = F.least(F.lit(MAX_CONFIDENCE), start + F.coalesce("__successes", F.lit(0)))
    failed = F.col("__failed")
    return (
        step.where(on_base | F.col("__created").isNotNull())
        .select(
            *KEYS,
            value.cast("int").alias("confidence"),
            F.when(on_base, F.col("__b_created")).otherwise(F.col("__created.ts")).alias("created"),
            F.coalesce(F.col("__verified.ts"), F.when(on_base, F.col("__b_last_verified"))).alias("last_verified"),
            F.when(on_base, F.coalesce(failed["ts"], F.col("__b_last_failed")))
            .when(failed > F.col("__created"), failed["ts"])
            .alias("last_failed"),
        )
        .withColumn("tier", X.confidence_tier("confidence"))
        .select(*KEYS, *STATE)
    )
