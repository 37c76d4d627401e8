"""Plans keep the shape that carries to large tables."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import joins, log, ordered, pages, runs
from ledgerline.plans import catalog
from tests.helpers import at, plan_of

SF = "/root/testdata/sf0.001"
PYTHON_ON_WORKERS = {"page_elements", "stored_page_classes"}
BATCH = sorted(n for n in catalog.QUERIES if not n.startswith("live_"))


@pytest.fixture(autouse=True)
def large_tables(spark):
    """Plan as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the supplied tables")
@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops_and_no_row_python(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert ("MapInPandas" in plan) == (name in PYTHON_ON_WORKERS)


def test_library_brings_nothing_to_the_driver():
    root = Path(catalog.__file__).parent.parent
    for path in root.rglob("*.py"):
        if path.parent.name == "llm":  # collects numbers and samples of stated size
            continue
        text = path.read_text()
        for word in (".collect()", "toPandas", "localCheckpoint", "crossJoin", "F.broadcast", ".rdd"):
            assert word not in text, (path.name, word)


def actions(spark):
    return spark.createDataFrame([(1, "p", at(0))], "id bigint, persona string, ts timestamp")


def test_recent_n_limits_groups_before_the_shuffle(spark):
    plan = plan_of(log.newest(actions(spark), ["persona"], ["ts", "id"], 20))
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hash") == 1
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_large_n_is_salted(spark):
    plan = plan_of(log.newest(actions(spark), ["persona"], ["ts", "id"], 5_000))
    assert re.search(r"hashpartitioning\(persona#\d+, __salt#", plan)


def test_page_features_aggregate_before_the_shuffle(spark):
    el = spark.createDataFrame([(1, 0, "a", "x")], "page_id bigint, pos int, tag string, text string")
    plan = plan_of(pages.page_features(el))
    assert "partial_count" in plan and plan.count("Exchange hash") == 1 and "collect_list" not in plan


def test_run_classes_gather_no_run(spark):
    steps = spark.createDataFrame(
        [(1, 1, "done", "x", "api", 0.5)],
        "run_id bigint, step int, action_taken string, page_type string, tier string, confidence double",
    )
    plan = plan_of(runs.classify_runs(steps))
    assert "partial_min" in plan and "partial_max" in plan and "collect_list(struct(step" not in plan


def test_chunk_carry_keeps_the_window_partitioning(spark, cut_all):
    """The rows themselves move once, by (key, chunk)."""
    df = actions(spark).repartition(3)
    plan = plan_of(ordered.ordinal(df, ["persona"], ["ts", "id"], "n"))
    big = [line for line in plan.splitlines() if "Exchange hashpartitioning(persona" in line]
    assert len([b for b in big if "__chunk" in b]) == 2  # the rows, and their counts
    assert plan.count("SortMergeJoin") == 1
    left = plan[plan.index("SortMergeJoin") :]
    assert left.index("Window") < left.index("Exchange")


def test_no_busy_key_leaves_the_plain_window(spark):
    plan = plan_of(ordered.ordinal(actions(spark), ["persona"], ["ts", "id"], "n"))
    assert plan.count("Exchange") == 1 and plan.count("Window") == 1 and "__chunk" not in plan


def test_splitters_are_a_constant(spark, cut_all):
    plan = plan_of(ordered.chunked(actions(spark), ["persona"], ["ts", "id"]))
    assert "from_json" not in plan and "scalar-subquery" not in plan and "REPARTITION_BY_COL" in plan


def test_match_is_by_equality(spark):
    urls = spark.createDataFrame([(1, "a.com")], "page_id bigint, url string")
    flows = spark.createDataFrame([("a.com", "x")], "domain string, action string")
    plan = plan_of(joins.match_flows(urls, flows))
    assert "NestedLoop" not in plan and "partial_min" in plan


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the supplied tables")
def test_confidence_state_needs_no_window(spark):
    plan = plan_of(catalog.QUERIES["confidence_state"](spark, SF))
    assert "Window" not in plan and "__chunk" not in plan


def test_no_file_of_an_array_is_brought_together(spark, tmp_path, cut_all):
    """Fragments meet what is known of their file by range, never by the file alone."""
    from ledgerline.sources import json_arrays

    (tmp_path / "a.json").write_text('[{"a": 1}, {"b": "}"}]')
    plan = plan_of(json_arrays.read_records(spark, str(tmp_path)))
    assert "SortMergeJoin [file#" in plan
    assert not re.search(r"SortMergeJoin \[file#\d+\]", plan)


def test_report_lines_are_shuffled_once_by_file(spark, tmp_path, monkeypatch):
    """Files of many short reports: no line looks for a range or joins, in writing or reading."""
    from ledgerline.operators import reports
    from ledgerline.sources import reports as sink

    monkeypatch.setattr(ordered, "HOT_ROWS", 160)
    monkeypatch.setattr(ordered, "_splitters", lambda *_: pytest.fail("no report is long"))
    persona = F.concat(F.lit("p"), (F.col("id") % 250).cast("string"))
    rows = spark.range(2_000).select(persona.alias("persona"), "id", F.lit("text").alias("text"))
    sink.write_reports(reports.emit(rows, ["persona"], {0: [F.col("text")]}, seq="id"), str(tmp_path / "out"))
    plan = plan_of(sink.read_reports(spark, str(tmp_path / "out")))
    assert "Join" not in plan and "__chunk" not in plan
    assert plan.count("Exchange hash") == 2  # one of the index, by key, and one of lines and index, by file


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the supplied tables")
def test_frames_are_made_by_many_tasks(spark):
    """Spark merges what recordings are grouped by into one task, and drops a repartition to the same number."""
    from ledgerline.plans import inputs

    spark.conf.set("spark.sql.adaptive.enabled", "true")
    made = inputs.frames(spark, SF).withColumn("task", F.spark_partition_id())
    assert made.select("task").distinct().count() > 1
