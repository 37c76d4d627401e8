from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import filters, log, ordered, reports
from ledgerline.sources import imports, json_arrays, logs, tables
from ledgerline.sources import reports as sink
from tests.helpers import at, plan_of, rows

ACTIONS = schemas.TABLES["actions"]


def test_append_and_read(spark, tmp_path):
    path = str(tmp_path / "actions")
    one = spark.createDataFrame([(1, "p", "open", "x", at(0))], ACTIONS)
    two = spark.createDataFrame([(2, "p", "open", "y", at(60 * 24))], ACTIONS)
    logs.append_actions(one, path)
    logs.append_actions(two, path)
    back = logs.read_actions(spark, path)
    assert rows(back, "id", "detail") == [(1, "x"), (2, "y")]
    assert "PartitionFilters: [isnotnull(date" in plan_of(back.where("date = date'2026-03-01'"))


def test_load_pushes_the_key_down(spark, tmp_path):
    spark.createDataFrame([(1, "p", "open", "x", at(0))], ACTIONS).write.parquet(str(tmp_path / "actions.parquet"))
    df = tables.load(spark, str(tmp_path), "actions")
    plan = plan_of(log.recent_n(filters.lookup(df, persona="p").select("persona", "id", "ts")))
    assert "EqualTo(persona,p)" in plan
    assert "ReadSchema: struct<id:bigint,persona:string,ts:timestamp>" in plan


def test_jsonl(spark, tmp_path):
    lines = [
        {"ts": 1_000, "action": "fill", "detail": {"x": 1, "durationMs": 240}},
        {"ts": 2_000, "action": "fill", "detail": "plain"},
        {"ts": 3_000, "action": "click", "detail": {"x": 1}},
        {"ts": 4_000, "action": "list", "detail": [1]},
    ]
    text = "\n".join([*map(json.dumps, lines), "", "  ", "{broken", '{"action": "no ts"}'])
    (tmp_path / "log.jsonl").write_text(text)
    good, rejects = logs.read_action_jsonl(spark, str(tmp_path / "log.jsonl"))
    assert rows(good, "ts_ms", "action", "duration_ms") == [
        (1_000, "fill", 240), (2_000, "fill", None), (3_000, "click", 0), (4_000, "list", None),
    ]
    assert rows(rejects, "value") == ['{"action": "no ts"}', "{broken"]


def test_account_import_never_reads_passwords(spark, tmp_path):
    listed = [
        {"entry": "ns/a", "username": "u", "password": "hush"},
        {"entry": "", "username": "u"},
        {"entry": "ns/b"},
    ]
    (tmp_path / "good.json").write_text(json.dumps(listed))
    (tmp_path / "bad.json").write_text('[{"entry": "ns/c", ')
    good, rejects, counts = imports.import_accounts(spark, str(tmp_path))
    assert good.columns == ["entry", "username"] and rows(good) == [("ns/a", "u")]
    assert sorted(rows(rejects, "error")) == ["entry is missing", "not valid JSON", "username is missing"]
    assert rows(counts) == [(1, 3)]


def test_milestone_import(spark):
    texts = [
        "2026-03-07T11:00:00", "2026-03-07T11:00", "2026-3-7", "", None, "2026-03-07 11:00:00",
        "2026-03-07T11:00:00Z", "2026-02-30", "1970-01-01",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, ts string")
    good, rejects = imports.import_milestones(df, at(0))
    assert rows(good, "id") == [0, 1, 2, 3, 4]
    assert dict(rows(good, "id", "ts"))[3] == at(0)
    assert rows(rejects, "id", "ts") == [(i, texts[i]) for i in (5, 6, 7, 8)]


def test_config_layers(spark, tmp_path):
    first, second = tmp_path / "one", tmp_path / "two"
    first.mkdir()
    second.mkdir()
    (first / "a.yml").write_text("name: yml\nonly: yml\n")
    (first / "a.yaml").write_text('name: one\n  name:  last  \n    deep: no\nlist:\n  city: "Rome"\n# note: x\n')
    (second / "a.yaml").write_text("name: two\nextra: two\n")
    (second / "b.yaml").write_text("size: 3\n")
    lines = imports.read_config_lines(spark, [str(first), str(second)])
    assert rows(imports.resolve_config(lines)) == [
        ("a", "city", '"Rome"'), ("a", "name", "last"), ("b", "size", "3"),
    ]
    assert ("a", "city", "Rome") in rows(imports.resolve_config(lines, unquote=True))


def test_report_sink_keeps_order(spark, tmp_path, monkeypatch):
    people = spark.createDataFrame(
        [("p", "tester", "", "en-US", "UTC", "", "", at(0), None), ("q", "", "", "en-US", "UTC", "", "", at(0), None)],
        schemas.TABLES["personas"],
    )
    milestones = spark.createDataFrame(
        [(i, "p", f"event {i:03d}", "line", "", ["post"], "", "manual", at(i * 60)) for i in range(60)],
        schemas.TABLES["milestones"],
    )
    lines = reports.timeline(people, milestones)
    path = tmp_path / "out"
    sink.write_reports(lines, str(path))
    back = sink.read_reports(spark, str(path))
    said = {}
    for r in back.orderBy("persona", "line_no").collect():
        said.setdefault(r.persona, []).append(r.line)
    document = reports.document(lines.where("persona = 'p'")).collect()
    assert "\n".join(said["p"]) == "\n".join(r.line for r in document)
    assert said["p"][:6] == ["# p — tester — Timeline", "", "## 2026-03-01", "", "### 12:00 — event 000", "Tags: `post`"]
    assert said["q"] == ["No milestones recorded for 'q'."]
    assert len(list((path / "lines").rglob("part-*.txt"))) == 1
    monkeypatch.setattr(ordered, "HOT_ROWS", 100)
    path = tmp_path / "cut"
    sink.write_reports(lines, str(path), file_bytes=2_000)
    cut = sink.read_reports(spark, str(path))
    assert rows(cut.select(back.columns)) == rows(back)
    files = {f.parent for f in (path / "lines").rglob("part-*.txt")}
    assert len(files) > 2 and spark.read.parquet(str(path / "index")).where("persona = 'p'").count() > 1


def test_report_sink_cuts_long_reports_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 160)
    texts = ["plain", "two\nlines", "carriage\rreturn", "", None]
    said = {f"short{i}": [texts[(i + j) % 5] for j in range(i % 9 + 1)] for i in range(40)}
    said |= {"long": [f"line {j}" if j % 5 else texts[j % 3] for j in range(900)]}
    data = [(k, 0, None, None, j, 0, line) for k, lines in said.items() for j, line in enumerate(lines)]
    kinds = "persona string, section int, at timestamp, by string, seq bigint, sub int, line string"
    for size in (1 << 20, 500):
        path = str(tmp_path / str(size))
        sink.write_reports(spark.createDataFrame(data, kinds).repartition(5), path, file_bytes=size)
        want = {k: "\n".join(line or "" for line in lines).split("\n") for k, lines in said.items()}
        expected = [(k, n, line) for k, lines in want.items() for n, line in enumerate(lines, 1)]
        assert rows(sink.read_reports(spark, path)) == sorted(expected, key=str)
        index = spark.read.parquet(f"{path}/index")
        assert index.where("persona = 'long' and part > 0").count() > 4
        assert index.where("persona <> 'long' and part = 0").count() == index.where("persona <> 'long'").count() == 40


def test_report_sink_of_nothing(spark, tmp_path):
    kinds = "persona string, section int, at timestamp, by string, seq bigint, sub int, line string"
    sink.write_reports(spark.createDataFrame([], kinds), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none" / "index")).count() == 0


def test_not_found(spark):
    people = spark.createDataFrame([("p",)], "name string")
    asked = spark.createDataFrame([("p",), ("x",)], "persona string")
    assert rows(reports.not_found(asked, people), "line") == ["Persona 'x' not found."]


def test_step_log_number(spark):
    steps = spark.createDataFrame(
        [(1, 1, "", "login", "form", "fill", "api", 0.84), (1, 2, "", "login", None, "done", "api", None)],
        schemas.TABLES["steps"],
    )
    assert rows(reports.step_log(steps), "line") == [
        "  Step 1: [login] form -> fill (tier: api, conf: 0.8)",
        "  Step 2: [login]  -> done (tier: api, conf: 0.0)",
    ]


def test_array_of_objects_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    sign = '{}[]"\\,: \né'
    objects = [
        {"entry": "".join(rng.choice(sign) for _ in range(rng.randrange(30))), "deep": [{"a": {}}, "}"] * rng.randrange(3)}
        for _ in range(400)
    ]
    (tmp_path / "a.json").write_text(json.dumps(objects, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(objects[:5], ensure_ascii=False))
    (tmp_path / "c.json").write_text(json.dumps(objects[0]))
    (tmp_path / "d.json").write_text(" [ ]\n")
    (tmp_path / "e.json").write_text('[1, {"entry": "x"}, 2]')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for hot in (0, 1_000_000):
            monkeypatch.setattr(ordered, "HOT_ROWS", hot)
            pieces = json_arrays.fragments(spark, str(tmp_path))
            assert pieces.where("file like '%a.json'").select(F.spark_partition_id()).distinct().count() > 3
            back = json_arrays.read_records(spark, str(tmp_path)).collect()
            of = lambda name: [r.value for r in sorted(back) if r.file.endswith(name)]
            assert [json.loads(t) for t in of("a.json")] == objects
            assert [json.loads(t) for t in of("b.json")] == objects[:5]
            assert [json.loads(t) for t in of("c.json")] == objects[:1]
            assert of("d.json") == [] and of("e.json") == ['1, {"entry": "x"}', "2"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
