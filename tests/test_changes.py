from __future__ import annotations

from ledgerline import schemas
from ledgerline.operators import changes, ordered
from ledgerline.sources import tables
from tests.helpers import at, rows

CONTEXT = schemas.TABLES["context"]


def context(spark, *entries):
    """(id, created, updated, digested, deleted) in minutes."""
    data = [
        (i, "p", f"s{i}", None, "a,b", *[None if m is None else at(m) for m in times])
        for i, *times in entries
    ]
    return spark.createDataFrame(data, CONTEXT)


STATES = [
    (1, 0, None, None, None),  # new
    (2, 0, 5, None, None),  # edited before its first digest: still new
    (3, 0, None, 10, None),  # digested
    (4, 0, 20, 10, None),  # edited after the digest
    (5, 0, 5, 10, None),  # edited before the digest
    (6, 0, None, None, 7),  # deleted before a digest
    (7, 0, None, 10, 30),  # deleted after it
    (8, 100, None, None, None),  # created after the commit below
    (9, 0, 100, 10, None),  # edited after the commit
    (10, 0, None, None, 100),  # deleted after the commit
]


def test_digest_classes(spark):
    got = dict(rows(changes.digest_classes(context(spark, *STATES)), "id", "digest_class"))
    assert got == {
        1: "new", 2: "new", 4: "updated", 6: "deleted", 7: "deleted", 8: "new", 9: "updated",
        10: "deleted",
    }


def test_digest_commit_leaves_later_changes_pending(spark):
    personas = spark.createDataFrame([("p", "old"), ("q", "keep")], "name string, context_summary string")
    summaries = spark.createDataFrame([("p", "fresh")], "persona string, summary string")
    people, after = changes.commit_digest(personas, context(spark, *STATES), summaries, at(50))
    assert rows(people) == [("p", "fresh"), ("q", "keep")]
    stamps = dict(rows(after, "id", "digested_at"))
    assert set(stamps) == {1, 2, 3, 4, 5, 8, 9, 10}
    assert {i for i, t in stamps.items() if t == at(50)} == {1, 2, 4, 9, 10}
    pending = dict(rows(changes.digest_classes(after), "id", "digest_class"))
    assert pending == {8: "new", 9: "updated", 10: "deleted"}


def test_patch(spark):
    base = spark.createDataFrame(
        [(1, "a", "x"), (2, "b", "y")], "id bigint, status string, notes string"
    )
    patches = spark.createDataFrame(
        [(1, 1, "c", None), (1, 2, None, "n"), (1, 3, "d", None), (9, 4, "z", None)],
        "id bigint, seq bigint, status string, notes string",
    )
    new, rejects = changes.patch(base, patches, "id", changes.PATCHABLE["accounts"], "seq")
    assert rows(new) == [(1, "d", "n"), (2, "b", "y")]
    assert rows(rejects, "id") == [9]


def test_patch_touches_only_allowed_columns(spark):
    base = spark.createDataFrame([(1, "a", "p")], "id bigint, status string, persona string")
    patches = spark.createDataFrame([(1, 1, "other")], "id bigint, seq bigint, persona string")
    patches = patches.selectExpr("*", "cast(null as string) AS status")
    new, _ = changes.patch(base, patches, "id", changes.PATCHABLE["accounts"], "seq")
    assert rows(new) == [(1, "a", "p")]


def test_context_edit_marks_dirty(spark):
    base = context(spark, (1, 0, None, 10, None), (2, 0, None, 10, None))
    edits = spark.createDataFrame(
        [(1, 1, "new text"), (2, 1, None)], "id bigint, seq bigint, summary string"
    )
    new, _ = changes.update_context(base, edits, at(60), "seq")
    assert rows(new, "id", "summary", "updated_at") == [(1, "new text", at(60)), (2, "s2", None)]
    assert rows(changes.digest_classes(new), "id", "digest_class") == [(1, "updated")]


def test_insert_and_default(spark):
    base = spark.createDataFrame([("a", "x")], "name string, description string")
    new = spark.createDataFrame(
        [("b", "first", 1), ("b", "second", 2), ("a", "again", 3)],
        "name string, description string, seq bigint",
    )
    merged, rejects = changes.insert_new(base, new, "name", "seq")
    assert rows(merged) == [("a", "x"), ("b", "first")]
    assert rows(rejects, "seq", "reject_reason") == [(2, "repeated in batch"), (3, "already exists")]
    once = changes.ensure_default(merged, at(0))
    assert rows(changes.ensure_default(once, at(5)), "name") == ["a", "b", "default"]


def test_upsert(spark):
    kind = (
        "id bigint, domain string, action string, description string, confidence int, "
        "created timestamp, last_verified timestamp, last_failed timestamp"
    )
    base = spark.createDataFrame(
        [(7, "a.com", "login", "old", 8, at(0), at(1), at(2)), (8, "b.com", "login", "b", 5, at(0), at(1), None)],
        kind,
    )
    saves = spark.createDataFrame(
        [("a.com", "login", "new", at(10), 1), ("c.com", "x", "one", at(11), 2), ("c.com", "x", "two", at(12), 3)],
        "domain string, action string, description string, ts timestamp, seq bigint",
    )
    got = changes.upsert_flows(base, saves)
    assert sorted(rows(got), key=lambda r: r[1]) == [
        (7, "a.com", "login", "new", 1, at(0), at(10), at(2)),
        (8, "b.com", "login", "b", 5, at(0), at(1), None),
        (None, "c.com", "x", "two", 1, at(11), at(12), None),
    ]


def test_deletes(spark):
    base = context(spark, (1, 0, None, None, None), (2, 0, None, None, 5), (3, 0, None, None, None))
    ids = spark.createDataFrame([(1,), (1,), (2,)], "id bigint")
    once = changes.soft_delete(base, ids, at(9))
    assert rows(changes.soft_delete(once, ids, at(99)), "id", "deleted_at") == [
        (1, at(9)), (2, at(5)), (3, None),
    ]
    stays, went = changes.hard_delete(base, ids)
    assert (rows(stays, "id"), rows(went, "id")) == ([3], [1, 2])


def test_cascade(spark):
    people = spark.createDataFrame([("a",), ("b",), ("default",)], "name string")
    child = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, persona string")
    flows = spark.createDataFrame([("x.com",)], "domain string")
    doomed = spark.createDataFrame([("a",), ("default",)], "name string")
    kept, refused = changes.cascade_delete(
        {"personas": people, "accounts": child, "actions": child, "milestones": child, "context": child, "flows": flows},
        doomed,
    )
    assert rows(kept["personas"], "name") == ["b", "default"]
    assert all(rows(kept[t], "id") == [2] for t in ("accounts", "actions", "milestones", "context"))
    assert rows(kept["flows"]) == ["x.com"] and rows(refused, "name") == ["default"]


def test_ids_are_dense(spark):
    base = spark.createDataFrame([(41,)], "id bigint")
    new = spark.createDataFrame([(i, at(i * 7 % 50)) for i in range(50)], "seq bigint, ts timestamp")
    got = changes.assign_ids(base, new, ["ts", "seq"])
    listed = got.orderBy("ts", "seq").collect()
    assert [r.id for r in listed] == list(range(42, 92))
    empty = changes.assign_ids(base.limit(0), new, ["ts", "seq"])
    assert sorted(r.id for r in empty.collect()) == list(range(1, 51))


def test_schema_upgrade(spark):
    old = spark.createDataFrame([("a", "x", at(0))], "name string, extra string, created_at timestamp")
    new = tables.conform(old, "personas")
    assert new.columns == [f.split()[0] for f in schemas.TABLES["personas"].split(", ")]
    assert rows(new, "name", "profile", "locale", "last_used_at") == [("a", "", "en-US", None)]
