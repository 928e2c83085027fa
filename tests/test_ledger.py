"""Stock ledger: the deletion and rollback cases, restocking, balances."""

import random

import pytest

from gridloom.operators import ledger

ITEMS = "warehouse_id string, item_idx int, color_key string, hex string, owned bigint, is_extra boolean"


@pytest.fixture
def store(spark):
    items = spark.createDataFrame(
        [("main", 0, "A1", "#FFFFFF", 10, False), ("main", 1, "B2", "#000000", 7, False), ("extra", 0, "C3", "#FF0000", 5, False)], ITEMS
    )
    houses = spark.createDataFrame([("main", "Main"), ("extra", "Extra")], "warehouse_id string, name string")
    txns = spark.createDataFrame([("txn-main", "main", 0), ("txn-out", "main", 1), ("txn-extra", "extra", 2)], "txn_id string, warehouse_id string, seq bigint")
    entries = spark.createDataFrame([("txn-main", "A1", 1), ("txn-out", "B2", -3), ("txn-extra", "C3", 5)], "txn_id string, color_key string, delta bigint")
    return houses, items, txns, entries


def ask(spark, *pairs):
    return spark.createDataFrame(list(pairs), "warehouse_id string, txn_id string")


def owned(items):
    return {(r.warehouse_id, r.color_key): r.owned for r in items.collect()}


def test_delete_unbound_warehouse(spark, store, rows):
    houses, items, txns, _ = store
    projects = spark.createDataFrame([("main", "p1")], "warehouse_id string, project_id string")
    request = spark.createDataFrame([("extra",)], "warehouse_id string")
    h, i, t, bad = ledger.delete_warehouses(houses, items, txns, projects, request)
    assert rows(h, "warehouse_id") == [("main",)]
    assert rows(t, "txn_id") == [("txn-main",), ("txn-out",)]
    assert {w for w, _ in owned(i)} == {"main"} and bad.count() == 0


def test_delete_bound_warehouse_is_refused(spark, store, rows):
    houses, items, txns, _ = store
    projects = spark.createDataFrame([("main", "p1")], "warehouse_id string, project_id string")
    request = spark.createDataFrame([("main",), ("nowhere",)], "warehouse_id string")
    h, i, t, bad = ledger.delete_warehouses(houses, items, txns, projects, request)
    assert h.count() == 2 and i.count() == 3 and t.count() == 3
    assert rows(bad) == [("main", "bound_to_project", 1), ("nowhere", "unknown_warehouse", 0)]


@pytest.mark.parametrize("txn, key, after", [("txn-main", "A1", 9), ("txn-out", "B2", 10)])
def test_rollback(spark, store, rows, txn, key, after):
    _, items, txns, entries = store
    new, left, bad = ledger.rollback_transactions(items, txns, entries, ask(spark, ("main", txn)))
    assert owned(new)["main", key] == after
    assert (txn,) not in rows(left, "txn_id") and left.count() == 2 and bad.count() == 0


@pytest.mark.parametrize(
    "requests, reason",
    [
        ([("main", "txn-extra")], "other_warehouse"), ([("main", "nope")], "unknown_transaction"),
        ([("main", "txn-main"), ("main", "txn-out")], "several_requests"),
    ],
)
def test_rollback_refusals_change_nothing(spark, store, rows, requests, reason):
    _, items, txns, entries = store
    new, left, bad = ledger.rollback_transactions(items, txns, entries, ask(spark, *requests))
    assert owned(new) == owned(items) and left.count() == 3
    assert {r for (r,) in rows(bad, "reason")} == {reason}


def test_rollback_never_goes_below_zero(spark, store, rows):
    _, items, txns, entries = store
    more = entries.unionByName(spark.createDataFrame([("txn-main", "B2", 8), ("txn-extra", "Z9", 0)], entries.schema))
    new, left, bad = ledger.rollback_transactions(items, txns, more, ask(spark, ("main", "txn-main"), ("extra", "txn-extra")))
    assert rows(bad, "warehouse_id", "reason") == [("main", "negative_stock")]
    assert owned(new) == {("main", "A1"): 10, ("main", "B2"): 7, ("extra", "C3"): 0}
    assert left.count() == 2
    unknown = entries.unionByName(spark.createDataFrame([("txn-main", "Z9", 1)], entries.schema))
    assert rows(ledger.rollback_transactions(items, txns, unknown, ask(spark, ("main", "txn-main")))[2], "reason") == [("unknown_color",)]


def test_adjustments(spark, store, rows):
    _, items, _, _ = store
    todo = spark.createDataFrame(
        [("main", " a1 ", 12.0), ("main", "B2", 7.0), ("main", "Q1", 1.0), ("extra", "C3", 1.5)], "warehouse_id string, color_key string, owned_count double"
    )
    new, log, bad = ledger.adjust_stock(items, todo)
    assert owned(new) == {("main", "A1"): 12, ("main", "B2"): 7, ("extra", "C3"): 5}
    assert rows(log, "color_key", "delta", "before", "after") == [("A1", 2, 10, 12)]
    assert rows(bad, "color_key", "reason") == [("C3", "bad_count"), ("Q1", "unknown_item")]


def test_preview_and_replenish(spark, store, rows):
    _, items, _, _ = store
    text = "a1-5\r\nA01：3\n\nZ9 4\nnonsense\nB2 0\nD4,6"
    catalogue = spark.createDataFrame([(0, "A1", "#FFFFFF"), (1, "B2", "#000000"), (2, "D4", "#0000FF")], "ord int, color_key string, hex string")
    texts = spark.createDataFrame([("main", 1, text)], "warehouse_id string, doc_id int, text string")
    entries, errors = ledger.replenish_preview(texts, items, catalogue)
    assert rows(entries, "color_key", "count", "line_count", "already_in_warehouse", "is_extra") == [("A1", 8, 2, True, False), ("D4", 6, 1, False, True)]
    assert rows(errors, "line_number", "reason") == [(4, "unknown_color"), (5, "unreadable"), (6, "count_not_positive")]
    merged, bad = ledger.merge_replenish(entries)
    new, log, refused = ledger.replenish(items, merged, catalogue)
    assert owned(new) == {("main", "A1"): 18, ("main", "B2"): 7, ("main", "D4"): 6, ("extra", "C3"): 5}
    assert rows(log, "color_key", "before", "after") == [("A1", 10, 18), ("D4", 0, 6)]
    assert rows(new.where("color_key = 'D4'"), "is_extra") == [(True,)] and bad.count() == 0 and refused.count() == 0


def test_merge_refuses_whole_requests(spark, rows):
    data = [("w", "a1", 2), ("w", "A1 ", 3), ("bad", "A1", 0), ("bad", "B1", 4), ("blank", " ", 4), ("w", "", 9)]
    merged, bad = ledger.merge_replenish(spark.createDataFrame(data, "warehouse_id string, color_key string, count bigint"))
    assert rows(merged) == [("w", "A1", 5)]
    assert rows(bad) == [("bad", "A1", "bad_count"), ("blank", "", "nothing_to_import")]


def test_running_balance_does_not_depend_on_blocks(spark):
    from gridloom.operators.sizing import rank_in_blocks, running_sum_in_blocks

    rnd = random.Random(2)
    data = [(i, "hot" if rnd.random() < 0.7 else rnd.choice("abc"), rnd.randrange(-5, 9)) for i in range(400)]
    df = spark.createDataFrame(data, "seq bigint, k string, delta bigint")
    want, total, pos = {}, {}, {}
    for i, k, v in data:
        total[k] = total.get(k, 0) + v
        pos[k] = pos.get(k, -1) + 1
        want[i] = (total[k], pos[k])
    for block in (7, 10**6):
        sums = running_sum_in_blocks(df, ["k"], "seq", "delta", "s", block)
        ranks = rank_in_blocks(df, ["k"], "seq", "p", block)
        got = {r.seq: r.s for r in sums.collect()}, {r.seq: r.p for r in ranks.collect()}
        assert got == ({i: w[0] for i, w in want.items()}, {i: w[1] for i, w in want.items()})


def test_health(spark, rows):
    demand = spark.createDataFrame(
        [("ok", 2, 5, 0), ("needs", 9, 5, 4), ("needs", 1, 5, 0), ("empty", 1, 0, 1), ("empty", 1, 9, 0), ("empty", 1, 9, 0), ("short", 9, 1, 8), ("short", 9, 1, 8), ("short", 0, 1, 0)],
        "warehouse_id string, needed bigint, owned bigint, missing bigint",
    )
    houses = spark.createDataFrame([(h,) for h in ("ok", "needs", "empty", "short", "none")], "warehouse_id string")
    assert rows(ledger.warehouse_health(houses, demand), "warehouse_id", "health") == [
        ("empty", "severe"), ("needs", "needs"), ("none", "none"), ("ok", "ok"), ("short", "severe"),
    ]


def test_upsert_keeps_creation_time(spark, rows):
    old = spark.createDataFrame([("a", "old", 1), ("b", "keep", 2)], "warehouse_id string, name string, created_at int")
    new = spark.createDataFrame([("a", "new", 9), ("c", "add", 9)], "warehouse_id string, name string, created_at int")
    assert rows(ledger.upsert_warehouses(old, new)) == [("a", "new", 1), ("b", "keep", 2), ("c", "add", 9)]


def test_deleted_warehouses_are_taken_out_without_moving_the_tables(spark, rows):
    wh = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "warehouse_id int, name string")
    txns = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (3, 4), (None, 5)], "warehouse_id int, txn_id int")
    projects = spark.createDataFrame([(3, 1)], "warehouse_id int, project_id int")
    asked = spark.createDataFrame([(2,), (3,), (9,)], "warehouse_id int")
    kept_wh, _items, kept, violations = ledger.delete_warehouses(wh, txns, txns, projects, asked)
    assert rows(kept, "txn_id") == [(1,), (4,), (5,)] and rows(kept_wh, "warehouse_id") == [(1,), (3,)]
    assert rows(violations, "warehouse_id", "reason") == [(3, "bound_to_project"), (9, "unknown_warehouse")]
    plan = kept.hint("merge")._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
