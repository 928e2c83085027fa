import json

import pytest
from pyspark.sql import functions as F

from gridloom.lineage import scratch_path
from gridloom.plans import stream_queries
from gridloom.streaming import ledger_stream

SCHEMA = "event_id bigint, seq bigint, warehouse_id string, color_key string, delta bigint, created_at timestamp"


def write(spark, path, rows_):
    spark.createDataFrame(rows_, "event_id bigint, seq bigint, warehouse_id string, color_key string, delta bigint, at string").selectExpr(
        "event_id", "seq", "warehouse_id", "color_key", "delta", "cast(at as timestamp) created_at"
    ).coalesce(1).write.mode("append").parquet(path)


def test_stream_counts_every_event_once_across_restarts(spark, tmp_path, rows):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        ledger_stream.run_ledger_stream(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint)
        return rows(ledger_stream.current_balances(spark, out))

    write(spark, source, [(1, 1, "w", "A", 5, "2024-01-01 00:00:00"), (2, 2, "w", "A", -2, "2024-01-01 00:01:00"), (1, 1, "w", "A", 5, "2024-01-01 00:00:00")])
    assert run() == [("w", "A", 3, 2)]
    write(spark, source, [(2, 2, "w", "A", -2, "2024-01-01 00:01:00"), (3, 3, "w", "B", 4, "2024-01-01 00:02:00"), (4, 4, "w", "A", 10, "2024-01-01 00:03:00")])
    assert run() == [("w", "A", 13, 4), ("w", "B", 4, 3)]
    assert run() == [("w", "A", 13, 4), ("w", "B", 4, 3)]


def test_late_and_repeated_events_count(spark, tmp_path, rows):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    want = {}
    for n, (at, delta) in enumerate([("12:00", 10), ("08:00", 5), ("13:00", 1), ("01:00", 7)], 1):
        write(spark, source, [(n, n, "w", "A", delta, f"2024-01-02 {at}:00"), (n, n, "w", "A", delta, f"2024-01-02 {at}:00"), (100 + n, n, f"w{n}", None, delta, "2023-01-01 00:00:00")])
        ledger_stream.run_ledger_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), out, checkpoint)
        want["w", "A"] = (want.get(("w", "A"), (0,))[0] + delta, n)
        want[f"w{n}", None] = (delta, n)
        assert rows(ledger_stream.current_balances(spark, out)) == sorted(((*k, *v) for k, v in want.items()), key=repr)
    commits = sorted((tmp_path / "out" / "commits").glob("*.json"))
    listed = {f for c in map(json.loads, (c.read_text() for c in commits)) for f in [c["base"], *[d for d, _ in c["deltas"]]]}
    assert len(commits) == 2 and {p.name for p in (tmp_path / "out" / "parts").iterdir()} == listed


class Lost(Exception):
    pass


STEPS = ["before write_part", "after write_part", "before commit", "after commit", "before clean", "after clean"]


@pytest.mark.parametrize("first,second", [(a, b) for i, a in enumerate(STEPS) for b in STEPS[i % 2 :: 2]])
def test_driver_lost_twice_between_any_two_steps(spark, tmp_path, rows, monkeypatch, first, second):
    """Batches are merged as a stream would hand them over: again from the one that did not end."""
    out = str(tmp_path / "out")
    batches = [[("w", "A", 11, 1), ("w", "B", 7, 2)], [("w", "A", 12, 3), (None, "C", 1, 4)], [("w", "B", 6, 5)], [("w", "A", 1, 6)]]
    schema = "warehouse_id string, color_key string, balance bigint, last_seq bigint"
    losses = [first, second]
    for name in ("write_part", "commit", "clean"):
        plain = getattr(ledger_stream.BalanceTable, name)

        def step(self, *args, name=name, plain=plain):
            if losses and done >= 1 and losses[0] == f"before {name}":
                losses.pop(0)
                raise Lost
            result = plain(self, *args)
            if losses and done >= 1 and losses[0] == f"after {name}":
                losses.pop(0)
                raise Lost
            return result

        monkeypatch.setattr(ledger_stream.BalanceTable, name, step)
    done, want = 0, {}
    while done < len(batches):
        try:
            ledger_stream.merge_batch(ledger_stream.BalanceTable(spark, out), spark.createDataFrame(batches[done], schema), done, "q")
        except Lost:
            known = rows(ledger_stream.current_balances(spark, out))
            assert known in (sorted(((*k, *v) for k, v in w.items()), key=repr) for w in (want, {**want, **{r[:2]: r[2:] for r in batches[done]}}))
            continue
        want.update({r[:2]: r[2:] for r in batches[done]})
        done += 1
        assert rows(ledger_stream.current_balances(spark, out)) == sorted(((*k, *v) for k, v in want.items()), key=repr)


def test_writes_follow_the_changes_and_other_checkpoints_are_refused(spark, tmp_path):
    table = ledger_stream.BalanceTable(spark, str(tmp_path / "out"))
    written = []
    plain = table.write_part
    table.write_part = lambda *a: written.append(plain(*a)) or written[-1]
    big = spark.range(1000).selectExpr("'w' warehouse_id", "cast(id as string) color_key", "id balance", "id last_seq")
    ledger_stream.merge_batch(table, big, 0, "q")
    for n in range(1, 12):
        ledger_stream.merge_batch(table, big.where(f"balance = {n}").withColumn("balance", F.lit(-n).cast("long")), n, "q")
    assert sum(n for _, n in written[1:]) == 11
    assert ledger_stream.current_balances(spark, table.path).agg(F.count("*"), F.sum("balance")).first()[:] == (1000, sum(range(1000)) - 2 * sum(range(12)))
    with pytest.raises(ValueError):
        ledger_stream.merge_batch(table, big, 12, "other")


def test_stream_whose_own_commit_is_lost(spark, tmp_path, rows):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    run = lambda: ledger_stream.run_ledger_stream(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint)
    write(spark, source, [(1, 1, "w", "A", 11, "2024-01-01 00:00:00"), (2, 2, "w", "B", 7, "2024-01-01 00:00:00")])
    run()
    write(spark, source, [(3, 3, "w", "A", 1, "2024-01-01 00:00:00")])
    run()
    for file in (tmp_path / "checkpoint" / "commits").glob("*1"):
        file.unlink()
    for file in (tmp_path / "checkpoint" / "commits").glob(".1.crc"):
        file.unlink()
    write(spark, source, [(4, 4, "w", "B", 2, "2024-01-01 00:00:00")])
    run()
    assert rows(ledger_stream.current_balances(spark, out)) == [("w", "A", 12, 3), ("w", "B", 9, 4)]


def test_batches_do_not_grow_with_the_files(spark, tmp_path, rows):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(9, "event_id").write.parquet(str(tmp_path / "in" / "events.parquet"))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "200m")  # a partition a file
    try:
        stream = stream_queries.event_stream(spark, str(tmp_path / "in"))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    out, checkpoint = str(tmp_path / "out"), scratch_path(spark, "stream")
    ledger_stream.run_ledger_stream(stream, out, checkpoint)
    assert len([r for r in spark.read.text(f"{checkpoint}/commits").select("_metadata.file_name").distinct().collect()]) == 2
    keys = [(F.col("user_id") % 10).alias("w"), (F.col("event_id") % 96).cast("int").alias("c")]
    want = events.groupBy(*keys).agg(F.max("event_id"))
    assert rows(ledger_stream.current_balances(spark, out).drop("balance")) == rows(want)
