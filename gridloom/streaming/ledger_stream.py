"""Stock events as a stream: append-only ledger rows to current balances, however late they come.

The table of balances is a folder of immutable parts and a chain of commits. A micro-batch writes the balances it changes
once, as a delta under a new name, and then renames a commit into place that lists the parts which make up the table: a
base and the deltas since. Once the deltas have as many rows as the base, the batch writes a new base in their stead, so the
rows written follow the rows changed. Nothing that a commit lists is ever written again, and parts go only when the last
two commits list them no more. A driver may be lost between any two steps, and again while it repeats them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["warehouse_id", "color_key"]
#: Deltas that a table may have whatever their size, so that small ones do not pile up.
MAX_DELTAS = 20


def unique_events(events: DataFrame) -> DataFrame:
    """Ledger events with repeated deliveries of an event_id dropped.

    There is no watermark: an event counts however late it comes, so the ids stay in the state store, which is
    partitioned by id and kept beside the checkpoint.
    """
    return events.dropDuplicates(["event_id"])


def balances(events: DataFrame) -> DataFrame:
    """Running balance per warehouse and colour; use with update mode."""
    return unique_events(events).groupBy(*KEYS).agg(F.sum("delta").alias("balance"), F.max("seq").alias("last_seq"))


class BalanceTable:
    """The table at `path`; a commit is {"query", "batch", "base", "rows", "deltas": [[folder, rows], ...]}."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _commits(self) -> list[str]:
        """Names of the commits, oldest first: their number, zero-padded."""
        return [n for n in self._names("commits") if n.endswith(".json") and not n.startswith((".", "_"))]

    def _read_commit(self, name: str) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/commits/{name}").collect()))  # a single line

    def latest(self) -> dict | None:
        commits = self._commits()
        return self._read_commit(commits[-1]) if commits else None

    def rows(self, commit: dict) -> DataFrame:
        """Keys, balance, last_seq, batch: per key what the latest batch says of it."""
        parts = self.spark.read.parquet(*[f"{self.path}/parts/{f}" for f in [commit["base"], *[d for d, _ in commit["deltas"]]]])
        newest = parts.groupBy(*KEYS).agg(F.max_by(F.struct("balance", "last_seq", "batch"), "batch").alias("_now"))
        return newest.select(*KEYS, "_now.balance", "_now.last_seq", "_now.batch")

    def write_part(self, rows: DataFrame, kind: str, batch: int) -> tuple[str, int]:
        """Writes rows under a name that no other attempt has; gives the name and the number of rows."""
        name = f"{kind}-{batch:010d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/parts/{name}")
        return name, self.spark.read.parquet(f"{self.path}/parts/{name}").count()

    def commit(self, commit: dict) -> None:
        """Makes a commit the latest one, by a rename."""
        before = self._commits()
        number = int(before[-1].removesuffix(".json")) + 1 if before else 0
        draft = self._path(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        final = self._path(f"{self.path}/commits/{number:010d}.json")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer committed to {self.path}")

    def clean(self) -> None:
        """Removes commits but the last two, and the parts that these do not list."""
        commits = self._commits()
        kept = [self._read_commit(n) for n in commits[-2:]]
        listed = {f for c in kept for f in [c["base"], *[d for d, _ in c["deltas"]]]}
        for name in commits[:-2]:
            self._fs.delete(self._path(f"{self.path}/commits/{name}"), False)
        for name in self._names("parts"):
            if name not in listed:
                self._fs.delete(self._path(f"{self.path}/parts/{name}"), True)


def merge_batch(table: BalanceTable, changed: DataFrame, batch: int, query: str) -> None:
    """Adds the balances that a micro-batch changed. A batch that was committed before is left out: it is the same again."""
    last = table.latest() or {"query": query, "batch": -1, "base": None, "rows": 0, "deltas": []}
    if last["query"] != query:
        raise ValueError(f"{table.path} holds the balances of another checkpoint")
    if last["batch"] >= batch:
        changed.write.format("noop").mode("overwrite").save()  # the stream's own state still has to be brought up
        return
    name, rows = table.write_part(changed.select(*KEYS, "balance", "last_seq", F.lit(batch).cast("long").alias("batch")), "delta", batch)
    now = {**last, "batch": batch, "deltas": [*last["deltas"], [name, rows]]}
    if not last["base"]:
        now = {**now, "base": name, "rows": rows, "deltas": []}
    elif len(now["deltas"]) > MAX_DELTAS or sum(n for _, n in now["deltas"]) > now["rows"]:
        name, rows = table.write_part(table.rows(now), "base", batch)
        now = {**now, "base": name, "rows": rows, "deltas": []}
    table.commit(now)
    table.clean()


def current_balances(spark: SparkSession, path: str) -> DataFrame:
    """Balances from the table that `run_ledger_stream` keeps, as of its latest commit."""
    table = BalanceTable(spark, path)
    commit = table.latest()
    if commit is None:
        raise FileNotFoundError(f"no balances at {path}")
    return table.rows(commit).select(*KEYS, "balance", "last_seq")


def run_ledger_stream(events: DataFrame, out: str, checkpoint: str) -> None:
    """Process all available events and merge the balances each micro-batch changes into the table at `out`.

    The table belongs to the checkpoint: batches of another one are refused, as their numbers would mean other events.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        merge_batch(BalanceTable(spark, out), batch, batch_id, query)

    query = (
        balances(events).writeStream.outputMode("update").foreachBatch(upsert)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
