"""Colour stock as an append-only ledger.

Tables: items (warehouse_id, item_idx, color_key, hex, owned, is_extra), transactions
(warehouse_id, txn_id, seq), entries (txn_id, color_key, delta). Operations that may
refuse return the result and a table of violations; one bad warehouse never stops a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import keys
from gridloom.operators.sizing import lookup_side, running_sum_in_blocks

# Palette sets a warehouse can be created from.
WAREHOUSE_PALETTES = ["96", "144", "291"]
RECENT_TRANSACTIONS = 5


def create_warehouses(requests: DataFrame, palette: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of new warehouses: every colour of the palette set with the initial count."""
    reason = (
        F.when(keys.trim_all(F.col("name")) == "", "empty_name")
        .when(~F.coalesce(F.col("palette_name").isin(WAREHOUSE_PALETTES), F.lit(False)), "unknown_palette")
        .when(F.coalesce(F.col("owned_count") < 0, F.lit(True)), "bad_count")
    )
    checked = requests.withColumn("reason", reason)
    items = checked.where("reason is null").join(lookup_side(palette), "palette_name").select(
        "warehouse_id", F.col("ord").alias("item_idx"), "color_key", "hex", F.col("owned_count").alias("owned"),
        F.lit(False).alias("is_extra"),
    )
    return items, checked.where("reason is not null").select("warehouse_id", "reason")


def upsert_warehouses(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace or add warehouses by id; the creation time of a replaced one survives."""
    born = existing.select("warehouse_id", F.col("created_at").alias("_born"))
    fresh = incoming.join(born, "warehouse_id", "left").withColumn("created_at", F.coalesce("_born", "created_at"))
    kept = existing.join(incoming, "warehouse_id", "left_anti")
    return kept.unionByName(fresh.select(*existing.columns))


def replace_items(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Items after an upsert: a replaced warehouse keeps none of its old items."""
    return existing.join(incoming.select("warehouse_id").distinct(), "warehouse_id", "left_anti").unionByName(incoming)


def _entry(delta: Column, before: Column, after: Column) -> list[Column]:
    return [delta.alias("delta"), before.alias("before"), after.alias("after")]


def adjust_stock(items: DataFrame, adjustments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Set counts (warehouse_id, color_key, owned_count): new items, ledger rows, violations."""
    asked = adjustments.select(
        "warehouse_id", keys.normalize_color_key(F.col("color_key")).alias("color_key"), F.col("owned_count").alias("_to")
    )
    known = asked.join(items, ["warehouse_id", "color_key"], "left")
    whole = F.coalesce((F.col("_to") >= 0) & (F.col("_to") == F.floor("_to")), F.lit(False))
    reason = F.when(~whole, "bad_count").when(F.col("owned").isNull(), "unknown_item")
    checked = known.withColumn("reason", reason)
    good = checked.where("reason is null").withColumn("_to", F.col("_to").cast("bigint"))
    rows = good.where(F.col("_to") != F.col("owned")).select(
        "warehouse_id", "color_key", "hex", *_entry(F.col("_to") - F.col("owned"), F.col("owned"), F.col("_to"))
    )
    changed = items.join(good.select("warehouse_id", "color_key", "_to"), ["warehouse_id", "color_key"], "left")
    result = changed.withColumn("owned", F.coalesce("_to", "owned")).select(*items.columns)
    return result, rows, checked.where("reason is not null").select("warehouse_id", "color_key", "reason")


def merge_replenish(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sum restock entries per warehouse and code. A non-positive count refuses its warehouse's
    whole request, as does a request without any usable entry; blank codes are skipped."""
    named = entries.withColumn("color_key", keys.normalize_color_key(F.col("color_key")))
    usable = named.where("color_key <> ''")
    bad = usable.where(F.coalesce(F.col("count") <= 0, F.lit(True))).select(
        "warehouse_id", "color_key", F.lit("bad_count").alias("reason")
    ).distinct()
    empty = named.groupBy("warehouse_id").agg(F.bool_and(F.col("color_key") == "").alias("_none")).where("_none").select(
        "warehouse_id", F.lit("").alias("color_key"), F.lit("nothing_to_import").alias("reason")
    )
    merged = usable.groupBy("warehouse_id", "color_key").agg(F.sum("count").alias("count"))
    return merged.join(bad.select("warehouse_id").distinct(), "warehouse_id", "left_anti"), bad.unionByName(empty)


def replenish(items: DataFrame, merged: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add merged counts: new items, ledger rows, violations.

    A colour the warehouse lacks is taken from the catalogue and added as an extra one; a
    code outside the catalogue refuses the warehouse's whole request.
    """
    known = merged.join(
        lookup_side(catalogue.select("color_key", F.col("ord").alias("_ord"), F.col("hex").alias("_hex"))), "color_key", "left"
    )
    unknown = known.where(F.col("_hex").isNull()).select("warehouse_id", "color_key", F.lit("unknown_color").alias("reason"))
    add = known.join(unknown.select("warehouse_id").distinct(), "warehouse_id", "left_anti")
    both = items.join(add, ["warehouse_id", "color_key"], "full")
    before = F.coalesce("owned", F.lit(0))
    after = before + F.coalesce("count", F.lit(0))
    last = items.groupBy("warehouse_id").agg(F.max("item_idx").alias("_last"))
    result = both.join(last, "warehouse_id", "left").select(
        "warehouse_id",
        F.coalesce("item_idx", F.coalesce("_last", F.lit(-1)) + 1 + F.col("_ord")).alias("item_idx"),
        "color_key", F.coalesce("hex", "_hex").alias("hex"), after.alias("owned"),
        F.coalesce("is_extra", F.lit(True)).alias("is_extra"),
    )
    rows = both.where(F.col("count").isNotNull()).select(
        "warehouse_id", "color_key", F.coalesce("hex", "_hex").alias("hex"), *_entry(F.col("count"), before, after)
    )
    return result, rows, unknown


def replenish_preview(texts: DataFrame, items: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read pasted restock lists (warehouse_id, doc_id, text): merged entries and unreadable lines.

    Flags say whether the warehouse has the colour and whether it is outside its base palette.
    """
    lines = texts.select(
        "warehouse_id", "doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("_pos", "_raw")
    ).select("warehouse_id", "doc_id", (F.col("_pos") + 1).alias("line_number"), keys.trim_all(F.col("_raw")).alias("line"))
    parsed = lines.where("line <> ''").withColumn("_e", keys.parse_replenish_line(F.col("line")))
    known = lookup_side(catalogue.select("color_key", "hex"))
    read = parsed.select("*", F.col("_e.color_key").alias("color_key"), F.col("_e.count").alias("count")).join(known, "color_key", "left")
    reason = (
        F.when(F.col("_e").isNull(), "unreadable").when(F.coalesce(F.col("count") <= 0, F.lit(True)), "count_not_positive")
        .when(F.col("hex").isNull(), "unknown_color")
    )
    checked = read.withColumn("reason", reason)
    merged = checked.where("reason is null").groupBy("warehouse_id", "color_key").agg(
        F.sum("count").alias("count"), F.first("hex").alias("hex"), F.count(F.lit(1)).alias("line_count")
    )
    owned = items.select(
        "warehouse_id", keys.normalize_color_key(F.col("color_key")).alias("color_key"), (~F.col("is_extra")).alias("_base")
    ).groupBy("warehouse_id", "color_key").agg(F.bool_or("_base").alias("_base"))
    entries = merged.join(owned, ["warehouse_id", "color_key"], "left").select(
        "warehouse_id", "color_key", "count", "hex", "line_count",
        F.col("_base").isNotNull().alias("already_in_warehouse"), (~F.coalesce("_base", F.lit(False))).alias("is_extra"),
    )
    return entries, checked.where("reason is not null").select("warehouse_id", "doc_id", "line_number", "line", "reason")


def rollback_transactions(
    items: DataFrame, transactions: DataFrame, entries: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take back one transaction per warehouse: new items, remaining transactions, violations.

    Refused: an unknown transaction, one of another warehouse, a colour the warehouse
    lacks, a count that would fall below zero, several requests for one warehouse (their
    order would matter). A transaction lists a colour once; zero deltas are ignored.
    """
    asked = requests.select("warehouse_id", "txn_id")
    crowded = asked.groupBy("warehouse_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("warehouse_id", F.lit(True).alias("_many"))
    owner = transactions.select("txn_id", F.col("warehouse_id").alias("_owner"))
    found = asked.join(owner, "txn_id", "left").join(crowded, "warehouse_id", "left")
    first_reason = (
        F.when(F.col("_many"), "several_requests").when(F.col("_owner").isNull(), "unknown_transaction")
        .when(F.col("_owner") != F.col("warehouse_id"), "other_warehouse")
    )
    found = found.withColumn("reason", first_reason)
    moves = (
        found.where("reason is null").join(entries.where("delta <> 0"), "txn_id")
        .groupBy("warehouse_id", "txn_id", keys.normalize_color_key(F.col("color_key")).alias("color_key"))
        .agg(F.sum("delta").alias("_delta"))
        .join(items.select("warehouse_id", "color_key", "owned"), ["warehouse_id", "color_key"], "left")
    )
    step = F.when(F.col("owned").isNull(), "unknown_color").when(F.col("owned") - F.col("_delta") < 0, "negative_stock")
    blocked = moves.groupBy("warehouse_id", "txn_id").agg(F.max(step).alias("reason")).where("reason is not null")
    violations = found.where("reason is not null").select("warehouse_id", "txn_id", "reason").unionByName(blocked)
    undo = moves.join(blocked, ["warehouse_id", "txn_id"], "left_anti").select("warehouse_id", "color_key", "_delta")
    result = items.join(undo, ["warehouse_id", "color_key"], "left").withColumn(
        "owned", F.col("owned") - F.coalesce("_delta", F.lit(0))
    ).select(*items.columns)
    done = found.where("reason is null").join(blocked, ["warehouse_id", "txn_id"], "left_anti")
    return result, transactions.join(done, "txn_id", "left_anti"), violations


def delete_warehouses(
    warehouses: DataFrame, items: DataFrame, transactions: DataFrame, projects: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Delete warehouses no project is bound to, with their items and transactions; then violations."""
    asked = requests.select("warehouse_id").distinct()
    bound = projects.join(asked, "warehouse_id", "left_semi").groupBy("warehouse_id").agg(F.count(F.lit(1)).alias("n_projects"))
    known = warehouses.select("warehouse_id", F.lit(True).alias("_known"))
    checked = asked.join(known, "warehouse_id", "left").join(bound, "warehouse_id", "left").withColumn(
        "reason", F.when(F.col("_known").isNull(), "unknown_warehouse").when(F.col("n_projects") > 0, "bound_to_project")
    )
    # The same few keys are taken from every table: with them broadcast, no table is moved to as many places as it has warehouses.
    gone = lookup_side(checked.where("reason is null").select("warehouse_id"), asked)
    kept = [t.join(gone, "warehouse_id", "left_anti") for t in (warehouses, items, transactions)]
    violations = checked.where("reason is not null").select("warehouse_id", "reason", F.coalesce("n_projects", F.lit(0)).alias("n_projects"))
    return (*kept, violations)


def running_balance(ledger: DataFrame) -> DataFrame:
    """Balance before and after each ledger row (warehouse_id, color_key, seq, delta), in arrival order."""
    total = running_sum_in_blocks(ledger, ["warehouse_id", "color_key"], "seq", "delta", "after")
    return total.withColumn("before", F.col("after") - F.col("delta"))


def recent_transactions(transactions: DataFrame, n: int = RECENT_TRANSACTIONS) -> DataFrame:
    """The latest transactions per warehouse by arrival, newest first."""
    latest = Window.partitionBy("warehouse_id").orderBy(F.desc("seq"))
    return transactions.withColumn("recency", F.row_number().over(latest)).where(F.col("recency") <= n)


def net_change(entries: DataFrame) -> DataFrame:
    return entries.groupBy("txn_id").agg(F.sum("delta").alias("net_change"), F.count(F.lit(1)).alias("n_entries"))


def stock_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("warehouse_id").agg(
        F.sum("owned").alias("total_owned"), F.count(F.lit(1)).alias("n_colors"), F.count_if("is_extra").alias("n_extra")
    )


def color_series_counts(items: DataFrame) -> DataFrame:
    """Colours per letter prefix of each warehouse."""
    named = items.withColumn("prefix", keys.series_prefix(F.col("color_key")))
    return named.where("prefix <> ''").groupBy("warehouse_id", "prefix").agg(F.count(F.lit(1)).alias("n_colors"))


def warehouse_demand(project_items: DataFrame, items: DataFrame) -> DataFrame:
    """Need per warehouse and code over all bound projects against the stock."""
    need = project_items.withColumn("color_key", keys.normalize_color_key(F.col("color_key"))).where("color_key <> ''")
    total = need.groupBy("warehouse_id", "color_key").agg(
        F.sum("needed").alias("needed"), F.min_by("hex", F.struct("project_id", "hex")).alias("hex")
    )
    have = items.select("warehouse_id", keys.normalize_color_key(F.col("color_key")).alias("color_key"), F.col("owned").alias("_owned"))
    owned = F.coalesce("_owned", F.lit(0))
    return total.join(have, ["warehouse_id", "color_key"], "left").select(
        "warehouse_id", "color_key", "hex", "needed", owned.alias("owned"),
        F.greatest(F.lit(0), F.col("needed") - owned).alias("missing"),
    )


def warehouse_health(warehouses: DataFrame, demand: DataFrame) -> DataFrame:
    """none / ok / needs / severe; severe when a missing colour has no stock or over half are short."""
    short = F.col("missing") > 0
    stats = demand.groupBy("warehouse_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(short).alias("_short"),
        F.bool_or(short & (F.col("owned") == 0)).alias("_empty"),
        F.sum("needed").alias("total_needed"), F.sum("missing").alias("total_missing"),
    )
    health = (
        F.when(F.coalesce("_n", F.lit(0)) == 0, "none").when(F.col("_short") == 0, "ok")
        .when(F.col("_empty") | (F.col("_short") > F.col("_n") * 0.5), "severe").otherwise("needs")
    )
    return warehouses.select("warehouse_id").join(stats, "warehouse_id", "left").select(
        "warehouse_id", health.alias("health"), F.coalesce("_short", F.lit(0)).alias("n_missing"),
        F.coalesce("total_needed", F.lit(0)).alias("total_needed"), F.coalesce("total_missing", F.lit(0)).alias("total_missing"),
    )
