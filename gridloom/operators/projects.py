"""Project demand, requirements and pattern membership.

Tables: projects (project_id, warehouse_id, …), patterns or members (pattern_id,
project_id, status, …), key_counts (pattern_id, color_key, count) from legends,
grid_counts (pattern_id, hex, color_key, count) from grids, items as in the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import keys

ACTIVE = ["draft", "in_progress"]


def project_demand(patterns: DataFrame, key_counts: DataFrame, grid_counts: DataFrame, items: DataFrame) -> DataFrame:
    """Colours the active patterns of each project need, by (hex, colour code).

    A pattern with legend counts uses them, with the hex from its warehouse's stock or a
    stand-in; any other pattern uses its grid counts. Counts are summed per project and
    code before the stock is joined.
    """
    active = patterns.where(F.col("status").isin(ACTIVE)).select("pattern_id", "project_id", "warehouse_id")
    keyed = key_counts.where("count > 0")
    by_key = active.join(keyed, "pattern_id").groupBy("project_id", "warehouse_id", "color_key").agg(F.sum("count").alias("count"))
    known = items.groupBy("warehouse_id", F.upper("color_key").alias("_key")).agg(F.max_by(F.upper("hex"), "item_idx").alias("_hex"))
    named = by_key.withColumn("_key", F.upper("color_key")).join(known, ["warehouse_id", "_key"], "left").select(
        "project_id", F.coalesce("_hex", keys.fallback_hex(F.col("color_key"))).alias("hex"), "color_key", "count"
    )
    from_grid = (
        active.join(keyed.select("pattern_id").distinct(), "pattern_id", "left_anti")
        .join(grid_counts.where("count > 0"), "pattern_id")
        .groupBy("project_id", F.upper("hex").alias("hex"), "color_key").agg(F.sum("count").alias("count"))
    )
    return named.unionByName(from_grid).groupBy("project_id", "hex", "color_key").agg(F.sum("count").alias("needed"))


def project_demand_by_hex(patterns: DataFrame, grid_counts: DataFrame) -> DataFrame:
    """Demand from grid counts by hex alone; the code is the first non-empty one in pattern order."""
    active = patterns.where(F.col("status").isin(ACTIVE)).select("pattern_id", "project_id")
    code = F.nullif("color_key", F.lit(""))
    return active.join(grid_counts, "pattern_id").groupBy("project_id", F.upper("hex").alias("hex")).agg(
        F.sum("count").alias("needed"),
        F.coalesce(F.min_by(code, F.when(code.isNotNull(), F.struct("pattern_id", code))), F.lit("")).alias("color_key"),
    )


def requirements(demand: DataFrame, projects: DataFrame, items: DataFrame) -> DataFrame:
    """Demand against the stock of the project's warehouse, matched by hex; the last item of a hex counts."""
    have = items.where("hex <> ''").groupBy("warehouse_id", F.upper("hex").alias("hex")).agg(
        F.max_by(F.struct(F.col("color_key").alias("k"), F.col("owned").alias("n")), "item_idx").alias("_s")
    )
    owned = F.coalesce("_s.n", F.lit(0))
    return (
        demand.join(projects.select("project_id", "warehouse_id"), "project_id")
        .join(have, ["warehouse_id", "hex"], "left")
        .select(
            "project_id", "warehouse_id", "hex", F.coalesce(F.nullif("color_key", F.lit("")), "_s.k", F.lit("")).alias("color_key"),
            "needed", owned.alias("owned"), F.greatest(F.lit(0), F.col("needed") - owned).alias("missing"),
            (owned - F.col("needed")).alias("remaining"),
        )
    )


def requirement_summary(required: DataFrame) -> DataFrame:
    return required.groupBy("project_id").agg(
        F.sum("needed").alias("total_needed"), F.sum(F.least("needed", "owned")).alias("total_owned"),
        F.sum("missing").alias("total_missing"), F.count(F.lit(1)).alias("colors_needed"),
        F.count_if(F.col("missing") > 0).alias("missing_colors"),
    )


def missing_items(required: DataFrame) -> DataFrame:
    """What is short, the largest gap first."""
    return required.where("missing > 0").orderBy("project_id", F.desc("missing"), *keys.color_key_order(F.col("color_key")))


def derive_status(projects: DataFrame, patterns: DataFrame) -> DataFrame:
    stats = patterns.groupBy("project_id").agg(
        F.bool_or(F.col("status") == "in_progress").alias("_run"), F.bool_and(F.col("status") == "completed").alias("_done")
    )
    status = F.when(F.col("_run"), "in_progress").when(F.col("_done"), "completed").otherwise("draft")
    return projects.select("project_id").join(stats, "project_id", "left").select("project_id", status.alias("status"))


def project_list(projects: DataFrame, patterns: DataFrame, summary: DataFrame) -> DataFrame:
    """Projects with pattern count, bead total, first thumbnail and shortage, newest first."""
    shown = F.nullif("thumbnail", F.lit(""))
    per = patterns.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("bead_total").alias("_beads"),
        F.min_by(shown, F.when(shown.isNotNull(), F.struct("added_at", "pattern_id"))).alias("thumbnail"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        projects.join(per, "project_id", "left").join(summary, "project_id", "left")
        .select(
            "project_id", "name", "updated_at", zero("_n").alias("pattern_count"), zero("_beads").alias("bead_total"),
            zero("total_needed").alias("total_needed"), zero("total_missing").alias("total_missing"), "thumbnail",
        )
        .orderBy(F.desc("updated_at"), "project_id")
    )


def pattern_owners(assignments: DataFrame, members: DataFrame) -> DataFrame:
    """Project holding each pattern: the assignment first, else the membership."""
    a = assignments.select("pattern_id", F.col("project_id").alias("_a"))
    m = members.groupBy("pattern_id").agg(F.max("project_id").alias("_m"))
    return a.join(m, "pattern_id", "full").select("pattern_id", F.coalesce("_a", "_m").alias("owner_id"))


def available_patterns(
    patterns: DataFrame, assignments: DataFrame, members: DataFrame, project_id=None, hide_own: bool = False
) -> DataFrame:
    """Patterns no other project holds; `hide_own` also drops those already in the project."""
    owned = patterns.join(pattern_owners(assignments, members), "pattern_id", "left")
    free = owned.where(F.col("owner_id").isNull() | F.coalesce(F.col("owner_id") == F.lit(project_id), F.lit(False)))
    if hide_own:
        free = free.join(members.where(F.col("project_id") == F.lit(project_id)), "pattern_id", "left_anti")
    return free.drop("owner_id")


def add_patterns(
    requests: DataFrame, patterns: DataFrame, assignments: DataFrame, members: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Patterns to add to projects, and violations.

    A project's request is refused as a whole when one of its patterns is assigned to
    another project, asked for earlier in the batch by another one, or unknown. Patterns
    it already has are skipped.
    """
    asked = requests.where("pattern_id is not null").select("project_id", "pattern_id").distinct()
    taken = assignments.select("pattern_id", F.col("project_id").alias("_a"))
    present = members.select("project_id", "pattern_id").distinct().withColumn("_in", F.lit(True))
    holder = members.groupBy("pattern_id").agg(F.max("project_id").alias("_m"))
    first = asked.groupBy("pattern_id").agg(F.min("project_id").alias("_first"))
    known = patterns.select("pattern_id").distinct().withColumn("_known", F.lit(True))
    state = (
        asked.join(taken, "pattern_id", "left").join(present, ["project_id", "pattern_id"], "left")
        .join(holder, "pattern_id", "left").join(first, "pattern_id").join(known, "pattern_id", "left")
    )
    other = F.coalesce(F.col("_a") != F.col("project_id"), F.lit(False))
    free = F.col("_known") & F.col("_a").isNull() & F.col("_m").isNull()
    reason = (
        F.when(other, "assigned_elsewhere").when(F.col("_in"), F.lit(None))
        .when(~F.coalesce(free, F.lit(False)), "not_available").when(F.col("_first") != F.col("project_id"), "assigned_elsewhere")
    )
    checked = state.withColumn("reason", reason)
    violations = checked.where("reason is not null").select("project_id", "pattern_id", "reason")
    accepted = checked.where(F.col("reason").isNull() & F.col("_in").isNull()).join(
        violations.select("project_id").distinct(), "project_id", "left_anti"
    )
    return accepted.select("project_id", "pattern_id", F.lit("draft").alias("status")), violations


def _refused(checked: DataFrame) -> DataFrame:
    return checked.where("reason is not null").select("project_id", "pattern_id", "reason")


def remove_patterns(
    requests: DataFrame, members: DataFrame, assignments: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members and assignments after removals, and violations; only drafts can be removed."""
    asked = requests.select("project_id", "pattern_id").distinct()
    hit = members.join(asked, ["project_id", "pattern_id"], "left_semi")
    bad = _refused(hit.where("status <> 'draft'").withColumn("reason", F.lit("not_draft")))
    go = asked.join(bad.select("project_id").distinct(), "project_id", "left_anti")
    on = ["project_id", "pattern_id"]
    return members.join(go, on, "left_anti"), assignments.join(go, on, "left_anti"), bad


def move_patterns(requests: DataFrame, members: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Change the status of patterns (project_id, pattern_id, target): members and violations.

    Patterns whose stock was deducted only go to completed; the completion time is kept,
    set or cleared with the status.
    """
    asked = requests.select("project_id", "pattern_id", keys.normalize_status(F.col("target")).alias("_to"))
    hit = members.join(asked, ["project_id", "pattern_id"])
    locked = hit.where(F.col("is_deducted") & (F.col("_to") != "completed")).withColumn("reason", F.lit("stock_deducted"))
    found = hit.select("project_id").distinct()
    lost = asked.join(found, "project_id", "left_anti").withColumn("reason", F.lit("no_pattern_found"))
    violations = _refused(locked).unionByName(_refused(lost))
    go = asked.join(_refused(locked).select("project_id").distinct(), "project_id", "left_anti")
    moved = members.join(go, ["project_id", "pattern_id"], "left")
    done = F.when(F.col("_to") == "completed", F.coalesce("completed_at", now))
    return moved.select(
        *[
            F.coalesce("_to", "status").alias(c) if c == "status"
            else F.when(F.col("_to").isNull(), F.col("completed_at")).otherwise(done).alias(c) if c == "completed_at"
            else c
            for c in members.columns
        ]
    ), violations


def patterns_by_status(patterns: DataFrame) -> DataFrame:
    """Pattern counts per project, one column per state."""
    return patterns.groupBy("project_id").pivot("status", ["draft", "in_progress", "completed"]).agg(F.count(F.lit(1))).na.fill(0)


# --- life cycle -------------------------------------------------------------

def create_projects(requests: DataFrame, warehouses: DataFrame, projects: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New projects of requests (project_id, name, warehouse_id), and violations (project_id, reason).

    A project needs a name, an existing warehouse and an id of its own; it starts as a draft and keeps what its
    warehouse is called now. Of several requests for one id none is carried out.
    """
    houses = warehouses.select("warehouse_id", F.col("name").alias("warehouse_name"), "brand", "palette_name")
    known = projects.select("project_id").distinct().withColumn("_known", F.lit(True))
    times = requests.groupBy("project_id").agg(F.count(F.lit(1)).alias("_times"))
    title = keys.trim_all(F.col("name"))
    asked = requests.select("project_id", title.alias("name"), "warehouse_id").join(houses, "warehouse_id", "left")
    asked = asked.join(known, "project_id", "left").join(times, "project_id")
    reason = (
        F.when(F.coalesce("name", F.lit("")) == "", "empty_name").when(F.col("warehouse_name").isNull(), "unknown_warehouse")
        .when(F.col("_known") | (F.col("_times") > 1), "id_taken")
    )
    checked = asked.withColumn("reason", reason)
    created = checked.where("reason is null").select(
        "project_id", "name", "warehouse_id", "warehouse_name", "brand", "palette_name", F.lit("draft").alias("status"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    return created, checked.where("reason is not null").select("project_id", "reason")


def rename_projects(requests: DataFrame, projects: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Projects after requests (project_id, request_seq, name), and violations (project_id, request_seq, reason).

    The last valid request of a project counts; others leave its name and time of change alone.
    """
    known = projects.select("project_id").distinct().withColumn("_known", F.lit(True))
    asked = requests.select("project_id", "request_seq", keys.trim_all(F.col("name")).alias("name")).join(known, "project_id", "left")
    reason = F.when(F.coalesce("name", F.lit("")) == "", "empty_name").when(F.col("_known").isNull(), "unknown_project")
    checked = asked.withColumn("reason", reason)
    last = checked.where("reason is null").groupBy("project_id").agg(F.max_by("name", "request_seq").alias("_name"))
    renamed = projects.join(last, "project_id", "left").select(
        *[
            F.coalesce("_name", "name").alias(c) if c == "name" else F.when(F.col("_name").isNull(), F.col(c)).otherwise(now).alias(c) if c == "updated_at" else c
            for c in projects.columns
        ]
    )
    return renamed, checked.where("reason is not null").select("project_id", "request_seq", "reason")


def delete_projects(
    requests: DataFrame, projects: DataFrame, members: DataFrame, assignments: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Projects, members and assignments after requests (project_id, confirm_name), and violations.

    A request must repeat the project's name. With a project go its members and the assignments of its patterns, which
    are free for other projects then.
    """
    names = projects.select("project_id", F.col("name").alias("_name"), F.lit(True).alias("_known"))
    asked = requests.select("project_id", "confirm_name").distinct().join(names, "project_id", "left")
    reason = F.when(F.col("_known").isNull(), "unknown_project").when(~F.col("confirm_name").eqNullSafe(F.col("_name")), "name_mismatch")
    checked = asked.withColumn("reason", reason)
    gone = checked.where("reason is null").select("project_id").distinct()
    left = lambda df: df.join(gone, "project_id", "left_anti").select(*df.columns)
    return left(projects), left(members), left(assignments), checked.where("reason is not null").select("project_id", "reason")
