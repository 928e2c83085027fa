"""Merkle manifest of a table: a tree per group, a tree over their roots, and proofs climbed by a recursive query.

Rows become leaves in a total order, every `FANOUT` consecutive nodes become their hash, level by level; each level is one
shuffle. Built levels are stored as rows that name their parent and hold the digests beside them, so that a proof is
climbed by following links: a recursive query starts at every leaf with the digest claimed for it, joins its node, takes
the siblings, folds the digest and goes on at the parent until there is none. A row of the recursion holds the siblings of
its own level only; those of a leaf are put together at the end.

All digests are SHA-256 and hashed as lower-case hex text; tables keep them as 32 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import broadcast_if_small, ranked, written

FANOUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: A node's place is its level times this plus its position.
LEVEL = 2**56
TOP = -1
SMALL_ROWS = 20_000


def _hash(*digests: Column) -> Column:
    """Digest of digests; an argument may hold several in a row."""
    return F.unhex(F.sha2(F.lower(F.concat(*[F.hex(d) for d in digests])).cast("binary"), 256))


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of values, each written as its byte count, a colon and itself, or '-' if null."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


@dataclass
class Manifest:
    """A built manifest; all four tables are stored ones.

    `leaves`: leaf_no, row (payload), digest, tree, place, left, right, p_tree, p_place (null for a group's only leaf);
    `nodes`, all others but the root: tree, place, left, right, p_tree, p_place; `subroots`: tree, group, digest;
    `root`: hex, None for an empty table.
    """

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def _runs(level: DataFrame, n: int, payload: list[str]) -> DataFrame:
    """The runs of a level: tree, size, parent, run (an array of at most FANOUT nodes in order)."""
    node = F.struct("pos", "digest", "key_tree", "key_place", *payload)
    runs = level.groupBy("tree", "size", F.floor(F.col("pos") / FANOUT).alias("parent"))
    return written(runs.agg(F.sort_array(F.collect_list(node)).alias("run")), f"merkle-level-{n}")


def _joined(run: str) -> Column:
    return F.expr(f"aggregate({run}, cast('' as binary), (a, x) -> concat(a, x.digest))")


def _linked(runs: DataFrame, n: int, payload: list[str]) -> DataFrame:
    """One row per node of the runs, with the digests before and after it and its parent."""
    rows = runs.select("tree", "parent", "run", F.posexplode("run").alias("i", "node"))
    return rows.select(
        F.col("node.key_tree").alias("tree"), F.col("node.key_place").alias("place"),
        _joined("slice(run, 1, i)").alias("left"), _joined(f"slice(run, i + 2, {FANOUT})").alias("right"),
        F.col("tree").alias("p_tree"), (F.lit((n + 1) * LEVEL) + F.col("parent")).alias("p_place"),
        *[F.col(f"node.{c}").alias(c) for c in payload],
    )


def _grown(level: DataFrame, largest: int, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The linked rows of every level, the lowest with its payload, and the roots: tree, digest, key_tree, key_place."""
    links, roots, n = [], [], 0
    keys = ["tree", "digest", "key_tree", "key_place"]
    while largest > FANOUT**n:
        roots.append(level.where(F.col("size") <= FANOUT**n).select(*keys))
        runs = _runs(level.where(F.col("size") > FANOUT**n), n, payload)
        links.append(_linked(runs, n, ["digest", *payload] if payload else []))
        level = runs.select(
            "tree", "size", F.col("parent").alias("pos"), _hash(_joined("run")).alias("digest"),
            F.col("tree").alias("key_tree"), (F.lit((n + 1) * LEVEL) + F.col("parent")).alias("key_place"),
        )
        payload, n = [], n + 1
    return links, reduce(DataFrame.unionByName, roots, level.select(*keys))


def build(rows: DataFrame) -> Manifest:
    """The trees of `rows`: group (null is a group, and the first), order (any orderable type, nulls first), digest, row (payload).

    Leaves ascend by order and then by digest, so equal rows may stand in any order. Groups are ordered by their UTF-8
    bytes. A group of one leaf has it as subroot, and a single group its subroot as root.
    """
    key = ["no_group", "group_key"]
    keyed = rows.select(F.col("group").isNull().alias("no_group"), F.coalesce("group", F.lit("")).alias("group_key"), "order", "digest", "row")
    keyed = written(keyed, "merkle-rows")
    sizes = written(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("size")), "merkle-groups")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count(F.lit(1)).alias("trees")).first()
    numbered = ranked(sizes.withColumn("all", F.lit(0)), ["all"], [(~F.col("no_group")).asc(), F.col("group_key").asc()], "tree", total["trees"])
    trees = written(numbered.select(*key, "size", "tree"), "merkle-trees")
    placed = ranked(keyed, key, [F.col("order").asc_nulls_first(), F.col("digest").asc()], "pos", total["n"])
    placed = placed.join(broadcast_if_small(trees, SMALL_ROWS), key)
    level = placed.select("tree", "size", "pos", "digest", F.col("tree").alias("key_tree"), F.col("pos").alias("key_place"), "row")
    links, roots = _grown(level, total["largest"], ["row"])
    named = roots.join(broadcast_if_small(trees.drop("size"), SMALL_ROWS), "tree")
    named = written(named.select("tree", F.when(~F.col("no_group"), F.col("group_key")).alias("group"), "digest", "key_tree", "key_place"), "merkle-subroots")
    top = named.select(F.lit(TOP).cast("long").alias("tree"), F.lit(total["trees"]).cast("long").alias("size"), F.col("tree").alias("pos"), "digest", "key_tree", "key_place")
    upper, last = _grown(top, total["trees"], [])
    nothing, unlinked = F.lit("").cast("binary"), F.lit(None).cast("long")
    alone = level.where("size = 1").select(
        "tree", F.col("pos").alias("place"), nothing.alias("left"), nothing.alias("right"), unlinked.alias("p_tree"), unlinked.alias("p_place"), "digest", "row"
    )
    leaves = written(reduce(DataFrame.unionByName, links[:1], alone).withColumn("leaf_no", F.monotonically_increasing_id()), "merkle-leaf-links")
    none = alone.where("false").drop("digest", "row")
    nodes = written(reduce(DataFrame.unionByName, [*links[1:], *upper], none), "merkle-nodes")
    root = last.select(F.lower(F.hex("digest"))).first()
    return Manifest(leaves, nodes, named.select("tree", "group", "digest"), root[0] if root else None)


CLIMB = f"""
with recursive climb(leaf_no, tree, place, step, folded, beside) as (
  select leaf_no, tree, place, 0, folded, beside from {{anchor}}
  union all
  select c.leaf_no, n.p_tree, n.p_place, c.step + 1, unhex(sha2(cast(lower(concat(hex(n.left), hex(c.folded), hex(n.right))) as binary), 256)), concat(n.left, n.right)
  from climb c join {{nodes}} n on c.tree = n.tree and c.place = n.place
) select leaf_no, step, folded, beside from climb"""
#: Rows of a recursion that Spark refuses to pass by default; a climb has one per leaf and level.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def climbed(manifest: Manifest, claim: Column) -> DataFrame:
    """leaf_no, proof (the siblings' digests in order, 32 bytes each) and folded, the root that follows from `claim`.

    `claim` is a digest over the columns of `leaves`. The first step needs no join, as a leaf's row has its siblings.
    """
    spark = manifest.leaves.sparkSession
    linked = F.col("p_tree").isNotNull()
    anchor = manifest.leaves.select(
        "leaf_no", F.coalesce("p_tree", "tree").alias("tree"), F.coalesce("p_place", "place").alias("place"),
        F.when(linked, _hash(F.col("left"), claim, F.col("right"))).otherwise(claim).alias("folded"), F.concat("left", "right").alias("beside"),
    )
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        steps = written(spark.sql(CLIMB, anchor=anchor, nodes=manifest.nodes), "merkle-climb")
    finally:
        spark.conf.set(ROW_LIMIT, before) if before else spark.conf.unset(ROW_LIMIT)
    ends = steps.groupBy("leaf_no").agg(F.sort_array(F.collect_list(F.struct("step", "beside"))).alias("all"), F.max_by("folded", "step").alias("folded"))
    return ends.select("leaf_no", "folded", F.expr("aggregate(all, cast('' as binary), (a, x) -> concat(a, x.beside))").alias("proof"))


def tampered(text: Column, doc_id: Column) -> Column:
    """The text without its line feeds where 2 divides the CRC-32 of the decimal id; a null id changes nothing."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; one row per row of `docs`.

    Leaves are hashed over `FIELDS`; any of them may be null. A null doc_id comes first in its source. Repeated rows are
    leaves of their own with equal digests. An empty table gives no rows; further columns are ignored.
    """
    fields = [F.col(c) for c in FIELDS]
    forged = leaf_digest([*fields[:-1], tampered(F.col("text"), F.col("doc_id"))])
    rows = docs.select(*FIELDS).select("doc_id", F.col("source").cast("string").alias("group"), F.col("doc_id").alias("order"), leaf_digest(fields).alias("digest"), forged.alias("forged"))
    built = build(rows.select("group", "order", "digest", F.struct("doc_id", "forged").alias("row")))
    text = lambda c: F.lower(F.hex(c))
    subroots = built.subroots.select("tree", text("digest").alias("subroot"))
    out = built.leaves.select("leaf_no", "tree", F.col("row.doc_id").alias("doc_id"), text("digest").alias("leaf"))
    out = out.join(climbed(built, F.col("row.forged")), "leaf_no").join(broadcast_if_small(subroots, SMALL_ROWS), "tree")
    root = F.lit(built.root).cast("string")
    return out.select(
        "doc_id", "leaf", "subroot", root.alias("root"), F.sha2(text("proof").cast("binary"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"), (text("folded") == root).alias("verified"),
    )


def oracle_sql() -> str:
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda t: " || ".join([*[field(c) for c in FIELDS[:-1]], field(t)])
    grow = f"""select tree, lvl + 1, pos // {FANOUT}, sha256(string_agg(digest, '' order by pos)), size from {{0}} where size > pow({FANOUT}, lvl) group by tree, lvl, pos // {FANOUT}, size"""
    run = f"select tree, lvl, pos // {FANOUT} parent, list(digest order by pos) run from {{0}} where size > pow({FANOUT}, lvl) group by tree, lvl, pos // {FANOUT}"
    step = f"""select c.doc_no, c.{{1}} {{2}}, c.lvl + 1, c.pos // {FANOUT}, c.proof || array_to_string(run[:c.pos % {FANOUT}], '') || array_to_string(run[c.pos % {FANOUT} + 2:], ''),
  sha256(array_to_string(run[:c.pos % {FANOUT}], '') || c.folded || array_to_string(run[c.pos % {FANOUT} + 2:], ''))
  from {{0}} c join {{3}} r on r.tree = c.{{1}} and r.lvl = c.lvl and r.parent = c.pos // {FANOUT}"""
    return f"""
with recursive crc_table as (select list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) t),
drawn as (select d.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda s: cast(ascii(s) as bigint))),
    lambda a, b: xor(a >> 8, t[cast(xor(a, b) & 255 as int) + 1])), 4294967295) crc from documents d, crc_table),
changed as (select *, case when crc % 2 = 0 then replace(text, chr(10), '') else text end other from drawn),
hashed as (select row_number() over () doc_no, doc_id, dense_rank() over (order by source nulls first) - 1 tree, sha256({leaf('text')}) digest, sha256({leaf('other')}) forged from changed),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 pos, count(*) over (partition by tree) size from hashed),
levels(tree, lvl, pos, digest, size) as (select tree, 0, pos, digest, size from leaves union all {grow.format('levels')}),
subroots as (select tree, digest from levels where size <= pow({FANOUT}, lvl)),
top(tree, lvl, pos, digest, size) as (select 0, 0, tree, digest, (select count(*) from subroots) from subroots union all {grow.format('top')}),
roots as (select digest root from top where size <= pow({FANOUT}, lvl)),
runs as ({run.format('levels')}),
top_runs as ({run.format('top')}),
climb(doc_no, tree, lvl, pos, proof, folded) as (select doc_no, tree, 0, pos, '', forged from leaves union all {step.format('climb', 'tree', '', 'runs')}),
ends as (select * from climb qualify row_number() over (partition by doc_no order by lvl desc) = 1),
climb_top(doc_no, tree, lvl, pos, proof, folded) as (select doc_no, 0, 0, tree, proof, folded from ends union all {step.format('climb_top', 'tree', '', 'top_runs')}),
done as (select * from climb_top qualify row_number() over (partition by doc_no order by lvl desc) = 1)
select l.doc_id, l.digest leaf, s.digest subroot, root, sha256(proof) proof_sha256, folded folded_root, folded = root verified
  from leaves l join subroots s using (tree) join done using (doc_no), roots"""
