"""SimHash near-duplicates: a self-join of the binary trie of fingerprints.

Two nodes of the trie are walked down together and the bits in which their prefixes differ are added up; a pair of
nodes is dropped once it differs in more bits than allowed, or once all fingerprints below it are known to be one
component, so a dense cloud of copies is never listed pair by pair.

The walk is spread over tasks by its upper levels. If two fingerprints differ in at most three bits, one of their four
16-bit blocks is equal, so four tries, one with each block first, are entered at depth 16 at the pairs of a node with
itself. A task holding more than `MAX_TASK` fingerprints is walked further down in Spark, four levels at a time, into
the tasks of its pairs of child nodes. Tasks return the trees of what they have joined, and star rounds merge them.
Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name, written
from gridloom.operators.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints in one task of the trie walk before it is split, and rows walked at once.
MAX_TASK = 32_768
CHUNK = 65_536
#: Node pairs expanded at once, and the product of sizes below which a node pair is compared outright.
FRONT = 200_000
SMALL = 32
TASK = ["trie", "a", "b", "depth", "spare"]


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's shingles as an unsigned number; zero without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII spaces count
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(size)])) if len(w) >= size else [b" ".join(w)]
    n = max(1, len(w) - size + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Adds `out`: the fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, simhash(text))


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of all i and j; every node then points at its tree's first node."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _pairs(a0, a1, b0, b1):
    """All index pairs of the given pairs of ranges."""
    na, nb = a1 - a0, b1 - b0
    which = np.repeat(np.arange(len(a0)), na * nb)
    k = np.arange(len(which)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
    return a0[which] + k // nb[which], b0[which] + k % nb[which]


def _walk(codes: np.ndarray, tasks: list[tuple], root: np.ndarray, allowed: int) -> None:
    """Walks pairs of trie nodes, each a range of the sorted codes, and joins what differs in at most `allowed` bits.

    tasks: (depth, a0, a1, b0, b1, spare) arrays of node pairs; `spare` bits may still differ out of MAX_BITS.
    """
    stack = [(depth, a0, a1, b0, b1, spare - (MAX_BITS - allowed)) for depth, a0, a1, b0, b1, spare in tasks]
    bit_sums: dict[int, np.ndarray] = {}
    while stack:
        depth, a0, a1, b0, b1, spare = stack.pop()
        changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        one = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (root[a0] == root[b0])
        live = (spare >= 0) & ~one
        if len(a0) > FRONT:
            half = np.arange(len(a0)) < FRONT
            stack.append((depth, *(x[live & ~half] for x in (a0, a1, b0, b1, spare))))
            live &= half
        a0, a1, b0, b1, spare = (x[live] for x in (a0, a1, b0, b1, spare))
        small = (a1 - a0) * (b1 - b0) <= SMALL
        if small.any():
            i, j = _pairs(a0[small], a1[small], b0[small], b1[small])
            near = np.bitwise_count(codes[i] ^ codes[j]) <= allowed
            _unite(root, i[near], j[near])
            a0, a1, b0, b1, spare = (x[~small] for x in (a0, a1, b0, b1, spare))
        if not len(a0):
            continue
        if depth not in bit_sums:
            bit_sums[depth] = np.concatenate([[0], np.cumsum((codes >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        upto = bit_sums[depth]
        am, bm = a1 - (upto[a1] - upto[a0]), b1 - (upto[b1] - upto[b0])
        twin = a0 == b0
        below = [(a0, am, b0, bm, spare, am > a0), (am, a1, bm, b1, spare, am < a1), (a0, am, bm, b1, spare - 1, am > a0), (am, a1, b0, bm, spare - 1, (am < a1) & ~twin)]
        merged = [np.concatenate([part[k][part[5] & (part[3] > part[2]) & (part[4] >= 0)] for part in below]) for k in range(5)]
        if len(merged[0]):
            stack.append((depth + 1, *merged))


def join_tasks(rows: pd.DataFrame) -> pd.DataFrame:
    """u, v: trees over the linked fingerprints of whole tasks (columns of TASK, and code: the turned fingerprint)."""
    key = rows["trie"].to_numpy(), rows["a"].to_numpy().view(np.uint64), rows["b"].to_numpy().view(np.uint64), rows["depth"].to_numpy()
    codes = rows["code"].to_numpy().view(np.uint64)
    order = np.lexsort((codes, key[3], key[2], key[1], key[0]))
    codes, key = codes[order], [k[order] for k in key]
    spare = rows["spare"].to_numpy()[order].astype(np.int64)
    n = len(codes)
    first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
    last = np.append(first[1:], n)
    depth = key[3][first]
    mine = (codes >> (np.uint64(64) - key[3].astype(np.uint64))) << (np.uint64(64) - key[3].astype(np.uint64))
    in_a = np.concatenate([[0], np.cumsum(mine == key[1])])
    # a < b for a pair of different nodes, so its first rows lie under a
    middle = np.where(key[1][first] == key[2][first], last, first + in_a[last] - in_a[first])
    twin = key[1][first] == key[2][first]
    b0 = np.where(twin, first, middle)
    tasks = []
    for d in np.unique(depth):
        at = (depth == d) & (middle > first) & (last > b0)
        tasks.append((int(d), first[at], middle[at], b0[at], last[at], spare[first[at]]))
    root = np.arange(n)
    for allowed in range(1, MAX_BITS + 1):  # the closest first: what they join need not be walked again
        _walk(codes, tasks, root, allowed)
    moved = np.flatnonzero(root != np.arange(n))
    turn = (np.uint64(16) * key[0].astype(np.uint64)) % np.uint64(64)
    plain = np.where(turn == 0, codes, (codes >> turn) | (codes << ((np.uint64(64) - turn) % np.uint64(64))))
    return pd.DataFrame({"u": plain[moved].view(np.int64), "v": plain[root[moved]].view(np.int64)})


def _join_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gathers rows sorted by task up to CHUNK and cuts between tasks, so memory is bounded by CHUNK and MAX_TASK."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        while len(held) > CHUNK:
            keys = held[["trie", "a", "b", "depth"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if not len(cuts):
                break
            early = cuts[cuts <= CHUNK]
            cut = early[-1] if len(early) else cuts[0]
            yield join_tasks(held.iloc[:cut])
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield join_tasks(held)


def _split(tasks: DataFrame) -> DataFrame:
    """The rows of tasks four levels deeper, once for each pair of child nodes that can still link."""
    nibble = "(shiftrightunsigned(code, 60 - depth) & 15L)"
    steps = tasks.select("*", F.explode(F.expr("filter(sequence(0L, 15L), m -> bit_count(m) <= spare)")).alias("m"))
    steps = steps.withColumn("c", F.expr(nibble)).withColumn("d", F.expr("c ^ m"))
    under_a = F.expr("a != b and shiftrightunsigned(code ^ a, 64 - depth) = 0")
    twin = F.col("a") == F.col("b")
    left = F.when(twin, F.least("c", "d")).when(under_a, F.col("c")).otherwise(F.col("d"))
    right = F.when(twin, F.greatest("c", "d")).when(under_a, F.col("d")).otherwise(F.col("c"))
    shifted = lambda x: F.call_function("shiftleft", x, 60 - F.col("depth"))
    return steps.select("trie", F.col("a").bitwiseOR(shifted(left)).alias("a"), F.col("b").bitwiseOR(shifted(right)).alias("b"),
                        (F.col("depth") + 4).alias("depth"), (F.col("spare") - F.bit_count("m")).cast("int").alias("spare"), "code")


def links(distinct: DataFrame, max_task: int = MAX_TASK) -> DataFrame:
    """u, v over distinct fingerprints (column fp): trees whose components are those of all links."""
    turned = "shiftleft(fp, 16 * trie) | if(trie = 0, 0L, shiftrightunsigned(fp, 64 - 16 * trie))"
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("trie")).withColumn("code", F.expr(turned))
    block = F.expr("code & shiftleft(-1L, 48)")
    rows = rows.select("trie", block.alias("a"), block.alias("b"), F.lit(16).alias("depth"), F.lit(MAX_BITS).alias("spare"), "code")
    node = ["trie", "a", "b", "depth"]
    settled, open_rows = [], rows
    while True:
        heavy = open_rows.groupBy(*node).count().where(F.col("count") > max_task).select(*node)
        if open_rows is not rows or heavy.limit(1).count():
            heavy = written(heavy, "heavy-nodes")
        if not heavy.limit(1).count():
            settled.append(open_rows)
            break
        settled.append(open_rows.join(heavy, node, "left_anti"))
        open_rows = written(_split(open_rows.join(heavy, node, "left_semi")), "split-nodes")
    tasks = settled[0]
    for part in settled[1:]:
        tasks = tasks.unionByName(part)
    tasks = tasks.select(*TASK, "code").repartition(*node).sortWithinPartitions(*node)
    return tasks.mapInPandas(_join_sorted, "u long, v long").distinct()


def components(fps: DataFrame, least: list[Column], names: list[str]) -> DataFrame:
    """fp and, for each aggregate of `least`, its smallest value over the component of the fingerprint."""
    distinct = written(fps.groupBy("fp").agg(*[m.alias(n) for m, n in zip(least, names)]), "distinct-fingerprints")
    linked = connected_components(links(distinct.select("fp")))
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(distinct["*"], F.coalesce("component", "fp").alias("root"))
    tops = rooted.groupBy("root").agg(*[F.min(n).alias(n) for n in names])
    return rooted.select("fp", "root").join(tops, "root").select("fp", *names)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row per row of `docs`.

    Null and empty texts have fingerprint zero and link like any other. component_id is the smallest doc_id of the
    component and null if all are null. Repeated rows give repeated rows, an empty table an empty one; further
    columns are ignored.
    """
    fps = written(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    top = components(fps, [F.min("doc_id")], ["component_id"])
    return fps.join(top, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, with one row of each component: that of the smallest doc_id (nulls last), any one if rows repeat."""
    row = free_name(docs.columns, "row")
    packed = docs.select(F.struct("*").alias(row), F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").alias("by_id"))
    packed = written(fingerprints(packed, f"{row}.text"), "fingerprinted")
    first = F.min(F.struct(F.col("by_id").isNull().alias("last"), "by_id", "row_no"))
    top = components(packed.select("fp", "by_id", "row_no"), [first], ["first"])
    kept = top.select(F.col("first.row_no").alias("row_no")).distinct()
    return packed.join(kept, "row_no", "left_semi").select(f"{row}.*")
