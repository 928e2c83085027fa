"""Near copies by SimHash and by the Jaccard similarity of word shingles.

The SimHash join of `simhash` comes first: every text of a component of linked fingerprints is compared with the first one
there. Fingerprints a few bits apart reach only the closest copies, so a prefix filter then proposes the other pairs. The
texts themselves decide, whoever proposed a pair.

In any one order of all shingles, two texts of similarity `SIMILAR` share one of the first fifth plus one of the shingles
of each (the prefix). The order used puts common shingles last, so texts that only share a passage, a line or a template
rarely meet there. How common a shingle is comes from a table of `SLOTS` counts over all shingles of all texts, in which a
shingle has the count of its slot: shingles far more frequent than a slot's share stand out, and what the table does not
tell apart costs comparisons but moves no result, as any order gives the same pairs.

Texts that share a prefix shingle are a bucket. A pair of a bucket must fit in size and in its parity sketches: every
shingle flips one of `BITS` bits, so two sketches differ in at most as many bits as the texts have shingles apart. That
bound is exact; for long texts, where it is above what chance gives, the mean at the wanted similarity plus six standard
deviations takes its place (a similar pair is above it with a probability of about 1e-9).

A bucket is not listed pair by pair: first each of its texts is compared with one text of the bucket, a different one in
each bucket and turn, what is linked becomes one component, and turns go on while they close buckets. What is left outside
its bucket's largest component is then compared with all texts of the bucket in other components. Texts equal but for case
and spaces are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import simhash
from gridloom.llm.common import broadcast_if_small, free_name, written
from gridloom.operators.components import connected_components

SHINGLE_WORDS = 5
SIMILAR = 0.8
BITS = 1024
#: Counts in the table of frequencies; it is sent to the driver and to every worker (8 bytes each).
SLOTS = 2**18
#: Counts that reach the driver as one value.
CHUNK = 8192
#: Rows of one number each that are broadcast at most, after counting them.
SMALL_ROWS = 400_000
#: Hashes counted at once.
COUNTED = 1_000_000
#: Turns at least and at most; turns end when one closes under a tenth of the open places of buckets.
STARS = (2, 4)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> set[bytes]:
    """The distinct runs of `size` words, or all words of a shorter text; only A-Z and the six ASCII spaces count."""
    w = _words(text)
    if not w:
        return set()
    return set(map(b" ".join, zip(*[w[i:] for i in range(size)]))) if len(w) >= size else {b" ".join(w)}


def hashed(text: str | None) -> np.ndarray:
    """The shingles' 64-bit hashes, ascending as signed numbers."""
    s = shingles(text)
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, s), np.uint64, len(s)).view(np.int64))


def prefix_size(n: int) -> int:
    """Shingles of which a similar text must share one, whatever the order: all but four fifths, plus one."""
    return n - -(-4 * n // 5) + 1 if n else 0


def frequencies(texts: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """How many shingles of the texts (one column) fall into each slot; every task sends at most `slots` rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, waiting, n = np.zeros(slots, np.int64), [], 0
        for batch in batches:
            for t in batch.iloc[:, 0]:
                waiting.append(hashed(t) & (slots - 1))
                n += len(waiting[-1])
                if n > COUNTED:
                    total += np.bincount(np.concatenate(waiting), minlength=slots)
                    waiting, n = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=slots)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total[at]})

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(CHUNK, np.int64)
        counts[part["slot"] % CHUNK] = part["n"]
        return pd.DataFrame({"chunk": [part["slot"].iloc[0] // CHUNK], "counts": [counts.tobytes()]})

    sums = texts.mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    chunks = sums.groupBy(F.floor(F.col("slot") / CHUNK)).applyInPandas(packed, "chunk int, counts binary")
    table = np.zeros(-(-slots // CHUNK) * CHUNK, np.int64)
    for row in chunks.collect():  # a few rows of bytes, in place of a row a slot
        table[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, np.int64)
    return table[:slots]


def prefix(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The part of a text's shingles that a similar text must share one of, in the order of (frequency, hash)."""
    return hashes[np.lexsort((hashes, table[hashes & (len(table) - 1)]))[: prefix_size(len(hashes))]]


def _keyed(docs: DataFrame, text: str, table: np.ndarray) -> DataFrame:
    """Adds digest (equal for texts of the same words), fp (SimHash), size, prefix and sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("digest binary, fp long, size int, prefix array<long>, sketch array<long>")
    def keyed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            h = hashed(t)
            flips = np.bincount(h & (BITS - 1), minlength=BITS) & 1
            fp = np.uint64(simhash.fingerprint(t)).view(np.int64)
            rows.append((xxhash.xxh128_digest(b" ".join(_words(t))), fp, len(h), prefix(h, sent.value), np.packbits(flips.astype(np.uint8)).view(np.int64)))
        return pd.DataFrame(rows, columns=["digest", "fp", "size", "prefix", "sketch"])

    return docs.withColumn("keyed", keyed(text)).select("*", "keyed.*").drop("keyed")


def _fits(a: str, b: str) -> Column:
    """Whether two texts, given by structs of size and sketch, can be similar."""
    sizes = f"({a}.size + {b}.size)"
    apart = " + ".join(f"bit_count({a}.sketch[{i}] ^ {b}.sketch[{i}])" for i in range(BITS // 64))
    chance = f"{BITS / 2} * (1 - exp(-{sizes} / 9.0D / {BITS / 2})) + {6 * BITS**0.5 / 2}"
    return F.expr(f"5 * least({a}.size, {b}.size) >= 4 * greatest({a}.size, {b}.size) and {apart} <= least({sizes} / 9.0D, {chance})")


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts have at least the similarity; texts: node, text."""

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        known = {t: shingles(t) for t in {*left, *right}}  # a batch meets the same text again and again
        sets = [[known[t] for t in side] for side in (left, right)]
        both = [(len(a & b), len(a), len(b)) for a, b in zip(*sets)]
        return pd.Series([n >= SIMILAR * (a + b - n) - 1e-9 for n, a, b in both])

    pairs = written(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = texts.join(broadcast_if_small(asked, SMALL_ROWS), "node", "left_semi")  # so that few pairs move few texts
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").where(similar("text_u", "text_v")).select("u", "v")


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """u, v: pairs proposed by SimHash, each node and the first one of its component of linked fingerprints. nodes: node, fp."""
    top = simhash.components(nodes.select("fp", "node"), [F.min("node")], ["top"])
    tied = nodes.select("fp", "node").join(top, "fp").where("node != top")
    return tied.select(F.col("node").alias("u"), F.col("top").alias("v"))


def links(nodes: DataFrame, texts: DataFrame, stars: tuple[int, int] = STARS, known: DataFrame | None = None) -> DataFrame:
    """u, v: links whose components are those of all similar pairs and of the `known` links (u and the first v of its component).

    nodes: node, size, prefix, sketch.
    """
    looks = nodes.select("node", F.struct("size", "sketch").alias("look"))
    side = lambda name: looks.select(F.col("node").alias(name), F.col("look").alias(f"look_{name}"))
    places = nodes.select("node", F.explode("prefix").alias("key"))
    shared = places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    rows = places.join(shared, "key").select("key", "node", F.col("node").alias("component"))
    if known is not None:
        first = known.select(F.col("u").alias("node"), F.col("v").alias("top"))
        rows = rows.join(first, "node", "left").select("key", "node", F.coalesce("top", "node").alias("component"))
    rows = written(rows, "buckets")
    found = rows.select(F.col("node").alias("u"), F.col("node").alias("v")).where("false") if known is None else known
    left, turn = rows.count(), 0
    while turn < stars[1]:
        centre = rows.groupBy("key").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", "key", F.lit(turn))).alias("c"))
        pairs = rows.join(centre, "key").where(F.col("component") != F.col("c.component"))
        pairs = pairs.select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v")).distinct()
        pairs = pairs.join(side("u"), "u").join(side("v"), "v").where(_fits("look_u", "look_v")).select("u", "v")
        found = found.unionByName(written(_similar(pairs, texts), "similar"))
        linked = connected_components(found).withColumnRenamed("component", "top")
        rows = rows.join(linked, "node", "left").select("key", "node", F.coalesce("top", "node").alias("component"))
        open_keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        rows = written(rows.join(open_keys, "key"), "open-buckets")
        before, left, turn = left, rows.count(), turn + 1
        if not left or turn >= stars[0] and left > 0.9 * before:
            break
    if left:
        most = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
        rows = rows.join(looks, "node")
        outside = rows.join(most, "key").where("component != largest")
        outside = outside.select("key", F.col("node").alias("other"), F.col("look").alias("other_look"), F.col("component").alias("apart"), "largest")
        # two texts outside the largest component meet once, one inside and one outside too
        pairs = outside.join(rows, "key").where("component = largest or component < apart").where(_fits("look", "other_look"))
        pairs = pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
        found = found.unionByName(written(_similar(pairs, texts), "similar"))
    return found


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, with one row of each component of similar texts: that of the smallest doc_id (nulls last), any one if rows repeat.

    Texts without words, null ones included, are copies of each other. An empty table gives an empty one.
    """
    row = free_name(docs.columns, "row")
    packed = docs.select(F.struct("*").alias(row), F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").alias("by_id"))
    packed = written(_keyed(packed, f"{row}.text", frequencies(docs.select("text"))), "keyed", "zstd")  # texts, the most of the disk
    order = F.struct(F.col("by_id").isNull().alias("last"), "by_id", "row_no")
    tops = written(packed.groupBy("digest").agg(F.min(order).alias("first")).select("first", F.col("first.row_no").alias("node")), "distinct-texts")
    heads = broadcast_if_small(tops.select("node"), SMALL_ROWS)
    nodes = packed.join(heads, F.col("row_no") == F.col("node"), "left_semi").select(F.col("row_no").alias("node"), "fp", "size", "prefix", "sketch")
    texts = packed.select(F.col("row_no").alias("node"), F.col(f"{row}.text").alias("text"))
    known = written(_similar(fingerprint_links(nodes), texts), "similar")
    linked = connected_components(links(nodes, texts, known=known))
    rooted = tops.join(linked, "node", "left").select("first", F.coalesce("component", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_no").alias("row_no"))
    return packed.join(kept, "row_no", "left_semi").select(f"{row}.*")
