"""Packing by optimal length buckets: dynamic programming over the global histogram chooses the bucket boundaries.

The histogram has log-linear bins (exact below 128, then 64 an octave), so it holds under 4000 rows whatever the
corpus, and only it comes to the driver. The program finds the boundaries with the least padding; inside each bucket
rows are dealt, in order of length, into batches of as many rows as the token budget holds at the bucket's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ranked, words, written

BUCKETS = 16
TOKEN_BUDGET = 16_384


def bin_top(length: Column) -> Column:
    """Largest length of a length's bin."""
    drop = F.greatest(F.length(F.bin(length)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", length, drop) + 1, drop) - 1


def boundaries(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Bucket lengths, ascending, with the least padding; histogram: (length, rows). Fewest buckets, then shortest, on ties.

    best[j] is the least sum of padded lengths of the first j bins with the buckets so far. Padding is that sum less
    the true lengths, which no choice changes.
    """
    if not histogram:
        return []
    tops, rows = (np.array(x, np.int64) for x in zip(*sorted(histogram)))
    upto = np.concatenate([[0], np.cumsum(rows)])
    m = len(tops)
    far = np.iinfo(np.int64).max // 4
    best = np.concatenate([[0], np.full(m, far)])
    cuts = []
    for _ in range(min(buckets, m)):
        then, cut = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + (upto[j] - upto[:j]) * tops[j - 1]
            i = int(np.argmin(cost))
            if cost[i] < then[j]:
                then[j], cut[j] = cost[i], i
        cuts.append(cut)
        best = then
    out, j = [], m
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            out.append(int(tops[j - 1]))
            j = int(cut[j])
    return out[::-1]


def packed(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, pad_to, batch, place; one row per row of `docs`.

    `length` gives a row's tokens, by default its words between white space; pass a column of counts to pack by those.
    bucket counts from 0 by length, pad_to is its length, batch is numbered gaplessly over all buckets, place within the
    batch. A text longer than the budget is a batch of its own. Null and empty texts have no tokens and are packed at
    length 1, the least bucket there is. Repeated rows are packed each, an empty table gives an empty one, further
    columns are ignored.
    """
    counted = F.size(words(F.col("text"))) if length is None else F.coalesce(length, F.lit(0))
    rows = written(docs.select("doc_id", counted.cast("long").alias("n_tokens")), "lengths")
    binned = rows.withColumn("padded", F.greatest("n_tokens", F.lit(1).cast("long")))
    histogram = [(r.top, r.n) for r in binned.groupBy(bin_top(F.col("padded")).alias("top")).agg(F.count(F.lit(1)).alias("n")).collect()]
    tops = boundaries(histogram, buckets)
    if not tops:
        return rows.select("doc_id", "n_tokens", *[F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("pad_to", "long"), ("batch", "long"), ("place", "int"))])
    per = [max(1, token_budget // t) for t in tops]
    held = [sum(n for top, n in histogram if (tops[k - 1] if k else 0) < top <= t) for k, t in enumerate(tops)]
    first = [sum(-(-h // p) for h, p in zip(held[:k], per[:k])) for k in range(len(tops))]
    pick = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket"))
    bucket = F.size(F.filter(F.array(*[F.lit(t).cast("long") for t in tops]), lambda t: t < F.col("padded")))
    placed = ranked(binned.withColumn("bucket", bucket), ["bucket"], [F.col("n_tokens"), F.col("doc_id")], "at", sum(held))
    return placed.select("doc_id", "n_tokens", "bucket", pick(tops).alias("pad_to"), (pick(first) + F.floor(F.col("at") / pick(per))).alias("batch"), (F.col("at") % pick(per)).cast("int").alias("place"))
