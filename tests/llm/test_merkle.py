"""Merkle manifest: trees and climbs against plain recursion, with nulls, repeats, single leaves and tampered rows."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from gridloom.llm import merkle

WIDE = "doc_id long, source string, lang string, n_chars long, text string, leaf_no string, tree string, step string, digest string, `row` string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in [*r[:4], text]])


def grow(nodes):
    """The root, and per node the digests beside its path as (left, right) pairs."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, i in enumerate(at):
            run = runs[i // 3]
            paths[k].append((run[: i % 3], run[i % 3 + 1 :]))
        at = [i // 3 for i in at]
        nodes = [h(*r) for r in runs]
    return nodes[0], paths


def expected(rows):
    order = lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r, r[4]))
    rows = sorted(rows, key=order)
    trees = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
    grown = [grow([leaf(r, r[4]) for r in t]) for t in trees]
    root, upper = grow([g[0] for g in grown])
    out = []
    for t, (subroot, paths), rest in zip(trees, grown, upper):
        for r, path in zip(t, paths):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in path + rest:
                folded = h(*left, folded, *right)
            proof = h(*[x for left, right in path + rest for x in left + right])
            out.append((r[0], leaf(r, r[4]), subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def rows_of(n, sources):
    texts = ["a\nb", None, "", "né 漢\n\n", "no break", "x" * 20_000 + "\n", "same\n"]
    return [(i, sources[i % len(sources)], [None, "en"][i % 2], [None, 3][i % 3 == 0], texts[i % 7]) for i in range(n)]


CASES = {
    "one row": rows_of(1, ["s"]),
    "one source": rows_of(28, ["s"]),
    "sources of one leaf": rows_of(10, list("zyxwvutsrq")),
    "hot source, null source, odd names": [*rows_of(40, ["hot"]), *rows_of(5, [None, "", "é", "-", "Z"]), *rows_of(9, ["a"])],
    "repeated rows, null ids": [*rows_of(7, ["s"]), *rows_of(7, ["s"]), (None, "s", None, None, "n\n"), (None, "s", None, None, "n\n"), (-5, "s", None, None, "m\n"), (3, "s", "de", 1, "other")],
}


@pytest.mark.parametrize("case", CASES)
def test_every_proof(spark, rows, case):
    data = [(*r, *"abcde") for r in CASES[case]]
    docs = spark.createDataFrame(data, WIDE).repartition(3)
    limit = spark.conf.get(merkle.ROW_LIMIT, None)
    got = merkle.verified(docs)
    assert rows(got, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == expected(CASES[case])
    assert spark.conf.get(merkle.ROW_LIMIT, None) == limit


def test_empty_table(spark):
    got = merkle.verified(spark.createDataFrame([], WIDE))
    assert got.collect() == [] and got.columns[0] == "doc_id"


def test_claims_of_one_leaf_and_stored_links(spark):
    data = [(i, None, None, None, f"t{i}") for i in range(11)]
    docs = spark.createDataFrame(data, WIDE.split(", leaf_no")[0])
    digest = merkle.leaf_digest([F.col(c) for c in merkle.FIELDS])
    built = merkle.build(docs.select(F.lit("g").alias("group"), F.col("doc_id").alias("order"), digest.alias("digest"), F.struct("doc_id").alias("row")))
    assert built.leaves.count() == 11 and built.nodes.count() == 4 + 2
    wrong = merkle._hash(F.col("digest"))
    claims = F.when(F.col("row.doc_id") == 6, wrong).otherwise(F.col("digest"))
    done = merkle.climbed(built, claims).join(built.leaves.select("leaf_no", "row.doc_id"), "leaf_no")
    bad = done.where(F.lower(F.hex("folded")) != built.root).select("doc_id").collect()
    assert [r.doc_id for r in bad] == [6]
