"""The near copies of the pipeline's stage against brute force over all pairs."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import Window

from gridloom.llm import near_copies, simhash

WORDS = "the of onan erst thea ingre tion heat wh ou re ndst blethe inor".split()


def prose(seed, n=150):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n))


def edited(text, seed, edits):
    rnd, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"odd{rnd.randrange(10**6)}"
    return " ".join(w)


def jaccard(a, b):
    def runs(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_hand(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted(set(root))


TEXTS = [prose(1), prose(1) + "!", prose(2, 60), prose(2, 60).replace(prose(2, 60).split()[20], "odd"), None, "", " \n", "a b", "A  b", "a b c", prose(3, 2000), prose(3, 1900), prose(3, 1500)]
TEXTS += [edited(prose(4, n), n * 100 + k, k) for n in (60, 150) for k in range(12)]
TEXTS += [edited(prose(5), 7000 + k, k % 6) for k in range(60)]


def test_similar_texts_are_one(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, row_no string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == kept_by_hand(TEXTS)
    assert 1 not in kept_by_hand(TEXTS) and len(kept_by_hand(TEXTS)) > 10


@pytest.mark.parametrize("stars,slots", [((0, 0), 2**18), ((1, 1), 4), ((2, 8), 1)])
def test_star_rounds_and_the_order_do_not_move_the_result(spark, stars, slots):
    texts = TEXTS[-60:]
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    table = near_copies.frequencies(docs.select("text"), slots)
    assert table.sum() == sum(len(near_copies.shingles(t)) for t in texts)
    nodes = near_copies._keyed(docs, "text", table)
    near = near_copies.links(nodes, docs, stars).collect()
    assert all(jaccard(texts[r.u], texts[r.v]) >= 0.8 for r in near)
    linked = near_copies.connected_components(spark.createDataFrame(near, "u long, v long")).collect()
    assert sorted({r.component for r in linked} | set(range(60)) - {r.node for r in linked}) == kept_by_hand(texts)


def test_sketch_never_refuses_a_similar_pair(spark):
    texts = [edited(prose(9, n), k, k) for n in (40, 300, 2000) for k in (0, 1, 3, 6, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    nodes = near_copies._keyed(docs, "text", near_copies.frequencies(docs.select("text"))).select("node", near_copies.F.struct("size", "sketch").alias("look"))
    a, b = (nodes.select(near_copies.F.col("node").alias(n), near_copies.F.col("look").alias(f"look_{n}")) for n in "uv")
    fits = {(r.u, r.v) for r in a.crossJoin(b).where(near_copies._fits("look_u", "look_v")).collect()}
    similar = {(i, j) for i in range(len(texts)) for j in range(len(texts)) if jaccard(texts[i], texts[j]) >= 0.8}
    assert similar <= fits and len(fits) < 2 * len(similar) and len(similar) > len(texts)


def test_texts_that_share_a_passage_do_not_meet(spark):
    """Texts of similarity 0.56 and below through one passage: the places where they meet grow with their number, not its square."""
    passage = prose(11, 110)
    sizes = []
    for n in (40, 160):
        docs = spark.createDataFrame([(i, prose(1000 + i, 21) + " " + passage + " " + prose(5000 + i, 21)) for i in range(n)], "node long, text string")
        nodes = near_copies._keyed(docs, "text", near_copies.frequencies(docs.select("text")))
        keys = nodes.select(near_copies.F.explode("prefix").alias("key")).groupBy("key").count()
        sizes.append(keys.where("count > 1").count())
        assert near_copies.links(nodes, docs).count() == 0
    assert sizes == [0, 0]


def test_fingerprints_propose_the_closest_copies(spark, monkeypatch):
    """Long texts with one odd word meet by SimHash; a pair that it alone proposes is still compared by its texts."""
    texts = [prose(21, 2000), edited(prose(21, 2000), 1, 1), prose(23, 200), prose(24, 200)]
    prints = [simhash.fingerprint(t) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[2] ^ prints[3]).bit_count()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = near_copies.frequencies(docs.select("text"))
    nodes = near_copies._keyed(docs.withColumnRenamed("doc_id", "node"), "text", table)
    assert [tuple(r) for r in near_copies.fingerprint_links(nodes).collect()] == [(1, 0)]
    monkeypatch.setattr(near_copies, "prefix_size", lambda n: 0)  # SimHash alone
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [0, 2, 3]
    wrong = lambda nodes: nodes.select(near_copies.F.col("node").alias("u"), near_copies.F.min("node").over(Window.partitionBy()).alias("v")).where("u != v")
    monkeypatch.setattr(near_copies, "fingerprint_links", wrong)
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [0, 2, 3]
