"""Fill-in-the-middle: the tree against plain counting, the query against a plain reading of its rules, and round trips."""

import hashlib
import random
import re

import pytest

from gridloom.llm import fill_middle

ODD = "doc_id long, text string, n string, form string, output string, made string"
TEXTS = [None, "", "\n", "a", "a\n", "\n\n\nx", "one\ntwo\nthree", "né\n漢字\n😀\n" * 3000, "x" * 20_000 + "\n" + "y" * 9_000, "with <P> inside\nb", "<S>", "a<M>b\nc\n", "<\nP>\n<\nS>\n<\nM>\n<", "\r\n\r\nx\r", "same\ntext\n", "same\ntext\n"]


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert "".join(units) == text
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 4096])
def test_tree_finds_every_cut(block):
    rnd = random.Random(block)
    for text in ["", "\n", "ab\ncd", "".join(rnd.choice("aé漢😀\n\n") for _ in range(300)), "z" * 500, "\n" * 130]:
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        tree = fill_middle.UnitTree(text.encode(), block)
        assert (tree.n_units, tree.n_points) == (len(units), len(text))
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_query_equals_rules(spark, rate, spm):
    data = [(i, t, *"abcd") for i, t in enumerate(TEXTS * 4)] + [(None, TEXTS[6], *"abcd"), (6, TEXTS[6], *"abcd")]
    docs = spark.createDataFrame(data, ODD)
    made = fill_middle.transformed(docs, rate=rate, spm_rate=spm)
    assert made.columns == ["doc_id", "text", "made", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(made["output"], made["form"]).alias("back")).collect()
    assert len(got) == len(data)
    for r in got:
        assert tuple(r)[2:7] == plain(r.doc_id, r.text, rate=rate, spm=spm)
        assert r.back == (r.text or "")
    if rate == 100:
        assert {r.form for r in got} >= ({"psm", "spm"} if spm == 50 else {"spm"})


def test_digests_and_empty_table(spark):
    docs = spark.createDataFrame([(3, TEXTS[7])], "doc_id long, text string")
    row = fill_middle.digests(docs).first()
    assert row.output_sha256 == hashlib.sha256(plain(3, TEXTS[7])[4].encode()).hexdigest()
    assert row.restored_sha256 == hashlib.sha256(TEXTS[7].encode()).hexdigest()
    assert fill_middle.digests(docs.limit(0)).collect() == []
