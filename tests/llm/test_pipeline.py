"""The pipeline on planted documents, each stage judged on its own input."""

import importlib
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of onan erst thea ingre tion heat wh ou re ndst blethe inor".split()


def prose(seed, n=150):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    item = prose(500, 40)
    rows = [(i, prose(i), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, prose(1), "en", "s1"), (101, prose(2, 150) + "!", "en", "s2"), (102, prose(3).replace(" ", "### "), "en", "s0"), (103, " ".join(["same words again"] * 60), "en", "s0"), (104, "short", "en", "s0"),
             (105, prose(105, 200) + " " + item + " " + prose(106, 200), "en", "s1"), (106, prose(107) + " mail me@mail1.example.com or +1 (843) 555-7672", None, None), (107, None, "en", "s1"), (None, prose(108), "en", "s1"), (5, prose(5), "en", "s2")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, prose(501, 20))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_stage_on_its_own_input(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    ids = lambda df: sorted(r.doc_id if r.doc_id is not None else -1 for r in df.select("doc_id").collect())
    stage = dict(corpus_pipeline.STAGES)
    every = ids(docs)
    drop = lambda *gone: sorted(i for i in every if i not in gone)
    for name in ("quality_rules", "near_dedup", "decontamination", "pii_redaction"):
        assert stage[name](spark, docs, tables).columns == docs.columns
        assert stage[name](spark, docs.limit(0), tables).count() == 0
    assert ids(stage["quality_rules"](spark, docs, tables)) == drop(102, 103, 104, 107)
    kept = ids(stage["near_dedup"](spark, docs, tables))
    assert 1 in kept and 2 in kept and kept.count(5) == 1 and set(every) - set(kept) == {100, 101}
    assert ids(stage["decontamination"](spark, docs, tables)) == drop(105)
    clean = stage["pii_redaction"](spark, docs, tables)
    assert ids(clean) == every
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[106].text.endswith(" mail [email] or [phone]") and texts[106].n_chars == len(texts[106].text)
    assert texts[107].text is None and all(texts[i].text == prose(i) for i in range(60))
    packed = stage["packing"](spark, docs, tables)
    assert ids(packed) == every


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    ids = {r.doc_id for r in got.collect()}
    assert ids >= set(range(3, 60)) | {0, 1, 106, None} and not ids & {100, 101, 102, 103, 104, 105, 107}
    assert got.groupBy("batch").agg((F.count("*") * F.max("pad_to")).alias("t")).where("t > 16384").count() == 0


def test_registered_where_installed():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii_redaction", "packing"]
