"""Token files: the code of boundaries alone, the files against the tokenizer itself, and what they say about each row."""

import json
import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import token_files
from gridloom.llm.elias_fano import SAMPLE, EliasFano, encode

WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = "doc_id long, text string, path string, part string, start string, ids string"
TEXTS = ["The quick brown fox.", None, "", "  \n\t ", "né 漢字 😀 it's 12,345\r\nÖSTERREICH ΣΑΣ", "á èx ́y", "x" * 5000, "word " * 30_000, "<|endoftext|> a <|startoftext|>b", "a\xa0b c\x0bd\x1ce", "same", "same"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=60))
def test_code_of_any_integers(values):
    values = sorted(values)
    code = EliasFano(encode(np.array(values, np.int64)))
    assert code.select(0, len(values)).tolist() == values
    for i, v in enumerate(values):
        assert code[i] == v and code.find(v) == values.index(v)


@pytest.mark.parametrize("n,span", [(1, 0), (SAMPLE, 10), (SAMPLE + 1, 0), (5 * SAMPLE + 3, 100_000), (3000, 2**40)])
def test_select_over_samples(n, span):
    rnd = random.Random(n)
    values = sorted(rnd.randint(0, span) for _ in range(n))
    raw = encode(np.array(values, np.int64))
    code = EliasFano(raw)
    for _ in range(50):
        a = rnd.randrange(n + 1)
        b = rnd.randrange(a, n + 5)
        assert code.select(a, b).tolist() == values[a:b]
    assert code.find(values[-1] + 1) == n
    away = values[-1] - values[0]
    assert len(raw) < 200 + n * (2 + max(0, np.log2(away / n + 1)) + 32 / SAMPLE + 1) / 8


PLAIN = Tokenizer.from_file(WORD)
ENCODER = token_files.Encoder(open(WORD, encoding="utf-8").read(), 2)


def expected(data, path=WORD, end_id=2, tok=None):
    tok = tok or Tokenizer.from_file(path)
    return [[*tok.encode(t or "", add_special_tokens=False).ids, *([] if end_id is None else [end_id])] for t in data]


@pytest.mark.parametrize("path,end_id", [(WORD, 2), (public_tokenizers.path("byte_bpe_50k.json"), 50256), (WORD, None)])
def test_files_hold_what_the_tokenizer_says(spark, tmp_path, path, end_id):
    data = [(7 * i % 101, t, *"abcd") for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame([*data, (None, "no id", *"abcd")], ODD).repartition(3)
    files = token_files.write(docs, str(tmp_path / "files"), path, end_id, file_ids=9_000)
    assert files.count() > 3
    got = token_files.read(files).orderBy("start", F.col("n_tokens").desc()).collect()
    order = sorted(data, key=lambda r: r[0])
    assert [r.doc_id for r in got if r.n_tokens] == [d for d, i in zip([None, *[r[0] for r in order]], expected(["no id", *[r[1] for r in order]], path, end_id)) if i]
    assert len(got) == len(data) + 1
    starts = 0
    for r, ids in zip([r for r in got if r.n_tokens], [i for i in expected(["no id", *[r[1] for r in order]], path, end_id) if i]):
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (starts, len(ids), ids)
        starts += len(ids)
    for row in files.collect():
        with token_files.TokenFile(row.path) as f:
            known = [d for d in f.doc_ids(0, len(f)) if d is not None]
            assert len(f) == row.n_docs and f.find(-5) is None
            for d in known:
                text = next(r[1] for r in order if r[0] == d)
                assert f.find(d).tolist() == expected([text], path, end_id)[0]


def test_repeated_ids_and_rows_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b b"), (1, "a"), (1, "a"), (-(2**63), "low"), (2**63 - 1, "high")], "doc_id long, text string")
    got = token_files.read(token_files.write(docs, str(tmp_path / "a"), WORD)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [-(2**63), 1, 1, 1, 2**63 - 1]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(5)]
    assert sorted(zlib.crc32(r.ids) for r in got) == sorted(zlib.crc32(np.array(i, "<u4").tobytes()) for i in expected([r.text for r in docs.collect()]))
    empty = token_files.write(docs.limit(0), str(tmp_path / "b"), WORD)
    assert empty.count() == 0 and token_files.read(empty).count() == 0


SIGNS = "aBÉıŉǅßİΣςé漢.,'’<|>-=0٣7\u0338\u0301\u00a0\u0958_~ \n"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(SIGNS, max_size=14), max_size=6))
def test_remembered_units_give_the_ids_of_whole_texts(texts):
    texts = [*texts, " ".join(texts), "it's " + "".join(texts), "it'S don't</w> x<|endoftext|>y"]
    ids = [np.frombuffer(x, "<u2").tolist() for x in ENCODER.encode(texts)]
    assert ids == expected(texts, tok=PLAIN)
    ENCODER._forget()


def test_long_text_makes_no_object_a_word():
    text = "harbour lights\n" * 300_000
    want = expected(["harbour lights"], tok=PLAIN)[0][:-1]
    ENCODER.encode(["harbour lights"])
    tracemalloc.start()
    (raw,) = ENCODER.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids = np.frombuffer(raw, "<u2")
    assert (ids[:-1].reshape(-1, len(want)) == want).all() and ids[-1] == 2 and len(ids) == 300_000 * len(want) + 1
    assert peak - len(text) < 600_000 * 50  # a string alone takes over 50 bytes


def test_whole_documents():
    table = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    assert [np.frombuffer(x, "<u2").tolist() for x in ENCODER.encode(table.text.tolist())] == expected(table.text, tok=PLAIN)


def test_words_are_encoded_alone_only_where_that_is_proven():
    given = lambda p: json.load(open(p))
    assert token_files.splits_at_spaces(given(WORD))
    assert not token_files.splits_at_spaces(given(public_tokenizers.path("byte_bpe_50k.json")))
    other = given(WORD)
    other["normalizer"]["normalizers"].append({"type": "Strip"})
    assert not token_files.splits_at_spaces(other)


def test_letters_are_learnt_once_whatever_their_case_and_signs():
    encoder = token_files.Encoder(open(WORD, encoding="utf-8").read(), 2)
    texts = ["Harbour, harbour. (HARBOUR)\nharbour!!", "Été harbour; harbour-harbour", None, "it's harbour"]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == expected(texts, tok=PLAIN)
    assert sorted(encoder.known) == sorted([b"harbour", *b", . ( ) !! ; -".split(), "Été".encode(), b"it's"])


def test_an_added_token_of_letters_is_not_found_in_other_case(tmp_path):
    settings = json.load(open(WORD))
    settings["added_tokens"].append({**settings["added_tokens"][0], "id": PLAIN.token_to_id("stop"), "content": "stop"})
    path = tmp_path / "added.json"
    path.write_text(json.dumps(settings))
    texts = ["STOP here", "stop here, unstopped", "Stop"]
    ids = [np.frombuffer(x, "<u2").tolist() for x in token_files.Encoder(path.read_text(), 2).encode(texts)]
    assert ids == expected(texts, str(path)) and ids[1][0] == PLAIN.token_to_id("stop") not in ids[0]


def test_every_letter_and_sign_alone_and_among_others():
    chars = [chr(c) for c in range(1, 0x600) if not 0xD800 <= c < 0xE000]
    texts = [f"{c} a{c}B {c}{c.upper()}, x.{c}" for c in chars]
    texts = [*texts, "".join(chars), " ".join(chars)]
    assert [np.frombuffer(x, "<u2").tolist() for x in ENCODER.encode(texts)] == expected(texts, tok=PLAIN)
    ENCODER._forget()


def test_a_long_text_is_encoded_by_stretches(monkeypatch):
    monkeypatch.setattr(token_files, "TOGETHER", 50_000)
    text = "it's \u6f22\u5b57 don't\n" * 100_000
    want = expected(["it's \u6f22\u5b57 don't"], tok=PLAIN)[0][:-1]
    ENCODER.encode(["it's"])
    tracemalloc.start()
    (raw,) = ENCODER.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids = np.frombuffer(raw, "<u2")
    assert (ids[:-1].reshape(-1, len(want)) == want).all() and ids[-1] == 2 and len(ids) == 100_000 * len(want) + 1
    assert peak < 3 * len(raw) + 4 * len(text) + 5_000_000
    odd = ["x" * 120_000 + " y", " " * 120_000, "\n" + "it's" * 30_000, "a <|endoftext|>b " * 9_000]
    assert [np.frombuffer(ENCODER.encode([t])[0], "<u2").tolist() for t in odd] == expected(odd, tok=PLAIN)
    ENCODER._forget()
