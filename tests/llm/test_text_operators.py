"""The training-text operators against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, html_text, licenses, packing, pii, quality, sharding, simhash, token_counts, training_pages, url_rules
from gridloom.llm.common import written
from gridloom.operators.components import connected_components

WIDE = "doc_id long, text string, lang string, source string, n_chars long, row string, quality string, kept string, fp string, row_no string, found string, batch string, pii_text string"
WORDS = "the of onan erst thea ingre tion heat wh ou re ndst blethe inor".split()


def prose(seed, n=120):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n))


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_docs(spark, texts):
    """Rows with extra columns whose names the operators use themselves; the first row twice, one id null."""
    data = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, len(t or ""), *"abcdefgh") for i, t in enumerate(texts)]
    data += [data[0], (None, texts[0], "en", None, 0, *"abcdefgh")]
    return spark.createDataFrame(data, WIDE)


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, schema)


TEXTS = [
    prose(1), None, "", " \n\t", prose(2, 3000), "x" * 5000, "a b c a b c a b c", "!!! ### $$$", prose(3, 60) + "\n" + prose(3, 60) + "\n \n" + prose(4, 20), "né 漢字 😀 " * 40,
    "mail Bob.x%2@mail7.example.com, a@b@c.de 1.2.3.4 999.1.1.1 0010.2.3.004 call +1 (843) 555-7672 4111 1111 1111 1111 now", "+12 +1 23 45-67 89 0. 4111-1111-1111-1111",
    "4111111111111111 4012888888881881", "@ @.com a@b.c.d._x@y.org e@-.-", "1.2.3.4.5.6.7.8 1..2", prose(5, 49), prose(6, 50),
]


def test_quality_measures(spark):
    got = quality.quality_rules(odd_docs(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS) + 2

    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed

    for r in got:
        assert tuple(r)[1:7] == brute(TEXTS[r.doc_id or 0])
        assert not (r.base_failed and r.kept)


def test_quality_windows_with_equal_hash_bits(spark):
    """So few bits are left of the hashes in a long text that different windows meet; the exact way must count them."""
    text = " ".join(f"w{i}" for i in range(60_000)) + " w5 w6 w7 w8"
    assert quality.quality_rules(frame(spark, [(1, text, "en", "s")])).first().n_repeat_words == 8


def test_quality_fences_follow_their_group(spark):
    rows = [(i, prose(i, 80), "en", "plain") for i in range(150)] + [(1000 + i, prose(i, 80).replace(" ", "# ", 30), "en", "forum") for i in range(150)]
    rows += [(2000, prose(7, 80).replace(" ", "### "), "en", "plain"), (2001, prose(8, 80), "en", "tiny"), (2002, prose(9, 80), None, None), (2003, prose(1, 80).replace(" ", "# ", 30), "en", "plain")]
    docs = frame(spark, rows)
    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    assert kept == {r[0] for r in rows} - {2000, 2003}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept


def test_sketch_quantiles_merge(spark):
    docs = frame(spark, [(i, prose(i, 60 + i), "en", f"s{i % 3}") for i in range(90)])
    stats = written(quality.measured(docs), "stats")
    whole = {tuple(r) for r in quality.sketches(stats).groupBy("measure", "value").agg(F.sum("n")).collect()}
    halves = quality.sketches(stats.where("doc_id < 40")).unionByName(quality.sketches(stats.where("doc_id >= 40")))
    assert whole == {tuple(r) for r in halves.groupBy("measure", "value").agg(F.sum("n")).collect()}
    values = spark.range(0, 100_000, 37).select("id", quality.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id and r.id - r.b <= r.id / 32 for r in values)


def simhash_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(prints):
    label = {f: f for f in prints}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for a, b in itertools.combinations(sorted(label), 2):
        if (a ^ b).bit_count() <= 3:
            x, y = sorted([root(a), root(b)])
            label[y] = x
    return {f: root(f) for f in label}


def test_simhash_components(spark):
    texts = TEXTS + [prose(2, 3000) + " odd", prose(2, 3000).upper(), prose(9, 2500), prose(9, 2500).replace("the", "The"), prose(9, 2490)]
    got = simhash.near_duplicates(odd_docs(spark, texts)).collect()
    prints = [simhash_of(t) for t in texts]
    top = components_of(set(prints))
    first = {}
    for i, f in enumerate(prints):
        first[top[f]] = min(i, first.get(top[f], i))
    assert sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == sorted(
        (False, i, f"{f:016x}", first[top[f]]) for i, f in [*enumerate(prints), (0, prints[0])])
    kept = simhash.keep_one(odd_docs(spark, texts))
    assert kept.columns == odd_docs(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(first.values()))
    alone = simhash.near_duplicates(frame(spark, [(None, "a b", "", ""), (None, "a b", "", "")])).collect()
    assert [r.component_id for r in alone] == [None, None]


@pytest.mark.parametrize("max_task", [10**6, 40, 3])
def test_trie_join_finds_all_links(spark, max_task):
    """A dense cloud, chains and noise; small tasks force the walk to go on in Spark."""
    rnd = random.Random(max_task)
    centre, prints = rnd.getrandbits(64), set()
    for _ in range(150):
        f = centre
        for _ in range(rnd.randrange(9)):
            f ^= 1 << rnd.randrange(64)
        prints.add(f)
    chain = rnd.getrandbits(64)
    for i in range(0, 60, 3):
        chain ^= 7 << i
        prints.add(chain)
    prints |= {rnd.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1, 1, 2**63}
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.links(df, max_task)).collect()}
    groups = lambda pairs: sorted(sorted(g) for g in pd.Series(dict(pairs)).groupby(lambda k: dict(pairs)[k]).groups.values())
    want = components_of(prints)
    mine = {f: got.get(signed(f), signed(f)) for f in prints}
    assert groups(mine) == groups(want)


ITEMS = [(1, prose(20, 30)), (2, prose(21, 13)), (3, "short Item"), (4, None), (5, "..."), (6, prose(21, 13).upper() + "!"), (None, "unnamed thing here"), (10, prose(20, 30)), (1, prose(20, 30))]


def contaminated_by_hand(text):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    w, hit, items = words(text), set(), set()
    for item, t in ITEMS:
        iw = words(t)
        for win in [iw[i : i + 13] for i in range(max(1, len(iw) - 12))] if iw else []:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    items |= {str(item)} if item is not None else set()
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("max_bytes", [10**7, 60])
def test_decontamination(spark, max_bytes):
    texts = [None, "", "...", prose(1), prose(20, 30), "é " + prose(20, 30)[5:] + " 😀", prose(1) + "\n" + prose(21, 13).replace(" ", "--") + "; " + prose(2), "a SHORT\nitem short item", "an unnamed  thing here",
             prose(3, 400) + " short item", "short items", prose(20, 12), prose(20, 30) + " " + prose(20, 30), "x" * 100_000]
    bench = spark.createDataFrame([(*i, "z") for i in ITEMS], "item_id long, text string, items string")
    got = decontaminate.decontamination(odd_docs(spark, texts), bench, max_bytes=max_bytes).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[r.doc_id or 0]
        assert tuple(r)[1:6] == contaminated_by_hand(text)
        assert sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text[s.start : s.end]))) for s in r.spans) == r.n_hit
    empty = decontaminate.decontamination(odd_docs(spark, texts), bench.limit(0)).collect()
    assert not any(r.contaminated for r in empty)


def test_drop_contaminated_keeps_columns(spark):
    docs = odd_docs(spark, [prose(20, 30), prose(1), None])
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2]


def personal_by_hand(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(digits):
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    out = []
    for n, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_personal_data(spark):
    rnd = random.Random(5)
    parts = ["a", "b.c", "@", ".", "_", "%", "mail@x.org", "1.2.3.4", "256.1.1.1", "+1 (843) 555-7672", "4111111111111111", "4012888888881881", " ", " ", "-", "4", "12", "+", "(", "é", "\n", "😀", "4111 1111 1111 1111"]
    texts = TEXTS + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 40))) for _ in range(400)] + ["1" * 20_000, "a" * 20_000 + "@", "1.2.3.4 " * 700, "+" + "1 " * 9000, "a@b.c" + ".d" * 9000]
    got = pii.personal_data(odd_docs(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    names = pii.KINDS
    for r in got:
        base = personal_by_hand(texts[r.doc_id or 0])
        listed = [f"{names[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), texts[r.doc_id or 0]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(listed) <= set(r.spans.split(",")) | {""} or not listed


def test_boosted_candidates_add_what_base_rules_drop(spark):
    rnd = random.Random(1)
    phone = lambda: f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
    rows = [(i, f"{rnd.choice(['call', 'then'])} {phone()} or not {rnd.randrange(10**15, 10**16)} {prose(i, 20)}", "", "") for i in range(300)]
    rows += [(1000, f"then {phone()} 190.137.223.20 {prose(1, 9)}", "", ""), (1001, prose(2, 50), "", "")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert got[1000].n_phone == 0 and "phone:5:22" in got[1000].spans.split(",")
    assert got[1001].spans == ""
    text = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert text[1000].startswith("then [phone] [ip] ") and text[1001] == rows[-1][1]


def test_redaction_keeps_rows_and_columns(spark):
    docs = odd_docs(spark, TEXTS)
    got = pii.redacted(docs)
    assert got.columns == docs.columns
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[1] is None and text[2] == "" and text[9] == TEXTS[9]
    assert text[10] == "mail [email], [email] [ip] 999.1.1.1 [ip] call [phone] [card] now" or "[email]" in text[10]
    assert not any(personal_by_hand(t) for i, t in text.items() if i in (10, 12))


def test_url_rules(spark):
    rnd = random.Random(2)
    labels, paths = ["net", "org", "a", "b", "c", ""], ["", "/", "/a", "/a/b", "/a/b/c", "/b/", "/é"]
    hosts = [".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    rules = [(rnd.choice(hosts) + rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(80)] + [(None, "block")]
    urls = [(i if i % 7 else None, rnd.choice(["http://", "x", "HTTPS://"]) + rnd.choice(hosts).upper() + rnd.choice(paths) + rnd.choice(["", "?q=/a", "#x", "x"]), "r", "k") for i in range(600)]
    urls += [(1, None, "r", "k"), (1, None, "r", "k"), (2, "", "r", "k"), (3, "a://b://c/d", "r", "k")] + [(9, "http://a.net/a/b", "r", "k")] * 300
    pages, known = spark.createDataFrame(urls, "page_id long, url string, rule string, key string"), {}
    for rule, verdict in rules:
        if rule is not None:
            host, slash, rest = rule.partition("/")
            known[host, slash + rest] = max(verdict, known.get((host, slash + rest), ""))

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lowered(host)
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    got = url_rules.judged(pages, spark.createDataFrame(rules, "rule string, verdict string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((u[0], *brute(u[1])) for u in urls), key=repr)
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {r.verdict for r in url_rules.judged(pages, none).collect()} == {"allow"}
    assert url_rules.judged(pages.limit(0), none).collect() == []


def test_license_scans(spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 A B\n\n" + mit.lower()), (2, None), (3, ""), (4, mit.replace(" ", "\n  ").replace('"', "“")), (5, "x\n* licensed UNDER the Apache Licence version 2.0\ny"), (6, "!!!"),
            (None, "MIT License\n© 2020 x\n" + mit), (7, mit + " more"), (7, mit + " more"), (8, "Released under the MIT License.\n" * 3000), (9, "Licensed under CC BY 4.0.\nReleased under the MIT License.")]
    got = licenses.scanned(spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, digest string, line string"), licenses.default_known(spark)).collect()
    found = {r.doc_id: (r.license_id, r.notices) for r in got}
    assert len(got) == len(rows)
    assert found == {1: ("MIT", ""), 2: (None, ""), 3: (None, ""), 4: ("MIT", ""), 5: (None, "Apache-2.0"), 6: (None, ""), None: ("MIT", ""), 7: (None, ""), 8: (None, "MIT"), 9: (None, "CC-BY-4.0,MIT")}
    assert licenses.scanned(spark.createDataFrame([], "doc_id long, text string"), licenses.default_known(spark)).collect() == []


def test_token_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    v = token_counts.read_vocabulary()
    pieces = [("<unk>", 0.0), *[(f"<0x{i:02X}>", 0.0) for i in range(256)], *v.scores.items()]
    whole = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, 0, True))
    whole.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    texts = [t for t in TEXTS if t] + ["  two   spaces ", "tab\tand\nline", "ſ ﬁ ▁ ▁▁x", "\u0301\u200d"]
    docs = odd_docs(spark, [*texts, None, ""])
    got = {r.doc_id: r.n_tokens for r in token_counts.counted(docs.drop("n_tokens")).collect()}
    assert [got[i] for i in range(len(texts))] == [len(whole.encode(t).ids) for t in texts]
    assert got[len(texts)] == got[len(texts) + 1] == 0
    clash = token_counts.counted(frame(spark, [(1, "a", "x")], "doc_id long, text string, N_tokens string"))
    assert clash.columns == ["doc_id", "text", "N_tokens", "n_tokens_"]


def test_token_ties_and_unknown_characters():
    v = token_counts.Vocabulary({"a": -1.0, "b": -1.0, "ab": -2.0, "▁": -1.0}, -2.0, True, True, True)
    count = token_counts.Counter(v)
    assert count("ab") == 2  # ▁ ab: the longer piece comes first and an equal score does not replace it
    assert count("é") == 1 + 2 and count("aé😀") == 2 + 2 + 4
    assert token_counts.Counter(token_counts.Vocabulary(v.scores, -2.0, False, False, True))("é") == 1


def test_sharding(spark):
    texts = TEXTS + [prose(i, 5) for i in range(60)] + ["same text"] * 40
    docs = odd_docs(spark, texts)
    rows = sharding.sharded(docs).collect()
    assert len(rows) == len(texts) + 2
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        raw = (texts[r.doc_id or 0] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    again = sharding.sharded(docs.repartition(3)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert sharding.sharded(docs.limit(0)).collect() == []
    assert sorted(r.shard for r in sharding.sharded(docs.limit(3)).collect()) == [0, 1, 2]


def test_ring_moves_match_placing_rows_one_by_one():
    rnd = random.Random(4)
    for _ in range(50):
        shards = rnd.randint(1, 5)
        points = sharding.ring(shards, 4)
        counts = {a: rnd.randrange(12) * (rnd.random() < 0.6) for a in range(len(points))}
        counts[rnd.randrange(len(points))] = rnd.randrange(200)
        total = sum(counts.values())
        room = [total // shards + (s < total % shards) for s in range(shards)]
        want, over = {}, []
        for a, (_, s) in enumerate(points):
            for rank in range(counts[a]):
                if room[s]:
                    room[s] -= 1
                    want[a, rank] = s
                else:
                    over.append((a, rank))
        for a, rank in over:
            k = a + 1
            while not room[points[k % len(points)][1]]:
                k += 1
            s = points[k % len(points)][1]
            room[s] -= 1
            want[a, rank] = s
        steps = sharding.moves(counts, points, shards)
        assert {(a, r): s for a, lo, hi, s, _ in steps for r in range(lo, hi)} == want
        slots = sorted((s, slot + i) for _, lo, hi, s, slot in steps for i in range(hi - lo))
        assert slots == [(s, i) for s in range(shards) for i in range(sum(1 for x, _ in slots if x == s))]


def test_arcs_follow_the_ring(spark):
    points = sharding.ring(5, 16)
    at = [0, 2**32 - 1, *[p + d for p, _ in points for d in (-1, 0, 1)]]
    df = spark.createDataFrame([(p,) for p in at], "p long")
    for r in df.select("p", sharding.arc(F.col("p"), points).alias("a")).collect():
        assert r.a == next((i for i, (q, _) in enumerate(points) if q >= r.p), 0)


def test_a_further_shard_takes_rows_only_from_the_ring_before_it():
    old, new = sharding.ring(8), sharding.ring(9)
    owner = lambda ring, p: next((s for q, s in ring if q >= p), ring[0][1])
    rnd = random.Random(1)
    moved = [(owner(old, p), owner(new, p)) for p in (rnd.randrange(2**32) for _ in range(2000))]
    assert all(a == b or b == 8 for a, b in moved)


def test_length_buckets_are_optimal():
    rnd = random.Random(6)
    for _ in range(60):
        histogram = [(n, rnd.randint(1, 9)) for n in rnd.sample(range(1, 60), rnd.randint(1, 9))]
        k, longest = rnd.randint(1, 4), max(n for n, _ in histogram)
        cost = lambda tops: sum(c * min(t for t in tops if t >= n) for n, c in histogram)
        best = min(cost(t) for i in range(1, k + 1) for t in itertools.combinations(sorted(n for n, _ in histogram), i) if t[-1] == longest)
        got = packing.boundaries(histogram, k)
        assert cost(got) == best and len(got) <= k
    assert packing.boundaries([], 3) == []


def test_packing(spark):
    texts = TEXTS + [prose(i, 1 + i % 90) for i in range(300)]
    docs = odd_docs(spark, texts)
    rows = packing.packed(docs, buckets=5, token_budget=300).collect()
    assert len(rows) == len(texts) + 2
    assert all(r.n_tokens == len((texts[r.doc_id or 0] or "").split()) and r.pad_to >= r.n_tokens for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for batch in batches.values():
        assert sorted(r.place for r in batch) == list(range(len(batch))) and len({(r.bucket, r.pad_to) for r in batch}) == 1
        assert len(batch) == 1 or len(batch) * batch[0].pad_to <= 300
    assert packing.packed(docs.limit(0)).collect() == []
    given = packing.packed(docs, length=F.col("n_chars")).collect()
    assert {r.n_tokens for r in given if r.doc_id == 0} == {len(TEXTS[0])}


def text_of(page):
    return html_text.trained().text(page)


def test_html_blocks_and_references():
    page = """<!doctype html><html><head><title>T &amp; x</title><script>var a="</p>";</script></head><body class='x'><!-- no --><nav><ul><li><a href="/a>b">Home</a><li>More</ul></nav>
    <article><h1>Big&nbsp;&lt;news&gt;</h1><p>One <b>two</b>thr<i>ee</i><br>four\n five<p>Six a < b &copy; seven.<aside><p>Related thing</p></aside><div class="ad">Buy now</div><p>Eight<style>p{}</style> nine.</p>
    <section id="comments"><p>Great article, thanks.</p></section></article><form><p>Your name</p></form><footer>&copy; All rights.</footer>"""
    assert text_of(page) == "Big <news> One twothree four five Six a < b © seven. Eight nine."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<!--", "<p", "<a href='", "</p></div>", "<script>", "<nav><a>x</a></nav>", "<div>" * 3000, "</b>" * 3000])
def test_html_without_article(page):
    assert text_of(page) == ""


def test_html_long_and_broken_pages():
    body = "".join(f"<p>Paragraph number {i} of a long text.<b>" for i in range(4000))
    got = text_of(f"<html><body><article>{body}")
    assert got.count("Paragraph") == 4000 and got.startswith("Paragraph number 0 of")
    deep = "<div><span>" * 2000 + "<article><p>Deep text in it.</p></article>"
    assert text_of(deep) == "Deep text in it."


def test_html_held_out_pages():
    field = html_text.trained()
    right = total = 0
    for page in training_pages.labelled_pages(150, seed=99):
        found = html_text.blocks(page, field.known)
        same = [a == b.text.startswith(training_pages.LABEL_MARK) for a, b in zip(field.labels(found), found)]
        right, total = right + sum(same), total + len(same)
    assert right / total > 0.995


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    field = html_text.trained()
    for page in training_pages.labelled_pages(6, seed=5):
        found = html_text.blocks(page, field.known)[:9]
        scores = [sum(field.weights.get(f, 0.0) for f in html_text.features(b)) for b in found]
        total = lambda y: field.start[y[0]] + sum(s for s, v in zip(scores, y) if v) + sum(field.order[a][b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(found)), key=total)
        assert total([int(x) for x in field.labels(found)]) == pytest.approx(total(best))
    assert rng is not None


def test_html_table(spark):
    page = "<body><nav><a>Menu</a></nav><main><p>Hello there, this is it.</p></main>"
    pages = spark.createDataFrame([(1, "u", page, "t"), (1, "u", page, "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.main_text(pages).collect()), key=repr) == sorted([(1, "u", "Hello there, this is it.", 24)] * 2 + [(None, None, "", 0)], key=repr)
    assert html_text.main_text(pages.limit(0)).collect() == []
