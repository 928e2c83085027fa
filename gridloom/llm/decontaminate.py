"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows scans each text once.

Words are runs of ASCII digits, letters (A-Z lowered) and characters beyond ASCII. A window is `WINDOW` consecutive
words of an item, or all words of a shorter item. Windows and texts are written as words between single spaces, so a
match of the automaton is a match of whole words, and its end is turned into word numbers and, for the spans, into
code points of the original text.
"""

from __future__ import annotations

import math
import re
import uuid

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name, written

WINDOW = 13
#: A document is contaminated if this many times its hit words reach its words.
SHARE = 20
#: Benchmark text behind one automaton. A larger benchmark is dealt into parts, each with an automaton and a scan.
MAX_AUTOMATON_BYTES = 4_000_000
PIECE_WORDS = 2_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"

_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_automata: dict[str, object] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))]


def automaton(items: list[tuple[str | None, str]], size: int = WINDOW):
    """Automaton whose values are (words of the window, item ids that have it)."""
    found: dict[str, tuple[int, set]] = {}
    for item_id, text in items:
        for window in windows(normal_words(text), size):
            key = (b" " + b" ".join(window) + b" ").decode("latin-1")
            found.setdefault(key, (len(window), set()))[1].add(item_id)
    out = ahocorasick.Automaton()
    for key, value in found.items():
        out.add_word(key, value)
    if found:
        out.make_automaton()
    return out


def scan(text: str | None, machine) -> tuple[int, int, list[str], list[tuple[int, int]]]:
    """Words, hit words, ids of the items with a window in the text, and the hit passages in code points of the text."""
    words = normal_words(text)
    if not words or not len(machine):
        return len(words), 0, [], []
    line = b" " + b" ".join(words) + b" "
    ends, lengths, items = [], [], set()
    for end, (length, ids) in machine.iter(line.decode("latin-1")):
        ends.append(end)
        lengths.append(length)
        items |= ids
    if not ends:
        return len(words), 0, [], []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    last = np.searchsorted(spaces, ends)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, last - np.array(lengths), 1)
    np.add.at(marks, last, -1)
    hit = np.cumsum(marks[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    places = [m.span() for m in WORD.finditer(text)]
    spans = [(places[a][0], places[b - 1][1]) for a, b in zip(edges[::2], edges[1::2])]
    return len(words), int(hit.sum()), sorted(i for i in items if i is not None), spans


def _pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """item, text: items cut into pieces that overlap by size - 1 words, so that every window lies in one of them."""
    normal = F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    split = benchmark.select(F.col("item_id").cast("string").alias("item"), F.array_remove(F.split(normal, " "), "").alias("w")).where(F.size("w") > 0)
    start = F.expr(f"explode(sequence(0, greatest(0, size(w) - {size}), {PIECE_WORDS}))")
    return split.select("item", "w", start.alias("at")).select("item", F.array_join(F.slice("w", F.col("at") + 1, PIECE_WORDS + size - 1), " ").alias("text")).distinct()


def _scanned(docs: DataFrame, text: str, items: list[tuple[str | None, str]], size: int, out: str) -> DataFrame:
    shared, token = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf(RESULT)
    def matches(texts: pd.Series) -> pd.DataFrame:
        if token not in _automata:
            _automata.clear()
            _automata[token] = automaton(shared.value, size)
        rows = [scan(t, _automata[token]) for t in texts]
        return pd.DataFrame({"n_words": [r[0] for r in rows], "n_hit": [r[1] for r in rows], "items": [r[2] for r in rows],
                             "spans": [[{"start": a, "end": b} for a, b in r[3]] for r in rows]})

    return docs.withColumn(out, matches.asNondeterministic()(text))  # else a plan may scan once per field


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "found", size: int = WINDOW, max_bytes: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """Adds the struct `out`: n_words, n_hit, items (sorted ids) and spans (hit passages, code points of the text).

    The pieces of the benchmark are read by the driver part by part, each part of about `max_bytes`, and broadcast.
    With more parts than one, the texts are scanned once for each and the hit passages united per row.
    """
    pieces = written(_pieces(benchmark.select("item_id", "text"), size), "benchmark-pieces")
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / max_bytes))
    part = F.pmod(F.xxhash64("text"), F.lit(parts))
    read = lambda k: [(r.item, r.text) for r in pieces.where(part == k).orderBy("text", "item").toLocalIterator()]
    if parts == 1:
        return _scanned(docs, text, read(0), size, out)
    row = free_name([*docs.columns, out], "row_no")
    kept = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    each = None
    for k in range(parts):
        one = _scanned(kept.select(row, F.col(text).alias("scanned")), "scanned", read(k), size, "m").select(row, "m.*")
        each = one if each is None else each.unionByName(one)
    found = each.groupBy(row).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    @F.pandas_udf("n_hit long, spans array<struct<start: long, end: long>>")
    def united(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, spans):
            pairs: list[list[int]] = []
            starts = np.array([m.start() for m in WORD.finditer(t or "")]) if len(s) else np.array([])
            for a, b in sorted((x["start"], x["end"]) for x in s):
                # passages that follow each other without a word between them are one passage
                if pairs and np.searchsorted(starts, a) <= np.searchsorted(starts, pairs[-1][1]):
                    pairs[-1][1] = max(pairs[-1][1], b)
                else:
                    pairs.append([a, b])
            rows.append((sum(int(np.searchsorted(starts, b) - np.searchsorted(starts, a)) for a, b in pairs), [{"start": a, "end": b} for a, b in pairs]))
        return pd.DataFrame({"n_hit": [r[0] for r in rows], "spans": [r[1] for r in rows]})

    joined = kept.join(found, row).withColumn("u_", united.asNondeterministic()(text, "spans"))
    fields = F.struct("n_words", F.col("u_.n_hit").alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), F.col("u_.spans").alias("spans"))
    return joined.select(*[kept[c] for c in docs.columns], fields.alias(out))


def is_contaminated(found: Column) -> Column:
    return (found["n_hit"] > 0) & (SHARE * found["n_hit"] >= found["n_words"])


def decontamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans; one row per row of `docs`.

    Null and empty texts have no words and are clean. Null and empty items have no windows; an item without id hits
    words but is not listed. Equal items are all listed. Repeated rows give repeated rows, empty tables an empty or a
    clean result; further columns are ignored.
    """
    c = F.col("found")
    found = contamination(docs.select("doc_id", "text"), benchmark, **options)
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), is_contaminated(c).alias("contaminated"), c["items"].alias("items"), c["spans"].alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that are not contaminated."""
    row = free_name(docs.columns, "row")
    packed = docs.select(F.struct("*").alias(row))
    return contamination(packed, benchmark, f"{row}.text", out="found").where(~is_contaminated(F.col("found"))).select(f"{row}.*")


def oracle_sql(size: int = WINDOW, share: int = SHARE) -> str:
    """`decontamination` of `documents` by `benchmark` in SQL, without the lists of items and spans."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"
    return f"""
with items as (select item_id, {words} w from benchmark),
item_windows as (select distinct cast(item_id as varchar) item, least(len(w), {size}) n, array_to_string(w[i : i + {size - 1}], ' ') x
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - {size - 2}))) i from items where len(w) > 0)),
docs as (select row_number() over () r, doc_id, {words} w from documents),
places as (select r, unnest(range(1, len(w) + 1)) i, unnest(w) word from docs),
ahead as (select r, i, list(word) over (partition by r order by i rows between current row and {size - 1} following) l from places),
spans as (select r, i, n, array_to_string(l[1:n], ' ') x from ahead join (select distinct n from item_windows) s on len(l) >= n),
found as (select r, i, n, item from spans join item_windows using (n, x)),
hit as (select r, count(distinct j) n from (select r, unnest(range(i, i + n)) j from found) group by r),
named as (select r, count(distinct item) n, string_agg(distinct item, ',' order by item) s from found group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(hit.n, 0) as bigint) n_hit, cast(coalesce(named.n, 0) as bigint) n_items, sha256(coalesce(named.s, '')) items_sha256,
  coalesce(hit.n, 0) > 0 and {share} * coalesce(hit.n, 0) >= len(w) contaminated
from docs left join hit using (r) left join named using (r)"""
