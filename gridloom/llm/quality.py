"""Quality rules with thresholds from mergeable quantile sketches per language and source. DataFrame functions only.

A text is measured once (`measured`). The measures of all texts are summed into histograms with log-linear buckets,
which are quantile sketches that merge by adding counts and give the same answer whatever the partitioning. Their
quartiles set Tukey fences per (lang, source); groups too small for a quartile use the sketch merged over their
language, then the one merged over all. A join brings the fences back and filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import SPACES, broadcast_if_small, free_name, words, written

#: Measure -> (fence in interquartile ranges, least distance of a fence from its quartile, has a lower fence).
FENCES = {"word_length": (4, 200, True), "symbols": (3, 150, False), "dup_lines": (3, 400, False), "repeats": (3, 350, False)}
#: Groups with fewer texts take their fences from the sketch of a larger one.
MIN_GROUP = 100
#: Groups whose fences are broadcast at most; about 100 bytes each.
MAX_BROADCAST_GROUPS = 50_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _covered(at: Column) -> Column:
    """Words covered by the three-word windows that start at the given places."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).cast("long").alias("last"))
    step = lambda a, x: F.struct((a["total"] + F.least(F.lit(3), x - a["last"])).alias("total"), x.alias("last"))
    return F.aggregate(F.sort_array(at), zero, step, lambda a: a["total"])


def measured(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """Adds the struct `out` of the base counts and the number of lines with a word. Null texts have no words.
    Write the result before filtering by it: a filter pushed below the steps would repeat them.

    Repeated windows: the low bits of each window's hash are replaced by its place, the numbers sorted, and equal
    neighbours compared word by word. If two different windows share the hash bits, whole windows are sorted instead,
    so the count is exact for every text.
    """
    t, w, lines, bits, s, near = (free_name([*docs.columns, out], n) for n in ("q_text", "q_words", "q_lines", "q_bits", "q_sorted", "q_near"))
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(w, words(F.col(t))).withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    df = df.withColumn(bits, F.length(F.bin(F.size(w))))
    none = "cast(array() as array<bigint>)"
    key = f"(shiftleft(shiftrightunsigned(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), {bits}), {bits}) | i)"
    df = df.withColumn(s, F.expr(f"sort_array(if(size({w}) >= 3, transform(sequence(0L, cast(size({w}) - 3 as bigint)), i -> {key}), {none}))"))
    df = df.withColumn(near, F.expr(f"filter({s}, (x, j) -> shiftrightunsigned(x ^ get({s}, j - 1), {bits}) = 0 or shiftrightunsigned(x ^ get({s}, j + 1), {bits}) = 0)"))
    place = lambda x: f"cast({x} & (shiftleft(1L, {bits}) - 1) as int)"
    differ = " or ".join(f"{w}[{place('x')} + {k}] != {w}[{place(f'{near}[j - 1]')} + {k}]" for k in range(3))
    clash = f"exists(transform({near}, (x, j) -> j > 0 and shiftrightunsigned(x ^ get({near}, j - 1), {bits}) = 0 and ({differ})), z -> z)"
    whole = f"array_sort(transform(sequence(0L, cast(size({w}) - 3 as bigint)), i -> struct(concat_ws(' ', {w}[i], {w}[i + 1], {w}[i + 2]) as k, i as i)))"
    exact = f"transform(filter(transform(array({whole}), y -> filter(y, (x, j) -> x.k = get(y, j - 1).k or x.k = get(y, j + 1).k))[0], x -> true), x -> x.i)"
    at = F.expr(f"case when size({near}) = 0 then {none} when {clash} then {exact} else transform({near}, x -> cast({place('x')} as bigint)) end")
    count = lambda c: c.cast("long")
    found = F.struct(
        count(F.size(w)).alias("n_words"), count(F.length(F.array_join(w, ""))).alias("word_chars"), count(F.regexp_count(t, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        count(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), count(_covered(at)).alias("n_repeat_words"), count(F.size(lines)).alias("n_lines"),
    )
    return df.withColumn(out, found).drop(t, w, lines, bits, s, near)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def measures(q: Column) -> dict[str, Column]:
    """Whole numbers: hundredths of a letter for the mean word length, else thousandths of the words or lines."""
    part = lambda a, b, unit: F.floor(unit * q[a] / F.greatest(q[b], F.lit(1))).cast("long")
    return {"word_length": part("word_chars", "n_words", 100), "symbols": part("n_symbols", "n_words", 1000), "dup_lines": part("n_dup_lines", "n_lines", 1000), "repeats": part("n_repeat_words", "n_words", 1000)}


def bucket(value: Column) -> Column:
    """Lower edge of a value's bucket: exact below 64, then 32 buckets an octave."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(stats: DataFrame, q: str = "quality", lang: str = "lang", source: str = "source") -> DataFrame:
    """Sketch of each measure per group: lang, source, measure, value (bucket), n. Texts that fail a base rule stay out."""
    rows = stats.where(~base_failed(F.col(q)))
    each = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("value")) for k, v in measures(F.col(q)).items()])
    return rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(each).alias("m")).groupBy("lang", "source", F.col("m.measure").alias("measure"), F.col("m.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source, and for each measure its fences, from the smallest level whose sketch holds `min_group` texts."""
    none = F.lit(None).cast("string")
    groups = [(F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)]
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), a.alias("g_lang"), b.alias("g_source")) for i, (a, b) in enumerate(groups)])).alias("g")
    keys = ["level", "g_lang", "g_source", "measure"]
    merged = sketch.select("measure", "value", "n", level).groupBy("g.level", "g.g_lang", "g.g_source", "measure", "value").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("value")
    spread = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("value")))
    cut = spread.groupBy(*keys).agg(F.max("all").alias("n"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    widest = lambda k: F.greatest(FENCES[k][0] * (F.col("q3") - F.col("q1")), F.lit(FENCES[k][1]))
    high = [F.max(F.when(F.col("measure") == k, F.col("q3") + widest(k))).alias(f"max_{k}") for k in FENCES]
    low = [F.max(F.when(F.col("measure") == k, F.col("q1") - widest(k))).alias(f"min_{k}") for k in FENCES if FENCES[k][2]]
    wide = cut.groupBy(*keys[:3]).agg(F.max("n").alias("n"), *high, *low).where((F.col("n") >= min_group) | (F.col("level") == 2))
    limits = F.struct(*[F.col(c) for c in wide.columns if c.startswith(("max_", "min_"))])
    wanted = sketch.select("lang", "source").distinct().select("lang", "source", level).select("lang", "source", "g.*")
    wide = wide.select(F.col("level").alias("w_level"), F.col("g_lang").alias("w_lang"), F.col("g_source").alias("w_source"), limits.alias("limits"))
    same = (F.col("level") == F.col("w_level")) & F.col("g_lang").eqNullSafe(F.col("w_lang")) & F.col("g_source").eqNullSafe(F.col("w_source"))
    return wanted.join(wide, same).groupBy("lang", "source").agg(F.min_by("limits", "level").alias("limits"))


def judged(stats: DataFrame, q: str = "quality", lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP, out: str = "kept") -> DataFrame:
    """Adds `out`: whether a text passes the base rules and lies within its group's fences.

    `stats` is read twice, so it should be a written table. A group without any text that passes the base rules has
    no fences, and none of its texts is kept. A hot (lang, source) pair meets one row of fences: by broadcast while the
    groups are counted to be few, by a join that AQE can split beyond.
    """
    g_lang, g_source, limits = (free_name([*stats.columns, out], n) for n in ("fence_lang", "fence_source", "fence_limits"))
    table = fences(sketches(stats, q, lang, source), min_group).select(F.col("lang").alias(g_lang), F.col("source").alias(g_source), F.col("limits").alias(limits))
    table = broadcast_if_small(written(table, "fences"), MAX_BROADCAST_GROUPS)
    joined = stats.join(table, F.col(lang).eqNullSafe(F.col(g_lang)) & F.col(source).eqNullSafe(F.col(g_source)), "left")
    inside = F.lit(True)
    for k, v in measures(F.col(q)).items():
        inside = inside & (v <= F.col(limits)[f"max_{k}"])
        if FENCES[k][2]:
            inside = inside & (v >= F.col(limits)[f"min_{k}"])
    return joined.withColumn(out, ~base_failed(F.col(q)) & F.coalesce(inside, F.lit(False))).drop(g_lang, g_source, limits)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; one row per row of `docs`.

    Null and empty texts have no words and fail; null doc_id, lang or source are values like others; repeated rows give
    repeated rows; an empty table gives an empty one; further columns are ignored.
    """
    stats = written(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"), "measured")
    q = F.col("quality")
    return judged(stats).select("doc_id", *[q[c].alias(c) for c in BASE], base_failed(q).alias("base_failed"), "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that `quality_rules` keeps. Texts are written once beside their measures."""
    row, q, kept = (free_name(docs.columns, n) for n in ("row", "quality", "kept"))
    lang, source = (free_name([*docs.columns, row, q, kept], n) for n in ("group_lang", "group_source"))
    packed = docs.select(F.struct("*").alias(row), F.col("text").alias("text"), F.col("lang").alias(lang), F.col("source").alias(source))
    stats = written(measured(packed, "text", q).drop("text"), "measured")
    return judged(stats, q, lang, source, out=kept).where(F.col(kept)).select(f"{row}.*")


def oracle_sql(min_group: int = MIN_GROUP) -> str:
    """`quality_rules` over `documents` in SQL."""
    word, space = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    names = list(FENCES)
    high = ", ".join(f"max(case when measure = '{k}' then q3 + greatest({FENCES[k][0]} * (q3 - q1), {FENCES[k][1]}) end) max_{k}" for k in names)
    low = ", ".join(f"max(case when measure = '{k}' then q1 - greatest({FENCES[k][0]} * (q3 - q1), {FENCES[k][1]}) end) min_{k}" for k in names if FENCES[k][2])
    inside = " and ".join([f"{k} <= max_{k}" for k in names] + [f"{k} >= min_{k}" for k in names if FENCES[k][2]])
    return f"""
with docs as (select row_number() over () r, doc_id, lang, source, coalesce(text, '') t from documents),
split as (select *, regexp_extract_all(t, '{word}') w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{space}')) lines from docs),
windows as (select r, i, count(*) over (partition by r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) n from (select r, w, unnest(range(1, len(w) - 1)) i from split where len(w) >= 3)),
hit as (select r, count(distinct i + k) n from windows, (values (0), (1), (2)) s(k) where n > 1 group by r),
counted as (select s.r, doc_id, lang, source, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) n_dup_lines,
  cast(coalesce(hit.n, 0) as bigint) n_repeat_words, len(lines) n_lines from split s left join hit using (r)),
stats as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, 100 * word_chars // greatest(n_words, 1) word_length, 1000 * n_symbols // greatest(n_words, 1) symbols,
  1000 * n_dup_lines // greatest(n_lines, 1) dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) repeats from counted),
each as ({" union all ".join(f"select lang, source, '{k}' measure, {k} v from stats where not base_failed" for k in names)}),
sketch as (select lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) v, count(*) n from each group by all),
levels as (select 0 level, lang, source, measure, v, n from sketch union all select 1, lang, null, measure, v, n from sketch union all select 2, null, null, measure, v, n from sketch),
merged as (select level, lang, source, measure, v, sum(n) n from levels group by all),
upto as (select *, sum(n) over (partition by level, lang, source, measure order by v) u, sum(n) over (partition by level, lang, source, measure) a from merged),
cut as (select level, lang, source, measure, max(a) n, min(v) filter (4 * u >= a) q1, min(v) filter (4 * u >= 3 * a) q3 from upto group by all),
wide as (select level, lang, source, max(n) n, {high}, {low} from cut group by all having max(n) >= {min_group} or level = 2),
chosen as (select g.lang, g.source, w.* exclude (lang, source, n), row_number() over (partition by g.lang, g.source order by w.level) k from (select distinct lang, source from sketch) g
  join wide w on (w.level = 2 or w.lang is not distinct from g.lang) and (w.level > 0 or w.source is not distinct from g.source))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({inside}, false) kept
from stats s left join (select * from chosen where k = 1) c on c.lang is not distinct from s.lang and c.source is not distinct from s.source"""
