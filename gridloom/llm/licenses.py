"""Licence scans by canonical digests. DataFrame functions only.

A text is brought to a canonical form: A-Z lowered, copyright lines dropped, punctuation and white space one space,
equivalent spellings one spelling. The digests of the entire text and, for notices inside other text, of each line
are joined with the digests of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import broadcast_if_small, written
from gridloom.llm.license_texts import EQUIVALENT, KNOWN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that name a holder or a year; "copyright notice" or "copyright holders" at a line's start are text.
COPYRIGHT_LINE = r"^[\x20\x09-\x0D\x23\x25\x2A\x2F;-]*(?:copyright[\x20:,]*(?:\(c\)|\x{A9}|[0-9]|by\b)|\(c\)[\x20]*(?:copyright|[0-9])|\x{A9}|all rights reserved[.\x20\x0D]*$)"
NO_WORD = r"[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]+"
SPELLING = r"(?<![^ ])(?:" + "|".join(EQUIVALENT) + r")(?![^ ])"
#: Known digests that are broadcast at most; 100 bytes each.
MAX_BROADCAST = 50_000


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line, empty for blank and copyright lines."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    line = lambda x: F.when(F.rlike(x, F.lit(COPYRIGHT_LINE)), F.lit("")).otherwise(F.btrim(F.regexp_replace(x, NO_WORD, " ")))
    return F.transform(F.split(low, r"\n"), line)


def one_spelling(line: Column) -> Column:
    """Equivalent spellings replaced word by word; lines without any are passed on."""
    names = F.map_from_arrays(F.array(*[F.lit(k) for k in EQUIVALENT]), F.array(*[F.lit(v) for v in EQUIVALENT.values()]))
    parts = F.zip_with(F.split(line, SPELLING, -1), F.concat(F.transform(F.regexp_extract_all(line, F.lit(SPELLING), F.lit(0)), lambda w: F.element_at(names, w)), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(F.rlike(line, F.lit(SPELLING)), F.array_join(parts, "")).otherwise(line)


def digests(text: Column) -> Column:
    """Digest of the entire canonical text, then those of its lines; null where nothing is left."""
    lines = F.filter(F.transform(canonical_lines(text), one_spelling), lambda x: x != "")
    sha = lambda x: F.when(x != "", F.unhex(F.sha2(x, 256)))
    return F.concat(F.array(sha(F.array_join(lines, " "))), F.transform(lines, sha))


def known_digests(known: DataFrame) -> DataFrame:
    """digest, license_id; the smallest id if several have the same canonical text. `known` has license_id and text."""
    rows = known.select("license_id", digests(F.col("text"))[0].alias("digest"))
    return rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scanned(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, license_id, notices; one row per row of `docs`.

    text_digest is the digest (hex) of the entire canonical text, null if none is left; license_id the licence with
    that text; notices the sorted ids of licences found as single lines, comma-joined, empty if none. Null texts are
    empty. Repeated rows give repeated rows, empty tables an empty result or one without licences; further columns are
    ignored.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_no"))
    rows = written(rows.select("row_no", "doc_id", digests(F.col("text")).alias("digests")), "license-digests")
    table = broadcast_if_small(written(known_digests(known), "known-licenses"), MAX_BROADCAST)
    each = rows.select("row_no", F.posexplode("digests").alias("line", "digest")).where(F.col("digest").isNotNull())
    found = each.join(table, "digest").groupBy("row_no").agg(
        F.min(F.when(F.col("line") == 0, F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("line") > 0, F.col("license_id")))), ",").alias("notices"))
    light = rows.select("row_no", "doc_id", F.lower(F.hex(F.col("digests")[0])).alias("text_digest"))
    return light.join(found, "row_no", "left").select("doc_id", "text_digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def default_known(spark) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def oracle_sql() -> str:
    """The default scan in SQL, the known texts included."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    spell = "map {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in EQUIVALENT.items()) + "}"
    line = f"case when regexp_matches(x, {quoted(COPYRIGHT_LINE)}) then '' else trim(regexp_replace(x, {quoted(NO_WORD)}, ' ', 'g')) end"
    lines = f"list_transform(string_split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), chr(10)), lambda x: {line})"
    spelled = f"list_filter(list_transform({lines}, lambda y: array_to_string(list_transform(string_split(y, ' '), lambda w: coalesce({spell}[w], w)), ' ')), lambda z: z != '')"
    return f"""
with known_texts(license_id, text) as (values {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in KNOWN)}),
known_lines as (select license_id, {spelled} l from known_texts),
known as (select sha256(array_to_string(l, ' ')) digest, min(license_id) license_id from known_lines group by 1),
docs as (select row_number() over () n, doc_id, {spelled} l from documents),
whole as (select n, doc_id, l, case when len(l) > 0 then sha256(array_to_string(l, ' ')) end text_digest from docs),
found as (select distinct n, license_id from (select n, sha256(unnest(l)) digest from docs) join known using (digest))
select doc_id, text_digest, license_id, coalesce((select string_agg(f.license_id, ',' order by f.license_id) from found f where f.n = whole.n), '') notices
from whole left join known on known.digest = text_digest"""
