"""Fill-in-the-middle transformation with cuts between lines.

A text is cut into units, lines with their line feed. A Fenwick tree over blocks of `BLOCK` bytes keeps how many units end
and how many code points begin in each. The descent by binary lifting finds the block in which the wanted unit ends, with
the code points before it; only that block is then searched. Restoring needs the output and its form alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
BLOCK = 4096


class UnitTree:
    """Fenwick tree over blocks of a text's UTF-8 bytes; counts[i] sums (unit ends, code points) of its range of blocks."""

    def __init__(self, raw: bytes, block: int = BLOCK):
        self.raw, self.block = raw, block
        data = np.frombuffer(raw, np.uint8)
        n = -(-len(data) // block)
        counts = np.zeros((n + 1, 2), np.int64)
        if n:
            starts = np.arange(0, len(data), block)
            counts[1:, 0] = np.add.reduceat(data == 10, starts, dtype=np.int64)
            counts[1:, 1] = np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64)
        self.n_units = int(counts[:, 0].sum()) + int(bool(raw) and not raw.endswith(b"\n"))
        self.n_points = int(counts[:, 1].sum())
        step = 1
        while step <= n:  # parents take their children's sums, one level at a time
            at = np.arange(2 * step, n + 1, 2 * step)
            counts[at] += counts[at - step]
            step *= 2
        self.counts, self.top = counts, step // 2

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first `units` units."""
        if units <= 0:
            return 0, 0
        if units >= self.n_units:
            return len(self.raw), self.n_points
        at, left, points, step = 0, units, 0, self.top
        while step:
            if at + step < len(self.counts) and self.counts[at + step, 0] < left:
                at += step
                left -= int(self.counts[at, 0])
                points += int(self.counts[at, 1])
            step //= 2
        piece = np.frombuffer(self.raw, np.uint8, min(self.block, len(self.raw) - at * self.block), at * self.block)
        end = int(np.flatnonzero(piece == 10)[left - 1]) + 1
        return at * self.block + end, points + int(np.count_nonzero((piece[:end] & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits drawn for a document; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest[:16], ">u4").tolist()


def transform(doc_id: int | None, text: str | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, block: int = BLOCK) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    tree = UnitTree(raw, block)
    n, h = tree.n_units, draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, before), (b, upto) = tree.cut(first), tree.cut(last)
    prefix, middle, suffix = (x.decode("utf-8", "surrogatepass") for x in (raw[:a], raw[a:b], raw[b:]))
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    head = f"{SUFFIX}{suffix}{PREFIX}{prefix}" if form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}"
    return n, form, before, upto - before, f"{head}{MIDDLE}{middle}"


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """`docs`, all rows and columns, with n (units), form, prefix_chars, middle_chars and output; columns of those names are replaced.

    `rate` of 100 texts are transformed, `spm_rate` of 100 of those with the suffix first. Null and empty texts, texts that
    hold a marker and those not drawn are plain: the output is the text, empty for null. Repeated rows give equal rows,
    an empty table an empty one. A text without line feeds is one unit.
    """

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def made(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transform(int(i) if i is not None else None, t, seed, rate, spm_rate) for i, t in zip(ids, texts)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    name = free_name(docs.columns, "made")
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in docs.columns if c.lower() not in new]
    return docs.withColumn(name, made(F.col("doc_id").cast("string"), "text")).select(*kept, f"{name}.*")


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made from; a marker cannot occur in it, nor across the border of one."""
    after = lambda c, mark: F.substring_index(c, mark, -1)
    head, middle = F.substring_index(output, MIDDLE, 1), after(output, MIDDLE)
    psm = F.concat(after(F.substring_index(head, SUFFIX, 1), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(F.substring_index(head, PREFIX, 1), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, **settings: int) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text rebuilt from it."""
    made = transformed(docs.select("doc_id", "text"), **settings)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def oracle_sql(seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> str:
    h = lambda i: f"cast('0x' || substr(x, {8 * i + 1}, 8) as ubigint)"
    marked = " or ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
with a as (select doc_id, coalesce(text, '') t, sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')) x from documents),
b as (select *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') l, {', '.join(f"{h(i)} h{i + 1}" for i in range(4))} from a),
c as (select *, cast(len(l) as bigint) n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) p, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) m,
  case when t = '' or {marked} or h3 % 100 >= {rate} then 'plain' when h4 % 100 < {spm_rate} then 'spm' else 'psm' end form from b),
d as (select *, array_to_string(l[1:p], '') pre, array_to_string(l[p + 1:m], '') mid, array_to_string(l[m + 1:], '') suf from c)
select doc_id, n, form, case when form <> 'plain' then cast(length(pre) as bigint) end prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid else '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid end) output_sha256,
  sha256(t) restored_sha256 from d"""
