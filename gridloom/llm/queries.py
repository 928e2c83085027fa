"""The registered queries of the subpackage, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.lineage import scratch_path
from gridloom.llm import decontaminate, fill_middle, html_text, licenses, merkle, packing, pii, quality, sharding, simhash, token_counts, token_files, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_quality_rules", quality.oracle_sql())
def op3_quality_rules(spark, d):
    return quality.quality_rules(table(spark, d, "documents"))


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


@query("op1_benchmark_decontamination", decontaminate.oracle_sql())
def op1_benchmark_decontamination(spark, d):
    found = decontaminate.decontamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.drop("items", "spans")


@query("op2_pii_candidate_boosting")
def op2_pii_candidate_boosting(spark, d):
    return pii.personal_data(table(spark, d, "documents"))


@query("op8_sharding")
def op8_sharding(spark, d):
    return sharding.sharded(table(spark, d, "documents"))


@query("op9_packing")
def op9_packing(spark, d):
    return packing.packed(table(spark, d, "documents"))


LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op5_url_rules", f"""
with rules(host, path, verdict) as (values {", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in url_rules.RULES)}),
rest as (select row_number() over () n, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end r from pages),
hosts as (select *, regexp_extract(r, '^[^/?#]*') h from rest),
urls as (select n, page_id, {LOWERED.format('h')} host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') path from hosts),
fits as (select u.n, r.host || r.path rule, r.verdict, row_number() over (partition by u.n order by length(r.host || r.path) desc, length(r.host) desc) k
  from urls u join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path))
select page_id, host, path, rule, coalesce(verdict, '{url_rules.DEFAULT}') verdict from urls left join (select * from fits where k = 1) using (n)
""")
def op5_url_rules(spark, d):
    return url_rules.judged(table(spark, d, "pages"), url_rules.default_rules(spark))


@query("op10_html_extraction")
def op10_html_extraction(spark, d):
    return html_text.main_text(table(spark, d, "pages"))


@query("op6_license_scans", licenses.oracle_sql())
def op6_license_scans(spark, d):
    return licenses.scanned(table(spark, d, "documents"), licenses.default_known(spark))


@query("op7_token_counts")
def op7_token_counts(spark, d):
    return token_counts.counted(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


@query("op11_merkle_manifest", merkle.oracle_sql())
def op11_merkle_manifest(spark, d):
    return merkle.verified(table(spark, d, "documents"))


@query("op12_fill_in_middle", fill_middle.oracle_sql())
def op12_fill_in_middle(spark, d):
    return fill_middle.digests(table(spark, d, "documents"))


@query("op13_token_files")
def op13_token_files(spark, d):
    files = token_files.write(table(spark, d, "documents"), scratch_path(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
