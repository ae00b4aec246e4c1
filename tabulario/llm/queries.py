"""The registered queries over the text tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabulario.llm import (
    alignment, exact_dedup, fingerprints, html_text, ngram_join, packing, sentencepiece_fst, spelling, substring, token_counts, toxicity, url_filter, winnowing,
)
from tabulario.llm.ship import send_package


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        send_package(spark)
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return read


documents, pages, labels, benchmark = _table("documents"), _table("pages"), _table("labels"), _table("benchmark")


BYTE_BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(documents(spark, sf_dir))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(pages(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), *BYTE_BPE)


def op4_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.round_trip(documents(spark, sf_dir), PIECE_MODEL)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed_words(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), PIECE_MODEL)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(pages(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_links(documents(spark, sf_dir), BYTE_BPE, PIECE_MODEL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_html_extraction, op3_best_fit_packing,
        op4_sentencepiece_fst, op5_toxicity, op6_substring_dedup, op7_token_counts, op8_fingerprints, op9_url_filter, op10_exact_dedup,
        op11_spelling_variants, op12_benchmark_decontamination, op13_tokenizer_alignment,
    )}


_URL_SQL = r"""
with parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
), rules(verdict, host, path) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits as (
  select p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
  from (select distinct page_id, host, path from parts) p
  join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  group by p.page_id
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fits f using (page_id)
"""

_EXACT_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""


_LEAKS_SQL = r"""
with words as (
  select doc_id, row_number() over () as k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), item_windows as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as x
  from (select item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as i from items where len(w) > 0)
), doc_windows as (
  select k, i, n, array_to_string(w[i : i + n - 1], ' ') as x
  from (select k, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from words, (select distinct n from item_windows) where len(w) >= n)
), hits as (
  select d.k, d.i, d.n, v.item_id from doc_windows d join item_windows v using (n, x)
), hit_words as (
  select k, count(distinct p) as n_hit from (select k, unnest(generate_series(i, i + n - 1)) as p from hits) group by k
), hit_items as (
  select k, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as items_sha256 from (select distinct k, item_id::varchar as id from hits) group by k
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
from words left join hit_words using (k) left join hit_items using (k)
"""


def oracle_sql() -> dict[str, str]:
    """The text tables hold no canonical links or refreshes, so rules alone decide in the SQL of op9."""
    return {"op9_url_filter": _URL_SQL, "op10_exact_dedup": _EXACT_SQL, "op12_benchmark_decontamination": _LEAKS_SQL}
