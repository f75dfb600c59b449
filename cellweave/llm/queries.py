"""The queries opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import neighbours, packing, quality, rank_queue, secrets, sharding, simhash, suffix_family, token_files, warc

LIBRARY_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANK_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), LIBRARY_VOCABULARY)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_family.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), LIBRARY_VOCABULARY)


def op6_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_queue.encode_documents(_table(spark, sf_dir, "documents"), RANK_VOCABULARY)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *quality.BASE, "base_failed", "kept")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


OP1_SQL = """
with told as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), slim as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from told
), grouped as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) end as first
  from slim
)
select page_id, payload_bytes, payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from grouped
"""


def _op8_sql() -> str:
    limits = {"class": 0.29, "word": 0.295}
    lists = " ".join(f"when '{lang}' then {listed!r}" for lang, listed in quality.COMMON.items())
    classes = ", ".join(f"length(rest) - length(regexp_replace(rest, '{p}', '', 'g'))" for p in quality.CLASSES.values())
    return f"""
with texts as (
  select row_number() over () as rid, doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents
), cut as (
  select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
         regexp_replace(text, '[a-z\\x20\\x09-\\x0D]+', '', 'g') as rest,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
         case lang {lists} else []::varchar[] end as stop
  from texts
), told as (
  select rid, doc_id, lang, words, stop, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines, length(text) as n_chars, length(rest) as n_rest,
         [{classes}] as marked
  from cut
), windows as (
  select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as trio
  from (select rid, words, unnest(range(1, greatest(1, n_words - 1))) as i from told)
), again as (
  select rid, i from windows qualify count(*) over (partition by rid, trio) > 1
), repeated as (
  select rid, count(distinct i + k) as n from again, (values (0), (1), (2)) t(k) group by rid
), based as (
  select t.*, coalesce(r.n, 0) as n_repeat_words, n_words < 50 or 100 * coalesce(r.n, 0) > 50 * n_words as base_failed
  from told t left join repeated r using (rid)
), bins as (
  select rid, lang, base_failed, 'class' as kind, unnest(range(0, 2 + len(marked))) as bin, unnest(list_concat([word_chars - n_rest, n_chars - word_chars], marked)) as n from based
  union all
  select rid, lang, base_failed, 'word', unnest(range(0, len(stop) + 1)),
         unnest(list_append(list_transform(stop, lambda s: len(list_filter(words, lambda w: w = s))), len(list_filter(words, lambda w: not list_contains(stop, w)))))
  from based where len(stop) > 0
), shares as (
  select *, n / nullif(sum(n) over (partition by rid, kind), 0) as p,
         sum(n) filter (where not base_failed) over (partition by lang, kind, bin) / nullif(sum(n) filter (where not base_failed) over (partition by lang, kind), 0) as q
  from bins
), distances as (
  select rid, kind, sqrt(greatest(0, sum(
    case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as d
  from shares where p is not null and q is not null group by rid, kind
), verdict as (
  select t.*, c.d as by_class, w.d as by_word
  from based t
  left join distances c on c.rid = t.rid and c.kind = 'class'
  left join distances w on w.rid = t.rid and w.kind = 'word'
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       base_failed, not base_failed
       and not (n_chars >= 200 and coalesce(by_class, 0) > {limits["class"]})
       and not (n_words >= 100 and coalesce(by_word, 0) > {limits["word"]}) as kept
from verdict
"""


def _op7_sql() -> str:
    """Positions come from the lengths of what lies between matches, as DuckDB's expressions have no offsets."""
    every = secrets.BASE + secrets.MORE
    parts = []
    for n, rule in enumerate(every):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"select rid, {n} as n, '{rule.kind}' as kind, {rule.least} as least, string_split_regex(text, '{pattern}') as between, "
            f"regexp_extract_all(text, '{pattern}', 0) as found, regexp_extract_all(text, '{pattern}', {rule.value_group}) as held from texts"
        )
    return f"""
with texts as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), cut as (
  {" union all ".join(parts)}
), each as (
  select rid, n, kind, least, unnest(range(1, len(found) + 1)) as i, unnest(found) as match, unnest(held) as value,
         unnest(between[1:len(found)]) as gap from cut where len(found) > 0
), placed as (
  select rid, n, kind, length(match) as size, length(value) >= least as good,
         sum(length(gap) + length(match)) over (partition by rid, n order by i) as upto from each
), spans as (
  select rid, n, upto - size as start, kind || ':' || (upto - size)::bigint || ':' || upto::bigint as span from placed where good
), told as (
  select rid, string_agg(span, ',' order by start, n) as spans, string_agg(span, ',' order by start, n) filter (where n < 3) as base,
         count(*) filter (where n = 0) as n_assign, count(*) filter (where n = 1) as n_access, count(*) filter (where n = 2) as n_hex
  from spans group by rid
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join told using (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_packing, op3_suffix_dedup, op4_simhash, op5_token_files, op6_rank_queue, op7_secrets, op8_quality, op9_neighbours, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op7_secrets": _op7_sql(), "op8_quality": _op8_sql()}
