"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontaminate, hard_negatives, html_extract, importance, jaccard_join, license_scan, line_dedup, lm_score, media, packing, secrets, toxicity, url_filter
from weft.llm._common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), least_words=line_dedup.ALL_LINES)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_secret_scan": op2_secret_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_media_columns": op4_media_columns,
    "op5_decontamination": op5_decontamination,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_line_dedup": op9_line_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_license_scan": op13_license_scan,
}

_OP8_SQL = r"""
with recursive urls as (
  select url, html, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
  from (select coalesce(url, '') as url, html from pages)
), tags as (
  select distinct url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) as tag from urls
), values_ as (
  select url, tag,
    regexp_extract(tag, '(?i)\brel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 1) || regexp_extract(tag, '(?i)\brel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 2) || regexp_extract(tag, '(?i)\brel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 3) as rel,
    regexp_extract(tag, '(?i)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 1) || regexp_extract(tag, '(?i)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 2) || regexp_extract(tag, '(?i)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 3) as href,
    regexp_extract(tag, '(?i)\bhttp-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 1) || regexp_extract(tag, '(?i)\bhttp-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 2) || regexp_extract(tag, '(?i)\bhttp-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 3) as equiv,
    regexp_extract(tag, '(?i)\bcontent\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 1) || regexp_extract(tag, '(?i)\bcontent\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 2) || regexp_extract(tag, '(?i)\bcontent\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 3) as content
  from tags
), targets as (
  select url, trim(replace(case when regexp_matches(tag, '(?i)^<link') and regexp_matches(rel, '(?i)(^|\s)canonical(\s|$)') then href
    when regexp_matches(tag, '(?i)^<meta') and regexp_matches(equiv, '(?i)^\s*refresh\s*$') then regexp_extract(content, '(?i)url\s*=\s*[''"]?([^''"]*)', 1) else '' end, '&amp;', '&')) as t
  from values_
), based as (
  select url, t, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from targets where t <> ''
), absolute as (
  select url, case when position('://' in t) > 0 then t when starts_with(t, '//') then 'http:' || t
    when starts_with(t, '/') then 'http://' || translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || t
    else 'http://' || translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || case when regexp_extract(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '^(.*/)?') = '' then '/' else regexp_extract(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '^(.*/)?') end || t end as target
  from based
), keyed as (
  select distinct u, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    case when starts_with(regexp_extract(r, '^[^/?#]*([^#]*)', 1), '/') then '' else '/' end || regexp_extract(r, '^[^/?#]*([^#]*)', 1) as tail
  from (select u, case when position('://' in u) > 0 then substr(u, position('://' in u) + 3) else '' end as r from (select url as u from urls union select target from absolute))
), nodes as (
  select u, host || tail as node, host, regexp_extract(tail, '^[^?]*') as path from keyed where host <> ''
), edges as (
  select x.node as a, y.node as b from absolute join nodes x on x.u = absolute.url join nodes y on y.u = absolute.target where x.node <> y.node
), ways as (select a, b from edges union select b, a from edges
), reach as (
  select a as node, a as other from ways union select r.node, w.b from reach r join ways w on w.a = r.other
), fits as (
  select node, host, path, r.* from (select distinct node, host, path from nodes) n join (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) r(verdict, rule_host, rule_path)
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
), own as (
  select node, arg_max(verdict, length(rule_host) + length(rule_path)) as verdict from fits group by node
), method as (
  select reach.node, case when bool_or(own.verdict = 'allow') then 'allow' when bool_or(own.verdict = 'block') then 'block' end as verdict
  from reach left join own on own.node = reach.other group by reach.node
), judged as (
  select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, coalesce(url, '') as url, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages)
), ruled as (
  select *, case when host = 'www.example.com' or ends_with(host, '.www.example.com') then case when starts_with(path, '/en/') then 'www.example.com/en/' end end as r1,
    case when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/' end as r2,
    case when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/' when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/' end as r3,
    case when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as r4
  from judged
)
select page_id, ruled.host, ruled.path, coalesce(r1, r2, r3, r4) as rule,
  case coalesce(r1, r2, r3, r4) when 'www.example.com/en/' then 'allow' when 'com/' then 'allow' when 'example.com/en/' then 'block' when 'net/es/' then 'block' when 'net/fr/' then 'block' else coalesce(method.verdict, 'allow') end as verdict
from ruled left join nodes on nodes.u = ruled.url left join method on method.node = nodes.node
"""

_OP11_SQL = """
with whole as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scores as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from whole a join whole b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)::int as rank, s.id as negative_id, p.positive_score, s.score as negative_score
from positives p join scores s on s.anchor_id = p.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify rank <= 5
"""

#: crc32 by a table of 256 numbers that SQL makes itself, byte after byte.
_OP12_SQL = r"""
with steps as (
  select list(c order by b) as t from (select b, list_reduce(list_prepend(b, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as b))
), words as (
  select 's' as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all select 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), features as (
  select side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from words
), hexed as (
  select f, hex(encode(f)) as h from (select distinct f from features)
), buckets as (
  select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint)), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 10000 as bucket
  from hexed, steps
), counted as (
  select bucket, count(*) filter (side = 's')::double as s, count(*) filter (side = 't')::double as t from features join buckets using (f) group by bucket
), gains as (
  select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000)))) as gain from counted
), weights as (
  select id, count(*) as n_features, floor(sum(gain) / count(*))::bigint as weight from features join buckets using (f) join gains using (bucket) where side = 's' group by id
), scored as (
  select id as doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::bigint + 0.5::double) / 4294967296))))::bigint as score
  from words left join weights using (id) where side = 's'
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_words >= 20
)
select scored.doc_id, n_features, weight, score, case when rank <= 25 * n // 100 then rank end as rank from scored left join ranked using (doc_id)
"""


def _op13_sql() -> str:
    """The same templates, all pairs of blocks and templates."""
    words = lambda x: f"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    notices = ", ".join("('{}', '{}')".format(label, text.replace("'", "''")) for label, text in license_scan.TEMPLATES)
    return rf"""
with notices as (select label, list_distinct({words("text")}) as own from (values {notices}) n(label, text)
), docs as (select doc_id, coalesce(text, '') as text, {words("coalesce(text, '')")} as w from documents
), blocks as (
  select doc_id, block from (select doc_id, unnest(string_split(text, chr(10))) as block from docs)
  union all select doc_id, block from (select doc_id, unnest(regexp_split_to_array(text, '\n[ \t\v\f\r]*\n')) as block from docs) where contains(trim(block, chr(10)), chr(10))
), sets as (select distinct doc_id, list_distinct({words("block")}) as words from blocks
), shares as (
  select doc_id, label, len(own) as n, len(list_intersect(own, words)) as shared from sets join notices on len(words) * 100 >= 90 * len(own)
), held as (select doc_id, list(distinct label) as found, max(shared / n) as score from shares where 100 * shared >= 90 * n group by doc_id
), places as (
  select doc_id, unnest(range(len(w))) as k, w from docs
), phrases as (
  select doc_id, case when w[k + 1] = 'mit' and w[k + 2] = 'license' then 'mit' when w[k + 1] = 'apache' and w[k + 2] = 'license' then 'apache' when w[k + 1] = 'general' and w[k + 2] = 'public' and w[k + 3] = 'license' then 'gpl' end as label, k from places
), base as (select doc_id, count(*) as n_base, min(k) as first_word, max(k) as last_word, list(distinct label) as found from phrases where label is not null group by doc_id)
select docs.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.found), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(coalesce(base.found, []) || coalesce(held.found, []))), ','), '') as labels, coalesce(score, 0)::double as score
from docs left join base using (doc_id) left join held using (doc_id)
"""


ORACLE_SQL: dict[str, str] = {"op8_url_filter": _OP8_SQL, "op11_hard_negatives": _OP11_SQL, "op12_importance_resampling": _OP12_SQL, "op13_license_scan": _op13_sql()}
