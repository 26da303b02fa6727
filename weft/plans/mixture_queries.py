"""Queries on conversations and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as X
from weft.functions.determinism import shuffled, with_ordinal
from weft.operators import conversation as C
from weft.operators import mixture as M
from weft.plans.registry import query, table

_TURNS = """turns as (select conv_id, role, text, turn, row_number() over (partition by conv_id order by turn, role, text) as k from conversations),
users as (select conv_id, min(k) as u from turns where role = 'user' group by conv_id),
answers as (select t.conv_id, min(k) as a from turns t join users on users.conv_id = t.conv_id where role = 'assistant' and k > u group by t.conv_id),
pairs as (select users.conv_id, ut.text as instruction, tt.text as response from users left join answers on answers.conv_id = users.conv_id
  join turns ut on ut.conv_id = users.conv_id and ut.k = u left join turns tt on tt.conv_id = users.conv_id and tt.k = a)"""


def conversations(spark, sf_dir):
    return C.gather(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(f"with {_TURNS} select cast(conv_id as varchar) as row_id, instruction, response from pairs where response is not null")
def instruction_pairs(spark, sf_dir):
    good, _ = C.instruction_pairs(conversations(spark, sf_dir))
    return good.select(F.col("conv_id").cast("string").alias("row_id"), "instruction", "response")


@query(f"with {_TURNS} select ids.conv_id, pairs.instruction is null as no_user from (select distinct conv_id from conversations) ids left join pairs on pairs.conv_id = ids.conv_id where response is null")
def quarantined_conversations(spark, sf_dir):
    _, bad = C.instruction_pairs(conversations(spark, sf_dir))
    return bad.select("conv_id", F.col("instruction").isNull().alias("no_user"))


@query(
    f"""with {_TURNS} select 'chat' as source_dataset_id, cast(conv_id as varchar) as row_id, 'train' as split, 'train' as source_split, 'text' as modality_label, '{{"kind": "chat", "version": 1}}' as render_config,
cast(length(response) as bigint) as original_token_length, 'user|assistant' as roles, instruction || '|' || response as texts, cast(0 as integer) as n_images from pairs where response is not null"""
)
def canonical_rows(spark, sf_dir):
    good, _ = C.instruction_pairs(conversations(spark, sf_dir))
    rows = C.canonical(good, source="chat", split="train", instruction=F.col("instruction"), target=F.col("response"), identity=C.row_id(good, F.lit(0), "conv_id"), config=C.config_json(version=1, kind="chat"))
    texts = F.flatten(F.transform("messages", lambda m: F.transform(m["content"], lambda p: p["text"])))
    return rows.select(
        "source_dataset_id", "row_id", "split", "source_split", "modality_label", "render_config", "original_token_length",
        F.array_join(F.transform("messages", lambda m: m["role"]), "|").alias("roles"), F.array_join(texts, "|").alias("texts"), F.size("images").alias("n_images"),
    )


@query(
    """select conv_id, coalesce(min_by(text, k) filter (where role = 'assistant'), '') as first_text, coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '') as joined,
coalesce(string_agg(text, ' ' order by k) filter (where role = 'assistant'), '') as spaced
from (select *, row_number() over (partition by conv_id order by turn, role, text) as k from conversations) group by conv_id"""
)
def assistant_text(spark, sf_dir):
    turns = F.col("turns")
    return conversations(spark, sf_dir).select("conv_id", X.assistant_text(turns).alias("first_text"), X.assistant_text(turns, "all").alias("joined"), X.assistant_text(turns, "all", " ").alias("spaced"))


@query(
    """with t as (select *, row_number() over (partition by conv_id order by turn, role, text) as k, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as b from conversations),
e as (select conv_id, count(*) as n, max(role) filter (where k = 1) as f, max(role) filter (where b = 1) as l, bool_or(role not in ('user', 'assistant')) as odd from t group by conv_id)
select conv_id, case when n < 2 then 'fewer than 2 messages' else concat_ws(';', case when f <> 'user' then 'first role ' || f end, case when l <> 'assistant' then 'last role ' || l end, case when odd then 'unexpected role' end) end as errors from e"""
)
def schema_errors(spark, sf_dir):
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text"))).alias("content")))
    errors = C.schema_errors(messages, F.array().cast("array<string>"))
    return conversations(spark, sf_dir).select("conv_id", F.array_join(errors, ";").alias("errors"))


@query("select doc_id, n_chars from documents where n_chars <= 0 or n_chars + doc_id % 5 * 282 + 256 <= 2048")
def token_budget_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return M.token_budget(docs, 2048, 282, "n_chars", F.col("doc_id") % 5).select("doc_id", "n_chars")


@query("with o as (select l_orderkey, count(*) as n_images from lineitem group by 1) select n_images, count(*) as orders from o where n_images <= 4 group by 1")
def image_count_histogram(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_images"))
    return M.image_limit(orders, 4, F.col("n_images")).groupBy("n_images").agg(F.count("*").alias("orders"))


@query(
    """with d as (select lang, n_chars, n_chars + doc_id % 3 * 282 + 256 as need from documents)
select lang, count(*) as rows_before, count(*) filter (where n_chars <= 0 or need <= 1500) as rows_after, round(count(*) filter (where n_chars <= 0 or need <= 1500) / count(*), 6) as fraction,
count(*) - count(*) filter (where n_chars <= 0 or need <= 1500) as dropped, cast(max(need) filter (where n_chars > 0) as bigint) as longest from d group by lang"""
)
def retention_by_lane(spark, sf_dir):
    return M.retention(table(spark, sf_dir, "documents"), 1500, 282, ["lang"], F.col("n_chars"), F.col("doc_id") % 3)


@query(
    """select cap, count(*) filter (where n_chars <= cap) as rows_kept, round(count(*) filter (where n_chars <= cap) / count(*), 6) as fraction, round(avg(case when n_chars <= cap then least(n_chars, 500) / n_chars end), 6) as readable
from documents cross join (values (500), (1000), (2000), (4000)) caps(cap) group by cap"""
)
def duration_cap_whatif(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("n_chars")
    caps = [500, 1000, 2000, 4000]
    kept = F.col("n_chars") <= F.col("cap")
    crossed = docs.withColumn("cap", F.explode(F.array(*map(F.lit, caps))))
    share = F.coalesce(F.try_divide(F.least("n_chars", F.lit(500)), F.col("n_chars")), F.lit(float("nan")))  # NaN for an empty text, as in SQL
    return crossed.groupBy("cap").agg(F.count_if(kept).alias("rows_kept"), F.round(F.count_if(kept) / F.count("*"), 6).alias("fraction"), F.round(F.avg(F.when(kept, share)), 6).alias("readable"))


@query("select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as k from documents) where k >= 37 and k < 87")
def offset_slice(spark, sf_dir):
    return M.take_slice(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 37, 50)


@query("select doc_id, cast(row_number() over (order by md5('42|' || doc_id), doc_id) - 1 as bigint) as position from documents")
def seeded_shuffle(spark, sf_dir):
    return shuffled(table(spark, sf_dir, "documents").select("doc_id"), 42, "doc_id", name="position")


@query("select doc_id from documents order by md5('42|' || doc_id), doc_id limit 60")
def bounded_sample(spark, sf_dir):
    return M.bounded_sample(table(spark, sf_dir, "documents").select("doc_id"), 60, 42, "doc_id")


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by md5('7|' || doc_id), doc_id) as k from documents) where k <= 5")
def cap_per_lane(spark, sf_dir):
    return M.bounded_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), 5, 7, "doc_id", by=["source"])


@query("select doc_id, case when row_number() over (order by md5('42|' || doc_id), doc_id) <= floor(0.9 * count(*) over ()) then 'train' else 'validation' end as split from documents")
def split_90_10(spark, sf_dir):
    return M.split(table(spark, sf_dir, "documents").select("doc_id"), 0.9, 42, "doc_id")


_PARTS = """parts as (select 'documents' as source_dataset_id, cast(doc_id as varchar) as row_id, length(text) as tokens from documents
union all select 'benchmark', cast(item_id as varchar), length(text) from benchmark union all select 'conversations', conv_id || '-' || turn, length(text) from conversations)"""


def _parts(spark, sf_dir):
    part = lambda name, key: table(spark, sf_dir, name).select(F.lit(name).alias("source_dataset_id"), key.cast("string").alias("row_id"), F.length("text").cast("long").alias("tokens"))
    return part("documents", F.col("doc_id")), part("benchmark", F.col("item_id")), part("conversations", F.concat_ws("-", "conv_id", "turn"))


@query(f"with {_PARTS} select *, cast(row_number() over (order by md5('3|' || source_dataset_id || '|' || row_id), source_dataset_id, row_id) - 1 as bigint) as position from parts")
def merge_mixture(spark, sf_dir):
    return M.merge(*_parts(spark, sf_dir), seed=3, keys=["source_dataset_id", "row_id"])


@query(f"with {_PARTS} select source_dataset_id, count(*) as lane_rows, cast(sum(tokens) as bigint) as lane_tokens, count(*) = count(distinct row_id) as unique_ids from parts group by 1")
def lane_counts(spark, sf_dir):
    union = M.union_all(*_parts(spark, sf_dir))
    return union.groupBy("source_dataset_id").agg(F.count("*").alias("lane_rows"), F.sum("tokens").alias("lane_tokens"), (F.count("*") == F.count_distinct("row_id")).alias("unique_ids"))


@query("select doc_id, lang, cast(null as varchar) as quality, cast(null as varchar) as toxic from documents union all select doc_id, null, cast(quality as varchar), cast(toxic as varchar) from labels")
def union_null_padded(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string"), F.col("toxic").cast("string"))
    return M.union_all(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, pad=True)


@query(
    """with s as (select text, row_number() over (order by md5('42|' || doc_id), doc_id) <= floor(0.9 * count(*) over ()) as train from documents)
select count(*) as validation_rows, count(distinct text) as distinct_targets, count(*) - count(distinct text) as repeated, count(distinct case when text in (select text from s where train) then text end) as leaked from s where not train"""
)
def train_val_leakage(spark, sf_dir):
    docs = M.split(table(spark, sf_dir, "documents").select("doc_id", "text"), 0.9, 42, "doc_id")
    return M.leakage(docs.where("split = 'train'"), docs.where("split = 'validation'"), "text")


_LANES = "lanes as (select lang, count(*) as n_rows, round(avg(n_chars), 6) as mean_tokens, round(sum(least(n_chars, 1000)) / sum(n_chars), 6) as readable from documents group by lang)"


def lanes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n_rows"), F.round(F.avg("n_chars"), 6).alias("mean_tokens"), F.round(F.sum(F.least("n_chars", F.lit(1000))) / F.sum("n_chars"), 6).alias("readable")
    )


@query(f"with {_LANES} select *, round(n_rows / sum(n_rows) over (), 6) as row_share, round(n_rows * mean_tokens / sum(n_rows * mean_tokens) over (), 6) as token_share, round(sum(n_rows * mean_tokens * readable) over () / sum(n_rows * mean_tokens) over (), 6) as readable_overall from lanes")
def share_table(spark, sf_dir):
    return M.share_table(lanes(spark, sf_dir), "n_rows", "mean_tokens", "readable")


@query(
    f"""with {_LANES}, p as (select lang, n_rows, mean_tokens, cast(round_even(400 * (0.25 / mean_tokens) / sum(0.25 / mean_tokens) over (), 0) as bigint) as planned from lanes), q as (select lang, planned, least(planned, n_rows) as rows_, mean_tokens from p)
select lang, planned, rows_ as "rows", rows_ < planned as clamped, round(rows_ * mean_tokens / sum(rows_ * mean_tokens) over (), 6) as realised_share from q"""
)
def token_share_plan(spark, sf_dir):
    wanted = lanes(spark, sf_dir).withColumn("share", F.lit(0.25))
    return M.token_share_plan(wanted, 400, "share", "mean_tokens", "n_rows").select("lang", "planned", "rows", "clamped", "realised_share")


@query(
    """with recursive d as (select doc_id, n_chars as length, ('0x' || substr(md5('0|' || doc_id), 1, 8))::bigint % 16 as shard, row_number() over (partition by ('0x' || substr(md5('0|' || doc_id), 1, 8))::bigint % 16 order by doc_id) as k from documents where n_chars between 1 and 4096),
p as (select shard, k, doc_id, length, 0 as pack, 0 as segment, cast(0 as bigint) as start from d where k = 1
union all select d.shard, d.k, d.doc_id, d.length, case when start + p.length + d.length > 4096 then pack + 1 else pack end, case when start + p.length + d.length > 4096 then 0 else segment + 1 end, case when start + p.length + d.length > 4096 then 0 else start + p.length end from p join d on d.shard = p.shard and d.k = p.k + 1)
select doc_id, length, cast(shard as integer) as shard, pack, segment, start from p"""
)
def greedy_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("length"))
    return M.greedy_pack(docs, "length", 4096, "doc_id", shards=16)


@query(
    """with c as (select doc_id, lang, least(length(text) // 500, 4) as images from documents), s as (select *, count(*) over (partition by lang, images) as size_ from c),
r as (select *, row_number() over (partition by lang, images order by md5('42|' || doc_id), doc_id) as round_ from s), p as (select *, row_number() over (partition by lang order by round_, size_, images) as pick from r)
select lang, doc_id, cast(pick as integer) as pick from p where pick <= 8"""
)
def review_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    images = F.least(F.floor(F.length("text") / 500), F.lit(4))
    return M.review_rows(docs.select("doc_id", "lang", "text"), "lang", images, 8, 42, "doc_id").select("lang", "doc_id", "pick")


@query("select o_orderkey, cast(k as bigint) as ordinal from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as k, count(*) over () as n from orders) where k in (select distinct round_even(i * (n - 1) / 19.0, 0) from range(20) t(i))")
def evenly_spaced(spark, sf_dir):
    return M.evenly_spaced(table(spark, sf_dir, "orders").select("o_orderkey"), 20, "o_orderkey").select("o_orderkey", "ordinal")


@query(
    """with d as (select n_chars, n_chars + doc_id % 3 * 282 + 256 as need from documents), c as (select max_length, count(*) filter (where n_chars <= 0 or need <= max_length) as kept, count(*) as n from d cross join (values (1024), (2048), (8192), (32768), (65536)) v(max_length) group by 1)
select cast(max_length as bigint) as max_length, kept, n - kept as cut, coalesce(max_length = min(case when n = kept then max_length end) over (), false) as chosen from c"""
)
def length_candidates(spark, sf_dir):
    return M.length_candidates(table(spark, sf_dir, "documents"), F.col("n_chars"), F.col("doc_id") % 3, 282, [1024, 2048, 8192, 32768, 65536])


@query("select lang, count(*) filter (where n_chars = length(text)) as equal, count(*) filter (where n_chars < strlen(text)) as less, round(avg(strlen(text) - n_chars), 6) as mean_difference, cast(max(strlen(text) - n_chars) as bigint) as largest from documents group by lang")
def stored_vs_recomputed(spark, sf_dir):
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count_if(F.col("n_chars") == F.length("text")).alias("equal"), F.count_if(F.col("n_chars") < size).alias("less"), F.round(F.avg(size - F.col("n_chars")), 6).alias("mean_difference"), F.max(size - F.col("n_chars")).cast("long").alias("largest")
    )


@query(
    """with p as (select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) as k from conversations)
select conv_id, cast(k - 1 as integer) as part, case when role = 'user' then 'image' else 'text' end as type, case when role = 'user' then 'img' || (count(*) filter (where role = 'user') over (partition by conv_id order by k) - 1) end as image from p"""
)
def placeholder_merge(spark, sf_dir):
    from weft.operators.pairing import merge_placeholders

    parts = F.transform("turns", lambda t: F.struct(F.when(t["role"] == "user", "image").otherwise("text").alias("type"), t["text"].alias("text")))
    n = F.size(F.filter("turns", lambda t: t["role"] == "user"))
    images = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.lit("img"), (k - 1).cast("string")))
    merged = conversations(spark, sf_dir).select("conv_id", F.posexplode(merge_placeholders(parts, images)).alias("part", "p"))
    return merged.select("conv_id", "part", "p.type", "p.image")


@query("select doc_id, doc_id % 100 as k, cast(row_number() over (partition by source order by doc_id) - 1 as bigint) as ordinal from documents")
def grouped_ordinals(spark, sf_dir):
    return with_ordinal(table(spark, sf_dir, "documents"), "doc_id", by=["source"]).select("doc_id", (F.col("doc_id") % 100).alias("k"), "ordinal")
