"""Queries on text metrics, layout, masks, poison, media and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as X
from weft.functions.determinism import with_ordinal
from weft.operators import layout as L
from weft.plans.registry import query, table

_NAMES = "n as (select n_name as a, lead(n_name, 1, 'CHINA') over (order by n_nationkey) as b from nation)"


@query(f"with {_NAMES} select a, b, round(levenshtein(a, b) / length(a), 6) as cer, case when a = b then 1.0 else 0.0 end as exact from n")
def char_cer(spark, sf_dir):
    from pyspark.sql import Window

    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("a"), F.lead("n_name", 1, "CHINA").over(Window.orderBy("n_nationkey")).alias("b"))
    return names.select("a", "b", F.round(X.cer(F.col("a"), F.col("b")), 6).alias("cer"), X.exact_match(F.col("a"), F.col("b")).alias("exact"))


def benchmark_pairs(spark, sf_dir):
    """Benchmark texts beside the text of the next item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hypothesis"))
    return items.join(after, "item_id").withColumnRenamed("text", "reference")


def _dp(best: str, step: str) -> str:
    """The last number of the last row of a table over word codes a (lists of one) and b: `best` from
    the row before (prev) and whether the words are the same, then `step` along the row."""
    row = f"list_reduce(list_prepend([prev[1] + {{first}}], list_transform(range(1, len(b) + 1), lambda j: [{best}])), lambda acc, y: list_append(acc, {step}))"
    return "list_reduce(list_prepend({start}, a), lambda prev, x: " + row + ")[-1]"


_EDITS = _dp("least(prev[j + 1] + 1, prev[j] + (b[j] <> x[1])::int)", "least(y[1], acc[-1] + 1)").format(start="range(0, len(b) + 1)", first=1)
_COMMON = _dp("case when b[j] = x[1] then prev[j] + 1 else prev[j + 1] end", "greatest(y[1], acc[-1])").format(start="list_transform(range(0, len(b) + 1), lambda z: 0::bigint)", first=0)
_CODES = """list_transform(u, lambda w: [list_position(u || v, w)::bigint]) as a, list_transform(v, lambda w: list_position(u || v, w)::bigint) as b"""
_SPLIT = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


@query(
    f"""with p as (select a.item_id, a.text as r, b.text as h from benchmark a join benchmark b on b.item_id = a.item_id + 1),
m as (select 'plain' as mode, r, h from p union all select 'lower', lower(r), lower(h) from p union all select 'letters', regexp_replace(lower(r), '[^a-z0-9 ]+', ' ', 'g'), regexp_replace(lower(h), '[^a-z0-9 ]+', ' ', 'g') from p),
w as (select mode, {_SPLIT("r")} as u, {_SPLIT("h")} as v from m), c as (select mode, {_CODES} from w), e as (select mode, {_EDITS} as edits, len(a) as words from c)
select mode, round(sum(edits) / sum(words), 6) as micro, round(avg(edits / words), 6) as macro from e group by mode"""
)
def word_wer(spark, sf_dir):
    pairs = benchmark_pairs(spark, sf_dir)
    rows = []
    for mode in X.WER_MODES:
        a, b = X.wer_words(F.col("reference"), mode), X.wer_words(F.col("hypothesis"), mode)
        rows.append(pairs.select(F.lit(mode).alias("mode"), X.word_edits(a, b).alias("edits"), F.size(a).alias("words"), X.wer(F.col("reference"), F.col("hypothesis"), mode).alias("wer")))
    union = rows[0].union(rows[1]).union(rows[2])
    return union.groupBy("mode").agg(F.round(F.sum("edits") / F.sum("words"), 6).alias("micro"), F.round(F.avg("wer"), 6).alias("macro"))


@query(
    f"""with p as (select a.item_id, a.text as r, b.text as h from benchmark a join benchmark b on b.item_id = a.item_id + 1), w as (select item_id, {_SPLIT("r")} as u, {_SPLIT("h")} as v from p), c as (select item_id, {_CODES} from w)
select item_id, round(2.0 * {_COMMON} / (len(a) + len(b)), 6) as rouge_l from c"""
)
def rouge_l(spark, sf_dir):
    return benchmark_pairs(spark, sf_dir).select("item_id", F.round(X.rouge_l(F.col("reference"), F.col("hypothesis")), 6).alias("rouge_l"))


@query(
    """with p as (select a.item_id, a.text as r, b.text as h from benchmark a join benchmark b on b.item_id = a.item_id + 1),
w as (select item_id, list_filter(regexp_split_to_array(r, '\\s+'), lambda x: x <> '') as a, list_filter(regexp_split_to_array(h, '\\s+'), lambda x: x <> '') as b, list_distinct(regexp_extract_all(lower(r), '[a-z0-9'']+')) as ta, list_distinct(regexp_extract_all(lower(h), '[a-z0-9'']+')) as tb from p)
select item_id, round(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) / len(a), 6) as multiset_recall,
round(len(list_intersect(ta, tb)) / len(ta), 6) as type_recall, round(len(list_intersect(ta, tb)) / len(tb), 6) as type_precision from w"""
)
def overlap_recall(spark, sf_dir):
    recall, precision = X.type_overlap(F.col("reference"), F.col("hypothesis"))
    return benchmark_pairs(spark, sf_dir).select("item_id", F.round(X.multiset_recall(F.col("reference"), F.col("hypothesis")), 6).alias("multiset_recall"), F.round(recall, 6).alias("type_recall"), F.round(precision, 6).alias("type_precision"))


@query("select conv_id, turn, nullif(regexp_extract(text, '^\\s*([ABCD])', 1), '') as letter from conversations")
def strict_letter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.strict_letter(F.col("text")).alias("letter"))


@query(
    """with m as (select l_returnflag, avg(l_quantity) as image, avg(l_extendedprice / 1000) as native from lineitem group by 1)
select l_returnflag, round(case when native <> 0 then image / native * 100 end, 6) as higher, round(case when image <> 0 then native / image * 100 end, 6) as lower from m"""
)
def retention_score(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("image"), F.avg(F.col("l_extendedprice") / 1000).alias("native"))
    return m.select("l_returnflag", F.round(X.retention(F.col("image"), F.col("native")), 6).alias("higher"), F.round(X.retention(F.col("image"), F.col("native"), False), 6).alias("lower"))


@query(
    """with c as (select p_partkey, p_name as q, p_size % 5 as idx, substr(p_type, 1, 6) as label, p_brand from part)
select p_partkey, 'Question: ' || q || chr(10) || chr(10) || 'A) ' || p_brand || chr(10) || 'B) ' || label as question, case when idx between 0 and 3 then substr('ABCD', cast(idx as integer) + 1, 1) when substr(upper(trim(label)), 1, 1) in ('A', 'B', 'C', 'D') then substr(upper(trim(label)), 1, 1) else label end as answer,
case when p_brand like '%#1%' then 'audio-visual' when p_brand like '%#2%' then 'audio' else 'visual' end as modality from c"""
)
def choice_questions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    label = F.substring("p_type", 1, 6)
    stated = F.when(F.col("p_brand").contains("#1"), "AV").when(F.col("p_brand").contains("#2"), " Audio ").otherwise("")
    return p.select(
        "p_partkey", X.question_text(F.col("p_name"), F.array("p_brand", label)).alias("question"), X.answer_letter((F.col("p_size") % 5).cast("int"), label).alias("answer"), X.modality(stated, F.lit(False), F.lit(True)).alias("modality")
    )


_POISON = """with k as (select doc_id, unnest(string_split(text, '')) as c, unnest(range(1, length(text) + 1)) as k from documents where length(text) > 0),
h as (select doc_id, k, c, ('0x' || substr(md5('{seed}|' || doc_id || '|' || k), 1, 8))::bigint / 4294967296.0 as u, ('0x' || substr(md5('{seed}|' || doc_id || '|letter|' || k), 1, 8))::bigint / 4294967296.0 as v from k),
p as (select *, regexp_matches(c, '^\\p{{L}}$') and u < {rate} as hit from h), g as (select doc_id, string_agg(case when hit then chr(cast(97 + floor(v * 26) as integer)) else c end, '' order by k) as poisoned, count(*) filter (where hit) as n_hit from p group by doc_id)
select doc_id, coalesce(poisoned, '') as poisoned, coalesce(n_hit, 0) as n_hit from documents left join g using (doc_id)"""


def _poisoned(spark, sf_dir, rate, seed):
    """Every document, and all of its letters."""
    docs = table(spark, sf_dir, "documents")
    out, places = X.poisoned(F.col("text"), rate, F.lit(seed), F.col("doc_id"))
    return docs.select("doc_id", out.alias("poisoned"), F.size(places).cast("long").alias("n_hit"))


@query(_POISON.format(rate=0.1, seed=4))
def poison_text(spark, sf_dir):
    return _poisoned(spark, sf_dir, 0.1, 4)


@query(_POISON.format(rate=0.3, seed=9))
def poison_text_whole(spark, sf_dir):
    return _poisoned(spark, sf_dir, 0.3, 9)


def _masked(spark, sf_dir):
    return L.masked(table(spark, sf_dir, "documents"), "doc_id", "text", 5)


@query(None)
def mask_target(spark, sf_dir):
    return L.sentinel_problems(_masked(spark, sf_dir), L.MaskSpec().sentinel).select("doc_id", "target", F.size("run_start").alias("runs"), F.array_join("problems", ";").alias("problems"))


@query(None)
def mask_statistics(spark, sf_dir):
    return L.mask_statistics(_masked(spark, sf_dir))


@query(None)
def mask_run_lengths(spark, sf_dir):
    return L.run_lengths(_masked(spark, sf_dir), 4)


@query(None)
def wrap_pages(spark, sf_dir):
    lines = L.wrapped(table(spark, sf_dir, "documents"), "doc_id", "text", L.Page())
    return lines.groupBy("doc_id").agg((F.max("page") + 1).alias("pages"), F.count("*").alias("lines"), F.max(F.length("text")).alias("longest"))


@query(None)
def word_boxes(spark, sf_dir):
    return L.text_boxes(table(spark, sf_dir, "documents"), "doc_id", "text", L.Page())


@query(
    """with p as (select p_partkey, row_number() over (order by p_partkey) - 1 as k, p_name from part), b as (select k // 5 as block, string_agg(p_name, ' ' order by k) as whole from p group by 1), f as (select k // 5 as block, p_name from p where k % 5 = 0)
select block, starts_with(whole, p_name) as shared from b join f using (block)"""
)
def joined_stream_detection(spark, sf_dir):
    p = with_ordinal(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").withColumn("block", F.floor(F.col("ordinal") / 5))
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "p_name")))
    return p.groupBy("block").agg(parts.alias("p")).select("block", F.array_join(F.col("p.p_name"), " ").startswith(F.col("p")[0]["p_name"]).alias("shared"))


@query("select chars, depth, round(avg(length(substr(text, 1, chars))), 6) as mean_chars, round(avg(least(length(substr(text, 1, chars)), depth)), 6) as readable from documents cross join (values (200), (800), (3200)) a(chars) cross join (values (100), (400)) b(depth) group by all")
def spec_ladder(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text").withColumn("chars", F.explode(F.array(F.lit(200), F.lit(800), F.lit(3200)))).withColumn("depth", F.explode(F.array(F.lit(100), F.lit(400))))
    n = F.least(F.length("text"), F.col("chars"))
    return docs.groupBy("chars", "depth").agg(F.round(F.avg(n), 6).alias("mean_chars"), F.round(F.avg(F.least(n, F.col("depth"))), 6).alias("readable"))


@query("select event_type as lane, round(arg_max(value, event_id), 6) as last, max(event_id) as at from events group by 1")
def endpoint_metrics(spark, sf_dir):
    from weft.operators.series import endpoint_metrics as ends

    found = ends(table(spark, sf_dir, "events").select(F.col("event_type").alias("lane"), F.col("event_id").alias("idx"), "value"), "lane", "idx", "value")
    return found.withColumn("last", F.round("last", 6))


@query(None)
def image_compare(spark, sf_dir):
    import numpy as np
    import pandas as pd

    from weft.functions import media

    def run(batches):
        for pdf in batches:
            rows = []
            for key, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                x = np.asarray(v, float)
                image = np.rint(255 * (x - x.min()) / max(float(np.ptp(x)), 1e-9)).astype(np.uint8).reshape(8, 8)
                back = media.read_png(media.png(image))
                found = media.compare(image, media.blank(image))
                rows.append((key, bool((back == image).all()), found["equal_share"], found["mean_diff"], found["ink_iou"], media.ink_share(image)))
            yield pd.DataFrame(rows, columns=["vec_id", "round_trip", "equal_share", "mean_diff", "ink_iou", "ink"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, round_trip boolean, equal_share double, mean_diff double, ink_iou double, ink double")


@query(None)
def log_mel_pages(spark, sf_dir):
    import numpy as np
    import pandas as pd

    from weft.functions import media

    def run(batches):
        for pdf in batches:
            rows = []
            for key, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                signal = np.tile(np.asarray(v, np.float32), 400)
                pages = media.log_mel_pages(signal, 1.0, 4)
                rows += [(key, k, p.shape[0], p.shape[1], media.ink_share(p), media.png(p)) for k, p in enumerate(pages)]
            yield pd.DataFrame(rows, columns=["vec_id", "page", "height", "width", "ink", "png"])

    some = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return some.mapInPandas(run, "vec_id long, page int, height int, width int, ink double, png binary").select("vec_id", "page", "height", "width", F.round("ink", 6).alias("ink"), F.md5("png").alias("png_md5"))


@query(
    """with m as (select event_id // 20 as step, event_type as metric, value, event_id as seq from events)
select step, round(arg_min(value, seq) filter (where metric = 'click'), 6) as click, round(arg_min(value, seq) filter (where metric = 'view'), 6) as view from m where value is not null group by step
having count(*) filter (where metric = 'click') > 0 and count(*) filter (where metric = 'view') > 0"""
)
def metric_watch(spark, sf_dir):
    from weft.streaming.watch import complete_steps

    m = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("step"), F.col("event_type").alias("metric"), "value", F.col("event_id").alias("seq"))
    return complete_steps(m, ["click", "view"]).select("step", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


@query("select cast(date_trunc('day', ts) as varchar) as day, event_type, count(*) as n, round(avg(value), 6) as mean from events group by all")
def windowed_means(spark, sf_dir):
    from weft.streaming.watch import windowed_means as windows

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows(events).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))
