"""Queries on token scores and series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import decisions as D
from weft.operators import pairing as P
from weft.operators import series as R
from weft.operators import stats as S
from weft.operators.neighbours import nearest_labels
from weft.plans.registry import query, table

_SCORES = """scores as (select l_orderkey as "row", l_returnflag as lane,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 as pos,
  (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1) * 7 as char_off,
  cast(l_discount >= 0.05 as integer) as a_c, cast(l_tax >= 0.04 as integer) as b_c, cast(l_quantity >= 25 as integer) as p_c,
  l_quantity / 10 as a_ce, l_quantity / 10 + l_tax * 20 as b_ce, l_quantity / 10 + l_discount * 10 as p_ce from lineitem)"""


def scores(spark, sf_dir):
    """The score fact table, made from order lines."""
    # named before the window, so that what is grouped by row needs no second exchange
    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "row", "l_returnflag": "lane"})
    order = Window.partitionBy("row").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "lane", "l_linestatus")
    q = F.col("l_quantity") / 10
    return lines.select(
        "row", "lane", (F.row_number().over(order) - 1).alias("pos"), ((F.row_number().over(order) - 1) * 7).alias("char_off"),
        (F.col("l_discount") >= 0.05).cast("int").alias("a_c"), (F.col("l_tax") >= 0.04).cast("int").alias("b_c"), (F.col("l_quantity") >= 25).cast("int").alias("p_c"),
        q.alias("a_ce"), (q + F.col("l_tax") * 20).alias("b_ce"), (q + F.col("l_discount") * 10).alias("p_ce"),
    )


@query(
    """select event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, min(value) as low, max(value) as high, round(median(value), 6) as median, round(stddev_samp(value) / sqrt(count(*)), 6) as se,
round(avg(value) - 1.959963985 * stddev_samp(value) / sqrt(count(*)), 6) as ci_low, round(avg(value) + 1.959963985 * stddev_samp(value) / sqrt(count(*)), 6) as ci_high from events group by 1"""
)
def summary_stats(spark, sf_dir):
    return S.summary(table(spark, sf_dir, "events"), F.col("value"), ["event_type"])


@query(
    """with o as (select event_type, value as v, row_number() over (partition by event_type order by value) - 1 as k, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, round(quantile_cont(v, 0.95), 6) as linear, max(v) filter (where k = floor(0.95 * (n - 1))) as floor_index, max(v) filter (where k = round_even(0.95 * (n - 1), 0)) as rounded_index, max(v) filter (where k = n // 2) as upper_median from o group by 1"""
)
def percentile_modes(spark, sf_dir):
    return S.percentile_modes(table(spark, sf_dir, "events"), "value", 0.95, ["event_type"])


@query(
    f"""with {_SCORES}, r as (select lane, "row", avg(a_c - b_c) as m from scores group by all)
select a.*, b.n_tokens, b.se_naive from (select lane, count(*) as n_rows, round(avg(m), 6) as row_mean, round(stddev_samp(m) / sqrt(count(*)), 6) as se_cluster from r group by lane) a
join (select lane, count(*) as n_tokens, round(stddev_samp(a_c - b_c) / sqrt(count(*)), 6) as se_naive from scores group by lane) b using (lane)"""
)
def cluster_stats(spark, sf_dir):
    return S.cluster_stats(scores(spark, sf_dir), F.col("a_c") - F.col("b_c"), "row", ["lane"])


_BINS = "bins(bin_no, lo, hi, bin) as (values (0, 0, 1, '0-0'), (1, 1, 2, '1-1'), (2, 2, 3, '2-2'), (3, 3, 4, '3-3'), (4, 4, 5, '4-4'), (5, 5, 10, '5-9'), (6, 10, 20, '10-19'), (7, 20, 40, '20-39'), (8, 40, 80, '40-79'), (9, 80, 160, '80-159'), (10, 160, 320, '160-319'), (11, 320, 640, '320-639'), (12, 640, 1000000000, '640+'))"
_BINNED = f"""with {_SCORES}, {_BINS}, t as (select * from scores join bins on pos >= lo and pos < hi),
r as (select bin_no, "row", avg(a_c - b_c) as m from t group by all), rr as (select bin_no, count(*) as n_rows, round(avg(m) * 100, 6) as gain_pts_rowmean, round(stddev_samp(m) / sqrt(count(*)) * 100, 6) as se_cluster_pts from r group by 1),
tt as (select bin_no, count(*) as n_tokens, round(avg(a_c), 6) as acc_aligned, round(avg(b_c), 6) as acc_blank, round(avg(a_c - b_c) * 100, 6) as gain_pts, round(stddev_samp(a_c - b_c) / sqrt(count(*)) * 100, 6) as se_naive_pts, round(avg(a_ce), 6) as ce_aligned, round(avg(b_ce), 6) as ce_blank from t group by 1)
select cast(bin_no as integer) as bin_no, cast(lo as bigint) as lo, bin, coalesce(n_tokens, 0) as n_tokens, coalesce(n_rows, 0) as n_rows, acc_aligned, acc_blank, gain_pts, gain_pts_rowmean, se_naive_pts, se_cluster_pts, ce_aligned, ce_blank, coalesce(n_tokens, 0) < 30 as underpowered
from bins """


@query(_BINNED + "left join tt using (bin_no) left join rr using (bin_no)")
def position_bins(spark, sf_dir):
    return S.position_bins(scores(spark, sf_dir))


@query(_BINNED + "join tt using (bin_no) join rr using (bin_no)")
def position_bins_compact(spark, sf_dir):
    return S.position_bins(scores(spark, sf_dir), keep_empty=False)


@query(f'with {_SCORES} select "row", cast(least(char_off // 14, 4) as integer) as bucket, cast(sum(a_c - b_c) as bigint) as sum_d, count(*) as cnt from scores group by all')
def bucket_table(spark, sf_dir):
    return S.bucket_table(scores(spark, sf_dir), "char_off", 14, 5)


_COLLAPSE = f"""with {_SCORES}, b as (select lane, least(char_off // 7, 11) as bucket, cast(sum(a_c - b_c) as bigint) as sum_d, count(*) as cnt from scores group by all),
base as (select lane, coalesce(sum(cnt) filter (where bucket < 2), 0) as base_n, coalesce(sum(sum_d) filter (where bucket < 2), 0) as base_sum, max(bucket) as last_filled from b group by lane),
e as (select b.lane, bucket, sum_d / cnt < 0.5 * base_sum / base_n as below from b join base using (lane) where bucket >= 2 and cnt >= 5),
s as (select *, bool_and(below) over (partition by lane order by bucket desc rows unbounded preceding) as stays from e),
f as (select lane, count(*) as eligible, min(bucket) filter (where stays) as k, min(bucket) filter (where below) as first_below, max(bucket) as last_eligible from s group by lane),
j as (select *, case when base_n < 5 then 'no_baseline_tokens' when base_sum <= 0 then 'no_reading' when coalesce(eligible, 0) = 0 then 'censored_short' when k is null then 'censored_right' when k = 2 then 'ok_at_structural_floor' else 'ok' end as status from base left join f using (lane))
select lane, status, cast(base_n as bigint) as baseline_n, round(base_sum * 100 / base_n, 6) as baseline_gain_pts, cast(case when status like 'ok%' then k * 7 end as double) as k_chars, cast(case when status like 'ok%' or status = 'censored_right' then first_below * 7 end as double) as k_first_crossing,
cast(case status when 'censored_short' then (last_filled + 1) * 7 when 'censored_right' then (last_eligible + 1) * 7 end as double) as k_lower_bound, coalesce(k = 2, false) as at_floor from j"""


@query(_COLLAPSE)
def collapse_point(spark, sf_dir):
    each = S.bucket_table(scores(spark, sf_dir).withColumn("row", F.col("lane")), "char_off", 7, 12).withColumnRenamed("row", "lane")
    found = S.collapse_point(each, ["lane"], 7, 14, 5)
    return found.withColumns({c: F.col(c).cast("double") for c in ("k_chars", "k_first_crossing", "k_lower_bound")})


@query(
    f"""with {_SCORES}, g as (select lane, least(pos, 12) as bin_no, avg(a_c - b_c) * 100 as gain from scores group by all), z as (select lane, max(gain) filter (where bin_no = 0) as gain0 from g group by lane)
select lane, round(gain0, 6) as gain0, cast((select max(bin_no) from g where g.lane = z.lane and gain0 > 0 and round(gain, 6) >= 0.5 * round(gain0, 6)) as double) as d50_lo, case when gain0 is null then 'no_position_0' when gain0 <= 0 then 'no_gain_at_0' else 'ok' end as status from z"""
)
def deepest_bin(spark, sf_dir):
    gains = scores(spark, sf_dir).groupBy("lane", F.least("pos", F.lit(12)).alias("bin_no")).agg(F.round(F.avg(F.col("a_c") - F.col("b_c")) * 100, 6).alias("gain_pts"))
    return S.deepest_bin(gains.withColumn("lo", F.col("bin_no").cast("double")), ["lane"])


@query(f"""with {_SCORES}, r as (select lane, "row", sum(a_c - b_c) as d from scores group by all) select lane, count(*) filter (where d > 0) as more, count(*) filter (where d < 0) as less, count(*) filter (where d = 0) as tied from r group by lane""")
def sign_counts(spark, sf_dir):
    return S.row_signs(scores(spark, sf_dir), ["lane"]).drop("p")


@query(
    f"""with {_SCORES}, a as (select lane, count(*) as n, avg(b_ce - a_ce) as d, (avg(b_ce) - avg(a_ce)) / avg(a_ce) as rel, stddev_samp(b_ce - a_ce) / sqrt(count(*)) as se from scores group by lane)
select lane, n, round(d, 6) as delta, round(rel, 6) as relative, round(d - 1.959963985 * se, 6) as ci_low, round(d + 1.959963985 * se, 6) as ci_high, case when rel is null then 'n/a' when abs(rel) < 0.05 then '<5%' when abs(rel) < 0.2 then '<20%' else 'grounded' end as flag from a"""
)
def paired_delta(spark, sf_dir):
    return S.paired_delta(scores(spark, sf_dir), ["lane"], "b_ce")


@query(
    f"""with {_SCORES} select lane, count(*) as n, round(avg(p_ce - b_ce), 6) as mean_difference, round(avg(case when b_ce <> 0 then p_ce / b_ce end), 6) as mean_ratio, round(sum(p_ce) / sum(b_ce), 6) as ratio_of_totals,
count(*) filter (where p_ce > b_ce) as more, count(*) filter (where p_ce = b_ce) as equal, count(*) filter (where p_ce < b_ce) as less from scores group by lane"""
)
def ratio_of_totals(spark, sf_dir):
    return S.ratio_of_totals(scores(spark, sf_dir), "p_ce", "b_ce", ["lane"])


@query(f"""with {_SCORES}, g as (select lane, sum(a_ce * p_c) as s, sum(p_c) as w from scores group by lane) select count(*) as groups, round(avg(s / greatest(w, 1)), 6) as macro, round(sum(s) / greatest(sum(w), 1), 6) as weighted from g""")
def macro_vs_weighted(spark, sf_dir):
    return S.macro_and_weighted(scores(spark, sf_dir), ["lane"], "a_ce", F.col("p_c"))


@query(
    """with r as (select l_returnflag, l_extendedprice as x, l_quantity as y, row_number() over (partition by l_returnflag order by l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_discount, l_tax) as rx, row_number() over (partition by l_returnflag order by l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_discount, l_tax) as ry from lineitem)
select l_returnflag, count(*) as n, round(corr(rx, ry), 6) as rho from r group by 1"""
)
def spearman_untied(spark, sf_dir):
    return S.spearman(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"], "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_discount", "l_tax")


#: How often each row counts in replicates 1 to 1000: Poisson numbers of mean 1.
_TIMES = " + ".join(f"(u >= {x})::int" for x in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]).tolist())
_WEIGHTS = f"""keys as (select distinct "row" from r), digests as (select "row", k, sha256('42|' || k || '|' || "row") as h from keys, range(0, 63) a(k)),
times as (select "row", k * 16 + j + 1 as b, ('0x' || substr(h, cast(j * 4 + 1 as integer), 4))::bigint / 65536.0 as u from digests, range(0, 16) c(j)),
w as (select r.*, b, {_TIMES} as times from r join times using ("row") where b <= 1000)"""


@query(
    f"""with {_SCORES}, r as (select lane, "row", sum(a_c) as hits, count(*) as tokens from scores group by all), {_WEIGHTS},
e as (select lane, b, sum(times * hits) / sum(times * tokens) as q from w group by all having sum(times * tokens) > 0), i as (select lane, round(quantile_cont(q, 0.025), 6) as ci_low, round(quantile_cont(q, 0.975), 6) as ci_high from e group by lane)
select lane, round(sum(hits) / sum(tokens), 6) as rate, count(*) as n_rows, round(avg(hits / tokens), 6) as rate_rowmean, round(stddev_samp(hits / tokens) / sqrt(count(*)), 6) as se_cluster, ci_low, ci_high from r join i using (lane) group by lane, ci_low, ci_high"""
)
def bootstrap_rate(spark, sf_dir):
    rows = scores(spark, sf_dir).groupBy("lane", "row").agg(F.sum("a_c").alias("hits"), F.count("*").alias("tokens"))
    return S.bootstrap_rate(rows, "hits", "tokens", ["lane"]).withColumns({c: F.round(c, 6) for c in ("rate", "rate_rowmean", "se_cluster", "ci_low", "ci_high")})


@query(
    f"""with {_SCORES}, r as (select lane, "row", least(char_off // 7, 11) as bucket, sum(a_c - b_c) as sum_d, count(*) as cnt from scores group by all), {_WEIGHTS},
b as (select lane, b, bucket, sum(times * sum_d) as sum_d, sum(times * cnt) as cnt from w group by all having sum(times * cnt) > 0),
base as (select lane, b, coalesce(sum(cnt) filter (where bucket < 2), 0) as base_n, coalesce(sum(sum_d) filter (where bucket < 2), 0) as base_sum from b group by all),
e as (select b.lane, b.b, bucket, sum_d / cnt < 0.5 * base_sum / base_n as below from b join base using (lane, b) where bucket >= 2 and cnt >= 5),
s as (select *, bool_and(below) over (partition by lane, b order by bucket desc rows unbounded preceding) as stays from e),
f as (select lane, b, count(*) as eligible, min(bucket) filter (where stays) as k from s group by all),
j as (select base.*, k, case when base_n < 5 then 'no_baseline_tokens' when base_sum <= 0 then 'no_reading' when coalesce(eligible, 0) = 0 then 'censored_short' when k is null then 'censored_right' when k = 2 then 'floor' else 'ok' end as status from base left join f using (lane, b)),
p as (select *, case when status in ('ok', 'floor') then k * 7 end as k_chars from j)
select lane, count(*) as n_boot, count(k_chars) as n_resolved, count(*) filter (where k = 2) as n_at_floor, count(*) filter (where status = 'ok') as n_ok, count(*) filter (where status = 'censored_right') as n_censored_right, count(*) filter (where status = 'censored_short') as n_censored_short,
count(*) filter (where status = 'no_reading') as n_no_reading, count(*) filter (where status = 'no_baseline_tokens') as n_no_baseline_tokens, quantile_cont(k_chars, 0.05) as ci_low, quantile_cont(k_chars, 0.5) as median, quantile_cont(k_chars, 0.95) as ci_high from p group by lane"""
)
def bootstrap_collapse(spark, sf_dir):
    each = scores(spark, sf_dir).groupBy("lane", "row", F.least(F.floor(F.col("char_off") / 7), F.lit(11)).cast("int").alias("bucket")).agg(F.sum(F.col("a_c") - F.col("b_c")).alias("sum_d"), F.count("*").alias("cnt"))
    return S.bootstrap_collapse(each, ["lane"], 7, 14, 5)


@query(
    f"""with {_SCORES}, w as (select *, case when p_c = 1 then 1 + 0.5 * greatest(b_ce - a_ce, 0.0) else 0.0 end as u from scores)
select "row", cast(pos as integer) as pos, round(coalesce(u / nullif(sum(u) over (partition by "row") / nullif(sum(p_c) over (partition by "row"), 0), 0), 0.0), 6) as weight from w"""
)
def gap_weights(spark, sf_dir):
    return S.gap_weights(scores(spark, sf_dir), ["row"], 0.5, F.col("p_c") == 1).select("row", "pos", "weight")


@query(
    f"""with {_SCORES}, a as (select lane, avg(a_c) as m, stddev_samp(a_c) / sqrt(count(*)) as se from scores group by lane)
select lane, case when m - 1.959963985 * se >= 0.5 then 'PASS' when m + 1.959963985 * se < 0.5 then 'FAIL' else 'UNDECIDABLE' end as decision, round(2.801585 * se, 6) as detectable from a"""
)
def ci_decision(spark, sf_dir):
    a = scores(spark, sf_dir).groupBy("lane").agg(F.avg("a_c").alias("m"), (F.stddev_samp("a_c") / F.sqrt(F.count("*"))).alias("se"))
    return a.select("lane", S.ci_decision(F.col("m") - S.Z95 * F.col("se"), F.col("m") + S.Z95 * F.col("se"), 0.5).alias("decision"), F.round(S.Z_DETECT * F.col("se"), 6).alias("detectable"))


@query(
    """with o as (select o.o_orderkey, count(l.l_orderkey) as k from orders o left join lineitem l on l_orderkey = o_orderkey group by 1)
select o_orderkey, k, cast(case when count(*) over (partition by k) > 1 then coalesce(lead(o_orderkey) over (partition by k order by o_orderkey), first_value(o_orderkey) over (partition by k order by o_orderkey)) end as double) as donor from o"""
)
def donor_permutation(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey")
    counted = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("k"))
    return P.group_donor(counted, "k", "o_orderkey").withColumn("donor", F.col("donor").cast("double"))


@query("select c_custkey, coalesce(lead(c_custkey) over (order by c_custkey), first_value(c_custkey) over (order by c_custkey)) as donor from customer")
def cyclic_donor(spark, sf_dir):
    return P.cyclic_donor(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", "donor")


_NEXT = "with a as (select row_number() over (order by text, doc_id) - 1 as k, text from documents) select count(*) as pairs, count(*) filter (where starts_with(a.text, b.text) or starts_with(b.text, a.text)) as same from a join a b on b.k = a.k + 1"


def _next_in_text_order(spark, sf_dir):
    """Every document, whole, with the next in the order of texts, so that copies and prefixes meet."""
    from weft.functions.determinism import with_ordinal

    a = with_ordinal(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")
    return P.verified_pairs(a, a.withColumn("ordinal", F.col("ordinal") - 1), "ordinal", "text", prefix=True).agg(F.count("*").alias("pairs"), F.count_if("same").alias("same"))


@query(_NEXT)
def verified_pairs(spark, sf_dir):
    return _next_in_text_order(spark, sf_dir)


@query(_NEXT)
def verified_pairs_whole(spark, sf_dir):
    return _next_in_text_order(spark, sf_dir)


_SPANS = """w as (select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as word_idx from documents),
spans as (select doc_id, word_idx, word, coalesce(sum(length(word) + 1) over (partition by doc_id order by word_idx rows between unbounded preceding and 1 preceding), 0) as lo from w)"""


@query(f"with {_SPANS} select doc_id, count(*) as n_words, cast(max(lo + length(word)) as bigint) as last_end, cast(sum(lo) as bigint) as sum_lo from spans where word <> '' group by doc_id")
def running_offsets(spark, sf_dir):
    spans = P.word_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    return spans.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.max("hi").alias("last_end"), F.sum("lo").alias("sum_lo"))


@query(f"with {_SPANS} select doc_id, cast(word_idx as integer) as word_idx, word from spans where word <> '' and lo < 60 and lo + length(word) > 40")
def interval_overlap(spark, sf_dir):
    return P.overlapping(P.word_spans(table(spark, sf_dir, "documents"), "doc_id", "text"), 40, 60).select("doc_id", "word_idx", "word")


_BOXES = "boxes as (select p_partkey, p_size % 17 * 10 as x0, p_size % 7 * 10 as y0, p_size % 17 * 10 + p_size as x1, p_size % 7 * 10 + p_size // 2 as y1 from part)"


def boxes(spark, sf_dir):
    p = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", (p % 17 * 10).alias("x0"), (p % 7 * 10).alias("y0"), (p % 17 * 10 + p).alias("x1"), (p % 7 * 10 + F.floor(p / 2)).alias("y1"))


@query(f"with {_BOXES}, c as (select p_partkey, unnest(range(x0 // 48, (greatest(x1, x0 + 1) - 1) // 48 + 1)) as cx, y0, y1 from boxes) select p_partkey, cx, unnest(range(y0 // 48, (greatest(y1, y0 + 1) - 1) // 48 + 1)) as cy from c")
def grid_cells(spark, sf_dir):
    return P.grid_cells(boxes(spark, sf_dir), 48).select("p_partkey", "cx", "cy")


@query(f"with {_BOXES} select p_partkey % 10 as run, cast(min(x0) - 2 as bigint) as x0, cast(min(y0) - 2 as bigint) as y0, cast(max(x1) + 2 as bigint) as x1, cast(max(y1) + 2 as bigint) as y1 from boxes group by 1")
def mask_rects(spark, sf_dir):
    return P.mask_rects(boxes(spark, sf_dir).withColumn("run", F.col("p_partkey") % 10), ["run"], 2)


@query(
    """with d as (select a.vec_id, a.label, arg_min(b.label, (list_distance(a.embedding, b.embedding), b.vec_id)) as nearest from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0 group by all)
select count(*) as n, count(*) filter (where label = nearest) as hits from d"""
)
def one_nn_probe(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = nearest_labels(vectors, "vec_id", "embedding", "label", probes=vectors.where("vec_id % 50 = 0"))
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("nearest")).alias("hits"))


@query(
    """with d as (select a.vec_id, a.label, arg_min(b.label, (list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id)) as nearest from embeddings a join embeddings b on a.vec_id <> b.vec_id group by all)
select label, count(*) as n, count(*) filter (where label = nearest) as hits from d group by label"""
)
def one_nn_loo(spark, sf_dir):
    found = nearest_labels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("nearest")).alias("hits"))


@query(
    """with e as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as k from embeddings), m as (select label, k, avg(v) as mean, var_pop(v) as within from e group by all)
select a.label as a, b.label as b, round(sqrt(avg((a.mean - b.mean) ** 2)), 5) as between_rms, round(sqrt(avg((a.within + b.within) / 2)), 5) as within_rms from m a join m b on a.k = b.k and a.label < b.label group by all"""
)
def class_separation(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    means = each.groupBy("label", "k").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("within"))
    a, b = means.alias("a"), means.alias("b")
    joined = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.label") < F.col("b.label")))
    return joined.groupBy(F.col("a.label").alias("a"), F.col("b.label").alias("b")).agg(
        F.round(F.sqrt(F.avg(F.pow(F.col("a.mean") - F.col("b.mean"), 2))), 5).alias("between_rms"), F.round(F.sqrt(F.avg((F.col("a.within") + F.col("b.within")) / 2)), 5).alias("within_rms")
    )


_SERIES = "s as (select event_type as lane, event_id as idx, value from events)"


def series(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("lane"), F.col("event_id").alias("idx"), "value")


@query(f"with {_SERIES}, f as (select lane, idx, value, first_value(value) over (partition by lane order by idx) as base from s) select lane, idx, round(case when base <> 0 then value / base - 1 end, 6) as inflation from f")
def baseline_inflation(spark, sf_dir):
    return R.inflation(series(spark, sf_dir), "lane", "idx", "value")


@query(f"with {_SERIES}, l as (select lane, value, row_number() over (partition by lane order by idx desc) as r from s) select lane, count(*) filter (where r <= 3) = 3 and max(value) filter (where r <= 3) < 60 as alarm, round(max(value), 6) as largest, round(max(value) filter (where r = 1), 6) as last, count(*) as n from l group by lane")
def consecutive_alarm(spark, sf_dir):
    return R.alarm(series(spark, sf_dir), "lane", "idx", "value", 60.0, 3)


@query(
    f"""with {_SERIES}, m as (select lane, idx // 100 as step, avg(value) as v from s group by all), d as (select *, v - lead(v) over (partition by lane order by step) as drop_ from m)
select lane, round(max(drop_), 6) as largest_drop, cast(arg_max(step, drop_) as bigint) as at_step, round(max(drop_) / (max(v) - min(v)), 6) as share, case when max(drop_) / (max(v) - min(v)) >= 0.6 then 'cliff' when max(drop_) / (max(v) - min(v)) >= 0.3 then 'gradual' else 'flat' end as shape, bool_and(coalesce(drop_ >= 0, true)) as monotone from d group by lane"""
)
def adjacent_drop(spark, sf_dir):
    means = series(spark, sf_dir).groupBy("lane", F.floor(F.col("idx") / 100).alias("step")).agg(F.avg("value").alias("v"))
    return R.adjacent_drop(means, "lane", "step", "v")


@query(f"with {_SERIES}, l as (select lane, idx, value, lag(idx) over (partition by lane order by idx) as before, lag(value) over (partition by lane order by idx) as last_ from s) select lane, count(*) filter (where idx <= before) as not_rising, count(*) filter (where value is null or isnan(value) or isinf(value)) as not_finite, round(count(*) filter (where round(value) = round(last_)) / (count(*) - 1), 6) as repetition from l group by lane")
def counter_checks(spark, sf_dir):
    return R.counter_checks(series(spark, sf_dir), "lane", "idx", "value")


@query(
    """with l as (select event_id, '{''eval_' || event_type || '_loss'': ''' || cast(event_id % 97 as varchar) || '.5'', ''eval_loss'': ''' || cast(event_id % 7 as varchar) || '.25''}' as line from events)
select 'eval/' || event_type || '_loss' as metric, count(*) as n, round(sum(event_id % 97 + 0.5), 6) as total from events group by 1 union all select 'eval/loss', count(*), round(sum(event_id % 7 + 0.25), 6) from events"""
)
def metric_log_parse(spark, sf_dir):
    from weft.sources.text import parse_metrics

    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("{'eval_"), "event_type", F.lit("_loss': '"), (F.col("event_id") % 97).cast("string"), F.lit(".5', 'eval_loss': '"), (F.col("event_id") % 7).cast("string"), F.lit(".25'}"))
    found = parse_metrics(e.select(F.col("event_id").alias("line_no"), line.alias("value")))
    return found.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("number"), 6).alias("total"))


@query("""select cast(json_extract_string(props, '$.k') as bigint) as k, '{"k": ' || json_extract_string(props, '$.k') || ', "width": 2000}' as config, count(*) as n from events group by all""")
def config_variants(spark, sf_dir):
    from weft.sources.text import rewrite_config

    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), rewrite_config("props", {"width": 2000}).alias("config"))
    return e.groupBy("k", "config").agg(F.count("*").alias("n"))


@query("select h, w, cast(greatest(1, floor(h * sqrt(budget * 2304.0 / (h * w)) / 48)) as bigint) as grid_h, cast(greatest(1, floor(w * sqrt(budget * 2304.0 / (h * w)) / 48)) as bigint) as grid_w, budget from (select distinct p_size * 40 as h, p_size * 25 + 100 as w from part) cross join (values (280), (560), (1120)) v(budget)")
def soft_token_grid(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select((F.col("p_size") * 40).alias("h"), (F.col("p_size") * 25 + 100).alias("w")).distinct()
    crossed = sizes.withColumn("budget", F.explode(F.array(F.lit(280), F.lit(560), F.lit(1120))))
    grid_h, grid_w = D.soft_token_grid(F.col("h"), F.col("w"), F.col("budget"))
    return crossed.select("h", "w", grid_h.alias("grid_h"), grid_w.alias("grid_w"), "budget")


@query("select font, (1024 - 40) // (font * 6 // 10) as chars_per_line, (1024 - 40) // (font * 14 // 10) as lines_per_page, (1024 - 40) // (font * 6 // 10) * ((1024 - 40) // (font * 14 // 10)) as capacity from (values (14), (18), (24), (32)) v(font)")
def page_capacity(spark, sf_dir):
    fonts = spark.createDataFrame([(14,), (18,), (24,), (32,)], "font int")
    per_line, lines = D.page_capacity(F.lit(1024), F.lit(1024), F.floor(F.col("font") * 6 / 10), F.floor(F.col("font") * 14 / 10))
    return fonts.select("font", per_line.cast("int").alias("chars_per_line"), lines.cast("int").alias("lines_per_page"), (per_line * lines).cast("int").alias("capacity"))


@query("select lang, round(sum(length(text)) * ln(26) / sum(length(text) // 3 + 1), 6) as floor_all, round(sum(length(text)) * ln(26) / sum(length(text) // 3 + 3), 6) as floor_supervised, round(avg(pow(26, -least(length(text), 12))), 12) as guess from documents group by lang")
def floors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("letters"), (F.floor(F.length("text") / 3) + 1).alias("tokens"))
    return D.floors(docs, ["lang"], "letters", "tokens", 26)


@query(
    f"""with {_SCORES}, m as (select lane, avg(a_c) as acc, max(b_ce - a_ce) as worst from scores group by lane)
select lane, case when worst > 1.59 then 'VOID' when acc >= 0.55 then 'READS' when acc >= 0.45 then 'PARTIAL' else 'BLIND' end as verdict from m"""
)
def verdict(spark, sf_dir):
    m = scores(spark, sf_dir).groupBy("lane").agg(F.avg("a_c").alias("acc"), F.max(F.col("b_ce") - F.col("a_ce")).alias("worst"))
    return m.select("lane", D.first_match([(F.col("worst") > 1.59, "VOID"), (F.col("acc") >= 0.55, "READS"), (F.col("acc") >= 0.45, "PARTIAL")], "BLIND").alias("verdict"))
