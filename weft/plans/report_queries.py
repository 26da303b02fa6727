"""Evaluation reports over the score table, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.plans import reports as R
from weft.plans.registry import query
from weft.plans.stat_queries import _SCORES, _WEIGHTS, scores


@query(
    f"""with {_SCORES}, b as (select lane, case when pos < 5 then pos when pos < 10 then 5 else 6 end as bin_no, a_c - b_c as d, a_c - p_c as e, "row", pos from scores),
r as (select lane, bin_no, "row", count(*) as k, sum(d) as s, avg(d) as m, sum(e) as t, avg(e) as u from b group by all),
g as (select lane, bin_no, [0, 1, 2, 3, 4, 5, 10][cast(bin_no as integer) + 1] as lo, cast(sum(k) as bigint) as n_tokens, count(*) as n_rows, round(sum(s) / sum(k) * 100, 6) as gain_pts, round(stddev_samp(m) / sqrt(count(*)) * 100, 6) as se_pts, round(sum(t) / sum(k) * 100, 6) as permuted_pts, round(stddev_samp(u) / sqrt(count(*)) * 100, 6) as permuted_se_pts from r group by all),
z as (select lane, max(gain_pts) filter (where bin_no = 0) as gain0 from g group by 1), c as (select lane, count(distinct "row") as rows_all, count(distinct "row") filter (where pos >= 4) as rows_cut from b group by 1)
select lane, cast(lo as bigint) as lo, n_tokens, n_rows, gain_pts, se_pts, permuted_pts, permuted_se_pts, n_tokens < 30 as underpowered, (select arg_max(x.lo, x.bin_no) from g x where x.lane = g.lane and gain0 > 0 and x.gain_pts >= 0.5 * gain0)::bigint as d50_lo,
case when gain0 is null then 'no_position_0' when gain0 <= 0 then 'no_gain_at_0' else 'ok' end as status, rows_all, rows_cut from g join z using (lane) join c using (lane)"""
)
def decay_report(spark, sf_dir):
    return R.decay_report(scores(spark, sf_dir), ["lane"], limit=4)


@query(
    f"""with {_SCORES}, r as (select lane, "row", least(char_off // 7, 11) as bucket, cast(sum(a_c - b_c) as bigint) as sum_d, count(*) as cnt from scores group by all), {_WEIGHTS},
b as (select lane, 0 as b, bucket, sum(sum_d) as sum_d, sum(cnt) as cnt from r group by all union all select lane, b, bucket, sum(times * sum_d), sum(times * cnt) from w group by all having sum(times * cnt) > 0),
base as (select lane, b, coalesce(sum(cnt) filter (where bucket < 2), 0) as base_n, coalesce(sum(sum_d) filter (where bucket < 2), 0) as base_sum from b group by all),
e as (select b.lane, b.b, bucket, sum_d / cnt < 0.5 * base_sum / base_n as below from b join base using (lane, b) where bucket >= 2 and cnt >= 5), s as (select *, bool_and(below) over (partition by lane, b order by bucket desc rows unbounded preceding) as stays from e),
f as (select lane, b, count(*) as eligible, min(bucket) filter (where stays) as k from s group by all),
j as (select base.*, k, case when base_n < 5 then 'no_baseline_tokens' when base_sum <= 0 then 'no_reading' when coalesce(eligible, 0) = 0 then 'censored_short' when k is null then 'censored_right' when k = 2 then 'ok_at_structural_floor' else 'ok' end as status from base left join f using (lane, b)),
p as (select *, cast(case when status like 'ok%' then k * 7 end as bigint) as k_chars from j), i as (select lane, count(k_chars) as n_resolved, quantile_cont(k_chars, 0.05) as k_low, quantile_cont(k_chars, 0.95) as k_high from p where b > 0 group by lane),
d as (select lane, round(avg(a_ce), 6) as density from scores group by 1), o as (select lane, density, status, k_chars, round(base_sum * 100 / base_n, 6) as baseline_gain_pts from p join d using (lane) where b = 0),
m as (select lane, "row", sum(a_c - b_c) as d from scores group by all), n as (select lane, count(*) filter (where d > 0) as more, count(*) filter (where d < 0) as less, count(*) filter (where d = 0) as tied from m group by lane)
select *, k_chars <= lag(k_chars) over (order by density, lane) as no_later from o join i using (lane) join n using (lane)"""
)
def ladder_report(spark, sf_dir):
    density = scores(spark, sf_dir).groupBy("lane").agg(F.round(F.avg("a_ce"), 6).alias("density"))
    return R.ladder_report(scores(spark, sf_dir), "lane", density, 7, 12, 14, 5).drop("p")


_BARS = {"span": (R.AT_LEAST, 0.5), "visible": (R.AT_LEAST, 0.9), "changed": (R.AT_MOST, 0.52)}
_CHECKS = f"""{_SCORES}, o as (select lane, 'span' as "check", "row", a_c as hit from scores where pos = 0 union all select lane, 'visible', "row", b_c from scores where pos > 0 union all select lane, 'changed', "row", p_c from scores),
r as (select lane, "check", "row", sum(hit) as hits, count(*) as tokens from o group by all), {_WEIGHTS},
e as (select lane, "check", b, sum(times * hits) / sum(times * tokens) as q from w group by all having sum(times * tokens) > 0), i as (select lane, "check", quantile_cont(q, 0.025) as ci_low, quantile_cont(q, 0.975) as ci_high from e group by all),
v("check", direction, bar) as (values ('span', '>=', 0.5::double), ('visible', '>=', 0.9::double), ('changed', '<=', 0.52::double)),
c as (select lane, "check", cast(sum(tokens) as bigint) as n, count(*) as n_rows, round(sum(hits) / sum(tokens), 6) as rate, round(avg(hits / tokens), 6) as rate_rowmean, round(stddev_samp(hits / tokens) / sqrt(count(*)), 6) as se_cluster, ci_low, ci_high, direction, bar,
  case when direction = '>=' then case when ci_low >= bar then 'PASS' when ci_high < bar then 'FAIL' else 'UNDECIDABLE' end else case when ci_high <= bar then 'PASS' when ci_low > bar then 'FAIL' else 'UNDECIDABLE' end end as decision
  from r join i using (lane, "check") join v using ("check") group by lane, "check", ci_low, ci_high, direction, bar)"""


def _checks(spark, sf_dir):
    s = scores(spark, sf_dir)
    # one pass over the scores: each is an observation of up to three checks
    kinds = (("span", "a_c", F.col("pos") == 0), ("visible", "b_c", F.col("pos") > 0), ("changed", "p_c", F.lit(True)))
    seen = F.array_compact(F.array(*(F.when(which, F.struct(F.lit(name).alias("check"), F.col(c).alias("hit"))) for name, c, which in kinds)))
    observations = s.select("lane", "row", F.explode(seen).alias("o")).select("lane", "o.check", "row", "o.hit")
    return R.rated_checks(observations, ["lane"], _BARS)


@query(f'with {_CHECKS} select lane, "check", n, n_rows, rate, rate_rowmean, se_cluster, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, direction, bar, decision from c')
def rated_checks(spark, sf_dir):
    return _checks(spark, sf_dir)


@query(
    f"""with {_CHECKS}, n as (select lane, count(*) filter (where decision = 'PASS') as passed, count(*) filter (where decision = 'FAIL') as failed, count(*) filter (where decision = 'UNDECIDABLE') as undecided, max(n) filter (where "check" = 'span') as spans from c group by lane)
select lane, passed, failed, undecided, case when spans < 400 then 'VOID' when failed > 0 then 'FAIL' when undecided > 0 then 'UNDECIDABLE' else 'PASS' end as verdict from n"""
)
def checks_verdict(spark, sf_dir):
    return R.checks_verdict(_checks(spark, sf_dir), ["lane"], (F.col("check") == "span") & (F.col("n") < 400))
