"""Queries on spans, packs and orders of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.tokenizers import FileTokenizer, token_count_and_prefix
from weft.operators import fit as T
from weft.operators import intervals as I
from weft.operators import packing as K
from weft.operators import pairing as P
from weft.operators import quantiles as Q
from weft.operators import sequences as Z
from weft.operators.layout import Page
from weft.plans.registry import query, table

_PIECES = """pieces as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) - 1 as token_idx from (select doc_id, regexp_extract_all(text, '[ \\n]*[^ \\n]+|[ \\n]+') as p from documents)),
tokens as (select doc_id, token_idx, coalesce(sum(length(piece)) over (partition by doc_id order by token_idx rows between unbounded preceding and 1 preceding), 0) as lo, length(piece) as len from pieces),
rows_ as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
lines as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as lo from rows_),
marks as (select doc_id, line_no, lo, lo + length(line) as hi from lines where contains(line, '@'))"""


def marked_lines(docs: DataFrame, sign: str) -> DataFrame:
    """doc_id, line_no, lo, hi of the lines with the sign."""
    lines = P.pieces_with_places(docs, "doc_id", F.split("text", "\n"), "line_no", "line", gap=1)
    return lines.where(F.contains("line", F.lit(sign))).select("doc_id", "line_no", "lo", "hi")


@query(
    f"""with {_PIECES}, met as (select t.doc_id, line_no, token_idx from tokens t join marks m on t.doc_id = m.doc_id and t.lo < m.hi and t.lo + t.len > m.lo), n as (select doc_id, max(token_idx) + 1 as n from tokens group by 1)
select doc_id, cast(line_no as integer) as line_no, min(token_idx) as first_token, max(token_idx) as last_token, count(*) as n_tokens, case when n - max(token_idx) - 1 > 0 then max(token_idx) + 1 end as after_first, greatest(0, least(5, n - max(token_idx) - 1)) as after_n
from met join n using (doc_id) group by doc_id, line_no, n"""
)
def interval_tokens(spark, sf_dir):
    """Tokens of every marked line of every document, and the five behind them."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@")))  # others have no marked line
    return I.marked_tokens(P.token_spans(docs, "doc_id", "text"), marked_lines(docs, "@"), ["doc_id"], "line_no", 5)


@query(f"with {_PIECES} select d.doc_id, coalesce(bool_and(t.lo + t.len <= length(text)), true) and coalesce(sum(t.len), 0) = coalesce(length(any_value(text)), 0) as tiled from documents d left join tokens t using (doc_id) group by d.doc_id")
def token_tiling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return I.tiles_text(P.token_spans(docs, "doc_id", "text"), docs, ["doc_id"], "text")


@query(
    """with s as (select l_suppkey, l_orderkey, l_linenumber, epoch(l_shipdate::timestamp)::bigint // 86400 as lo, epoch(l_shipdate::timestamp)::bigint // 86400 + 1 + l_quantity::bigint % 30 as hi from lineitem),
o as (select c_nationkey % 10 as k, o_orderkey, epoch(o_orderdate::timestamp)::bigint // 86400 as lo, epoch(o_orderdate::timestamp)::bigint // 86400 + 3 as hi from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT' and o_totalprice > 350000)
select o_orderkey, count(*) as in_transit, cast(sum(least(s.hi, o.hi) - greatest(s.lo, o.lo)) as bigint) as days from o join s on s.lo < o.hi and o.lo < s.hi and s.l_suppkey % 10 = o.k group by 1"""
)
def shipments_around(spark, sf_dir):
    """Shipments on their way (a day, and more with the quantity) in the three days from each large urgent order."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    shipped = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("k"), day("l_shipdate").alias("lo"), (day("l_shipdate") + 1 + F.col("l_quantity").cast("long") % 30).alias("hi"))
    asked = table(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 350000))
    asked = asked.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select((F.col("c_nationkey") % 10).alias("k"), "o_orderkey", day("o_orderdate").alias("lo"), (day("o_orderdate") + 3).alias("hi"))
    # spans that are the same are one span with a number: pairs grow with the days there are, not with orders times shipments
    span = ["k", "lo", "hi"]
    met = I.interval_join(asked.select(*span).distinct(), shipped.groupBy(*span).agg(F.count("*").alias("n")), ["k"])
    days = F.least("hi", "hi_b") - F.greatest("lo", "lo_b")
    of_span = met.groupBy(*span).agg(F.sum("n").alias("in_transit"), F.sum(F.col("n") * days).alias("days"))
    return asked.join(of_span, span).groupBy("o_orderkey").agg(F.sum("in_transit").alias("in_transit"), F.sum("days").alias("days"))


_PARTS = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
_PARTS_SQL = ", ".join(f"round(quantile_cont({{0}}, {q}), 6) as {name}" for name, q in _PARTS.items())


@query(f"select l_returnflag, count(*) as n, {_PARTS_SQL.format('l_extendedprice')} from lineitem group by 1")
def quantile_set(spark, sf_dir):
    """The fixed set of quantiles of each group, of every row."""
    found = Q.quantiles(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), ["l_returnflag"], _PARTS)
    return found.withColumns({c: F.round(c, 6) for c in _PARTS})


_LANE = "lanes as (select lang, source, length(text) as chars, length(text) / greatest(1, len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> ''))) as per_word from documents)"


@query(
    f"with {_LANE} "
    + " union all ".join(
        f"select lang, '{c}' as measure, count(*) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as sd, round(min({c}), 6) as low, round(max({c}), 6) as high, round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.99), 6) as p99 from lanes group by lang"
        for c in ("chars", "per_word")
    )
)
def lane_geometry(spark, sf_dir):
    """Length and characters a word of every lane's documents, with exact p50 and p99."""
    words = F.size(F.array_remove(F.split(F.translate("text", "\n", " "), " "), ""))
    docs = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("chars"), (F.length("text") / F.greatest(words, F.lit(1))).alias("per_word"))
    both = docs.select("lang", F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in ("chars", "per_word")))).alias("m")).select("lang", "m.*")
    found = Q.summarised(both, F.col("v"), ["lang", "measure"], {"p50": 0.5, "p99": 0.99})
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "low", "high", "p50", "p99")})


@query(
    """with recursive l as (select row_number() over (order by doc_id) as k, doc_id, length(text) // 4 + 1 as n from documents where length(text) // 4 + 1 <= 4096),
p as (select k, doc_id, n, 0::bigint as pack, 0::bigint as segment, 0::bigint as start from l where k = 1
  union all select l.k, l.doc_id, l.n, case when start + p.n + l.n > 4096 then pack + 1 else pack end, case when start + p.n + l.n > 4096 then 0 else segment + 1 end, case when start + p.n + l.n > 4096 then 0 else start + p.n end from p join l on l.k = p.k + 1)
select doc_id, pack, segment, start from p"""
)
def sequential_packing(spark, sf_dir):
    """All documents in one order into sequences of 4096, one after the other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.floor(F.length("text") / 4) + 1).alias("length"))
    return K.sequential_pack(docs, "length", 4096, "doc_id").select("doc_id", "pack", "segment", "start")


_TALL = """with p as (select doc_id, unnest(string_split(text, chr(10))) as p from documents),
w as (select doc_id, list_prepend({'n': 1, 'used': 0, 'top': 0}, list_transform(string_split(p, ' '), lambda x: {'n': 0, 'used': length(x), 'top': 0})) as w from p),
r as (select doc_id, list_reduce(w, lambda a, b: case when a.used = 0 then {'n': a.n, 'used': b.used, 'top': greatest(a.top, b.used)} when b.used = 0 and a.used <= 123 then a
  when a.used + sign(b.used) + b.used > 123 then {'n': a.n + 1, 'used': b.used, 'top': greatest(a.top, b.used)} else {'n': a.n, 'used': a.used + 1 + b.used, 'top': greatest(a.top, a.used + 1 + b.used)} end) as r from w)
select doc_id, cast(sum(r.n) as integer) as lines, cast(greatest(40 + sum(r.n) * 17, 64) as integer) as height, cast(max(r.top) as integer) as longest from r group by doc_id"""


@query(_TALL)
def tall_pages(spark, sf_dir):
    """Every document on one page as high as it needs."""
    return T.tall_pages(table(spark, sf_dir, "documents"), "doc_id", "text", Page())


@query(None)
def page_fit(spark, sf_dir):
    """What of every document fits one and three pages, from one index."""
    index = T.wrap_index(table(spark, sf_dir, "documents"), "doc_id", "text", Page(), 3)
    one = T.fitting(index, Page(), 1).withColumnsRenamed({c: f"one_{c}" for c in ("lines_fit", "chars_fit", "all_fits")})
    return T.fitting(one, Page(), 3).drop("starts", "ends", "lengths", "whole")


@query(None)
def bpe_lengths(spark, sf_dir):
    """Tokens of every document by a public byte-level tokenizer, and of its first 64 tokens' text."""
    import public_tokenizers

    bpe = FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents")
    both = docs.select("doc_id", token_count_and_prefix(F.col("text"), bpe, 64).alias("t"))
    return both.select("doc_id", F.col("t.n").alias("n_tokens"), F.md5(F.col("t.prefix")).alias("prefix_md5"))


@query(None)
def page_fidelity(spark, sf_dir):
    """How near the sound that comes back from each row's page is to the one it was drawn from."""
    import numpy as np
    import pandas as pd

    def run(batches):
        from weft.functions import media, sound

        for pdf in batches:
            rows = []
            for key, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                if v is None or not len(v):
                    continue
                signal = np.tile(np.asarray(v, np.float32), -(-8000 // len(v)))[:8000]
                page = media.log_mel_pages(signal, 0.5)[0]
                back = sound.sound_of_page(page, 0.5, rounds=16)
                again = media.log_mel_pages(back.astype(np.float32), 0.5)[0]
                rows.append((key, *(media.fidelity(media.from_pixels(page), media.from_pixels(again))[c] for c in ("mse", "corr")), sound.round_trip(page, 160, 100)["rmse_over_sd"]))
            yield pd.DataFrame(rows, columns=["vec_id", "mse", "corr", "resize_loss"])

    # a row is some 20 ms of work, so rows are dealt evenly over many tasks, whatever the files are
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    dealt = rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "vec_id")
    return dealt.mapInPandas(run, "vec_id long, mse double, corr double, resize_loss double")


@query(
    """with s as (select pack, list(n order by segment) as segments, sum(n) as used from (with recursive l as (select row_number() over (order by doc_id) as k, doc_id, length(text) // 4 + 1 as n from documents where length(text) // 4 + 1 <= 4096),
p as (select k, n, 0::bigint as pack, 0::bigint as segment, 0::bigint as start from l where k = 1
  union all select l.k, l.n, case when start + p.n + l.n > 4096 then pack + 1 else pack end, case when start + p.n + l.n > 4096 then 0 else segment + 1 end, case when start + p.n + l.n > 4096 then 0 else start + p.n end from p join l on l.k = p.k + 1) select * from p) group by pack)
select pack, len(segments) as segments, cast(used as bigint) as used, cast(list_sum(list_transform(segments, lambda n: n * (n - 1) // 2)) as bigint) as position_sum from s"""
)
def packed_positions(spark, sf_dir):
    """Position ids of every pack, from 0 in each of its segments."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.floor(F.length("text") / 4) + 1).alias("length"))
    packs = Z.packed_segments(K.sequential_pack(docs, "length", 4096, "doc_id"), "length")
    total = F.aggregate(Z.position_ids(F.col("segments"), 4096), F.lit(0).cast("long"), lambda a, x: a + x)
    return packs.select("pack", F.size("segments").alias("segments"), "used", total.alias("position_sum"))


@query(
    """with d as (select lang, length(text) * 60.0 as ms from documents where length(text) > 0), p as (select lang, ms / (ceil(ms / 10000) * 10000) as share from d)
select lang, count(*) as n, round(avg(share), 6) as mean, round(stddev_samp(share), 6) as sd, round(min(share), 6) as low, round(max(share), 6) as high, round(median(share), 6) as median from p group by lang"""
)
def time_coverage(spark, sf_dir):
    """Share of their pages' time that documents take if read at 60 ms a character."""
    ms = F.length("text") * 60.0
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    found = Z.time_coverage(docs, ["lang"], ms, F.ceil(ms / 10000), 10000.0)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "low", "high", "median")})


@query(None)
def labelled_ids(spark, sf_dir):
    """Ids and labels of every conversation: what its assistant says is learned."""
    import public_tokenizers

    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    part = lambda t: F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), part(t).alias("content"))).alias("messages"))
    made = Z.labelled_ids(rows, FileTokenizer(public_tokenizers.path("byte_bpe_50k.json")), 0)
    return made.select("conv_id", F.size("input_ids").alias("n_ids"), "learned", F.md5(F.array_join("labels", ",")).alias("labels_md5"))
