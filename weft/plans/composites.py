"""Runs and reports made of several operators: rebuilds, mixtures, evaluations and gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as X
from weft.functions.decisions import first_match
from weft.operators import conversation as C
from weft.operators import mixture as M
from weft.operators import series as R
from weft.operators import stats as S
from weft.operators.audit import sentinel_score
from weft.sources.catalog import Catalog

SPLITS = ("train", "validation")


def rebuild(catalog: Catalog, lanes: dict[str, Callable[[], DataFrame]], ratio: float = 0.9, seed: int = 42, tokenizer: str = "char") -> list[dict]:
    """Makes every lane that the catalog lacks: canonical rows, token lengths filled in, split by
    seeded order, both splits committed and in the manifest. A run that was broken off goes on
    where it stopped: splits that are there are kept, and a lane that has both is not made."""
    for lane, make in lanes.items():
        if all(catalog.has(lane, s) and catalog.lookup(lane, s) for s in SPLITS):
            continue
        rows = M.split(C.fill_token_length(make(), tokenizer), ratio, seed, "row_id", name="__part")
        for part in SPLITS:
            if not (catalog.has(lane, part) and catalog.lookup(lane, part)):
                own = C.retarget(rows.where(F.col("__part") == part).drop("__part"), part).to(C.CANONICAL)
                catalog.commit(own, lane, part, source=lane, training=part == "train", force=True)
    return [e for e in catalog.manifest()["subsets"] if e["config_name"] in lanes]


def token_share_mixture(rows: DataFrame, lane: str, tokens: str, shares: dict[str, float], total_rows: int, seed: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a mixture by token shares, each lane's first in seeded order up to its plan, and
    the check: planned, available and built rows, tokens and their share, one row for each lane."""
    spark = rows.sparkSession
    have = rows.groupBy(lane).agg(F.count("*").alias("available"), F.avg(tokens).alias("mean_tokens"))
    asked = spark.createDataFrame(list(shares.items()), f"{lane} string, share double")
    plan = M.token_share_plan(have.join(F.broadcast(asked), lane), total_rows, "share", "mean_tokens", "available")
    wanted = {r[lane]: r["rows"] for r in plan.collect()}  # one row for each lane
    parts = [M.bounded_sample(rows.where(F.col(lane) == name), n, seed, *keys) for name, n in wanted.items() if n > 0]
    mixture = M.union_all(*parts)
    built = mixture.groupBy(lane).agg(F.count("*").alias("built"), F.sum(tokens).cast("long").alias("built_tokens"))
    check = plan.select(lane, "planned", "available", "clamped").join(built, lane, "left")
    whole = mixture.agg(F.sum(tokens).alias("all_tokens"))
    check = check.crossJoin(F.broadcast(whole))  # one row
    return mixture, check.select(lane, "planned", "available", "clamped", F.coalesce("built", F.lit(0)).alias("built"), F.coalesce("built_tokens", F.lit(0)).alias("built_tokens"), S.rounded(F.coalesce("built_tokens", F.lit(0)) / F.col("all_tokens")).alias("share"))


def position_decay(scores: DataFrame, by: list[str], bins=S.TOKEN_BINS, least: int = 30) -> DataFrame:
    """Gain of each group by bins of positions, rows and tokens behind it, and the deepest bin that keeps half of bin 0's gain."""
    d = F.col("a_c").cast("double") - F.col("b_c").cast("double")
    placed = scores.withColumn("bin_no", S.bin_number(F.col("pos"), bins)).where(F.col("bin_no").isNotNull())
    rows = placed.groupBy(*by, "bin_no", "row").agg(F.count("*").alias("k"), F.sum(d).alias("s"))
    gains = rows.groupBy(*by, "bin_no").agg(F.sum("k").alias("n_tokens"), F.count("*").alias("n_rows"), S.rounded(F.sum("s") / F.sum("k") * 100).alias("gain_pts"))
    gains = gains.join(F.broadcast(S.bin_table(scores.sparkSession, bins).select("bin_no", "lo")), "bin_no")
    deep = S.deepest_bin(gains, by).select(*by, "d50_lo", "status")
    return gains.join(deep, by).select(*by, "lo", "n_tokens", "n_rows", "gain_pts", (F.col("n_tokens") < least).alias("underpowered"), "d50_lo", "status")


def density_ladder(buckets: DataFrame, rung: str, density: DataFrame, width: int, baseline: int, least: int) -> DataFrame:
    """Where each rung's gain collapses, beside its density, and whether it collapses no later than
    the rung of the next lower density."""
    from pyspark.sql import Window

    found = S.collapse_point(buckets, [rung], width, baseline, least).join(density, rung)
    before = F.lag("k_chars").over(Window.orderBy("density", rung))  # one row for each rung
    return found.select(rung, "density", "status", "k_chars", "baseline_gain_pts", F.when(before.isNull() | F.col("k_chars").isNull(), None).otherwise(F.col("k_chars") <= before).alias("no_later"))


def masked_report(df: DataFrame, by: list[str], reference: str, hypothesis: str, sentinel: str) -> DataFrame:
    """Of each group: rows, reference pieces, shares that agree by place and at all, and of the other's that are invented."""
    rows = sentinel_score(df, reference, hypothesis, sentinel)
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum("n_reference").cast("long").alias("pieces"), S.rounded(F.try_divide(F.sum("positional"), F.sum("n_reference"))).alias("positional"),
        S.rounded(F.try_divide(F.sum("recalled"), F.sum("n_reference"))).alias("recalled"), S.rounded(F.try_divide(F.sum("invented"), F.sum("n_hypothesis"))).alias("invented"),
    )


def wer_gate(df: DataFrame, variant: str, reference: str, hypothesis: str, control: str, tolerance: float, mode: str = "letters") -> DataFrame:
    """Corpus word error rate of each variant, and whether it is within the tolerance of the control's."""
    a, b = X.wer_words(F.col(reference), mode), X.wer_words(F.col(hypothesis), mode)
    each = df.select(variant, X.word_edits(a, b).alias("edits"), F.size(a).alias("words")).groupBy(variant).agg(F.count("*").alias("rows"), F.sum("edits").alias("edits"), F.sum("words").cast("long").alias("words"))
    rated = each.withColumn("wer", S.rounded(F.try_divide("edits", "words")))
    base = rated.where(F.col(variant) == control).select(F.col("wer").alias("__base"))
    joined = rated.crossJoin(F.broadcast(base))  # one row
    return joined.select(variant, "rows", "edits", "words", "wer", F.when(F.col("wer") - F.col("__base") <= tolerance, "PASS").otherwise("FAIL").alias("gate"))


def log_guard(df: DataFrame, lane: str, index: str, value: str, inflated: float, bar: float, n: int) -> DataFrame:
    """VOID if the value ever rose by more than a share of its first, ALARM if the last n are all below the bar, else PASS."""
    rise = R.inflation(df, lane, index, value).groupBy(lane).agg(F.max("inflation").alias("max_inflation"))
    late = R.alarm(df, lane, index, value, bar, n)
    verdict = first_match([(F.col("max_inflation") > inflated, "VOID"), (F.col("alarm"), "ALARM")], "PASS")
    return late.join(rise, lane).select(lane, "n", "last", "max_inflation", verdict.alias("verdict"))


def cliff_table(df: DataFrame, lane: str, index: str, value: str, gate: DataFrame) -> DataFrame:
    """The largest fall of each lane over its rungs, with the anchor gate's status and the branch that follows."""
    falls = R.adjacent_drop(df, lane, index, value)
    branch = first_match([(F.col("gate") != "PASS", "do not read"), (F.col("shape") == "cliff", "stop at the rung before"), (F.col("shape") == "gradual", "take more rungs")], "go on")
    return falls.join(gate.select(lane, F.col("status").alias("gate")), lane).select(lane, "largest_drop", "at_step", "shape", "gate", branch.alias("branch"))


def exposed_delta(exposed: DataFrame, by: list[str], lo: int, hi: int) -> DataFrame:
    """Loss added by permutation on tokens at lo to hi - 1, by whether they touch a marked character.
    exposed: row, pos, touching and the scores that `token_exposure` kept, so that scores are not joined again."""
    window = exposed.where((F.col("pos") >= lo) & (F.col("pos") < hi))
    return window.groupBy(*by, "touching").agg(F.count("*").alias("n"), F.count_distinct("row").alias("rows"), S.rounded(F.avg(F.col("p_ce") - F.col("a_ce"))).alias("delta"))


def alignment(weights: DataFrame, by: list[str], item: str, place: str, weight: str, time: Column) -> DataFrame:
    """Rank correlation, in each group, of items' weighted mean places with their times."""
    each = weights.withColumn("__t", time).groupBy(*by, item).agg(F.try_divide(F.sum(F.col(place) * F.col(weight)), F.sum(weight)).alias("centroid"), F.min("__t").alias("time"))
    return S.spearman(each.where(F.col("centroid").isNotNull()), "centroid", "time", by, item)
