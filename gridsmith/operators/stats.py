"""Statistics of bands over finite values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions.scalar import bin_of, finite, is_finite, ratio_or_null, stretch, z_score


def _long(one: DataFrame, bands: Sequence[str], fields: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(b).alias("band"), *[F.col(f"{b}_{f}").alias(f) for f in fields]) for b in bands])
    return one.select(F.inline(rows))


def band_stats(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """band, mean, std (of the population), n_finite, n_total and nan_fraction (all that isn't finite): all bands in one scan and one aggregate."""
    aggs = []
    for b in bands:
        x = finite(F.col(b).cast("double"))
        aggs += [F.avg(x).alias(f"{b}_mean"), F.stddev_pop(x).alias(f"{b}_std"), F.count(x).alias(f"{b}_n_finite"), F.count("*").alias(f"{b}_n_total")]
    out = _long(pixels.agg(*aggs), bands, ("mean", "std", "n_finite", "n_total"))
    return out.withColumn("nan_fraction", ratio_or_null(F.col("n_total") - F.col("n_finite"), F.col("n_total")))


def value_ranges(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """band, least and greatest finite value (null without any), NaN count and infinite count."""
    aggs = []
    for b in bands:
        x = F.col(b).cast("double")
        aggs += [F.min(finite(x)).alias(f"{b}_min_value"), F.max(finite(x)).alias(f"{b}_max_value"), F.count_if(F.isnan(x)).alias(f"{b}_n_nan"), F.count_if(F.abs(x) == float("inf")).alias(f"{b}_n_inf")]
    return _long(pixels.agg(*aggs), bands, ("min_value", "max_value", "n_nan", "n_inf"))


def normalized(pixels: DataFrame, stats: DataFrame, bands: Sequence[str]) -> DataFrame:
    """z-scored bands. The statistics are one row a band: they are joined as one row of structs, broadcast by their number of bands."""
    one = stats.agg(*[F.max(F.when(F.col("band") == b, F.struct("mean", "std"))).alias(f"__{b}") for b in bands])
    met = pixels.crossJoin(F.broadcast(one))  # one row, whatever the input
    return met.withColumns({b: z_score(F.col(b).cast("double"), F.col(f"__{b}.mean"), F.col(f"__{b}.std")) for b in bands}).drop(*[f"__{b}" for b in bands])


def percentiles(pixels: DataFrame, x: Column, shares: Sequence[float], gather: int = 100_000) -> list[float | None]:
    """Linearly interpolated percentiles of the finite values, exactly; None without any.

    A bounded sketch brackets all ranks at once, and one pass counts what lies
    below and in each bracket. A bracket that holds more than `gather` rows and
    more than one value is bracketed anew, until each can be sorted: no group
    grows with the data, and the passes are as many as the worst rank needs.
    """
    values = pixels.select(finite(x.cast("double")).alias("x")).where("x IS NOT NULL")
    first = values.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    n = first["n"]
    if not n:
        return [None for _ in shares]
    wanted = [share * (n - 1) for share in shares]
    ranks = sorted({r for w in wanted for r in (int(w), min(n - 1, int(w) + 1))})
    found = _ranked(values, ranks, _Bracket(first["low"], first["high"], 0, n), gather)
    return [found[int(w)] + (w - int(w)) * (found[min(n - 1, int(w) + 1)] - found[int(w)]) for w in wanted]


@dataclass(frozen=True)
class _Bracket:
    """Values from low to high: how many rows lie below and inside."""

    low: float
    high: float
    below: int
    inside: int

    def holds(self, x: Column) -> Column:
        return (x >= self.low) & (x <= self.high)


def _ranked(values: DataFrame, ranks: list[int], whole: _Bracket, gather: int) -> dict[int, float]:
    """The values at 0-based ranks."""
    x = F.col("x")
    at = dict.fromkeys(ranks, whole)
    wide = lambda b: b.inside > gather and b.low < b.high
    while todo := [r for r in ranks if wide(at[r])]:
        near = lambda r: (r - at[r].below) / at[r].inside
        ends = values.agg(*[F.percentile_approx(F.when(at[r].holds(x), x), [max(0.0, near(r) - 1e-3), min(1.0, near(r) + 1e-3)], 10_000).alias(f"r{r}") for r in todo]).first()
        new = {r: (at[r].low if near(r) <= 1e-3 else ends[f"r{r}"][0], at[r].high if near(r) >= 1 - 1e-3 else ends[f"r{r}"][1]) for r in todo}
        counts = values.agg(*[c for r in todo for c in (F.count_if(x < new[r][0]).alias(f"b{r}"), F.count_if(x <= new[r][1]).alias(f"t{r}"), F.max(F.when(x < new[r][0], x)).alias(f"l{r}"), F.min(F.when(x > new[r][1], x)).alias(f"h{r}"))]).first()
        for r in todo:
            below, through = counts[f"b{r}"], counts[f"t{r}"]
            if r < below:  # the sketch missed: the part's other side is taken instead
                at[r] = _Bracket(at[r].low, counts[f"l{r}"], at[r].below, below - at[r].below)
            elif r >= through:
                at[r] = _Bracket(counts[f"h{r}"], at[r].high, through, at[r].below + at[r].inside - through)
            elif through - below < at[r].inside:
                at[r] = _Bracket(*new[r], below, through - below)
            else:  # too few different values for the sketch: the least one goes, or stays alone
                one = values.where(at[r].holds(x)).agg(F.count_if(x == at[r].low).alias("n"), F.min(F.when(x > at[r].low, x)).alias("next")).first()
                alone = r < at[r].below + one["n"]
                at[r] = _Bracket(at[r].low, at[r].low, at[r].below, one["n"]) if alone else _Bracket(one["next"], at[r].high, at[r].below + one["n"], at[r].inside - one["n"])
    open_ranks = [r for r in ranks if at[r].low < at[r].high]
    sorts = [F.sort_array(F.collect_list(F.when(at[r].holds(x), x)))[r - at[r].below].alias(f"r{r}") for r in open_ranks]
    rows = values.agg(*sorts).first() if sorts else None
    return {r: rows[f"r{r}"] if r in open_ranks else at[r].low for r in ranks}


def histogram(pixels: DataFrame, x: Column, bins: int, low: Column, high: Column) -> DataFrame:
    """bin and n of every bin, empty ones included; the last one holds the maximum. low and high are literals or columns."""
    counted = pixels.select(bin_of(x, low, high, bins).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    return pixels.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def band_histograms(pixels: DataFrame, bands: Sequence[str], bins: int = 32) -> DataFrame:
    """band, bin and n between each band's least and greatest finite value, empty bins included: one scan for the ends and one for the counts, whatever the number of bands."""
    ends = value_ranges(pixels, bands).select("band", "min_value", "max_value")
    long = pixels.select(F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("x")) for b in bands])))
    met = long.join(F.broadcast(ends), "band")  # a row a band
    counted = met.groupBy("band", bin_of(F.col("x"), F.col("min_value"), F.col("max_value"), bins).alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("band", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counted, ["band", "bin"], "left").select("band", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def stretched(pixels: DataFrame, band: str, low: float, high: float) -> DataFrame:
    return pixels.withColumn(band, stretch(F.col(band).cast("double"), F.lit(float(low)), F.lit(float(high))))


def sanity_issues(rows: DataFrame, mask: str, fold: str, value: str, expected_folds: int) -> DataFrame:
    """One row: an array of found issues, and what they rest on."""
    facts = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col(fold).isNull()).alias("n_without_fold"), F.countDistinct(fold).alias("n_folds"),
        F.count_if(~F.col(mask).isin(0, 1)).alias("n_not_binary"), F.count_if(~is_finite(F.col(value))).alias("n_not_finite"),
    )
    say = lambda condition, text: F.when(condition, F.lit(text))
    issues = F.array_compact(F.array(say(F.col("n") == 0, "no rows"), say(F.col("n_without_fold") > 0, "rows without fold"), say(F.col("n_folds") != expected_folds, "unexpected number of folds"), say(F.col("n_not_binary") > 0, "mask is not binary"), say(F.col("n_not_finite") > 0, "values that are not finite")))
    return facts.withColumn("issues", issues)
