"""Exploratory statistics and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkcast.config import ValidationConfig
from linkcast.functions.scalar import pearson
from linkcast.operators.ordering import Signal, index_series, join_by_keys, spread
from linkcast.operators.quantiles import quantiles


def unpivot(wide: DataFrame, keys: Sequence[str], cols: Sequence[str], value: str) -> DataFrame:
    """(keys, feature, value) rows of a wide one-row-per-group table."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias(value)) for c in cols]
    return wide.select(*keys, F.inline(F.array(*pairs)))


def describe(df: DataFrame, keys: Sequence[str], cols: Sequence[str], **q) -> DataFrame:
    """count, mean, std, min, quartiles and max per column."""
    keys = list(keys)
    aggs = []
    for c in cols:
        entry = F.struct(
            F.lit(c).alias("name"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
        )
        aggs.append(entry.alias(f"_d{len(aggs)}"))
    wide = df.groupBy(*keys).agg(*aggs)
    basic = wide.select(*keys, F.inline(F.array(*[F.col(f"_d{i}") for i in range(len(aggs))])))
    qs = quantiles(df, keys, cols, (0.25, 0.5, 0.75), **q)
    return basic.join(qs, [*keys, "name"]).select(
        *keys, "name", "count", "mean", "std", "min",
        *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))],
        "max",
    )


def variance_ranking(df: DataFrame, keys: Sequence[str], cols: Sequence[str], top: int = 10):
    """The columns with the largest sample variance, per group."""
    wide = df.groupBy(*keys).agg(*[F.var_samp(c).alias(c) for c in cols])
    return top_per_group(unpivot(wide, keys, cols, "variance"), keys, "variance", "feature", top)


def target_correlation(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], target: str, top: int | None = None
) -> DataFrame:
    """Absolute correlation of every column with the target, strongest first."""
    wide = df.groupBy(*keys).agg(*[F.abs(pearson(c, target)).alias(c) for c in cols])
    long = unpivot(wide, keys, cols, "correlation")
    return top_per_group(long, keys, "correlation", "feature", top)


def top_per_group(df: DataFrame, keys: Sequence[str], by: str, tie: str, top: int | None = None):
    """Rank rows of small per-group tables by ``by`` descending."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by), tie)
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def outliers(
    df: DataFrame, keys: Sequence[str], col: str, width: float = 3.0, n_groups: int | None = None, **q
) -> DataFrame:
    """Quartiles, bounds at ``width`` interquartile ranges and the rows outside."""
    keys = list(keys)
    qs = quantiles(df, keys, [col], (0.25, 0.75), **q).select(
        *keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")
    )
    iqr = F.col("q3") - F.col("q1")
    bounds = (
        qs.withColumn("iqr", iqr)
        .withColumn("lower_bound", F.col("q1") - width * iqr)
        .withColumn("upper_bound", F.col("q3") + width * iqr)
    )
    cut = ["q1", "q3", "iqr", "lower_bound", "upper_bound"]
    outside = (F.col(col) < F.col("lower_bound")) | (F.col(col) > F.col("upper_bound"))
    return (
        join_by_keys(df.select(*keys, col), bounds, keys, n_groups)
        .groupBy(*keys)
        .agg(
            *[F.max(c).alias(c) for c in cut],
            F.count_if(outside).alias("n_outliers"),
            (F.count_if(outside) / F.count(col) * 100).alias("outlier_pct"),
        )
    )


def autocorrelation(sig: Signal, base: str = "OptPow", max_lag: int = 100) -> DataFrame:
    """Correlation of x[:-k] with x[k:] for k below ``max_lag``, with the 95 % band.

    One window yields all lagged values and one aggregate their products. The
    sums of the two shifted halves follow from the totals and the few values at
    either end of the series.
    """
    keys, lags = list(sig.keys), range(1, max_lag)
    sizes = sig.df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(base).alias("_m"))
    df = sig.attach(sizes).withColumn("_x", F.col(base) - F.col("_m"))
    df, frame, own = spread(sig.with_df(df), max_lag, 0)
    df = df.withColumns({f"_l{k}": frame.lag("_x", k) for k in lags}).where(own)
    x, edge = F.col("_x"), max_lag - 1
    point = F.struct("seq", "_x")
    sums = df.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum(x).alias("_s"),
        F.sum(x * x).alias("_q"),
        F.array_sort(F.collect_list(F.when(F.col("seq") < edge, point))).alias("_head"),
        F.array_sort(F.collect_list(F.when(F.col("seq") >= F.col("n") - edge, point))).alias("_tail"),
        *[F.sum(x * F.col(f"_l{k}")).alias(f"_p{k}") for k in lags],
    )
    product = F.array(F.col("_q"), *[F.col(f"_p{k}") for k in lags])
    long = sums.select(*keys, "n", "_s", "_q", "_head", "_tail", F.posexplode(product).alias("lag", "_p"))

    def edge_sum(arr, power):
        return F.aggregate(
            arr, F.lit(0.0), lambda acc, p: acc + (p["_x"] if power == 1 else p["_x"] * p["_x"])
        )

    k, m = F.col("lag"), F.col("n") - F.col("lag")
    first = F.slice("_head", F.lit(1), k)
    last = F.slice("_tail", F.greatest(F.size("_tail") - k + 1, F.lit(1)), k)
    sx, sy = F.col("_s") - edge_sum(last, 1), F.col("_s") - edge_sum(first, 1)
    qx, qy = F.col("_q") - edge_sum(last, 2), F.col("_q") - edge_sum(first, 2)
    acf = F.try_divide(F.col("_p") - sx * sy / m, F.sqrt((qx - sx * sx / m) * (qy - sy * sy / m)))
    return long.where(m > 1).select(
        *keys, "lag", acf.alias("acf"), (F.lit(1.96) / F.sqrt("n")).alias("band")
    )


def histogram(
    df: DataFrame, keys: Sequence[str], col: str, bins: int = 100, n_groups: int | None = None
) -> DataFrame:
    """Equal-width bins between each group's minimum and maximum (non-empty bins).

    ``n_groups`` is the counted number of groups, if known.
    """
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.floor(F.try_divide(F.col(col) - F.col("_lo"), width))
    values = df.select(*keys, col).where(F.col(col).isNotNull())
    binned = join_by_keys(values, span, keys, n_groups).withColumn(
        "bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1))
    )
    return binned.groupBy(*keys, "bin").agg(
        F.max(F.col("_lo") + F.col("bin") * width).alias("left_edge"),
        F.count("*").alias("n"),
    )


def density(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    bins: int = 150_000,
    floor: float = 1e-6,
    n_groups: int | None = None,
) -> DataFrame:
    """Histogram scaled to unit area, bins with a share above ``floor`` only.

    The area is the trapezoid sum over the left edges of the kept bins.
    """
    keys = list(keys)
    hist = histogram(df, keys, col, bins, n_groups)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    kept = hist.withColumn("share", share).where(F.col("share") > floor)
    nxt = Window.partitionBy(*keys).orderBy("bin")
    step = (F.lead("left_edge").over(nxt) - F.col("left_edge")) * (
        F.lead("share").over(nxt) + F.col("share")
    )
    kept = kept.withColumn("_area", step / 2)
    area = F.sum("_area").over(Window.partitionBy(*keys))
    return kept.select(
        *keys, "bin", F.col("left_edge").alias("x"), F.try_divide(F.col("share"), area).alias("y")
    )


# The rational approximations of the inverse normal (Wichura 1988, AS 241) for the
# middle, the tails and the far tails; numerator and denominator, lowest power first.
INVERSE_NORMAL = (
    (
        (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
         4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
        (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
         2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    ),
    (
        (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
         1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
         1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    (
        (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
         2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
         7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
)


def _ratio(of: tuple, x: str) -> str:
    def powers(coefficients):
        text = f"{coefficients[-1]:.17e}"
        for c in coefficients[-2::-1]:
            text = f"({text} * {x} + {c:.17e})"
        return text

    return f"{powers(of[0])} / {powers(of[1])}"


def normal_quantile(p: str) -> str:
    """SQL text of the standard normal quantile of the column ``p``, to double precision."""
    middle, tail, far = INVERSE_NORMAL
    q, r = f"({p} - 0.5e0)", f"sqrt(-ln(least({p}, 1e0 - {p})))"
    side = f"(CASE WHEN {p} < 0.5e0 THEN -1e0 ELSE 1e0 END)"
    return (
        f"CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {_ratio(middle, f'(0.180625e0 - {q} * {q})')} "
        f"WHEN {r} <= 5e0 THEN {side} * {_ratio(tail, f'({r} - 1.6e0)')} "
        f"ELSE {side} * {_ratio(far, f'({r} - 5e0)')} END"
    )


def qq_points(sig: Signal, base: str = "OptPow", every: int = 100) -> DataFrame:
    """Every ``every``-th sample against standard normal quantiles.

    Plotting positions are Filliben's medians: 0.5^(1/n) at the top, its
    complement at the bottom and (i - 0.3175) / (n + 0.365) in between.
    """
    keys = list(sig.keys)
    picked = sig.df.where(F.col("seq") % every == 0).withColumn("_v", F.col(base))
    ranked = index_series(picked, keys, [base, "seq"], ["_v"])
    n = ranked.df.groupBy(*keys).agg(F.count("*").alias("n"))
    df = join_by_keys(ranked.df, n, keys, ranked.n_series)
    i, n = F.col("seq") + 1, F.col("n")
    top = F.pow(F.lit(0.5), 1 / n)
    position = (
        F.when(i == n, top).when(i == 1, 1 - top).otherwise((i - 0.3175) / (n + 0.365))
    )
    placed = df.select(*keys, i.alias("rank"), position.alias("_p"), F.col("_v").alias("observed"))
    return placed.select(*keys, "rank", F.expr(normal_quantile("_p")).alias("theoretical"), "observed")


def quality_counts(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows, missing values, infinite values and range over all ``cols``."""

    def total(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    missing = [F.count_if(F.col(c).isNull() | F.isnan(c)) for c in cols]
    infinite = [F.count_if(F.abs(c) == float("inf")) for c in cols]
    lows, highs = [F.min(c) for c in cols], [F.max(c) for c in cols]
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        total(missing).alias("n_nan"),
        total(infinite).alias("n_inf"),
        (F.least(*lows) if len(cols) > 1 else lows[0]).alias("min_value"),
        (F.greatest(*highs) if len(cols) > 1 else highs[0]).alias("max_value"),
    )


def validate(
    df: DataFrame, cols: Sequence[str], name: str = "data", cfg: ValidationConfig = ValidationConfig()
) -> dict:
    """Counts over all columns; a ``ValueError`` names the columns that break a rule."""
    missing = [F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"missing_{i}") for i, c in enumerate(cols)]
    infinite = [F.count_if(F.abs(c) == float("inf")).alias(f"infinite_{i}") for i, c in enumerate(cols)]
    each = df.agg(*missing, *infinite).first().asDict()
    row = quality_counts(df, [], cols).first().asDict()
    rules = [("missing", cfg.check_nan), ("infinite", cfg.check_inf)]
    broken = [
        f"{c} has {each[f'{rule}_{i}']} {rule} values"
        for rule, on in rules if on
        for i, c in enumerate(cols) if each[f"{rule}_{i}"]
    ]
    if cfg.check_empty and not row["n_rows"]:
        broken.insert(0, "there are no rows")
    if broken:
        raise ValueError(f"{name}: " + ", ".join(broken))
    return row
