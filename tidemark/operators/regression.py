"""Means and regressions with autocorrelation-robust errors.

Spark forms every sum over rows and solves the systems of a few unknowns, one per series, in array expressions. The
lags run inside one series ordered by time, which has one row per period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cleaning import ratio


def lagged_products(
    df: DataFrame, series: list[str], order: str, e: str, lags: int
) -> DataFrame:
    """sums of ``e`` times its own lags, s0 to s``lags``, by series; other columns are kept first."""
    w = Window.partitionBy(*series).orderBy(order)
    x = df.withColumns({f"_e{k}": F.lag(e, k).over(w) for k in range(1, lags + 1)})
    rest = [c for c in df.columns if c not in (*series, order, e)]
    return x.groupBy(*series).agg(
        *[F.first(c, True).alias(c) for c in rest],
        F.sum(F.col(e) * F.col(e)).alias("s0"),
        *[
            F.coalesce(F.sum(F.col(e) * F.col(f"_e{k}")), F.lit(0.0)).alias(f"s{k}")
            for k in range(1, lags + 1)
        ],
    )


def centred(df: DataFrame, series: list[str], order: str, value: str) -> DataFrame:
    """Deviations from the mean of each series, with the mean and the row count."""
    x = df.filter(F.col(value).isNotNull()).select(*series, order, value)
    stats = x.groupBy(*series).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return x.join(stats, series).select(
        *series, order, "mean", "n", (F.col(value) - F.col("mean")).alias("e")
    )


def newey_west_mean(
    df: DataFrame, series: list[str], order: str, value: str, lags: int
) -> DataFrame:
    """Mean, plain t and Newey-West t of every series; fewer than 3 rows give nulls."""
    sums = lagged_products(centred(df, series, order, value), series, order, "e", lags)
    n = F.col("n")
    s = F.col("s0") / n  # a group has at least one row
    for lag in range(1, lags + 1):
        s = s + 2.0 * (1.0 - lag / (lags + 1.0)) * F.col(f"s{lag}") / n
    enough = n >= 3
    se_nw = F.sqrt(F.greatest(s, F.lit(1e-18)) / n)
    se_ols = F.sqrt(ratio(F.col("s0") / n, n - 1))
    return sums.select(
        *series, "n", F.when(enough, F.col("mean")).alias("mean"),
        F.when(enough, ratio(F.col("mean"), se_ols)).alias("t_ols"),
        F.when(enough, F.col("mean") / se_nw).alias("t_nw"),
        F.when(enough, se_nw).alias("se_nw"),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def inverse(m: Column, k: int) -> Column:
    """The inverse of a small matrix of products (an array of k rows), by elimination beside the unit matrix.

    Such a matrix is positive semidefinite, so no rows are exchanged. Where next to nothing of a column is left, the
    earlier ones add up to it: its row and column are zero in the result.
    """
    beside = F.transform(
        m, lambda row, i: F.concat(row, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0)))
    )

    def eliminate(a: Column, p: Column) -> Column:
        pivot_row = F.element_at(a, p + 1)
        pivot = F.element_at(pivot_row, p + 1)
        some = pivot > 1e-12 * F.element_at(F.element_at(m, p + 1), p + 1)
        return F.transform(
            a,
            lambda row, i: F.when(i == p, F.transform(row, lambda v: F.when(some, v / F.nullif(pivot, F.lit(0.0))).otherwise(0.0)))
            .when(some, F.zip_with(row, pivot_row, lambda v, q: v - F.element_at(row, p + 1) / F.nullif(pivot, F.lit(0.0)) * q))
            .otherwise(row),
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), beside, eliminate)
    return F.transform(done, lambda row: F.slice(row, k + 1, k))


def ols_newey_west(
    df: DataFrame, models: list[str], order: str, y: str, xs: list[str], lags: int, min_rows: int
) -> DataFrame:
    """Least squares of y on a constant and ``xs`` for every model, with Newey-West errors.

    Returns one row per (model, term): coefficient, se, t, r2, n. A term that the terms before it add up to has
    coefficient and se 0, and no t.
    """
    terms = ["const", *xs]
    d = df.select(*models, order, F.col(y).alias("_y"), *xs)
    for c in ["_y", *xs]:
        d = d.filter(F.col(c).isNotNull())
    z = [F.lit(1.0)] + [F.col(x) for x in xs]
    k = len(z)
    moments = d.groupBy(*models).agg(
        F.array(*[F.array(*[F.sum(z[i] * z[j]) for j in range(k)]) for i in range(k)]).alias("xx"),
        F.array(*[F.sum(z[i] * F.col("_y")) for i in range(k)]).alias("xy"),
        F.count(F.lit(1)).alias("n"), F.var_pop("_y").alias("_vy"),
    ).filter(F.col("n") >= min_rows)

    # one row per model
    fitted = moments.withColumn("inv", inverse(F.col("xx"), k)).withColumn(
        "b", F.transform("inv", lambda row: dot(row, F.col("xy")))
    )
    e = d.join(fitted.select(*models, "b"), models)
    fit = sum((F.col("b")[i] * z[i] for i in range(1, k)), F.col("b")[0] * z[0])
    e = e.withColumn("_e", F.col("_y") - fit)
    e = e.select(*models, order, "_e", *[(z[i] * F.col("_e")).alias(f"u{i}") for i in range(k)])
    # a quadratic form takes each lag twice, so the weighted lags of a row are added up before they are multiplied
    w = Window.partitionBy(*models).orderBy(order)
    weights = {lag: 2 * (1 - lag / (lags + 1.0)) for lag in range(1, lags + 1)}
    e = e.withColumns(
        {
            f"s{i}": sum(
                (weights[lag] * F.coalesce(F.lag(f"u{i}", lag).over(w), F.lit(0.0)) for lag in weights), F.col(f"u{i}")
            )
            for i in range(k)
        }
    )
    sums = e.groupBy(*models).agg(
        F.array(*[F.array(*[F.sum(F.col(f"u{i}") * F.col(f"s{j}")) for j in range(k)]) for i in range(k)]).alias("meat"),
        F.sum(F.col("_e") * F.col("_e")).alias("_sse"),
    )
    spread = F.transform(
        "inv",
        lambda v: F.sqrt(F.greatest(F.lit(0.0), dot(v, F.transform(F.col("meat"), lambda row: dot(row, v))))),
    )
    done = fitted.join(sums, models).withColumn("se", spread).withColumn(
        "r2", 1 - ratio(F.col("_sse"), F.col("_vy") * F.col("n"))
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("term"), F.col("b")[i].alias("coef"), F.col("se")[i].alias("se"),
                ratio(F.col("b")[i], F.col("se")[i]).alias("t"),
            )
            for i, t in enumerate(terms)
        ]
    )
    return done.select(*models, "n", "r2", F.inline(rows))


def detectable(
    table: DataFrame, se: str, n: str, hurdles: DataFrame, effect: float
) -> DataFrame:
    """Smallest detectable effect, needed rows and power ratio at each hurdle.

    ``hurdles`` has a few rows (name, t), so pairing it with every series is linear in the series.
    """
    j = table.crossJoin(F.broadcast(hurdles))
    sd = F.col(se) * F.sqrt(F.col(n))
    return j.select(
        *[c for c in table.columns if c not in (se,)], F.col("name").alias("hurdle"),
        (F.col("t") * F.col(se)).alias("mde"),
        F.pow(F.col("t") * sd / effect, F.lit(2.0)).alias("needed"),
        (F.col("t") * F.col(se) / effect).alias("power_ratio"),
    )


def power_grid(
    table: DataFrame, sd: str, n: str, hurdles: DataFrame, scales: tuple[float, ...], sizes: tuple[int, ...], effect: float
) -> DataFrame:
    """Smallest detectable effect over a grid of spreads and sample sizes.

    Every series is asked at multiples of its own standard deviation (``scales``) and of its own number of rows
    (``sizes``). ``hurdles`` has a few rows (name, t).
    """
    cells = F.array(
        *[
            F.struct(F.lit(float(s)).alias("sd_times"), F.lit(int(k)).cast("long").alias("n_times"))
            for s in scales for k in sizes
        ]
    )
    j = table.select("*", F.inline(cells)).crossJoin(F.broadcast(hurdles))
    mde = F.col("t") * F.col(sd) * F.col("sd_times") / F.sqrt(F.col(n) * F.col("n_times"))
    return j.select(
        *[c for c in table.columns if c not in (sd, n)], "sd_times", (F.col(n) * F.col("n_times")).alias("n"),
        F.col("name").alias("hurdle"), mde.alias("mde"), (mde <= effect).alias("detects"),
    )
