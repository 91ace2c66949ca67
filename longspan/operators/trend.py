"""Yearly series: bands, trends, breakpoints, classes and smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from longspan.functions import columns as C, student
from longspan.sources.stages import stage

Z95 = 1.96


def with_band(df: DataFrame, value: str = "cos", sd: str = "sd") -> DataFrame:
    """95% band clipped to [-0.1, 0.9]; null where the value or its spread is missing."""
    half = F.col(sd) * F.lit(Z95)
    return df.withColumns(
        {
            "high_se": C.lower_of(F.col(value) + half, 0.9),
            "low_se": C.higher_of(F.col(value) - half, -0.1),
        }
    )


def series_table(
    cosines: DataFrame, prevalence: DataFrame, spread: DataFrame, names: DataFrame
) -> DataFrame:
    """(drug, year) rows with cosine, prevalence, spread, band and display name.

    `cosines(drug, year, cos)` is already on the full year grid, `prevalence(drug, year, freq)`,
    `spread(drug, year, sd)`, `names(drug, name)`; a class has itself as name.
    """
    return with_band(
        cosines.join(prevalence, ["drug", "year"], "left").join(spread, ["drug", "year"], "left")
    ).join(names, "drug", "left").withColumn("name", F.coalesce("name", "drug"))


def class_panels(series: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of each class and its members, for classes with more than one entry beyond the class.

    `series(drug, ...)`, `members(treatment_class, drug)`. Adds panel, is_class, n_valid and the
    smoother that the number of valid points allows.
    """
    own = members.select(
        F.col("treatment_class").alias("panel"), F.col("treatment_class").alias("drug")
    ).distinct()
    listed = members.select(F.col("treatment_class").alias("panel"), "drug").distinct()
    rows = series.join(own.unionByName(listed), "drug")
    sizes = rows.groupBy("panel").agg(F.count_distinct("drug").alias("_size"))
    group = W.partitionBy("panel", "drug")
    return (
        rows.join(sizes.where(F.col("_size") > 2), "panel", "left_semi")
        .withColumn("is_class", F.col("drug") == F.col("panel"))
        .withColumn("n_valid", F.count("cos").over(group))
        .withColumn("smoother", F.when(F.col("n_valid") > 4, "loess").otherwise("lm"))
    )


def ols_trend(df: DataFrame, key: str = "drug", x: str = "year", y: str = "cos") -> DataFrame:
    """Slope, its standard error, t, two-sided p and direction per series.

    Series with at most two complete points keep their count and have null statistics.
    """
    complete = F.col(x).isNotNull() & F.col(y).isNotNull()
    a = F.when(complete, F.col(x).cast("double"))
    b = F.when(complete, F.col(y).cast("double"))
    fit = df.groupBy(key).agg(
        F.count(a).alias("n"),
        F.regr_slope(b, a).alias("_slope"),
        F.regr_sxx(b, a).alias("_sxx"),
        F.regr_syy(b, a).alias("_syy"),
        F.regr_sxy(b, a).alias("_sxy"),
    )
    enough = F.col("n") > 2
    explained = F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx"))
    left = F.greatest(F.lit(0.0), F.col("_syy") - explained)
    se = F.sqrt(F.try_divide(F.try_divide(left, F.col("n") - 2), F.col("_sxx")))
    return (
        fit.withColumn("beta", F.when(enough, F.col("_slope")))
        .withColumn("se_beta", F.when(enough, se))
        .withColumn("t", ratio("beta", "se_beta"))
        .withColumn("p", student.two_sided_p("t", "n - 2"))
        .select(key, "n", "beta", "se_beta", "t", "p")
    )


def ratio(beta: str, se: str) -> Column:
    """t statistic; a slope without error is infinitely far from zero."""
    certain = F.when(F.col(beta) == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return F.when(F.col(se) == 0, certain).otherwise(F.try_divide(F.col(beta), F.col(se)))


def direction(p: Column, beta: Column, alpha: float = 0.05) -> Column:
    return (
        F.when((p < alpha) & (beta > 0), "Increase")
        .when((p < alpha) & (beta < 0), "Decrease")
        .otherwise("None")
    )


def zscores(df: DataFrame, key: str = "drug", value: str = "cos") -> DataFrame:
    """Value centred and scaled within its series; a series has one row per year."""
    group = W.partitionBy(key)
    return (
        df.where(F.col(value).isNotNull())
        .withColumns(
            {
                "mean": F.avg(value).over(group),
                "sd": F.stddev_samp(value).over(group),
            }
        )
        .withColumn("z", F.when(F.col("sd") > 0, (F.col(value) - F.col("mean")) / F.col("sd")))
    )


def series_span(df: DataFrame, key: str = "drug", x: str = "year", y: str = "cos") -> DataFrame:
    """First and last year with a value; null for a series without any."""
    year = F.when(F.col(y).isNotNull(), F.col(x))
    return df.groupBy(key).agg(
        F.min(year).alias("start"), F.max(year).alias("end"), F.count(year).alias("n")
    )


BREAK_FIT = """
    with b as (
      select k, y, x - avg(x) over s as u, avg(x) over s as centre, count(*) over s as n
      from {points} window s as (partition by k)),
    knots as (
      select k, u, row_number() over (partition by k order by u) as at, count(*) over (partition by k) as last
      from (select distinct k, u from b where n >= {least})),
    gaps as (
      select k, u as low, lead(u) over (partition by k order by u) as high, at, last from knots),
    sides as (
      select g.k, low, high,
        regr_slope(y, u) filter (where u <= low) as sa, regr_intercept(y, u) filter (where u <= low) as ia,
        regr_slope(y, u) filter (where u >= high) as sb, regr_intercept(y, u) filter (where u >= high) as ib
      from gaps g join b on g.k = b.k
      where last >= 4 and at >= 2 and at + 1 <= last - 1 group by g.k, low, high),
    crossings as (select k, low, high, try_divide(ia - ib, sb - sa) as psi from sides),
    candidates as (
      select k, u as psi from knots where last >= 4 and at between 2 and last - 1
      union all select k, psi from crossings where psi > low and psi < high),
    terms as (
      select c.k, psi, n, centre, u, y, greatest(u - psi, 0D) as h, if(u > psi, -1D, 0D) as g
      from candidates c join b on c.k = b.k),
    sums as (
      select k, psi, max(n) as n, max(centre) as centre, regr_sxx(y, u) as uu, regr_sxx(y, h) as hh,
        regr_sxx(y, g) as gg, regr_sxy(u, h) as uh, regr_sxy(u, g) as ug, regr_sxy(h, g) as hg,
        regr_sxy(u, y) as uy, regr_sxy(h, y) as hy, regr_sxy(g, y) as gy, regr_syy(y, u) as yy
      from terms group by k, psi),
    scored as (
      select *, (hy - uh * uy / uu) / (hh - uh * uh / uu) as delta,
        yy - uy * uy / uu - pow(hy - uh * uy / uu, 2) / (hh - uh * uh / uu) as rss,
        uu * (hh * gg - hg * hg) - uh * (uh * gg - hg * ug) + ug * (uh * hg - hh * ug) as det
      from sums where uu > 0 and hh * uu - uh * uh > 1e-12 * uu * hh),
    best as (select *, row_number() over (partition by k order by rss, psi) as pick from scored),
    inverse as (
      select *, (uy - delta * uh) / uu as beta1, det <= 1e-9 * uu * hh * gg as spent,
        try_divide(hh * gg - hg * hg, det) as i11, try_divide(uu * gg - ug * ug, det) as i22,
        try_divide(uu * hh - uh * uh, det) as i33, try_divide(ug * hg - uh * gg, det) as i12,
        try_divide(uh * hg - hh * ug, det) as i13, try_divide(ug * uh - uu * hg, det) as i23
      from best where pick = 1),
    noise as (
      select *, greatest(0D, (yy - uy * uy * i11 - hy * hy * i22 - gy * gy * i33
        - 2 * (uy * hy * i12 + uy * gy * i13 + hy * gy * i23)) / (n - 4)) as v
      from inverse)
    select k, psi + centre as change_point, beta1, beta1 + delta as beta2,
      if(spent, double('infinity'), sqrt(greatest(0D, v * i11))) as se1,
      if(spent, double('infinity'), sqrt(greatest(0D, v * (i11 + i22 + 2 * i12)))) as se2
    from noise"""


def _points(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return complete.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def break_trends(df: DataFrame, key: str = "drug", x: str = "year", y: str = "cos") -> DataFrame:
    """(key, change_point, beta1, beta2, se1, se2) for series with at least six points: the
    least-squares continuous two-piece line.

    The residual sum has one smooth piece between neighbouring points. Where the separate lines of
    the points left and right of a gap cross inside the gap, the crossing is that piece's best
    break; otherwise the best lies at an interior point. All of these are tried. Errors come from
    the fit linearised at the break, with four terms; one that cannot be computed is infinite.
    A series has one row per period, so joining it with its own breaks stays small.
    """
    fits = df.sparkSession.sql(BREAK_FIT, points=_points(df, key, x, y), least=6)
    return fits.withColumnRenamed("k", key)


def classified_trends(
    df: DataFrame,
    key: str = "drug",
    x: str = "year",
    y: str = "cos",
    alpha: float = 0.05,
) -> DataFrame:
    """Five-way trend class with global and per-segment slopes, p values and half-widths.

    Both segments significant: their signs decide (I-D, D-I, Increase, Decrease). One: its sign.
    None, or no break fit: the global slope, unless its p exceeds alpha. Up to three points: None.
    """
    span = series_span(df, key, x, y)
    line = ols_trend(df, key, x, y).drop("n")
    broken = break_trends(df, key, x, y)
    joined = span.join(line, key, "left").join(broken, key, "left")
    enough = F.col("n") > 3
    fitted = F.col("change_point").isNotNull()
    joined = joined.withColumns(
        {
            "beta": F.when(enough, F.col("beta")),
            "p": F.when(enough, F.col("p")),
            "w": F.when(enough, F.col("se_beta") * student.critical_value(alpha, "n - 2")),
            "t1": ratio("beta1", "se1"),
            "t2": ratio("beta2", "se2"),
            "critical": F.when(fitted, student.critical_value(alpha, "n - 4")),
        }
    ).withColumns(
        {
            "p1": student.two_sided_p("t1", "n - 4"),
            "p2": student.two_sided_p("t2", "n - 4"),
            "w1": F.col("se1") * F.col("critical"),
            "w2": F.col("se2") * F.col("critical"),
        }
    )
    overall = (
        F.when(~enough | F.col("p").isNull() | (F.col("p") > alpha), "None")
        .when(F.col("beta") > 0, "Increase")
        .otherwise("Decrease")
    )
    sig1, sig2 = F.col("p1") < alpha, F.col("p2") < alpha
    up1, up2 = F.col("beta1") > 0, F.col("beta2") > 0
    down1, down2 = F.col("beta1") < 0, F.col("beta2") < 0
    kind = (
        F.when(
            fitted & sig1 & sig2,
            F.when(up1 & down2, "I-D")
            .when(down1 & up2, "D-I")
            .when(up1 & up2, "Increase")
            .when(down1 & down2, "Decrease")
            .otherwise("None"),
        )
        .when(fitted & sig1, F.when(up1, "Increase").otherwise("Decrease"))
        .when(fitted & sig2, F.when(up2, "Increase").otherwise("Decrease"))
        .otherwise(overall)
    )
    return joined.withColumn("type", kind).select(
        key, "type", "change_point", "n", "start", "end",
        "beta", "beta1", "beta2", "p", "p1", "p2", "w", "w1", "w2",
    )


def compare_trends(line: DataFrame, classes: DataFrame, key: str = "drug") -> DataFrame:
    """Linear and classified results side by side, joined on the series only."""
    renamed = line.withColumnsRenamed({c: f"{c}_lm" for c in line.columns if c != key})
    return classes.join(renamed, key)


def export_trends(dimension: DataFrame, trends: DataFrame, key: str = "drug") -> DataFrame:
    """Every listed drug and every trend, matched where both exist."""
    return dimension.join(trends, key, "full")


def linear_smooth(df: DataFrame, key: str = "drug", x: str = "year", y: str = "cos") -> DataFrame:
    """Fitted straight line at the observed years."""
    group = W.partitionBy(key)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .withColumn("_slope", F.regr_slope(b, a).over(group))
        .withColumn("_base", F.regr_intercept(b, a).over(group))
        .withColumn("smooth", F.col("_base") + F.col("_slope") * a)
        .drop("_slope", "_base")
    )


LOCAL_FIT = """
    with pairs as (
      select a.k, a.x, a.y as own, b.x - a.x as dx, abs(b.x - a.x) as gap, b.y,
        count(*) over w as n, row_number() over near as place, rank() over near - 1 as closer
      from {points} a join {points} b on a.k = b.k
      window w as (partition by a.k, a.x, a.y), near as (partition by a.k, a.x, a.y order by abs(b.x - a.x))),
    reaches as (
      select *, coalesce(
        min(if(place >= greatest(floor({span} * n + 1e-9), least(n, 4)) and closer >= 3, gap, null)) over w,
        2 * greatest(max(gap) over w, 1e-300)) as reach
      from pairs window w as (partition by k, x, own)),
    weighed as (select *, pow(greatest(0D, 1 - pow(gap / reach, 3)), 3) as w from reaches),
    sums as (
      select k, x, own, sum(w) as a, sum(w * dx) as b, sum(w * dx * dx) as c, sum(w * pow(dx, 3)) as d,
        sum(w * pow(dx, 4)) as e, sum(w * y) as t0, sum(w * dx * y) as t1, sum(w * dx * dx * y) as t2
      from weighed group by k, x, own)
    select k, x, own, coalesce(try_divide(
        t0 * (c * e - d * d) - b * (t1 * e - d * t2) + c * (t1 * d - c * t2),
        a * (c * e - d * d) - b * (b * e - d * c) + c * (b * d - c * c)), t0 / a) as smooth
    from sums"""


def local_smooth(df: DataFrame, key: str, x: str, y: str, span: float = 0.75) -> DataFrame:
    """Local quadratic fit at each point with tricube weights on the nearest points.

    The reach is the distance of the last of the nearest points; it widens until three points
    carry weight, as the fit needs. Where they do not fix a curve, their weighted mean stands.
    """
    kinds = dict(df.dtypes)
    points = stage(_points(df, key, x, y), "points")
    fits = df.sparkSession.sql(LOCAL_FIT, points=points, span=span)
    return fits.select(
        F.col("k").alias(key), F.col("x").cast(kinds[x]).alias(x), F.col("own").cast(kinds[y]).alias(y), "smooth"
    )


def smooth_series(
    df: DataFrame,
    key: str = "drug",
    x: str = "year",
    y: str = "cos",
    least_local: int = 4,
) -> DataFrame:
    """Local quadratic smooth for series with at least `least_local` points, else a line.

    A series has one row per period, so pairing its points stays small.
    """
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y)
    sized = complete.withColumn("_n", F.count("*").over(W.partitionBy(key)))
    local = local_smooth(sized.where(F.col("_n") >= least_local).drop("_n"), key, x, y)
    line = linear_smooth(sized.where(F.col("_n") < least_local).drop("_n"), key, x, y)
    return local.withColumn("method", F.lit("loess")).unionByName(line.withColumn("method", F.lit("lm")))
