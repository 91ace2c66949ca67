"""ROC curves and quality at fixed specificity for scores against labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from longspan.operators.joins import null_safe_join
from longspan.operators.ranking import quantiles, running_sums
from longspan.sources.stages import stage

CUTOFFS = [0.97, 0.95, 0.90, 0.80]


def score_groups(df: DataFrame, method: str = "method", label: str = "y", score: str = "score"):
    """Cases and controls per distinct score; what follows works on distinct scores only."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(F.col(method).alias("method"), F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum(1 - F.col(label).cast("bigint")).alias("neg"),
    )


def orient(df: DataFrame, method: str = "method", label: str = "y", score: str = "score"):
    """Turn scores round where the controls' median exceeds the cases'; adds `flipped`."""
    medians = quantiles(
        df.where(F.col(label).isNotNull()).withColumn(
            "_group", F.concat_ws("|", F.col(method), F.col(label).cast("string"))
        ),
        ["_group"], score, [0.5],
    ).select(
        F.split_part("_group", F.lit("|"), F.lit(1)).alias(method),
        F.split_part("_group", F.lit("|"), F.lit(2)).alias("_label"),
        F.col("quantiles")[0].alias("_median"),
    )
    # One row per method.
    turn = medians.groupBy(method).agg(
        (
            F.max(F.when(F.col("_label") == "0", F.col("_median")))
            > F.max(F.when(F.col("_label") == "1", F.col("_median")))
        ).alias("flipped")
    )
    return df.join(F.broadcast(turn), method).withColumn(
        score, F.when(F.col("flipped"), -F.col(score)).otherwise(F.col(score))
    )


def ranked_groups(df: DataFrame, **names) -> DataFrame:
    return running_sums(score_groups(df, **names), ["method"], "score", ["pos", "neg"])


def roc_curve(df: DataFrame, **names) -> DataFrame:
    """(method, threshold, sensitivity, specificity) with the counts behind them.

    Thresholds are minus infinity, the midpoints between distinct scores, and plus infinity; a
    score at or above the threshold counts as positive.
    """
    return roc_rows(ranked_groups(df, **names))


def roc_rows(ranked: DataFrame) -> DataFrame:
    infinity = F.lit(float("inf"))
    midpoint = (F.col("score") + F.col("next_score")) / 2
    above = F.struct(
        F.coalesce(midpoint, infinity).alias("threshold"),
        (F.col("pos_total") - F.col("pos_before") - F.col("pos")).alias("tp"),
        (F.col("neg_total") - F.col("neg_before") - F.col("neg")).alias("fp"),
    )
    start = F.struct(
        (-infinity).alias("threshold"),
        F.col("pos_total").alias("tp"),
        F.col("neg_total").alias("fp"),
    )
    # The lowest score also stands for the threshold below all scores.
    lowest = (F.col("pos_before") == 0) & (F.col("neg_before") == 0)
    points = F.when(lowest, F.array(start, above)).otherwise(F.array(above))
    none = F.lit(0)
    return ranked.select(
        "method",
        F.inline(points),
        F.col("pos_total").alias("n_pos"),
        F.col("neg_total").alias("n_neg"),
    ).select(
        "method",
        "threshold",
        (F.col("tp") / F.nullif(F.col("n_pos"), none)).alias("sensitivity"),
        ((F.col("n_neg") - F.col("fp")) / F.nullif(F.col("n_neg"), none)).alias("specificity"),
        "tp", "fp", "n_pos", "n_neg",
    )


def area_metrics(df: DataFrame, **names) -> DataFrame:
    """(method, auroc, auprc): rank-sum area with ties at half, and average precision."""
    return area_rows(ranked_groups(df, **names))


def area_rows(ranked: DataFrame) -> DataFrame:
    at_or_above_pos = F.col("pos_total") - F.col("pos_before")
    at_or_above = at_or_above_pos + F.col("neg_total") - F.col("neg_before")
    # In double, as products of counts pass what a bigint holds.
    wins = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2)
    pairs = F.max(F.col("pos_total").cast("double") * F.col("neg_total"))
    return ranked.groupBy("method").agg(
        (F.sum(wins) / F.nullif(pairs, F.lit(0.0))).alias("auroc"),
        F.sum(
            F.try_divide(F.col("pos"), F.col("pos_total")) * at_or_above_pos / at_or_above
        ).alias("auprc"),
    )


def cut_points(df: DataFrame, cutoffs: Sequence[float] = CUTOFFS, **names) -> DataFrame:
    """Per method and target specificity the ROC row nearest to it; the lowest threshold on ties."""
    return cut_rows(ranked_groups(df, **names), cutoffs)


def cut_rows(ranked: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    rows = roc_rows(ranked).withColumn(
        "cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs]))
    )
    best = rows.groupBy("method", "cutoff").agg(
        F.min(
            F.struct(
                F.abs(F.col("specificity") - F.col("cutoff")).alias("gap"),
                "threshold", "sensitivity", "specificity", "tp", "fp", "n_pos", "n_neg",
            )
        ).alias("b")
    )
    return best.select("method", "cutoff", "b.*").drop("gap")


def metrics_at_specificity(
    df: DataFrame, cutoffs: Sequence[float] = CUTOFFS, **names
) -> DataFrame:
    """(method, cutoff, threshold, specificity, sensitivity, ppv, npv, auroc, auprc).

    The ranked distinct scores are written once; areas and cuts both read them.
    """
    ranked = stage(ranked_groups(df, **names), "ranked")
    tn = F.col("n_neg") - F.col("fp")
    missed = F.col("n_pos") - F.col("tp")
    none = F.lit(0)
    cuts = cut_rows(ranked, cutoffs).withColumns(
        {
            "ppv": F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), none),
            "npv": tn / F.nullif(tn + missed, none),
        }
    )
    # One row per method.
    return cuts.join(F.broadcast(area_rows(ranked)), "method").select(
        "method", "cutoff", "threshold", "specificity", "sensitivity", "ppv", "npv",
        "auroc", "auprc",
    )


def side_by_side(metrics: DataFrame, first: float, second: float) -> DataFrame:
    """Two cutoffs' metrics per method in one row, columns suffixed with the percentage."""
    kept = ["sensitivity", "ppv", "npv"]

    def one(cutoff: float) -> DataFrame:
        tag = f"_{round(cutoff * 100)}"
        return metrics.where(F.col("cutoff") == cutoff).select(
            "method", "auroc", "auprc", *[F.col(c).alias(c + tag) for c in kept]
        )

    right = one(second).drop("auroc", "auprc")
    return one(first).join(right, "method")


def transposed(wide: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Metrics as rows and the listed methods as columns; `wide` has one row per method."""
    metrics = [c for c in wide.columns if c != "method"]
    return (
        wide.unpivot("method", metrics, "metric", "value")
        .groupBy("metric")
        .pivot("method", list(methods))
        .agg(F.first("value"))
    )


def phenotype_list(
    patients: DataFrame, scored: DataFrame, cuts: DataFrame, method: str,
    cutoffs: Sequence[float] = (0.90, 0.95),
) -> DataFrame:
    """All patients; a prediction per cutoff where a score exists.

    `patients(patient_num, is_labeled, is_case, is_registry)`; `scored` has the first three and
    `score`. The label is nullable, so the join matches null to null.
    """
    out = scored
    for cutoff in cutoffs:
        # One row.
        cut = cuts.where((F.col("method") == method) & (F.col("cutoff") == cutoff)).select(
            "threshold"
        )
        above = (F.col("score") > cut.scalar()).cast("int")
        out = out.withColumn(f"pred_{round(cutoff * 100)}", above)
    return null_safe_join(
        patients, out.drop("score"), ["patient_num", "is_labeled", "is_case"], "left"
    )


def poisson_steps() -> list[float]:
    """Distribution function of a Poisson(1) count at 0, 1, ... up to where it is 1 in double."""
    steps, term, total = [], math.exp(-1), 0.0
    while total + term > total:
        total += term
        steps.append(total)
        term /= len(steps)
    return steps


def resampled_groups(
    df: DataFrame, key: str, sums: dict[str, Column], rounds: int, seed: int, method: str, score: str
) -> DataFrame:
    """(method, round, score, *sums) with hashed Poisson(1) weights; round 0 has the rows as they are.

    A row's weight in a round comes from the md5 of its key, the round and the seed, so resamples
    repeat under any partitioning and in any engine. All rounds of a distinct score are summed side
    by side before the shuffle, so a row is read once and not copied for each round.
    """
    steps = F.array(*[F.lit(s) for s in poisson_steps()])

    def weight(draw: Column) -> Column:
        code = F.md5(F.concat_ws(":", F.col(key).cast("string"), draw, F.lit(seed)).cast("binary"))
        unit = F.conv(F.substring(code, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
        return F.when(draw == 0, 1).otherwise(F.size(F.filter(steps, lambda s: s <= unit)))

    weighed = df.where(F.col(score).isNotNull()).select(
        F.col(method).alias("method"), F.col(score).alias("score"),
        *[value.cast("bigint").alias(name) for name, value in sums.items()],
        F.transform(F.sequence(F.lit(0), F.lit(rounds)), weight).alias("_w"),
    )
    each = F.array(
        *[
            F.struct(*[F.sum(F.col("_w")[k] * F.col(name)).alias(name) for name in sums])
            for k in range(rounds + 1)
        ]
    )
    side = weighed.groupBy("method", "score").agg(each.alias("_rounds"))
    return side.select("method", "score", F.posexplode("_rounds").alias("round", "_s")).select(
        "method", "round", "score", *[F.col(f"_s.{name}").alias(name) for name in sums]
    )


def bootstrap_areas(
    df: DataFrame, key: str, rounds: int = 50, seed: int = 11, **names
) -> DataFrame:
    """Mean and spread of AUROC over resamples of cases and controls."""
    method, label, score = (
        names.get(k, d) for k, d in (("method", "method"), ("label", "y"), ("score", "score"))
    )
    known = df.where(F.col(label).isNotNull())
    sums = {"pos": F.col(label), "neg": 1 - F.col(label)}
    groups = resampled_groups(known, key, sums, rounds, seed, method, score)
    drawn = groups.where("round > 0 and pos + neg > 0").withColumn(
        "method", F.concat_ws("|", "method", F.col("round").cast("string"))
    )
    return (
        area_rows(running_sums(drawn, ["method"], "score", ["pos", "neg"]))
        .withColumn("method", F.split_part("method", F.lit("|"), F.lit(1)))
        .groupBy("method")
        .agg(F.avg("auroc").alias("auroc_mean"), F.stddev_samp("auroc").alias("auroc_sd"))
    )


CASE_METRICS = ["auroc", "fpr", "sensitivity", "ppv", "f_score"]


def case_only_evaluation(
    df: DataFrame, key: str, known: Column, top: float = 0.2, least_share: float = 0.1,
    rounds: int = 50, seed: int = 11, method: str = "method", score: str = "score",
) -> DataFrame:
    """(method, metric, estimate, mean, sd, low, high): quality where only some cases are known.

    `known` marks sure cases; the other rows are cases and controls nobody has looked at. The score's
    distribution over all rows is then a mixture, with the known cases' one as the cases' part. The
    cases' share is the least ratio of the two tails, over tails with `least_share` of the known
    cases; the controls' distribution is what is left, which gives the area, and at the cut that
    `top` of all rows pass the false positive rate, sensitivity, precision and F-score. Means,
    spreads and 95% percentile intervals are over resamples of the rows.
    """
    cuts = quantiles(df.where(F.col(score).isNotNull()), [method], score, [1 - top]).select(
        F.col(method).alias("method"), F.col("quantiles")[0].alias("cut")
    )
    sums = {"n_all": F.lit(1), "n_known": F.coalesce(known, F.lit(False)).cast("int")}
    groups = resampled_groups(df, key, sums, rounds, seed, method, score).where("n_all > 0")
    # One row per method.
    ranked = running_sums(groups, ["method", "round"], "score", list(sums)).join(F.broadcast(cuts), "method")
    zero = F.lit(0.0)
    cases, everyone = (F.nullif(F.col(f"{n}_total").cast("double"), zero) for n in ("n_known", "n_all"))
    tail = (F.col("n_known_total") - F.col("n_known_before")) / cases
    whole_tail = (F.col("n_all_total") - F.col("n_all_before")) / everyone
    above = F.col("score") > F.col("cut")
    measured = ranked.groupBy("method", "round").agg(
        F.min(F.when(tail >= least_share, whole_tail / tail)).alias("p"),
        F.sum(F.col("n_known") * (F.col("n_all_before") + F.col("n_all") / 2) / cases / everyone).alias("wins"),
        F.sum(F.when(above, F.col("n_known")).otherwise(0) / cases).alias("sensitivity"),
        F.sum(F.when(above, F.col("n_all")).otherwise(0) / everyone).alias("rate"),
    )

    def within(value: Column) -> Column:
        """Cut to 0 and 1; no value stays none."""
        return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(1.0)), zero))

    p, sens, rate = within(F.col("p")), F.col("sensitivity"), F.col("rate")
    controls = F.nullif(1 - p, zero)
    metrics = measured.withColumns(
        {
            "auroc": (F.col("wins") - p / 2) / controls,
            "fpr": within((rate - p * sens) / controls),
            "ppv": within(p * sens / F.nullif(rate, zero)),
        }
    ).withColumn("f_score", 2 * F.col("ppv") * sens / F.nullif(F.col("ppv") + sens, zero))
    long = metrics.unpivot(["method", "round"], CASE_METRICS, "metric", "value")
    drawn = F.when(F.col("round") > 0, F.col("value"))
    ends = F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975)))
    # Rounds are few, so a group has as many rows as rounds.
    return long.groupBy("method", "metric").agg(
        F.max(F.when(F.col("round") == 0, F.col("value"))).alias("estimate"),
        F.avg(drawn).alias("mean"), F.stddev_samp(drawn).alias("sd"), ends[0].alias("low"), ends[1].alias("high"),
    )
