"""Balance, dominance, lexical diversity and rank statistics over prompts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions import text as T

CATEGORY = ("dominio", "categoria")


def structure_summary(df: DataFrame) -> DataFrame:
    """Prompts and distinct categories by domain."""
    return df.groupBy("dominio").agg(F.count("*").alias("n_prompt"), F.countDistinct("categoria").alias("n_categorie"))


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*CATEGORY).agg(F.count("*").alias("n_prompt")).orderBy("dominio", F.desc("n_prompt"))


def balance(df: DataFrame) -> DataFrame:
    """Spread of the categories' counts by domain; sd and cv are null for a single category."""
    n = F.col("n_prompt")
    out = df.groupBy(*CATEGORY).agg(F.count("*").alias("n_prompt")).groupBy("dominio").agg(F.avg(n).alias("media"), F.stddev_samp(n).alias("sd"), F.min(n).alias("min"), F.max(n).alias("max"))
    return out.select("dominio", "media", "sd", (F.col("sd") / F.col("media")).alias("cv"), "min", "max")


def prompts_per_domain(df: DataFrame) -> DataFrame:
    return df.groupBy("dominio").agg(F.count("*").alias("n_prompt")).orderBy(F.desc("n_prompt"))


def entity_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*CATEGORY, "entita").agg(F.count("*").alias("n_prompt_entita"))


def entity_imbalance(counts: DataFrame) -> DataFrame:
    """Prompts for each entity by category; the most uneven first, single entities last."""
    n = F.col("n_prompt_entita")
    out = counts.groupBy(*CATEGORY).agg(F.count("*").alias("n_entita"), F.avg(n).alias("media_prompt_per_entita"), F.stddev_samp(n).alias("sd_prompt_per_entita"), F.max(n).alias("max_prompt_singola_entita"))
    out = out.withColumn("cv_entita", F.col("sd_prompt_per_entita") / F.col("media_prompt_per_entita"))
    return out.select(*CATEGORY, "n_entita", "media_prompt_per_entita", "sd_prompt_per_entita", "cv_entita", "max_prompt_singola_entita").orderBy(F.desc_nulls_last("cv_entita"))


def dominant_entities(counts: DataFrame) -> DataFrame:
    """Each category's largest entities, ties kept, with their share of the category."""
    group = Window.partitionBy(*CATEGORY)
    n = F.col("n_prompt_entita")
    out = counts.withColumns({"totale_categoria": F.sum(n).over(group), "top": F.max(n).over(group)}).where(n == F.col("top"))
    share = 100 * n / F.col("totale_categoria")
    return out.select(*CATEGORY, "entita", "n_prompt_entita", "totale_categoria", share.alias("percentuale_su_categoria")).orderBy(F.desc("percentuale_su_categoria"))


def dominance_over(dominant: DataFrame, percent: float = 10.0) -> DataFrame:
    return dominant.where(F.col("percentuale_su_categoria") > percent)


def type_token_ratio(df: DataFrame, groups: tuple[str, ...] = CATEGORY, column: str = "prompt") -> DataFrame:
    """Distinct over all lower-cased words between white space; null without words.

    Words are counted by (group, word) first, so a frequent word is one row to each task.
    """
    words = df.select(*groups, F.explode(F.split(F.lower(F.coalesce(F.col(column), F.lit("na"))), rf"{T.WHITE}+")).alias("w")).where("w <> ''")
    ratio = words.groupBy(*groups, "w").agg(F.count("*").alias("n")).groupBy(*groups).agg((F.count("*") / F.sum("n")).alias("ttr"))
    sizes = df.groupBy(*groups).agg(F.count("*").alias("n_prompt"))
    out = sizes.alias("s").join(ratio.alias("r"), [F.col(f"s.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups], "left")
    return out.select(*(F.col(f"s.{g}") for g in groups), "ttr", "n_prompt").orderBy(groups[0], "ttr")


def corpus_type_token_ratio(df: DataFrame, column: str = "prompt") -> DataFrame:
    words = df.select(F.explode(F.split(F.lower(F.coalesce(F.col(column), F.lit("na"))), rf"{T.WHITE}+")).alias("w")).where("w <> ''")
    return words.groupBy("w").agg(F.count("*").alias("n")).agg((F.count("*") / F.sum("n")).alias("ttr"))


# Rank statistics. Values are counted first: ranks then come from the distinct values' counts, so the
# sort is over distinct values, not rows.


def mid_ranks(df: DataFrame, value: str, group: str, within: tuple[str, ...] = ()) -> DataFrame:
    """For each (within, group, value): n rows, the mid-rank of the value and its tie count t."""
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*within, group, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ties = counts.groupBy(*within, "value").agg(F.sum("n").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*within).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ties.withColumn("rank", upto - (F.col("t") - 1) / F.lit(2.0))
    return counts.join(ranked, [*within, "value"])


def kruskal_wallis(df: DataFrame, value: str = "n_parole", group: str = "dominio") -> DataFrame:
    """H with tie correction and its degrees of freedom; h is null for one group or all ties."""
    ranked = mid_ranks(df, value, group)
    by_group = ranked.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    ties = ranked.groupBy("value").agg(F.first("t").alias("t")).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    total = by_group.agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count("*").alias("k"))
    one = total.crossJoin(F.broadcast(ties))  # one row each
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    return one.select(F.when(F.col("k") > 1, h).alias("h"), (F.col("k") - 1).alias("df"), F.col("n").alias("n"))


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) by the incomplete gamma function: a series below, a continued fraction above."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    lead = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return 1 - lead * total
    b, c = z + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return lead * h


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def kruskal_test(df: DataFrame, value: str = "n_parole", group: str = "dominio") -> dict[str, float]:
    row = kruskal_wallis(df, value, group).first()
    p = None if row.h is None else chi_square_tail(row.h, row.df)
    return {"h": row.h, "df": row.df, "p": p}


def pairwise_wilcoxon(df: DataFrame, value: str = "n_parole", group: str = "dominio") -> DataFrame:
    """Rank-sum tests of each pair of groups: normal approximation, ties and continuity corrected, Bonferroni.

    Group counts by value are joined with the pairs of groups; rows are not. Columns: group1 > group2,
    w (rank sum of group1 less its least), z, p (adjusted).
    """
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    names = counts.select("g").distinct()
    pairs = names.select(F.col("g").alias("group1")).join(names.select(F.col("g").alias("group2")), F.col("group1") > F.col("group2"))
    members = pairs.select("group1", "group2", F.explode(F.array("group1", "group2")).alias("g"))
    ranked = _ranked_pairs(members, counts)
    n1 = F.sum(F.when(F.col("g") == F.col("group1"), F.col("n")).otherwise(0))
    r1 = F.sum(F.when(F.col("g") == F.col("group1"), F.col("n") * F.col("rank")).otherwise(0.0))
    per = ranked.groupBy("group1", "group2").agg(n1.alias("n1"), F.sum("n").alias("n"), r1.alias("r1"))
    ties = ranked.select("group1", "group2", "value", "t").distinct().groupBy("group1", "group2").agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    x = per.join(ties, ["group1", "group2"])
    a, n = F.col("n1").cast("double"), F.col("n").cast("double")
    b = n - a
    w = F.col("r1") - a * (a + 1) / 2
    centred = w - a * b / 2
    sigma = F.sqrt(a * b / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (centred - F.signum(centred) * 0.5) / F.nullif(sigma, F.lit(0.0))
    out = x.select("group1", "group2", w.alias("w"), z.alias("z"))
    m = F.count("*").over(Window.partitionBy())  # as many rows as pairs of groups
    return out.withColumn("p", F.least(F.lit(1.0), 2 * _tail(F.abs("z")) * m))


def _ranked_pairs(members: DataFrame, counts: DataFrame) -> DataFrame:
    both = members.join(counts, "g")
    ties = both.groupBy("group1", "group2", "value").agg(F.sum("n").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("group1", "group2").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return both.join(ties.withColumn("rank", upto - (F.col("t") - 1) / F.lit(2.0)), ["group1", "group2", "value"])


def _tail(z: Column) -> Column:
    """The normal distribution's upper tail, to 1e-7 (Abramowitz and Stegun 7.1.26 on z / sqrt 2)."""
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x) / 2


def stable_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by a hash of their key: the same on every run and every cluster. n is the feature's limit."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def stratified_sample(df: DataFrame, strata: tuple[str, ...], n: int, key: str, seed: int = 42) -> DataFrame:
    """Up to n rows of each stratum by a hash of their key."""
    by = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)
    return df.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= n).drop("__r")


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """W and p for 3 to 5000 values, after Royston (1995)."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not 3 <= n <= 5000:
        raise ValueError("between 3 and 5000 values")
    if x[0] == x[-1]:
        raise ValueError("all values are equal")
    m = np.array([_inverse_normal((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c = m / np.sqrt(m @ m)
    u = 1 / math.sqrt(n)
    a = np.zeros(n)
    # Royston's polynomials in 1 / sqrt(n) for the outer weights
    last = c[-1] + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    if n == 3:
        a[:] = (-math.sqrt(0.5), 0, math.sqrt(0.5))
    elif n <= 5:
        phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0], a[-1] = -last, last
    else:
        second = c[-2] + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
        phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[0], a[1], a[-2], a[-1] = -last, -second, second, last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        k = math.log(n)
        mu = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3
        sigma = math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
    return w, normal_tail((y - mu) / sigma)


def _inverse_normal(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def normality_test(df: DataFrame, value: str = "n_parole", key: str = "ord", n: int = 5000) -> DataFrame:
    """Shapiro-Wilk over a stable sample of at most 5000 rows, the most that the test is defined for."""
    rows = stable_sample(df.where(F.col(value).isNotNull()), min(n, 5000), key).select(value).collect()
    w, p = shapiro_wilk([r[0] for r in rows])
    return df.sparkSession.createDataFrame([(len(rows), w, p)], "n long, w double, p double")


def qq_points(df: DataFrame, value: str = "n_parole") -> DataFrame:
    """Sorted values with the probability that a normal quantile plot sets them against, by distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    a = F.when(total <= 10, 3 / 8).otherwise(0.5)
    first, last = (upto - F.col("n") + 1 - a) / (total + 1 - 2 * a), (upto - a) / (total + 1 - 2 * a)
    return counts.select("value", "n", first.alias("p_first"), last.alias("p_last"))


# Plot data: what the figures of a report show.


def histogram(df: DataFrame, value: Column, groups: tuple[str, ...], bins: int = 40) -> DataFrame:
    """Counts in equal bins over all rows' range; bin is 0-based."""
    data = df.select(*groups, value.cast("double").alias("v")).where("v is not null")
    ends = data.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / width)).otherwise(F.lit(0)), F.lit(bins - 1))
    return data.crossJoin(F.broadcast(ends)).groupBy(*groups, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, value: str = "n_parole", group: str = "dominio") -> DataFrame:
    """Quartiles, whiskers and outliers of a box plot by group."""
    q = df.groupBy(group).agg(*(F.percentile(value, F.lit(p)).alias(a) for a, p in (("q1", 0.25), ("mediana", 0.5), ("q3", 0.75))))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - fence, F.col("q3") + fence)
    joined = df.select(group, value).join(q, group)
    return joined.groupBy(group, "q1", "mediana", "q3").agg(F.min(F.when(inside, F.col(value))).alias("baffo_inf"), F.max(F.when(inside, F.col(value))).alias("baffo_sup"), F.count_if(~inside).alias("n_outlier"))


def bars(counts: DataFrame, group: str = "dominio", label: str = "categoria", value: str = "n_prompt") -> DataFrame:
    """Bars in plotting order: place 1 is the shortest of its panel."""
    return counts.select(group, label, value, F.row_number().over(Window.partitionBy(group).orderBy(F.col(value), F.col(label))).alias("posizione"))


def token_histogram(df: DataFrame) -> DataFrame:
    """Generated tokens in bins of width 1 by model and domain, ok rows only."""
    return df.where("audit_status_ok").groupBy("model_key", "domain", F.round("generated_tokens").cast("long").alias("bin")).agg(F.count("*").alias("n"))


def han_rates(df: DataFrame) -> DataFrame:
    """Share of non-empty ok continuations with Han characters, by model and category."""
    some = df.where(F.col("audit_status_ok") & F.col("audit_has_text"))
    return some.groupBy("model_key", "domain", "category").agg(F.count("*").alias("n"), F.count_if("audit_has_han").alias("n_han"), (100 * F.count_if("audit_has_han") / F.count("*")).alias("pct_han"))
