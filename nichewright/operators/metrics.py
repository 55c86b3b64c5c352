"""Scores of a labelling over a distance relation, as DataFrame aggregates.

``distance`` is (i, j, cost) in both directions without the diagonal; ``labels`` is (row_idx, niche).  Several labellings can be scored in
one job by columns ``by`` that both relations of a call share through ``labels``.  Scores that the labelling doesn't allow are null.

Cases: ids are unique within a labelling; distances of rows without a label are left out; singletons score 0; ties go by id; an empty
table gives no row, or nulls where a score is one row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichewright.config import METRICS, metric_names

__all__ = ["METRICS", "assignment_score", "calinski_harabasz", "davies_bouldin", "labelled", "medoids", "metric_names", "minimum_dunn", "percentile_dunn", "rank_ensemble", "scores", "silhouette", "size_summary", "within_between"]


def labelled(distance: DataFrame, labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, cost, li, lj)."""
    of = lambda c: labels.select(*by, F.col("row_idx").alias(c), F.col("niche").alias(f"l{c}"))
    return distance.join(of("i"), "i").join(of("j"), [*by, "j"]).select(*by, "i", "j", "cost", "li", "lj")


def _means(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, i, li, own, other): mean distance to the own niche (null for a singleton) and the least one to another."""
    # Sums by niche (i, li, lj, total, n) can be given in place of pairs.
    to = pairs.withColumn("mean", F.col("total") / F.col("n")) if "total" in pairs.columns else pairs.groupBy(*by, "i", "li", "lj").agg(F.avg("cost").alias("mean"))
    return to.groupBy(*by, "i", "li").agg(F.max(F.when(F.col("li") == F.col("lj"), F.col("mean"))).alias("own"), F.min(F.when(F.col("li") != F.col("lj"), F.col("mean"))).alias("other"))


def assignment_score(distance: DataFrame | None, labels: DataFrame, by: tuple[str, ...] = (), sums: DataFrame | None = None) -> DataFrame:
    """(by, row_idx, niche, score): (other - own) / other within [0, 1]; 0 for a singleton, 1 if there is one niche only.

    ``sums`` (by, i, li, lj, total, n), as ``tiles.niche_sums`` makes them, take the place of ``distance``.
    """
    score = F.when(F.col("other").isNull(), F.lit(1.0)).when(F.col("own").isNull(), F.lit(0.0)).otherwise(F.least(F.greatest((F.col("other") - F.col("own")) / F.greatest("other", F.lit(1e-8)), F.lit(0.0)), F.lit(1.0)))
    scored = _means(labelled(distance, labels, by) if sums is None else sums, by).select(*by, F.col("i").alias("row_idx"), score.alias("score"))
    return labels.join(scored, [*by, "row_idx"], "left").select(*by, "row_idx", "niche", F.coalesce("score", F.lit(1.0)).alias("score"))


def silhouette(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, silhouette): the mean over rows of (b - a) / max(a, b), 0 for singletons."""
    value = F.when(F.col("own").isNull() | (F.greatest("own", "other") == 0), F.lit(0.0)).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return _means(pairs, by).groupBy(*by).agg(F.avg(F.when(F.col("other").isNotNull(), value)).alias("silhouette"))


def medoids(distance: DataFrame | None, labels: DataFrame, by: tuple[str, ...] = (), sums: DataFrame | None = None) -> DataFrame:
    """(by, niche, medoid, size): the member with the least sum of distances within its niche; ties go by id.

    ``sums`` (by, i, li, lj, total, n), as ``tiles.niche_sums`` makes them, take the place of ``distance``.
    """
    if sums is None:
        inner = labelled(distance, labels, by).where("li = lj").groupBy(*by, "i").agg(F.sum("cost").alias("total"))
    else:
        inner = sums.where("li = lj").select(*by, "i", "total")
    rows = labels.join(inner.withColumnRenamed("i", "row_idx"), [*by, "row_idx"], "left")
    return rows.groupBy(*by, "niche").agg(F.min(F.struct(F.coalesce("total", F.lit(0.0)).alias("total"), "row_idx"))["row_idx"].alias("medoid"), F.count("*").alias("size"))


def _sizes(labels: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return labels.groupBy(*by, "niche").agg(F.count("*").alias("size"))


def calinski_harabasz(pairs: DataFrame, labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, calinski_harabasz) from squared distances: total / 2n against the sum over niches of inner / 2n_c.

    Sums by niche (i, li, lj, squares), as ``tiles.niche_sums`` makes them, can be given in place of pairs.
    """
    square = F.col("squares") if "squares" in pairs.columns else F.col("cost") * F.col("cost")
    sizes = _sizes(labels, by)
    inner = pairs.where("li = lj").groupBy(*by, F.col("li").alias("niche")).agg(F.sum(square).alias("inner"))
    per = sizes.join(inner, [*by, "niche"], "left").groupBy(*by).agg(F.sum(F.coalesce("inner", F.lit(0.0)) / (2 * F.col("size"))).alias("within"), F.sum("size").alias("_n"), F.count("*").alias("_k"))
    total = pairs.groupBy(*by).agg(F.sum(square).alias("all"))
    both = per.join(total, list(by)) if by else per.join(total)
    between = F.greatest(F.col("all") / (2 * F.col("_n")) - F.col("within"), F.lit(0.0))
    score = (between / (F.col("_k") - 1)) / F.greatest(F.col("within") / (F.col("_n") - F.col("_k")), F.lit(1e-12))
    return both.select(*by, F.when((F.col("_k") > 1) & (F.col("_k") < F.col("_n")), score).alias("calinski_harabasz"))


def davies_bouldin(distance: DataFrame, labels: DataFrame, by: tuple[str, ...] = (), centre: DataFrame | None = None) -> DataFrame:
    """(by, davies_bouldin): minus the mean over niches of the worst (s_a + s_b) / d(medoids), s the mean distance to the medoid.

    Medoids that coincide make the ratio infinite and so the score minus infinity.  Where ``medoids`` are given as ``centre``, only the
    distances to them are asked for.
    """
    centre = medoids(distance, labels, by) if centre is None else centre
    to = labels.join(centre, [*by, "niche"]).select(*by, "niche", "size", F.col("row_idx").alias("i"), F.col("medoid").alias("j"))
    spread = to.join(distance, ["i", "j"], "left").groupBy(*by, "niche").agg((F.sum(F.coalesce("cost", F.lit(0.0))) / F.max("size")).alias("s"))
    at = centre.join(spread, [*by, "niche"])
    a, b = (at.select(*by, F.col("niche").alias(f"n{c}"), F.col("medoid").alias(c), F.col("s").alias(f"s{c}")) for c in ("i", "j"))
    apart = a.join(distance, "i").join(b, [*by, "j"])
    ratio = F.when(F.col("cost") <= 1e-12, F.lit(float("inf"))).otherwise((F.col("si") + F.col("sj")) / F.greatest("cost", F.lit(1e-300)))
    return apart.groupBy(*by, "ni").agg(F.max(ratio).alias("worst")).groupBy(*by).agg((-F.avg("worst")).alias("davies_bouldin"))


def percentile_dunn(pairs: DataFrame, by: tuple[str, ...] = (), inter: float = 0.05, intra: float = 0.95) -> DataFrame:
    """(by, percentile_dunn): the low percentile of distances between niches over the high one within; exact percentiles."""
    half = pairs.where("i < j")
    return half.groupBy(*by).agg((F.percentile(F.when(F.col("li") != F.col("lj"), F.col("cost")), inter) / F.greatest(F.percentile(F.when(F.col("li") == F.col("lj"), F.col("cost")), intra), F.lit(1e-12))).alias("percentile_dunn"))


def minimum_dunn(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, minimum_dunn): the least distance between niches over the largest within, at least 1e-12."""
    inner = F.coalesce(F.max(F.when(F.col("li") == F.col("lj"), F.col("cost"))), F.lit(0.0))
    return pairs.groupBy(*by).agg((F.min(F.when(F.col("li") != F.col("lj"), F.col("cost"))) / F.greatest(inner, F.lit(1e-12))).alias("minimum_dunn"))


def within_between(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ratio): mean finite distance within niches over the mean finite and positive one between them; null without either."""
    finite = ~F.isnan("cost") & (F.abs("cost") < float("inf"))
    within = F.avg(F.when(finite & (F.col("li") == F.col("lj")), F.col("cost")))
    between = F.avg(F.when(finite & (F.col("li") != F.col("lj")) & (F.col("cost") > 0), F.col("cost")))
    return pairs.groupBy(*by).agg(F.when(between.isNotNull(), within / F.greatest(between, F.lit(1e-12))).alias("ratio"))


def size_summary(labels: DataFrame) -> DataFrame:
    """One row (niches, least, largest, singletons, small, threshold); small niches have fewer than max(2, ceil(0.005 n)) rows."""
    sizes = _sizes(labels, ())
    n = labels.count()
    threshold = max(2, -(-n * 5 // 1000))
    return sizes.agg(F.count("*").alias("niches"), F.min("size").alias("least"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("singletons"), F.count_if(F.col("size") < threshold).alias("small")).withColumn("threshold", F.lit(threshold))


def scores(distance: DataFrame, labels: DataFrame, names: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """(by, one column a metric) for every labelling."""
    pairs = labelled(distance, labels, by)
    make = {
        "silhouette": lambda: silhouette(pairs, by),
        "calinski_harabasz": lambda: calinski_harabasz(pairs, labels, by),
        "davies_bouldin": lambda: davies_bouldin(distance, labels, by),
        "percentile_dunn": lambda: percentile_dunn(pairs, by),
        "minimum_dunn": lambda: minimum_dunn(pairs, by),
    }
    out = labels.select(*by).distinct()
    for name in names:
        out = out.join(make[name](), list(by), "left")
    return out


def rank_ensemble(table: DataFrame, names: tuple[str, ...], tie: str) -> DataFrame:
    """The table with rank_<metric>, mean_rank and best: ranks by score, null and NaN last, ties by the ``tie`` column."""
    value: dict[str, Column] = {n: F.when(F.isnan(n), None).otherwise(F.col(n)) for n in names}
    ranked = table.withColumns({f"rank_{n}": F.row_number().over(Window.orderBy(c.desc_nulls_last(), tie)) for n, c in value.items()})
    ranked = ranked.withColumn("mean_rank", sum((F.col(f"rank_{n}") for n in names), F.lit(0)) / len(names))
    return ranked.withColumn("best", F.row_number().over(Window.orderBy("mean_rank", tie)) == 1)
