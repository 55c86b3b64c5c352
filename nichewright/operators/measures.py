"""Local measures: weighted, capped neighborhoods with expression, relative position and radius as token components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichewright.config import ISOLATED, KERNELS, SCALES, canonical
from nichewright.functions.portable import least_drawn, squared_distance, uniform


def kernel_weight(distance: Column, radius: float, kernel: str) -> Column:
    name = canonical(kernel, KERNELS, "kernel")
    if name == "uniform":
        return F.lit(1.0)
    if name == "inverse":
        return F.lit(1.0) / F.greatest(distance, F.lit(1e-6))
    scaled = distance / F.lit(radius / 2)
    return F.exp(F.lit(-0.5) * scaled * scaled)


def state_labels(vectors: DataFrame, n_states: int, seed: int = 1337) -> DataFrame:
    """(row_idx, state) by k-means of (row_idx, z), for caps by state; all 0 for one state or fewer rows than two.

    Rows without a vector have no state and give no row.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = vectors.where(F.col("z").isNotNull())
    k = min(n_states, vectors.limit(n_states).count())
    if k < 2:
        return vectors.select("row_idx", F.lit(0).alias("state"))
    rows = vectors.select("row_idx", array_to_vector("z").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(rows).transform(rows).select("row_idx", F.col("prediction").alias("state"))


def cap_neighbors(edges: DataFrame, radius: float, most: int, shells: int = 4, seed: int = 1337, by_state: bool = True) -> DataFrame:
    """At most ``most`` edges a row, drawn so that distance shells (and the neighbor's ``state``) stay represented.

    Edges are (row_idx, neighbor, distance, weight[, state]).  Only rows with more edges are thinned.  Their strata are drawn by mass
    without replacement if there are more than ``most``, else all are taken; each taken stratum gives one edge by weight, and
    further ones are drawn by weight from all that are left.  A draw by weight is a race: the least -ln(u) / weight wins, with u
    from a portable hash of (seed, row, neighbor), so the outcome doesn't depend on partitions or order.

    Dense neighborhoods don't travel whole: the strata's sums and best draws are combined before the shuffle, and of the draws of a row
    each task sends its ``most`` best (Spark pushes a limit on ``row_number`` below the shuffle).

    Further columns of any name and type stay; a null state is 0; an edge that is repeated is one draw; an empty table gives none.
    """
    if most < 1 or shells < 1:
        raise ValueError("most and shells must be positive")
    shell = F.floor(F.least(F.greatest(F.col("distance") / radius, F.lit(0.0)), F.lit(0.999999)) * shells)
    state = F.coalesce(F.col("state"), F.lit(0)) if by_state and "state" in edges.columns else F.lit(0)
    race = lambda u, w: -F.ln(u) / F.greatest(w, F.lit(1e-300))
    drawn = edges.select(
        "row_idx",
        F.struct(shell.cast("long").alias("shell"), state.cast("long").alias("state")).alias("stratum"),
        "weight",
        F.struct(race(uniform(seed, F.col("row_idx"), F.col("neighbor")), F.col("weight")).alias("key"), "neighbor").alias("draw"),
        F.struct(*edges.columns).alias("edge"),
    )
    row = Window.partitionBy("row_idx")
    # What a row needs of its edges: the mass and the best draw of each stratum, and the ``most`` best draws of all.
    strata = drawn.groupBy("row_idx", "stratum").agg(F.sum("weight").alias("mass"), F.min("draw").alias("draw"), F.min_by("edge", "draw").alias("edge"))
    number = F.col("stratum.shell") * 100_000 + F.col("stratum.state")
    ranked = strata.withColumn("rank", F.row_number().over(row.orderBy(race(uniform(seed + 1, F.col("row_idx"), number), F.col("mass")), "stratum")))
    chosen = ranked.where(F.col("rank") <= most).select("row_idx", F.lit(0).alias("turn"), "draw", "edge")
    first = drawn.withColumn("place", F.row_number().over(row.orderBy("draw"))).where(F.col("place") <= most)
    both = chosen.unionByName(first.select("row_idx", F.lit(1).alias("turn"), "draw", "edge"))
    once = both.groupBy("row_idx", "draw").agg(F.min("turn").alias("turn"), F.min_by("edge", "turn").alias("edge"))
    kept = once.withColumn("pick", F.row_number().over(row.orderBy("turn", "draw"))).where(F.col("pick") <= most)
    return kept.select(*(F.col("edge").getField(c).alias(c) for c in edges.columns))


def assemble(cells: DataFrame, edges: DataFrame, include_anchor: bool = True, isolated: str = "anchor_fallback", uniform_fallback: bool = False) -> DataFrame:
    """(row_idx, neighbor, distance, weight, mass): the support of every cell with weights that sum to 1.

    The anchor joins its own support with weight 1 if asked for.  A cell without support gets itself (``anchor_fallback``) or a dummy
    with neighbor -1 (``zero_dummy``); ``error`` raises when such a cell is met.  With ``uniform_fallback`` a support whose weights sum to
    nothing positive and finite has equal masses; without it they are divided by 1e-12 at least.
    """
    if isolated not in ISOLATED:
        raise ValueError(f"unknown isolated policy {isolated!r}")
    support = edges.select("row_idx", "neighbor", "distance", "weight")
    own = cells.select("row_idx", F.col("row_idx").alias("neighbor"), F.lit(0.0).alias("distance"), F.lit(1.0).alias("weight"))
    if include_anchor:
        support = own.unionByName(support)
    else:
        alone = cells.select("row_idx").join(edges.select("row_idx").distinct(), "row_idx", "left_anti")
        stand_in = F.col("row_idx") if isolated == "anchor_fallback" else F.lit(-1).cast("long") if isolated == "zero_dummy" else F.raise_error(F.lit("a cell has no neighbor and no anchor")).cast("long")
        support = support.unionByName(alone.select("row_idx", stand_in.alias("neighbor"), F.lit(0.0).alias("distance"), F.lit(1.0).alias("weight")))
    row = Window.partitionBy("row_idx")
    total = F.sum("weight").over(row)
    mass = F.col("weight") / F.greatest(total, F.lit(1e-12))
    if uniform_fallback:
        mass = F.when((total > 0) & (total < float("inf")), F.col("weight") / total).otherwise(1.0 / F.count("*").over(row))
    return support.withColumn("mass", mass)


def tokens(support: DataFrame, cells: DataFrame, vectors: DataFrame, radius: float) -> DataFrame:
    """The support with z (the neighbor's vector), rx, ry and rr; a dummy has no z and zeros else.  ``vectors`` is (row_idx, z)."""
    at = cells.select("row_idx", "x", "y")
    near = cells.select(F.col("row_idx").alias("neighbor"), F.col("x").alias("nx"), F.col("y").alias("ny")).join(vectors.select(F.col("row_idx").alias("neighbor"), "z"), "neighbor")
    joined = support.join(at, "row_idx").join(near, "neighbor", "left")
    out = joined.withColumns({"rx": (F.col("nx") - F.col("x")) / radius, "ry": (F.col("ny") - F.col("y")) / radius, "rr": F.col("distance") / radius})
    return out.select("row_idx", "neighbor", "distance", "weight", "mass", "z", F.coalesce("rx", F.lit(0.0)).alias("rx"), F.coalesce("ry", F.lit(0.0)).alias("ry"), F.coalesce("rr", F.lit(0.0)).alias("rr"))


def component_scales(token_rows: DataFrame, method: str, pairs: int = 20_000, seed: int = 1337) -> tuple[float, float, float]:
    """What squared differences of z, position and radius are divided by.

    ``none``: 1; ``dimension``: (dimension of z, 2, 1); ``sampled_median``: the median of the positive squared differences over pairs
    of tokens, at least 1e-8, or 1 if there is none.  The 2 * ``pairs`` tokens with the least keyed hash are paired in that order.
    """
    if method not in SCALES:
        raise ValueError(f"unknown scales {method!r}")
    if method == "none":
        return 1.0, 1.0, 1.0
    if method == "dimension":
        row = token_rows.select(F.max(F.size("z")).alias("d")).first()
        return float(max(row["d"] or 1, 1)), 2.0, 1.0
    row = sampled_scales(token_rows, pairs, seed).first()
    return row["z_scale"], row["xy_scale"], row["r_scale"]


def sampled_scales(token_rows: DataFrame, pairs: int, seed: int) -> DataFrame:
    """One row (z_scale, xy_scale, r_scale) of the ``sampled_median`` method."""
    keyed = token_rows.where("neighbor >= 0").select("row_idx", "neighbor", "z", "rx", "ry", "rr", uniform(seed, F.col("row_idx"), F.col("neighbor")).alias("u"))
    chosen = least_drawn(keyed, "u", ["row_idx", "neighbor"], 2 * pairs)  # at most 2 * pairs rows from here on
    placed = chosen.withColumn("at", F.row_number().over(Window.orderBy("u", "row_idx", "neighbor")) - 1).withColumn("pair", F.floor(F.col("at") / 2))
    side = lambda k, s: placed.where(F.col("at") % 2 == k).select("pair", *(F.col(c).alias(c + s) for c in ("z", "rx", "ry", "rr")))
    both = side(0, "a").join(side(1, "b"), "pair")
    sq = lambda c: (F.col(f"{c}a") - F.col(f"{c}b")) * (F.col(f"{c}a") - F.col(f"{c}b"))
    costs = {"z_scale": squared_distance(F.col("za"), F.col("zb")), "xy_scale": sq("rx") + sq("ry"), "r_scale": sq("rr")}
    return both.select(*(c.alias(n) for n, c in costs.items())).agg(*(F.greatest(F.coalesce(F.median(F.when(F.col(n) > 0, F.col(n))), F.lit(1.0)), F.lit(1e-8)).alias(n) for n in costs))


#: What a token holds for the distance kernels.
NODE_FEATURES = ("full_token", "expression_only", "expression_plus_radial")


def scaled_tokens(token_rows: DataFrame, weights: tuple[float, float, float], scales: tuple[float, float, float], node_features: str = "full_token") -> DataFrame:
    """(row_idx, neighbor, mass, token): the components times sqrt(weight / scale), joined to one array.

    ``expression_only`` keeps z and ``expression_plus_radial`` z and the radius, which suit distances that have a structure besides.
    """
    if node_features not in NODE_FEATURES:
        raise ValueError(f"unknown node features {node_features!r}; known: {', '.join(NODE_FEATURES)}")
    by = [(max(w, 0.0) / max(s, 1e-8)) ** 0.5 for w, s in zip(weights, scales, strict=True)]
    z, place, radius = F.transform("z", lambda v: v * F.lit(by[0])), F.array(F.col("rx") * by[1], F.col("ry") * by[1]), F.array(F.col("rr") * by[2])
    token = {"full_token": F.concat(z, place, radius), "expression_only": z, "expression_plus_radial": F.concat(z, radius)}[node_features]
    return token_rows.select("row_idx", "neighbor", "mass", "rx", "ry", token.alias("token"))


def packed(scaled: DataFrame, width: int | None = None) -> DataFrame:
    """One row a cell: (row_idx, m, masses, tokens, rel) with flat arrays in the order of neighbor ids.

    A dummy's token has no z; its array is filled with zeros to ``width``.
    """
    token = F.when(F.col("neighbor") >= 0, F.col("token")).otherwise(F.array_repeat(F.lit(0.0), width or 0)) if width else F.col("token")
    item = F.struct("neighbor", F.col("mass"), token.alias("token"), F.array("rx", "ry").alias("rel"))
    rows = scaled.groupBy("row_idx").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return rows.select("row_idx", F.size("s").alias("m"), F.col("s.mass").alias("masses"), F.flatten("s.token").alias("tokens"), F.flatten("s.rel").alias("rel"))
