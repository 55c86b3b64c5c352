"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target of words by weight, held to ``most_repeats`` times its size; what that cuts off is reshared by weight.
A source's documents stand in the order of a keyed hash, and its stream runs through them again and again until the target is
met.  Over training time t in [0, 1] a source is drawn with a piecewise-linear weight; its integral is the source's cumulative
demand, so the position of a document is found by inverting that integral at the document's place in the stream.  Sorting by
position gives the training order.

Scale: sizes are summed before any shuffle.  The running sum over a source is taken in two levels, over hash ranges of at most
``bucket`` documents and then within each, so that a source with a third of all rows is spread like any other.  Tables with a row
for each source or range are broadcast only after their rows were counted.

Cases: a null text has size 0; the null source is a source of its own and comes last; documents of size 0 take nothing; rows that
share an id are documents of their own; an empty table gives an empty result; other columns are ignored by ``mix_plan`` and kept
by ``mixed_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichewright.llm.shared import WORD, materialise, partitions

#: Beyond so many rows a table is joined by shuffle instead of broadcast.
MOST_BROADCAST_ROWS = 200_000
#: Prefix of the columns that are added to documents meanwhile.
P = "__nw_"


@dataclass(frozen=True)
class Schedule:
    """A weight over training time as straight lines between knots (time, weight); times run from 0 to 1."""

    knots: tuple[tuple[float, float], ...]

    def position(self, share: Column) -> Column:
        """The time at which ``share`` of the weight's integral is reached."""
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(self.knots, self.knots[1:], strict=False)]
        total, before = sum(areas), 0.0
        out = F.lit(1.0)
        steps = []
        for (a, b), area in zip(zip(self.knots, self.knots[1:], strict=False), areas, strict=True):
            steps.append((before, a, b, area))
            before += area
        for before, (t, w), (t2, w2), area in reversed(steps):
            y = share * F.lit(total) - F.lit(before)
            slope = (w2 - w) / (t2 - t)
            root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * y, F.lit(0.0)))
            inside = F.when(y <= 0, F.lit(float(t))).otherwise(F.lit(float(t)) + F.lit(2.0) * y / (F.lit(float(w)) + root))
            out = F.when(y < F.lit(area), inside).otherwise(out)
        return out


#: By rank modulo 3: heavy sources fade, middle ones are even, light ones rise.  Each has the integral 1.
CURRICULUM = (Schedule(((0.0, 1.5), (1.0, 0.5))), Schedule(((0.0, 1.0), (1.0, 1.0))), Schedule(((0.0, 0.5), (1.0, 1.5))))


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order(doc_id: Column, text: Column, seed: int) -> Column:
    """The hash that orders a source's documents; texts that share an id, or have none, are spread like others."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe inner join; the small side is broadcast if it has few rows, else the join shuffles and skew is split at run time."""
    other = right.select(*(F.col(k).alias(f"{k}_r") if k in keys else F.col(k) for k in right.columns))
    on = [left[k].eqNullSafe(other[f"{k}_r"]) for k in keys]
    few = other.count() <= MOST_BROADCAST_ROWS
    return left.join(F.broadcast(other) if few else other, on).drop(*(f"{k}_r" for k in keys))


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most_repeats: float) -> DataFrame:
    """(source, source_size, documents, shape, target) from rows (source, size).

    With caps c, weights w and total T, the level L = max over k of (T - sum of the k least c/w's caps) / (sum of the other
    weights) gives every source min(c, w * L): resharing the excess until none is above ends there.
    """
    by_source = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), "mix-sources")
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("shape", F.col("rank") % len(weights)).withColumns(
        {"weight": F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")), "cap": F.col("source_size") * float(most_repeats)}
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    all_ = Window.partitionBy()
    levels = weighed.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(all_) - before) / rest)
    return levels.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(all_))).select("source", "source_size", "documents", "shape", "target")


def _placed(rows: DataFrame, sized: DataFrame, weights, share, most_repeats, bucket: int) -> DataFrame:
    """``rows`` with source_size, target, shape, the words before a row in its source's stream and its copies.

    ``rows`` and ``sized`` have source, size and order under the prefix; ``sized`` may have fewer columns.
    """
    targets = materialise(source_targets(sized.select(F.col(f"{P}source").alias("source"), F.col(f"{P}size").alias("size")), weights, share, most_repeats), "mix-targets")
    named = targets.select(*(F.col(c).alias(P + c) for c in targets.columns))

    def bucketed(df: DataFrame) -> DataFrame:
        fraction = F.conv(F.substring(f"{P}order", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
        return _joined(df, named, [f"{P}source"]).withColumn(f"{P}bucket", F.floor(fraction * F.ceil(F.col(f"{P}documents") / bucket)))

    sums = bucketed(sized).groupBy(f"{P}source", f"{P}bucket").agg(F.sum(f"{P}size").alias(f"{P}sum"))
    earlier = Window.partitionBy(f"{P}source").orderBy(f"{P}bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sums.select(f"{P}source", f"{P}bucket", F.coalesce(F.sum(f"{P}sum").over(earlier), F.lit(0)).alias(f"{P}start")), "mix-buckets")
    within = Window.partitionBy(f"{P}source", f"{P}bucket").orderBy(f"{P}order", f"{P}size").rowsBetween(Window.unboundedPreceding, 0)
    placed = _joined(bucketed(rows), starts, [f"{P}source", f"{P}bucket"])
    placed = placed.withColumn(f"{P}before", F.col(f"{P}start") + F.sum(f"{P}size").over(within) - F.col(f"{P}size"))
    full = F.when(F.col(f"{P}source_size") > 0, F.floor(F.col(f"{P}target") / F.col(f"{P}source_size"))).otherwise(F.lit(0))
    rest = F.col(f"{P}target") - full * F.col(f"{P}source_size")
    once_more = F.col(f"{P}before") + F.col(f"{P}size") / 2 < rest
    return placed.withColumn(f"{P}copies", F.when(F.col(f"{P}size") > 0, full + once_more.cast("long")).otherwise(F.lit(0)).cast("int"))


def _position(copy: Column, curriculum: tuple[Schedule, ...]) -> Column:
    """Training time, in billionths, of a copy (0, 1, ...) of a row."""
    share = F.least((copy * F.col(f"{P}source_size") + F.col(f"{P}before")) / F.col(f"{P}target"), F.lit(1.0))
    at = F.lit(None).cast("double")
    for n, schedule in enumerate(curriculum):
        at = F.when(F.col(f"{P}shape") % len(curriculum) == n, schedule.position(share)).otherwise(at)
    return F.floor(at * 1e9).cast("long")


def _sized(documents: DataFrame, seed: int) -> DataFrame:
    return documents.withColumns({f"{P}source": documents["source"], f"{P}size": words_in(documents["text"]), f"{P}order": _order(documents["doc_id"], documents["text"], seed)})


def _ordered(placed: DataFrame, curriculum: tuple[Schedule, ...], columns: list[str]) -> DataFrame:
    """The copies of the placed rows in training order by range partition."""
    copies = placed.withColumn(f"{P}copy", F.explode(F.sequence(F.lit(0), F.col(f"{P}copies") - 1)))
    by = [f"{P}position", f"{P}order"]
    ordered = copies.withColumn(f"{P}position", _position(F.col(f"{P}copy"), curriculum)).select(*dict.fromkeys([*columns, *by]))
    return ordered.repartitionByRange(partitions(placed.sparkSession), *by).sortWithinPartitions(*by).select(*columns)


def mix_plan(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_repeats: float = 2, curriculum: tuple[Schedule, ...] = CURRICULUM, seed: int = 17, bucket: int = 4_000) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, first_position) for every document; no text is shuffled.

    The mix is made as ``mixed_documents`` makes it, with numbers of rows for texts, and written in training order; what a document gives
    it is counted there.  ``first_position`` is the training time of the first copy in billionths, -1 for a document that isn't taken.
    """
    sized = materialise(_sized(documents.select("doc_id", "source", "text"), seed).select(F.monotonically_increasing_id().alias(f"{P}row"), "doc_id", f"{P}source", f"{P}size", f"{P}order"), "mix-sizes")
    placed = materialise(_placed(sized, sized, weights, share, most_repeats, bucket), "mix-placed")
    mix = materialise(_ordered(placed.where(F.col(f"{P}copies") > 0), curriculum, [f"{P}row", f"{P}size", f"{P}position"]), "mix-order")
    given = mix.groupBy(f"{P}row").agg(F.sum(f"{P}size").alias(f"{P}taken"), F.count("*").cast("int").alias(f"{P}given"), F.min(f"{P}position").alias(f"{P}first"))
    return placed.join(given, f"{P}row", "left").select(
        "doc_id",
        F.col(f"{P}size").alias("size"),
        F.col(f"{P}source_size").alias("source_size"),
        F.col(f"{P}target").alias("target"),
        F.coalesce(f"{P}taken", F.lit(0)).alias("taken"),
        F.coalesce(f"{P}given", F.lit(0)).alias("copies"),
        F.coalesce(f"{P}first", F.lit(-1)).alias("first_position"),
    )


def mixed_documents(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_repeats: float = 2, curriculum: tuple[Schedule, ...] = CURRICULUM, seed: int = 17, bucket: int = 4_000) -> DataFrame:
    """The copies that the mix takes, in training order by range partition, with the columns of ``documents``."""
    keyed = _sized(documents, seed)
    sized = materialise(keyed.select(f"{P}source", f"{P}size", f"{P}order"), "mix-sizes")
    placed = _placed(keyed, sized, weights, share, most_repeats, bucket).where(F.col(f"{P}copies") > 0)
    return _ordered(placed, curriculum, documents.columns)


def oracle_sql(weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_repeats: float = 2, seed: int = 17) -> str:
    """The SQL of ``mix_plan`` with the default curriculum over the view ``documents``."""
    weight = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return f"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5(COALESCE(CAST(doc_id AS VARCHAR), 'null') || ':{seed}:' || md5(COALESCE(text, ''))) AS h
  FROM documents),
sources AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1 AS rnk FROM sources),
weighed AS (
  SELECT *, CASE rnk % {len(weights)} {weight} END AS w, CAST(source_size AS DOUBLE) * {float(most_repeats)} AS cap,
         {float(share)} * SUM(source_size) OVER () AS total FROM ranked),
levels AS (
  SELECT *, (total - COALESCE(SUM(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / SUM(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighed),
targets AS (SELECT source, source_size, rnk, LEAST(cap, w * MAX(lvl) OVER ()) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rnk % 3 AS shape,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         CAST(SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(whole + CASE WHEN before + size / 2.0 < target - whole * source_size THEN 1 ELSE 0 END AS INTEGER) ELSE 0 END AS copies,
         LEAST(before / target, 1.0) AS share FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies,
       CASE WHEN copies > 0 THEN CAST(floor(1e9 * CASE
         WHEN share >= 1 THEN 1.0 WHEN share <= 0 THEN 0.0
         WHEN shape = 0 THEN 2.0 * share / (1.5 + sqrt(2.25 - 2.0 * share))
         WHEN shape = 1 THEN 2.0 * share / (1.0 + sqrt(1.0))
         ELSE 2.0 * share / (0.5 + sqrt(0.25 + 2.0 * share)) END) AS BIGINT) ELSE -1 END AS first_position
FROM counted"""
