"""Near-duplicate vectors by sorted projection passes.

A pass gives every vector a key of 63 concatenated hashes, each the side of a random hyperplane that it lies on, sorts the vectors of
each label by it, and compares every vector with the ``window`` next ones.  Pairs whose cosine is verified are united across
passes.  Two vectors at an angle of ``a`` share a hash with a chance of 1 - a / pi, and they are within the window of each other if they
share about log2(n / window) leading ones; the number of passes follows from that, so that a pair right at the threshold is missed
with a chance of ``miss`` at most (where the keys spread the vectors evenly).

Links are then counted within each united group: its members meet in blocks, so that no count depends on the window and a group denser
than it loses no link.  Equal vectors of a label are one member with a weight.

Scale: only (key, member) is sorted, all passes at once; places come from the counts of the sorted partitions.  Each run of
``block`` places is one row group, with the ``window`` places before it, so that neither labels nor partitions bound a comparison and
none is hot.  A vector is sent to one block a pass.  A block returns a spanning forest of its links, a pair of blocks of a group the
counts of its members, never pairs.  A group of m members takes m * m / 2 comparisons, which grow with the square of its different
vectors.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link with nothing
and are their own component; vectors of different lengths don't link; rows that share an id are rows of their own; the
component of rows with null ids only is null; ``kept`` is false for a null id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichewright.llm.ann import cosine
from nichewright.llm.shared import few, materialise, partitions
from nichewright.llm.simhash import _runs
from nichewright.operators.components import connected_components

BITS = 63
#: Cosines of products of unit vectors are taken anew, one by one, where they are as near to the threshold as this.
NEAR = 1e-9


def passes_for(n: int, window: int, threshold: float, miss: float = 1e-4) -> int:
    """How many passes miss a pair at the threshold with a chance of ``miss`` at most, four at least."""
    shared = (1 - math.acos(min(1.0, threshold)) / math.pi) ** max(0.0, math.log2(max(1, n) / window))
    return 4 if shared >= 1 else max(4, math.ceil(math.log(miss) / math.log1p(-shared)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are scaled by powers of two first, so that no square over- or underflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a column of equally long arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def hyperplane_keys(x: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """(rows, passes) of 63-bit keys; the first hash is the highest bit."""
    out = np.zeros((len(x), passes), np.int64)
    for p in range(passes):
        planes = np.random.default_rng([seed, p, x.shape[1]]).standard_normal((x.shape[1], BITS))
        out[:, p] = (x @ planes > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
    return out


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` have a cosine of ``threshold`` or more."""
    products = unit(x) @ unit(y).T
    found = products >= threshold
    i, j = np.nonzero(np.abs(products - threshold) < NEAR)
    if len(i):
        found[i, j] = cosine(x[i], y[j]) >= threshold
    return found


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def window_links(x: np.ndarray, fresh: int, window: int, threshold: float, tile: int = 512) -> np.ndarray:
    """Roots of the links between rows at most ``window`` apart, one of each pair at ``fresh`` or later."""
    a, b = [], []
    for start in range(0, len(x), tile):
        stop = min(start + tile, len(x))
        i, j = np.nonzero(linked(x[start:stop], x[start : stop + window], threshold))
        good = (j > i) & (j - i <= window) & (start + j >= fresh)
        a.append(start + i[good])
        b.append(start + j[good])
    return forest(np.concatenate(a), np.concatenate(b), len(x))


def members(vectors: DataFrame, label: Column, vector: Column) -> DataFrame:
    """The rows (vec_id, h1, h2, label, v); those that link with nothing have a null label.  (h1, h2) is the same for equal ones."""
    kind = dict(vectors.select(vector.alias("v")).dtypes)["v"]
    rows = vectors.select("vec_id", label.alias("label"), vector.cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    fine = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    held = F.coalesce(fine & F.col("label").isNotNull(), F.lit(False))
    return rows.select("vec_id", *(F.when(held, F.xxhash64(F.lit(salt), "label", "v")).alias(f"h{salt}") for salt in (1, 2)), F.when(held, F.col("label")).alias("label"), F.when(held, F.col("v")).alias("v"))


def pass_links(different: DataFrame, threshold: float, passes: int, window: int, block: int, seed: int) -> DataFrame:
    """Edges (a, b) between members (cid, label, d, v): a spanning forest of every block's verified pairs, for all passes."""
    spark = different.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("d").to_numpy()
            for d in np.unique(length):
                for at in np.array_split(np.flatnonzero(length == d), -(-int((length == d).sum()) // 2048)):
                    rows = batch.take(pa.array(at))
                    keys = hyperplane_keys(matrix(rows.column("v")), passes, seed)
                    yield pa.RecordBatch.from_arrays([rows.column("cid"), rows.column("label"), rows.column("d"), pa.array(list(keys), pa.list_(pa.int64()))], ["cid", "label", "d", "keys"])

    kind = different.schema["label"].dataType.simpleString()
    keyed = different.select("cid", "label", "d", "v").mapInArrow(hashed, f"cid long, label {kind}, d int, keys array<long>")
    order = ["pass", "label", "d", "key", "cid"]
    spread = keyed.select(F.posexplode("keys").alias("pass", "key"), "label", "d", "cid").select(*order)
    # The id's upper bits number the partition, its lower 33 the row in it.
    placed = materialise(spread.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "passes")
    part = F.shiftright("at", 33)
    counts = {r.part: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}  # a number for each partition
    offset, rows = 0, []
    for p in sorted(counts):
        rows.append((p, offset - (p << 33)))
        offset += counts[p]
    offsets = F.broadcast(spark.createDataFrame(rows, "part long, shift long"))
    where = placed.withColumn("part", part).join(offsets, "part").select("pass", "label", "d", "cid", (F.col("at") + F.col("shift")).alias("place"))
    own = F.floor(F.col("place") / block)
    blocks = F.when(F.col("place") % block >= block - window, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = where.select("pass", "label", "d", "cid", "place", F.explode(blocks).alias("block")).join(different.select("cid", "v"), "cid")
    sorted_blocks = dealt.select("block", "place", "pass", "label", "d", "cid", "v").repartition(partitions(spark), "block").sortWithinPartitions("block", "place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["block"]):
            fresh = run["place"].to_numpy() >= run["block"][0].as_py() * block
            codes = [run["pass"].to_numpy(), run["d"].to_numpy(), run["label"].combine_chunks().dictionary_encode().indices.to_numpy()]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
            for start, stop in zip([0, *edges], [*edges, len(fresh)], strict=True):
                if stop - start < 2 or not fresh[stop - 1]:
                    continue
                part_ = run.slice(start, stop - start)
                root = window_links(matrix(part_["v"]), int(np.argmax(fresh[start:stop])), window, threshold)
                at = np.flatnonzero(root != np.arange(len(root)))
                if len(at):
                    cid = part_["cid"].to_numpy()
                    yield pa.RecordBatch.from_pydict({"a": cid[root[at]], "b": cid[at]})

    return sorted_blocks.mapInArrow(compare, "a long, b long")


def link_counts(grouped: DataFrame, threshold: float, block: int) -> DataFrame:
    """(cid, links): the weight of all other members of its group that each member (component, cid, weight, v) links with."""
    # A group of m members has sqrt(m) / 8 blocks, so that larger groups have both more and larger ones, up to ``block`` members.
    blocks = F.ceil(F.greatest(F.sqrt("count") / 8, F.col("count") / block))
    sizes = grouped.groupBy("component").count().where(blocks > 1).select("component", blocks.alias("n"))
    sized = grouped.join(few(materialise(sizes, "group-sizes")), "component", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64("cid"), "n")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    key = ["component", "i", "j"]
    met = sized.withColumn("first", own).select("component", F.explode(pairs).alias("p"), "first", "cid", "weight", "v").select("component", "p.i", "p.j", (F.col("first") == F.col("p.i")).alias("left"), "cid", "weight", "v")
    met = met.repartition(partitions(grouped.sparkSession), *key).sortWithinPartitions(*key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, key):
            cid, weight, x = run["cid"].to_numpy(), run["weight"].to_numpy(), matrix(run["v"])
            left = np.flatnonzero(run["left"].to_numpy(zero_copy_only=False))
            same = run["i"][0].as_py() == run["j"][0].as_py()
            right = left if same else np.setdiff1d(np.arange(len(cid)), left)
            links = np.zeros(len(cid), np.int64)
            for start in range(0, len(left), 512):
                some = left[start : start + 512]
                found = linked(x[some], x[right], threshold)
                found[some[:, None] == right[None, :]] = False
                links[some] += found @ weight[right]
                if not same:
                    links[right] += weight[some] @ found
            yield pa.RecordBatch.from_pydict({"cid": cid, "links": links})

    return met.mapInArrow(count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def close_vectors(vectors: DataFrame, label: Column, vector: Column, threshold: float = 0.98, window: int = 128, passes: int | None = None, block: int = 4096, seed: int = 12) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    if not 0 < threshold <= 1 or not 1 <= window < block:
        raise ValueError("the threshold must be in (0, 1] and the window shorter than a block")
    rows = materialise(members(vectors, label, vector), "close-rows")
    keys = ["h1", "h2"]
    made = rows.where("h1 IS NOT NULL").groupBy(*keys).agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    different = materialise(made.withColumns({"cid": F.monotonically_increasing_id(), "d": F.size("v")}), "close-members")
    n = different.count()
    edges = pass_links(different, threshold, passes or passes_for(n, window, threshold), window, block, seed) if n else different.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    groups = materialise(connected_components(edges), "close-groups").select(F.col("node").alias("cid"), "component")
    grouped = materialise(groups.join(different.select("cid", "weight", "v"), "cid"), "close-grouped")
    counted = groups.join(link_counts(grouped, threshold, 4 * block), "cid", "left").join(different.select("cid", *keys, "first", "weight"), "cid")
    counted = materialise(counted.select("component", *keys, "first", "weight", F.coalesce("links", F.lit(0)).alias("links")), "close-counted")
    least = counted.groupBy("component").agg(F.min("first").alias("component_id"))
    of_copies = F.col("links") + F.col("weight") - 1
    in_groups = counted.join(least, "component").select(*keys, "weight", of_copies.alias("n_links"), "component_id")
    alone = different.where("weight > 1").join(groups, "cid", "left_anti").select(*keys, "weight", (F.col("weight") - 1).alias("n_links"), F.col("first").alias("component_id"))
    found = materialise(in_groups.unionByName(alone), "close-found")
    # Rows of much repeated vectors stay where they are; there are at most 10,000 such vectors.
    hot = F.col("weight") > max(1_000, rows.count() // 10_000)
    ids = rows.select("vec_id", *keys)
    spread = F.broadcast(found.where(hot).drop("weight"))
    repeated = ids.join(spread, keys)
    others = ids.join(spread.select(*keys), keys, "left_anti").join(found.where(~hot).drop("weight"), keys, "left")
    linked_or_not = repeated.unionByName(others)
    n_links, component = F.coalesce("n_links", F.lit(0).cast("long")), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return linked_or_not.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def oracle_sql(threshold: float = 0.98) -> str:
    """All pairs of a label, and their components."""
    fine = "len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))) AND list_bool_or(list_transform(embedding, lambda e: e <> 0))"
    return f"""WITH RECURSIVE r AS MATERIALIZED (SELECT row_number() OVER () AS at_, vec_id, label, embedding FROM embeddings),
u AS MATERIALIZED (SELECT at_, vec_id, label, embedding::DOUBLE[] AS v FROM r WHERE label IS NOT NULL AND {fine}),
links AS MATERIALIZED (SELECT a.at_ AS a, b.at_ AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.at_ <> b.at_ WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
reach(a, b) AS (SELECT at_, at_ FROM r UNION SELECT x.a, l.b FROM reach x JOIN links l ON l.a = x.b),
least_ AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN r ON at_ = b GROUP BY a),
n AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT vec_id, COALESCE(n.n, 0) AS n_links, component_id, COALESCE(vec_id = component_id, false) AS kept FROM r JOIN least_ ON least_.a = at_ LEFT JOIN n ON n.a = at_"""
