"""Connected components of an edge list by randomised contraction.

Each round every node hooks to the node of its closed neighbourhood with the least keyed hash, edges are rewritten to the
hooks' ends, and loops and repeats drop out.  Fresh hashes each round make the number of nodes shrink geometrically whatever the
graph's shape or numbering, so chains take a logarithmic number of rounds too.  The minimum over neighbours is combined before
the shuffle, so a hub isn't collected anywhere; rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichewright.plans.storage import materialise


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); ``component`` is the least node of the component.

    Edges with a null end and loops are dropped, so a node that has no other edge doesn't appear.
    """
    links = materialise(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(),
        "components",
    )
    hooks: list[DataFrame] = []
    for turn in range(most_rounds):
        if links.isEmpty():
            break
        both = links.select("a", "b").union(links.select("b", "a")).toDF("node", "near")
        rank = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("id"))
        hook = materialise(
            both.groupBy("node").agg(F.min(rank("near")).alias("best")).select("node", F.least("best", rank("node"))["id"].alias("to")),
            "components",
        )
        hooks.append(hook)
        moved = links.join(hook.toDF("a", "x"), "a").join(hook.toDF("b", "y"), "b")
        links = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "components")
    else:
        raise RuntimeError(f"components: edges left after {most_rounds} rounds")
    if not hooks:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # Follow the hooks from the first round on; a node that isn't in a later round stays where it is.
    place = hooks[0]
    for hook in hooks[1:]:
        place = place.join(hook.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    place = materialise(place, "components") if len(hooks) > 1 else place
    return with_group(place, "to", component=F.min("node")).select("node", "component")


def with_group(rows: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """``rows``, a written table, each with the ``aggregates`` of all rows that share its ``key``; a null key has nulls.

    Groups of over a ten-thousandth of all rows (and of over 1,000) are at most ten thousand, so their aggregates are broadcast and
    their rows stay where they are; the others meet theirs by shuffle.
    """
    groups = materialise(rows.groupBy(key).agg(*(c.alias(n) for n, c in aggregates.items()), F.count("*").alias("__nw_rows")), "groups")
    large = F.col("__nw_rows") > max(1_000, rows.count() // 10_000)
    hot = F.broadcast(groups.where(large).drop("__nw_rows"))
    others = rows.join(hot.select(key), key, "left_anti").join(groups.where(~large).drop("__nw_rows"), key, "left")
    return rows.join(hot, key).unionByName(others)
