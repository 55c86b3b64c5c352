"""Near-duplicate removal: SimHash anchors and MinHash bands find candidates, whole shingle sets decide.

Two texts are near copies if the sets of their ``width``-word shingles have a Jaccard similarity of ``similarity`` or more.  A 64-bit
SimHash of such a pair differs in ``64 * acos(2 s / (1 + s)) / pi`` bits on average, 10 at 0.8, while anchors can cover only a few
bits (each more bit multiplies the replicas).  So the anchors, at ``bits`` differing bits, find the closest pairs, the bands of a
MinHash signature find the others, and both kinds of candidates are verified alike.

Cases: a null text counts as empty, and texts without words are like each other; rows that share an id are documents of their
own; the document with the smallest id stays (null ids last), then the one with the smallest text hash, and one of rows that
agree in both; an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichewright.llm.minhash import MinHasher, band_stars, verified_links
from nichewright.llm.shared import few, materialise, text_batches
from nichewright.llm.simhash import fingerprint, links
from nichewright.operators.components import connected_components


def near_copy_candidates(different: DataFrame, bits: int) -> DataFrame:
    """Edges (a, b) from rows (id, fp, bands): texts of equal or close SimHash, and texts that share a band."""
    of_print = materialise(different.groupBy("fp").agg(F.min("id").alias("a")), "prints")
    same = different.join(of_print, "fp").where("id <> a").select("a", F.col("id").alias("b"))
    near = links(of_print.select("fp"), bits)
    ends = few(of_print)
    close = near.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.unionByName(close).unionByName(band_stars(different))


def drop_near_copies(documents: DataFrame, similarity: float = 0.8, width: int = 5, bits: int = 4, slots: int = 64, band: int = 4, block: int = 512) -> DataFrame:
    """One document of each group of near copies, with all its columns.

    Fingerprints are taken in one pass.  Texts are shuffled once if more documents stay than can be broadcast, to meet the list of
    those that stay, and the texts of candidate clusters once to be compared.
    """
    keys = ["__nw_id", "__nw_text"]
    text = F.coalesce(documents["text"], F.lit(""))

    @F.arrow_udf("struct<fp: bigint, bands: array<bigint>>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = MinHasher(slots, width)
        for texts in batches:
            raw = [x.as_py().encode() for x in texts]
            signed = [np.ascontiguousarray(np.pad(hasher.signature(x).reshape(-1, band), ((0, 0), (0, 4 - band)))).view(np.int64)[:, 0] for x in raw]
            yield pa.StructArray.from_arrays([pa.array([fingerprint(x, width) for x in raw], pa.int64()), pa.array(signed, pa.list_(pa.int64()))], ["fp", "bands"])

    if not 1 <= band <= 4:
        raise ValueError("a band has one to four slots")
    keyed = text_batches(documents).withColumns({"__nw_id": F.coalesce(documents["doc_id"].cast("string"), F.lit("")), "__nw_text": F.substring(F.sha2(text, 256), 1, 32)})
    prints = materialise(keyed.select(documents["doc_id"].cast("long").alias("doc_id"), *keys, F.length(text).alias("size"), sketch(text).alias("s")).select("doc_id", *keys, "size", "s.fp", "s.bands"), "near-prints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__nw_text", "__nw_id")
    different = materialise(prints.groupBy(F.col("__nw_text").alias("id")).agg(F.min(order).alias("k"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("size").alias("size")), "near-texts")
    once = materialise(prints.groupBy(*keys).count().where("count > 1").drop("count"), "near-repeats")
    repeats = not once.isEmpty()
    clusters = materialise(connected_components(near_copy_candidates(different.select("id", "fp", "bands"), bits)), "near-clusters")
    members = clusters.join(different, clusters.node == different.id).select(F.col("component").alias("cluster"), F.col("k.__nw_id").alias("__nw_id"), F.col("id").alias("__nw_text"), "size")
    if repeats:
        members = members.join(few(once).withColumn("twice", F.lit(True)), keys, "left").fillna(False, ["twice"])
    members = materialise(members, "near-members")
    read = keyed.select(*keys, text.alias("__nw_whole")).join(few(members), keys).select("cluster", F.col("__nw_text").alias("id"), F.col("__nw_whole").alias("text"), *(["twice"] if repeats else []))
    linked = connected_components(verified_links(read, members, similarity, slots, width, block))
    root = different.join(linked, different.id == linked.node, "left").select("k", F.coalesce("component", "id").alias("root"))
    stays = materialise(root.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.__nw_id").alias("__nw_id"), F.col("k.__nw_text").alias("__nw_text")), "near-kept")
    # Rows that agree in id and text go together: of each such pair of keys the first row stays.
    kept = keyed.join(few(stays), keys, "left_semi")
    if not repeats:
        return kept.select(*documents.columns)
    alone = kept.join(few(once), keys, "left_anti").select(*documents.columns)
    return alone.unionByName(kept.join(few(once), keys, "left_semi").dropDuplicates(keys).select(*documents.columns))
