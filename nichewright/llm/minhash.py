"""MinHash document fingerprints, their likeness, and near-duplicate texts by signature bands.

A text's shingles are runs of ``width`` lower-cased words (fewer words: the whole sequence; none: the empty shingle).  Every
shingle gets a 64-bit base hash, and each of ``slots`` hash functions of the multiply-add-shift universal family reorders the
shingles; the fingerprint keeps 16 bits (32 to 47) of each function's minimum, four hexadecimal digits a slot.  Likeness is the
share of equal slots, an estimate of the Jaccard similarity of the shingle sets.

Texts that share a band of their signature are joined in Spark: a band's texts form a star, stars form clusters, and only the
texts of clusters are read again, one row for each id and text.  A cluster of more than ``block`` texts, or of more than ``most_chars``
characters, is compared in blocks, similarities are taken from whole shingle sets, and a block sends out a spanning forest of its links at ``threshold`` or more instead of all pairs.  A pair at 0.8
shares one of 16 bands of 4 slots with the probability 1 - (1 - 0.8 ** 4) ** 16 = 0.9998.

``fingerprinted`` also needs every document's successor: texts are range-shuffled once, each task walks its sorted documents, and
only one text on either side of a partition border waits for a second step.

Cases: a null text counts as empty, empty texts are like each other; null ids come last in descending order; rows that share an
id follow each other by a hash of their text; the only document of a table is its own successor; a component that has only null
ids has a null ``component_id``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichewright.llm.shared import few, materialise, partitions, release, text_batches, text_id
from nichewright.llm.simhash import _runs
from nichewright.operators.components import connected_components, with_group

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class MinHasher:
    """Signatures of UTF-8 texts; the hashes of recent words are kept."""

    def __init__(self, slots: int = 64, width: int = 5, seed: int = 11, most_words: int = 150_000):
        rng = np.random.default_rng(seed)
        draw = lambda n: rng.integers(0, 2**64, n, np.uint64, endpoint=False) | np.uint64(1)
        self.place, self.a, self.b = draw(width), draw(slots)[:, None], draw(slots)[:, None]
        self.width, self.seed, self.most_words, self.cache = width, seed, most_words, {}

    def shingles(self, raw: bytes) -> np.ndarray:
        """The base hashes of all shingles, repeats included."""
        words = raw.translate(_LOWER).split()
        new = set(words).difference(self.cache)
        if len(self.cache) + len(new) > self.most_words:
            self.cache, new = {}, set(words)
        digest, seed = xxhash.xxh64_intdigest, self.seed
        self.cache.update((w, digest(w, seed)) for w in new)
        hashed = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.width + 1
        if n < 1:
            return _mixed((hashed * self.place[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
        total = np.full(n, np.uint64(self.width))
        for j in range(self.width):
            total += hashed[j : j + n] * self.place[j]
        return _mixed(total)

    def signature(self, raw: bytes) -> np.ndarray:
        """16 middle bits of the least hash in every slot."""
        x = self.shingles(raw)
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(x), 512):
            np.minimum(least, (self.a * x[start : start + 512] + self.b).min(1), out=least)
        return (least >> np.uint64(32)).astype("<u2")


def _edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


#: What a document's step yields; the signatures and hashes are kept as bytes until the result is made.
STEP = "doc_id long, row long, text_id binary, n_chars long, edited binary, own binary, new binary, near_edited double, near_next double"
WALKED = f"{STEP}, part int, kind string, text string"
_NAMES = [c.split()[0] for c in WALKED.split(", ")]
_TYPES = [{"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in WALKED.split(", ")]
_STEPS = len(STEP.split(", "))


def _step(doc_id, row: int, text: str, own: np.ndarray, following: str, next_own: np.ndarray, hasher: MinHasher) -> tuple:
    raw, changed = text.encode(), _edited(text, following).encode()
    new = own if changed == raw else hasher.signature(changed)
    return doc_id, row, hashlib.sha256(raw).digest()[:16], len(text), hashlib.sha256(changed).digest(), own.tobytes(), new.tobytes(), float((own == new).mean()), float((own == next_own).mean())


def _batch(rows: list[tuple], width: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES[:width], strict=True)], _NAMES[:width])


def edited_steps(documents: DataFrame, slots: int = 64, width: int = 5) -> DataFrame:
    """STEP for every document: its fingerprint, that of its edited text, and its likeness to that and to the next document's.

    The edited text has the last third of the code points replaced by the first as many of the document that follows in
    descending order of doc_id; the first follows the last.  ``row`` numbers the documents.
    """
    spark = documents.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    # Rows that agree in id and text may be dealt to several tasks: their order makes no difference.
    walked = (
        text_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(partitions(spark), *order, "deal")
        .sortWithinPartitions(*order, "text")
        .select("doc_id", "text")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, part, held, out = MinHasher(slots, width), TaskContext.get().partitionId(), None, []
        row = part << 33

        def flush(more=()):
            rows = [(*r, part, "done", None) for r in out] + list(more)
            out.clear()
            return _batch(rows, len(_NAMES))

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    own = hasher.signature(text.encode())
                    if held is None:
                        yield flush([(*[None] * _STEPS, part, "head", text)])
                    else:
                        out.append(_step(*held, text, own, hasher))
                    held = (doc_id, row, text, own)
                    row += 1
                if out:
                    yield flush()
        if held is not None:
            yield flush([(held[0], held[1], *[None] * (_STEPS - 2), part, "tail", held[2])])

    steps = materialise(walked.mapInArrow(walk, WALKED), "edited-fingerprints")
    del walked
    release(spark)
    heads, tails = (steps.where(F.col("kind") == k) for k in ("head", "tail"))
    by_part = Window.orderBy("part")
    following = heads.select("part").select("part", F.lead("part").over(by_part).alias("next"), F.min("part").over(by_part).alias("first"))
    borders = (
        tails.select("part", "doc_id", "row", "text")
        .join(following.select("part", F.coalesce("next", "first").alias("next")), "part")
        .join(heads.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
        .select("doc_id", "row", "text", "following")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(slots, width)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own, other = hasher.signature(r["text"].encode()), hasher.signature(r["following"].encode())
                rows.append(_step(r["doc_id"], r["row"], r["text"], own, r["following"], other, hasher))
            if rows:
                yield _batch(rows, _STEPS)

    return steps.where("kind = 'done'").select(*_NAMES[:_STEPS]).unionByName(materialise(borders.mapInArrow(close, STEP), "edited-borders"))


def fingerprinted(documents: DataFrame, threshold: float = 0.8, slots: int = 64, width: int = 5, band: int = 4, block: int = 512) -> DataFrame:
    """Fingerprints and near-duplicate groups: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, component_id, copies) for every document.

    ``component_id`` is the smallest doc_id that links of a Jaccard similarity of ``threshold`` or more reach, its own included;
    ``copies`` is the number of documents with the same text.
    """
    steps = edited_steps(documents, slots, width)
    classes = materialise(steps.groupBy("text_id").agg(F.min("row").alias("id"), F.min("doc_id").alias("first"), F.count("*").alias("copies")), "text-classes")
    bands = F.array(*(F.xxhash64(F.substring("own", 2 * band * i + 1, 2 * band)) for i in range(slots // band)))
    sketched = steps.select(F.col("row").alias("id"), "doc_id", "text_id", F.col("n_chars").alias("size"), bands.alias("bands")).join(classes.select("id"), "id")
    clusters = materialise(connected_components(band_stars(sketched)), "similar-clusters")
    members = sketched.join(few(clusters), sketched.id == clusters.node).select("id", "doc_id", "text_id", "size", F.col("component").alias("cluster"))
    repeated = materialise(steps.groupBy("doc_id", "text_id").count().where("count > 1").toDF("own_id", "own_text", "count"), "similar-repeats")
    if not repeated.isEmpty():
        members = members.join(few(repeated), (F.col("text_id") == F.col("own_text")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left").withColumn("twice", F.col("count").isNotNull()).drop(*repeated.columns)
    members = materialise(members, "similar-members")
    text = F.coalesce(documents["text"], F.lit(""))
    whole = text_batches(documents).select(documents["doc_id"].cast("long").alias("own_id"), text_id(text).alias("own_text"), text.alias("text"))
    read = whole.join(few(members), (F.col("text_id") == F.col("own_text")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select(*(c for c in ("cluster", "id", "text", "twice") if c == "text" or c in members.columns))
    linked = materialise(connected_components(verified_links(read, members, threshold, slots, width, block)), "similar-linked")
    roots = classes.join(few(linked), classes.id == linked.node, "left").select("text_id", "copies", "first", F.coalesce("component", "id").alias("root"))
    grouped = with_group(materialise(roots, "similar-roots"), "root", component_id=F.min("first"), all_copies=F.sum("copies"))
    # Most documents are alone; only the others are joined.
    shared = materialise(grouped.where("all_copies > 1").select("text_id", "copies", "component_id"), "similar-classes")
    of_row = steps.join(few(shared), "text_id", "left")
    hexed = lambda c: F.lower(F.hex(c))
    return of_row.select(
        "doc_id",
        "n_chars",
        hexed("edited").alias("edited_sha256"),
        hexed("own").alias("fingerprint"),
        hexed("new").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
    )


def band_stars(sketched: DataFrame) -> DataFrame:
    """Edges (a, b) from rows (id, bands) with different ids: every id that shares a band with others to the least of them."""
    by_band = sketched.select("id", F.posexplode("bands").alias("slot", "value")).select("id", F.xxhash64("slot", "value").alias("key"))
    shared = by_band.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a")
    return by_band.join(few(materialise(shared, "bands")), "key").where("id <> a").select("a", F.col("id").alias("b"))


def similar_links(sets: list[np.ndarray], home: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (sorted, without repeats) of which at least one is at home."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(code))])
    holders, begin = owner[order], np.concatenate([[0], np.cumsum(sizes)])
    root, out = np.arange(len(sets)), []
    for i in np.flatnonzero(home):
        if (root == root[i]).all():
            continue
        common = np.zeros(len(sets), np.int64)
        for c in range(begin[i], begin[i + 1], 1024):
            own = code[c : min(c + 1024, begin[i + 1])]
            common += np.bincount(np.concatenate([holders[first[k] : first[k + 1]] for k in own]), minlength=len(sets))
        for j in np.flatnonzero((common >= threshold * (sizes + sizes[i] - common)) & (root != root[i])):
            if root[j] != root[i]:
                out.append((int(i), int(j)))
                root[root == root[j]] = root[i]
    return out


def verified_links(read: DataFrame, members: DataFrame, threshold: float, slots: int, width: int, block: int, most_chars: int = 16 << 20) -> DataFrame:
    """Edges (a, b) that connect exactly the ids that links at ``threshold`` connect, from rows (cluster, id, text[, twice]) of clusters
    and the written table ``members`` with a row (cluster, size) for each of their ids, ``size`` being the length of its text.

    Rows that repeat an id are marked ``twice``; of these each task sends one an id.  A cluster of more than ``block`` ids or
    ``most_chars`` characters is dealt into blocks, and every pair of these meets in one task.
    """
    kind = read.schema["id"].dataType.simpleString()
    if "twice" in read.columns:
        once = read.where("twice").groupBy("cluster", "id").agg(F.first("text").alias("text"))
        read = read.where("NOT twice").drop("twice").unionByName(once)
    blocks_of = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / most_chars))
    sizes = members.groupBy("cluster").agg(blocks_of.alias("n")).where("n > 1")
    dealt = read.join(few(materialise(sizes, "clusters")), "cluster", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), "n"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    placed = dealt.select("cluster", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("h"), "id", (F.col("own") <= F.col("other")).alias("home"), "text")
    key = ["cluster", "c", "h"]
    blocks = placed.withColumn("cluster", F.xxhash64("cluster")).repartition(*key).sortWithinPartitions(*key, "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(slots, width)
        for rows in _runs(batches, key):
            ids, own = rows["id"].to_pylist(), rows["home"].to_pylist()
            sets = [np.unique(hasher.shingles(text.as_py().encode())) for text in rows["text"]]
            found = similar_links(sets, np.array(own), threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found]), pa.array([ids[j] for _, j in found])], ["a", "b"])

    return blocks.mapInArrow(compare, f"a {kind}, b {kind}")
