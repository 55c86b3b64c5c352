"""SimHash near-duplicates: fingerprints linked through the anchor points of a covering code.

A fingerprint's 64 bits fall into three parts.  The anchors of a part are the 4096 words of the binary Golay code of length 23,
whose covering radius is 3: every part has one nearest anchor at 3 bits or fewer.  Two fingerprints that differ in at most
``threshold`` bits differ in at most ``threshold * g // 3`` bits over some ``g`` of the three parts.  So every fingerprint is
replicated to all anchors within the covering radius plus that many bits, and it is compared, at its nearest anchor only, with
the fingerprints replicated to there.  No pair within the threshold is missed, whatever the data.

Scale: exact copies meet in one fingerprint before anything is replicated.  ``g`` = 1 makes about 16 replicas and compares a
fingerprint with 0.4 % of the others; ``g`` = 2 makes about 180 and compares with about a hundred-thousandth, which is for tens
of millions of fingerprints and more.  An anchor with more than ``block`` members is compared in blocks of that size, each of
them a row group of its own, and a block sends out a spanning forest of its links instead of all pairs.

Cases: a null text counts as empty; no words give fingerprint zero, which is linked like any other; rows that share an id are
kept each; a component that has only null ids has a null component; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichewright.llm.shared import materialise, text_batches
from nichewright.operators.components import connected_components, with_group

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The generator polynomial of the binary Golay code, its length and its covering radius.
GOLAY, LENGTH, RADIUS = 0b110001110101, 23, 3
#: First bit and length of the parts; the last one is filled up with zeros to the code's length.
PARTS = ((0, 23), (23, 23), (46, 18))
#: From this many different fingerprints on, anchors are taken over two parts.
MANY = 50_000_000


def fingerprint(raw: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash of UTF-8 bytes: bit i is set if over half of the shingles' XXH64 have it; signed, 0 for no words."""
    found = raw.translate(_LOWER).split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, words: int = 4, seed: int = 42) -> Column:
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(x.as_py(), words, seed) for x in texts), pa.int64(), size=len(texts))

    return of(F.coalesce(text, F.lit("")).cast("binary"))


@functools.cache
def _cosets(slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the Golay code: syndromes of the lower 12 and upper 11 bits, and for each syndrome the vectors that lead from
    a word to the anchors within RADIUS + slack (padded with the first) and by how much each is longer than RADIUS (99: padding)."""

    def remainder(value: int) -> int:
        for bit in range(LENGTH - 1, 10, -1):
            if value >> bit & 1:
                value ^= GOLAY << bit - 11
        return value

    of_bit = [remainder(1 << b) for b in range(LENGTH)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for b in range(12):
        low[np.arange(1 << 12) >> b & 1 == 1] ^= of_bit[b]
    for b in range(11):
        high[np.arange(1 << 11) >> b & 1 == 1] ^= of_bit[12 + b]
    lists: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for weight in range(RADIUS + slack + 1):
        for bits in itertools.combinations(range(LENGTH), weight):
            syndrome = functools.reduce(lambda s, b: s ^ of_bit[b], bits, 0)
            lists[syndrome].append((sum(1 << b for b in bits), max(0, weight - RADIUS)))
    width = max(map(len, lists))
    vectors = np.array([[v for v, _ in x] + [x[0][0]] * (width - len(x)) for x in lists], np.int64)
    excess = np.array([[e for _, e in x] + [99] * (width - len(x)) for x in lists], np.int64)
    return low, high, vectors, excess


def anchors(prints: np.ndarray, threshold: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor key, is it the nearest) for every anchor of unsigned 64-bit fingerprints.

    The key's low bits are the code word's 12 message bits of each part, above them the number of the choice of parts.
    """
    slack = threshold * g // len(PARTS)
    low, high, vectors, excess = _cosets(slack)
    words, errors, extra = [], [], []
    for first, length in PARTS:
        word = (prints >> np.uint64(first) & np.uint64((1 << length) - 1)).astype(np.int64)
        at = low[word & 0xFFF] ^ high[word >> 12]
        words.append(word)
        errors.append(vectors[at])
        extra.append(excess[at])
    rows, keys, nearest = [], [], []
    for n, chosen in enumerate(itertools.combinations(range(len(PARTS)), g)):
        key = np.full((len(prints), 1), n, np.int64)
        more = np.zeros((len(prints), 1), np.int64)
        for p in chosen:
            message = (words[p][:, None] ^ errors[p]) >> 11
            key = ((key[:, :, None] << 12) | message[:, None, :]).reshape(len(prints), -1)
            more = (more[:, :, None] + extra[p][:, None, :]).reshape(len(prints), -1)
        i, j = np.nonzero(more <= slack)
        rows.append(i)
        keys.append(key[i, j])
        nearest.append(more[i, j] == 0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(nearest)


def block_links(home: np.ndarray, member: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links between unsigned ``home`` and larger ``member`` fingerprints of one block."""
    nodes = np.unique(np.concatenate([home, member]))
    home_at, member_at = np.searchsorted(nodes, home), np.searchsorted(nodes, member)
    root = np.arange(len(nodes))
    step = max(1, (1 << 20) // max(1, len(member)))
    for start in range(0, len(home), step):
        part = home[start : start + step]
        close = (np.bitwise_count(part[:, None] ^ member[None, :]) <= threshold) & (part[:, None] < member[None, :])
        for i in np.flatnonzero(close.any(1)):
            own = root[home_at[start + i]]
            other = np.unique(root[member_at[close[i]]])
            joined = np.union1d(other, own)
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[linked]], nodes[linked]


def links(prints: DataFrame, threshold: int, block: int = 8192, g: int | None = None) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints ``fp`` (distinct longs) that links of ``threshold`` bits connect."""
    size = g or (2 if prints.count() > MANY else 1)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                own = batch.column("fp").slice(start, 2048).to_numpy(zero_copy_only=False)
                row, key, nearest = anchors(own.view(np.uint64), threshold, size)
                yield pa.RecordBatch.from_pydict({"anchor": key, "fp": own[row], "home": nearest})

    placed = prints.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    large = (
        placed.groupBy("anchor")
        .agg(F.count("*").alias("members"), F.count_if("home").alias("homes"))
        .where(F.col("members") > block)
        .select("anchor", F.ceil(F.col("members") / block).alias("n"), F.ceil(F.greatest("homes", F.lit(1)) / block).alias("m"))
    )
    sized = placed.join(large, "anchor", "left").select("anchor", "fp", "home", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("m", F.lit(1)).alias("m"))
    draw = lambda by, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(by))
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # A fingerprint is a member of one block column in every row of blocks, and at home in one row of every column.
    as_member = F.transform(all_of("m"), lambda h: F.struct(draw("n", 1).alias("c"), h.alias("h"), F.lit(False).alias("home")))
    as_home = F.transform(all_of("n"), lambda c: F.struct(c.alias("c"), draw("m", 2).alias("h"), F.lit(True).alias("home")))
    places = F.when(F.col("home"), F.concat(as_member, as_home)).otherwise(as_member)
    blocks = sized.select("anchor", "fp", F.explode(places).alias("at")).select("anchor", "at.c", "at.h", "fp", "at.home")
    key = ["anchor", "c", "h"]
    blocks = blocks.repartition(*key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, key):
            fp, at_home = rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy(zero_copy_only=False)
            a, b = block_links(fp[at_home], fp[~at_home], threshold)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    return blocks.mapInArrow(compare, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a sorted partition, each as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in key])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in key):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in itertools.pairwise(edges):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def roots(prints: DataFrame, threshold: int, block: int = 8192, g: int | None = None) -> DataFrame:
    """(fp, root) for every different fingerprint of ``prints``; linked ones share their root."""
    different = materialise(prints.select("fp").distinct(), "simhash")
    joined = connected_components(links(different, threshold, block, g))
    return different.join(joined, different.fp == joined.node, "left").select("fp", F.coalesce("component", "fp").alias("root"))


def simhash_components(documents: DataFrame, threshold: int = 4, block: int = 8192, g: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; the texts are read once and never shuffled."""
    prints = materialise(text_batches(documents).select("doc_id", fingerprints(F.col("text")).alias("fp")), "simhash")
    placed = materialise(roots(prints, threshold, block, g).join(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp"), "simhash")
    of_print = with_group(placed, "root", component_id=F.min("first")).select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

