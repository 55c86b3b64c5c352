"""Bounded features of whole texts for the classifiers, and the deterministic fold and sampling rules they share."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichewright.llm.shared import materialise

#: Lower-cases A-Z and turns every other ASCII byte that isn't a letter into a space; bytes of other characters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    """Lower-cased letter runs of UTF-8 bytes."""
    return raw.translate(_LETTERS).split()


class HashedWords:
    """The distinct hashed words of a text as feature indices; the hashes of recent words are kept.

    ``most_kept`` bounds what one text gives, to the least indices, where features are collected to fit a model.
    """

    def __init__(self, bits: int = 18, most: int = 100_000, most_kept: int | None = None):
        self.mask, self.most, self.most_kept, self.cache = (1 << bits) - 1, most, most_kept, {}

    def __call__(self, raw: bytes) -> np.ndarray:
        found = set(words(raw))
        if len(self.cache) + len(found) > self.most:
            self.cache = {}
        cache = self.cache
        for w in found.difference(cache):
            cache[w] = zlib.crc32(w) & self.mask
        return np.unique(np.fromiter(map(cache.__getitem__, found), np.int32, len(found)))[: self.most_kept]


#: Names of the numeric features of ``shape``, in order.
SHAPE = (
    ["log_bytes", "log_words", "log_word_length", "distinct_words", "repeated_next", "commonest_word", "distinct_lines", "log_line_length"]
    + ["letters", "upper", "digits", "spaces", "other_bytes", "sentence_ends", "word_ends_in_sign", "lone_signs"]
    + [f"byte_{c:02x}" for c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
)


def shape(raw: bytes) -> np.ndarray:
    """Numeric features of layout and repetition, each bounded; an empty text has zeros only."""
    out = np.zeros(len(SHAPE))
    n = len(raw)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    tokens, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    k = max(1, len(tokens))
    tally = Counter(tokens)
    ends = [t[-2:] for t in tokens]
    signed = sum(1 for e in ends if len(e) == 2 and e in _SIGN_PAIRS)
    lone = sum(tally.get(s, 0) for s in _SIGNS)
    out[:16] = [
        np.log1p(n) / 10,
        np.log1p(k) / 10,
        np.log1p(n / k) / 3,
        len(tally) / k,
        sum(map(bytes.__eq__, tokens, tokens[1:])) / k,
        max(tally.values(), default=0) / k,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))) / 10,
        (counts[65:91].sum() + counts[97:123].sum()) / n,
        counts[65:91].sum() / n,
        counts[48:58].sum() / n,
        (counts[32] + counts[9:14].sum()) / n,
        counts[128:].sum() / n,
        (counts[46] + counts[33] + counts[63]) / k,
        signed / k,
        lone / k,
    ]
    out[16:] = np.sqrt(counts[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] / k)
    return out


_SIGN_BYTES = [bytes([c]) for c in range(33, 127) if not bytes([c]).isalnum()]
_SIGNS = frozenset(_SIGN_BYTES)
_SIGN_PAIRS = frozenset(a + b for a in _SIGN_BYTES for b in _SIGN_BYTES if a == b)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: fold 0 is held out; a null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: one for each id, a null or contradictory label drops out."""
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .drop("most")
    )


def hashed_sample(rows: DataFrame, size: int, salt: int) -> DataFrame:
    """The ``size`` rows (doc_id) with the smallest keyed hash: a bounded sample that any run finds again.

    The rows are counted first, so that little more than the sample itself is sorted, however many rows and partitions there are.
    """
    rows, draw = materialise(rows, "sample"), F.xxhash64("doc_id", F.lit(salt))
    return rows.where(draw < draw_edge(rows.count(), size)).orderBy(draw, "doc_id").limit(size)


def draw_edge(rows: int, size: int) -> int:
    """The signed 64-bit hash below which ``size`` of so many rows or some more lie, but for a chance below one in a billion."""
    share = min(1.0, (size + 6 * size**0.5 + 50) / max(1, rows))
    return min(2**63 - 1, int(share * 2**64) - 2**63)


def collect_features(documents: DataFrame, ids: DataFrame, featurise, value_type: pa.DataType) -> list[tuple[int, int, np.ndarray]]:
    """(doc_id, group, features) for the bounded ``ids`` (doc_id, group), computed where the texts are.

    Only features reach the driver, those of one row an id: of rows that share it, the text with the least hash.
    """
    raw = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    one = F.min(F.struct(F.xxhash64("raw").alias("draw"), "raw"))["raw"]  # combined before the shuffle, however often an id recurs
    wanted = raw.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "group").agg(one.alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = featurise()
        for batch in batches:
            found = pa.array([make(x) for x in batch.column("raw").to_pylist()], pa.list_(value_type))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("group"), found], ["doc_id", "group", "features"])

    kind = "int" if pa.types.is_integer(value_type) else "double"
    rows = wanted.select("doc_id", "group", "raw").mapInArrow(run, f"doc_id long, group int, features array<{kind}>").toArrow()
    order = np.lexsort((rows["group"].to_numpy(), rows["doc_id"].to_numpy()))
    ids_, groups, values = rows["doc_id"].to_pylist(), rows["group"].to_pylist(), rows["features"].combine_chunks()
    flat, offsets = values.values.to_numpy(), values.offsets.to_numpy()
    return [(ids_[i], groups[i], flat[offsets[i] : offsets[i + 1]]) for i in order]


def score_texts(texts: Column, scorer) -> Column:
    """A double for each text by ``scorer()(raw bytes)``; null counts as empty."""
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = scorer()
        for batch in batches:
            yield pa.array((score(x.as_py()) for x in batch), pa.float64(), size=len(batch))

    return scored(F.coalesce(texts, F.lit("")).cast("binary"))
