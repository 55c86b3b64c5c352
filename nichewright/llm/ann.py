"""Approximate nearest neighbours by additive quantisation.

A vector, scaled to length 1, is written as the sum of one word from each of several codebooks of full dimension.  Each codebook is
fitted to what the ones before leave over, by k-means; encoding keeps the best ``beam`` partial sums from book to book.  The index
holds a byte for each book, the length of the sum and the cosine of the vector and its sum.  A search looks up the query's products
with all words once, adds them by a row's bytes and divides by the stored length.  The ``rerank`` best rows of the whole index then get
their exact cosine.  The ``k``-th of these is a query's bound: a second pass over the codes lets go of each row that can't reach it, since
the angle of query and vector differs from that of query and sum by that of vector and sum at most, and gives the others their
exact cosine.  So the result is that of brute force for any data; how well words fit it decides how many rows are let go only.

Scale: the codebooks are fitted to a sample of at most ``train_rows`` vectors; every vector is indexed and every row is scored for
every query.  The index is a table in the shared folder, dealt into chunks of at most ``chunk`` rows; the queries go to every chunk,
are scored there in small blocks, and send back at most ``rerank`` approximate scores a chunk.  With n chunks the first sqrt(n) are
searched ahead of the others, which then send back only scores that are not below a query's ``rerank``-th best so far: about
2 sqrt(n) times ``rerank`` candidates a query instead of n times, and the same result.  The second pass holds the vectors of a chunk
too, 64 MB at most, and sends back ``k`` rows a query and chunk at most.  Neither rows nor queries pass the driver, and results depend on neither chunks, partitions nor batches.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id or of another
length than most; rows that share an id are indexed and asked each, and are each other's candidates; equal scores go by the smaller
id; queries with fewer candidates get all of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichewright.llm.shared import few, materialise, partitions
from nichewright.llm.text_features import draw_edge


class Codebooks:
    """words: (books, size, dimension).  Only they are sent to the workers; each makes the inner products, which are larger, itself."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __getstate__(self) -> dict:
        return {"words": self.words}

    @cached_property
    def products(self) -> np.ndarray:
        """The inner products of all words with all words."""
        flat = self.words.reshape(-1, self.words.shape[2])
        return flat @ flat.T

    @classmethod
    def fit(cls, x: np.ndarray, books: int, size: int, rounds: int = 8, seed: int = 5) -> Codebooks:
        rng, rest, words = np.random.default_rng(seed), x.astype(np.float32).copy(), []
        for _ in range(books):
            word = rest[rng.choice(len(rest), size, replace=len(rest) < size)].copy()
            for _ in range(rounds):
                near = _nearest(rest, word)
                total = np.zeros_like(word)
                np.add.at(total, near, rest)
                count = np.bincount(near, minlength=size)
                word[count > 0] = total[count > 0] / count[count > 0, None]
            rest -= word[_nearest(rest, word)]
            words.append(word)
        return cls(np.stack(words))

    def encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of the sum) of unit vectors, keeping the ``beam`` best partial sums."""
        books, size, _ = self.words.shape
        flat = self.words.reshape(books * size, -1)
        gain = 2 * (x @ flat.T) - np.diag(self.products)  # |x|^2 - |x - word|^2
        n = len(x)
        codes, value = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for m in range(books):
            step = value[:, :, None] + gain[:, None, m * size : (m + 1) * size]
            for j in range(m):
                step = step - 2 * self.products[codes[:, :, j] + j * size, m * size : (m + 1) * size]
            wide = step.reshape(n, -1)
            keep = min(beam, wide.shape[1])
            best = np.argpartition(-wide, keep - 1, axis=1)[:, :keep]
            value = np.take_along_axis(wide, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // size)[:, :, None], 1), (best % size)[:, :, None]], 2)
        best = codes[np.arange(n), value.argmax(1)]
        total = sum(self.words[m][best[:, m]] for m in range(books))
        return best.astype(np.uint8), np.maximum(np.sqrt((total * total).sum(1)), 1e-12)


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    bias = (words * words).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ words.T - bias).argmax(1) for i in range(0, len(x), 4096)])


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _unit64(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _unit(x: np.ndarray) -> np.ndarray:
    return _unit64(x).astype(np.float32)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines along the last axis in double precision; a row's result doesn't depend on its neighbours.

    Vectors are first scaled by powers of two, which is exact, so that no square over- or underflows; products are added from the
    first component to the last, so that SQL can do the same sum.
    """
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(-1, keepdims=True))[1]) for v in (x, y))
    dot = lambda a, b: functools.reduce(np.add, np.moveaxis(a * b, -1, 0))
    return dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))


def usable(vectors: DataFrame, vector: Column) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = vectors.select("vec_id", vector.cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def build_index(vectors: DataFrame, books: int = 16, size: int = 256, beam: int = 4, train_rows: int = 10_000) -> tuple[DataFrame, Codebooks | None]:
    """The index (row, vec_id, v, codes, length, fit) of usable rows, written to the shared folder, and its codebooks.

    ``fit`` is the cosine of a vector and the sum of its words, -1 where that sum is too short to have a direction.
    """
    draw = F.xxhash64("vec_id", "v")
    sample = vectors.where(draw < draw_edge(vectors.count(), train_rows)).orderBy(draw, "vec_id").limit(train_rows).select("v").toArrow()
    if not sample.num_rows:
        return vectors, None
    d = len(sample["v"][0])
    model = Codebooks.fit(_unit(_matrix(sample["v"], d)), books, size)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                piece = batch.slice(start, 1000)
                v = _matrix(piece.column("v"), d)
                codes, length = model.encode(_unit(v), beam)
                total = sum(model.words[m][codes[:, m]].astype(np.float64) for m in range(books))
                length = np.where(length > 1e-3, np.sqrt((total * total).sum(1)), length)
                fit = np.where(length > 1e-3, (_unit64(v) * total).sum(1) / length, -1.0)
                yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("vec_id"), piece.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(fit)], ["row", "vec_id", "v", "codes", "length", "fit"])

    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    return materialise(numbered.mapInArrow(encode, "row long, vec_id long, v array<double>, codes binary, length double, fit double"), "ann-index"), model


def _best(approx: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` largest entries of every row, the first ones where entries are equal."""
    n = approx.shape[1]
    if n <= keep:
        return np.tile(np.arange(n), (len(approx), 1))
    at = np.argpartition(-approx, keep - 1, axis=1)[:, :keep]
    least = np.take_along_axis(approx, at, 1).min(1)
    for i in np.flatnonzero((approx >= least[:, None]).sum(1) > keep):
        above = np.flatnonzero(approx[i] > least[i])
        at[i] = np.concatenate([above, np.flatnonzero(approx[i] == least[i])[: keep - len(above)]])
    return at


class _Chunk:
    """The codes of one chunk's rows, in the order of their ids, and the search for the best of them."""

    def __init__(self, model: Codebooks, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        self.words, books = model.words, len(model.words)
        self.row, self.vec_id = rows["row"].to_numpy(), rows["vec_id"].to_numpy()
        self.codes = np.ascontiguousarray(np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(-1, books).T)
        self.length = rows["length"].to_numpy().astype(np.float32)

    def best(self, asked: np.ndarray, queries: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, approximate cosine) of the ``keep`` best rows for each query but its own row, ``asked``; among equal ones those with
        the smaller ids."""
        # Without BLAS, whose last bits depend on how many queries are asked at once: bounds compare scores of different blocks.
        table = np.einsum("qd,mkd->mqk", _unit(queries), self.words)
        place, score = np.zeros((len(asked), 0), np.int64), np.zeros((len(asked), 0), np.float32)
        for start in range(0, len(self.row), 8192):
            span = slice(start, start + 8192)
            approx = table[0][:, self.codes[0, span]]
            for m in range(1, len(table)):
                approx += table[m][:, self.codes[m, span]]
            approx /= self.length[span]
            approx[asked[:, None] == self.row[None, span]] = -np.inf
            score = np.concatenate([score, approx], 1)
            place = np.concatenate([place, np.broadcast_to(np.arange(start, start + approx.shape[1]), approx.shape)], 1)
            at = np.sort(_best(score, keep), axis=1)
            score, place = np.take_along_axis(score, at, 1), np.take_along_axis(place, at, 1)
        return place, score


    def answer(self, piece: pa.RecordBatch, keep: int) -> pa.RecordBatch:
        """CANDIDATE for a batch of queries."""
        asking, ids = piece.column("row").to_numpy(), piece.column("vec_id").to_numpy()
        place, score = self.best(asking, _matrix(piece.column("v"), self.words.shape[2]), keep)
        i, j = np.nonzero(np.isfinite(score) & (score >= piece.column("bound").to_numpy()[:, None]))
        found = place[i, j]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (asking[i], ids[i], self.row[found], score[i, j].astype(np.float64), self.vec_id[found])], ["asked", "query_id", "row", "approx", "vec_id"])


#: More than rounding adds to a bound or to an inner product of unit vectors in double precision.
SLACK = 1e-9


class _ExactChunk(_Chunk):
    """A chunk that holds its vectors as well, and gives those rows their exact cosine that can reach a query's bound."""

    def __init__(self, model: Codebooks, parts: list[pa.RecordBatch]):
        super().__init__(model, parts)
        rows = pa.Table.from_batches(parts)
        self.length = rows["length"].to_numpy()
        self.fit = np.maximum(rows["fit"].to_numpy() - SLACK, -1.0)
        self.apart = np.sqrt(np.maximum(1 - self.fit * self.fit, 0))
        self.v = _matrix(rows["v"], self.words.shape[2])
        self.unit = _unit64(self.v)

    def reach(self, table: np.ndarray, span: slice) -> np.ndarray:
        """The largest cosine that each row of ``span`` can have to each query: that of the angle to its sum less that of its sum."""
        approx = sum(table[m][:, self.codes[m, span]] for m in range(len(table))) / self.length[span]
        approx = np.clip(approx + SLACK, -1.0, 1.0)
        return np.where(approx >= self.fit[span], 1.0, approx * self.fit[span] + np.sqrt(1 - approx * approx) * self.apart[span]) + SLACK

    def answer(self, piece: pa.RecordBatch, keep: int) -> pa.RecordBatch:
        """FOUND for a batch of queries: of this chunk the ``keep`` nearest rows that reach the bound; ties go to smaller ids."""
        asked, ids, bound = (piece.column(c).to_numpy(zero_copy_only=False).copy() for c in ("row", "vec_id", "bound"))
        q = _matrix(piece.column("v"), self.words.shape[2])
        unit = _unit64(q)
        table = np.einsum("qd,mkd->mqk", unit, self.words.astype(np.float64), optimize=True)
        at, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(self.row), 4096):
            span = slice(start, start + 4096)
            may = (self.reach(table, span) >= bound[:, None]) & (asked[:, None] != self.row[None, span])
            some = np.flatnonzero(may.any(0))
            i, j = np.nonzero(may[:, some] & (unit @ self.unit[span][some].T >= bound[:, None] - SLACK))
            j = some[j] + start
            exact = np.concatenate([np.zeros(0), *(cosine(q[i[n : n + 8192]], self.v[j[n : n + 8192]]) for n in range(0, len(i), 8192))])
            at, place, score = np.concatenate([at, i]), np.concatenate([place, j]), np.concatenate([score, exact])
            # Places go by (vec_id, row), so equal scores keep the smaller ids.
            order = np.lexsort((place, -score, at))
            at, place, score = at[order], place[order], score[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            bound[at[rank == keep - 1]] = np.maximum(bound[at[rank == keep - 1]], score[rank == keep - 1])
            at, place, score = at[rank < keep], place[rank < keep], score[rank < keep]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (asked[at], ids[at], self.row[place], score, self.vec_id[place])], ["asked", "query_id", "row", "score", "vec_id"])


CANDIDATE = "asked long, query_id long, row long, approx double, vec_id long"
FOUND = "asked long, query_id long, row long, score double, vec_id long"


def candidates(index: DataFrame, queries: DataFrame, model: Codebooks, rerank: int, chunk: int) -> DataFrame:
    """CANDIDATE: for each query (row ``asked``) the ``rerank`` rows of the whole index with the best approximate cosines."""
    # As few chunks as memory allows, since each sends back candidates for every query.
    n = max(-(-index.count() // chunk), 1)
    first = math.isqrt(n - 1) + 1
    best = Window.partitionBy("asked").orderBy(F.desc("approx"), "vec_id", "row")
    top = lambda found: found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= rerank)
    no_bound = queries.withColumn("bound", F.lit(float("-inf")))
    if first == n:
        return top(_searched(index, no_bound, model, rerank, n, range(n))).drop("place")
    ahead = materialise(top(_searched(index, no_bound, model, rerank, n, range(first))), "ann-ahead")
    bounds = ahead.where(F.col("place") == rerank).select(F.col("asked").alias("row"), F.col("approx").alias("bound"))
    bounded = queries.join(bounds, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    others = _searched(index, materialise(bounded, "ann-bounds"), model, rerank, n, range(first, n))
    return top(ahead.drop("place").unionByName(others)).drop("place")


def _searched(index: DataFrame, queries: DataFrame, model: Codebooks, rerank: int, n: int, chunks: range) -> DataFrame:
    """CANDIDATE: each query's ``rerank`` best rows of each of the given chunks (of n), as far as they reach its ``bound``."""
    # Where chunks leave tasks without work, a chunk's codes go to several tasks, and each of them takes a share of the queries.
    shares = max(partitions(index.sparkSession) // len(chunks), 1)
    return _met(index.withColumn("v", F.lit(None).cast("array<double>")), queries, model, rerank, n, chunks, shares, _Chunk, CANDIDATE)


def reached(index: DataFrame, queries: DataFrame, model: Codebooks, k: int, chunk: int) -> DataFrame:
    """FOUND: of each chunk the ``k`` nearest rows of a query whose exact cosine reaches its ``bound``.

    There are as many chunks as tasks at least, since vectors are longer than codes: here queries are copied rather than a chunk.
    """
    chunk = max(min(chunk, (64 << 20) // (8 * model.words.shape[2])), 1)
    n = max(-(-index.count() // chunk), partitions(index.sparkSession))
    return _met(index, queries, model, k, n, range(n), 1, _ExactChunk, FOUND)


def _met(index: DataFrame, queries: DataFrame, model: Codebooks, keep: int, n: int, chunks: range, shares: int, kind_of: type[_Chunk], schema: str) -> DataFrame:
    """What chunks (of n), each held by ``shares`` tasks, answer to the queries (row, vec_id, v, bound)."""
    upto = lambda low, k: F.explode(F.sequence(F.lit(low).cast("long"), F.lit(k - 1).cast("long")))
    no = lambda kind: F.lit(None).cast(kind)
    coded = index.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(n))).where(F.col("c").between(chunks.start, chunks.stop - 1))
    coded = coded.select("c", upto(0, shares).alias("s"), F.lit(0).alias("kind"), "row", "vec_id", "codes", "length", "fit", "v", no("double").alias("bound"))
    asked = queries.select(upto(chunks.start, chunks.stop).alias("c"), F.pmod(F.xxhash64("row", F.lit(n)), F.lit(shares)).alias("s"), F.lit(1).alias("kind"), "row", "vec_id", no("binary").alias("codes"), no("double").alias("length"), no("double").alias("fit"), "v", "bound")
    dealt = coded.unionByName(asked).withColumn("chunk", F.col("c") * shares + F.col("s")).drop("c", "s")
    met = dealt.select("chunk", *dealt.columns[:-1]).repartition(partitions(index.sparkSession), "chunk").sortWithinPartitions("chunk", "kind", "vec_id", "row")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, own = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("chunk").to_numpy() * 2 + batch.column("kind").to_numpy()
            for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]):
                piece, (at, kind) = batch.slice(a, b - a), divmod(int(key[a]), 2)
                if at != held:
                    held, parts, own = at, [], None
                if not kind:
                    parts.append(piece)
                    continue
                if not parts:
                    continue
                own = own or kind_of(model, parts)
                for start in range(0, piece.num_rows, 256):
                    yield own.answer(piece.slice(start, 256), keep)

    return met.mapInArrow(search, schema)


def nearest(vectors: DataFrame, is_query: Column, vector: Column, k: int = 5, rerank: int = 200, chunk: int = 1 << 20, **index_options) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` selects the ``k`` nearest others by cosine."""
    index, model = build_index(usable(vectors, vector), **index_options)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = model.words.shape[2]
    queries = materialise(index.where(is_query).select("row", "vec_id", "v"), "ann-queries")
    found = materialise(candidates(index, queries, model, max(rerank, k), chunk), "ann-candidates")
    # A table of vectors is broadcast up to 64 MB.
    asked = few(queries.select(F.col("row").alias("asked"), F.col("v").alias("q")), (64 << 20) // (8 * d))
    pairs = index.select("row", "v").join(few(found), "row").join(asked, "asked").select("asked", "q", "v")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                some = batch.slice(start, 2000)
                score = cosine(_matrix(some.column("q"), d), _matrix(some.column("v"), d))
                yield pa.RecordBatch.from_arrays([some.column("asked"), pa.array(score)], ["asked", "score"])

    scored = pairs.mapInArrow(exact, "asked long, score double")
    kth = scored.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score")))).where(F.col("rank") == k)
    bounds = kth.select(F.col("asked").alias("row"), F.col("score").alias("bound"))
    bounded = materialise(queries.join(bounds, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))), "ann-reached")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row")
    return reached(index, bounded, model, k, chunk).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(every: int = 50, k: int = 5) -> str:
    """The ``k`` nearest by brute force over the view ``embeddings``: what a search finds wherever its recall is 1."""
    fine = "vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))) AND list_bool_or(list_transform(embedding, lambda e: e <> 0))"
    dot = lambda a, b: f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]), lambda s, p: s + p)"
    return f"""
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS at_, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {fine}),
u AS MATERIALIZED (SELECT at_, vec_id, v, sqrt({dot('v', 'v')}) AS norm FROM r WHERE len(v) = (SELECT len(v) FROM r GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)),
pairs AS (SELECT q.at_, q.vec_id AS query_id, c.vec_id, {dot('q.v', 'c.v')} / (q.norm * c.norm) AS score FROM u q JOIN u c ON q.at_ <> c.at_ WHERE q.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY at_ ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""
