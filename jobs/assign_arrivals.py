"""Niches of arriving cells: a stream of files, each cell taking the niche of the nearest reference landmark.

    python -m jobs.assign_arrivals --input TABLES --output OUT [--config jobs/assign_arrivals.json] [--checkpoint DIR]

A cohort grows by files of cells with a sample, a vector and, where it is known, a label.  The first run chooses the reference:
``landmarks`` cells, shared evenly among samples, and their labels, and keeps it in ``OUT/reference``, so that later runs compare with the
same one.  Every run then takes the files that arrived since the one before, whose names the checkpoint of the file stream holds,
assigns their cells, and ends.  It writes

* ``OUT/assigned`` (row_idx, landmark, niche, distance, score, batch, sample_id), partitioned by batch and sample: the squared distance
  to the nearest landmark and the margin to the second nearest, (d2 - d1) / max(d2, 1e-8) within [0, 1];
* ``OUT/counts`` (sample_id, niche, cells, batch), partitioned by batch.

A run without new files writes nothing.  A run that was broken off is continued by the next: the checkpoint repeats the unfinished
batch with the same files under the same number, and its partitions are replaced, so that no cell is lost or doubled.

Scale: a batch is joined with nothing but the landmarks, at most 20,000 rows that are sent to every task; its rows are shuffled once by
id, and once to the files of their sample, ``files_per_sample`` at most.  ``files_per_batch`` bounds how much one batch takes.

Cases: cells without an id or with a vector that is null, of another length than the reference's, or holds a null or non-finite
component are left out and logged; a null sample is ``__none__``; of rows of a batch that share an id the least by sample and vector
counts; a cell that arrives again is assigned again in its own batch, and ``current`` gives the newest row of each; a landmark
without a label gives a null niche; where no cell has been read yet there is no reference, and nothing is written.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import counted, log, main, written
from nichewright.functions.portable import finite, squared_distance_sql, uniform_sql
from nichewright.operators import assignment

MOST_LANDMARKS = 20_000
NO_SAMPLE = "__none__"
ASSIGNED = "row_idx long, landmark long, niche int, distance double, score double, batch long, sample_id string"
COUNTS = "sample_id string, niche int, cells long, batch long"


@dataclass(frozen=True)
class Settings:
    table: str = "embeddings"
    row: str = "vec_id"
    sample: str = "label"
    vector: str = "embedding"
    label: str = "label"
    landmarks: int = 40
    candidates: int = 2
    seed: int = 1337
    files_per_batch: int = 1000
    files_per_sample: int = 16

    def __post_init__(self):
        if not 1 <= self.landmarks <= MOST_LANDMARKS or self.candidates < 2 or self.files_per_batch < 1 or self.files_per_sample < 1:
            raise ValueError(f"landmarks must be 1 to {MOST_LANDMARKS}, candidates 2 at least, and the other numbers positive")


def cells_of(rows: DataFrame, s: Settings) -> DataFrame:
    """(row_idx, sample_id, label, z) of arriving rows."""
    sample = F.coalesce(F.col(s.sample).cast("string"), F.lit(NO_SAMPLE))
    return rows.select(F.col(s.row).cast("long").alias("row_idx"), sample.alias("sample_id"), F.col(s.label).cast("int").alias("label"), F.col(s.vector).cast("array<double>").alias("z"))


def usable(length: int | None) -> Column:
    """Whether a cell has an id and a finite vector, of the given length."""
    wanted = F.size("z") == length if length else F.size("z") > 0
    return F.coalesce(F.col("row_idx").isNotNull() & wanted & F.forall("z", finite), F.lit(False))


def choose_reference(cells: DataFrame, s: Settings) -> DataFrame:
    """(row_idx, sample_id, niche, z): landmarks of the usable cells that share the commonest length; the least row of each id."""
    good = cells.where(usable(None))
    length = good.groupBy(F.size("z").alias("d")).count().orderBy(F.desc("count"), "d").first()
    once = one_of_each(good.where(F.size("z") == (length["d"] if length else 0)))
    return once.join(assignment.sample_landmarks(once, s.landmarks, s.seed).select("row_idx"), "row_idx").select("row_idx", "sample_id", F.col("label").alias("niche"), "z")


def one_of_each(cells: DataFrame) -> DataFrame:
    return cells.groupBy("row_idx").agg(F.min(F.struct("sample_id", "z", "label")).alias("c")).select("row_idx", "c.sample_id", "c.z", "c.label")


def assigned(cells: DataFrame, reference: DataFrame, s: Settings) -> DataFrame:
    """(row_idx, sample_id, landmark, niche, distance, score) of usable cells."""
    near = assignment.landmark_candidates(cells, reference, s.candidates, MOST_LANDMARKS)
    best = assignment.landmark_margin(near.select("i", "j", F.col("distance").alias("cost")))
    labelled = assignment.propagate(best, reference.select("row_idx", "niche"), "landmark")
    return cells.select("row_idx", "sample_id").join(labelled, "row_idx").select("row_idx", "sample_id", "landmark", F.col("niche").cast("int").alias("niche"), F.col("cost").alias("distance"), "score")


def assign_arrivals(spark: SparkSession, path: str, output: str, settings: Settings | None = None, checkpoint: str | None = None) -> dict:
    """Assigns the cells of files that are new below ``path``; returns the batches with the rows that were read and written."""
    s, output = settings or Settings(), output.rstrip("/")
    source, kept = f"{path.rstrip('/')}/{s.table}.parquet", f"{output}/reference"
    arriving = spark.read.parquet(source)
    if written(spark, kept) is None:
        chosen, count = counted(choose_reference(cells_of(arriving, s), s).coalesce(1), "reference")
        chosen.write.mode("overwrite").parquet(kept)
        log.info("wrote a reference of %s landmarks to %s", count()["rows"], kept)
    reference = spark.read.parquet(kept)
    first = reference.first()
    if first is None:
        log.info("%s has no cells to choose a reference from", source)
        return {"batches": []}
    done: list[dict] = []

    def one(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        cells, read = counted(cells_of(batch, s), f"read {number}", left_out=F.count_if(~usable(len(first.z))))
        rows = assigned(one_of_each(cells.where(usable(len(first.z)))), own.read.parquet(kept), s).withColumn("batch", F.lit(number).cast("long"))
        spread, wrote = counted(rows.repartition("sample_id", F.pmod(F.xxhash64("row_idx"), F.lit(s.files_per_sample))), f"wrote {number}")
        replace(spread, f"{output}/assigned", "batch", "sample_id")
        of_batch = own.read.schema(ASSIGNED).parquet(f"{output}/assigned").where(F.col("batch") == number)
        replace(of_batch.groupBy("batch", "sample_id", "niche").agg(F.count("*").alias("cells")).coalesce(1), f"{output}/counts", "batch")
        done.append({"batch": number} | read() | {"written": wrote()["rows"]})
        log.info("batch %(batch)s: read %(rows)s cells, left out %(left_out)s, wrote %(written)s", done[-1])

    # A pattern, since the path may be a folder of files or one file, which the stream doesn't take by its plain name.
    stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", s.files_per_batch).parquet(f"{source[:-1]}[{source[-1]}]")
    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint or f"{output}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s new batches of %s went to %s", len(done), source, output)
    return {"batches": done}


def replace(rows: DataFrame, path: str, *by: str) -> None:
    """Writes ``rows`` in place of the partitions that they belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def assigned_table(spark: SparkSession, output: str) -> DataFrame:
    """All assignments as written."""
    return spark.read.schema(ASSIGNED).parquet(f"{output.rstrip('/')}/assigned")


def current(spark: SparkSession, output: str) -> DataFrame:
    """The newest assignment of every cell."""
    newest = Window.partitionBy("row_idx").orderBy(F.desc("batch"))
    return assigned_table(spark, output).withColumn("turn", F.row_number().over(newest)).where("turn = 1").drop("turn")


def totals(spark: SparkSession, output: str) -> DataFrame:
    """(sample_id, niche, cells) over all batches, from their counts."""
    return spark.read.schema(COUNTS).parquet(f"{output.rstrip('/')}/counts").groupBy("sample_id", "niche").agg(F.sum("cells").alias("cells"))


def sql(s: Settings = Settings(), dimension: int = 64) -> str:
    """The table ``assigned`` after a single batch in SQL, for ids without repeats, with doubles rounded to six places."""
    r6 = lambda e: f"(round({e}, 6) + 0.0::DOUBLE)"
    distance = squared_distance_sql("a.z", "b.z", dimension)
    return f"""WITH c AS MATERIALIZED (SELECT {s.row} AS row_idx, COALESCE(CAST({s.sample} AS VARCHAR), '{NO_SAMPLE}') AS sample_id, {s.label} AS label, CAST({s.vector} AS DOUBLE[]) AS z FROM {s.table} WHERE {s.row} IS NOT NULL AND len({s.vector}) = {dimension} AND list_bool_and(list_transform({s.vector}, lambda e: e IS NOT NULL AND isfinite(e)))),
h AS (SELECT row_idx, row_number() OVER (PARTITION BY sample_id ORDER BY {uniform_sql(s.seed, 'row_idx')}, row_idx) AS place, dense_rank() OVER (ORDER BY sample_id) - 1 AS s FROM c),
l AS MATERIALIZED (SELECT row_idx, label AS niche, z FROM c JOIN h USING (row_idx), (SELECT COUNT(DISTINCT sample_id) AS k FROM c) WHERE place <= {s.landmarks} // k + CASE WHEN s < {s.landmarks} % k THEN 1 ELSE 0 END),
d AS (SELECT a.row_idx, a.sample_id, b.row_idx AS landmark, b.niche, {distance} AS d FROM c a CROSS JOIN l b),
r AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY d, landmark) AS rank, lead(d) OVER (PARTITION BY row_idx ORDER BY d, landmark) AS second FROM d)
SELECT row_idx, landmark, niche, {r6('d')} AS distance, {r6('CASE WHEN second IS NULL THEN 1 ELSE least(greatest((second - d) / greatest(second, 1e-8), 0), 1) END')} AS score, 0::BIGINT AS batch, sample_id FROM r WHERE rank = 1"""


if __name__ == "__main__":
    main(assign_arrivals, Settings, sys.argv[1:], checkpoint="folder of the stream's checkpoint, OUT/checkpoint by default")
