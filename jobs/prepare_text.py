"""Features of a text cohort: ``documents`` are the cells, their sources the samples and their words the genes.

    python -m jobs.prepare_text --input TABLES --output OUT [--config jobs/prepare_text.json] [--samples a,b]

What ``prepare-inputs`` does to the counts of a cohort, from raw text: words are counted, the ``panel_size`` words that most documents
have become the panel, counts are divided by a document's number of words and put on a log scale, and every panel word is standardised
over the whole cohort, absent words counting as zeros.  Two tables are written:

* ``features`` (sample_id, row_idx, gene, value, normalised, scaled), partitioned by sample: a row for each panel word of a document,
  in ``files_per_sample`` files a sample at most;
* ``samples`` (sample_id, cells, words, panel_words, distinct_genes).

Scale: texts are read twice, once for the panel and once for the counts.  The first time words are combined before they are shuffled;
the second time a document's panel words go as numbers in arrays, a row for each document, and become rows where they are written.
Ids that several rows share are added up word by word.  The panel is a table of at most ``panel_size`` rows, which may not exceed
20,000, and is sent to every task.  A sample of any size is spread over its files.

A rerun replaces what it writes by the same rows.  With ``--samples`` only the partitions of these samples are replaced (panel and
scales still come from the whole cohort) and ``samples`` is left alone.

Cases: documents without an id are left out and logged; a null text has no words; rows that share an id and a source are one
document; a null source is the sample ``__none__``; an empty table gives empty tables.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import counted, log, main
from nichewright.operators import features
from nichewright.plans.storage import materialise

MOST_PANEL = 20_000
NO_SAMPLE = "__none__"
#: Words are runs of anything but ASCII white space, with A-Z lower-cased.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Different words that a task holds before it hands on what it has counted.
MOST_WORDS = 200_000
FEATURES = "row_idx long, gene string, value double, normalised double, scaled double, sample_id string"


@dataclass(frozen=True)
class Settings:
    table: str = "documents"
    row: str = "doc_id"
    sample: str = "source"
    text: str = "text"
    panel_size: int = 2000
    least_documents: int = 2
    target_sum: float = 10_000.0
    files_per_sample: int = 16

    def __post_init__(self):
        if not 1 <= self.panel_size <= MOST_PANEL or self.least_documents < 1 or self.files_per_sample < 1 or not self.target_sum > 0:
            raise ValueError(f"panel_size must be 1 to {MOST_PANEL}, and the other numbers positive")


def cells_of(spark: SparkSession, path: str, s: Settings) -> DataFrame:
    """(row_idx, sample_id, text) of the table's rows."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/{s.table}.parquet")
    return rows.select(F.col(s.row).cast("long").alias("row_idx"), F.coalesce(F.col(s.sample).cast("string"), F.lit(NO_SAMPLE)).alias("sample_id"), F.coalesce(F.col(s.text), F.lit("")).cast("binary").alias("text"))


def _split(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The words of each text: of bytes, only A-Z are lower-cased and only ASCII white space splits, as ``WORD`` has it."""
    return (text.as_py().lower().split() for text in batch.column("text"))


def panel_of(cells: DataFrame, s: Settings) -> DataFrame:
    """(gene, documents): the words that most rows have, ties to the smaller word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda c: pa.RecordBatch.from_pydict({"gene": pa.array(list(c), pa.binary()).cast(pa.string()), "n": pa.array(list(c.values()), pa.int64())})
        seen: Counter = Counter()
        for batch in batches:
            for words in _split(batch):
                seen.update(set(words))
                if len(seen) >= MOST_WORDS:
                    yield made(seen)
                    seen = Counter()
        yield made(seen)

    seen = cells.select("text").mapInArrow(run, "gene string, n long").groupBy("gene").agg(F.sum("n").alias("documents"))
    return seen.where(F.col("documents") >= s.least_documents).orderBy(F.desc("documents"), "gene").limit(s.panel_size)


def counts_of(cells: DataFrame, panel: list[str]) -> DataFrame:
    """(row_idx, sample_id, total, genes, ns): the number of words of each row, the places in ``panel`` of its words there and how often it has each."""
    place = {gene.encode(): n for n, gene in enumerate(panel)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, ends, genes, ns = [], [0], [], []
            for words in _split(batch):
                totals.append(len(words))
                for word, n in Counter(words).items():
                    if (at := place.get(word)) is not None:
                        genes.append(at)
                        ns.append(n)
                ends.append(len(genes))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)) for v, kind in ((genes, pa.int32()), (ns, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("row_idx"), batch.column("sample_id"), pa.array(totals, pa.int64()), *lists], ["row_idx", "sample_id", "total", "genes", "ns"])

    return cells.mapInArrow(run, "row_idx long, sample_id string, total long, genes array<int>, ns array<long>")


def documents_of(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sample_id, row_idx, total, genes, ns) of documents, whose ``rows`` in ``sizes`` are added up where they are several."""
    by = ["sample_id", "row_idx"]
    joined = counts.drop("total").join(sizes, by)
    columns = [*by, "total", "genes", "ns"]
    several = joined.where("rows > 1").select(*by, "total", F.explode(F.arrays_zip("genes", "ns")).alias("w"))
    added = several.groupBy(*by, "total", F.col("w.genes").alias("gene")).agg(F.sum("w.ns").alias("n")).groupBy(*by, "total").agg(F.collect_list(F.struct("gene", "n")).alias("w"))
    return joined.where("rows = 1").select(columns).unionByName(added.select(*by, "total", F.col("w.gene").alias("genes"), F.col("w.n").alias("ns")))


def prepare(spark: SparkSession, path: str, output: str, settings: Settings | None = None, samples: str | None = None) -> dict:
    """Writes the tables ``features`` and ``samples`` of the documents below ``path``; returns what was read and written."""
    s, output = settings or Settings(), output.rstrip("/")
    raw, read = counted(cells_of(spark, path, s), "read", without_id=F.count_if(F.col("row_idx").isNull()))
    genes = [r.gene for r in panel_of(raw.where("row_idx IS NOT NULL"), s).collect()]  # panel_size rows
    panel = spark.createDataFrame(list(enumerate(genes)), "at int, gene string")
    counts = materialise(counts_of(cells_of(spark, path, s).where("row_idx IS NOT NULL"), genes), "text-words")
    sizes = materialise(counts.groupBy("sample_id", "row_idx").agg(F.sum("total").alias("total"), F.count("*").alias("rows")), "text-sizes")
    cells = materialise(documents_of(counts, sizes), "text-counts")

    def valued(own: DataFrame) -> DataFrame:
        entries = own.select("sample_id", "row_idx", "total", F.explode(F.arrays_zip("genes", "ns")).alias("w"))
        values = entries.select("sample_id", "row_idx", "total", F.col("w.genes").alias("at"), F.col("w.ns").cast("double").alias("value"))
        return values.withColumn("normalised", features.log_normalised(F.col("value"), F.col("total"), s.target_sum))

    stats = materialise(features.sparse_column_stats(valued(cells), sizes.count(), "at").join(panel, "at"), "text-stats")  # a row for each panel word
    if samples:
        cells = cells.where(F.col("sample_id").isin(samples.split(",")))
    # Documents go to their files as arrays, and become rows there.
    dealt = cells.repartition("sample_id", F.pmod(F.xxhash64("row_idx"), F.lit(s.files_per_sample)))
    scaled = valued(dealt).join(F.broadcast(stats), "at").withColumn("scaled", (F.col("normalised") - F.col("mean")) / F.col("scale"))
    made = scaled.select("row_idx", "gene", "value", "normalised", "scaled", "sample_id")
    made, wrote = counted(made, "features")
    writer = made.write.mode("overwrite").partitionBy("sample_id").option("compression", "zstd")
    writer.option("partitionOverwriteMode", "dynamic" if samples else "static").parquet(f"{output}/features")
    done = {"read": read(), "panel": len(genes), "features": wrote()["rows"]}
    log.info("read %(rows)s rows of %(table)s, %(without_id)s without an id", done["read"] | {"table": f"{path}/{s.table}"})
    log.info("wrote %s features of %s panel words to %s/features", done["features"], done["panel"], output)
    if not samples:
        of_features = features_table(spark, output).groupBy("sample_id").agg(F.sum("value").cast("long").alias("panel_words"), F.count_distinct("gene").alias("distinct_genes"))
        summary = sizes.groupBy("sample_id").agg(F.count("*").alias("cells"), F.sum("total").alias("words")).join(of_features, "sample_id", "left").fillna(0, ["panel_words", "distinct_genes"])
        summary, rows = counted(summary, "samples")
        summary.coalesce(1).write.mode("overwrite").parquet(f"{output}/samples")  # a row a sample
        done["samples"] = rows()["rows"]
        log.info("wrote %s samples to %s/samples", done["samples"], output)
    return done


def features_table(spark: SparkSession, output: str) -> DataFrame:
    """The table ``features`` as written; the schema is given, since a sample's name may look like a number."""
    return spark.read.schema(FEATURES).parquet(f"{output.rstrip('/')}/features")


def sql(s: Settings = Settings()) -> str:
    """The table ``features`` in SQL, with doubles rounded to six places."""
    r6 = lambda e: f"(round({e}, 6) + 0.0::DOUBLE)"
    return f"""WITH c AS MATERIALIZED (SELECT row_number() OVER () AS at_, CAST({s.row} AS BIGINT) AS row_idx, COALESCE({s.sample}, '{NO_SAMPLE}') AS sample_id, regexp_extract_all(translate(COALESCE({s.text}, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM {s.table} WHERE {s.row} IS NOT NULL),
w AS MATERIALIZED (SELECT at_, row_idx, sample_id, unnest(words) AS gene FROM c),
p AS MATERIALIZED (SELECT gene FROM (SELECT gene, COUNT(DISTINCT at_) AS documents FROM w GROUP BY gene) WHERE documents >= {s.least_documents} ORDER BY documents DESC, gene LIMIT {s.panel_size}),
z AS MATERIALIZED (SELECT sample_id, row_idx, SUM(len(words)) AS total FROM c GROUP BY 1, 2),
v AS MATERIALIZED (SELECT sample_id, row_idx, gene, COUNT(*)::DOUBLE AS value, ln(1.0::DOUBLE + COUNT(*) * {s.target_sum}::DOUBLE / max(total)) AS normalised FROM w JOIN p USING (gene) JOIN z USING (sample_id, row_idx) GROUP BY 1, 2, 3),
m AS (SELECT gene, SUM(normalised) / n AS mean, SUM(normalised * normalised) / n AS square FROM v, (SELECT COUNT(*)::DOUBLE AS n FROM z) GROUP BY gene, n),
d AS (SELECT gene, mean, sqrt(greatest(square - mean * mean, 0)) AS s FROM m)
SELECT sample_id, row_idx, gene, value, {r6('normalised')} AS normalised, {r6('(normalised - mean) / CASE WHEN s <= 1e-8 THEN 1 ELSE s END')} AS scaled FROM v JOIN d USING (gene)"""


if __name__ == "__main__":
    main(prepare, Settings, sys.argv[1:], samples="comma-separated samples whose partitions are to be replaced")
