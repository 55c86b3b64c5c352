"""A training corpus from the table ``documents``: STAGES in order, each written as Parquet and read again by the next.

Every stage works on all that the one before kept.  All but the last return the columns of ``documents``:

1. ``toxicity`` drops documents that the non-negative positive-unlabelled model scores 0.5 or more.
2. ``quality`` drops documents that the pairwise ranking scores below 0.3.
3. ``near_copies`` keeps one document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, the
   one with the smallest id.  SimHash fingerprints of 4 differing bits or fewer, linked through anchors, are candidates, and so are
   texts that share a MinHash band: SimHash alone finds a small part of the pairs at 0.8.
4. ``mixing`` takes whole documents, up to twice each, to the sources' targets and puts them in training order.
5. ``pieces`` adds the ids of a seeded merge-dropout segmentation (``piece_ids``), which decode to the text exactly; both
   copies of a document are segmented on their own, by their places in the training order.  ``training_place`` ascends in that order,
   which files of Parquet don't keep when they are read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nichewright.llm.dedup import drop_near_copies
from nichewright.llm.mixing import mixed_documents
from nichewright.llm.pieces import encode_documents
from nichewright.llm.quality import drop_poor
from nichewright.llm.shared import table, work_dir
from nichewright.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_poor(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, weights=(5, 2, 1), share=1.5, most_repeats=2)


def _training_place(docs: DataFrame) -> Column:
    """A number that ascends in the order of the files that ``docs`` was read from, and of the rows in them.

    A task of the mixing stage, which is a range of its order, writes ``part-<task>-<id>-c<file>``; 20, 12 and 31 bits hold the task,
    its file and the row, and more of any is an error.  Files of other names come in the order of a hash of their names, and
    rows that aren't read from files in that of the DataFrame's partitions.
    """
    try:
        name, row = docs["_metadata.file_name"], docs["_metadata.row_index"]
    except AnalysisException:
        return F.monotonically_increasing_id()
    number = lambda group: F.regexp_extract(name, r"^part-(\d+)(?:.*-c(\d+))?", group).try_cast("long")
    task, file = F.coalesce(number(1), F.crc32(name.cast("binary")) % (1 << 20)), F.coalesce(number(2), F.lit(0))
    place = F.shiftleft(task, 43) + F.shiftleft(file, 31) + row
    return F.when((task < 1 << 20) & (file < 1 << 12) & (row < 1 << 31), place).otherwise(F.raise_error(F.lit("too many files or rows for training places")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = docs.withColumn("training_place", _training_place(docs))
    return encode_documents(placed, public_tokenizers.path("piece_bpe_32k.model"), dropout=0.1, copy=placed["training_place"])


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_copies", near_copies), ("mixing", mixing), ("pieces", pieces)]

#: Trained models and merge-dropout can't be put in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result goes through the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
