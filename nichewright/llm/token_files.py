"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back through memory maps.

A *token set* is a folder with, for every shard ``n``::

    shard-n.ids   token ids, little-endian unsigned 16-bit if every id of the vocabulary fits, else 32-bit
    shard-n.off   unsigned 64-bit offsets into the ids, one more than there are documents
    shard-n.doc   signed 64-bit document ids (NULL_ID stands for null)

plus the Parquet table ``manifest`` (shard, n_docs, n_tokens, base).  Shards hold ascending ranges of document ids; the
position of a token in the whole set is its shard's ``base``, an exclusive prefix sum over the shards, plus its offset.

Scale: one range shuffle of the texts, then every shard is written by one task.  Only one short row a shard reaches the
driver.  A task writes to names of its own attempt and renames them at its end, so lost executors and speculative attempts
leave the same files.

Cases: a null text counts as empty; an empty document has only the end id; null ids come first and stay null; rows that share
an id keep one entry each, ordered by a hash of the text and the text; an empty table yields an empty set; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nichewright.llm.shared import partitions, text_batches, work_dir

NULL_ID = -(2**63)
MANIFEST = "shard int, n_docs long, n_tokens long"
END_OF_DOCUMENT = 0
#: Last slot of the table that tells chunks met in an earlier batch from new ones; most are met once and aren't kept.
MET = (1 << 23) - 1
#: A cut in front of a space or a line feed is certain to be a pre-token border only where no white space meets white space.
_UNSAFE = re.compile(r"\s\s|\s\Z")


class WordCachedEncoder:
    """Byte-level BPE encoding of whole texts, equal to ``Tokenizer.encode`` on the whole text.

    The pre-tokenizer always cuts in front of a single space or line feed, so a text is the concatenation of independent
    chunks, and most chunks recur.  Their ids are kept; new chunks are encoded by the library in one call for each batch.
    Texts in which such a cut isn't certain, or that hold a special token's string, go to the library whole.
    """

    def __init__(self, tokenizer_file: str, most_chunks: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        pieces = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        #: ids with which a chunk can begin: those of pieces that begin with a space, and the line feed alone
        self.begins = np.array([p.startswith("Ġ") or p == "Ċ" for p in pieces])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_chunks, self.met = most_chunks, bytearray(MET + 1)
        self.cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        for start in range(0, len(chunks), 4096):
            part = chunks[start : start + 4096]
            spelled = [c if c[0] == "\n" else f" {c}" for c in part]
            (encoded,) = self.tokenizer.encode_batch_fast(["".join(spelled)], add_special_tokens=False)
            ids = np.array(encoded.ids, self.dtype)
            cuts = np.flatnonzero(self.begins[ids])
            if len(cuts) == len(part) and cuts[0] == 0:
                raw, width = ids.tobytes(), self.dtype.itemsize
                edges = [*(cuts * width).tolist(), len(raw)]
                self.cache.update((c, raw[edges[i] : edges[i + 1]]) for i, c in enumerate(part))
            else:
                self.cache.update((c, self._whole(s)) for c, s in zip(part, spelled, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as bytes of ``dtype``."""
        split: list[list[str] | None] = []
        for text in texts:
            led = "\n" + text
            safe = text and not _UNSAFE.search(led) and not any(s in text for s in self.special)
            split.append(led.replace("\n", " \n").split(" ")[1:] if safe else None)
        seen = set().union(*(s for s in split if s))
        missing = list(seen.difference(self.cache))
        if missing and len(self.cache) + len(missing) > self.most_chunks:
            self.cache, missing = {}, list(seen)
        self._learn(missing)
        get, width = self.cache.__getitem__, self.dtype.itemsize
        out = [self._whole(t) if s is None else b"".join(map(get, s))[width:] for t, s in zip(texts, split, strict=True)]
        met, forget = self.met, self.cache.__delitem__
        for chunk in missing:
            slot = hash(chunk) & MET
            if not met[slot]:
                met[slot] = 1
                forget(chunk)
        return out


@functools.cache
def encoder_of(tokenizer_file: str) -> WordCachedEncoder:
    """One encoder for each Python worker, so that what it has learned serves its later tasks too."""
    return WordCachedEncoder(tokenizer_file)


def _paths(root: str, shard: int) -> dict[str, str]:
    return {kind: f"{root}/shard-{shard:06d}.{kind}" for kind in ("ids", "off", "doc")}


def write_token_files(documents: DataFrame, root: str, tokenizer_file: str, end_id: int = END_OF_DOCUMENT, shards: int | None = None) -> DataFrame:
    """Encodes ``documents`` (doc_id, text) and writes a token set to ``root``; returns its manifest."""
    spark = documents.sparkSession
    ordered = (
        text_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))  # rows that agree in id and text may be dealt to several shards
        .repartitionByRange(shards or partitions(spark), F.col("doc_id").asc_nulls_first(), "tie", "deal")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
        .select("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        final, mark = _paths(base, shard), uuid.uuid4().hex
        encoder, sizes, n_docs = None, [np.zeros(1, "<u8")], 0
        with store.open_output_stream(f"{final['ids']}.{mark}") as ids_out, store.open_output_stream(f"{final['doc']}.{mark}") as doc_out:
            for batch in batches:
                encoder = encoder or encoder_of(tokenizer_file)
                end = np.array([end_id], encoder.dtype).tobytes()
                texts = batch.column("text")
                for start in range(0, batch.num_rows, 256):
                    encoded = encoder.encode(texts.slice(start, 256).to_pylist())
                    sizes.append(np.array([len(x) // encoder.dtype.itemsize + 1 for x in encoded], "<u8"))
                    ids_out.write(end.join([*encoded, b""]))
                doc_out.write(batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs += batch.num_rows
        offsets = np.cumsum(np.concatenate(sizes), dtype="<u8")
        with store.open_output_stream(f"{final['off']}.{mark}") as off_out:
            off_out.write(offsets.tobytes())
        for path in final.values():
            store.move(f"{path}.{mark}", path)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n_docs], "n_tokens": [int(offsets[-1])]})

    # One row for each shard; written once, since a second evaluation would encode everything again.
    found = f"{root}/found"
    ordered.mapInArrow(write, MANIFEST).write.parquet(found)
    totals = spark.read.schema(MANIFEST).parquet(found)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("*", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0).cast("long")).alias("base")).write.parquet(f"{root}/manifest")
    return spark.read.schema(f"{MANIFEST}, base long").parquet(f"{root}/manifest")


class _Mapped:
    """A file of numbers of which spans are read: a memory map of a local file, elsewhere ranged reads."""

    def __init__(self, store: fs.FileSystem, path: str, dtype: str):
        self.dtype, self.map, self.file = np.dtype(dtype), None, None
        if isinstance(store, fs.LocalFileSystem):
            self.map = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        else:
            self.file = store.open_input_file(path)

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[span]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((span.stop - span.start) * width, span.start * width), self.dtype)


def read_token_files(spark: SparkSession, root: str, id_bits: int = 16, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) from the files of a token set; a task maps a shard."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    manifest = spark.read.schema(f"{MANIFEST}, base long").parquet(f"{root}/manifest")
    n = max(1, partitions(spark))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                path = _paths(base, row["shard"])
                if not row["n_docs"]:
                    continue
                ids, offsets, docs = _Mapped(store, path["ids"], f"<u{id_bits // 8}"), _Mapped(store, path["off"], "<u8"), _Mapped(store, path["doc"], "<i8")
                for start in range(0, row["n_docs"], 500):
                    stop = min(start + 500, row["n_docs"])
                    edges, own = offsets[start : stop + 1].astype(np.int64), docs[start:stop]
                    held = ids[int(edges[0]) : int(edges[-1])]
                    spans = [held[a:b] for a, b in itertools.pairwise((edges - edges[0]).tolist())]
                    out = {
                        "doc_id": pa.array(np.array(own), mask=np.array(own == NULL_ID)),
                        "start": pa.array(edges[:-1] + row["base"]),
                        "n_tokens": pa.array(np.diff(edges)),
                        "ids_crc32": pa.array([zlib.crc32(s.astype("<u4").tobytes()) for s in spans], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([s.astype(np.int64) for s in spans], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return manifest.repartition(n, "shard").mapInArrow(read, schema)


def token_files(documents: DataFrame, tokenizer_file: str) -> DataFrame:
    """Writes a token set to the shared folder and returns what its files hold."""
    spark = documents.sparkSession
    root = work_dir(spark, "token-files")
    write_token_files(documents, root, tokenizer_file)
    from tokenizers import Tokenizer

    bits = 16 if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else 32
    return read_token_files(spark, root, bits)
