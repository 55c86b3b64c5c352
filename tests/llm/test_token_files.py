import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from nichewright.llm.shared import work_dir
from nichewright.llm.token_files import WordCachedEncoder, read_token_files, token_files, write_token_files
from tokenizers import Tokenizer

BPE = public_tokenizers.path("byte_bpe_50k.json")
ENCODER, LIBRARY = WordCachedEncoder(BPE, most_chunks=50), Tokenizer.from_file(BPE)


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a", "a  b", "a   b", "a \n b", " a", "a ", "\na", "a\n", "a\nb c\n\nd", "it's <|endoftext|> x", "x y z", "a\tb\r\nc d", "é 漢字 🙂 a🙂b", "a\x1c b \x85c"])
def test_encoding_equals_the_library(text):
    assert np.frombuffer(ENCODER.encode([text])[0], ENCODER.dtype).tolist() == expected(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab 1\n\t'.,é  ſ", max_size=30), max_size=4))
def test_any_text_equals_the_library(texts):
    assert [np.frombuffer(x, ENCODER.dtype).tolist() for x in ENCODER.encode(texts)] == [expected(t) for t in texts]


def test_files_hold_every_document_in_order(spark):
    rows = [(5, "one two"), (None, "none"), (3, None), (9, ""), (3, "again"), (7, "long " * 30000), (-4, "é\nx")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start long, ids string")
    got = [tuple(r) for r in token_files(docs, BPE).collect()]
    want = sorted((-(2**63) if i is None else i, i, [*expected(t or ""), 0]) for i, t in rows)
    assert sorted(r[1] for r in got)[0] == 0 and sorted((r[2], r[3]) for r in got) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for _, _, x in want)
    at = 0
    for doc_id, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == [i for _, i, _ in want]


def test_ids_read_back(spark):
    root = work_dir(spark, "t")
    write_token_files(spark.createDataFrame([(i, f"text {i} of a set") for i in range(50)], "doc_id long, text string"), root, BPE, shards=3)
    got = read_token_files(spark, root, with_ids=True).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [[*expected(f"text {i} of a set"), 0] for i in range(50)]


def test_empty_table(spark):
    assert token_files(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0
