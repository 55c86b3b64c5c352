import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from nichewright.llm.pieces import PieceCoder, encode_documents, round_trip
from nichewright.llm.shared import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PLAIN, DROPPING, SMALL = PieceCoder(MODEL, 0.0), PieceCoder(MODEL, 0.3), PieceCoder(MODEL, 0.3, most_parts=6)
TEXTS = ["", " ", "  a  b\n\tc d ", "Hello, world", "漢字かな🙂", "x" * 300, "\x00\x07", "é" * 60 + " end", "a▁b ▁", "\n\n", " the  the\nthe", "ﬁ ﬂ Å", "no space" * 40]


@pytest.mark.parametrize("text", [t for t in TEXTS if "▁" not in t])
def test_without_dropout_the_ids_are_the_librarys(text):
    assert PLAIN.encode(text).tolist() == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="the a\n.▁漢🙂é\tx", max_size=60), st.integers(0, 3))
def test_any_text_comes_back(text, variant):
    for coder in (PLAIN, DROPPING, SMALL):
        assert coder.decode(coder.encode(text, variant).tolist()) == text
    assert SMALL.encode(text, variant).tolist() == DROPPING.encode(text, variant).tolist()
    if "▁" not in text:
        assert PLAIN.encode(text).tolist() == LIBRARY.encode(text)


@pytest.mark.parametrize("text", TEXTS)
def test_both_agendas_agree(text):
    for coder in (PLAIN, DROPPING):
        for key in (0, 12345, 999999):
            assert coder._merge_short(text.replace(" ", "▁"), key) == coder._merge_long(text.replace(" ", "▁"), key)


def test_every_document_of_a_table_equals_the_library(spark):
    for r in table(spark, "/root/testdata/sf0.001", "documents").collect():
        assert PLAIN.encode(r.text).tolist() == LIBRARY.encode(r.text)


def test_dropout_varies_by_variant_and_never_joins_all():
    text = "international organisations understand segmentation " * 20
    ids = [DROPPING.encode(text, v).tolist() for v in range(4)]
    assert len({tuple(i) for i in ids}) == 4 and all(len(i) > len(PLAIN.encode(text)) for i in ids)
    assert PieceCoder(MODEL, 1.0).encode("abc").tolist() == [LIBRARY.piece_to_id(c) for c in "▁abc"]
    assert PieceCoder(MODEL, 0.3).encode(text, 2).tolist() == ids[2] != PieceCoder(MODEL, 0.3, seed=1).encode(text, 2).tolist()


def test_share_of_skipped_candidates():
    rng, coder = random.Random(1), PieceCoder(MODEL, 0.25)
    pairs = ["".join(rng.sample("abcdefghilmnorst", 2)) for _ in range(3000)]
    found = [p for p in pairs if p in coder.rank]
    kept = sum(len(coder._merge(p, v)) == 1 for p in found for v in range(4)) / (4 * len(found))
    assert abs(kept - 0.75) < 0.1


def rows_of():
    return [(i, t, "v", 5, [1]) for i, t in enumerate(TEXTS)] + [(100, None, "", 0, None), (None, "null id", "", 0, None), (102, "tie", "", 0, None), (102, "tie", "", 0, None), (101, "long text " * 60000, "", 0, None)]


def test_round_trip_of_documents(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string, variant string, n_pieces int, piece_ids array<int>")
    got = sorted(round_trip(docs, MODEL).collect(), key=str)
    assert len(got) == len(rows_of()) and all(r.lossless for r in got)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows_of())
    coder = PieceCoder(MODEL, 0.1)
    text = {r[0]: r[1] or "" for r in rows_of()}
    assert all((r.n_pieces, r.ids_crc32) == (len(x := coder.encode(text[r.doc_id], r.variant)), zlib.crc32(x.astype("<u4").tobytes())) for r in got)
    encoded = encode_documents(docs, MODEL)
    assert encoded.columns == docs.columns
    assert all(coder.decode(r.piece_ids) == (r.text or "") for r in encoded.collect())
    assert round_trip(docs.where("false"), MODEL).count() == 0 == encode_documents(docs.where("false"), MODEL).count()
    assert np.unique([r.variant for r in got]).size > 1
