"""Merge-dropout draws anew for every occurrence, document and training copy."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from nichewright.llm.pieces import PieceCoder, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXT = "international organisations understand segmentation " * 40


def words(coder, ids):
    """The pieces of each word, as lists of ids."""
    out = []
    for i in ids:
        if coder.back[i][:1] == b" ":
            out.append([])
        out[-1].append(i)
    return [tuple(w) for w in out]


def test_occurrences_in_one_document_differ():
    coder = PieceCoder(MODEL, 0.3)
    of_word = [w for w in words(coder, coder.encode(TEXT, 1).tolist()) if b"".join(coder.back[i] for i in w) == b" international"]
    assert len(of_word) == 40 and len(set(of_word)) > 4


def test_documents_have_more_than_four_segmentations(spark):
    docs = spark.createDataFrame([(i, "international organisations") for i in range(300)], "doc_id long, text string")
    assert len({tuple(r.piece_ids) for r in encode_documents(docs, MODEL, dropout=0.3).collect()}) > 8


def spread(x):
    for shift, by in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
        x = (x ^ x >> shift) * by % 2**64
    return x ^ x >> 33


def brute(text, variant, dropout, seed=23):
    """Ids by plain rescanning: the best, leftmost pair that wasn't skipped; one draw a skip, from the variant and the place."""
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    known = {library.id_to_piece(i): i for i in range(library.get_piece_size()) if not library.is_byte(i) and not library.is_control(i) and not library.is_unknown(i)}
    chances = [c for n in range(1, 4000) if (c := int((1 - dropout) ** n * 2**53))]
    out = []
    base = spread((spread(seed) + variant * 0x9E3779B97F4A7C15) % 2**64)
    marked = "▁" + text.replace(" ", "▁")
    parts = re.findall("▁*[^▁\n]+|▁+|\n[^▁\n]*", marked) if "\n" not in known else re.findall("▁*[^▁]+|▁+", marked)
    for place, part in enumerate(parts):
        key = spread((base + place * 0x9E3779B97F4A7C15) % 2**64)
        gap = lambda depth: sum((spread((key + depth * 0xD1342543DE82EF95) % 2**64) >> 11) < c for c in chances)  # noqa: E731, B023
        pieces, banned, taken, depth = list(part), set(), 0, 0
        skip = gap(0)
        while True:
            pairs = [(-library.get_score(known[pieces[i] + pieces[i + 1]]), i) for i in range(len(pieces) - 1) if pieces[i] + pieces[i + 1] in known and i not in banned]
            if not pairs:
                break
            i = min(pairs)[1]
            if taken == skip:
                banned.add(i)
                depth += 1
                skip += 1 + gap(depth)
            else:
                pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
                # Pairs that lose a symbol are new ones; those to the right move one place.
                banned = {b if b < i else b - 1 for b in banned if b not in (i - 1, i, i + 1)}
            taken += 1
        for p in pieces:
            out += [known[p]] if p in known else [library.piece_to_id(f"<0x{b:02X}>") for c in p for b in c.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.5, 0.9])
def test_equals_brute_force_with_dropout(dropout):
    rng = random.Random(8)
    words = ["segmentation", "the", "organisations", "x", "naïve", "漢字かな🙂", "é" * 20, "a\nb", "understandably", "aaaaaaa", ""]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(40)]
    coder = PieceCoder(MODEL, dropout)
    ids, counts = coder.encode_many(texts, list(range(40)))
    want = [brute(t, v, dropout) for v, t in enumerate(texts)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert coder.decode_many(ids, counts) == texts


def test_parts_that_were_kept_give_what_a_new_coder_gives():
    coder, text = PieceCoder(MODEL, 0.2), " ".join(["segmentation", "organisations", "x"] * 60)
    for variant in range(30):
        base = coder.encode(text, variant).tolist()
        assert base == PieceCoder(MODEL, 0.2, most_parts=0).encode(text, variant).tolist()
    assert len(coder.node_of) == 3


@pytest.mark.parametrize("part", ["▁ab", "▁segmentation"])
def test_segmentations_are_as_frequent_as_with_independent_skips(part):
    coder, rng = PieceCoder(MODEL, 0.1), random.Random(2)
    drawn = Counter(tuple(coder.ids[p] for p in coder._short(part, (n for n in range(99) if rng.random() < 0.1))[0]) for _ in range(20000))
    got = Counter(words(coder, coder.encode(" ".join([part[1:]] * 20000), 5).tolist()))
    assert all(abs(got[w] - drawn[w]) < 400 for w in got | drawn)


def test_copies_in_the_pipeline_differ(spark, tmp_path):
    stage = pytest.importorskip("corpus_pipeline").pieces
    docs = spark.createDataFrame([(1, TEXT), (1, TEXT)], "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/docs")
    for rows in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        a, b = stage(spark, rows, "").collect()
        assert a.piece_ids != b.piece_ids
