"""The pipeline against a brute-force version on a small fixture, stage by stage."""

import random
from collections import Counter

import public_tokenizers
import pytest
from nichewright.llm import mixing, quality, toxicity
from nichewright.llm.pieces import PieceCoder

corpus_pipeline = pytest.importorskip("corpus_pipeline")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, toxic and poor documents, with copies, odd rows and an extra column of a clashing name."""
    rng, words = random.Random(7), [f"word{i}" for i in range(400)]
    prose = lambda n: ". ".join(" ".join(rng.choices(words, k=9)).capitalize() for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(300):
        kind = "toxic" if i % 5 == 0 else "poor" if i % 5 == 1 else "clean"
        text = prose(rng.randrange(3, 9))
        if kind == "toxic":
            text = text.replace("word", "vile idiot word", 4)
        if kind == "poor":
            text = " ".join(f"{w}%%%" for w in text.split())
        rows.append((i, text, "en", "hot" if i % 3 == 0 else f"s{i % 4}", len(text), 0.5))
        if i % 2 == 0 or i % 5 < 2:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    clean = [r for r in rows if r[0] % 5 > 1]
    rows += [(300 + n, *r[1:]) for n, r in enumerate(clean[:40])]
    rows += [(400 + n, clean[50][1] + " end" * (n % 2), *clean[50][2:]) for n in range(60)]
    rows += [(500, None, None, None, None, None), (501, "", "en", None, 0, 0.0), (502, prose(3000), "en", "long", 0, 0.0), (clean[0][0], clean[0][1], "en", "hot", 0, 0.0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def key(r):
    return r.doc_id, r.text


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = docs.collect()

    out = corpus_pipeline.toxicity(spark, docs, folder)
    score = toxicity.train(docs, labels).scorer()
    want = [r for r in held if score((r.text or "").encode()) < 0.5]
    assert out.columns == docs.columns and Counter(map(key, out.collect())) == Counter(map(key, want))
    assert not [r for r in want if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 5 == 0]
    assert len([r for r in want if r.doc_id < 300]) >= 230
    docs, held = spark.createDataFrame(want, docs.schema), want

    out = corpus_pipeline.quality(spark, docs, folder)
    model = quality.train(docs, labels)
    score = quality.with_cut(model, quality.raw_scores(docs, model), labels).scorer()
    want = [r for r in held if score((r.text or "").encode()) >= 0.3]
    assert out.columns == docs.columns and Counter(map(key, out.collect())) == Counter(map(key, want))
    assert not [r for r in want if r.doc_id < 300 and r.doc_id % 5 == 1] and len([r for r in want if r.doc_id < 300]) >= 170
    docs, held = spark.createDataFrame(want, docs.schema), want

    out = corpus_pipeline.near_copies(spark, docs, folder)
    words = [("".join(c.lower() if c.isascii() else c for c in r.text or "")).split() for r in held]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in words]
    root = list(range(len(held)))
    for i in range(len(held)):
        for j in range(i):
            if len(common := sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(common)):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    first = {}
    for r, g in zip(held, root):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    want = {next(key(r) for r, h in zip(held, root) if h == g and r.doc_id == d) for g, d in first.items()}
    got = out.collect()
    assert out.columns == docs.columns and Counter(map(key, got)) == Counter(want)
    docs, held = spark.createDataFrame(got, docs.schema), got

    out = corpus_pipeline.mixing(spark, docs, folder)
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
    got = out.collect()
    assert out.columns == docs.columns and Counter(r.doc_id for r in got) == +Counter(plan)
    docs, held = spark.createDataFrame(got, docs.schema), got

    out = corpus_pipeline.pieces(spark, docs, folder)
    coder = PieceCoder(MODEL, 0.1)
    rows = out.collect()
    assert out.columns == [*docs.columns, "training_place", "piece_ids"] and Counter(map(key, rows)) == Counter(map(key, held))
    assert all(coder.decode(r.piece_ids) == (r.text or "") for r in rows)


def test_training_order_stays(spark, folder, tmp_path):
    mixed = corpus_pipeline.mixing(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    mixed.write.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.pieces(spark, spark.read.parquet(f"{tmp_path}/mixed"), folder)
    want = [r.doc_id for r in mixed.collect()]
    assert [r.doc_id for r in out.orderBy("training_place").collect()] == want and len(want) > 400


def test_training_places_differ_where_a_task_writes_several_files(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = corpus_pipeline.mixing(spark, docs, folder)
    mixed.write.option("maxRecordsPerFile", 20).parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.pieces(spark, spark.read.parquet(f"{tmp_path}/mixed"), folder).orderBy("training_place").collect()
    assert [r.doc_id for r in out] == [r.doc_id for r in mixed.collect()] and len({r.training_place for r in out}) == len(out)


def test_pieces_of_files_of_any_name(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").coalesce(1).write.parquet(f"{tmp_path}/one")
    file = next(tmp_path.glob("one/part-*.parquet"))
    out = corpus_pipeline.pieces(spark, spark.read.parquet(f"file://{file.rename(tmp_path / 'documents.parquet')}"), folder).collect()
    assert len({r.training_place for r in out}) == len(out) > 400


def test_run_applies_all_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "mixing", "pieces"]
    assert rows and max(Counter(r.doc_id for r in rows).values()) <= 2
    assert not {r.doc_id for r in rows if r.doc_id < 300 and r.doc_id % 5 < 2}


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
