"""Both jobs: results by hand and brute force, reruns, growing input, broken-off runs and odd rows."""

import json
import logging
import math
import re
import shutil
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from jobs import assign_arrivals as aa
from jobs import common
from jobs import prepare_text as pt

DOCUMENTS = "doc_id long, text string, source string, gene string"
CELLS = "vec_id long, embedding array<float>, label int, batch int"


def documents(spark, path, rows):
    spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], DOCUMENTS).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")


def brute_features(rows, panel_size, least=2, target=1e4):
    lower = str.maketrans(pt.UPPER, pt.LOWER)
    words = lambda t: [w for w in (t or "").translate(lower).replace("\n", " ").replace("\t", " ").split(" ") if w]
    seen, cells = Counter(), {}
    for i, text, source in rows:
        if i is not None:
            seen.update(set(words(text)))
            cells.setdefault((source or pt.NO_SAMPLE, i), []).extend(words(text))
    panel = sorted((w for w in seen if seen[w] >= least), key=lambda w: (-seen[w], w.encode()))[:panel_size]
    values = {(s, i, w): math.log1p(ws.count(w) * target / len(ws)) for (s, i), ws in cells.items() for w in set(ws) & set(panel)}
    out = {}
    for w in panel:
        column = [values.get((*c, w), 0.0) for c in cells]
        deviation = np.std(column)
        for (s, i), v in zip(cells, column, strict=True):
            if v:
                out[s, i, w] = (float(cells[s, i].count(w)), v, (v - np.mean(column)) / (deviation if deviation > 1e-8 else 1.0))
    return out


def features_of(spark, out):
    return {(r.sample_id, r.row_idx, r.gene): (r.value, r.normalised, r.scaled) for r in pt.features_table(spark, out).collect()}


def same(a, b):
    return a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


TEXTS = [(1, "The cat sat", "a"), (2, "the CAT\tran ran", "a"), (3, "a dog\nran off", "b"), (4, None, "b"), (5, "", "12"), (6, "Ärger the é É", "12"), (None, "the the the", "a"), (7, "the end", None), (8, "dog " * 20000 + "cat", "b"), (9, "unique words only", "lone"), (2, "cat again", "a")]


def test_features_equal_brute_force_and_reruns_change_nothing(spark, tmp_path, caplog):
    documents(spark, tmp_path, TEXTS)
    s, out = pt.Settings(panel_size=4), str(tmp_path / "out")
    with caplog.at_level(logging.INFO, "jobs"):
        done = pt.prepare(spark, str(tmp_path), out, s)
    want = brute_features(TEXTS, 4)
    assert same(features_of(spark, out), want)
    assert done == {"read": {"rows": 11, "without_id": 1}, "panel": 4, "features": len(want), "samples": 5}
    assert "read 11 rows" in caplog.text and f"wrote {len(want)} features" in caplog.text
    summary = {r.sample_id: (r.cells, r.words, r.panel_words, r.distinct_genes) for r in spark.read.parquet(f"{out}/samples").collect()}
    assert summary["12"] == (2, 4, 1, 1) and summary["lone"] == (1, 3, 0, 0) and summary["b"][:2] == (3, 20005) and summary[pt.NO_SAMPLE] == (1, 2, 1, 1)
    assert {p.name for p in Path(out, "features").glob("sample_id=*")} == {"sample_id=a", "sample_id=b", "sample_id=12", f"sample_id={pt.NO_SAMPLE}"}
    assert pt.prepare(spark, str(tmp_path), out, s) == done and same(features_of(spark, out), want)


def test_only_the_partitions_of_given_samples_are_replaced(spark, tmp_path):
    documents(spark, tmp_path, TEXTS)
    s, out = pt.Settings(panel_size=4), str(tmp_path / "out")
    pt.prepare(spark, str(tmp_path), out, s)
    before = {p: p.stat().st_mtime_ns for p in Path(out, "features").rglob("*.parquet")}
    changed = [(i, t + " ran" if i == 3 else t, src) for i, t, src in TEXTS]
    documents(spark, tmp_path, changed)
    pt.prepare(spark, str(tmp_path), out, s, samples="b")
    after = {p: p.stat().st_mtime_ns for p in Path(out, "features").rglob("*.parquet")}
    assert {p for p in before if "sample_id=b" not in str(p)} == {p for p in after if before.get(p) == after[p]}
    found, want = features_of(spark, out), brute_features(changed, 4)
    assert {k: found[k] for k in found if k[0] == "b"}.keys() == {k for k in want if k[0] == "b"} and np.isclose(found["b", 3, "ran"][1], want["b", 3, "ran"][1])


def test_a_sample_that_is_gone_leaves_no_partition(spark, tmp_path):
    documents(spark, tmp_path, TEXTS)
    s, out = pt.Settings(panel_size=4), str(tmp_path / "out")
    pt.prepare(spark, str(tmp_path), out, s)
    fewer = [r for r in TEXTS if r[2] != "a"]
    documents(spark, tmp_path, fewer)
    pt.prepare(spark, str(tmp_path), out, s)
    assert same(features_of(spark, out), brute_features(fewer, 4))


def test_empty_documents(spark, tmp_path):
    documents(spark, tmp_path, [])
    done = pt.prepare(spark, str(tmp_path), str(tmp_path / "out"))
    assert (done["features"], done["panel"], done["samples"]) == (0, 0, 0) and features_of(spark, str(tmp_path / "out")) == {}


def test_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"panel_size": 7, "table": "texts"}))
    assert common.settings(spark, pt.Settings, str(tmp_path / "s.json"), table="given", text=None) == pt.Settings(table="given", panel_size=7)
    (tmp_path / "bad.json").write_text(json.dumps({"panel": 7}))
    with pytest.raises(ValueError, match="unknown settings: panel"):
        common.settings(spark, pt.Settings, str(tmp_path / "bad.json"))
    for bad in ({"panel_size": 0}, {"panel_size": 10**6}, {"files_per_sample": 0}, {"target_sum": 0.0}):
        with pytest.raises(ValueError, match="positive"):
            pt.Settings(**bad)
    with pytest.raises(ValueError, match="landmarks"):
        aa.Settings(landmarks=0)
    for job, kind in (("prepare_text", pt.Settings), ("assign_arrivals", aa.Settings)):
        path = Path(pt.__file__).with_name(f"{job}.json")
        assert common.settings(spark, kind, str(path)) == kind()

def test_words_of_odd_texts_and_ids_of_several_rows(spark, tmp_path):
    space = "a\x1cb a\x85b a b a b\x0bA\x0cB\rİI ıi \x00 a\x00"
    rows = [(1, space, "x"), (2, "\U0001f600 Σς ΣΣ é É", "x"), (3, space + " " + space, "y"), *((7, f"a b w{n} é", "y") for n in range(40)), (7, "a", "x"), (8, " \t\n", "x")]
    documents(spark, tmp_path, rows)
    s, out = pt.Settings(panel_size=12), str(tmp_path / "out")
    pt.prepare(spark, str(tmp_path), out, s)
    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    lower = str.maketrans(pt.UPPER, pt.LOWER)
    plain = [(i, " ".join(split(t.translate(lower))), source) for i, t, source in rows]
    assert same(features_of(spark, out), brute_features(plain, 12))


def test_texts_become_no_row_for_each_word(spark, tmp_path, monkeypatch):
    documents(spark, tmp_path, TEXTS)
    plans, made = [], pt.materialise
    monkeypatch.setattr(pt, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or made(df, label))
    pt.prepare(spark, str(tmp_path), str(tmp_path / "out"), pt.Settings(panel_size=4))
    reads = [p for p in plans if "documents.parquet" in p or "text#" in p]
    assert reads and not any("Generate" in p or "regexp" in p for p in reads)


# Arrivals -----------------------------------------------------------------------------------------------------------------


def arrive(spark, path, rows, mode="append"):
    spark.createDataFrame([(*r, 1) for r in rows], CELLS).coalesce(1).write.mode(mode).parquet(f"{path}/embeddings.parquet")


def cells(rng, first, n):
    return [(first + i, rng.normal(size=3).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]


def check_nearest(rows, reference):
    ids = sorted(reference)
    for r, z in rows:
        d = sorted((sum((a - b) ** 2 for a, b in zip(z, reference[j][0], strict=True)), j) for j in ids)
        assert (r.landmark, r.niche) == (d[0][1], reference[d[0][1]][1]) and np.isclose(r.distance, d[0][0])
        assert np.isclose(r.score, (d[1][0] - d[0][0]) / max(d[1][0], 1e-8))


def test_runs_over_growing_input_take_only_what_is_new(spark, tmp_path, caplog):
    rng, path, out, s = np.random.default_rng(1), str(tmp_path), str(tmp_path / "out"), aa.Settings(landmarks=6)
    first, second = cells(rng, 0, 40), cells(rng, 100, 25)
    arrive(spark, path, first)
    with caplog.at_level(logging.INFO, "jobs"):
        assert aa.assign_arrivals(spark, path, out, s) == {"batches": [{"batch": 0, "rows": 40, "left_out": 0, "written": 40}]}
    assert "batch 0: read 40 cells, left out 0, wrote 40" in caplog.text
    reference = {r.row_idx: (r.z, r.niche) for r in spark.read.parquet(f"{out}/reference").collect()}
    assert len(reference) == 6
    files = set(Path(out, "assigned").rglob("*.parquet"))
    assert aa.assign_arrivals(spark, path, out, s) == {"batches": []}
    arrive(spark, path, second)
    assert aa.assign_arrivals(spark, path, out, s)["batches"] == [{"batch": 1, "rows": 25, "left_out": 0, "written": 25}]
    assert files < set(Path(out, "assigned").rglob("*.parquet"))
    assert {r.row_idx: (r.z, r.niche) for r in spark.read.parquet(f"{out}/reference").collect()} == reference
    z = {i: v for i, v, _ in first + second}
    rows = aa.assigned_table(spark, out).collect()
    assert Counter(r.batch for r in rows) == {0: 40, 1: 25} and {r.row_idx for r in rows} == z.keys()
    check_nearest([(r, z[r.row_idx]) for r in rows], reference)
    assert {(r.sample_id, r.niche): r.cells for r in aa.totals(spark, out).collect()} == Counter((r.sample_id, r.niche) for r in rows)
    assert all(r.sample_id == str(lab) for r in rows for i, _, lab in first + second if i == r.row_idx)


def test_a_broken_off_batch_is_repeated_without_doubling(spark, tmp_path, monkeypatch):
    rng, path, out, s = np.random.default_rng(2), str(tmp_path), str(tmp_path / "out"), aa.Settings(landmarks=4)
    arrive(spark, path, cells(rng, 0, 10))
    aa.assign_arrivals(spark, path, out, s)
    arrive(spark, path, cells(rng, 50, 10))
    real = aa.replace

    def broken(rows, where, *by):
        real(rows, where, *by)
        if where.endswith("assigned"):
            raise OSError("lost")

    monkeypatch.setattr(aa, "replace", broken)
    with pytest.raises(Exception, match="lost"):
        aa.assign_arrivals(spark, path, out, s)
    monkeypatch.setattr(aa, "replace", real)
    assert [b["batch"] for b in aa.assign_arrivals(spark, path, out, s)["batches"]] == [1]
    rows = aa.assigned_table(spark, out).collect()
    assert len(rows) == len({r.row_idx for r in rows}) == 20 and sum(r.cells for r in aa.totals(spark, out).collect()) == 20


def test_odd_cells_and_cells_that_arrive_again(spark, tmp_path):
    path, out, s = str(tmp_path), str(tmp_path / "out"), aa.Settings(landmarks=2)
    nan = float("nan")
    arrive(spark, path, [(1, [0.0, 0.0], 5), (2, [4.0, 0.0], None), (3, None, 5), (4, [1.0], 5), (5, [nan, 0.0], 5), (6, [None, 0.0], 5), (None, [0.0, 0.0], 5), (1, [0.0, 0.0], 5), (1, [9.0, 0.0], 5)])
    done = aa.assign_arrivals(spark, path, out, s)["batches"]
    assert done == [{"batch": 0, "rows": 9, "left_out": 5, "written": 2}]
    assert {(r.row_idx, r.landmark, r.niche, r.sample_id, r.distance) for r in aa.assigned_table(spark, out).collect()} == {(1, 1, 5, "5", 0.0), (2, 2, None, aa.NO_SAMPLE, 0.0)}
    arrive(spark, path, [(2, [1.0, 0.0], 7)])
    aa.assign_arrivals(spark, path, out, s)
    assert {(r.row_idx, r.batch, r.niche, r.sample_id) for r in aa.current(spark, out).collect()} == {(1, 0, 5, "5"), (2, 1, 5, "7")}
    assert aa.assigned_table(spark, out).count() == 3


def test_many_files_come_in_bounded_batches(spark, tmp_path):
    rng, path, out = np.random.default_rng(3), str(tmp_path), str(tmp_path / "out")
    for k in range(5):
        arrive(spark, path, cells(rng, 10 * k, 4))
    done = aa.assign_arrivals(spark, path, out, aa.Settings(landmarks=3, files_per_batch=2))["batches"]
    assert [b["rows"] for b in done] == [8, 8, 4] and aa.current(spark, out).count() == 20


def test_no_cells_no_reference(spark, tmp_path):
    path, out = str(tmp_path), str(tmp_path / "out")
    arrive(spark, path, [])
    assert aa.assign_arrivals(spark, path, out) == {"batches": []}
    shutil.rmtree(out)
    arrive(spark, path, cells(np.random.default_rng(4), 0, 3))
    assert aa.assign_arrivals(spark, path, out)["batches"][-1]["written"] == 3


@pytest.mark.parametrize("name", ["job1_prepare_text", "job2_assign_arrivals"])
def test_registered_queries_equal_their_sql(spark, name):
    import duckdb
    from jobs import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).fetchall()
    names = [c[0] for c in con.description]
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == sorted(names)
    plain = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert plain(df.select(*names).collect()) == plain(want) and len(want) > 400
