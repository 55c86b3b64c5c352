import random
import re

import duckdb
import pytest
from nichewright.llm import licenses
from nichewright.llm.licenses import PHRASES, TEMPLATES, scan_licenses

SCHEMA = "doc_id long, text string, labels string, w int, row long"
WORD = re.compile(licenses.WORDS)


def brute(text, k=3, gap=2, least=0.7):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    base = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    spans = []
    where = {}
    for i in range(len(words) - k + 1):
        where.setdefault(tuple(words[i : i + k]), []).append(i)
    for label, template in TEMPLATES:
        t = template.split()
        votes = sorted((i - j, j) for j in range(len(t) - k + 1) for i in where.get(tuple(t[j : j + k]), []))
        band, last = [], None
        for diagonal, j in [*votes, (10**12, 0)]:
            if last is not None and diagonal - last > gap:
                cover = len({p + d for _, p in band for d in range(k)}) / len(t)
                if cover >= least:
                    spans.append((label, min(x + p for x, p in band), max(x + p + k - 1 for x, p in band), cover, len({p + d for _, p in band for d in range(k)})))
                band = []
            last = diagonal
            band.append((diagonal, j))
    stand = []
    for x in sorted(spans, key=lambda x: x[3:], reverse=True):
        if not any(y[1] <= x[2] and x[1] <= y[2] and y[3:] > x[3:] for y in stand):
            stand.append(x)
    labels, best = {b for _, b in base} | {x[0] for x in stand}, max((x[3] for x in stand), default=0.0)
    at = [i for i, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), 1.0 if base else best


def rows_of():
    rng = random.Random(6)
    filler = ["the", "É", "42", "licensed", "under", "license", "mit", "or"]
    texts = [None, "", "...", "MIT License", "mit-license/MIT  LICENSE", "license mit", "Licensed under CC BY-NC 4.0.", "x " * 70000 + "Apache License", "ΜIT license"]
    for _, template in TEMPLATES:
        words = template.split()
        for drop in (0, 1, 2, 4):
            kept = list(words)
            for _ in range(min(drop, len(kept) - 3)):
                kept.pop(rng.randrange(len(kept)))
            if drop == 2:
                kept.insert(rng.randrange(len(kept)), "inserted")
            texts.append(" ".join(rng.choices(filler, k=9)) + ", " + " ".join(kept).title() + "! " + " ".join(rng.choices(filler, k=5)))
    texts += [f"{t} {t}" for t in texts[-8:]] + texts[-3:]
    return [(i, t, "x", 1, 2) for i, t in enumerate(texts)]


def test_equals_brute_force(spark):
    rows = rows_of() + [(None, "the MIT License", "", 0, 0), (3, "MIT License", "", 0, 0)]
    got = sorted((str(r.doc_id), *r[1:]) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    want = sorted((str(r[0]), *brute(r[1])) for r in rows)
    assert [tuple(map(str, g[:-1])) for g in got] == [tuple(map(str, w[:-1])) for w in want]
    assert [g[-1] for g in got] == pytest.approx([w[-1] for w in want])
    assert {label for label, _ in TEMPLATES} <= {x for w in want for x in w[6].split(",")}


@pytest.mark.parametrize("number", range(len(TEMPLATES)))
def test_a_wording_has_its_own_label_only(number):
    label, template = TEMPLATES[number]
    assert brute(f"some words {template} and more")[4:6] in {("", label), (label, label), ("gpl", "agpl,gpl"), ("gpl", "gpl,lgpl")}


def test_equals_its_sql(spark):
    documents = spark.createDataFrame(rows_of(), SCHEMA).select("doc_id", "text").toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(licenses.oracle_sql()).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(repr, map(tuple, scan_licenses(spark.createDataFrame(rows_of(), SCHEMA)).select(*names).collect()))) == sorted(map(repr, want))


def test_a_beaten_span_beats_no_other(spark):
    """The text is the whole of a and c; b, of which a word lacks, overlaps both, loses to a and so mustn't hide the smaller c."""
    a, b, c = "a1 a2 a3 a4 a5 a6 a7 a8 a9", "a7 a8 a9 x1 x2 x3 x4 x5 x6 lacks c1 c2 c3", "c1 c2 c3 c4 gone1 gone2 c5"
    text = "a1 a2 a3 a4 a5 a6 a7 a8 a9 x1 x2 x3 x4 x5 x6 c1 c2 c3 c4 c5"
    of = lambda *templates: scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), templates, least_cover=0.5).first()["labels"]
    assert of(("a", a), ("c", c)) == "a,c" and of(("b", b), ("c", c)) == "b"
    assert of(("a", a), ("b", b), ("c", c)) == "a,c"
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1 AS doc_id, ? AS text", [text])
    sql = licenses.oracle_sql((("a", a), ("b", b), ("c", c)), least_cover=0.5)
    assert con.execute(f"SELECT labels FROM ({sql})").fetchone() == ("a,c",)


def test_standing_spans_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for row in range(40):
        for n in range(rng.randrange(1, 25)):
            first = rng.randrange(60)
            rows.append((row, f"l{n:02d}", first, first + rng.randrange(12), rng.randrange(3, 6), rng.choice([0.7, 0.8, 0.9, 1.0])))
    want = set()
    for row in range(40):
        stand = []
        for x in sorted((r for r in rows if r[0] == row), key=lambda r: (-r[5], -r[4])):
            if not any(y[2] <= x[3] and x[2] <= y[3] and (y[5], y[4]) > (x[5], x[4]) for y in stand):
                stand.append(x)
        want |= {x[:2] for x in stand}
    spans = spark.createDataFrame(rows, "row long, label string, first int, last int, covered int, cover double")
    assert {(r.row, r.label) for r in licenses.standing(spans).collect()} == want and len(want) < len(rows)


def test_empty(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
