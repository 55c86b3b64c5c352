"""License scans by diagonal voting, with DataFrame functions only.

Every rolling run of ``k`` words of a text is hashed and joined to the positions at which license templates have the same run.  A
match of text word i with template word j votes for the diagonal i - j; neighbouring diagonals, which inserted or dropped words
lead to, are merged; a merged diagonal is verified by the share of its template's words that it covers, word for word.  Of
verified spans that overlap in the text the one of the larger share, then of the more words, stands, so that a license isn't taken for
one whose wording it shares but for a word.  This is decided from the largest share downwards, and only spans that stand beat others;
equal ones both stand.

Scale: the join with the template runs goes in two halves.  The set of their hashes, 912 for the templates here, drops the
runs that no template has inside the array of words, and only the others become rows that meet the table of positions.  (Making a
row of every run and joining these took three times the CPU seconds.)  The texts are read once and never shuffled.

Cases: a null text counts as empty; rows that share an id are documents of their own; a phrase may be found at every place,
overlapping ones included; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nichewright.llm.license_texts import templates
from nichewright.llm.shared import ascii_lower, few, materialise

#: Words are runs of ASCII letters and digits and of characters beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

TEMPLATES = templates(WORDS)


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _grams(templates: tuple[tuple[str, str], ...], k: int) -> list[tuple[int, str, int, int, str]]:
    """(template number, label, number of words, position, run of k words)."""
    split = [(n, label, text.split()) for n, (label, text) in enumerate(templates)]
    return [(n, label, len(w), j, " ".join(w[j : j + k])) for n, label, w in split for j in range(len(w) - k + 1)]


def template_runs(spark: SparkSession, templates: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """(template, label, length, place, words, hash), a row for each position of a run in a template."""
    rows = spark.createDataFrame(_grams(templates, k), "template int, label string, length int, place int, words string")
    parts = F.split("words", " ")
    return rows.withColumn("hash", F.xxhash64(*(parts[i] for i in range(k))))


def license_spans(hits: DataFrame, known: DataFrame, k: int, gap: int, least_cover: float) -> DataFrame:
    """(row, label, first, last, cover) of verified spans that no overlapping one excels, from rows (row, at, hash, gram)."""
    votes = (
        hits.join(few(known), "hash")
        .where(F.col("gram") == F.col("words"))
        .groupBy("row", "template", "label", "length", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"))
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    merged = votes.withColumn("new", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(gap + 1)) > gap).cast("int")).withColumn("band", F.sum("new").over(order))
    ends = [F.min(F.col("diagonal") + F.array_min("places")).alias("first"), F.max(F.col("diagonal") + F.array_max("places") + (k - 1)).alias("last")]
    spans = merged.groupBy("row", "template", "label", "length", "band").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), *ends)
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1))))))
    verified = spans.select("row", "label", "first", "last", covered.alias("covered"), (covered / F.col("length")).alias("cover")).where(F.col("cover") >= least_cover)
    return standing(verified)


def standing(verified: DataFrame) -> DataFrame:
    """The rows (row, label, first, last, covered, cover) that no better span which itself stands overlaps.

    Spans that don't overlap, not even through others, fall into runs of their own, so that a text with very many licenses is
    decided run by run.
    """
    before = Window.partitionBy("row").orderBy("first", "last", "label").rowsBetween(Window.unboundedPreceding, -1)
    placed = verified.withColumn("new", (F.col("first") > F.coalesce(F.max("last").over(before), F.lit(-1))).cast("int"))
    placed = placed.withColumn("run", F.sum("new").over(Window.partitionBy("row").orderBy("first", "last", "label").rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct((-F.col("cover")).alias("by_cover"), (-F.col("covered")).alias("by_words"), "first", "last", "label", "cover", "covered")
    runs = placed.groupBy("row", "run").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    better = lambda y, x: (y["cover"] > x["cover"]) | ((y["cover"] == x["cover"]) & (y["covered"] > x["covered"]))
    beats = lambda y, x: (y["first"] <= x["last"]) & (x["first"] <= y["last"]) & better(y, x)
    kept = F.aggregate("spans", F.slice("spans", 1, 0), lambda stand, x: F.when(F.exists(stand, lambda y: beats(y, x)), stand).otherwise(F.concat(stand, F.array(x))))
    return runs.select("row", F.inline(kept)).select("row", "label", "first", "last", "cover", "covered")


def scan_licenses(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = 3, gap: int = 2, least_cover: float = 0.7) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    The first columns count the places of the base ``phrases``; ``labels`` adds those of ``license_spans``; ``score`` is 1 with a base
    phrase, else the largest share of a template that a verified span covers, else 0.
    """
    known = template_runs(documents.sparkSession, templates, k)
    # The templates are parameters of the program, so their hashes are of a known number.
    hashes = [r.hash for r in known.select("hash").distinct().orderBy("hash").collect()]
    words = documents.select("doc_id", split_words(F.col("text")).alias("w"))
    n = F.size("w")

    def places(phrase: str) -> Column:
        parts = phrase.split()
        same = lambda i: functools.reduce(operator.and_, (F.get("w", i + j) == p for j, p in enumerate(parts)))
        at = F.filter(F.sequence(F.lit(0), n - 1), same)
        return F.when(F.array_contains("w", parts[-1]), at).otherwise(F.array().cast("array<int>"))

    run = lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(k)))
    hits = F.when(n >= k, F.filter(F.sequence(F.lit(0), n - k), lambda i: run(i).isin(hashes))).otherwise(F.array().cast("array<int>"))
    found = words.select("doc_id", n.cast("long").alias("n_words"), *(places(p).alias(f"p{i}") for i, p in enumerate(phrases)), hits.alias("hits"), "w")
    marked = materialise(
        found.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "n_words",
            *(f"p{i}" for i in range(len(phrases))),
            F.transform("hits", lambda i: F.struct(i.alias("at"), run(i).alias("hash"), F.array_join(F.slice("w", i + 1, k), " ").alias("gram"))).alias("hits"),
        ),
        "licenses",
    )
    spans = license_spans(marked.select("row", F.inline("hits")), known, k, gap, least_cover)
    by_row = spans.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))
    all_places = F.concat(*(F.col(f"p{i}") for i in range(len(phrases))))
    base = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))))
    return marked.join(by_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("found", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size(all_places) > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = 3, gap: int = 2, least_cover: float = 0.7) -> str:
    """The same over the view ``documents``, for tables in which doc_id is unique and not null."""
    known = ", ".join(f"({n}, '{label}', {length}, {place}, '{gram}')" for n, label, length, place, gram in _grams(templates, k))
    run = " || ' ' || ".join(["word"] + [f"lead(word, {j}) OVER w" for j in range(1, k)])
    longest = max(len(p.split()) for p in phrases)
    cases = " UNION ALL ".join(
        f"SELECT doc_id, pos, '{label}' AS label FROM running WHERE " + " AND ".join(f"w{j} = '{p}'" for j, p in enumerate(phrase.split())) for phrase, label in phrases.items()
    )
    assert re.fullmatch(r"[\w, ()'\-]+", known)
    return f"""
WITH split AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM split),
running AS (SELECT doc_id, pos, word AS w0, {", ".join(f"lead(word, {j}) OVER w AS w{j}" for j in range(1, longest))}, {run} AS gram FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
known(template, label, length, place, gram) AS (VALUES {known}),
base AS ({cases}),
votes AS (SELECT DISTINCT doc_id, template, label, length, r.pos - k.place AS diagonal, k.place AS place FROM running r JOIN known k USING (gram)),
diagonals AS (SELECT DISTINCT doc_id, template, diagonal FROM votes),
fresh AS (SELECT *, CASE WHEN COALESCE(diagonal - lag(diagonal) OVER w, {gap + 1}) > {gap} THEN 1 ELSE 0 END AS new FROM diagonals WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
bands AS (SELECT *, SUM(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS band FROM fresh),
covered AS (SELECT doc_id, v.template, label, length, band, v.diagonal, unnest(range(v.place, v.place + {k})) AS word FROM votes v JOIN bands b USING (doc_id, template, diagonal)),
spans AS (SELECT doc_id, label, COUNT(DISTINCT word) / CAST(MAX(length) AS DOUBLE) AS cover, COUNT(DISTINCT word) AS n, MIN(diagonal + word) AS first, MAX(diagonal + word) AS last
          FROM covered GROUP BY doc_id, template, label, band),
enough AS (SELECT doc_id, label, cover, n, first, last FROM spans WHERE cover >= {least_cover}),
ordered AS (SELECT doc_id, list([{{'label': label, 'cover': cover, 'n': n, 'first': first, 'last': last}}] ORDER BY cover DESC, n DESC, first, last, label) AS spans FROM enough GROUP BY doc_id),
verified AS (SELECT doc_id, x.label AS label, x.cover AS cover FROM (SELECT doc_id, unnest(list_reduce(spans, lambda stand, x: CASE WHEN len(list_filter(stand, lambda y: y.first <= x[1].last AND x[1].first <= y.last AND (y.cover > x[1].cover OR y.cover = x[1].cover AND y.n > x[1].n))) > 0 THEN stand ELSE list_concat(stand, x) END)) AS x FROM ordered)),
per_base AS (SELECT doc_id, COUNT(*) AS n_base, MIN(pos) AS first_word, MAX(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
per_all AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM verified) GROUP BY doc_id),
per_span AS (SELECT doc_id, MAX(cover) AS cover FROM verified GROUP BY doc_id)
SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(COALESCE(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE COALESCE(cover, 0.0) END::DOUBLE AS score
FROM split s LEFT JOIN per_base USING (doc_id) LEFT JOIN per_all USING (doc_id) LEFT JOIN per_span USING (doc_id)"""
