"""Line dedup with a log-template tree.

The tree has a fixed depth: a line goes to a leaf by its number of tokens and its first ``DEPTH`` tokens (tokens with a
digit count as variable). In a leaf, a token that stands at its place in lines of few documents is a variable field; the others are
constant, those with a digit too. A line's template is its leaf with its constant tokens. Templates of mostly constant tokens recur, and their lines are dropped
everywhere, if they stand in at least ``LEAST_DOCS`` different texts; in lines of more than ``LONG_LINE`` tokens, ``LONG_DOCS`` texts are
enough (the same bounds say what few documents are for a token): so long a passage does not come twice by chance. The three leading tokens are told apart unless they hold a digit.

Equal texts count as one document here (whole copies are for document dedup to find). Only lines in leaves of enough documents are taken apart into tokens;
everything else leaves after one count per leaf. All counts are exact and taken over all documents; hot lines meet as
partial counts.

Defined cases: a null text stays null and has no lines; blank lines are kept and never counted; tokens are compared with case; a
text all of whose lines recur becomes empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import WORD, packed
from skyfold.session import stored

DEPTH = 3
LEAST_DOCS = 5
#: Lines of more tokens than this are passages, which recur from so many texts on.
LONG_LINE, LONG_DOCS = 50, 2
#: Percent of a line's tokens that must be constant.
CONSTANT = 60
VARIABLE = "<*>"


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({WORD})"))


def _masked(token: Column) -> Column:
    return F.when(F.regexp(token, F.lit("[0-9]")), F.lit(VARIABLE)).otherwise(token)


def _least(n: Column, least_docs: int) -> Column:
    """Texts that a template of ``n`` tokens must stand in."""
    return F.when(n > LONG_LINE, F.least(F.lit(LONG_DOCS), F.lit(least_docs))).otherwise(F.lit(least_docs))


def _lines(texts: DataFrame) -> DataFrame:
    """One row per line with a token: ``tie``, ``line`` (its number), ``leaf`` and ``toks``."""
    lines = texts.select(*[c for c in texts.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = lines.withColumn("toks", _tokens(F.col("content"))).drop("content").filter(F.size("toks") > 0)
    lead = F.transform(F.slice("toks", 1, DEPTH), _masked)
    return lines.withColumn("leaf", F.xxhash64(F.size("toks"), lead))


def recurring(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Lines to drop: per text (``tie``) the numbers (``gone``) of its lines with a recurring template."""
    texts = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("tie"), "text")
    seen = stored(_lines(texts).select("leaf", "tie", F.size("toks").alias("n")).distinct(), "leaves")
    enough = F.col("k") >= _least(F.col("n"), least_docs)  # a leaf has one number of tokens
    live = seen.groupBy("leaf").agg(F.count("*").alias("k"), F.max("n").alias("n")).filter(enough).select("leaf")
    mine = seen.join(live, "leaf", "left_semi").groupBy("tie").agg(F.collect_set("leaf").alias("live"))

    # What joins the texts grows with the corpus, so it is never broadcast, at any size.
    held = _lines(texts.join(mine.hint("merge"), "tie")).filter(F.array_contains("live", F.col("leaf"))).drop("live")
    held = stored(held.dropDuplicates(["tie", "line"]), "lines")
    tokens = held.select("tie", "line", "leaf", F.size("toks").alias("n"), F.posexplode("toks").alias("at", "tok"))
    constant = tokens.select("leaf", "n", "at", "tok", "tie").distinct().groupBy("leaf", "at", "tok").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    constant = constant.filter(enough).drop("k", "n")
    shapes = (
        tokens.join(constant, ["leaf", "at", "tok"])
        .groupBy("tie", "line", "leaf", "n")
        .agg(F.count("*").alias("k"), F.expr("bit_xor(xxhash64(at, tok))").alias("shape"))
        .filter(100 * F.col("k") >= CONSTANT * F.col("n"))
    )
    shapes = stored(shapes.select("tie", "line", "leaf", "n", "shape"), "shapes")
    often = shapes.select("leaf", "n", "shape", "tie").distinct().groupBy("leaf", "shape").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    often = often.filter(enough)
    return shapes.join(often, ["leaf", "shape"], "left_semi").groupBy("tie").agg(F.collect_set("line").alias("gone"))


def drop_recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All rows of ``docs`` with their text rid of recurring lines, as ``_row`` (the row), ``_text``, ``_lines`` and ``_dropped``."""
    gone = stored(recurring(docs, least_docs), "gone")
    rows = packed(docs, F.xxhash64("text").alias("tie")).join(gone.hint("merge"), "tie", "left")
    rows = rows.withColumn("_all", F.split(F.col("_row")["text"], "\n"))
    places = F.sequence(F.lit(0), F.size("_all") - 1)
    stay = F.array_except(places, "gone")
    # The lines are bound once: named inside the lambda they could be split again for every line.
    kept = F.get(F.transform(F.array("_all"), lambda a: F.array_join(F.transform(stay, lambda i: F.get(a, i)), "\n")), F.lit(0))
    text = F.when(F.col("gone").isNull(), F.col("_row")["text"]).otherwise(kept)
    lines = F.when(F.col("_row")["text"].isNotNull(), F.size("_all")).otherwise(F.lit(0)).cast("long")
    return rows.select("_row", text.alias("_text"), lines.alias("_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_dropped"))


def line_report(docs: DataFrame) -> DataFrame:
    """Per document its text without recurring lines, its lines and how many were dropped."""
    out = drop_recurring_lines(docs.select("doc_id", "text"))
    return out.select("_row.doc_id", F.col("_text").alias("text"), F.col("_lines").alias("n_lines"), F.greatest("_dropped", F.lit(0)).alias("n_dropped"))


LINES_SQL = rf"""
WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
parts AS (SELECT text, string_split(text, chr(10)) AS ls FROM t),
l AS (SELECT text, i - 1 AS line, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS toks
      FROM parts, unnest(range(1, len(ls) + 1)) AS u(i)),
leafed AS (SELECT text, line, toks, len(toks) AS n,
                  list_transform(toks[1:{DEPTH}], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{VARIABLE}' ELSE x END) AS leaf
           FROM l WHERE len(toks) > 0),
tok AS (SELECT text, line, n, leaf, i AS place, toks[i] AS tok FROM leafed, unnest(range(1, n + 1)) AS u(i)),
constant AS (SELECT n, leaf, place, tok FROM tok GROUP BY ALL HAVING count(DISTINCT text) >= CASE WHEN n > {LONG_LINE} THEN {LONG_DOCS} ELSE {LEAST_DOCS} END),
shapes AS (SELECT text, line, n, leaf, string_agg(place || ':' || tok, ' ' ORDER BY place) AS shape
           FROM tok JOIN constant USING (n, leaf, place, tok) GROUP BY text, line, n, leaf HAVING 100 * count(*) >= {CONSTANT} * n),
often AS (SELECT n, leaf, shape FROM shapes GROUP BY ALL HAVING count(DISTINCT text) >= CASE WHEN n > {LONG_LINE} THEN {LONG_DOCS} ELSE {LEAST_DOCS} END),
gone AS (SELECT text, list(line) AS gone FROM shapes JOIN often USING (n, leaf, shape) GROUP BY text)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(
         list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
FROM documents d LEFT JOIN gone USING (text)
"""
