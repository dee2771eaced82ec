"""Source divergence audit: how far the word use of each source of a language is from the other sources', over run-length columns.

Terms are runs of letters (ASCII, or any character beyond); a language's vocabulary holds the terms of at least ``LEAST_DOCS`` of its
documents. Each (language, source) is a column of counts over the vocabulary. The vocabulary is reordered by its rows of counts, so equal
counts lie together; terms with equal rows fold into one row with a length. Blocks of that order are run-length encoded column by column;
for a pair of columns the boundaries of their runs are intersected, the divergence is worked out once per common run and multiplied by the
run's length. All arithmetic is in integers.

Counting: each task folds its documents before the one shuffle, by (language, term), so no language or source meets in one task. What
is carried on is the kept vocabulary alone. Blocks hold a bounded number of counts.

Defined cases: null text, language or source is the empty string; every row is a document of its own, also with a repeated or null id;
a group without terms has counts of zero; in a language without kept terms all pairs have value 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import ship, whole_text
from skyfold.session import stored

LEAST_DOCS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
#: Most different terms a task folds before it hands them on.
HELD_TERMS = 300_000
#: Counts in one block of the reordered vocabulary.
BLOCK_COUNTS = 400_000

#: A-Z become a-z, other letters and bytes of non-ASCII characters stay, the rest becomes a blank.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _groups(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), whole_text().alias("text"))


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, occurrences ``n`` and documents ``docs``, folded per task only."""
    ship(docs.sparkSession)

    def read(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def rows():
            for (lang, source), (n, seen) in held.items():
                if n:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "lang": pa.array([lang] * len(n), pa.string()),
                            "source": pa.array([source] * len(n), pa.string()),
                            "term": pa.array(list(n), pa.binary()).cast(pa.string()),
                            "n": pa.array(list(n.values()), pa.int64()),
                            "docs": pa.array([seen[t] for t in n], pa.int64()),
                        }
                    )

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                terms = text.as_py().translate(_TERMS).split()
                before = len(n)
                n.update(terms)
                seen.update(set(terms))
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from rows()
                    held.clear()
                    size = 0
        yield from rows()

    return _groups(docs).mapInArrow(read, "lang string, source string, term string, n long, docs long")


def vocabulary(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Kept terms: ``lang``, ``term``, ``total`` and ``counts``, an array of (source, n) in source order."""
    counted = count_terms(docs).repartition("lang", "term")  # the one shuffle: both aggregates below keep its partitioning
    per_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    row = F.sort_array(F.collect_list(F.struct("source", "n")))
    rows = per_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), row.alias("counts"))
    return rows.filter(F.col("docs") >= least_docs).drop("docs")


def group_totals(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Every occurring (``lang``, ``source``) with ``total`` of its counts, ``lang_total`` and vocabulary size ``terms``."""
    own = vocab.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    langs = vocab.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("terms"))
    found = _groups(docs).select("lang", "source").distinct()
    return found.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "terms"])


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """Smoothed share of each count in ``total``, scaled; exact for counts of any size."""
    below = total + 2 * terms
    if len(counts) and int(counts.max()) + 2 > (1 << 62) // SCALE:
        return np.array([1 + SCALE * (int(c) + 2) // below for c in counts], np.int64)
    return 1 + SCALE * (counts + 2) // below


def run_columns(lists: pa.ListArray, sources: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per source the starts of its runs of equal counts and the counts, over the rows of a block."""
    rows = len(lists)
    owner = np.repeat(np.arange(rows), pc.list_value_length(lists).to_numpy())
    flat = lists.flatten()
    which = pc.index_in(flat.field("source"), value_set=pa.array(sources, pa.string())).to_numpy()
    order = np.argsort(which, kind="stable")
    owner, n = owner[order], flat.field("n").to_numpy()[order]
    ends = np.searchsorted(which[order], np.arange(len(sources) + 1))
    columns = []
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        dense = np.zeros(rows, np.int64)
        dense[owner[lo:hi]] = n[lo:hi]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(dense)) + 1])
        columns.append((starts, dense[starts]))
    return columns


def run_sum(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], upto: np.ndarray) -> int:
    """Divergence of two columns of shares in runs; ``upto`` has the terms before each row of the block."""
    cut = np.union1d(a[0], b[0])
    p = a[1][np.searchsorted(a[0], cut, "right") - 1]
    q = b[1][np.searchsorted(b[0], cut, "right") - 1]
    length = np.diff(np.append(upto[cut], upto[-1]))
    return int(((p - q) * (p - q) // (p + q) * length).sum())


def pair_sums(vocab: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``a``, ``b`` (a before b), ``value``: divergence over the whole vocabulary."""
    rows = stored(vocab.groupBy("lang", "counts").agg(F.count("*").alias("length")), "count_rows")
    cells = rows.agg(F.sum(F.size("counts"))).first()[0] or 0
    placed = rows.repartitionByRange(max(1, math.ceil(cells / BLOCK_COUNTS)), "lang", "counts").sortWithinPartitions("lang", "counts")
    placed = stored(placed.select("*", F.monotonically_increasing_id().alias("place")), "count_blocks")
    block = F.shiftright("place", 33).alias("block")
    placed = placed.select("lang", block, "place", "length", "counts")
    blocks = placed.select(F.col("lang").alias("of"), F.col("block").alias("at")).distinct()
    columns = blocks.withColumnsRenamed({"of": "lang", "at": "block"}).join(groups, "lang").select("lang", "block", "source", "total", "terms")

    def sums(rows: pa.Table, columns: pa.Table) -> pa.Table:
        rows, columns = rows.sort_by("place"), columns.sort_by("source")
        out = {"lang": [], "a": [], "b": [], "value": []}
        if len(rows):
            sources, terms = columns["source"].to_pylist(), columns["terms"][0].as_py()
            upto = np.concatenate([[0], np.cumsum(rows["length"].to_numpy())])
            runs = run_columns(rows["counts"].combine_chunks(), sources)
            runs = [(starts, shares(n, total, terms)) for (starts, n), total in zip(runs, columns["total"].to_pylist(), strict=True)]
            for i, a in enumerate(runs):
                out["a"] += [sources[i]] * (len(runs) - i - 1)
                out["b"] += sources[i + 1 :]
                out["value"] += [run_sum(a, b, upto) for b in runs[i + 1 :]]
            out["lang"] = [rows["lang"][0].as_py()] * len(out["a"])
        return pa.table(out, pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())]))

    found = placed.groupBy("lang", "block").cogroup(columns.groupBy("lang", "block")).applyInArrow(sums, "lang string, a string, b string, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _share(n: str, total: str) -> Column:
    """As ``shares``, in decimals, for a vocabulary that is not empty."""
    return F.expr(f"1 + cast({SCALE} * cast({n} + 2 as decimal(20, 0)) div cast({total} + 2 * terms as decimal(20, 0)) as long)")


def _ranked(rows: DataFrame) -> DataFrame:
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(place))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Every pair of sources of a language by divergence, and each source's ``top`` terms above its language's use."""
    vocab = stored(vocabulary(docs, least_docs), "vocabulary")
    groups = stored(group_totals(docs, vocab), "groups")
    sums = pair_sums(vocab, groups)
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    both = both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    # A row per pair is the result asked for; groups are one row per language and source.
    others = groups.select("lang", F.col("source").alias("item"))
    every = groups.select("lang", "source").join(others, "lang").filter("source != item")
    pairs = every.join(both, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))

    cells = vocab.select("lang", "term", F.col("total").alias("whole"), F.explode("counts").alias("c")).select("lang", "term", "whole", "c.source", "c.n")
    cells = cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share("n", "total").alias("p"), _share("whole", "lang_total").alias("q"))
    terms = cells.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    parts = (_ranked(pairs).withColumn("part", F.lit("pair")), _ranked(terms).filter(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


AUDIT_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
per AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(per.n, 0) AS n, whole,
         sum(coalesce(per.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
         count(*) OVER (PARTITION BY g.lang, g.source) AS v,
         sum(whole) OVER (PARTITION BY g.lang, g.source) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k ON k.lang = g.lang
       LEFT JOIN per ON per.lang = g.lang AND per.source = g.source AND per.term = k.term),
share AS (
  SELECT lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + 2)) // (total + 2 * v) AS p,
         1 + ({SCALE}::HUGEINT * (whole + 2)) // (lang_total + 2 * v) AS q
  FROM grid),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM share WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
