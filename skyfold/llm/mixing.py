"""Mixing sources to target weights by systematic sampling.

Each source's documents lie in one order (longest first, then by id). A document's expected copies are its source's target over its
source's size; their prefix sums, moved by one random offset per source, cross an integer boundary as often as the document is
emitted. Longest first keeps the taken words near the target: neighbours in the order have nearly the same size.

The prefix sum is the row's rank times a constant, and ranks are found without ordering a source in one task: counts per
(source, size), then per (source, size, id bucket), then a row number inside each bucket.

Defined cases: null or empty texts have size 0 and take no words; a null source is a source of its own, last; null ids come first;
rows of one id, source and size are ordered by a hash of all their columns, so reruns agree in any row order; equal rows are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import packed, whole_text, word_count
from skyfold.session import stored

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of one source and size are dealt to so many buckets by id.
BUCKETS = 4096
SEED = "mix"


def _source_key() -> Column:
    """A key that is never null: joins stay plain equalities, and null differs from every text."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _bucket() -> Column:
    return F.coalesce(F.pmod(F.col("doc_id"), F.lit(BUCKETS)), F.lit(-1)).cast("long")


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's random offset in [0, 1), the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + "|"), source).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source its size and target words, from rows of (``_key``, ``_size``); one row per source reaches the windows.

    Targets are ``min(most * size, level * weight)``: the level at which they share all words is what resharing the
    excess by weight ends at, and it follows from one pass over the sources ordered by how soon they are full.
    """
    per = sizes.groupBy("_key").agg(F.sum("_size").alias("_n"))
    by_name = Window.orderBy((F.col("_key") == "n"), "_key")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("_w", F.get(F.lit(list(weights)), turn).cast("long")).withColumn("_cap", F.col("_n") * most)
    full = Window.orderBy(F.col("_cap") / F.col("_w"), "_key")
    earlier, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    level = (F.sum("_n").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0))
    )
    per = per.withColumn("_level", level).withColumn("_place", F.row_number().over(full))
    open_ = F.col("_level") * F.col("_w") <= F.col("_cap")
    per = per.withColumn("_open", F.min_by("_level", F.when(open_, F.col("_place"))).over(everything))
    return per.select(
        "_key",
        F.col("_n").alias("_source_size"),
        F.least(F.col("_cap").cast("double"), F.col("_open") * F.col("_w")).alias("_target"),
    )


def with_copies(docs: DataFrame, carry: bool, seed: str = SEED) -> DataFrame:
    """Every row with ``_copies``, its source's size and target; ``carry`` keeps the whole row as ``_row``."""
    keys = (_source_key().alias("_key"), F.col("doc_id").alias("_id"), word_count(whole_text()).alias("_size"), _bucket().alias("_bucket"))
    rows = packed(docs, *keys) if carry else docs.select(*keys, F.col("source").alias("_source"))
    if carry:
        rows = rows.withColumn("_tie", F.xxhash64("_row"))
    narrow = stored(rows.drop("_row", "_tie"), "mix")
    if not carry:
        rows = narrow

    aims = targets(narrow)
    cells = narrow.groupBy("_key", "_size", "_bucket").agg(F.count("*").alias("_rows"))
    by_size = narrow.groupBy("_key", "_size").agg(F.count("*").alias("_of_size"))
    longer = Window.partitionBy("_key").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("_longer", F.coalesce(F.sum("_of_size").over(longer), F.lit(0))).join(aims, "_key")
    earlier = Window.partitionBy("_key", "_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        cells.withColumn("_earlier", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .join(by_size, ["_key", "_size"])
        .select("_key", "_size", "_bucket", (F.col("_longer") + F.col("_earlier")).alias("_base"), "_source_size", "_target")
    )
    inside = Window.partitionBy("_key", "_size", "_bucket").orderBy("_id", *["_tie"] * carry)
    ranked = rows.withColumn("_n", F.row_number().over(inside)).join(bases, ["_key", "_size", "_bucket"])
    each = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    rank = F.col("_base") + F.col("_n")
    u = offset(F.col("_key"), seed)
    copies = F.floor(u + each * rank) - F.floor(u + each * (rank - 1))
    return ranked.withColumn("_copies", copies.cast("long"))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document how many of its words the mix takes."""
    return with_copies(docs, carry=False).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
        F.col("_source").alias("source"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row as often as it is taken, with the columns of ``docs``."""
    taken = with_copies(docs, carry=True).filter(F.col("_copies") > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k, coalesce(doc_id % {BUCKETS}, -1) AS b,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT k, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY k),
named AS (SELECT k, n, n * {MOST_COPIES} AS cap,
                 CASE (row_number() OVER (ORDER BY k = 'n', k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
filled AS (SELECT *, row_number() OVER o AS place,
                  ((sum(n) OVER ()) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                  / ((sum(w) OVER ()) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lev
           FROM named WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, k)),
level AS (SELECT min_by(lev, place) AS lev FROM filled WHERE lev * w <= cap),
aims AS (SELECT k, n, least(cap::DOUBLE, level.lev * w) AS target FROM filled, level),
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY k ORDER BY size DESC, b, doc_id) AS r FROM d),
e AS (SELECT r.*, n, target, CASE WHEN n > 0 THEN target / n ELSE 0.0 END AS e,
             ('0x' || substr(md5('{SEED}|' || r.k), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 AS u
      FROM ranked r JOIN aims USING (k))
SELECT doc_id, size, n AS source_size, target, source,
       size * CAST(floor(u + e * r) - floor(u + e * (r - 1)) AS BIGINT) AS taken
FROM e
"""
