"""Operators that depend on row order, written so that no single task ever holds one hot group.

The common device is a *segment*: a range of rows in the wanted order, cut at the quantiles of a sketch where the order is a number, else by Spark's range
partitioning on the order columns and the tie. Columns of any type can be cut, and nulls and NaN lie where the direction puts them. Segments hold a bounded
number of rows, are written once and then processed in parallel; what one segment needs from those before it (a last row, a
running total) is a table of one row per segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.session import drop_path, scratch_path, shuffle_width, shuffles_dropped, stored

#: Rows a segment holds on average; a group above that is cut.
ROWS_PER_SEGMENT = 500_000
#: Below that many rows a further segment costs more than it saves.
LEAST_ROWS = 20_000
#: Quantiles a sketch is asked for.
SKETCH_STEPS = 200


def segmented(df: DataFrame, order_by: Sequence[Column], rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """``df`` with ``_seg``, a number that grows along ``order_by``; written, so that every reader sees the same cuts.

    ``df`` itself is worked out once: it is written first, its rows are counted from what was written, and the range partitioning samples that.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "unordered")
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    rows = kept.count()
    n = max(1, -(-rows // rows_per_segment), min(shuffle_width(spark), rows // LEAST_ROWS))
    with shuffles_dropped(spark):
        out = stored(kept.repartitionByRange(n, *order_by).withColumn("_seg", F.spark_partition_id()), "segments")
    drop_path(spark, path)
    return out


def cut_by_sketch(df: DataFrame, order: str, descending: bool, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame | None:
    """``df`` with ``_seg`` from the cuts of a quantile sketch, written; None where a sketch cannot cut it into bounded segments.

    One aggregate counts the rows and merges the tasks' sketches; after it a row's segment follows from its value alone, so nothing is
    sampled or shuffled for the cut, and the counts that matter are exact. Orders that are not numbers, values that hold a segment or more, and tables of more
    segments than the sketch has steps are left to range partitioning.
    """
    if not isinstance(df.schema[order].dataType, T.NumericType):
        return None
    x = F.col(order).cast("double")
    steps = F.array(*[F.lit(i / SKETCH_STEPS) for i in range(1, SKETCH_STEPS)])
    sketch = F.kll_sketch_agg_double(F.when(~F.isnan(x), x), 4 * SKETCH_STEPS)
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.isnan(x)).alias("known"), sketch.alias("s"))
    rows, quantiles = seen.select("n", F.when(F.col("known") > 0, F.kll_sketch_get_quantile_double("s", steps))).first()
    n = max(1, -(-rows // rows_per_segment), min(shuffle_width(df.sparkSession), rows // LEAST_ROWS))
    cuts = sorted({quantiles[round(i * SKETCH_STEPS / n) - 1] for i in range(1, n)}) if quantiles else []
    if n > SKETCH_STEPS // 2 or len(cuts) < n - 1:
        return None
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= x)) if cuts else F.lit(0)
    place = F.when(F.isnan(x), n).otherwise(place)
    seg = F.when(x.isNull(), 1 if descending else -1).otherwise(-place if descending else place)
    return stored(df.withColumn("_seg", seg), "segments")


def _cut(df: DataFrame, order: str, descending: bool, order_by: Sequence[Column], rows_per_segment: int) -> DataFrame:
    found = cut_by_sketch(df, order, descending, rows_per_segment)
    return segmented(df, order_by, rows_per_segment) if found is None else found


def hot_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """Keys of more than ``most`` rows."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return stored(counts.filter(F.col("_n") > most).select(key), "hot_keys")


def previous_event(
    df: DataFrame, key: str, order: str, cols: Mapping[str, str], tie: str, rows_per_segment: int = ROWS_PER_SEGMENT
) -> DataFrame:
    """Values of the row before, within ``key`` by (``order``, ``tie``); rows with a null key have none.

    Ordinary keys take one window each. The rows of keys above a segment's size are cut into segments; a segment's first row
    of a key gets the key's last row before it from a table of one row per hot key and segment.
    """
    hot = hot_keys(df, key, rows_per_segment)
    packed = df.withColumn("_pack", F.struct(*[F.col(c).alias(o) for c, o in cols.items()]))
    known = packed.filter(F.col(key).isNotNull())
    none = packed.filter(F.col(key).isNull()).withColumn("_prev", F.lit(None).cast(packed.schema["_pack"].dataType))
    cut = not hot.isEmpty()
    cool = known.join(hot, key, "left_anti") if cut else known
    out = cool.withColumn("_prev", F.lag("_pack", 1).over(W.partitionBy(key).orderBy(order, tie)))
    if cut:
        names = [c for c in known.columns]
        warm = segmented(known.join(hot, key, "left_semi"), [F.col(key), F.col(order), F.col(tie)], rows_per_segment)
        inside = W.partitionBy(key, "_seg")
        last = warm.withColumn("_r", F.row_number().over(inside.orderBy(F.desc(order), F.desc(tie)))).filter("_r = 1")
        carry = last.select(key, "_seg", F.lag("_pack", 1).over(W.partitionBy(key).orderBy("_seg")).alias("_carry"))
        warm = warm.withColumn("_prev", F.lag("_pack", 1).over(inside.orderBy(order, tie))).join(carry, [key, "_seg"], "left")
        out = out.unionByName(warm.select(*names, F.coalesce("_prev", "_carry").alias("_prev")))
    return out.unionByName(none).select(*df.columns, *[F.col("_prev")[o].alias(o) for o in cols.values()])


def _summed(segments: DataFrame, sums: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """Running sums of columns inside each segment plus the totals of the segments before it."""
    per_segment = segments.groupBy("_seg").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = W.orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)  # one row per segment
    offsets = per_segment.select("_seg", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_t_{c}") for c in sums])
    inside = W.partitionBy("_seg").orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    joined = segments.withColumns({c: F.sum(c).over(inside) for c in sums}).join(offsets, "_seg")
    return joined.withColumns({c: F.col(c) + F.col(f"_t_{c}") for c in sums}).drop("_seg", *[f"_t_{c}" for c in sums])


def running_totals(
    df: DataFrame, order: str, tie: str, sums: Mapping[str, Column], descending: bool = False, rows_per_segment: int = ROWS_PER_SEGMENT
) -> DataFrame:
    """Running sums over the whole table in (``order``, ``tie``) order, without a one-task sort.

    Nulls and NaN stand where Spark's order puts them: nulls first going up and last going down, NaN above every number.
    """
    order_by = [F.desc(order) if descending else F.asc(order), F.asc(tie)]
    return _summed(_cut(df.withColumns(dict(sums)), order, descending, order_by, rows_per_segment), list(sums), order_by)


def totals_by_value(
    df: DataFrame, value: str, sums: Mapping[str, Column], descending: bool = False, own: bool = False, rows_per_segment: int = ROWS_PER_SEGMENT,
    by: Sequence[str] = (),
) -> DataFrame:
    """Distinct values with the sums over all rows up to and including each value, per group with ``by``.

    Equal values are folded together before they are ordered, so a value shared by a third of all rows
    is one row afterwards. With ``own`` the sums of each value alone stay as ``own_<name>``. All groups are ordered together, one after the other, so
    a large group is cut like any other range; what the groups before hold is taken off by a table of one row per group.
    """
    folded = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[F.sum(c).alias(o) for o, c in sums.items()])
    if own:
        folded = folded.withColumns({f"own_{o}": F.col(o) for o in sums})
    order_by = [*map(F.asc, by), F.desc(value) if descending else F.asc(value)]
    cut = segmented(folded, order_by, rows_per_segment) if by else _cut(folded, value, descending, order_by, rows_per_segment)
    out = _summed(cut, list(sums), order_by)
    if not by:
        return out
    earlier = W.orderBy(*by).rowsBetween(W.unboundedPreceding, -1)  # one row per group
    groups = cut.groupBy(*by).agg(*[F.sum(o).alias(f"_g_{o}") for o in sums])
    groups = groups.select(*[F.col(b).alias(f"_by_{b}") for b in by], *[F.coalesce(F.sum(f"_g_{o}").over(earlier), F.lit(0)).alias(f"_b_{o}") for o in sums])
    same = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    out = out.join(groups, same).withColumns({o: F.col(o) - F.col(f"_b_{o}") for o in sums})
    return out.drop(*[f"_by_{b}" for b in by], *[f"_b_{o}" for o in sums])


def global_rank(df: DataFrame, order: str, tie: str, alias: str = "row_num", descending: bool = False, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Position 1, 2, ... of each row in the whole table."""
    return running_totals(df, order, tie, {alias: F.lit(1).cast("bigint")}, descending, rows_per_segment)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float]:
    """Interpolated quantiles of a column, exact at any size: counts per value, then running counts.

    The driver receives the (at most two per probability) values the results lie between.
    """
    cumulative = totals_by_value(df, col, {"_n": F.lit(1).cast("bigint")})
    total = df.filter(F.col(col).isNotNull()).count()
    if total == 0:
        return []
    positions = [p * (total - 1) for p in probs]
    wanted = sorted({int(x) for x in positions} | {min(int(x) + 1, total - 1) for x in positions})
    # the value at 0-based position w is the smallest one whose running count exceeds w
    row = cumulative.agg(
        *[F.min(F.when(F.col("_n") > w, F.col(col))).cast("double").alias(f"_{w}") for w in wanted]
    ).first()
    out = []
    for x in positions:
        lo, hi = row[f"_{int(x)}"], row[f"_{min(int(x) + 1, total - 1)}"]
        out.append(lo + (hi - lo) * (x - int(x)))
    return out


def top_n_per_group(df: DataFrame, group: str | Sequence[str], measure: str, n: int, *tie: str) -> DataFrame:
    """The n largest rows of each group with their rank; tasks drop rows beyond n before the shuffle."""
    groups = [group] if isinstance(group, str) else list(group)
    w = W.partitionBy(*groups).orderBy(F.col(measure).desc(), *[F.col(t) for t in tie])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def share_of_total(report: DataFrame, shares: Mapping[str, str], digits: int | None = None) -> DataFrame:
    """Percent of the grand total for each measure. The report is written once; the totals are scalar sub-queries over what was
    written, so it is neither worked out twice nor gathered into one window partition."""
    report = stored(report, "report")

    def share(c: str) -> Column:
        total = report.agg(F.sum(c)).scalar()
        value = F.col(c) / F.nullif(total, F.lit(0)) * 100
        return value if digits is None else F.round(value, digits)

    return report.withColumns({alias: share(c) for c, alias in shares.items()})


def cumulative_share(df: DataFrame, measure: str, tie: str, share: str = "share", running: str = "cumulative_share") -> DataFrame:
    """Percent of the total per row and its running sum in descending order of the measure."""
    shares = share_of_total(df, {measure: share})
    ranked = running_totals(
        shares.withColumn("_m", F.col(measure)), "_m", tie, {running: F.col(share)}, descending=True
    )
    return ranked.drop("_m")
