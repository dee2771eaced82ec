"""Filters, projections, joins, set operations, sorts and limits.

No join carries a broadcast hint: Catalyst and adaptive execution broadcast a side after checking its
size and otherwise fall back to a shuffled join with skew splitting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- filters and projections


def date_between(df: DataFrame, col: str, lo: str, hi: str) -> DataFrame:
    """Rows whose date (or ISO text) lies in the range, both ends included; pushed into the scan."""
    return df.filter(F.col(col).between(lo, hi))


def operated_only(df: DataFrame, zero_flags: Sequence[str], code_cols: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """Rows with every flag 0 and no code in the exclusion list."""
    keep = [F.col(c) == 0 for c in zero_flags] + [~F.col(c).isin(list(excluded)) for c in code_cols]
    return where_all(df, *keep)


def where_all(df: DataFrame, *preds: Column | str) -> DataFrame:
    """Rows that satisfy every predicate, given as columns or SQL text."""
    return reduce(lambda acc, p: acc.filter(p), preds, df)


def contains(df: DataFrame, col: str, text: str) -> DataFrame:
    return df.filter(F.col(col).contains(text))


def dim_filter(df: DataFrame, equals: Mapping[str, Any], not_null: Sequence[str] = ()) -> DataFrame:
    """Dimension rows with the given values and no null in the given columns."""
    return where_all(df, *[F.col(c) == v for c, v in equals.items()], *[F.col(c).isNotNull() for c in not_null])


def code_length(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.filter(F.length(col) == n)


def prefix_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Only the mapped columns, under their new names, in mapping order."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def drop_matching(df: DataFrame, suffixes: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """Without the named columns and those ending in one of the suffixes."""
    gone = [c for c in df.columns if c in set(names) or c.endswith(tuple(suffixes))]
    return df.drop(*gone)


def in_box(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows inside (lat from, lat to, lon from, lon to), ends included; unreadable coordinates drop out."""
    lat_lo, lat_hi, lon_lo, lon_hi = box
    return df.filter(
        F.col(lat).try_cast("double").between(lat_lo, lat_hi) & F.col(lon).try_cast("double").between(lon_lo, lon_hi)
    )


def coerce(df: DataFrame, cols: Sequence[str], kind: str = "double", drop_bad: bool = True) -> DataFrame:
    """Cast columns; what cannot be read becomes null, and rows with such nulls go unless kept."""
    out = df.withColumns({c: F.col(c).try_cast(kind) for c in cols})
    return out.dropna(subset=list(cols)) if drop_bad else out


def any_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]))


def all_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols]))


def enforce_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast listed columns where the type differs; unreadable text becomes null."""
    have = dict(df.dtypes)
    todo = {c: F.col(c).try_cast(t) for c, t in types.items() if c in have and have[c] != t}
    return df.withColumns(todo) if todo else df


# ---------------------------------------------------------------- joins


def dim_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str = "inner") -> DataFrame:
    """Equi join of a fact with a dimension under differently named keys."""
    return fact.join(dim, fact[fact_key] == dim[dim_key], how)


def keep_used(dim: DataFrame, fact: DataFrame, dim_key: str, fact_key: str) -> DataFrame:
    """Rows whose key occurs in the other table.

    The fact keys are made distinct first, which combines map-side, so only one row per key and task
    is shuffled however long the fact is.
    """
    used = fact.select(F.col(fact_key).alias("_used")).distinct()
    return dim.join(used, dim[dim_key] == used["_used"], "left_semi")


def role_join(fact: DataFrame, dim: DataFrame, dim_key: str, role_key: str, names: Mapping[str, str]) -> DataFrame:
    """Left join of a dimension in one of its roles, its columns renamed for that role."""
    side = dim.select(F.col(dim_key).alias("_role_key"), *[F.col(c).alias(n) for c, n in names.items()])
    return fact.join(side, fact[role_key] == side["_role_key"], "left").drop("_role_key")


def fallback_dim(primary: DataFrame, backup: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """One dimension in which each column comes from the primary and, where null, from the backup.

    Merging the two small dimensions first means the fact is joined once per role instead of twice.
    Both must be unique on ``key``; columns only one side has are kept as they are.
    """
    p = primary.select(F.col(key).alias("_pk"), *[F.col(c).alias(f"_p_{c}") for c in primary.columns if c != key])
    b = backup.select(F.col(key).alias("_bk"), *[F.col(c).alias(f"_b_{c}") for c in backup.columns if c != key])
    pairs = p.join(b, p["_pk"] == b["_bk"], "full")

    def best(c: str) -> Column:
        sides = [F.col(f"_{s}_{c}") for s, d in (("p", primary), ("b", backup)) if c in d.columns]
        return F.coalesce(*sides).alias(c)

    return pairs.select(F.coalesce("_pk", "_bk").alias(key), *[best(c) for c in cols])


def fallback_join(
    fact: DataFrame,
    primary: DataFrame,
    backup: DataFrame,
    dim_key: str,
    fact_key: str,
    names: Mapping[str, str],
) -> DataFrame:
    """Role join against a primary dimension backed up column by column by a second one."""
    return role_join(fact, fallback_dim(primary, backup, dim_key, list(names)), dim_key, fact_key, names)


def nearest_per_key(df: DataFrame, key: str, distance: str, tie: str) -> DataFrame:
    """The row with the smallest distance for each key, ties to the smaller ``tie`` value.

    Two steps: a hash aggregate finds each key's smallest distance, a number a key, combined map-side; the rows that have it are joined back, and
    of those the first by ``tie`` stays, where every task drops all but one row a key before the shuffle. Rows are never
    sorted or carried through the aggregate. Rows without a distance count only when a key has no other.
    """
    least = df.groupBy(F.col(key).alias("_key")).agg(F.min(distance).alias("_least"))
    rows = df.join(least, F.col(key).eqNullSafe(F.col("_key")) & F.col(distance).eqNullSafe(F.col("_least"))).drop("_key", "_least")
    first = F.row_number().over(Window.partitionBy(key).orderBy(tie))
    return rows.withColumn("_r", first).filter("_r = 1").select(key, *[c for c in df.columns if c != key])


def attach_node_metrics(
    df: DataFrame, nodes: DataFrame, src: str, dst: str, src_cols: Mapping[str, str], dst_cols: Mapping[str, str],
    node: str = "node",
) -> DataFrame:
    """Node metrics on both ends of each edge row, from one node table."""
    return role_join(role_join(df, nodes, node, src, src_cols), nodes, node, dst, dst_cols)


def outer_merge(a: DataFrame, b: DataFrame, on: str, fill: float | int | None = 0) -> DataFrame:
    """Full outer merge of two reports; gaps get the fill value."""
    merged = a.join(b, on, "full")
    return merged if fill is None else merged.fillna(fill)


def lookup_first(df: DataFrame, dim: DataFrame, key: str, dim_key: str, cols: Mapping[str, str], order: str) -> DataFrame:
    """Attributes of the first dimension row per key (first by ``order``)."""
    first = F.row_number().over(Window.partitionBy(dim_key).orderBy(F.asc_nulls_last(order)))
    side = dim.select(dim_key, order, *[c for c in cols if c not in (dim_key, order)]).withColumn("_r", first).filter("_r = 1")
    return role_join(df, side.select(*dict.fromkeys([dim_key, *cols])), dim_key, key, cols)


def edges_within(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str = "node") -> DataFrame:
    """Edges both ends of which are in the node set."""
    chosen = nodes.select(node).distinct()
    s, d = chosen.withColumnRenamed(node, src), chosen.withColumnRenamed(node, dst)
    return edges.join(s, src, "left_semi").join(d, dst, "left_semi").select(*edges.columns)


# ---------------------------------------------------------------- set operations


def tagged_union(tables: Mapping[str, DataFrame], tag: str = "tag") -> DataFrame:
    """Rows of all tables by column name, each with the tag of its table."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole-row duplicates removed; copies are folded together before the shuffle."""
    return df.dropDuplicates()


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per column of either table: its type on both sides and where it occurs."""
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    rows = []
    for c in sorted(set(ta) | set(tb)):
        where = "both" if c in ta and c in tb else "left_only" if c in ta else "right_only"
        rows.append((c, ta.get(c), tb.get(c), where))
    return a.sparkSession.createDataFrame(
        rows, "column_name string, left_type string, right_type string, presence string"
    )


# ---------------------------------------------------------------- sorts, limits, extremes


def top_k(df: DataFrame, measure: str, k: int, *tie: str) -> DataFrame:
    """The k largest rows; each task keeps k rows, then they are merged."""
    return df.orderBy(F.col(measure).desc(), *[F.col(t) for t in tie]).limit(k)


def arg_extreme(df: DataFrame, measure: str, kind: str, *tie: str) -> DataFrame:
    """The whole row with the largest or smallest measure, ties to the smallest ``tie`` values."""
    measure_col = F.col(measure) if kind == "min" else -F.col(measure)
    order = F.struct(measure_col, *[F.col(t) for t in tie])
    known = df.filter(F.col(measure).isNotNull())
    return known.agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def preview(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
