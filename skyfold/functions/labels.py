"""Labels, bins and code lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Compass sectors, clockwise from north, 45 degrees each.
SECTORS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sector_label(degrees: Column | str) -> Column:
    """Compass sector of a wind direction: ``Calm`` for null, 0 and 360, ``OTHER`` for text that is no number.

    Each sector is centred on its compass point, so its index is one floor division; what lies outside
    0..360 counts as north.
    """
    raw = _c(degrees)
    d = raw.try_cast("double")
    index = F.when((d >= 337.5) | (d < 22.5), F.lit(0)).otherwise(F.floor((d + 22.5) / 45).cast("int"))
    names = F.array(*[F.lit(s) for s in SECTORS])
    return (
        F.when(raw.isNull() | d.isin(0.0, 360.0), F.lit("Calm"))
        .when(d.isNull(), F.lit("OTHER"))
        .otherwise(F.get(names, index))
    )


def bin_label(value: Column | str, uppers: Sequence[tuple[float, str]], last: str, null_label: str | None = None) -> Column:
    """Label of the first bin whose upper bound exceeds the value, else ``last``.

    Nulls fall through to ``last`` unless ``null_label`` names a bin of their own.
    """
    value = _c(value)
    chain = F.when(value.isNull(), F.lit(null_label)) if null_label is not None else F
    for upper, label in uppers:
        chain = chain.when(value < upper, F.lit(label))
    return chain.otherwise(F.lit(last))


def label_codes(code: Column | str, names: Mapping[int | str, str]) -> Column:
    """Name of a code from a short fixed list; unknown codes give null."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(code))


def category_rank(col: Column | str, order: Sequence[str]) -> Column:
    """Position of a category in a given order, to sort by; unknown categories come last."""
    return F.coalesce(label_codes(col, {name: i for i, name in enumerate(order)}), F.lit(len(order)))


def order_by_category(df: DataFrame, col: str, order: Sequence[str], *then: str) -> DataFrame:
    return df.orderBy(category_rank(col, order), *then)


def status_label(cancelled: Column | str, delayed: Column | str) -> Column:
    return (
        F.when(_c(cancelled) == 1, F.lit("Canceled")).when(_c(delayed) == 1, F.lit("Delayed")).otherwise(F.lit("On Time"))
    )


def cause_name(column: str) -> str:
    """``LATE_AIRCRAFT_DELAY`` -> ``Late Aircraft``."""
    return column.upper().removesuffix("_DELAY").replace("_", " ").title()


def active_causes(columns: Sequence[str]) -> Column:
    """Names of the cause columns above zero, as an array in column order."""
    return F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(cause_name(c))) for c in columns]))


def cause_combo(columns: Sequence[str], sep: str = " & ") -> Column:
    """The active causes as one label, empty without any."""
    return F.concat_ws(sep, active_causes(columns))


def explode_causes(df: DataFrame, columns: Sequence[str], alias: str = "cause") -> DataFrame:
    """One row per active cause."""
    return df.withColumn(alias, F.explode(active_causes(columns)))


def thousands_label(value: Column | str) -> Column:
    """``200000`` -> ``200K``, ``1500`` -> ``1.5K``, below 1000 unchanged; ``x.25K`` and ``x.75K`` go to the even digit."""
    v = _c(value).cast("long")
    tenths = F.when(F.pmod(v, F.lit(500)) == 250, F.bround(v / 1000, 1)).otherwise(v / 1000)
    return (
        F.when((v >= 1000) & (F.pmod(v, F.lit(1000)) == 0), F.format_string("%dK", F.floor(v / 1000)))
        .when(v >= 1000, F.format_string("%.1fK", tenths))
        .otherwise(v.cast("string"))
    )


def composite_id(*parts: Column | str, sep: str = "_") -> Column:
    """Joined id; null parts are left out."""
    return F.concat_ws(sep, *[_c(p).cast("string") for p in parts])


def route_label(origin: Column | str, dest: Column | str, sep: str = " → ") -> Column:
    return F.concat_ws(sep, _c(origin), _c(dest))


def split_coordinates(col: Column | str) -> tuple[Column, Column]:
    """``"a,b"`` -> both parts as written; a missing second part is null."""
    parts = F.split(_c(col), ",")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def signed_log(col: Column | str) -> Column:
    """``sign(x) * log1p(|x|)``: compresses both tails and keeps the sign."""
    c = _c(col)
    return F.signum(c) * F.log1p(F.abs(c))
