"""Sharding by sampled splitters, in DataFrame functions only.

Rows are ordered by a hash of their text, so equal texts lie together. A sample drawn with a probability in proportion to
a row's size gives quantile boundaries (the splitters), which cut the order into many more ranges than shards. The bytes of each range
are then counted exactly over all rows; a range above twice its share is subdivided by a hash of the text, and a text that is itself above
twice the share by a hash of the id. Whole ranges go to shards in order, so that the shards' bytes are nearly equal (law ``bytes``) and only texts
above such a share are spread over shards.

Defined cases: a null text has no bytes (size 1) and the crc of the empty text; null ids order first; identical rows stay
together unless they fill more than a range; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import whole_text
from skyfold.session import stored

#: Keys have 52 bits, so a double holds them exactly.
_KEY_BITS = 52


def _unit(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - _KEY_BITS) / F.lit(float(1 << _KEY_BITS))


def keyed(docs: DataFrame) -> DataFrame:
    """Per row: id, size, crc and the 52-bit key of the text."""
    text = whole_text()
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - _KEY_BITS).alias("key"),
    )


def splitters(rows: DataFrame, total: int, ranges: int, sample: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of about ``sample`` keys (at most twice that)."""
    rate = sample / max(total, 1)
    drawn = rows.filter(_unit("key", "doc_id", F.lit("splitter")) < F.col("size") * rate)
    weight = F.greatest(F.lit(1), F.round(F.col("size") * rate)).cast("long")
    points = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = drawn.agg(F.percentile("key", points, weight).alias("p")).first()["p"]
    return sorted({int(x) for x in found or []})


def _search(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted boundaries are at or below the key, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    table = F.lit(bounds)
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key), at + step
        ).otherwise(at),
    )


def shard(rows: DataFrame, shards: int = 16, ranges_per_shard: int = 64, sample: int = 20_000) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows of ``keyed``.

    What reaches the driver is bounded by parameters: the total, the boundaries and a count per overfull range and hot text. ``sample`` bounds the
    keys that boundaries are taken from; sizes are always counted over all rows.
    """
    ranges = shards * ranges_per_shard
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    ranged = rows.withColumn("range", _search(F.col("key"), splitters(rows, total, ranges, sample)))
    ranged = stored(ranged, "ranges")
    share = max(1.0, total / ranges)
    by_range = ranged.groupBy("range").agg(F.sum("size").alias("n")).filter(F.col("n") > 2 * share).collect()
    rest = {r["range"]: r["n"] for r in by_range}
    hot = []
    if rest:
        by_key = ranged.filter(F.col("range").isin(list(rest))).groupBy("range", "key").agg(F.sum("size").alias("n"))
        hot = sorted(by_key.filter(F.col("n") > 2 * share).collect(), key=lambda r: r["key"])  # at most half as many as there are ranges
    for r in hot:
        rest[r["range"]] -= r["n"]
    pieces = [1] * (ranges + 1)
    for at, n in rest.items():
        pieces[at] = max(1, int(-(-n // share)))
    # Texts stay whole, but for hot ones: their rows are dealt by id to pieces of their own, behind the others of their range.
    piece = F.pmod(F.xxhash64("key"), F.get(F.lit(pieces), F.col("range")).cast("long"))
    if hot:
        behind, first, own = dict(enumerate(pieces)), [], []
        for r in hot:
            first.append(behind[r["range"]])
            own.append(int(-(-r["n"] // share)))
            behind[r["range"]] += own[-1]
        keys = [r["key"] for r in hot]
        at = _search(F.col("key"), keys) - 1
        dealt = F.get(F.lit(first), at) + F.pmod(F.xxhash64("doc_id", "key"), F.get(F.lit(own), at).cast("long"))
        piece = F.when(F.get(F.lit(keys), at) == F.col("key"), dealt).otherwise(piece)
    cut = ranged.withColumn("piece", piece.cast("int"))

    # One row per piece: at most three times as many as there are ranges.
    before = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        cut.groupBy("range", "piece")
        .agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        .withColumn("middle", F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("n") / 2)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / max(total, 1))).cast("int"))
    )
    inside = Window.partitionBy("shard").orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("range", "piece", "shard", F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("base"))
    order = Window.partitionBy("range", "piece").orderBy("key", "doc_id", "text_crc32")
    return (
        cut.withColumn("_n", F.row_number().over(order))
        .join(placed, ["range", "piece"])
        .withColumn("slot", F.col("base") + F.col("_n") - 1)
        .drop("base", "_n")
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The digest of all documents: where each row lies, under the law ``bytes``."""
    return shard(keyed(docs), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
