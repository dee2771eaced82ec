"""Importance resampling towards a target text: hashed n-gram features, weights by log ratios, a draw without replacement by Gumbel scores.

Texts are lower-cased (A-Z) and every run of separators becomes one blank, so an n-gram is a substring: an expression with boundary
lookarounds, scanned with overlapping matches, gives its spans directly, and the bytes of each span are hashed by CRC-32 into ``buckets``.
Every text is scanned once; its buckets and counts are kept packed in a written table, from which the corpus counts (a row per bucket) and
then the weights are taken. The gains are an array of ``buckets`` numbers, the only thing that goes to every task.

The draw ranks rows by (score, id) in ranges of bounded rows: a row's rank is its place in its range plus the rows of the ranges before.

Defined cases: null text has no features and weight 0; a null id is written as the empty text after the seed and comes last among ties; rows
of one id each are ranked, equal ones in any order; an empty target or an empty table gives gains of a uniform bucket count; extra columns
are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import packed, ship, whole_text
from skyfold.session import shuffle_width, stored

LEAST, MOST = 1, 1
BUCKETS, SEED = 10_000, 2024
LEAST_WORDS, DRAWN_PERCENT, SCALE = 20, 10, 1000
#: Rows of one range while ranking, at least and at most.
RANGE_LEAST, RANGE_MOST = 20_000, 1_000_000
#: Features a batch of the written table holds at most, beyond one text.
_BATCH_FEATURES = 500_000

#: A-Z become a-z; digits, letters and bytes of non-ASCII characters stay; the rest becomes a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FEATURES = "doc_id long, tie long, n_words long, n_features long, buckets binary, counts binary"


def gram_patterns(least: int = LEAST, most: int = MOST) -> list[regex.Pattern]:
    """One expression per length: whole words between single blanks, neither end inside a word."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (k - 1)) for k in range(least, most + 1)]


def collapsed(text: bytes) -> bytes:
    """Lower-cased words with one blank between them."""
    return b" ".join(text.translate(_WORDS).split())


def feature_spans(line: bytes, patterns: list[regex.Pattern]):
    """(start, end) of every n-gram of a collapsed text."""
    for p in patterns:
        for m in p.finditer(line, overlapped=True):
            yield m.span()


def text_buckets(line: bytes, patterns: list[regex.Pattern], buckets: int) -> np.ndarray:
    crc = zlib.crc32
    hashed = np.fromiter((crc(line[a:b]) for a, b in feature_spans(line, patterns)), np.uint32)
    return hashed % np.uint32(buckets)


def features(texts: DataFrame, least: int = LEAST, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """Per row of ``doc_id``, ``text``: words, features, and its different buckets with counts as packed unsigned 32-bit integers."""
    ship(texts.sparkSession)

    def scan(batches):
        patterns = gram_patterns(least, most)
        names = ("doc_id", "tie", "n_words", "n_features", "buckets", "counts")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            out, held = {n: [] for n in names}, 0
            for doc_id, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                line = collapsed(text.as_py())
                found, n = np.unique(text_buckets(line, patterns, buckets), return_counts=True)
                values = (doc_id, tie, line.count(b" ") + bool(line), int(n.sum()), found.astype("<u4").tobytes(), n.astype("<u4").tobytes())
                for name, v in zip(names, values, strict=True):
                    out[name].append(v)
                held += len(found)
                if held > _BATCH_FEATURES:
                    yield pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in zip(names, types, strict=True)})
                    out, held = {n: [] for n in names}, 0
            yield pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in zip(names, types, strict=True)})

    text = whole_text()
    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(scan, _FEATURES)


def _flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows of ``found``; every task hands on one row per bucket."""

    def add(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, _flat(batch.column(0)), _flat(batch.column(1)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    rows = found.select("buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, np.int64)
    for r in rows:  # at most one per bucket
        total[r["bucket"]] = r["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of the smoothed shares of each bucket in the target and in the corpus."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    odds = [((float(t) + 1) * (s_all + size)) / ((float(s) + 1) * (t_all + size)) for s, t in zip(corpus, target, strict=True)]
    return np.array([math.floor(SCALE * math.log(x)) for x in odds], np.int64)


def scored(found: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """Weight and Gumbel score of every row of the features ``found``."""

    def weigh(batches):
        for batch in batches:
            cells = gain[_flat(batch.column("buckets"))] * _flat(batch.column("counts"))
            ends = np.cumsum([len(b) // 4 for b in batch.column("buckets").to_pylist()], dtype=np.int64)
            upto = np.concatenate([[0], np.cumsum(cells)])
            weight = upto[ends] - upto[np.concatenate([[0], ends[:-1]])] if len(ends) else ends
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "tie", "n_words", "n_features")], pa.array(weight, pa.int64())], names=["doc_id", "tie", "n_words", "n_features", "weight"])

    rows = found.mapInArrow(weigh, "doc_id long, tie long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-float(SCALE) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def draw(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT) -> DataFrame:
    """``rank`` of the drawn rows of ``rows`` (stored), null for all others."""
    spark = rows.sparkSession
    able = rows.filter(F.col("n_words") >= least_words)
    n = able.count()
    ranges = max(math.ceil(n / RANGE_MOST), min(shuffle_width(spark), math.ceil(n / RANGE_LEAST)), 1)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("tie"), F.asc("_row")]
    placed = able.withColumn("_row", F.monotonically_increasing_id())  # parts rows equal in everything
    placed = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = stored(placed.drop("_row"), "draw")
    part = F.shiftright("_place", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    rank = F.col("_base") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("_part", part).join(bases, "_part").withColumn("rank", rank)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank"))).drop("_part", "_base", "_place")
    return ranked.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def importance(docs: DataFrame, target: DataFrame, least: int = LEAST, most: int = MOST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document's features, weight, score and rank among the drawn; ``target`` has a column ``text``."""
    found = stored(features(docs, least, most, buckets), "features")
    aims = stored(features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), least, most, buckets), "target_features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(aims, buckets))
    rows = stored(scored(found, gain, seed), "scores")
    return draw(rows)


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return importance(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The drawn rows of ``docs``, with its columns; rows of one id and one text are drawn together."""
    drawn = importance(docs, target).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn_id"), F.col("tie").alias("_drawn_tie"))
    rows = packed(docs, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text()).alias("_tie"))
    same = rows["_id"].eqNullSafe(drawn["_drawn_id"]) & (rows["_tie"] == drawn["_drawn_tie"])
    return rows.join(drawn, same, "left_semi").select("_row.*")


RESAMPLE_SQL = rf"""
WITH steps AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t
  FROM range(256) r(i)),
crc_table AS (SELECT list(t ORDER BY i) AS tab FROM steps),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
dw AS (SELECT r, unnest(words) AS word FROM d),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM b)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h)::BIGINT, 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
                               lambda c, x: xor(c // 256, tab[1 + xor(c % 256, x)])), 4294967295) % {BUCKETS} AS bucket
  FROM hexed, crc_table),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s_all, (SELECT count(*) FROM b)::DOUBLE AS t_all),
gain AS (
  SELECT s.bucket, CAST(floor({SCALE} * ln(((coalesce(t.n, 0)::DOUBLE + 1) * (s_all + {BUCKETS})) / ((s.n::DOUBLE + 1) * (t_all + {BUCKETS})))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT r, sum(g) AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-{SCALE}.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
         count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {LEAST_WORDS} AND place <= {DRAWN_PERCENT} * n // 100 THEN place END AS rank
FROM ranked
"""
