"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens: it hashes the tokens it looks at and ignores the others, so an overlap with some
substituted tokens still shares seeds. Seeds of the benchmark join those of the documents by hash; each joined pair names a diagonal (the
offset between both texts), and the tokens of both texts along it are compared. Some stretch with four in five tokens equal must reach the least
length (that of the item, if it is shorter). Reported is the best stretch, or the longest where the best is too short.

Few of the documents' seeds are the benchmark's. A bit table of fixed size (2 MB), set from the benchmark's seeds, keeps the
others from leaving the task that reads the documents; what passes by chance fails the exact join.

Tokens are the words in lower case without marks at either end; words of marks alone are left out. Defined cases: null or empty texts hold
nothing, on both sides; equal items and equal rows are each reported; items shorter than a seed are found when all their tokens stand in a
row; an overlap whose substitutions leave no seed whole is not found; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import lean, ship, whole_text
from skyfold.session import stored

#: Offsets each mask looks at.
MASKS = (
    (0, 1, 2, 3, 4, 5, 6),
    (0, 1, 3, 6, 7, 9, 10),
    (0, 1, 2, 5, 7, 9, 10),
    (0, 1, 3, 4, 7, 9, 10),
)
LEAST_TOKENS = 12
#: A mismatch costs what so many matches earn: stretches above zero have at least four in five tokens equal.
MISMATCH = 4
_BITS = 24
_BLOCK = 1 << 21
_KEPT_WORDS = 400_000


def _token(word: bytes) -> int:
    """Hash of a word without case and outer marks; 0 for marks alone."""
    s = word.decode().lower()
    lo, hi = 0, len(s)
    while lo < hi and not s[lo].isalnum():
        lo += 1
    while hi > lo and not s[hi - 1].isalnum():
        hi -= 1
    return xxhash.xxh64_intdigest(s[lo:hi].encode()) or 1 if lo < hi else 0


class Tokens:
    """Token hashes of texts; the hashes of words are kept up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        split = text.split()
        if len(self.known) > _KEPT_WORDS:
            self.known.clear()
        known = self.known
        for w in {w for w in split if w not in known}:
            known[w] = _token(w)
        out = np.fromiter(map(known.__getitem__, split), np.uint64, len(split))
        return out[out != 0] if len(out) else out


def _masks(short: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The fixed masks and, for items shorter than all of them, one of exactly the item's length."""
    return [*MASKS, *(tuple(range(n)) for n in short)]


def seeds(tokens: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Hash of each position under a mask, for positions the mask fits at."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(number * 2 + 1))
    for off in mask:
        out = (out ^ tokens[off : off + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the table a hash stands for."""
    low = np.uint64((1 << _BITS) - 1)
    return hashes & low, (hashes >> np.uint64(_BITS)) & low


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with the most matches after paying for mismatches; of equal ones the longest."""
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    lowest = np.minimum.accumulate(gain)
    over = gain - lowest
    end = int(np.flatnonzero(over == over.max())[-1]) if over.max() > 0 else 0
    start = int(np.flatnonzero(gain[: end + 1] == lowest[end])[0])
    return start, end, int(equal[start:end].sum())


def longest_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the longest stretch with at least four in five tokens equal; of equal ones the first."""
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    # The first place with a sum no higher than that of the end is a new lowest one.
    starts = np.searchsorted(-np.minimum.accumulate(gain), -gain)
    end = int(np.argmax(np.arange(len(gain)) - starts))
    start = int(starts[end])
    return start, end, int(equal[start:end].sum())


ITEMS = "item_id long, item long, tokens array<long>, hash array<long>, pos array<int>"
REGIONS = "doc_id long, tie long, region long, start long, tokens array<long>, hash array<long>, pos array<long>"
OVERLAPS = "doc_id long, tie long, item_id long, doc_token long, n_tokens long, n_equal long"


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    flat = np.concatenate([*values, np.empty(0, np.int64)]).astype(np.int64)
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat).cast(kind))


def _items(benchmark: DataFrame, short: tuple[int, ...]) -> DataFrame:
    """Each item's tokens and seeds; ``item`` tells rows apart whatever their ids."""

    def read(batches):
        tokens = Tokens()
        for batch in batches:
            ids, number = batch.column("item_id").to_pylist(), batch.column("item").to_pylist()
            sets = [tokens.of(t.as_py()) for t in batch.column("text")]
            hashes, places = [], []
            for s in sets:
                found = [seeds(s, m, k) for k, m in enumerate(_masks(short)) if k < len(MASKS) or len(m) == len(s)]
                hashes.append(np.concatenate(found).view(np.int64))
                places.append(np.concatenate([np.arange(len(f)) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(number, pa.int64()), _lists([s.view(np.int64) for s in sets], pa.int64()), _lists(hashes, pa.int64()), _lists(places, pa.int32())],
                names=["item_id", "item", "tokens", "hash", "pos"],
            )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.monotonically_increasing_id().alias("item"), whole_text().cast("binary").alias("text"))
    return rows.mapInArrow(read, ITEMS)


def _short_lengths(benchmark: DataFrame) -> tuple[int, ...]:
    """Token counts below the shortest mask that occur: at most six numbers."""

    def count(batches):
        tokens = Tokens()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(tokens.of(t.as_py())) for t in batch.column(0)], pa.int64())})

    least = min(m[-1] + 1 for m in MASKS)
    found = benchmark.select(whole_text().cast("binary").alias("text")).mapInArrow(count, "n long")
    return tuple(sorted(r["n"] for r in found.filter((F.col("n") > 0) & (F.col("n") < least)).distinct().collect()))


def _bit_table(items: DataFrame) -> np.ndarray:
    """Bits of all benchmark seeds; combined per 64-bit word on the executors, at most 2**18 words."""
    low = (1 << _BITS) - 1
    one = items.select(F.explode("hash").alias("h"))
    one = one.select(F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", _BITS).bitwiseAND(low))).alias("bit"))
    words = one.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits"))
    table = np.zeros(1 << (_BITS - 6), np.int64)
    for r in words.collect():
        table[r["word"]] = r["bits"]
    return table.view(np.uint8)


def _regions(docs: DataFrame, table: np.ndarray, masks: list[tuple[int, ...]], reach: int) -> DataFrame:
    """Stretches of documents with benchmark seeds in them, and ``reach`` tokens to either side."""

    def read(batches):
        tokens, number = Tokens(), 0

        def blocks():
            block, size = [], 0
            for batch in batches:
                for i, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    block.append((i, tie, tokens.of(text.as_py())))
                    size += len(block[-1][2])
                    if size >= _BLOCK // 8:
                        yield block
                        block, size = [], 0
            if block:
                yield block

        for block in blocks():
            ends = np.cumsum([len(t) for _, _, t in block])
            flat = np.concatenate([t for _, _, t in block])
            spots, hashes = [], []
            for k, mask in enumerate(masks):
                h = seeds(flat, mask, k)
                a, b = _places(h)
                hit = np.flatnonzero(table[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8) & 1)
                b = b[hit]
                hit = hit[(table[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                of = np.searchsorted(ends, hit, "right")
                inside = of == np.searchsorted(ends, hit + mask[-1], "right")
                spots.append(hit[inside])
                hashes.append(h[hit[inside]])
            spot, hash_ = np.concatenate(spots), np.concatenate(hashes)
            if not len(spot):
                continue
            order = np.argsort(spot, kind="stable")
            spot, hash_ = spot[order], hash_[order].view(np.int64)
            of = np.searchsorted(ends, spot, "right")
            new = np.ones(len(spot), bool)
            new[1:] = (of[1:] != of[:-1]) | (spot[1:] - spot[:-1] > reach)
            first = np.flatnonzero(new)
            rows = {n: [] for n in ("doc_id", "tie", "region", "start", "tokens", "hash", "pos")}
            for lo, hi in zip(first, np.append(first[1:], len(spot)), strict=True):
                d = int(of[lo])
                begin = int(ends[d]) - len(block[d][2])
                left = max(begin, int(spot[lo]) - reach)
                right = min(int(ends[d]), int(spot[hi - 1]) + max(m[-1] for m in masks) + 1 + reach)
                number += 1
                for name, v in zip(rows, (block[d][0], block[d][1], number, left - begin, flat[left:right].view(np.int64), hash_[lo:hi], spot[lo:hi] - begin), strict=True):
                    rows[name].append(v)
            if rows["region"]:
                plain = [pa.array(rows[n], pa.int64()) for n in ("doc_id", "tie", "region", "start")]
                lists = [_lists(rows[n], pa.int64()) for n in ("tokens", "hash", "pos")]
                yield pa.RecordBatch.from_arrays([*plain, *lists], names=list(rows))

    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    found = rows.mapInArrow(lean(read), REGIONS)
    # Numbers count within a task; the task's own number makes them unique in the table that is written once.
    return found.withColumn("region", F.monotonically_increasing_id())


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """One row per document row and item it holds: where, how many tokens long, and how many of them are equal."""
    ship(docs.sparkSession)
    short = _short_lengths(benchmark)
    items = stored(_items(benchmark, short), "items")
    longest = items.agg(F.max(F.size("tokens")).alias("n")).first()["n"] or 0
    regions = stored(_regions(docs, _bit_table(items), _masks(short), int(longest)), "regions")

    hits = regions.select("region", F.explode(F.arrays_zip("hash", "pos")).alias("h")).select("region", "h.hash", F.col("h.pos").alias("at"))
    marks = items.select("item", F.explode(F.arrays_zip("hash", "pos")).alias("h")).select("item", "h.hash", "h.pos")
    diagonals = hits.join(marks, "hash").select("region", "item", (F.col("at") - F.col("pos")).alias("shift")).distinct()

    def verify(batches):
        for batch in batches:
            out = {n: [] for n in ("doc_id", "tie", "item_id", "doc_token", "n_tokens", "n_equal")}
            cols = [batch.column(n).to_pylist() for n in ("doc_id", "tie", "item_id", "start", "shift")]
            for k, (doc_id, tie, item_id, start, shift) in enumerate(zip(*cols, strict=True)):
                doc = batch.column("tokens")[k].values.to_numpy()
                item = batch.column("item_tokens")[k].values.to_numpy()
                at = shift - start  # place of the item's first token in the region
                lo, hi = max(0, -at), min(len(item), len(doc) - at)
                same = doc[at + lo : at + hi] == item[lo:hi]
                begin, end, equal = best_stretch(same)
                if end - begin < min(least, len(item)):
                    begin, end, equal = longest_stretch(same)
                if end - begin >= min(least, len(item)):
                    for name, v in zip(out, (doc_id, tie, item_id, shift + lo + begin, end - begin, equal), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()})

    tested = (
        diagonals.join(regions.select("region", "doc_id", "tie", "start", "tokens"), "region")
        .join(items.select("item", "item_id", F.col("tokens").alias("item_tokens")), "item")
        .select("doc_id", "tie", "item_id", "start", "shift", "tokens", "item_tokens")
        .mapInArrow(verify, OVERLAPS)
    )
    best = F.max_by(F.struct("doc_token", "n_tokens", "n_equal"), F.struct(F.col("n_equal"), -F.col("doc_token")))
    return tested.groupBy("doc_id", "tie", "item_id").agg(best.alias("b")).select("doc_id", "tie", "item_id", "b.*")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark passage, with the passage and the overlap."""
    found = overlaps(docs, benchmark)
    return found.select("doc_id", "item_id", "doc_token", "n_tokens", "n_equal", F.round(F.col("n_equal") / F.col("n_tokens"), 4).alias("identity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage."""
    bad = stored(overlaps(docs, benchmark).select(F.col("doc_id").alias("_bad_id"), F.col("tie").alias("_bad_tie")).distinct(), "leaks")
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text()).alias("_tie"))
    same = row["_id"].eqNullSafe(bad["_bad_id"]) & (row["_tie"] == bad["_bad_tie"])
    return row.join(bad, same, "left_anti").select("_row.*")
