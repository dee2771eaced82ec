"""Questions from segments of documents to counts over all of them, in packed rows.

Documents are dealt to segments of bounded size by hash. A segment's distinct keys (n-grams, words, shingles) travel as sorted, packed arrays, one row
per (segment, bucket of keys); a bucket sees the keys of all segments, and its answers go back as arrays in the order of the
keys asked about. A segment derives the same keys again from its documents, so answers need not repeat them. Shuffled are a few bytes per
distinct key and segment instead of a row per key, or per occurrence.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import give_back, lean, whole_text

#: Bytes of text in a segment, and bytes of text per bucket of keys.
SEGMENT_BYTES = 16 << 20
BUCKET_BYTES = 24 << 20
#: A task packs documents whenever it holds so many bytes of them.
_PACKED_BYTES = 48 << 20


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0


def segmented(docs: DataFrame, total: int, *extra) -> DataFrame:
    """Documents as packed rows (``seg``, ``body``): each body holds many documents of a segment, compressed together.

    A body has ``doc_id``, ``text`` (bytes, empty for null) and the ``extra`` columns; ``unpacked`` gives them back.
    """
    n = max(1, -(-total // SEGMENT_BYTES))
    text = whole_text()
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", text), F.lit(n)).cast("int").alias("seg"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text.cast("binary").alias("text"),
        *extra,
    )

    def pack(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0

        def flush():
            segs, bodies = [], []
            for seg, parts in held.items():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(pa.Table.from_batches(parts).combine_chunks())
                segs.append(seg)
                bodies.append(sink.getvalue().to_pybytes())
            held.clear()
            return pa.RecordBatch.from_pydict({"seg": pa.array(segs, pa.int32()), "body": pa.array(bodies, pa.binary())})

        for batch in batches:
            own = batch.column(0).to_numpy()
            rest = batch.select(batch.schema.names[1:])
            order = np.argsort(own, kind="stable")
            ids, sizes = runs(own.copy())
            for seg, end, k in zip(ids.tolist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                held.setdefault(seg, []).append(rest.take(pa.array(order[end - k : end])))
            size += batch.nbytes
            if size >= _PACKED_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return rows.mapInArrow(lean(pack), "seg int, body binary")


def unpacked(table: pa.Table) -> pa.Table:
    """The documents of a segment, from its packed rows."""
    return pa.concat_tables([pa.ipc.open_stream(body.as_buffer()).read_all() for body in table.column("body")])


def bucket_count(total: int) -> int:
    return max(16, -(-total // BUCKET_BYTES))


def _planes(a: np.ndarray) -> bytes:
    """Bytes by significance, so that equal high bytes lie together."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def _unplanes(raw: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0))) if len(keys) else b""


def unpack_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplanes(raw, n, np.uint64), dtype=np.uint64) if n else np.empty(0, np.uint64)


def pack_values(values: np.ndarray) -> bytes:
    return _planes(values) if len(values) else b""


def unpack_values(raw: bytes, n: int, kind) -> np.ndarray:
    return _unplanes(raw, n, kind) if n else np.empty(0, kind)


def counted(chunks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts. Empties ``chunks``: they are not held beside what is made of them."""
    if not chunks:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ordered = len(chunks) == 1
    keys, counts = chunks[0] if ordered else (np.concatenate([c[i] for c in chunks]) for i in (0, 1))
    chunks.clear()
    if not ordered:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        counts = counts[order]
        del order
    if not len(keys):
        return keys, counts
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    if new.all():
        return keys, counts
    counts = np.add.reduceat(counts, np.flatnonzero(new))
    return keys[new], counts


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``a`` in order and how often each occurs; sorts ``a`` in place."""
    a.sort()
    if not len(a):
        return a, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return a[first], np.diff(np.append(first, len(a)))


def _bounds(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """Each bucket that occurs, and where its keys begin and end in the order of buckets."""
    sizes = np.bincount(bucket)
    ids, ends = np.flatnonzero(sizes), np.cumsum(sizes)
    return [(int(b), int(ends[b] - sizes[b]), int(ends[b])) for b in ids]


ASKED = "seg int, bucket int, n int, keys binary, counts binary"
ANSWERED = "seg int, bucket int, n int, answers binary"


def asked_rows(seg: int, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.Table:
    """One packed row per bucket of a segment's keys. ``keys`` ascend; ``bucket`` gives each its bucket."""
    order, out = np.argsort(bucket, kind="stable"), []
    for b, lo, hi in _bounds(bucket):
        some = order[lo:hi]
        out.append((b, hi - lo, pack_keys(keys[some]), pack_values(counts[some].astype(np.int64))))
    return pa.table(
        {
            "seg": pa.array([seg] * len(out), pa.int32()),
            "bucket": pa.array([r[0] for r in out], pa.int32()),
            "n": pa.array([r[1] for r in out], pa.int32()),
            "keys": pa.array([r[2] for r in out], pa.binary()),
            "counts": pa.array([r[3] for r in out], pa.binary()),
        }
    )


def all_asked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a bucket over all segments, and their summed counts."""
    sizes = table.column("n").to_pylist()
    keys = (unpack_keys(k.as_py(), n) for k, n in zip(table.column("keys"), sizes, strict=True))
    counts = (unpack_values(c.as_py(), n, np.int64) for c, n in zip(table.column("counts"), sizes, strict=True))
    return counted(list(zip(keys, counts, strict=True)))


def answer(asked: DataFrame, reply: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Per bucket: ``reply`` gets all distinct keys with their summed counts and returns a value for each."""

    def solve(table: pa.Table) -> pa.Table:
        distinct, totals = all_asked(table)
        values = reply(distinct, totals)
        del totals
        packed = []
        for raw, n in zip(table.column("keys"), table.column("n").to_pylist(), strict=True):
            packed.append(pack_values(values[np.searchsorted(distinct, unpack_keys(raw.as_py(), n))]))
        del distinct, values
        give_back()
        return table.select(["seg", "bucket", "n"]).append_column("answers", pa.array(packed, pa.binary()))

    return asked.groupBy("bucket").applyInArrow(solve, ANSWERED)


def answers_of(table: pa.Table, keys: np.ndarray, bucket: np.ndarray, kind) -> np.ndarray:
    """The answers a segment got, in the order of its ``keys``."""
    order = np.argsort(bucket, kind="stable")
    place = {b: (lo, hi) for b, lo, hi in _bounds(bucket)}
    sorted_values = np.empty(len(keys), kind)
    for b, n, raw in zip(table.column("bucket").to_pylist(), table.column("n").to_pylist(), table.column("answers"), strict=True):
        lo, hi = place[b]
        if hi - lo != n:
            raise ValueError("answers do not fit the keys asked about")
        sorted_values[lo:hi] = unpack_values(raw.as_py(), n, kind)
    out = np.empty_like(sorted_values)
    out[order] = sorted_values
    return out
