"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words, joined by one blank and closed by an end byte. Each byte is eight binary decisions; each decision has a
tree of contexts (the last 0 to ``DEPTH`` bytes). A node's Krichevsky-Trofimov estimate comes from the training counts below it, and each node
weighs its own estimate against its children's, bottom up. The trained weights mix the estimates along a context's path, so a byte has a fixed
code length given the ``DEPTH`` bytes before it. That length is worked out once per distinct n-gram of the corpus, and a text's score is
the sum over its bytes.

Distribution: n-grams and words are counted per segment and asked about bucket-wise (``segments``). A bucket holds whole sub-trees below
two context bytes; only the tables of the two shallowest levels (at most 65,536 nodes) meet on the driver. Counts cover
every training text, without a cut on vocabulary or contexts; what is gathered grows with the corpus.

Defined cases: a null or empty text is the end alone; a null id is held out or not by the crc of the empty text; every row gives a row, repeated
ids included; without any training text all estimates are even; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm import segments
from skyfold.llm.common import fold_of, ship
from skyfold.session import stored

DEPTH = 5
FOLDS, HELD = 7, 2
END = b"\n"
_CHUNK = 1 << 21
_CHUNK_DOCS = 1 << 16
_HALF = float(np.log(np.sqrt(np.pi)))  # log gamma(1/2)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def body_of(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def chunks(bodies):
    """Blocks of (n-gram codes, number of the text per code): nearest byte first, predicted byte last."""
    buffer, owners, spans, size = [], [], [], 0

    def codes():
        raw = np.frombuffer(b"".join(buffer), np.uint8).astype(np.uint64)
        out = raw[DEPTH:].copy()
        for d in range(1, DEPTH + 1):
            out |= raw[DEPTH - d : len(raw) - d] << np.uint64(8 * (DEPTH - d + 1))
        ends = np.cumsum(spans)
        whole = np.ones(len(out), bool)
        for e in ends[:-1]:  # the first bytes of the next piece are context only
            whole[e - DEPTH : e] = False
        owner = np.repeat(np.array(owners, np.uint64), np.array(spans) - DEPTH)
        return out[whole], owner

    for i, body in enumerate(bodies):
        for lo in range(0, len(body), _CHUNK):
            piece = (body[lo - DEPTH : lo] if lo else END * DEPTH) + body[lo : lo + _CHUNK]
            buffer.append(piece)
            owners.append(i)
            spans.append(len(piece))
            size += len(piece)
            if size >= _CHUNK or len(owners) >= _CHUNK_DOCS:
                yield codes()
                buffer, owners, spans, size = [], [], [], 0
    if owners:
        yield codes()


def gram_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the two nearest context bytes, so that a bucket holds whole sub-trees."""
    top = keys >> np.uint64(8 * (DEPTH - 1))
    return ((top * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def word_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(20)).astype(np.int64) % buckets + buckets


def _distinct(table: pa.Table):
    """Of a segment: n-grams and their training counts, words in the order of their keys, keys and training counts."""
    held = np.array(table.column("held").to_pylist(), bool)
    train, words = Counter(), set()
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def bodies():
        for text, h in zip(table.column("text"), held, strict=True):
            split = words_of(text.as_py())
            words.update(split) if h else train.update(split)
            yield body_of(split)

    for codes, owner in chunks(bodies()):
        taught = ~held[owner.astype(np.int64)]
        found.append(segments.runs(codes[taught]))
        seen, _ = segments.runs(codes[~taught])
        found.append((seen, np.zeros(len(seen), np.int64)))
    grams, counts = segments.counted(found)
    train[b""] += int((~held).sum())
    names = list(train.keys() | words)
    keys = np.fromiter(map(word_key, names), np.uint64, len(names))
    order = np.argsort(keys)
    tally = np.fromiter((train[w] for w in names), np.int64, len(names))
    return grams, counts, [names[i] for i in order], keys[order], tally[order]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 1/2 and more: Stirling's series eight places further up."""
    y = x + 8.0
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n0, n1 = n0.astype(float), n1.astype(float)
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - 2 * _HALF - _log_gamma(n0 + n1 + 1.0)


def _levels(codes: np.ndarray, counts: np.ndarray):
    """(codes, counts) with contexts of DEPTH, DEPTH - 1, ... 2 bytes."""
    out = {DEPTH: (codes, counts)}
    for d in range(DEPTH - 1, 1, -1):
        codes, counts = segments.counted([((codes >> np.uint64(16) << np.uint64(8)) | (codes & np.uint64(255)), counts), (codes[:0], counts[:0])])
        out[d] = (codes, counts)
    return out


def _nodes(codes: np.ndarray, counts: np.ndarray, k: int):
    """Nodes of bit ``k``: their keys, zeros, ones, and the node of each code."""
    key = codes >> np.uint64(8 - k)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    bit = ((codes >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
    total = np.add.reduceat(counts, first)
    ones = np.add.reduceat(counts * bit, first)
    return key[first], total - ones, ones, np.cumsum(new) - 1


def _parent(key: np.ndarray, k: int) -> np.ndarray:
    """The node's key with the farthest context byte taken off."""
    return (key >> np.uint64(k + 8) << np.uint64(k)) | (key & np.uint64((1 << k) - 1))


def _trained(levels, k: int):
    """Per depth the nodes of bit ``k`` with own estimates and weights; and the weighted log probabilities at depth 2."""
    out, weighted, below = {}, None, None
    for d in range(DEPTH, 1, -1):
        key, n0, n1, of_code = _nodes(*levels[d], k)
        own = kt_log(n0, n1)
        if below is None:
            ratio, weighted = None, own
        else:
            children = np.bincount(np.searchsorted(key, _parent(below, k)), weights=weighted, minlength=len(key))
            ratio = own - children
            weighted = np.logaddexp(own, children) - np.log(2.0)
        out[d] = (key, n0, n1, ratio, of_code)
        below = key
    return out, weighted


SHALLOW = "byte int, node int, zeros long, ones long, below double"


def _shallow(codes: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Sums over a bucket's depth-2 nodes for their depth-1 parents."""
    levels = _levels(codes, counts)
    rows: list[np.ndarray] = []
    for k in range(8):
        nodes, weighted = _trained(levels, k)
        key, n0, n1, _, _ = nodes[2]
        parent = _parent(key, k)
        distinct, place = np.unique(parent, return_inverse=True)
        byte = (distinct >> np.uint64(k)).astype(np.int64)
        node = (1 << k) | (distinct & np.uint64((1 << k) - 1)).astype(np.int64)
        sums = [np.bincount(place, weights=w, minlength=len(distinct)) for w in (n0, n1, weighted)]
        rows.append(np.column_stack([byte, node, *sums]))
    a = np.concatenate(rows)
    return pa.table({"byte": a[:, 0].astype(np.int32), "node": a[:, 1].astype(np.int32), "zeros": a[:, 2].astype(np.int64), "ones": a[:, 3].astype(np.int64), "below": a[:, 4]})


def _top(rows) -> tuple[np.ndarray, ...]:
    """Dense tables for depth 1 (byte, node) and depth 0 (node): estimates of a one and log weights."""
    n0, n1, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for r in rows:
        n0[r["byte"], r["node"]], n1[r["byte"], r["node"]], below[r["byte"], r["node"]] = r["zeros"], r["ones"], r["below"]
    own = kt_log(n0, n1)
    weighted = np.logaddexp(own, below) - np.log(2.0)
    m0, m1 = n0.sum(0), n1.sum(0)
    return (n1 + 0.5) / (n0 + n1 + 1), own - below, (m1 + 0.5) / (m0 + m1 + 1), kt_log(m0, m1) - weighted.sum(0)


def _weight(log_ratio: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_ratio, -700, 700)))


def code_lengths(codes: np.ndarray, counts: np.ndarray, top) -> np.ndarray:
    """Bits of the last byte of each n-gram, given the bytes before it."""
    one1, ratio1, one0, ratio0 = top
    levels = _levels(codes, counts)
    bits = np.zeros(len(codes))
    byte = (codes >> np.uint64(8 * DEPTH)).astype(np.int64)
    last = (codes & np.uint64(255)).astype(np.int64)
    for k in range(8):
        nodes, _ = _trained(levels, k)
        bit = (last >> (7 - k)) & 1
        node = (1 << k) | (last >> (8 - k))
        key, n0, n1, _, of_code = nodes[DEPTH]
        p = ((n1 + 0.5) / (n0 + n1 + 1.0))[of_code]
        at = key[of_code]
        for d in range(DEPTH - 1, 1, -1):
            at = _parent(at, k)
            key, n0, n1, ratio, _ = nodes[d]
            i = np.searchsorted(key, at)
            w = _weight(ratio[i])
            p = w * ((n1[i] + 0.5) / (n0[i] + n1[i] + 1.0)) + (1 - w) * p
        for own, ratio in ((one1[byte, node], ratio1[byte, node]), (one0[node], ratio0[node])):
            w = _weight(ratio)
            p = w * own + (1 - w) * p
        bits -= np.log2(np.where(bit == 1, p, 1 - p))
    return bits


SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
    "score double, n_bytes long, bits_per_byte double"
)


def score(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """Scores all rows of ``docs`` with a model of those whose fold is not ``held``."""
    spark = docs.sparkSession
    ship(spark)
    total = segments.text_bytes(docs)
    buckets = segments.bucket_count(total)
    rows = segments.segmented(docs, total, (fold_of("doc_id", folds) == held).alias("held"))

    def ask(table: pa.Table) -> pa.Table:
        seg = table.column("seg")[0].as_py()
        grams, counts, _, keys, tally = _distinct(segments.unpacked(table))
        return pa.concat_tables(
            [
                segments.asked_rows(seg, grams, counts, gram_bucket(grams, buckets)),
                segments.asked_rows(seg, keys, tally, word_bucket(keys, buckets)),
            ]
        )

    asked = stored(rows.groupBy("seg").applyInArrow(ask, segments.ASKED), "asked")
    grams, words = asked.filter(F.col("bucket") < buckets), asked.filter(F.col("bucket") >= buckets)

    def shallow(table: pa.Table) -> pa.Table:
        return _shallow(*segments.all_asked(table))

    top = grams.groupBy("bucket").applyInArrow(shallow, SHALLOW)
    top = top.groupBy("byte", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    tables = _top(top.collect())  # at most 256 x 255 rows

    def vocabulary(table: pa.Table) -> pa.Table:
        _, totals = segments.all_asked(table)
        return pa.table({"n": [int(totals.sum())], "v": [int((totals > 0).sum())]})

    sizes = words.groupBy("bucket").applyInArrow(vocabulary, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sizes["n"] or 0, sizes["v"] or 0

    answers = segments.answer(grams, lambda k, c: code_lengths(k, c, tables)).union(
        segments.answer(words, lambda k, c: c.astype(np.float64))
    )

    def apply(table: pa.Table, got: pa.Table) -> pa.Table:
        table = segments.unpacked(table)
        grams, _, names, keys, _ = _distinct(table)
        bucket = np.array(got.column("bucket").to_pylist(), np.int64)
        bits = segments.answers_of(got.filter(pa.array(bucket < buckets)), grams, gram_bucket(grams, buckets), np.float64)
        known = segments.answers_of(got.filter(pa.array(bucket >= buckets)), keys, word_bucket(keys, buckets), np.float64)
        place = {w: i for i, w in enumerate(names)}
        place.setdefault(b"", -1)
        known = np.append(known, 0.0)
        logs = np.log10((known + 1) / (n + v + 1))
        rows = table.num_rows
        base, tokens, hits, length = np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        cost = np.zeros(rows)

        def bodies():
            for i, text in enumerate(table.column("text")):
                split = words_of(text.as_py())
                at = np.fromiter(map(place.__getitem__, split), np.int64, len(split))
                at = np.append(at, place[b""])
                base[i], tokens[i], hits[i] = logs[at].sum(), len(at), (known[at] > 0).sum()
                body = body_of(split)
                length[i] = len(body)
                yield body

        shift = np.uint64(16)
        offset = 0
        for codes, owner in chunks(bodies()):
            offset = int(owner[0])
            both = (codes << shift) | (owner - np.uint64(offset))
            both.sort()
            code = both >> shift
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            each = np.repeat(bits[np.searchsorted(grams, code[first])], np.diff(np.append(first, len(code))))
            of = (both & np.uint64(0xFFFF)).astype(np.int64)
            sums = np.bincount(of, weights=each)
            cost[offset : offset + len(sums)] += sums
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": table.column("held"),
                "n_tokens": tokens,
                "n_known": hits,
                "train_tokens": np.full(rows, n, np.int64),
                "base_score": base,
                "score": -cost * np.log10(2.0),
                "n_bytes": length,
                "bits_per_byte": cost / np.maximum(length, 1),
            }
        )

    return rows.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(apply, SCORED)
