"""Exact Jaccard join of documents' word shingles, with set-relation skipping, and the groups its links make.

1. Shingles are hashed, and how many documents hold each is found bucket-wise (``segments``). A document with fewer than 85 %
   shared shingles cannot link and is done. Equal sets count as one set from here on.
2. Tokens are ordered rarest first. Two linked sets share a token of their prefixes; lists of sets per prefix token connect
   sets into cells, outside which no link can lie. Small cells are joined whole; a large one is cut into size classes (a
   link spans at most two neighbouring ones) and blocks, and each pair of blocks is joined by itself.
3. Inside a block, lists are ordered by token position, so a list is left at the first position that can no longer reach the
   threshold. Overlaps of a set are derived from those of the set before it, whose tokens are mostly the same: only the lists
   of tokens in which both differ are read.
4. A block gives a spanning forest of its links; the forests' connected components are the groups. No pairs of a group are
   written out, and every link between different sets is tested.

Defined cases: null and empty texts (and texts of white space) have no shingles and no links; a text of fewer words than a shingle is
one token; equal rows link; a null id never is the smallest while the group has another; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm import segments
from skyfold.llm.common import give_back, ship, whole_text
from skyfold.llm.components import components
from skyfold.session import stored

#: A block of a large cell holds about so many tokens, and at most so many sets.
BLOCK_TOKENS = 1 << 18
BLOCK_SETS = 512


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; word hashes are kept while a segment lasts."""

    def __init__(self, words: int):
        self.words, self.known = words, {}
        rng = np.random.default_rng(7)
        self.factors = rng.integers(1, 1 << 63, words, dtype=np.int64).astype(np.uint64) | np.uint64(1)

    def _word(self, w: bytes) -> int:
        h = self.known.get(w)
        if h is None:
            h = self.known[w] = xxhash.xxh64_intdigest(w)
        return h

    def of(self, text: bytes) -> np.ndarray:
        split = text.lower().split()
        n = len(split)
        if not n:
            return np.empty(0, np.uint64)
        if n < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(split), seed=n)], np.uint64)
        h = np.fromiter(map(self._word, split), np.uint64, n)
        last = n - self.words + 1
        out = np.zeros(last, np.uint64)
        for i, f in enumerate(self.factors):
            out += h[i : i + last] * f
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return segments.runs(out)[0]


def _key(tokens: np.ndarray) -> np.ndarray:
    """48 bits are enough to count by: a collision only makes a shingle look more frequent."""
    return tokens >> np.uint64(16)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)


SETS = "doc_id long, tie long, n long, sig string, tokens binary"


def shared_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row its number of shingles; of those that can link also the set's digest and its shared tokens, rarest first."""
    ship(docs.sparkSession)
    total = segments.text_bytes(docs)
    buckets = segments.bucket_count(total)
    rows = segments.segmented(docs, total, F.xxhash64(whole_text()).alias("tie"))

    def ask(table: pa.Table) -> pa.Table:
        shingler = Shingler(words)
        found, held, size = [], [], 0
        for own in (_key(shingler.of(text.as_py())) for text in segments.unpacked(table).column("text")):
            held.append(own)
            size += len(own)
            if size > 1 << 21:
                found.append(segments.runs(np.concatenate(held)))
                held, size = [], 0
        found.append(segments.runs(np.concatenate([*held, np.empty(0, np.uint64)])))
        del shingler, held
        keys, counts = segments.counted(found)
        out = segments.asked_rows(table.column("seg")[0].as_py(), keys, counts, _bucket(keys, buckets))
        del keys, counts
        give_back()
        return out

    asked = rows.groupBy("seg").applyInArrow(ask, segments.ASKED)
    answers = segments.answer(asked, lambda keys, counts: np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))

    def pick(table: pa.Table, got: pa.Table) -> pa.Table:
        table = segments.unpacked(table)
        shingler = Shingler(words)
        sets = [shingler.of(text.as_py()) for text in table.column("text")]
        table = table.drop_columns(["text"])
        del shingler
        keys = segments.runs(np.concatenate([np.empty(0, np.uint64), *map(_key, sets)]))[0]
        seen = segments.answers_of(got, keys, _bucket(keys, buckets), np.uint32)
        give_back()
        sigs, tokens, told = [], [], set()
        for s in sets:
            often = seen[np.searchsorted(keys, _key(s))]
            shared = often >= 2
            if len(s) and 100 * int(shared.sum()) >= percent * len(s):
                sigs.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                # Equal sets of a segment need their tokens told once.
                tokens.append(None if sigs[-1] in told else s[shared][np.argsort(often[shared], kind="stable")].tobytes())
                told.add(sigs[-1])
            else:
                sigs.append(None)
                tokens.append(None)
        sizes = [len(s) for s in sets]
        del sets, keys, seen
        give_back()
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "tie": table.column("tie"),
                "n": pa.array(sizes, pa.int64()),
                "sig": pa.array(sigs, pa.string()),
                "tokens": pa.array(tokens, pa.binary()),
            }
        )

    return rows.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(pick, SETS)


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix_tokens(n: int, tokens: np.ndarray, percent: int) -> np.ndarray:
    """The shared tokens of a set's prefix. Unshared ones come first in the order and match nothing."""
    return tokens[: max(0, n - least_overlap(n, percent) + 1 - (n - len(tokens)))]


class Index:
    """Lists of (position, set) per token, by position."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        lengths = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), lengths)
        start = np.cumsum(lengths) - lengths
        position = np.arange(len(tokens)) - np.repeat(start - (sizes - lengths), lengths)
        order = np.lexsort((position, tokens))
        self.owner, self.position = owner[order], position[order]
        tokens = tokens[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.tokens, self.first = tokens[first], np.append(first, len(tokens))

    def lists(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        at = at[self.tokens[at] == tokens]
        return list(zip(self.first[at].tolist(), self.first[at + 1].tolist(), strict=True))

    def reaches(self, n: int, prefix: np.ndarray, percent: int) -> bool:
        """Whether any list of the prefix holds a set, at a position and of a size that can still reach the threshold."""
        need = least_overlap(n, percent)
        most = 100 * n // percent
        for lo, hi in self.lists(prefix):
            # Positions ascend: beyond the last useful one the rest of the list is skipped.
            hi = lo + int(np.searchsorted(self.position[lo:hi], most - need, "right"))
            sizes = self.sizes[self.owner[lo:hi]]
            if ((sizes >= need) & (sizes <= most) & (sizes - self.position[lo:hi] >= need)).any():
                return True
        return False

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each indexed set holds."""
        parts = [self.owner[lo:hi] for lo, hi in self.lists(tokens)]
        return np.bincount(np.concatenate(parts), minlength=len(self.sizes)) if parts else np.zeros(len(self.sizes), np.int64)


def block_links(sets: list[np.ndarray], sizes: np.ndarray, queries: np.ndarray, indexed: np.ndarray, percent: int):
    """Spanning forest of the links between queried and indexed sets, as pairs of set numbers."""
    index = Index([sets[i] for i in indexed], sizes[indexed])
    root = list(range(len(sets)))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    by_kind = {int(q): np.sort(sets[q]) for q in queries}
    order = sorted(by_kind, key=lambda q: (by_kind[q][:3].tolist(), int(sizes[q])))
    out: list[tuple[int, int]] = []
    last, counts = None, None
    for q in order:
        n = int(sizes[q])
        if not index.reaches(n, prefix_tokens(n, sets[q], percent), percent):
            continue
        mine = by_kind[q]
        differ = np.setxor1d(mine, last, assume_unique=True) if last is not None else None
        if differ is not None and len(differ) < len(mine):
            fresh = np.isin(differ, mine, assume_unique=True)
            counts = counts + index.overlaps(differ[fresh]) - index.overlaps(differ[~fresh])
        else:
            counts = index.overlaps(mine)
        last = mine
        linked = indexed[100 * counts >= percent * (n + index.sizes - counts)]
        for t in linked.tolist():
            a, b = find(q), find(t)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((q, t))
    return out


def _tasks(sets: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Every set with the tasks it takes part in, and its side there."""
    ratio = float(np.log(100 / percent))
    band = F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int")
    # Tasks are worked out on narrow rows; tokens join them last.
    placed = sets.select("sig", band.alias("band"), (F.octet_length("tokens") / 8).alias("size"))
    placed = placed.join(cells, placed.sig == cells.node).drop("node")
    weight = placed.groupBy("component", "band").agg(F.count("*").alias("sets"), F.sum("size").alias("held"))
    cell = weight.groupBy("component").agg(F.sum("sets").alias("all_sets"), F.sum("held").alias("all_held"))
    large = (F.col("all_sets") > BLOCK_SETS) | (F.col("all_held") > BLOCK_TOKENS)
    total = cell.agg(F.sum("all_held").alias("n")).first()["n"] or 0
    shared_tasks = max(8, int(total // BLOCK_TOKENS))

    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("held") / BLOCK_TOKENS)).cast("int")
    weight = weight.withColumn("blocks", blocks)
    near = lambda step, name: weight.select("component", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
    plan = (
        weight.select("component", "band", "blocks")
        .join(near(1, "above"), ["component", "band"], "left")
        .join(near(-1, "below"), ["component", "band"], "left")
        .join(cell.select("component", large.alias("large")), "component")
    )
    placed = placed.join(plan, ["component", "band"])
    block = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", block)

    def task(band_a, a, band_b, b):
        return F.concat_ws("/", "component", band_a, a, band_b, b)

    band, none = F.col("band"), F.expr("array()").cast("array<struct<task:string,side:int>>")
    entry = lambda t, side: F.struct(t.alias("task"), side.cast("int").alias("side"))
    own = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: entry(task(band, F.least("block", j), band, F.greatest("block", j)), F.when(F.col("block") == j, -1).when(F.col("block") < j, 0).otherwise(1)),
    )
    up = F.when(F.col("above").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda j: entry(task(band, "block", band + 1, j), F.lit(0)))).otherwise(none)
    down = F.when(F.col("below").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda j: entry(task(band - 1, j, band, "block"), F.lit(1)))).otherwise(none)
    whole = F.array(entry(F.concat(F.lit("#"), F.pmod(F.xxhash64("component"), F.lit(shared_tasks)).cast("string")), F.lit(-1)))
    took = F.explode(F.when(F.col("large"), F.concat(own, up, down)).otherwise(whole)).alias("t")
    tasks = placed.select("sig", took).select("sig", "t.task", "t.side")
    return tasks.join(sets, "sig").select("sig", "n", "tokens", "task", "side")


def set_links(sets: DataFrame, percent: int) -> DataFrame:
    """A forest of links (``a``, ``b``) between distinct sets (``sig``, ``n``, ``tokens``) that spans their groups."""

    def prefixes(batches):
        for batch in batches:
            token, sig = [], []
            for s, n, raw in zip(*(batch.column(c).to_pylist() for c in ("sig", "n", "tokens")), strict=True):
                some = prefix_tokens(n, np.frombuffer(raw, np.uint64), percent)
                token.append(some.astype(np.int64))
                sig += [s] * len(some)
            yield pa.RecordBatch.from_pydict({"token": np.concatenate([*token, np.empty(0, np.int64)]), "sig": pa.array(sig, pa.string())})

    postings = stored(sets.mapInArrow(prefixes, "token long, sig string"), "postings")
    heads = postings.groupBy("token").agg(F.min("sig").alias("head"), F.count("*").alias("k")).filter("k > 1")
    stars = postings.join(heads, "token").select(F.col("sig").alias("a"), F.col("head").alias("b"))
    cells = components(stars)

    def join(table: pa.Table) -> pa.Table:
        side = np.array(table.column("side").to_pylist())
        sigs = table.column("sig").to_pylist()
        found = [np.frombuffer(r.as_py(), np.uint64) for r in table.column("tokens")]
        sizes = np.array(table.column("n").to_pylist())
        numbers = np.arange(len(sigs))
        apart = bool((side >= 0).any())
        left, right = (numbers[side == 0], numbers[side == 1]) if apart else (numbers, numbers)
        pairs = block_links(found, sizes, left, right, percent) if len(left) and len(right) else []
        return pa.table({"a": pa.array([sigs[a] for a, _ in pairs], pa.string()), "b": pa.array([sigs[b] for _, b in pairs], pa.string())})

    return _tasks(sets, cells, percent).groupBy("task").applyInArrow(join, "a string, b string")


def grouped(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """Per row ``doc_id``, ``tie`` (hash of the text), ``n`` and the ``grp`` it belongs to (null if it links with nothing)."""
    rows = stored(shared_sets(docs, words, percent), "sets")
    held = rows.filter("sig IS NOT NULL")
    sets = stored(held.filter("tokens IS NOT NULL").groupBy("sig").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "distinct_sets")
    labels = components(set_links(sets, percent))
    named = held.drop("tokens").join(labels, F.col("sig") == F.col("node"), "left")
    named = named.select("doc_id", "tie", "n", F.coalesce("component", "sig").alias("grp"))
    return named.union(rows.filter("sig IS NULL").select("doc_id", "tie", "n", F.lit(None).cast("string").alias("grp")))


def jaccard_groups(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """Per row its number of shingles and the smallest id it is linked with, directly or not."""
    rows = stored(grouped(docs, words, percent), "grouped")
    linked = rows.filter("grp IS NOT NULL")
    least = linked.groupBy("grp").agg(F.min("doc_id").alias("least"))
    named = linked.join(least, "grp").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    return named.union(rows.filter("grp IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_per_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest id (then text hash) stays."""
    rows = stored(grouped(docs, words, percent), "grouped").filter("grp IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("tie").alias("z")))
    kept = rows.groupBy("grp").agg(first.alias("k")).select(F.col("k.y").alias("_id"), F.col("k.z").alias("_tie"), F.lit(True).alias("_kept"))
    gone = rows.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct()
    same = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_tie"] == b["_tie"])
    fate = gone.join(kept, same(gone, kept), "left").select(gone["_id"], gone["_tie"], F.coalesce("_kept", F.lit(False)).alias("_kept"))
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_dtie"))
    joined = keyed.join(fate, keyed["_did"].eqNullSafe(fate["_id"]) & (keyed["_dtie"] == fate["_tie"]), "left")
    alone = joined.filter("_kept IS NULL").select("_row")
    # Rows that repeat id and text are one document.
    first_rows = joined.filter("_kept").groupBy("_did", "_dtie").agg(F.first("_row").alias("_row")).select("_row")
    return alone.union(first_rows).select("_row.*")
