"""Language identification with a linear-chain conditional random field over words.

Every word of a text gets a label. Features of a word are its affixes and byte n-grams (hashed) and whether it stands in the lexicon of a language;
learned transitions tie neighbours, so that a text which changes its language is labelled piece by piece. Marginals come from
forward-backward; a document's language is the one with the largest mean marginal over its words with letters, that mean is its score.

Training takes a bounded sample: about ``SAMPLE_DOCS`` labelled texts per language, ``WINDOWS`` stretches of ``WINDOW_WORDS`` words of
each, at random places. Stretches of several languages are joined into code-switched chains, from which the transitions are learned. The
model is a table of fixed size and goes to the executors with the code; documents are then labelled whole, where they are read.

To reject texts in no learned language (``in_known_language``) the field's labels are checked against what the sample shows of a language: a word is as
familiar as the share of its letters' three- and four-byte n-grams (with end marks) that the sample has in the language of its label, and a text as its words are in the
mean. The least familiarity of a text is learned from the sample too, from stretches of its own second half and from strangers: stretches that are labelled by the other
languages alone, and words of random letters.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing can be learned from; a null
language teaches nothing; every row gives a row; texts above ``CHAIN_WORDS`` words are labelled as several chains; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import WORD, fold_of, lean, ship, whole_text
from skyfold.session import stored

FOLDS, HELD = 4, 2
SAMPLE_DOCS, WINDOWS, WINDOW_WORDS = 400, 4, 24
#: Words per language in the lexicon, and the share of a word's sightings that must be the language's.
LEXICON, LEXICON_SHARE = 4000, 0.9
FEATURE_BITS = 17
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.15, 1e-5
CHAIN_WORDS = 1_000_000
#: Distinct words whose n-grams are held at once.
SCORED_WORDS = 1 << 14
_BLOCK_BYTES = 4 << 20
#: Table of the n-grams a language is known by, and familiar words added to each text, so that few words alone reject none.
KNOWN_BITS, KNOWN_ORDERS, GIVEN_WORDS = 20, (3, 4), 2
#: An n-gram belongs to a language above this share of the n-grams in the language's stretches.
KNOWN_SHARE = 5e-5
#: Shares of own and of strange stretches of the sample that the least familiarity lies between.
OWN_LOW, STRANGE_HIGH = 0.1, 0.9
_JUDGED_BLOCK_BYTES = 2 << 20
_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # feature, label
    moves: np.ndarray  # label before, label
    start: np.ndarray
    lexicon: dict[str, int]  # word, number of its language
    known: np.ndarray | None = None  # n-gram, label: whether the sample has it in the language
    least: float = 0.0  # least familiarity of a text in the learned languages


def _ngrams(words: list[str], bits: int = FEATURE_BITS, orders: Sequence[int] = (2, 3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of two to four bytes of each word between end marks (so affixes are n-grams with a mark), and whose they are."""
    raw = [b"\x01" + w.encode() + b"\x02" for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    features, owners = [], []
    code = flat.copy()
    for n in range(2, 5):
        code = (code[:-1] << np.uint64(8)) | flat[n - 1 :]
        if n not in orders:
            continue
        whole = owner[: len(code)] == owner[n - 1 :]
        h = (code[whole] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        features.append((h >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(owner[: len(code)][whole])
    f, o = np.concatenate(features), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return f[order], o[order]


def _lexicon_feature(label: int) -> int:
    return (1 << FEATURE_BITS) + label


def _features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    f, o = _ngrams(words)
    listed = [(i, _lexicon_feature(lexicon[w])) for i, w in enumerate(words) if w in lexicon]
    if listed:
        f = np.concatenate([f, [x for _, x in listed]])
        o = np.concatenate([o, [i for i, _ in listed]])
    return f, o


def _scores(words: list[str], model: Model) -> np.ndarray:
    """Per word and label the sum of its features' weights; words without letters say nothing."""
    out = np.zeros((len(words), len(model.labels)))
    for lo in range(0, len(words), SCORED_WORDS):
        some = words[lo : lo + SCORED_WORDS]
        f, o = _features(some, model.lexicon)
        for k in range(out.shape[1]):
            out[lo : lo + len(some), k] = np.bincount(o, weights=model.weights[f, k], minlength=len(some))
    return out


def forward_backward(
    emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: np.ndarray | None = None
) -> np.ndarray:
    """Marginals per word for many chains at once. ``emit`` holds the words' scores, chain after chain.

    ``pairs`` gets the expected transitions added.

    Chains are taken longest first, so at each step those that still run are the first ones.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    potential = np.exp(emit - emit.max(1, keepdims=True))
    step, first = np.exp(moves), np.exp(start)
    forward = np.empty_like(potential)
    marginal = np.empty_like(potential)
    running = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    a = np.empty((0, emit.shape[1]))
    for t, n in enumerate(running):
        at = starts[:n] + t
        a = potential[at] * (first if t == 0 else a[:n] @ step)
        a /= a.sum(1, keepdims=True)
        forward[at] = a
    back = step.T
    b = np.empty((0, emit.shape[1]))
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at = starts[:n] + t
        fresh = np.ones((n, emit.shape[1]))
        if len(b):
            ahead = b * potential[starts[: len(b)] + t + 1]
            if pairs is not None:
                joint = forward[at[: len(b)], :, None] * step[None] * ahead[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            fresh[: len(b)] = ahead @ back
            fresh[: len(b)] /= fresh[: len(b)].sum(1, keepdims=True)
        b = fresh
        m = forward[at] * b
        marginal[at] = m / m.sum(1, keepdims=True)
    return marginal


def _chains(pieces: list[tuple[int, list[str]]], rng) -> tuple[list[list[str]], list[np.ndarray]]:
    """Code-switched chains of one to four stretches."""
    order = rng.permutation(len(pieces))
    words, labels, i = [], [], 0
    while i < len(order):
        some = [pieces[j] for j in order[i : i + int(rng.integers(1, 5))]]
        i += len(some)
        words.append([w for _, ws in some for w in ws])
        labels.append(np.concatenate([np.full(len(ws), k) for k, ws in some]))
    return words, labels


def fit(pieces: list[tuple[str, list[str]]], seed: int = 11) -> Model:
    """Fits the field to labelled stretches of words by stochastic gradient steps on the likelihood of the labels."""
    rng = np.random.default_rng(seed)
    names = sorted({k for k, _ in pieces})
    number = {k: i for i, k in enumerate(names)}
    n = len(names)
    data = [(number[k], ws) for k, ws in sorted(pieces) if ws]
    seen: dict[str, Counter] = {}
    for k, ws in data:
        for w in ws:
            seen.setdefault(w, Counter())[k] += 1
    lexicon = {}
    for k in range(n):
        own = [(c[k], w) for w, c in seen.items() if _LETTER.search(w) and c[k] >= 2 and c[k] >= LEXICON_SHARE * sum(c.values())]
        lexicon |= {w: k for _, w in sorted(own, reverse=True)[:LEXICON]}
    model = Model(names, np.zeros(((1 << FEATURE_BITS) + n, n)), np.zeros((n, n)), np.zeros(n), lexicon)
    pace_w, pace_m, pace_s = np.full(model.weights.shape, 1e-6), np.full((n, n), 1e-6), np.full(n, 1e-6)
    known = sorted(seen)
    place = {w: i for i, w in enumerate(known)}
    f, o = _features(known, lexicon)
    order = np.argsort(o, kind="stable")
    f, bounds = f[order], np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(known)))])
    one = np.eye(n)
    for _ in range(EPOCHS):
        words, labels = _chains(data, rng)
        for lo in range(0, len(words), BATCH):
            some, truth = words[lo : lo + BATCH], np.concatenate(labels[lo : lo + BATCH])
            ids = np.array([place[w] for ws in some for w in ws])
            lengths = np.array([len(ws) for ws in some])
            starts = np.cumsum(lengths) - lengths
            spans = bounds[ids + 1] - bounds[ids]
            who = np.repeat(np.arange(len(ids)), spans)
            feats = f[np.repeat(bounds[ids] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())]
            emit = np.column_stack([np.bincount(who, weights=model.weights[feats, k], minlength=len(ids)) for k in range(n)])
            pair = np.zeros((n, n))
            mean = forward_backward(emit, starts, lengths, model.moves, model.start, pair)
            gap = one[truth] - mean
            step = np.zeros_like(model.weights)
            for k in range(n):
                step[:, k] = np.bincount(feats, weights=gap[who, k], minlength=len(step))
            step -= DECAY * model.weights
            inner = np.ones(len(ids), bool)
            inner[starts] = False
            after = np.flatnonzero(inner)
            told = np.zeros((n, n))
            np.add.at(told, (truth[after - 1], truth[after]), 1.0)
            move = told - pair
            begin = (one[truth[starts]] - mean[starts]).sum(0)
            for value, pace, g in ((model.weights, pace_w, step), (model.moves, pace_m, move), (model.start, pace_s, begin)):
                pace += g * g
                value += RATE * g / np.sqrt(pace)
    return model


def _letters_of(words: list[str]) -> list[str]:
    """The words without the digits and marks around and inside them."""
    return [w if w.isalpha() else _NO_LETTER.sub("", w) for w in words]


def _known(pieces: list[tuple[int, list[str]]], n: int) -> np.ndarray:
    """Which n-grams each label's stretches hold often enough: texts of a language also quote others."""
    known = np.zeros((1 << KNOWN_BITS, n), bool)
    for k in range(n):
        seen = Counter(w for j, ws in pieces if j == k for w in _letters_of(ws))
        if seen:
            f, o = _ngrams(list(seen), KNOWN_BITS, KNOWN_ORDERS)
            times = np.bincount(f, weights=np.array(list(seen.values()))[o], minlength=len(known))
            known[:, k] = times > KNOWN_SHARE * times.sum()
    return known


def familiarity(words: list[str], known: np.ndarray) -> np.ndarray:
    """Per word and label the share of the word's n-grams that the label's language is known by."""
    out = np.zeros((len(words), known.shape[1]))
    for lo in range(0, len(words), SCORED_WORDS):
        some = words[lo : lo + SCORED_WORDS]
        f, o = _ngrams(_letters_of(some), KNOWN_BITS, KNOWN_ORDERS)
        all_ = np.maximum(np.bincount(o, minlength=len(some)), 1)
        for k in range(known.shape[1]):
            out[lo : lo + len(some), k] = np.bincount(o, weights=known[f, k], minlength=len(some)) / all_
    return out


def learn_strangers(model: Model, pieces: list[tuple[str, list[str]]], seed: int = 12) -> Model:
    """Adds to a model what its languages are known by, and how familiar a text in them is at least."""
    rng = np.random.default_rng(seed)
    number = {k: i for i, k in enumerate(model.labels)}
    data = [(number[k], ws) for k, ws in sorted(pieces) if ws]
    half = _known(data[::2], len(model.labels))
    letters = sorted({c for _, ws in data for w in ws for c in w if c.isalpha()})
    own, strange = [], []
    for k, ws in data[1::2]:
        share = familiarity(ws, half)
        own.append(share[:, k].mean())
        if share.shape[1] > 1:
            strange.append(np.delete(share, k, axis=1).max(axis=1).mean())
        junk = ["".join(letters[i] for i in rng.integers(0, len(letters), len(w))) for w in ws]
        strange.append(familiarity(junk, half).max(axis=1).mean())
    if own:
        low, high = float(np.quantile(own, OWN_LOW)), float(np.quantile(strange, STRANGE_HIGH))
        # Languages alike in their n-grams cannot be told from strangers: then texts stay rather than go.
        model.least = min((low + high) / 2, low)
    model.known = _known(data, len(model.labels))
    return model


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, strangers: bool = False) -> Model | None:
    """A model of the labelled documents outside the held-out fold; None if there are none. ``strangers``: it can tell other languages from its own."""
    usable = docs.filter((fold_of("doc_id", FOLDS) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, sample_docs / n))])
    unit = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 11) / F.lit(float(1 << 53))
    drawn = usable.filter(unit("doc_id", "text") < rate[F.col("lang")])
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"))
    spare = F.greatest(F.size("words") - WINDOW_WORDS, F.lit(0))
    windows = [F.slice("words", (F.floor(unit("doc_id", "text", F.lit(i)) * spare) + 1).cast("int"), WINDOW_WORDS) for i in range(WINDOWS)]
    rows = drawn.select("lang", "doc_id", "text", words.alias("words")).select("lang", F.array(*windows).alias("w")).collect()
    pieces = [(r["lang"], [w for w in ws if _LETTER.search(w)]) for r in rows for ws in r["w"]]
    if not any(ws for _, ws in pieces):
        return None
    model = fit(pieces)
    return learn_strangers(model, pieces) if strangers else model


def label(docs: DataFrame, model: Model | None, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``tie`` (hash of the text), ``lang_pred``, ``score`` and ``certainty`` (see ``label_texts``)."""
    ship(docs.sparkSession)

    def blocks(batches):
        block, size = [], 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = row[2].as_py()
                block.append((row[0], row[1], text))
                size += len(text)
                if size >= block_bytes:
                    yield block
                    block, size = [], 0
        if block:
            yield block

    def read(batches):
        for block in blocks(batches):
            lang, score, certainty = label_texts([t for _, _, t in block], model)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([b[0] for b in block], pa.int64()),
                    "tie": pa.array([b[1] for b in block], pa.int64()),
                    "lang_pred": pa.array(lang, pa.string()),
                    "score": pa.array(score, pa.float64()),
                    "certainty": pa.array(certainty, pa.float64()),
                }
            )

    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(lean(read), "doc_id long, tie long, lang_pred string, score double, certainty double")


def label_texts(texts: list[str], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and certainty of each text; without a model letters are certain.

    Certainty is the mean of the words' largest marginals; of a model that knows strangers, the text's familiarity: the mean share of known n-grams of its
    words in the languages of their labels, with ``GIVEN_WORDS`` familiar words added.
    """
    lang, score, certainty = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if model is None:
        return lang, score, np.array([float(_LETTER.search(t) is not None) for t in texts])
    number: dict[str, int] = {}
    ids = []
    for t in texts:
        split = t.lower().split()
        ids.append(np.fromiter([number.setdefault(w, len(number)) for w in split], np.int64, len(split)))
    words = list(number)
    lettered = np.fromiter((_LETTER.search(w) is not None for w in words), bool, len(words))
    emit = np.zeros((len(words), len(model.labels)))
    emit[lettered] = _scores([w for w, x in zip(words, lettered, strict=True) if x], model)
    flat = np.concatenate([*ids, np.empty(0, np.int64)])
    sizes = np.array([len(i) for i in ids], np.int64)
    ends = np.cumsum(sizes)
    starts, lengths = [], []
    for e, n in zip(ends.tolist(), sizes.tolist(), strict=True):
        for lo in range(e - n, e, CHAIN_WORDS):
            starts.append(lo)
            lengths.append(min(CHAIN_WORDS, e - lo))
    if not starts:
        return lang, score, certainty
    mean = forward_backward(emit[flat], np.array(starts), np.array(lengths), model.moves, model.start)
    mean *= lettered[flat][:, None]
    full = np.flatnonzero(sizes)
    sums = np.add.reduceat(mean, (ends - sizes)[full], axis=0)
    best, given = mean.max(axis=1), 0
    if model.known is not None:
        given = GIVEN_WORDS
        shares = np.zeros_like(emit)
        shares[lettered] = familiarity([w for w, x in zip(words, lettered, strict=True) if x], model.known)
        best = shares[flat, mean.argmax(axis=1)]
    sure = np.add.reduceat(best, (ends - sizes)[full])
    counts = np.add.reduceat(lettered[flat].astype(np.int64), (ends - sizes)[full])
    for i, s, m, c in zip(full.tolist(), sums, sure.tolist(), counts.tolist(), strict=True):
        if c:
            k = int(np.argmax(s))
            lang[i], score[i], certainty[i] = model.labels[k], min(1.0, float(s[k]) / c), min(1.0, (m + given) / (c + given))
    return lang, score, certainty


def identify(docs: DataFrame) -> DataFrame:
    """Language and score of every row, by a model of the rows outside the held-out fold."""
    return label(docs, train(docs)).select("doc_id", (fold_of("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has letters and words as familiar, in the languages of their labels, as texts of the learned languages are.

    A text may be in several languages; if nothing can be learned, all texts with letters stay.
    """
    model = train(docs, strangers=True)
    found = label(docs, model, _JUDGED_BLOCK_BYTES)
    # The rejected are the few: they are named by id and text, so every other row stays as it is.
    bad = found.filter((F.col("certainty") == 0) | (F.col("certainty") < (model.least if model else 0.0)))
    bad = stored(bad.select(F.col("doc_id").alias("_bad_id"), F.col("tie").alias("_bad_tie")).distinct(), "rejected")
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text()).alias("_tie"))
    same = row["_id"].eqNullSafe(bad["_bad_id"]) & (row["_tie"] == bad["_bad_tie"])
    return row.join(bad, same, "left_anti").select("_row.*")
