"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer writes every word as a symbol: insult (with a weight), threat, target, negation, reported speech, end of clause or
other. Insults are words and word beginnings with weights learned from labels, beside a short fixed list. Three more transducers
read these symbols: negation turns harm in its scope into negated harm, reported speech turns harm up to the end of its clause into quoted
harm, and the target machine tells harm near a target from harm alone. They are composed into one machine, whose paths carry the weights;
a clause's evidence is the sum over its harm of path weight times lexical weight. Only clauses with harm are run.

A text's score comes from the evidence of its matched clauses (sum, sum per word, largest, different words) by a logistic curve. The
lexicon is learned from a sample of at most ``TRAIN_TOXIC`` and ``TRAIN_CLEAN`` labelled documents outside the held-out fold, the curve from the
sample's last fold, which the lexicon has not seen. Both go to the tasks with the code (at most ``LEXICON`` entries and seven numbers); documents
are then scored whole where they are read.

Defined cases: null or empty text has no clause and the score of no evidence; without labels, or with one label alone, fixed weights hold;
contradicting labels of an id count as toxic; null ids and labels teach nothing; every row gives a row; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import fold_of, packed, ship, whole_text
from skyfold.session import stored

FOLDS, HELD, CURVE_FOLD = 5, 0, 4
TRAIN_TOXIC, TRAIN_CLEAN = 4000, 16_000
#: Entries of the learned lexicon; a beginning has so many letters.
LEXICON, BEGIN_LEAST, BEGIN_MOST = 5000, 3, 8
#: Texts an entry must stand in, standard errors taken off its log odds, and the least that must remain.
LEAST_TEXTS, ERRORS, LEAST_ODDS = 4, 2.5, 1.0
#: A beginning goes if one longer entry stands in this share of its toxic texts.
EXPLAINED = 0.8
#: Words after a negation, and between a target and an insult or threat.
SCOPE, REACH = 3, 4
SEED_WEIGHT, LEVELS, LEVEL = 3.0, 60, 0.1
#: Words a worker keeps read; beyond that it starts anew.
KEPT_WORDS = 400_000

# The words of the grammar's classes in English, German, Spanish and French.
INSULTS = [
    "idiot", "idiots", "moron", "morons", "loser", "losers", "scum", "stupid", "pathetic", "worthless", "disgusting", "imbecile",
    "dummkopf", "abschaum", "widerlich", "trottel", "idiota", "imbécil", "estúpido", "estúpida", "asqueroso", "crétin", "ordure", "dégoûtant",
]
THREATS = ["kill", "hurt", "strangle", "stab", "shoot", "töten", "umbringen", "erschießen", "verprügeln", "matar", "golpear", "apuñalar", "tuer", "frapper", "poignarder"]
TARGETS = [
    "you", "your", "yours", "you're", "he", "she", "they", "him", "her", "them", "du", "dich", "dir", "dein", "deine", "euch", "tú", "ti", "usted",
    "ustedes", "ellos", "ellas", "toi", "vous", "votre", "eux", "tu", "te",
]
NEGATIONS = ["not", "never", "no", "isn't", "aren't", "wasn't", "don't", "doesn't", "nobody", "nicht", "kein", "keine", "nie", "nunca", "jamás", "ne", "pas", "jamais", "non"]
REPORTS = ["said", "says", "wrote", "writes", "called", "claimed", "quoted", "reported", "sagte", "schrieb", "nannte", "behauptete", "dijo", "escribió", "llamó", "dit", "écrit", "appelé"]
#: Weights of the paths a harmful word can end on.
PATHS = {"insult": 1.0, "aimed insult": 1.5, "threat": 0.3, "aimed threat": 2.0, "negated": 0.25, "reported": 0.4, "aim": 0.5}

OTHER, END, TARGET, NEGATION, REPORT, THREAT, INSULT = range(7)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")
_HARM = re.compile(rb"[\x05-\xff]")
_END = bytes([END])


@dataclass
class Transducer:
    """A machine that is total on its symbols: (state, symbol) to (state, what it writes, weight)."""

    start: object
    arcs: dict[tuple, tuple]


def machine(start, symbols: tuple, step: Callable) -> Transducer:
    """All states reachable from ``start`` by ``step(state, symbol)``."""
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            arcs[state, symbol] = step(state, symbol)
            if (after := arcs[state, symbol][0]) not in seen:
                seen.add(after)
                todo.append(after)
    return Transducer(start, arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that reads what ``first`` reads and writes what ``second`` writes of it; weights multiply."""

    def step(state, symbol):
        a, mid, w = first.arcs[state[0], symbol]
        b, out, v = second.arcs[state[1], mid]
        return (a, b), out, w * v

    return machine((first.start, second.start), tuple(dict.fromkeys(s for _, s in first.arcs)), step)


def negation() -> Transducer:
    """Writes harm within ``SCOPE`` words after a negation as negated harm."""

    def step(left, symbol):
        if symbol == NEGATION:
            return SCOPE, OTHER, 1.0
        if symbol == END:
            return 0, END, 1.0
        harm = symbol in (THREAT, INSULT)
        return max(0, left - 1), "negated" if harm and left else symbol, 1.0

    return machine(0, (OTHER, END, TARGET, NEGATION, REPORT, THREAT, INSULT), step)


def reporting() -> Transducer:
    """Writes harm after a verb of speech, up to the end of the clause, as reported."""

    def step(told, symbol):
        if symbol in (REPORT, END):
            return symbol == REPORT, END if symbol == END else OTHER, 1.0
        harm = symbol in (THREAT, INSULT, "negated")
        return told, "reported" if harm and told else symbol, 1.0

    return machine(False, (OTHER, END, TARGET, REPORT, THREAT, INSULT, "negated"), step)


def aiming() -> Transducer:
    """Writes the name of the path: harm alone, near a target before it, or followed by a target."""

    def step(state, symbol):
        target, harm = state
        after = (max(0, target - 1), max(0, harm - 1))
        if symbol == END:
            return (0, 0), None, 0.0
        if symbol == TARGET:
            name = "aim" if harm else None
            return (REACH, 0), name, PATHS.get(name, 0.0)
        if symbol in (INSULT, THREAT):
            name = ("aimed " if target else "") + ("insult" if symbol == INSULT else "threat")
            return (after[0], 0 if target else REACH), name, PATHS[name]
        if symbol in ("negated", "reported"):
            return after, symbol, PATHS[symbol]
        return after, None, 0.0

    return machine((0, 0), (OTHER, END, TARGET, THREAT, INSULT, "negated", "reported"), step)


def grammar() -> list[list[tuple[int, str | None, float]]]:
    """The composed machine as a table: row per state, entry per symbol."""
    whole = compose(compose(negation(), reporting()), aiming())
    number = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in whole.arcs))}
    rows = [[(0, None, 0.0)] * 7 for _ in number]
    for (state, symbol), (after, name, weight) in whole.arcs.items():
        rows[number[state]][symbol] = (number[after], name, weight)
    return rows


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, SEED_WEIGHT))
    begins: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-2.5, 1.6, 0.2, 0.4, 0.4, 0.0, 0.0)


class Symbols(dict):
    """The lexical transducer: token to symbol, insults above ``INSULT`` by the level of their weight."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.fixed = {w: s for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}

    def __missing__(self, token: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        word = token.lower().replace("’", "'")
        if not token[0].isalpha():
            symbol = END
        elif word in self.fixed:
            symbol = self.fixed[word]
        else:
            known = [self.model.words.get(word, 0.0)]
            known += [self.model.begins.get(word[:k], 0.0) for k in range(BEGIN_LEAST, min(BEGIN_MOST, len(word) - 1) + 1)]
            level = min(LEVELS, round(max(known) / LEVEL))
            symbol = INSULT + level if level > 0 else OTHER
        self[token] = symbol
        return symbol


@dataclass
class Clause:
    first: int  # token
    last: int
    evidence: float
    paths: list[str]


class Reader:
    """Runs the composed machine over texts."""

    def __init__(self, model: Model):
        self.symbols, self.table = Symbols(model), grammar()

    def clauses(self, tokens: list[str]) -> Iterator[Clause]:
        """The clauses with harm, in order."""
        codes = bytes(map(self.symbols.__getitem__, tokens))
        if not _HARM.search(codes):
            return
        at = 0
        for part in codes.split(_END):
            if _HARM.search(part):
                state, evidence, paths = 0, 0.0, []
                for code in part:
                    state, name, weight = self.table[state][min(code, INSULT)]
                    if name:
                        evidence += weight * ((code - INSULT) * LEVEL if code > INSULT else 1.0)
                        paths.append(name)
                yield Clause(at, at + len(part), evidence, paths)
            at += len(part) + 1

    def features(self, text: str) -> tuple[list[float], list[Clause]]:
        """What the curve reads, and the matched clauses."""
        tokens = _TOKEN.findall(text)
        found = list(self.clauses(tokens))
        if not found:
            return [0.0] * 6, found
        total, harm = sum(c.evidence for c in found), Counter()
        for c in found:
            harm.update(t.lower() for t in tokens[c.first : c.last] if self.symbols[t] > INSULT)
        per_word = 1000 * total / len(tokens)
        return [math.log1p(total), math.log1p(per_word), math.log1p(max(c.evidence for c in found)), math.log1p(len(harm)), math.log1p(sum(harm.values())), 1000 * sum(harm.values()) / len(tokens) / 50], found


def chance(features: list[float], curve: tuple[float, ...]) -> float:
    z = curve[0] + sum(f * c for f, c in zip(features, curve[1:], strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_curve(rows: np.ndarray, toxic: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Logistic curve by Newton's steps; the ridge keeps separable labels finite."""
    x = np.hstack([np.ones((len(rows), 1)), rows])
    w, hold = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    hold[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (toxic - p) - hold @ w)
        w = w + step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> DataFrame:
    """``text``, ``toxic`` and ``fold`` of the sampled labelled documents, one row per different text."""
    fold = fold_of("doc_id", FOLDS)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != HELD))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, toxic), (0, clean))]
    drawn = stored(drawn[0].unionByName(drawn[1]), "train_ids")  # at most toxic + clean rows of two numbers: the bound of the broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.max(fold).alias("fold"))


def _keys(text: str) -> set[str]:
    """Words, and beginnings with a mark, of a text."""
    words = {t.lower() for t in _TOKEN.findall(text) if t[0].isalpha()}
    return words | {w[:k] + "*" for w in words for k in range(BEGIN_LEAST, min(BEGIN_MOST, len(w) - 1) + 1)}


def learn_lexicon(texts: DataFrame, model: Model) -> Model:
    """``model`` with the words and beginnings that tell toxic texts; ``texts`` has ``text`` and ``toxic``."""

    def count(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(_keys(text))
        keys = list(toxic)  # the others cannot be entries; their counts are not needed
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "p": pa.array([toxic[k] for k in keys], pa.int64()), "n": pa.array([0] * len(keys), pa.int64())})
        keys = list(clean)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "p": pa.array([0] * len(keys), pa.int64()), "n": pa.array([clean[k] for k in keys], pa.int64())})

    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return model
    counts = texts.select("text", "toxic").mapInArrow(count, "key string, p long, n long").groupBy("key").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    half = F.lit(0.5)
    odds = F.log((F.col("p") + half) / (F.lit(sizes[1]) - F.col("p") + half)) - F.log((F.col("n") + half) / (F.lit(sizes[0]) - F.col("n") + half))
    error = F.sqrt(1 / (F.col("p") + half) + 1 / (F.col("n") + half))
    entries = counts.withColumn("weight", odds - ERRORS * error)
    good = entries.filter((F.col("p") >= LEAST_TEXTS) & (F.col("weight") >= LEAST_ODDS)).orderBy(F.desc("weight"), "key").limit(LEXICON).collect()
    # A word of the fixed list that the labels know well has the weight they give it, be it none.
    seen = entries.filter(F.col("key").isin(INSULTS) & (F.col("p") + F.col("n") >= 10)).collect()
    # A beginning that one longer entry explains says nothing more: "trash", not "tra"; the stem of a family stays.
    explained: Counter = Counter()
    for r in good:
        stem = r["key"].rstrip("*")
        for k in range(BEGIN_LEAST, len(stem) + (stem == r["key"])):
            explained[stem[:k] + "*"] = max(explained[stem[:k] + "*"], r["p"])
    good = [r for r in good if explained[r["key"]] < EXPLAINED * r["p"]]
    words = {w: SEED_WEIGHT for w in INSULTS} | {r["key"]: max(0.0, r["weight"]) for r in seen}
    words |= {r["key"]: r["weight"] for r in good if not r["key"].endswith("*")}
    return Model(words, {r["key"][:-1]: r["weight"] for r in good if r["key"].endswith("*")}, model.curve)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and curve from the labelled documents outside the held-out fold."""
    ship(docs.sparkSession)
    texts = stored(sample(docs, labels), "train_texts")
    model = learn_lexicon(texts.filter(F.col("fold") != CURVE_FOLD), Model())

    def read(batches):
        reader = Reader(model)
        for batch in batches:
            rows = [reader.features(t)[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(rows, pa.list_(pa.float64())), "toxic": batch.column(1)})

    # Six numbers for each text of the bounded sample's last fold.
    rows = texts.filter(F.col("fold") == CURVE_FOLD).select("text", "toxic").mapInArrow(read, "x array<double>, toxic int").collect()
    toxic = np.array([r["toxic"] for r in rows], float)
    if len(set(toxic.tolist())) == 2:
        model.curve = fit_curve(np.array([r["x"] for r in rows]), toxic)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``tie`` (hash of the text), ``score``, ``evidence``, and the matched ``clauses``
    (first and end code point, evidence, paths), in order."""
    ship(docs.sparkSession)
    clause = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64()), ("paths", pa.string())]))

    def read(batches):
        reader = Reader(model)
        for batch in batches:
            chances, evidence, clauses = [], [], []
            for text in batch.column(2).to_pylist():
                x, found = reader.features(text)
                chances.append(chance(x, model.curve))
                evidence.append(sum(c.evidence for c in found))
                spans = [m.span() for m in _TOKEN.finditer(text)] if found else []
                clauses.append([{"start": spans[c.first][0], "end": spans[c.last - 1][1], "evidence": c.evidence, "paths": ",".join(c.paths)} for c in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(chances, pa.float64()), pa.array(evidence, pa.float64()), pa.array(clauses, clause)],
                names=["doc_id", "tie", "score", "evidence", "clauses"],
            )

    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(read, "doc_id long, tie long, score double, evidence double, clauses array<struct<start: long, end: long, evidence: double, paths: string>>")


def toxic_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict on every row of ``docs`` by a model of ``labels``."""
    rows = score(docs, train(docs, labels))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return rows.select("doc_id", (fold_of("doc_id", FOLDS) == HELD).alias("held_out"), "score", predicted, "evidence", F.size("clauses").cast("long").alias("n_clauses"))


def without_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``most``."""
    bad = score(docs, train(docs, labels)).filter(F.col("score") >= most).select(F.col("doc_id").alias("_bad_id"), F.col("tie").alias("_bad_tie")).distinct()
    bad = stored(bad, "toxic")
    rows = packed(docs, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text()).alias("_tie"))
    same = rows["_id"].eqNullSafe(bad["_bad_id"]) & (rows["_tie"] == bad["_bad_tie"])
    return rows.join(bad, same, "left_anti").select("_row.*")
