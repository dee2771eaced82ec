from __future__ import annotations

import random
import zlib

import pytest
from tests.llm.conftest import odd_rows

from skyfold.llm import toxicity
from skyfold.llm.common import documents

SYMBOLS = {"so": toxicity.OTHER, "you": toxicity.TARGET, "not": toxicity.NEGATION, "said": toxicity.REPORT, "kill": toxicity.THREAT, "idiot": toxicity.INSULT}


def by_hand(words):
    """Paths of one clause by looking back over its words, without states."""
    out = []
    for i, w in enumerate(words):
        near = lambda x, n, before=i: any(words[j] == x for j in range(max(0, before - n), before))
        kind = {"idiot": "insult", "kill": "threat"}.get(w)
        if kind and "said" in words[:i]:
            out.append("reported")
        elif kind and near("not", toxicity.SCOPE):
            out.append("negated")
        elif kind:
            out.append(("aimed " if near("you", toxicity.REACH) else "") + kind)
        elif w == "you":
            # Harm alone that no other target has taken since.
            last = max((j for j in range(max(0, i - toxicity.REACH), i) if words[j] in ("idiot", "kill")), default=None)
            own = [j for j in range(max(0, i - toxicity.REACH), i) if out_at(words, j) in ("insult", "threat") and "you" not in words[j:i]]
            later = own and any(out_at(words, j) in ("aimed insult", "aimed threat") for j in range(own[-1] + 1, i))
            if last is not None and own and not later:
                out.append("aim")
    return out


def out_at(words, i):
    kind = {"idiot": "insult", "kill": "threat"}.get(words[i])
    if not kind:
        return None
    if "said" in words[:i]:
        return "reported"
    if "not" in words[max(0, i - toxicity.SCOPE) : i]:
        return "negated"
    return ("aimed " if "you" in words[max(0, i - toxicity.REACH) : i] else "") + kind


def test_composed_machine_against_looking_back():
    table, rnd = toxicity.grammar(), random.Random(3)
    for _ in range(3000):
        words = rnd.choices(list(SYMBOLS), weights=[6, 2, 1, 1, 1, 2], k=rnd.randint(1, 14))
        state, paths = 0, []
        for w in words:
            state, name, weight = table[state][SYMBOLS[w]]
            if name:
                paths.append(name)
                assert weight == toxicity.PATHS[name]
        assert paths == by_hand(words), words
        assert table[state][toxicity.END][0] == 0


def test_clauses_are_scored_apart():
    reader = toxicity.Reader(toxicity.Model())
    score = lambda t: toxicity.chance(reader.features(t)[0], reader.symbols.model.curve)
    assert score("you are an idiot") > score("an idiot") > score("you are not an idiot") > score("you are kind")
    assert score("she said: fine. You idiot") > score("they said you are an idiot")
    assert score("we kill the process") < score("i will find you and kill you")
    (clause,) = reader.features("All fine here. You’re a pathetic LOSER, friend! Bye")[1]
    assert clause.paths == ["aimed insult", "aimed insult"]


def test_learned_words_and_beginnings(spark):
    """Insults never listed, a family of which each word is rare, and clean documents with the same common words."""
    rnd = random.Random(7)
    clean = [f"w{''.join(rnd.choices('aeioulnrst', k=4))}" for _ in range(300)]

    def text(i):
        words = rnd.choices(clean, k=60)
        if i % 4 == 0:
            words[3] = rnd.choice(["glorp", "snarkle"])
            words[30] = "zemp" + "".join(rnd.choices("abcdefghij", k=4))
        return " ".join(words)

    rows = [(i, text(i)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {"glorp", "snarkle"} <= set(model.words) and "zemp" in model.begins
    got = {r.doc_id: r for r in toxicity.toxic_report(docs, labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(1200))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(1200))
    assert toxicity.without_toxic(docs, labels).count() == 900


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = documents(spark, sf, "labels")
    rows = toxicity.toxic_report(documents(spark, sf), labels).filter("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.85 * sum(r.toxic for r in rows) and hit >= 0.95 * sum(r.predicted for r in rows)


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, odd, none, labelled):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] if labelled else [], "doc_id long, toxic int")
    rows = toxicity.toxic_report(odd, labels).collect()
    assert len(rows) == len(odd_rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.toxic_report(none, labels).count() == 0
    assert toxicity.without_toxic(odd, labels).columns == odd.columns


def test_spans_are_of_the_text_itself(spark):
    text = "İstanbul is fine\nYou are a stupid MORON; bye. Idiot"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = toxicity.score(docs, toxicity.Model()).collect()
    assert [text[c.start : c.end] for c in row.clauses] == ["You are a stupid MORON", "Idiot"]
