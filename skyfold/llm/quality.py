"""Quality by weak supervision, in DataFrame functions only.

Rules vote for a text (1), against it (-1) or abstain (0). Every text is good or bad, unseen; when a rule votes, it is right with an
accuracy of its own, and expectation-maximisation over all texts estimates the accuracies from where rules agree and differ. Most rules know
one kind of junk each: they vote against it and abstain otherwise, so that one of them can reject a text alone. Both classes have
even odds beforehand. A text is kept if its posterior probability of being good reaches one half and the plain base rules do not fail it.

Only counts per vote pattern matter to the estimation, at most 3 to the power of the number of rules whatever the number of texts: they
are aggregated once, and each round is one aggregate over them whose few sums reach the driver.

Windows of eight words are found again by hash inside each row; nothing is exploded or shuffled.

Defined cases: a null text has no words and fails the base; a row's result depends on other rows only through the rates;
an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import WORD, whole_text
from skyfold.session import stored

WINDOW = 8
LEAST_WORDS = 20
ROUNDS = 25
#: Accuracies start here, with so many votes behind the start, and stay within bounds.
START, START_VOTES = 0.8, 10.0
LEAST_ACCURACY, MOST_ACCURACY = 0.05, 0.99
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _dropped(text: Column, chars: str) -> Column:
    """How many of ``chars`` a text holds."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def _covered(starts: Column) -> Column:
    """Words in at least one of the windows that begin at these ascending places."""
    empty = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"))
    return F.aggregate(starts, empty, step)["n"]


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once: a column named inside a lambda could be put there as its expression and be worked out
    again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def features(docs: DataFrame) -> DataFrame:
    """Counts the base rules and the voting rules are made of."""
    text = whole_text()
    out = docs.select(F.col("doc_id"), text.alias("text"), F.regexp_extract_all(text, F.lit(f"({WORD})")).alias("words"))
    # A line has a word if it is not blank.
    lines = F.filter(F.split("text", "\n"), lambda line: F.char_length(F.translate(line, _BLANKS, "")) > 0)
    out = out.withColumn("lines", lines).withColumn("n_words", F.size("words").cast("long"))
    places = F.sequence(F.lit(0), F.size("words") - WINDOW)
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    windows = _bound(hashes, lambda h: F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    out = out.withColumn("windows", F.when(F.size("words") >= WINDOW, windows))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("ordered", ordered)
    again = _bound(F.col("ordered"), lambda o: F.filter(o, lambda x, i: (F.get(o, i - 1)["h"] == x["h"]) | (F.get(o, i + 1)["h"] == x["h"])))
    out = out.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    ended = F.size(F.filter("lines", lambda line: F.regexp(line, F.lit(r"[.!?][\x20\x09-\x0D]*$")))).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        F.char_length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        _dropped(F.col("text"), _SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("starts")), F.lit(0)).cast("long").alias("n_repeat_words"),
        _dropped(F.col("text"), _CAPITALS).alias("n_capitals"),
        _dropped(F.col("text"), "!").alias("n_bangs"),
        ended.alias("n_ended"),
    )


#: Rule: (condition against, condition for), as SQL over the features; neither: the rule abstains.
RULES = {
    "length": ("n_words < 20", "FALSE"),
    "symbols": ("10 * n_symbols > n_words", "FALSE"),
    "dup_lines": ("10 * n_dup_lines > 3 * n_lines", "FALSE"),
    "repeats": ("10 * n_repeat_words > 2 * n_words", "FALSE"),
    "capitals": ("2 * n_capitals > word_chars", "FALSE"),
    "bangs": ("4 * n_bangs > n_words", "FALSE"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 15 * n_words", "FALSE"),
    "sentences": ("5 * n_ended < n_lines", "2 * n_ended >= n_lines AND 50 * n_symbols <= n_words AND 20 * n_bangs <= n_words"),
    "prose": ("FALSE", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words AND 5 * n_capitals <= word_chars AND 10 * n_symbols <= n_words"),
}
BASE_FAILED = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 30 * n_words)"


def _vote(rule: str) -> str:
    against, for_ = RULES[rule]
    return f"CASE WHEN {against} THEN -1 WHEN {for_} THEN 1 ELSE 0 END"


def _posterior(accuracy: dict[str, float]) -> Column:
    """Probability of a good text, from its votes.

    The numbers stand in arrays: Spark then compiles the same code once for all rounds.
    """
    odds = None
    for rule, a in accuracy.items():
        log = math.log(a / (1 - a))
        term = F.get(F.lit([-log, 0.0, log]), F.col(f"v_{rule}") + 1)
        odds = term if odds is None else odds + term
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> dict[str, float]:
    """Accuracies after ``rounds`` rounds, from (votes, ``rows``) per pattern."""
    accuracy = dict.fromkeys(RULES, START)
    for _ in range(rounds):
        weighed = patterns.withColumn("good", _posterior(accuracy))
        sums = []
        for rule in RULES:
            v = F.col(f"v_{rule}")
            right = F.when(v == 1, F.col("good")).when(v == -1, 1 - F.col("good")).otherwise(F.lit(0.0))
            sums += [F.sum(F.col("rows") * right).alias(f"{rule}_right"), F.sum(F.col("rows") * F.abs(v)).alias(f"{rule}_votes")]
        s = weighed.agg(*sums).first().asDict()
        for rule in RULES:
            a = ((s[f"{rule}_right"] or 0.0) + START * START_VOTES) / (float(s[f"{rule}_votes"] or 0) + START_VOTES)
            accuracy[rule] = min(MOST_ACCURACY, max(LEAST_ACCURACY, a))
    return accuracy


def judge(docs: DataFrame) -> DataFrame:
    """Per row the counts, the base verdict, the posterior probability of being good, and whether the text is kept."""
    voted = stored(features(docs).withColumns({f"v_{r}": F.expr(_vote(r)) for r in RULES}), "votes")
    patterns = stored(voted.groupBy(*[f"v_{r}" for r in RULES]).agg(F.count("*").alias("rows")), "patterns")
    failed = F.expr(BASE_FAILED)
    good = _posterior(estimate(patterns))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (good >= 0.5)).alias("kept"), F.round(good, 6).alias("p_good"),
    )


def _judge_sql() -> str:
    """DuckDB SQL for ``judge``: windows compared as lists of words, and the rounds as a recursion over vote patterns."""
    b = r"\x20\x09-\x0D"
    votes = ", ".join(f"{_vote(r)} AS v_{r}" for r in RULES)
    names = ", ".join(f"v_{r}" for r in RULES)
    start = " + ".join(f"v_{r} * ln({START} / {1 - START:.10g})" for r in RULES)

    def accuracy(r: str) -> str:
        right = f"sum(c * CASE v_{r} WHEN 1 THEN q WHEN -1 THEN 1 - q ELSE 0 END) OVER ()"
        return f"least({MOST_ACCURACY}, greatest({LEAST_ACCURACY}, ({right} + {START * START_VOTES}) / (sum(c * abs(v_{r})) OVER () + {START_VOTES})))"

    again = " + ".join(f"v_{r} * ln({accuracy(r)} / (1 - {accuracy(r)}))" for r in RULES)
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^{b}]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{b}]')) AS lines FROM d),
win AS (SELECT rid, i, list_aggregate(words[i:i + {WINDOW - 1}], 'string_agg', ' ') AS g
        FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS t(i)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM dup) GROUP BY rid),
f AS (SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[{b}]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
             CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_bangs,
             CAST(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?][{b}]*$'))) AS BIGINT) AS n_ended
      FROM w LEFT JOIN cov USING (rid)),
v AS (SELECT *, {votes} FROM f),
p AS (SELECT {names}, count(*)::DOUBLE AS c FROM v GROUP BY ALL),
em AS (
  SELECT 0 AS k, *, 1 / (1 + exp(-({start}))) AS q FROM p
  UNION ALL
  SELECT k + 1, {names}, c, 1 / (1 + exp(-({again}))) FROM em WHERE k < {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
       (NOT {BASE_FAILED} AND q >= 0.5) AS kept, round(q, 6) AS p_good
FROM v JOIN (SELECT * FROM em WHERE k = {ROUNDS}) USING ({names})
"""


JUDGE_SQL = _judge_sql()
