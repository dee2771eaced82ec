"""Secret scan over whole texts with a trigram inverted index.

Each block of documents is indexed in the task that reads it: postings of all trigrams of the lower-cased texts. A rule's Boolean
trigram query is answered by intersecting postings, and only the texts it names are searched with the rule's
expression; a rule without mandatory trigrams (bare hexadecimal runs) searches every text. Nothing is shuffled or kept:
a scan that meets each text once gains nothing from an index on disk, and none of the work depends on how keys are spread.

Defined cases: a null text is empty; every input row gives one row, repeated ids included; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import ship, whole_text
from skyfold.llm.trigrams import Segment, required

#: A segment of the index holds about so many bytes of text.
SEGMENT_BYTES = 1 << 21


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A leftmost match counts if ``group`` of it has ``least`` characters or more."""

    kind: str
    pattern: str
    flags: int = re.A
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Kinds beyond the base: their marks are so particular that prose does not hold them.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


def matches(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches in code points, without those that are too short."""
    return [m.span() for m in expression.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _searched(rule: Rule) -> re.Pattern:
    """The rule's expression. A lone run of a class is searched with its least length: the runs kept are the same."""
    if rule.pattern.endswith("]+") and rule.pattern.startswith("[") and rule.pattern.count("[") == 1 and rule.least > 1:
        return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", rule.flags)
    return re.compile(rule.pattern, rule.flags)


class Scanner:
    """Rules with their trigram queries."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = [(r, _searched(r), required(r.pattern, r.flags)) for r in rules]

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text its (start, end, rule number), by start and then rule."""
        segment = Segment([t.encode().lower() for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, expression, query) in enumerate(self.rules):
            for i in segment.candidates(query):
                found[i] += [(a, b, k) for a, b in matches(rule, expression, texts[i])]
        for spans in found:
            spans.sort(key=lambda s: (s[0], s[2]))
        return found


def _listed(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per document the counts of the base kinds, a digest of the base spans and all spans."""
    ship(docs.sparkSession)
    rules = tuple(rules)
    base = min(len(BASE), len(rules))

    def blocks(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= SEGMENT_BYTES:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def scan(batches):
        scanner = Scanner(rules)
        for ids, texts in blocks(batches):
            found = scanner.scan(texts)
            counts = [[sum(1 for s in spans if s[2] == k) for spans in found] for k in range(base)]
            plain = [_listed([s for s in spans if s[2] < base], rules) for spans in found]
            out = {"doc_id": pa.array(ids, pa.int64())}
            out |= {f"n_{rules[k].kind}": pa.array(counts[k], pa.int64()) for k in range(base)}
            out["base_sha256"] = pa.array([hashlib.sha256(p.encode()).hexdigest() for p in plain], pa.string())
            out["spans"] = pa.array([_listed(spans, rules) for spans in found], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, " + ", ".join(f"n_{r.kind} long" for r in rules[:base]) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(scan, schema)
