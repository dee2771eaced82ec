"""Registered queries of this subpackage, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyfold.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


from skyfold.llm.ctw import score  # noqa: E402
from skyfold.llm.decontaminate import contaminated  # noqa: E402
from skyfold.llm.divergence import AUDIT_SQL, audit  # noqa: E402
from skyfold.llm.jaccard import jaccard_groups  # noqa: E402
from skyfold.llm.langid import identify  # noqa: E402
from skyfold.llm.mixing import MIX_SQL, mix_report  # noqa: E402
from skyfold.llm.quality import JUDGE_SQL, judge  # noqa: E402
from skyfold.llm.resampling import RESAMPLE_SQL, report  # noqa: E402
from skyfold.llm.secrets import find_secrets  # noqa: E402
from skyfold.llm.shards import shard_documents  # noqa: E402
from skyfold.llm.templates import LINES_SQL, line_report  # noqa: E402
from skyfold.llm.tokens import encode_and_read  # noqa: E402
from skyfold.llm.toxicity import toxic_report  # noqa: E402


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document through the trigram index."""
    return find_secrets(documents(spark, sf_dir))


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under context-tree weighting, beside the unigram base."""
    return score(documents(spark, sf_dir))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a conditional random field over its words."""
    return identify(documents(spark, sf_dir))


@query("op4_source_mixing", MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mix_report(documents(spark, sf_dir))


@query("op5_token_output")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    return encode_and_read(documents(spark, sf_dir), vocabulary())


@query("op6_line_dedup", LINES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines of recurring templates."""
    return line_report(documents(spark, sf_dir))


@query("op7_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard_groups(documents(spark, sf_dir), 4, 85)


@query("op8_quality_rules", JUDGE_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document by voting rules of estimated accuracy."""
    return judge(documents(spark, sf_dir))


@query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark."""
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    return shard_documents(documents(spark, sf_dir))


@query("op11_source_divergence", AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every pair of sources of a language, and each source's terms above its language's use."""
    return audit(documents(spark, sf_dir))


@query("op12_importance_resampling", RESAMPLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and draw of every document towards the benchmark's texts."""
    return report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the clause grammar."""
    return toxic_report(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
