"""A corpus pipeline of five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skirmish.llm import mixing, packing, pii, quality, similarity
from skirmish.llm.common import drop_staged, staged
from skirmish.llm.queries import PII_KEY, table, tokenizer_path


#: Bytes of text chunks that packing remembers in a task; the workers go on to other stages.
PACKING_CACHE = 32 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are mostly content lines; see quality.keep. Null, blank and short texts go."""
    return quality.keep(docs, quality.fit_lines(docs, table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: that with the smallest doc_id (null last); see similarity.keep_one for ties and repeats."""
    return similarity.keep_one(docs)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal numbers replaced; null texts stay null, repeated rows each stay. See pii.pseudonymise."""
    return pii.pseudonymise(docs, PII_KEY)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row for each copy; documents without words have none. See mixing.mix and mixing.take."""
    return mixing.take(docs, mixing.mix(docs))


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of sequences of 1024 tokens, each copy for itself; a null text is its end token. See packing.pack."""
    return packing.pack(docs, tokenizer_path(), cache_bytes=PACKING_CACHE, keep_cache=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("pii_pseudonyms", pii_pseudonyms),
    ("source_mixing", source_mixing),
    ("harmonic_packing", harmonic_packing),
]
#: The line labels of the first stage have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written as a table and read again. An empty table gives no rows."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_staged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
