"""documents, cleaned and packed: language, near duplicates, repeated passages, personal data, sequences."""

from __future__ import annotations

from geoframe.llm import language_id, ngram_join, packing, pii, substring_dedup

STAGES = [
    ("language ID", language_id.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("substring dedup", substring_dedup.stage),
    ("PII", pii.stage),
    ("best-fit packing", packing.stage),
]

#: Its stages hold trained models, MinHash and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each stage's result written and read again."""
    from geoframe.llm import common

    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
