"""Documents made into training tokens: quality rules, exact and near duplicates, the mix of sources, token ids.

Every stage is ``f(spark, docs, sf_dir)`` and works on all that the stage before it kept.
"""

import public_tokenizers

from breachlens.llm import exact_dedup, mixing, near_dedup, pieces, quality_rules
from breachlens.session import staged

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark, docs, sf_dir):
    """Documents that no rule rejects."""
    return quality_rules.keep_quality(docs)


def exact(spark, docs, sf_dir):
    """Of equal texts the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark, docs, sf_dir):
    """Of documents linked at a similarity of 0.8 on five-word shingles the smallest doc_id."""
    return near_dedup.drop_near_duplicates(docs)


def mix(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark, docs, sf_dir):
    """The documents with their ids, the text these decode to, and digests of both."""
    return pieces.encoded(docs, PIECE_MODEL, keep=True)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("sentencepiece", tokens)]

#: SQL cannot express hash minima and merges; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of a folder; what a stage returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
