"""The corpus pipeline: from raw documents to encoded ones, in five stages.

Each stage takes what the one before it left, as a table with the columns of `documents`, and its decisions take effect: rows go, texts
lose what repeats, rows come as often as the mix takes them. The last stage encodes, and decodes what it encoded.

Defined results: a null or empty text, or one of less than 50 words, fails the quality rules and is gone after the first stage. Rows with
null or equal doc_ids are told apart by their rows in the near-duplicate stage and by their texts in the next; of equal texts one row
stays. What the mix repeats keeps its doc_id, so the last stage may return several rows of one. Ties go to the smaller doc_id, null last,
then to the smaller hash of the text. Columns beyond those of `documents` are carried along, whatever their names, up to the last stage.
Texts are taken whole, however long. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe_codec, minhash_dedup, quality_rules, source_mix, suffix_dedup
from quillon.llm.common import discard, documents, gathered, stored


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, by shingles of five words at a similarity of 0.8."""
    return minhash_dedup.single(docs, width=5, percent=80)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out of the texts."""
    return suffix_dedup.clean(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mix of sources takes them, the last time up to the source's budget."""
    return source_mix.mixed_rows(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the text decoded from them, and the ids."""
    return bpe_codec.encoded_corpus(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", apply_quality_rules),
    ("minhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_strings),
    ("source mix", mix_sources),
    ("bpe encoding", encode_texts),
]

#: Neither near-duplicate components, nor repeated byte strings, nor byte-pair encoding can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each is written and read again before the next, and tables that are done with are deleted."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with gathered() as made:
            before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{i}")
        # what the stage kept on the way goes, and so does its input, now that its result is written
        discard(before, *(m for m in made if m is not docs))
    return STAGES[-1][1](spark, docs, sf_dir)
