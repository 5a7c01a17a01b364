"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame, which is written as Parquet and read again.
All stages but the last return the columns of ``documents``, whichever they
are: the stages read doc_id and text (personal data also n_chars), and no other
column's name can clash with theirs. Null ids and texts, empty and very long
texts, ties and repeated rows have a defined result in every stage, stated
below; an empty table stays empty through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontaminate, jaccard, packing, pii, quality
from tallyforge.llm.common import finished, n_staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labeller reject go. The labeller is fitted on a bounded sample of ``labels``.

    Null and empty texts have too few words and go; repeated rows stay or go together.
    """
    return quality.keep_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more over 5-word shingles, the one with the least id stays.

    Ties in the id are decided by the text's hash; of rows equal in id and text
    one stays; a null id comes after all others; null and empty texts are equal.
    """
    return jaccard.keep_firsts(docs, jaccard.join_ngrams(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within the edits allowed go.

    Null and empty texts hold none and stay; repeated rows stay or go together;
    items without words are passed over, and without items all documents stay.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; all documents stay and n_chars is counted anew.

    Null and empty texts stay as they are; repeated rows are masked alike.
    """
    return pii.mask_personal_data(docs, pii.train(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence of at most 2048 tokens.

    Null and empty texts are one end token; repeated rows are pieces of their own.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the labeller, the edit distance of words, the field and the packing; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each stage's rows are written and read again, and its working tables deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = n_staged()
        docs = finished(stage(spark, docs, sf_dir), name.replace(" ", "-"), before)
    return docs
