"""The corpus pipeline: documents to packed training sequences. Each stage works on all rows of the one before.

All stages take documents of any columns beside doc_id, text, lang and source, and keep them with their values; null and empty texts, texts of any
length, repeated rows and tables without rows have defined results, given for each stage.
"""

import public_tokenizers

from switchback.llm.line_dedup import without_boilerplate
from switchback.llm.ngram_join import one_of_each
from switchback.llm.packing import pack
from switchback.llm.quality_rules import passing
from switchback.llm.resampling import sampled
from switchback.storage import delete, kept


def quality_classifier(spark, docs, sf_dir):
    """Documents that importance resampling draws; the others go.

    A null or empty text has weight 0, and is judged by its noise alone; repeated rows have one key and share their fate; a key equal to the cutoff is drawn.
    """
    return sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and the risk-controlled cutoffs; the others go.

    Null and empty texts have no words and go; repeated rows are judged alike; a value equal to its cutoff passes.
    """
    return passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark, docs, sf_dir):
    """All documents, their texts without the boilerplate lines of their source.

    A null text stays null, an empty one empty; a null source is a source of its own; repeated rows are pages of their own.
    """
    return without_boilerplate(docs, counts=False)


def ngram_jaccard(spark, docs, sf_dir):
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    Texts without words stay; of rows with one doc_id and equal sets of shingles one stays, while different texts with one doc_id are different documents.
    """
    return one_of_each(docs)


def packing(spark, docs, sf_dir):
    """Pieces of documents in sequences of at most 1024 tokens, with their ids.

    A null or empty text is its end token alone; repeated rows are documents of their own.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [(f.__name__, f) for f in (quality_classifier, quality_rules, line_dedup, ngram_jaccard, packing)]
#: SQL can express neither the classifier nor the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in turn. What a stage wrote besides its result is deleted when the result is written, and then the result of the stage before."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = kept(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            delete(spark, before)
        before = docs.inputFiles()[0].rsplit("/", 1)[0] if docs.inputFiles() else None
    return STAGES[-1][1](spark, docs, sf_dir)
