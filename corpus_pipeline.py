"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each stage's rows as Parquet to shared storage and reads
them again for the next one. An empty table gives an empty result at every
stage, very long texts are worked on whole, and columns beside those of the
documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, minhash, packing, substring, toxicity
from quire.llm.columns import fresh, named
from quire.session import materialize

#: A text nearer to no profile than this is in none of the languages.
LEAST_LANG_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no determined language.

    A null text, or one without a letter, is in none and goes; so does every text
    where no row teaches a language. Rows of null lang teach nothing. Ties go to the
    smaller language name. Repeated rows are judged each, and stay or go together.
    """
    names = fresh(docs.columns, "lang_pred", "lang_score")
    found = langid.predict(docs, langid.learn(docs.where(~langid.held_out(2, 4))), added=tuple(names))
    return _own(found.where((named(names[0]) != "und") & (named(names[1]) >= LEAST_LANG_SCORE)), docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic texts.

    Null and empty texts have no evidence and stay; so does every text where the
    labels do not have both classes. Null labels teach nothing; of several of one
    doc_id the largest counts. A score at the threshold is toxic. Repeated rows
    are judged each, and stay or go together; rows of null doc_id are judged by their text.
    """
    names = fresh(docs.columns, "toxic_score", "toxic_predicted")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _own(toxicity.predict(docs, model, added=tuple(names)).where(named(names[1]) == 0), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8).

    The one of the smallest doc_id stays. Null, empty and wordless texts are in no
    group and stay. Of rows that share a doc_id one stays, that of the smallest text
    hash; rows of null doc_id all stay.
    """
    return minhash.deduplicate(docs, k=5, percent=80)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes 50-word passages out of all documents but the first that has them.

    The smallest doc_id keeps a passage. No row goes; a text that loses words is the
    rest joined by single spaces, perhaps empty, and its n_chars follows. Texts that
    lose none, null and short ones, and rows of null doc_id are left as they are;
    rows that share a doc_id take nothing from each other.
    """
    names = fresh(docs.columns, "n_words", "n_removed", "kept_text")
    cut = substring.remove_repeats(docs, added=names)
    lost = named(names[1]) > 0
    text = F.when(lost, named(names[2])).otherwise(F.col("text"))
    chars = F.when(lost, F.length(named(names[2])).cast("long")).otherwise(F.col("n_chars"))
    return _own(cut.withColumns({"text": text, "n_chars": chars}), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left into sequences.

    A null or empty text is the end id alone. Repeated rows are packed as often as
    they occur, null ids stay null, and other columns are ignored.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _own(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, whatever their names."""
    return found.select(*[named(c) for c in docs.columns])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("packing", pack),
]

#: SQL has no tokenizer and no trained models; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
