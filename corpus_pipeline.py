"""Documents to training text: five stages, each on all that the one before has kept.

Every stage takes tables with other columns of any name and hands all columns on; an empty table gives an empty one.
Null ids and null texts are allowed; null texts stay null, and count as empty where a text is judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.llm.common import table, written

#: A passage of over 50 words is to be caught: 51 words of the languages at hand take 240 bytes or more.
REPEAT_BYTES = 240


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rule ensemble scores 0.3 or more. Empty and null texts are scored like any other, so
    repeated rows stay or go together; a score of exactly 0.3 stays. The model is fitted on labelled rows of this input."""
    from papertide.llm.quality import fit_quality, good_documents

    return good_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near copies: five-word shingles, similarity 0.8 or more, by SimHash.
    Wordless and null texts are one group; of rows of the same id and text one stays; rows without an id all stay."""
    from papertide.llm.nearcopies import near_copy_groups
    from papertide.llm.simhash import least_of_groups

    return least_of_groups(docs, near_copy_groups(docs.filter("doc_id is not null")))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes that are part of a string of ``REPEAT_BYTES`` bytes found elsewhere too, in the same or another row, and counts
    n_chars anew. All rows stay, emptied ones too; repeated rows empty each other; a character that loses a byte goes whole."""
    from papertide.llm.suffix import shortened

    return shortened(docs, REPEAT_BYTES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item with similarity 0.8 or more. Empty and null texts hold none; repeated rows
    stay or go together; empty and repeated items change nothing."""
    from papertide.llm.decontaminate import clean_documents

    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def subword_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece_ids, n_tokens and the text decoded from them, a row each; null and empty texts have no pieces and decode to
    the empty text. Input columns of these three names stay with ``_in`` added."""
    import public_tokenizers

    from papertide.llm.unigram import Vocabulary, decode_column, encode_column, without_clash

    vocab = Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    return decode_column(encode_column(without_clash(docs, "n_tokens"), vocab), vocab).withColumn("n_tokens", F.size("piece_ids").cast("long"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("subword_pieces", subword_pieces),
]

#: Learned scores, fingerprints and subword pieces have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
