"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, PII, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.byte_bpe import bpe_round_trip
from lorespark.llm.common import materialize, small, table
from lorespark.llm.decontamination import find_contamination
from lorespark.llm.language_id import UNKNOWN, fit_language_id, identify_language, is_held_out
from lorespark.llm.minhash import near_duplicates
from lorespark.llm.pii import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text with fewer letters than this is too short to be rejected as ambiguous.
LEAST_LETTERS = 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of LEAST_LETTERS letters or more whose language is ambiguous. A document
    without a language gets the predicted one; the others keep theirs."""
    model = fit_language_id(docs.where(~is_held_out()))
    found = identify_language(docs.select(*COLUMNS), model)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (~F.col("ambiguous") | (letters < LEAST_LETTERS)))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the least id stays; of rows that repeat its id, the one whose text has the least
    digest. Rows with a null id stay. The ids that go, not the texts, are moved; an empty table gives no rows."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    gone = materialize(gone, "duplicate-ids")
    left = docs.join(small(gone), "doc_id", "left_anti").select(*COLUMNS)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = materialize(again, "repeated-ids")
    if not again.limit(1).count():
        return left
    row = F.struct(F.md5("text").alias("digest"), *COLUMNS)
    once = left.join(small(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("r")).select("r.*").select(*COLUMNS)
    return left.join(small(again), "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a word inside any benchmark window go, whatever their ids: they are told by a digest of the
    text, so rows with null or repeated ids are judged one by one. Null and empty texts stay; so do all rows if there is
    no benchmark; an empty table gives no rows."""
    keyed = docs.select(*COLUMNS, F.md5("text").alias("digest"))
    found = find_contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="digest")
    gone = materialize(found.where("n_hit > 0").select("digest").distinct(), "contaminated-texts")
    return keyed.join(small(gone), "digest", "left_anti").select(*COLUMNS)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in brackets; n_chars follows the text. A row in, a row out:
    null texts stay null, ids may be null or repeated; an empty table gives no rows."""
    out = redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them. A row in, a row out: null and empty
    texts have 0 tokens; ids may be null or repeated; an empty table gives no rows."""
    return bpe_round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicate_removal),
    ("decontamination", decontamination),
    ("pii", pii_redaction),
    ("bpe", bpe),
]

#: Language ID, MinHash classes, the random field and BPE can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
