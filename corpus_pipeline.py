"""A corpus pipeline: quality rules, near copies, personal data, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the
columns of documents; the last returns the encoded documents. Near copies are documents
whose sets of five-word shingles have a Jaccard index of 0.8 or more, links followed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexaloc.llm import mixing, pieces, pii, quality, similarity
from hexaloc.llm._shared import materialize, table
from hexaloc.llm.queries import MIX, domain_of_source


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules. Null and blank texts fail; a null source is a
    host of its own; repeated rows are each judged; no rows give no rows."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies. Null and blank texts
    link with nothing and stay, as do rows with a null id; rows that share an id stay or go
    together; no rows give no rows."""
    return similarity.one_of_each(docs, percent=80, width=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked. Null and empty texts stay as they are; null or
    repeated ids don't matter; equal texts are masked alike; no rows give no rows."""
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budgets take, each as often as taken. A null language or source is a
    node of its own; null texts have no tokens; rows that share an id are taken or left together;
    no rows give no rows."""
    return mixing.mixed(docs, domain_of_source(), MIX)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its pieces, and a digest of what they decode to. Null and empty texts
    have no pieces; repeated rows stay, equal texts have equal pieces; no rows give no rows."""
    rows = pieces.encoded(docs, pieces.Vocabulary.load(pieces.default_path()))
    return rows.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: The stages use a seeded hash and a vocabulary that SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
