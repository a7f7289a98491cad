"""The training-data pipeline: five stages, each on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``documents``.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows, empty tables and further
columns of any name; what it does with them is said at the stage. Texts are always read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, ngram_join, packing, secrets, toxicity
from ledgerloom.llm.common import materialise, table


#: Target weights of the sources, for the order of the mix; None: by square root of size.
WEIGHTS: dict[str, int] | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects (score 0.3 or more) go.

    Empty and null texts are scored like others (no features), repeated rows alike; without labelled rows nothing can
    be learned and every document has the same low score."""
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model) < 0.3)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five words, similarity 0.8 or more) the smallest id stays; rows without an id come last.

    Rows are told apart by id and text: of several texts under one id only copies go, and a row that repeats both counts
    once. Texts without words have no copies: each id keeps its own."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays, repeated ones too.

    Null and empty texts stay as they are; ``n_chars`` follows where a text has changed."""
    found = secrets.scan(docs, secrets.train(secrets.labelled_findings(spark)))
    return secrets.redact(docs, found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, stored in the order of the mix of sources, which the packing follows; a null source is a source of its own.

    Ties and repeated rows have places of their own. Columns of documents that are named like the mix's own pass through."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    return mixing.by_text(rows, WEIGHTS).orderBy("mix_position").select("row.*")


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins that training sequences are made of: (bin_id, doc_id, piece, start_word, n_words, mix_from).

    Shards are ranges of the order in which ``docs`` are stored, that is of the mix, and numbered in it. Texts without words are one piece of no words; null
    ids and repeated rows are documents of their own, and only ids are given back."""
    return packing.pack_stored(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_each),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: No SQL: learned models and a sequential packing take part.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
