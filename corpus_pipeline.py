"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of documents.  ``run`` writes each stage's result as
Parquet to the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import jaccard_join, language_id, pieces, secret_scan
from scriptorium.llm.common import materialize, table
from scriptorium.llm.queries import mixed, model_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text goes where its language is undetermined or knows less than this share of its n-grams.
MIN_SHARE = 0.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language; ``lang`` is the predicted one afterwards."""
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    judged = language_id.identify(docs.select(*COLUMNS), model, out_col="language")
    kept = judged.where((F.col("language.lang") != language_id.UNDETERMINED) & (F.col("language.share") >= MIN_SHARE))
    return kept.withColumn("lang", F.col("language.lang")).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the row with the smallest id; ids come before nulls.

    Wordless documents stay.  Where ids repeat or are null, rows are told apart by
    a key of their own: two texts of one id are two documents, and rows that
    repeat id and text are one.
    """
    rows = docs.select(*COLUMNS)
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not repeated:
        groups = jaccard_join.jaccard_components(rows, "doc_id", "text", num=80, den=100)
        firsts = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("first_id"))
        return rows.join(firsts, F.col("doc_id") == F.col("first_id"), "left_semi")
    keyed = materialize(rows.dropDuplicates(["doc_id", "text"]).withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    groups = jaccard_join.jaccard_components(keyed, "row_key", "text", num=80, den=100).select(F.col("doc_id").alias("row_key"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("row_key"))
    met = keyed.select("doc_id", "row_key").join(groups, "row_key")
    firsts = met.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row_key").alias("first_key"))
    return keyed.join(firsts, F.col("row_key") == F.col("first_key"), "left_semi").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts every known form and every live token; ``n_chars`` is that of the redacted text."""
    found = secret_scan.scan(docs, keep=COLUMNS[1:])
    text = F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(secret_scan.redacted(F.col("text"), F.col("found")))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.length(text).cast("long"), F.col("n_chars")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the target shares of source, language and topic; scarce ones come as several rows, all together no more than are read."""
    taken = mixed(docs.select(*COLUMNS), within_rows=True).where("mix_kept")
    return taken.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("mix_copies")))).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked against their decoding."""
    return pieces.token_digests(docs, model_path())


STAGES = [("language_id", language_stage), ("ngram_jaccard_join", jaccard_stage), ("secret_scans", secret_stage), ("mixing", mixing_stage), ("pieces", pieces_stage)]

#: The language filter, the draw of the mix and the piece ids are beyond SQL; tests look at columns, counts, links and keys of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
