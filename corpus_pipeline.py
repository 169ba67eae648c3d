"""A training corpus from raw documents: five stages, each one operator over all that the stage before it kept.

Every stage but the last returns the columns of ``documents``. Toxic documents go; of equal texts one stays; of each group
of near-duplicates (word shingles of five, similarity 0.8) one stays; sources are mixed by temperature so that each
document is seen once at least and those of smaller sources up to ``REPEATS`` times; the last stage gives piece ids.

Every stage takes null and empty texts as texts without words, which are clean, equal to each other and near to nothing; very
long texts are read whole; null ids, sources and languages are kept and stand for themselves; rows repeated with one id are
rows of their own, told apart by their text; ties go to the smallest id, then the smallest MD5; columns besides doc_id, text,
lang and source may have any names and stay as they are; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dcbspark.llm import exact_dedup, mixing, near_dup, pieces, toxicity
from dcbspark.llm.common import drop_since, materialise, numbered, renamed, written

#: How often a document of the smallest source may be seen against one of the largest.
REPEATS = 1.25


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among them, doesn't reject by its language's threshold."""
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = toxicity.scored(docs, model)
    return rows.filter(~F.col(rows.columns[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest id."""
    return exact_dedup.exact_kept(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, of those the smallest MD5; null ids come last.
    Documents without words stay. Rows are told apart by id and text."""
    groups = near_dup.near_groups(docs).select(F.col("doc_id").alias("id"), F.col("text_md5").alias("md5"), "component")
    groups = materialise(groups, "pipeline-near")
    least = groups.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "md5")).alias("row"))
    kept = least.select("row.id", "row.md5").union(groups.filter("component is null").select("id", "md5"))
    rows, own = numbered(docs), {c: F.col(f"c{k}") for k, c in enumerate(docs.columns)}
    md5 = F.unhex(F.md5(F.coalesce(own["text"].cast("string"), F.lit(""))))
    return renamed(rows.join(kept, own["doc_id"].cast("long").eqNullSafe(F.col("id")) & (md5 == F.col("md5")), "left_semi"), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, each of them once at least."""
    return mixing.mixed(docs, repeats=REPEATS, whole=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, scores and checksums of its N best segmentations, and whether the ids decode to its text.
    Workers have served other stages before, so each task gives its memory back."""
    return pieces.encoded(docs, pieces.default_model(spark), carry=("doc_id", "lang", "source"), remember=False).select("doc_id", "lang", "source", "n_tokens", "ids", "score", "nbest_scores", "nbest_crc32", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("near_dedup", unlike),
    ("mixing", mixture),
    ("sentencepiece", tokens),
]

#: SQL can't express a trained classifier, so the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is removed once the next one's input is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
            drop_since(spark, mark, keep=1)
    return docs
