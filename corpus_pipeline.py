"""From raw documents to a training mix: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents`` (the last one adds those of the mix).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardline.llm.contamination import contamination
from hazardline.llm.mixing import mixed_documents
from hazardline.llm.near_copies import near_copies
from hazardline.llm.quality import fit_quality, held_out, quality_scores
from hazardline.llm.secrets import secret_scan
from hazardline.session import ship_code, stage_table

#: A document with a lower score is rejected.
QUALITY = 0.7
MASK = "[secret]"


def _packed(docs: DataFrame, *open_: str) -> tuple[DataFrame, str]:
    """(``docs`` with every column inside one struct, beside the ``open_`` ones that a stage reads; the struct's name).

    So no column of a user can meet one that an operator adds.
    """
    return docs.select(*open_, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole_row")), "whole_row"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled documents among these, but for the held-out ones.

    A null text is scored like an empty one, a repeated row like the first; other columns come back as they are.
    """
    labels = ship_code(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    packed, row = _packed(docs, "doc_id", "text")
    weights = fit_quality(packed.drop(row), labels.where(~held_out("doc_id")))
    return quality_scores(packed, weights).where(F.col("score") >= QUALITY).select(f"{row}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id. Rows without a text or an id stay.

    Of repeated rows one stays; empty texts are copies of each other; other columns come back as they are.
    """
    ship_code(spark)
    packed, row = _packed(docs, "doc_id", "text")
    classes = near_copies(packed.drop(row))
    first = classes.where("doc_id = class_id and copy is not null").groupBy("root").agg(F.min("class_id").alias("doc_id"), F.min("copy").alias("copy"))
    first = stage_table(first.drop("root"), "first")
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    whole = packed.where("doc_id is not null and text is not null").withColumn("copy", key)
    kept = whole.join(first, ["doc_id", "copy"]).dropDuplicates(["doc_id", "copy"]).select(f"{row}.*")
    return kept.unionByName(docs.where("doc_id is null or text is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of words that occur in the benchmark.

    A null text stays null; repeated rows are each cut; ``n_chars`` follows the text, other columns come back as they are.
    """
    benchmark = ship_code(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    packed, row = _packed(docs, "doc_id", "text")
    return _with_text(docs, contamination(packed, benchmark, cut=True, carry=(row,)), row, "clean")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked.

    A null text stays null; repeated rows are each masked; ``n_chars`` follows the text, other columns come back as they are.
    """
    ship_code(spark)
    packed, row = _packed(docs, "doc_id", "text")
    return _with_text(docs, secret_scan(packed, mask=MASK, carry=(row,)), row, "masked")


def _with_text(docs: DataFrame, changed: DataFrame, row: str, text: str) -> DataFrame:
    new = F.when(F.col(f"{row}.text").isNotNull(), F.col(text))
    fresh = {"text": new}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(new.isNull(), F.col(f"{row}.n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return changed.select(*(fresh.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with how often each is taken.

    Columns of the mix whose name ``docs`` has already are added as ``mix_`` and that name. A null or empty text has no
    words and takes no part in a target, repeated rows are documents of their own, null sources are one source.
    """
    ship_code(spark)
    packed, row = _packed(docs, "doc_id", "text", "source")
    taken = mixed_documents(packed)
    added = [F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in ("size", "source_size", "target", "copies", "taken")]
    return taken.select(f"{row}.*", *added)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
]
#: SQL has no near-copy classes and no trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written as Parquet and read again."""
    docs = ship_code(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
