"""Documents to packed training sequences, stage by stage; each stage's rows are written and read again before the next.

Quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination,
best-fit packing. All but the last return the columns of ``documents``. Texts
that line dedup changes get a new n_chars; a document that it leaves without any
line goes (its text stands whole in earlier ones); others keep their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.llm import decontaminate, line_dedup, ngram_join, packing, quality
from pixelquarry.llm.common import materialize, table
from pixelquarry.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above. It learns from the rows this stage is given."""
    ship(spark)
    return quality.reject(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted; a document of which nothing is left goes."""
    ship(spark)
    done = line_dedup.dedup(docs, deleted="__deleted").filter("`__deleted` = 0 OR text <> ''")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__deleted") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    ship(spark)
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the packed sequences. Lean, as executors and their Python workers have grown in the stages before."""
    ship(spark)
    return packing.pack(docs, lean=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs


#: The trained model, the runs of lines and the token ids aren't SQL's; tests hold each stage against brute force.
ORACLE_SQL = None
