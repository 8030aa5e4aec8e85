"""From documents to training windows: five stages, each a Parquet table that the next one reads.

Language ID drops documents without letters and those that no learned language parses; line dedup takes out lines
that stand earlier; order MinHash keeps the document with the smallest id of each class of near duplicates;
decontamination drops documents that hold a benchmark item; packing fills windows of 2,048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import decontaminate, langid, lines, omh, packing
from kinweave.llm.common import fresh, own_dir, table
from kinweave.llm.queries import tokenizer_path

#: Phrases a character above which a text isn't in a learned language: matches of one or two characters only.
FOREIGN = 0.6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts foreign to all learned languages."""
    numbered = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of the operator's own
    own = docs.select(*[F.col(c).alias(n) for c, n in numbered.items()])
    doc_id, text, lang = (numbered[c] for c in ("doc_id", "text", "lang"))
    learned = own.where(~langid.held_out(doc_id))
    kept = tuple(n for n in own.columns if n != doc_id)
    found = langid.identify(own, learned, id_col=doc_id, text_col=text, label_col=lang, keep=kept)
    left = found.where((F.col("lang_pred") != "und") & (F.col("rate") <= FOREIGN))
    return left.select(*[F.col(n).alias(c) for c, n in numbered.items()])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out of the texts that a like line stands before; n_chars, if there is one, follows."""
    left = lines.without_lines(docs, lines.dedup_lines(docs))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size))
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class."""
    found = omh.near_duplicates(docs)
    (key,) = fresh(docs, "first_id")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi").dropDuplicates(["doc_id", "text"])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    (key,) = fresh(docs, "hit_id")
    hits = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of the sources' proportions."""
    return packing.pack(docs, tokenizer=tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("packing", pack),
]

#: Automata, alignments and tokenizers have no SQL; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; what each leaves is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = own_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
