"""The corpus pipeline: language ID, near-duplicate removal, decontamination, PII removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as Parquet in the
shared folder and gives it, read again, to the next. Learned parts read what their stage is given, except that the
language model's labels come from the rows of the stage's own input.

Defined results: documents need doc_id, text and lang; other columns may be missing, null or bear any name, and come
through. Null ids and ids that several texts share lose no row but near duplicates. Null and empty texts have no language
and go at the first stage. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import MapType

from lodestrata.llm import decontam, langid, neardup, packing, pii
from lodestrata.llm.common import documents, forget, held_out, quoted, stored, tune

#: Goes before the names of columns that a stage adds for itself.
OWN = "__stage_"


def columns(docs: DataFrame) -> list:
    return [F.col(quoted(c)) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; null, letterless and far-off texts go."""
    tune(spark)
    model = langid.fit(docs, ~held_out(F.col("doc_id")))
    found = langid.identify(docs, model, keep=tuple(docs.columns), prefix=OWN)
    return found.where(~F.col(OWN + "rejected")).select(*columns(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the least id, null last (of rows alike in all columns, one).

    Rows are named by two hashes of all their columns, so one shuffle of the rows picks those that stay.
    """
    tune(spark)
    plain = [F.col(quoted(f.name)) for f in docs.schema if not isinstance(f.dataType, MapType)]
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in plain])  # a hash passes nulls by
    keys = (OWN + "a", OWN + "b")
    rows = docs.select(*columns(docs), *[F.xxhash64(F.lit(k), nulls, *plain).alias(n) for k, n in enumerate(keys)])
    classes = neardup.classes(rows, keep=keys)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)).alias("k")
    stay = classes.groupBy("class_key").agg(first).select(*[F.col(f"k.{n}") for n in keys])
    one = Window.partitionBy(*keys).orderBy(F.lit(1))
    return rows.join(stay, list(keys)).withColumn(OWN + "n", F.row_number().over(one)).where(F.col(OWN + "n") == 1).select(*columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    tune(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by its kind; n_chars, where there is one, follows the text."""
    tune(spark)
    found = pii.scan(docs, redacted=True, keep=tuple(docs.columns), prefix=OWN)
    clean = F.when(F.col("text").isNotNull(), F.col(OWN + "redacted"))
    changed = {"text": clean, "n_chars": F.length(clean).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(quoted(c)) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 1024 tokens."""
    tune(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", deduplicate), ("decontaminate", decontaminate), ("pii", remove_pii), ("packing", pack)]

#: No stage but the choice of rows can be said in SQL: models, sampling and tokenizers are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "stored_path"):
            forget(before)
    return docs
