"""Helpers shared by the corpus operators: table access, Arrow batch slicing and shared-storage tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

#: Characters of text that one vectorised step works on (a longer single text makes its own step).
STEP_CHARS = 400_000
#: Texts of one step at most, however short they are.
STEP_ROWS = 4096
#: Rows of an Arrow batch sent to Python; texts can be long, so batches are kept small.
BATCH_ROWS = 512


def tune(spark: SparkSession) -> None:
    """Bound the size of Arrow batches for the session; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def quoted(name: str) -> str:
    """A column name as one identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, counts: DataFrame, hot: int = 1000) -> DataFrame:
    """Inner join of ``many`` with the at most one row of ``one`` for each key, where one key may hold a third of ``many``.

    ``counts`` has ``key`` and ``n``, about the rows of ``many`` by key. Keys with more than a ``hot``-th of all rows,
    fewer than ``hot`` by arithmetic, are broadcast as a list; their rows of ``many`` are dealt by a hash of ``by`` to as
    many parts as they are large, and their rows of ``one`` are repeated for each part (2 * ``hot`` repeats at most).
    """
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    edge = max(total / hot, 1.0)
    if most <= edge:
        return many.join(one, key)
    heavy = F.broadcast(counts.where(F.col("n") > edge).select(key, F.ceil(F.col("n") / edge).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = many.join(heavy, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    repeated = one.join(heavy, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(repeated, [key, "__part"]).drop("__part")


def slices(texts: list[str], limit: int = STEP_CHARS, rows: int = STEP_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows that hold about ``limit`` characters each, at least one row."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit or i - lo >= rows:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def fields(df: DataFrame, names: Iterable[str], added: str) -> StructType:
    """The schema of columns ``names`` of ``df``, whatever names and types they have, and of ``added`` ones."""
    return StructType([StructField(c, df.schema[c].dataType) for c in names] + StructType.fromDDL(added).fields)


def text_map(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[list[str], dict[str, list]], dict]], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Run a vectorised kernel over whole texts.

    ``make()`` is called once per task and returns ``kernel(texts, kept) -> columns``; nulls reach the kernel
    as empty texts. ``kept`` has the columns named in ``keep`` as lists.
    """
    cols = df.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)], F.col(quoted(text)).alias("t"))  # read by place
    out_schema = cols.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            kept = {c: batch.column(i).to_pylist() for i, c in enumerate(keep)}
            for lo, hi in slices(texts):
                out = kernel(texts[lo:hi], {c: v[lo:hi] for c, v in kept.items()})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        finish = getattr(kernel, "finish", None)
        if finish is not None and (out := finish()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return cols.mapInArrow(run, out_schema)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset: in local mode (tests) a folder of this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; intermediate tables need a folder that all machines share")
        import tempfile

        found = getattr(shared_folder, "local", None)
        if not found:
            found = shared_folder.local = tempfile.mkdtemp(prefix="lodestrata-")
    return found.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestrata/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.stored_path)


def release(spark: SparkSession) -> None:
    """Delete all stored tables of this application; its results that read them must have been written before."""
    _delete(spark, f"{shared_folder(spark)}/lodestrata/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
