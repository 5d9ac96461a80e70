"""Helpers shared by the corpus operators.

Text columns travel to Python as Arrow batches.  A batch may hold up to ten
thousand rows of any length, so operators walk it in :func:`chunks` of bounded
bytes; a single text longer than the bound forms a chunk of its own.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step looks at.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one table of a scale-factor directory, file or folder of Parquet."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by ``spark.checkpoint.dir``.

    Where the session names none, a folder of this machine is set, but only for a
    local master: on a cluster executors' files in it would be out of reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="verdatrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`settle` wrote and nobody reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Survives the loss of any executor, unlike a local checkpoint.  Returns the
    table and its path, so that loops can drop what they no longer need.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows that a part file of a short-rowed table between steps holds, if there are as many.
PART_ROWS = 50_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` short rows, in no more partitions than its rows and the cores call for.

    Every part file costs the executor that writes it some child processes
    (Hadoop's local file system runs ``chmod`` for the file and its checksum),
    each of which has all its memory once more until it becomes another program.
    A small table that many partitions hold must not become as many files.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and the fields of ``ddl`` after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a string column; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def chunks(items: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges ``(start, end)`` of ``items`` with at most ``limit`` bytes, one item at least."""
    start = size = 0
    for k, x in enumerate(items):
        if k > start and size + len(x) > limit:
            yield start, k
            start, size = k, 0
        size += len(x)
    if start < len(items):
        yield start, len(items)


#: Rows up to which a side is broadcast; it is counted first.
BROADCAST_KEYS = 500_000
#: A key is hot with more than a HOT-th of a side's rows, so fewer than HOT keys are.
HOT = 100_000
#: Rows up to which one key may hold them all: a single task takes them with ease.
PLAIN_ROWS = 1_000_000


def join_keyed(big: DataFrame, small: DataFrame, key: str, how: str = "inner", total: int | None = None, plain: int | None = None) -> DataFrame:
    """``big`` (a table of ``total`` rows, counted if not given) joined to ``small`` by ``key``, of which ``small`` has one row at most each.

    Up to ``plain`` rows (``PLAIN_ROWS`` if not given) are simply dealt by key.

    Keys with more than a ``HOT``-th of the rows of ``big`` are fewer than
    ``HOT``: their rows meet a broadcast part of ``small`` where they are, and
    only all others are dealt by key, so no task gathers a hot key's rows.
    ``small`` is written as if it had ``total`` rows.
    """
    total = big.count() if total is None else total
    if total <= (PLAIN_ROWS if plain is None else plain):
        return big.join(small, key, how)
    big, small = settle(gathered(big, total), "big")[0], settle(gathered(small, total), "small")[0]
    hot = big.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).count().where(F.col("count") * HOT > total).select("__hot")
    hot, _ = settle(gathered(hot, min(total, HOT)), "hot")
    listed = F.broadcast(hot)
    of_hot = F.broadcast(small.join(listed, small[key] == listed["__hot"], "left_semi"))
    stay = big.join(listed, big[key] == listed["__hot"], "left_semi").join(of_hot, key, how)
    return stay.unionByName(big.join(listed, big[key] == listed["__hot"], "left_anti").join(small, key, how))


def identity(key: Column | str, text: Column | str) -> Column:
    """What tells rows apart: the key (or none) and 128 bits of hash over the text; rows alike in both are repeats."""
    return F.struct((F.col(key) if isinstance(key, str) else key).alias("key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("identity"), text).alias("h2"))


def _listed(own: Column, rows: DataFrame, total: int) -> tuple[DataFrame, Column]:
    """Identities (the one column of ``rows``) as a table to join to, broadcast if short by its count, and the condition."""
    flat = rows.toDF("_d").select(F.col("_d.key").alias("__key"), F.col("_d.h1").alias("__h1"), F.col("_d.h2").alias("__h2")).distinct()
    flat, _ = settle(gathered(flat, total), "identities")
    return (F.broadcast(flat) if flat.count() <= BROADCAST_KEYS else flat), (own["h1"] == flat["__h1"]) & (own["h2"] == flat["__h2"]) & own["key"].eqNullSafe(flat["__key"])


def without_rows(docs: DataFrame, key: str, text: str, dropped: DataFrame, total: int) -> DataFrame:
    """``docs``, of ``total`` rows, but for those whose :func:`identity` is in the one column of ``dropped``, null keys included.

    A short list stays with the texts where they are; a longer one is joined by a shuffle.
    """
    side, same = _listed(identity(docs[key], docs[text]), dropped, total)
    return docs.join(side, same, "left_anti")


def once(docs: DataFrame, key: str, text: str, repeated: DataFrame, total: int) -> DataFrame:
    """``docs``, of ``total`` rows, with one row of each :func:`identity` in the one column of ``repeated``; all other rows stay."""
    if repeated.isEmpty():
        return docs
    side, same = _listed(identity(docs[key], docs[text]), repeated, total)
    many = docs.join(side, same, "left_semi").withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit("identity"), F.col(text))})
    return docs.join(side, same, "left_anti").unionByName(many.dropDuplicates([key, "__h1", "__h2"]).drop("__h1", "__h2"))
