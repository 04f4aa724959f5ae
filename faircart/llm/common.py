"""Helpers shared by the corpus operators: tables, materialisation, row text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Set once per process where the session names no shared folder (tests, local runs).
_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one on a single machine and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="faircart-"))
    return _LOCAL[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files every executor can reach, so a lost executor costs
    only its running tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later plan reads."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def held_fold(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def give_back() -> None:
    """Hand what this process has freed back to the system, Arrow's memory and that of the C library."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def trimmed(run):
    """``run`` for ``mapInArrow`` that gives memory back behind its last batch, as workers outlive their tasks and stages."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def map_arrow(df: DataFrame, run, more: list[tuple[str, str]]) -> DataFrame:
    """``df.mapInArrow(run, ...)`` for ``run`` that adds columns ``more`` of names and DDL types to those of ``df``.

    Columns go by number inside, as Spark's own lookup of them stops at names with dots. Batches that ``run`` gives are read by
    position.
    """
    import pyarrow as pa
    from pyspark.sql.types import DataType, StructField, StructType

    names = [*df.columns, *(n for n, _ in more)]
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    kinds = [*(f.dataType for f in plain.schema), *(DataType.fromDDL(kind) for _, kind in more)]
    numbered = [f"c{i}" for i in range(len(kinds))]
    schema = StructType([StructField(n, k) for n, k in zip(numbered, kinds, strict=True)])

    def by_number(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=numbered)

    return plain.mapInArrow(trimmed(by_number), schema).toDF(*names)


def add_arrow_column(df: DataFrame, source: str, name: str, kind: str, make) -> DataFrame:
    """``df`` with one more column ``name`` of DDL type ``kind``, made from ``source`` in Arrow batches.

    ``make()`` runs once a task and gives a function from an Arrow array of values to a list of
    values. No shuffle; all other columns, of any name, pass through as they are. ``name`` must be free.
    """
    import pyarrow as pa
    from pyspark.sql.types import DataType

    at, wanted = df.columns.index(source), DataType.fromDDL(kind)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        fill, arrow = make(), to_arrow_type(wanted)
        for b in batches:
            more = pa.array(fill(b.column(at)), arrow)
            yield pa.RecordBatch.from_arrays([*b.columns, more], names=[*b.schema.names, "new"])

    return map_arrow(df, run, [(name, kind)])


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores added until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
