"""What the operators of this package share: table reads, the shared work folder, tables that cut the lineage and their removal."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables that go with each open :func:`scratch` block, the innermost last.
_MADE: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("made", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``).

    Where it is unset, a temporary one of our own, which only a local master can read; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; it outlives the :func:`scratch` block around it.

    It goes with the next block further out; without one it stays. This cuts the lineage and survives a lost executor: what was
    written need not be computed again.
    """
    return _written(df, name, 2)


def _written(df: DataFrame, name: str, depth: int) -> DataFrame:
    """Write ``df`` and read it back; it goes with the ``depth``-th block from inside, if so many are open."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    if len(_MADE.get()) >= depth:
        _MADE.get()[-depth].append(out)
    return out


def cut(df: DataFrame, name: str) -> DataFrame:
    """:func:`keep`, but only until the :func:`scratch` block around it ends."""
    return _written(df, name, 1)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs.

    It does so once the driver's garbage collection finds the plans that made them, which may take half an hour; asking for it
    keeps the disks of long jobs from filling up with shuffles that nobody reads.
    """
    spark._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Remove what :func:`cut` or :func:`keep` wrote, once nothing reads it any more, and the shuffles of finished jobs."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._factloom_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        for made in _MADE.get():
            made[:] = [m for m in made if m is not df]
    if tables:
        free_shuffles(tables[0].sparkSession)


@contextmanager
def scratch():
    """Tables that are :func:`cut` within the block, or kept by a block in it, are removed at its end; its result must be kept."""
    token = _MADE.set((*_MADE.get(), []))
    try:
        yield
    finally:
        drop(*_MADE.get()[-1])
        _MADE.reset(token)


def with_columns(schema, *fields: str):
    """A DDL-style schema with columns added, for mapInArrow."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType(list(schema.fields) + list(_parse_datatype_string(", ".join(fields)).fields))


def add_struct(df: DataFrame, name: str, ddl: str, compute, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add a struct column that Python computes from the whole text of each row.

    ``compute`` is called once for each Arrow batch with an iterator of UTF-8 bytes (None for null) and yields one tuple
    for each row. ``keep`` names the columns that stay (all by default); a column called ``name`` is replaced.
    Nothing is shuffled, and a batch is the most that a worker holds.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kept = [c for c in (keep if keep is not None else df.columns) if c != name]
    read = df.select(*[f"`{c}`" for c in kept], *([] if text in kept else [f"`{text}`"]))
    struct = _parse_datatype_string(ddl)
    schema = StructType([*read.select(*[f"`{c}`" for c in kept]).schema.fields, StructField(name, struct)])

    def run(batches):
        kinds = [to_arrow_type(f.dataType) for f in struct.fields]
        for batch in batches:
            texts = batch.column(read_at).cast(pa.binary())
            rows = list(compute(x.as_py() for x in texts))
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            added = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=struct.names)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), added], names=[*kept, name])

    read_at = read.columns.index(text)
    return read.mapInArrow(run, schema)
