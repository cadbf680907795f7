"""What the operators of this subpackage share: the shared folder, cut lineage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space as the contracts name it: \x20 and \x09 to \x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

_own_folder: list[str] = []
#: Paths of the tables that ``cut`` has written in this session and nobody has released.
_held: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs within one machine (tests, a laptop) a folder of this process is used instead."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="talentlake-"))
    return "file://" + _own_folder[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there and
    a lost executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    free_shuffles(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    _held.append(path)
    return table


def held_tables() -> list[str]:
    """The paths of all tables that ``cut`` has written and nobody has released yet."""
    return list(_held)


def release_unread(spark: SparkSession, paths: list[str], docs: DataFrame) -> list[str]:
    """Delete those of the tables at ``paths`` that ``docs`` does not read; the rest is returned."""
    read = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()} if paths else set()
    kept = [p for p in paths if p.rsplit("/", 1)[-1] in read]  # names of tables are unique, whatever the form of the path
    for path in set(paths) - set(kept):
        _delete_path(spark, path)
    return kept


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written, once all that was made of them has been written itself, and free shuffles."""
    for table in tables:
        _delete(table)
    free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Spark drops the shuffle files of plans that the driver's collector has found unused. It is asked to look where large
    ones have just become so; a session without a JVM of its own leaves them to the end of the job."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def _delete(table: DataFrame) -> None:
    _delete_path(table.sparkSession, table.cut_path)


def _delete_path(spark: SparkSession, name: str) -> None:
    if name in _held:
        _held.remove(name)
    if getattr(spark, "_jvm", None) is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII text takes the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that ``df`` does not have yet, so that no input column is shadowed."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)
    return names


def text_blocks(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20, most_rows: int = 2048, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most ``most_bytes`` of text (one row at least), which bounds a
    worker's memory whatever the size of a batch. No row is dropped."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if isinstance(col.type, pa.StructType) or not len(col):
            if len(col):
                yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def map_text(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over blocks of bounded size. Python workers also look for this package where the driver has
    it; on a cluster it is installed or shipped with ``--py-files``."""
    paths = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in paths.get("PYTHONPATH", "").split(":"):
        paths["PYTHONPATH"] = ":".join(filter(None, [paths.get("PYTHONPATH"), root]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(text_blocks(batches))

    return df.mapInArrow(run, schema)
