"""Tables written between steps, in the folder that the driver and every executor share.

Lineage is cut by writing a table and reading it again, so a lost executor costs a re-read and never a
recomputation of the whole job.  The folder is the one the cluster names in ``spark.checkpoint.dir``; only
where that is unset (a local test session) does a temporary folder stand in.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and every executor share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark)}/tidemill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, parts: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by ``parts``, its last columns, and return the table read back, with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*parts).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def read_columns(files: Sequence[str], columns: Sequence[str]) -> pa.Table:
    """Columns of some ``files`` of a written table, by URI, for a task that needs them beside its own rows."""
    found = []
    for uri in files:
        at, path = pyarrow.fs.FileSystem.from_uri(uri)
        with at.open_input_file(path) as file:
            found.append(pyarrow.parquet.ParquetFile(file).read(columns=list(columns)))
    return pa.concat_tables(found)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more; other tables stay."""
    for table in tables:
        if path := getattr(table, "scratch_path", None):
            spark = table.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete every table that this application wrote to the shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemill-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
