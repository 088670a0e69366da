"""Shared-folder tables that cut lineage.

Intermediate tables go to the folder the session names in ``spark.checkpoint.dir``,
which the driver and all executors can reach.  Only when that setting is absent and all
threads are on one machine (a ``local`` master, as in unit tests) a temporary folder is used instead.
"""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from itertools import accumulate

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.unions import union

_ROOTS: dict[str, str] = {}
#: Places of tables that are still there and that ``release`` may remove, with their names in the catalog.
_SCRATCH: dict[str, str | None] = {}
#: A key is hot when it has more than this part of all rows; so there are fewer hot keys than HOT_KEYS.
HOT_KEYS = 4096
#: Rows of a file of a table whose size is known, and the fewest files.
FILE_ROWS, LEAST_FILES = 100_000, 24
#: Nodes of a plan under which every row is a row of a stored file.
_PLAIN = {"Project", "Filter", "SubqueryAlias", "View"}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one when none is configured and the master is one machine; else ValueError."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    return _ROOTS[app]


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of 8 MB rather than Spark's 64 MB, for the whole session, so that several workers fit an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table of this module once no plan reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, path: str, name: str | None) -> None:
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, path)


def new_path(spark: SparkSession, tag: str, lasting: bool = False, name: str | None = None) -> str:
    """A fresh path below the shared folder; it is removed, with the table ``name`` of the catalog, when the driver ends, or by
    ``release`` unless ``lasting``."""
    path = f"{shared_dir(spark)}/quillstone/{tag}-{uuid.uuid4().hex}"
    if not lasting:
        _SCRATCH[path] = name

    def remove() -> None:
        try:
            _forget(spark, path, name)
        except Exception:  # the session or its JVM may already be gone at exit
            pass

    atexit.register(remove)
    return path


def release(spark: SparkSession) -> None:
    """Remove all tables that operators have left so far; no plan may read them any more."""
    for path in list(_SCRATCH):
        _forget(spark, path, _SCRATCH.pop(path, None))


class Table:
    """A materialised DataFrame together with its place."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self._spark, self.path, self.schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return self._spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _SCRATCH.pop(self.path, None)
        delete(self._spark, self.path)


def write_table(df: DataFrame, tag: str, lasting: bool = False, rows: int | None = None) -> Table:
    """Write ``df`` to the shared folder as Parquet and return the table.

    Of a table of at most ``rows`` rows, where they are known, many small partitions make few files; a large one keeps its partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, tag, lasting)
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, math.ceil(rows / FILE_ROWS)))
    df.write.option("compression", "snappy").parquet(path)
    return Table(spark, path, df.schema)


class BucketedTable(Table):
    """A table whose files are dealt by a key, so that grouping by the key needs no shuffle."""

    def __init__(self, spark: SparkSession, path: str, schema, name: str) -> None:
        super().__init__(spark, path, schema)
        self.name = name

    @property
    def df(self) -> DataFrame:
        return self._spark.table(self.name)

    def drop(self) -> None:
        self._spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        super().drop()


def write_bucketed(df: DataFrame, tag: str, key: str) -> BucketedTable:
    """Write ``df`` to the shared folder in as many buckets by ``key`` as there are shuffle partitions."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}".replace("-", "_")
    path = new_path(spark, tag, name=name)
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.option("compression", "snappy").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return BucketedTable(spark, path, df.schema, name)


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back without its lineage."""
    return write_table(df, tag, rows=rows).df


def _scans_rows_once(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of a stored file, and no file is listed twice."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in _PLAIN:
        node = node.children().head()
    if node.getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        paths = node.relation().location().rootPaths()
    except Exception:  # a relation without files
        return False
    return paths.distinct().size() == paths.size()


def identified(df: DataFrame, name: str = "_uid") -> DataFrame:
    """``df`` with the identity of each row in ``name``: a struct of two hashes of its file's path and its place in that file.

    It is the same in every scan, however the files are split over tasks.  Rows that don't come straight from
    stored files are stored first; a column of that name is replaced.
    """
    path, columns = F.col("_metadata.file_path"), [F.col(f"`{c}`") for c in df.columns if c != name]
    uid = F.struct(F.xxhash64(path).alias("a"), F.xxhash64(F.lit(1), path).alias("b"), F.col("_metadata.row_index").alias("row")).alias(name)
    if _scans_rows_once(df):
        try:
            return df.select(*columns, uid)
        except AnalysisException:  # a format without row numbers
            pass
    return materialize(df, "rows").select(*columns, uid)


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], uses: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keys``: a stored table with one row a key (not null), whose column ``uses`` is the key's number of rows.

    Keys with more than a HOT_KEYS-th of the ``total`` rows, fewer than HOT_KEYS by definition, are broadcast, so their rows stay
    where they are; the rest is shuffled, and no key of it has more rows than that.
    """
    least = max(1, total // HOT_KEYS)
    hot = F.broadcast(keys.filter(F.col(uses) > least))
    cold = rows.join(hot.select(*on), on, "left_anti").join(keys.filter(F.col(uses) <= least), on)
    return union(rows.join(hot, on), cold)


def ranked(df: DataFrame, keys: list[str], tag: str, name: str = "name", sums: tuple[str, ...] = (), rows: int | None = None) -> tuple[Table, dict[str, int]]:
    """``df`` with its rows numbered from 0 in the order of ``keys`` over the whole table, and its count (``rows``) and ``sums``.

    The numbers depend on the rows only.  The driver gets one row a partition.
    """
    spark = df.sparkSession
    place, part = F.col("_place"), F.shiftright("_place", 33)
    sorted_ = write_table(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()), tag, rows=rows)
    parts = sorted_.df.groupBy(part.alias("_part")).agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in sums]).collect()
    parts.sort(key=lambda r: r["_part"])
    starts = list(accumulate((p["rows"] for p in parts), initial=0))
    at = starts.pop()
    first = F.broadcast(spark.createDataFrame(pa.table([pa.array([p["_part"] for p in parts], pa.int64()), pa.array(starts, pa.int64())], names=["_part", "_start"])))
    numbered = sorted_.df.withColumn("_part", part).join(first, "_part").withColumn(name, F.col("_start") + place.bitwiseAND(F.lit((1 << 33) - 1)))
    out = _Derived(sorted_, numbered.drop("_part", "_start", "_place"))
    return out, {"rows": at} | {c: sum(p[c] for p in parts) for c in sums}


class _Derived(Table):
    """A table with columns that are worked out where it is read."""

    def __init__(self, table: Table, df: DataFrame) -> None:
        super().__init__(table._spark, table.path, df.schema)
        self._df = df

    @property
    def df(self) -> DataFrame:
        return self._df
