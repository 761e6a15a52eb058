"""Helpers that keep plans sound on skewed and very large inputs.

* ``materialise`` cuts lineage with a table in the shared folder named by
  ``spark.checkpoint.dir``, so a lost executor never replays the whole job.
* ``lookup_join`` broadcasts the small side only after its row count was
  checked, and falls back to a shuffle join that spreads hot keys over salts.
* ``sorted_slices`` range-partitions rows into equally sized sorted slices, so
  that order-dependent operators never gather one key into one task.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of a table that may be broadcast; both are checked by counting.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
# Copies of the small side when it is too large to broadcast: as many as there
# are shuffle partitions, within these bounds.
LEAST_SALTS, MOST_SALTS = 8, 1_024
# Keys that the sketch of a large side tracks and reports; one is hot with this
# many times the rows of a mean partition.
TRACKED_KEYS, HOT_KEYS, HOT_SHARE = 8_192, 512, 0.5

_made: dict[str, list[str]] = {}
_scopes = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and stream checkpoints.

    ``spark.checkpoint.dir`` names it. A local session that lacks the setting
    gets a folder of its own there, once.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        path = tempfile.mkdtemp(prefix="buslens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`scratch_dir`."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; returns how many.

    Call it once the results that read them are written. Prepared catalogues,
    stream checkpoints and whatever others keep in the same folder stay.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)
    return len(paths)


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path as its own type."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, wherever it is stored."""
    files, place = _at(spark, path)
    files.delete(place, True)


def make_folder(spark: SparkSession, path: str) -> None:
    """Make an empty folder, wherever it is stored."""
    files, place = _at(spark, path)
    files.mkdirs(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    files, place = _at(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables that this thread makes inside, but for those to keep."""
    outer = getattr(_scopes, "made", None)
    _scopes.made = []
    try:
        yield
    finally:
        known = _made.get(spark.sparkContext.applicationId, [])
        for path in _scopes.made:
            delete(spark, path)
            if path in known:
                known.remove(path)
        _scopes.made = outer


def materialise(df: DataFrame, label: str = "table", keep: bool = False, outlives: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    ``drop_scratch`` removes the table unless it is to ``keep``; one that
    ``outlives`` its ``scratch_scope`` stays when that ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    if not keep:
        _made.setdefault(spark.sparkContext.applicationId, []).append(path)
        if not outlives and getattr(_scopes, "made", None) is not None:
            _scopes.made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is within both bounds; reads at most one row beyond them.

    Bytes are those of the rows as JSON text, a measure that also sees long
    strings, arrays and maps.
    """
    size = F.length(F.to_json(F.struct("*"))).cast("bigint")
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    return found.rows <= max_rows and (found.bytes or 0) <= max_bytes


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    small_fits: bool | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join a large table with a lookup table without moving hot keys.

    A checked small side is broadcast and ``big`` is not shuffled. A larger one
    is joined by (key, salt): a sketch over the keys of ``big`` finds the hot ones,
    only their rows are salted, and only they are copied once per salt. The salt
    is a hash of the row, so a task that runs again deals its rows out as before.
    A stream has no keys to look at beforehand, so there all keys are salted.
    ``null_safe`` lets null keys match each other.
    """
    fits = fits_broadcast(small, max_rows) if small_fits is None else small_fits
    if null_safe:
        renamed = {key: f"_r_{key}" for key in on}
        small = small.withColumnsRenamed(renamed)
        same = all_of([F.col(key).eqNullSafe(F.col(other)) for key, other in renamed.items()])
        if fits:
            return big.join(F.broadcast(small), same, how).drop(*renamed.values())
    elif fits:
        return big.join(F.broadcast(small), on, how)
    salts = min(MOST_SALTS, max(LEAST_SALTS, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = None if big.isStreaming else hot_keys(big, on, salts)
    spread = _copies(small, [renamed[key] for key in on] if null_safe else on, hot, salts)
    salt = F.pmod(row_hash(big), F.lit(salts)).cast("int")
    salted = big.withColumn("_salt", salt if hot is None else F.when(_key_hash(on).isin(hot), salt).otherwise(F.lit(0)))
    if null_safe:
        spread = spread.withColumnRenamed("_salt", "_r_salt")
        same = same & (F.col("_salt") == F.col("_r_salt"))
        return salted.join(spread, same, how).drop("_salt", "_r_salt", *renamed.values())
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def _key_hash(on: list[str]) -> Column:
    # Nulls do not change a hash, so they are marked.
    return F.xxhash64(*on, *[F.col(key).isNull() for key in on])


def hot_keys(big: DataFrame, on: list[str], partitions: int) -> list[int]:
    """Hashes of the keys that hold a large part of a partition's share of the rows, by a sketch of bounded size."""
    sketch = F.call_function("approx_top_k", _key_hash(on), F.lit(HOT_KEYS), F.lit(TRACKED_KEYS))
    found = big.agg(F.count(F.lit(1)).alias("rows"), sketch.alias("keys")).first()
    least = HOT_SHARE * found.rows / partitions
    return [key.item for key in found.keys or [] if key["count"] > least]


def _copies(small: DataFrame, on: list[str], hot: list[int] | None, salts: int) -> DataFrame:
    """The small side with ``_salt``: each row of a hot key once per salt, all others once."""
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return small.withColumn("_salt", F.explode(every if hot is None else F.when(_key_hash(on).isin(hot), every).otherwise(F.array(F.lit(0)))))


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, the same when a task runs again."""
    return F.xxhash64(*[F.col(_quoted(f.name)) for f in df.schema if not _holds_map(f.dataType)])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _holds_map(kind: T.DataType) -> bool:
    """Maps have no hash."""
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType | T.VariantType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def sorted_slices(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Materialise ``df`` sorted by keys and order, in balanced slices.

    Adds ``_slice`` (number of the sorted slice) and ``_pos`` (global position,
    rising over the whole table). A range partitioning on keys *and* order
    splits a hot key over many slices; ``_tie`` also splits equal rows. The
    result is written out because positions must not change between the jobs
    that read them. Their number follows ``spark.sql.shuffle.partitions``.

    ``_tie`` repeats on a retried task when the input is a scan or narrow on
    one. If copies of one row may come out of a shuffle, ``materialise`` first.
    """
    by = [*keys, *order, "_tie"]
    return materialise(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_tie")
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id()),
        "slices",
    )


def all_of(conditions: list[Column]) -> Column:
    """Conjunction of conditions; true when there is none."""
    return reduce(Column.__and__, conditions) if conditions else F.lit(True)


def any_of(conditions: list[Column]) -> Column:
    """Disjunction of conditions; false when there is none."""
    return reduce(Column.__or__, conditions) if conditions else F.lit(False)
