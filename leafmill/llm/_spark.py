"""Helpers shared by the training-data operators: shared scratch tables, global row numbers,
fixed-size bitmap filters and joins that stay even under hot keys."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bitmap filters never exceed 2**MAX_BITS bits (32 MiB), whatever the number of keys.
MAX_BITS = 28
#: A side joined by broadcast has at most this many narrow rows.
BROADCAST_ROWS = 100_000
#: A key is heavy when it holds at least one in HEAVY_SHARE rows; so there are at most HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1000

#: Rows of texts in an Arrow batch, on either side of a Python worker.
TEXT_ROWS = 500

_own_dirs: dict[str, str] = {}
#: Scratch tables that still stand, with the session that wrote them.
_standing: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session
    that leaves it unset a temporary folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own_dirs.get(app)
        if base is None:
            base = _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    return base.rstrip("/")


@atexit.register
def _tidy_up() -> None:
    """Scratch tables that results were read from are removed when the driver's process ends."""
    import shutil

    for path, spark in _standing.items():
        with contextlib.suppress(Exception):  # the session's JVM may be gone
            delete_path(spark, path)
    for path in _own_dirs.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to TEXT_ROWS: a row is a whole text, and a batch stands in memory on
    both sides of each worker. A setting that is lower already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def tidy(*caches: dict) -> None:
    """At a task's end: a worker lives on for tasks of other stages, which shouldn't find its memory taken."""
    import ctypes

    import pyarrow as pa

    for cache in caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # freed memory goes back to the system where the C library can
    if trim is not None:
        trim(0)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/leafmill-{tag}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


class Scratch:
    """Written tables in the shared folder. They cut lineage and survive lost executors.

    ``save`` writes and rereads a table; ``drop`` removes tables whose rows no later plan reads. What
    is left, since results are read from it, goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_path(self.spark, tag)
        _standing[path] = self.spark
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._leafmill_keep = self  # the id stays taken while the frame lives
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self._paths.pop(id(df), None)
            if path:
                _standing.pop(path, None)
                delete_path(self.spark, path)


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no taken one is alike whatever the case."""
    known, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in known:
            name = "_" + name
        out.append(name)
    return out


def global_row_number(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "row_number") -> DataFrame:
    """Number all rows from 0 in the given total order, without gathering them in one task.

    Range partitions are sorted and written once; each row keeps its place in its partition, and
    one row per partition carries the partition's offset. Rows that tie in ``order`` get
    consecutive numbers, in any order among themselves; they are spread by their place in the
    input, so that ties of any number don't meet in one partition. A column called ``name`` is
    replaced, all others stay.
    """
    df = df.drop(name)
    uid, place, part_, n, offset = free_names([*df.columns, name], "_uid", "_place", "_part", "_n", "_offset")
    ranked = df.withColumn(uid, F.monotonically_increasing_id())
    order = [*order, F.col(uid).asc()]
    placed = ranked.repartitionByRange(*order).sortWithinPartitions(*order).drop(uid).withColumn(place, F.monotonically_increasing_id())
    placed = scratch.save(placed, "ranged")
    part = F.shiftright(place, 33)
    sizes = placed.groupBy(part.alias(part_)).agg(F.count("*").alias(n))
    before = Window.orderBy(part_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part_, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    # one row per partition of the table: bounded by the number of partitions
    out = placed.withColumn(part_, part).join(F.broadcast(offsets), part_)
    number = F.col(offset) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), number.alias(name))


def join_small(rows: DataFrame, side: DataFrame, on: list[str] | str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``side`` by broadcast after counting that it has at most ``limit`` rows; else by shuffle."""
    return rows.join(F.broadcast(side) if side.limit(limit + 1).count() <= limit else side, on, how)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``rows`` to ``groups`` (unique ``key``; ``count`` rows each) where few groups may hold most rows.

    Groups with at least ``total / HEAVY_SHARE`` rows number HEAVY_SHARE at most and are broadcast;
    the others, none of which is large, are joined by shuffle, or by broadcast if they are few.
    """
    least = max(2, -(-total // HEAVY_SHARE))
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key, "left")
    heavy = groups.filter(F.col(count) >= least).withColumn("_heavy", F.lit(True))
    light = groups.filter(F.col(count) < least)
    met = rows.join(F.broadcast(heavy), key, "left")
    done = met.filter("_heavy").drop("_heavy")
    rest = met.filter("_heavy is null").select(*rows.columns).join(light, key, "left")
    return done.unionByName(rest.select(*done.columns))


def filter_bits(n: int, per_key: int = 16) -> int:
    """Bits of the filter's address for n keys: a power of two of at least ``per_key`` cells a key, up to MAX_BITS."""
    return max(15, min(MAX_BITS, (max(1, n) * per_key - 1).bit_length()))


def cell(key: Column, k: int, bits: int) -> Column:
    """The k-th cell of a key, 1 .. 2**bits."""
    return F.xxhash64(key, F.lit(k)).bitwiseAND(F.lit((1 << bits) - 1)) + 1


def bitmap(cells: DataFrame, column: str = "cell") -> DataFrame:
    """Pack cells in 4 KiB bitmaps, one row per bucket of 32,768 cells."""
    return cells.groupBy(F.bitmap_bucket_number(column).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(column))).alias("_bits"))


def with_membership(rows: DataFrame, key: Column, filter_: DataFrame, bits: int, name: str, hashes: int = 2) -> DataFrame:
    """Add ``name``: whether all cells of the key are set in the packed filter (at most 2**bits / 8 bytes, broadcast)."""
    out, found = rows, F.lit(True)
    for k in range(hashes):
        at = cell(key, k, bits)
        side = filter_.select(F.col("_bucket").alias(f"_bucket{k}"), F.col("_bits").alias(f"_bits{k}"))
        out = out.withColumn(f"_cell{k}", at)
        out = out.join(F.broadcast(side), F.bitmap_bucket_number(F.col(f"_cell{k}")) == F.col(f"_bucket{k}"), "left")
        place = F.bitmap_bit_position(F.col(f"_cell{k}"))
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{k}"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found & F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return out.withColumn(name, found).drop(*(f"{p}{k}" for k in range(hashes) for p in ("_cell", "_bucket", "_bits")))


def key_filter(keys: DataFrame, key: Column, n: int, hashes: int = 2) -> tuple[DataFrame, int]:
    """A packed Bloom filter of the keys and its address bits."""
    bits = filter_bits(n)
    cells = keys.select(F.explode(F.array(*(cell(key, k, bits) for k in range(hashes)))).alias("cell"))
    return bitmap(cells), bits
