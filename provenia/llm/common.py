"""What the operators share: scratch tables, Arrow passes over text, small helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java, RE2 and Python character class.
SPACE = r"[\x20\x09-\x0D]"
#: Rows turned into Python objects at a time; Spark bounds the bytes of a batch.
SLICE_ROWS = 50
_LOCAL: dict[str, str] = {}
_KEPT: set[Callable] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor reaches; it goes with the session's process.

    The setting is read from the session; only where it is unset (tests, notebooks in
    local mode) does a temporary folder of this machine stand in.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="provenia-"))
    own = f"{root.rstrip('/')}/provenia/{app}"
    if own not in _LOCAL:
        _LOCAL[own] = own
        atexit.register(_delete, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped already
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, narrow: bool = False, few: bool = False) -> DataFrame:
    """df written once as Parquet in the shared folder and read back.

    It ends the lineage: what follows survives lost executors without computing df again.
    narrow: rows of a few bytes, made where wide ones are read; they are dealt anew into
    files of the advisory size rather than one small file for each task that reads.
    few: the same, and written as one file a core at most, however many partitions a
    shuffle has. On a local disk without Hadoop's native library each file costs the
    executor several processes (chmod).
    """
    spark = df.sparkSession
    if narrow or few:
        df = df.hint("rebalance")
    if few:
        df = df.coalesce(spark.sparkContext.defaultParallelism)
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _give_back() -> None:
    """Return free memory of Arrow's pool and, with glibc, of the heap to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def turn_to(cache: Callable | None) -> None:
    """Say which functools cache the pass that begins in this Python worker keeps between its tasks; those of other passes are emptied.

    What they held goes back to the system: a worker lives on through all stages beside its executor.
    """
    if others := _KEPT - {cache}:
        for other in others:
            other.cache_clear()
        _give_back()
    _KEPT.clear()
    if cache is not None:
        _KEPT.add(cache)


def text_pass(
    df: DataFrame,
    make: Callable[[], Callable[[list], list]],
    out: str,
    text: Column | str = "text",
    carry: list[str] | None = None,
    binary: bool = True,
    shown: bool = True,
    keeps: Callable | None = None,
) -> DataFrame:
    """One Arrow pass over a text column.

    make() runs once in each task and returns f(texts) -> list of dicts (None drops the
    row); out is the DDL of these dicts. The columns named in carry (None: all of df)
    stay in front. Null texts arrive as empty ones, as bytes or, if binary is false, str.
    Carried columns travel in a struct, so that no name of theirs can clash with ours;
    with shown false they alone come back, for passes that only drop rows. keeps is the
    cache that the pass leaves in its Python workers, if any; see turn_to().
    """
    from pyspark.sql.types import StructType

    names = df.columns if carry is None else carry
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), (body.cast("binary") if binary else body.cast("string")).alias("text"))
    fields = StructType.fromDDL(out)
    schema = StructType().add(source.schema["row"]).add("out", fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        turn_to(keeps)
        f, kind = make(), to_arrow_type(fields)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                got = f(part.column(1).to_pylist())
                row = part.column(0)
                if any(x is None for x in got):
                    row, got = row.filter(pa.array([x is not None for x in got])), [x for x in got if x is not None]
                if got:
                    yield pa.RecordBatch.from_arrays([row, pa.array(got, kind)], names=["row", "out"])

    done = source.mapInArrow(run, schema)
    return done.select(*[F.col(f"row.`{c}`") for c in names], *[F.col(f"out.`{f.name}`") for f in fields if shown])


def join_splittable(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left joined with right, which has one row for each key, where left may be skewed.

    A second key, derived from the first, makes Spark deal out both sides for this join
    even where right is already dealt by key, so that adaptive execution can split the
    partitions of a hot key.
    """
    twin = F.pmod(F.hash(F.col(key)), F.lit(2))
    return left.withColumn("_twin", twin).join(right.withColumn("_twin", twin), [key, "_twin"], how).drop("_twin")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
