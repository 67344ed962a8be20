"""What the operators of this subpackage share: scratch tables, text columns, tokenizer files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes between words: space and tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]"
#: Bytes of an Arrow batch on its way to Python, at most (but for one longer row).
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local, as in tests on one machine, a temporary
    folder is set and used. The folder goes when the session ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
        root = _checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/skein-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return fs.makeQualified(hadoop).toString()


def _checkpoint_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_BYTES at most: texts and sets differ in length, so a number of rows bounds no memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default; a value that the user has set stays
        spark.conf.set(name, f"{BATCH_BYTES}b")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: cuts the lineage, computes once."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents at ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that clash with ``names``, in either case."""
    clash = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps over its tasks under ``name``: one thing at a time, so operators that follow one another don't add up."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has columns of those names, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def annotate(df: DataFrame, reads: str, adds: StructType, start: Callable[[], Callable], keep: list[str] | None = None) -> DataFrame:
    """Columns ``adds`` beside those of ``df``, from column ``reads`` alone, in one pass over Arrow batches.

    Each task calls ``start()`` once for a function from a value of ``reads`` (None if null) to the
    tuple of new values. ``keep`` names the columns of ``df`` to return (all); columns of the names
    in ``adds`` give way.
    """
    small_batches(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in adds}]
    passed = list(dict.fromkeys([*kept, reads]))
    source = df.select([F.col(f"`{c}`") for c in passed])
    at, kinds = passed.index(reads), pa_types(adds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        for batch in batches:
            for part in slices(batch, at):
                rows = [one(v) for v in part.column(at).to_pylist()]
                new = [pa.array(v, kind) for v, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], names=[*kept, *adds.names])

    fields = [f for f in source.schema.fields[: len(kept)]]
    return source.mapInArrow(run, StructType([*fields, *[StructField(f.name, f.dataType, True) for f in adds]]))


def slices(batch: pa.RecordBatch, at: int, room: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose column ``at`` holds some ``room`` bytes, or one row."""
    size = batch.column(at).nbytes
    step = max(1, batch.num_rows * room // max(size, room))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def pa_types(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]
