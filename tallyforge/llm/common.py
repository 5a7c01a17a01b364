"""Helpers shared by the training-data operators: tables, the shared folder, words, grouped streams."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.shipping import ship

#: White space that separates words: U+0020 and U+0009 to U+000D.
SPACES = "\t\n\x0b\x0c\r "
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters at which str.split() cuts and WORD does not.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

_own_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def literals(values, kind: str) -> Column:
    """An array column of the values, folded to one literal by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def words_of(text: str) -> list[str]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores before it until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    Where that setting is missing, a local folder serves local mode only; on a
    cluster its absence is an error, because executors could not see the files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="tallyforge-")
        base = _own_folders[app]
    folder = f"{base.rstrip('/')}/tallyforge-{app}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


_cleaned: set[str] = set()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes the application's folder when the driver's Python ends, as far as Spark still answers."""
    try:
        delete(spark, folder)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths that staged() wrote, in order.
_written: list[str] = []


def finished(df: DataFrame, name: str, since: int) -> DataFrame:
    """``staged``, after which what was staged from place ``since`` of ``n_staged()`` on is deleted: the result no longer needs it."""
    held = staged(df, name)
    for path in _written[since:-1]:
        delete(df.sparkSession, path)
    del _written[since:-1]
    return held


def n_staged() -> int:
    return len(_written)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    It cuts the lineage: what follows reads files that survive lost executors
    instead of running the plan again.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches_of(rows: Iterable[tuple], schema, *, rows_at_once: int = 2000, bytes_at_once: int = 8 << 20) -> Iterator:
    """Arrow batches of the rows' tuples; a batch closes by count or by the size of its strings and lists."""
    import pyarrow as pa

    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
        if len(held) >= rows_at_once or size >= bytes_at_once:
            yield _batch(pa, held, schema)
            held, size = [], 0
    if held:
        yield _batch(pa, held, schema)


def _batch(pa, rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def rows_of(batches, columns: list[str] | None = None, *, at_once: int = 256) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, turned into Python objects a few at a time."""
    for batch in batches:
        names = columns or batch.schema.names
        for start in range(0, batch.num_rows, at_once):
            part = batch.slice(start, at_once)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string with plain types."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    fields = [x.strip().rsplit(" ", 1) for x in ddl.split(",")]
    return pa.schema([pa.field(n, kinds[k]) for n, k in fields])


def map_rows(df: DataFrame, function, ddl: str, **limits) -> DataFrame:
    """``mapInArrow`` for a function from an iterator of row tuples to an iterator of row tuples."""

    def run(batches):
        return batches_of(function(rows_of(batches)), arrow_schema(ddl), **limits)

    return map_arrow(df, run, ddl)


#: Smaller Arrow batches than Spark's own, which hold ten thousand texts: (setting, Spark's value, ours). They become settings of the session,
#: because a plan reads them when it runs; other values that the session has stay.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"))


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow``, with this package brought to the workers, in batches that leave tasks little to hold."""
    spark = df.sparkSession
    ship(spark)
    for setting, usual, ours in BATCHES:
        if spark.conf.get(setting) == usual:
            spark.conf.set(setting, ours)
    return df.mapInArrow(function, schema)


def map_grouped(df: DataFrame, keys: list[str], function, schema=None) -> DataFrame:
    """``applyInArrow`` for a function from a group's table to a table (of the same columns, if no schema is given), with this package brought to the workers."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(function, schema or df.schema)
