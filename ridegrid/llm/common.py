"""Helpers shared by the text operators: staging, code shipping, hold-out split, Arrow mapping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridegrid.session import configure, ensure_checkpoint_dir, remember

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings plus this package on the executors' Python path (once per application)."""
    configure(spark)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        # The driver serves this file to the executors itself, so a driver-local folder is enough.
        path = os.path.join(tempfile.mkdtemp(prefix="ridegrid-py-"), "ridegrid_py.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("ridegrid", os.path.relpath(full, root)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back.

    Cuts the lineage, pins generated ids and survives lost executors.
    """
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = remember(f"{base}/ridegrid-llm-{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does the same on pure ASCII text and is faster there."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds`` (null id: counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def id_text(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_null: bool = False) -> DataFrame:
    """Only id and text, under fixed names; all other columns, whatever their names, go."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("doc_id"), (text if keep_null else F.coalesce(text, F.lit(""))).alias("text"))


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str, carry: list[str], rows: int = 2000,
    chars: int = 4_000_000, text_col: str = "text",
) -> DataFrame:
    """Add computed columns to ``carry`` by a Python function over bounded lists of texts.

    ``make()`` runs once per task and returns ``fn(texts) -> {column: values}``.
    At most ``rows`` texts, and no more than ``chars`` characters unless one
    text alone is longer, are handed over at a time.
    """
    spark = df.sparkSession
    fields = [df.schema[c] for c in carry]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string(schema) if spark else StructType()
    out = StructType([*fields, *extra.fields])
    arrow = to_arrow_schema(out)
    names = [f.name for f in extra.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(texts):
                end, held = begin, 0
                while end < len(texts) and end - begin < rows and (end == begin or held + sizes[end] <= chars):
                    held += int(sizes[end])
                    end += 1
                got = fn(texts.slice(begin, end - begin).to_pylist())
                cols = [batch.column(batch.schema.get_field_index(c)).slice(begin, end - begin) for c in carry]
                new = [pa.array(got[n], type=arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, *new], schema=pa.schema(
                    [pa.field(f.name, a.type) for f, a in zip(out.fields, [*cols, *new], strict=True)]))
                begin = end

    return df.select(*dict.fromkeys([*carry, text_col])).mapInArrow(run, out)


def filter_rows(df: DataFrame, make: Callable[[], Callable[[list], list]], text_col: str = "text") -> DataFrame:
    """Rows whose text ``make()(texts)`` marks true; every column passes through unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([bool(x) for x in fn(texts)], type=pa.bool_()))

    return df.mapInArrow(run, df.schema)
