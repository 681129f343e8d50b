"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: What separates words, and a word.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handed to Python at once, in bytes; one longer text is handled alone.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in a local session without one, a
    folder that lasts as long as the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="docmill-llm-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: a lost executor costs no more than its tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def learn_fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts


def n_words(text: str | Column) -> Column:
    """Words of a text; null has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def per_text(
    df: DataFrame,
    text: str,
    keep: list[str],
    fields: T.StructType,
    start: Callable[[], Callable[[list], dict]],
) -> DataFrame:
    """Rows with ``keep`` and computed columns. ``start`` runs once per task and gives the
    function that turns a list of texts (with nulls) into lists of values by field."""
    kept = [df.schema[c] for c in keep]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in slices(batch, "text__"):
                got = work(part.column("text__").to_pylist())
                new = [pa.array(got[f.name], kind) for f, kind in zip(fields, kinds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(kept))] + new,
                    names=[f.name for f in kept] + [f.name for f in fields],
                )

    chosen = [F.col(f"`{c}`") for c in keep] + [F.col(f"`{text}`").alias("text__")]
    return df.select(*chosen).mapInArrow(run, T.StructType(kept + list(fields)))
