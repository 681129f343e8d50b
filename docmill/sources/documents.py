"""Document files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.gate import file_extension, guess_mime
from docmill.operators.source_text import from_content

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All files below a path: metadata, ``content``, guessed ``mime_type``.

    Filters on length and time reach the scan; ``content`` is read only if used.
    Spark's file sources give no row for a file of zero bytes, so empty uploads
    show up only in tables of upload metadata.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return with_file_columns(reader.load(path))


#: What readers of lines leave out at the start of a file.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, bytes, md5) of files whose lines come one after another: path, size, line."""
    path = None

    def ended() -> pa.RecordBatch:
        left = size - read
        if left not in (0, 1, 3, 4):
            raise ValueError(f"{path}: {read} of {size} bytes were read")
        digest = marked if left > 1 else plain
        if left in (1, 4):
            digest.update(b"\n")
        return pa.RecordBatch.from_arrays(
            [pa.array([path]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])],
            names=["path", "bytes", "md5"],
        )

    for batch in batches:
        paths, sizes, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        at = 0
        while at < len(paths):
            end = at + 1
            while end < len(paths) and paths[end] == paths[at]:
                end += 1
            part = b"\n".join(lines[at:end])
            if paths[at] != path:
                if path is not None:
                    yield ended()
                path, size, read = paths[at], sizes[at], 0
                plain, marked = hashlib.md5(), hashlib.md5(BYTE_ORDER_MARK)
            else:
                part = b"\n" + part
            plain.update(part)
            marked.update(part)
            read += len(part)
            at = end
    if path is not None:
        yield ended()


def with_digest(files: DataFrame, spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files of ``scan_files`` with ``bytes`` and ``md5`` of what they hold, however large they are.

    A file is read in pieces that end at line feeds, by several tasks, and its digest goes over
    them in their order; no task holds more than some pieces. Files are not unpacked, so their
    names must not end like those of packed ones.
    """
    reader = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.load(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("line"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"),
    )
    dealt = lines.repartition("path").sortWithinPartitions("path", "start", "n").select("path", "size", "line")
    found = dealt.mapInArrow(_digests, "path string, bytes bigint, md5 string").withColumnRenamed("path", "_path")
    known = files.withColumn("_file", F.col("_metadata.file_path")).join(found, F.col("_file") == F.col("_path"), "left")
    # A file of bytes and without a line is the mark alone.
    return known.withColumns(
        {
            "bytes": F.coalesce("bytes", "length"),
            "md5": F.coalesce("md5", F.lit(hashlib.md5(BYTE_ORDER_MARK).hexdigest())),
        }
    ).drop("_file", "_path")


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as they arrive in a landing directory."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    return with_file_columns(reader.load(path))


def with_file_columns(files: DataFrame, default_mime: str = "text/plain") -> DataFrame:
    return files.withColumns(
        {
            "mime_type": guess_mime(F.col("path"), default_mime),
            "is_text_type": file_extension(F.col("path")) == ".txt",
        }
    )


def with_job_id(files: DataFrame) -> DataFrame:
    """A stable id for a file version, so that a replayed batch gives the same ids."""
    stamp = F.unix_micros("modificationTime").cast("string")
    return files.withColumn("job_id", F.sha2(F.concat_ws("|", "path", stamp), 256))


def attach_content(names: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Documents named in a table with their text; '' where there is no such file."""
    return from_content(names.join(files.select(path, "content"), path, "left"))
