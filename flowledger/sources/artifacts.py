"""Pages and artifacts: captured pages, objects under a path, and bodies to be stored."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType


def page_scan(pages: DataFrame) -> DataFrame:
    """Captured pages as (url, body, status)."""
    return pages.select("url", F.col("html").alias("body"), F.lit(200).cast("long").alias("status"))


def object_scan(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Objects under a path: (path, modificationTime, length, content). Unread columns are not loaded.

    With a ``name`` pattern the folders below the path are searched too, many of them by tasks rather than one by one.
    """
    objects = spark.read.format("binaryFile")
    if name is not None:
        objects = objects.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    return objects.load(path)


#: Bytes of the largest object whose content a scan gives as a whole; where tasks can't open objects themselves, what a cell can hold.
WHOLE, CELL = 64 << 20, (1 << 31) - (1 << 20)
#: Bytes of a larger object that a task holds at a time.
CHUNK = 8 << 20


def shared_folder(spark: SparkSession, path: str) -> bool:
    """Whether the path is in a folder that all tasks share, where they can also open objects themselves."""
    store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getUri().getScheme() == "file"


def whole_bytes(spark: SparkSession, path: str) -> int:
    """Up to which length objects under the path are read by Spark, whole."""
    return WHOLE if shared_folder(spark, path) else CELL


def _store(path: str) -> tuple[FileSystem, str]:
    """The store of an object and the path in it."""
    scheme, _, rest = path.partition(":")
    return FileSystem.from_uri(f"{scheme}:{'//' if scheme == 'file' else ''}{quote(rest)}")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, at = _store(row["path"])
            digest = hashlib.sha256()
            with store.open_input_stream(at, compression=None) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            yield pa.RecordBatch.from_pylist([row | {"digest": digest.hexdigest()}])


def write_objects(bodies: DataFrame, path: str) -> None:
    """Write the texts of (folder, value), each ended by a line feed, as one object per folder; rows of a folder are in one partition.

    For a shared folder. Tasks write the objects themselves: Spark's writer starts several processes for each, to set permissions
    of it and of its checksum. An object gets its name when it is whole, so a repeated task does no harm.
    """
    spark = bodies.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    shared = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    shared.mkdirs(folder)  # there is a folder even without objects
    root = shared.makeQualified(folder).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        rows = (row for batch in batches for row in zip(batch.column("folder").to_pylist(), batch.column("value").to_pylist(), strict=True))
        n = 0
        for folder, values in groupby(rows, lambda row: row[0]):
            store.create_dir(f"{top}/{folder}")
            begun = f"{top}/{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(begun, compression=None) as stream:
                for _, value in values:
                    stream.write((value or "").encode() + b"\n")
            store.move(begun, f"{top}/{folder}/part.txt")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    bodies.select("folder", "value").sortWithinPartitions("folder").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def object_digests(objects: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(path, length, digest) of scanned objects of any size: the SHA-256 of the content, in hexadecimal.

    Content of up to ``whole`` bytes comes from the scan. A larger object is read by one task in chunks, so neither a task's
    memory nor the two GB of a cell limit its size.
    """
    small = objects.filter(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("digest"))
    large = objects.filter(F.col("length") > whole).select("path", "length")
    return small.unionByName(large.mapInArrow(_digests, "path string, length long, digest string"))


def existing(wanted: DataFrame, listing: DataFrame, column: str = "blob_path") -> DataFrame:
    """Wanted paths that are in the listing."""
    return wanted.join(listing.select(column), column, "left_semi")


def _is_document(dtype: DataType) -> bool:
    return isinstance(dtype, (StructType, MapType, ArrayType))


def artifact_body(value: Column, dtype: DataType) -> Column:
    """Bytes to store: text and binary as they are, documents as indented JSON, absent as ``null``."""
    if isinstance(dtype, BinaryType):
        body = value
    elif isinstance(dtype, StringType):
        body = F.encode(value, "UTF-8")
    elif _is_document(dtype):
        pretty = F.to_json(value, {"pretty": "true"})
        body = F.encode(F.regexp_replace(pretty, r'(?m)^(\s*"(?:[^"\\]|\\.)*") : ', "$1: "), "UTF-8")
    else:
        body = F.encode(value.cast("string"), "UTF-8")
    return F.coalesce(body, F.encode(F.lit("null"), "UTF-8"))


def content_type(dtype: DataType) -> str:
    if isinstance(dtype, StringType):
        return "text/plain"
    return "application/json" if _is_document(dtype) else "application/octet-stream"


def artifact_uri(bucket: str, blob_path: Column) -> Column:
    return F.concat(F.lit(f"s3://{bucket}/"), blob_path)


def public_url(base: str, bucket: str, blob_path: Column) -> Column:
    return F.concat(F.lit(f"{base.strip().rstrip('/')}/{bucket}/"), blob_path)


def artifacts(rows: DataFrame, blob_path: Column, value: Column, bucket: str) -> DataFrame:
    """Bodies ready to be written: (blob_path, body, content_type, n_bytes, uri)."""
    dtype = rows.select(value.alias("v")).schema["v"].dataType
    bodies = rows.select(blob_path.alias("blob_path"), artifact_body(value, dtype).alias("body"))
    return bodies.select(
        "blob_path",
        "body",
        F.lit(content_type(dtype)).alias("content_type"),
        F.octet_length("body").cast("long").alias("n_bytes"),
        artifact_uri(bucket, F.col("blob_path")).alias("uri"),
    )


def write_artifacts(bodies: DataFrame, path: str) -> DataFrame:
    """Write the bodies from all tasks at once and give back the manifest without them."""
    bodies.write.mode("overwrite").parquet(path)
    return bodies.sparkSession.read.schema(bodies.schema).parquet(path).drop("body")
