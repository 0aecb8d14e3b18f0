"""Files of any size, folders of part files included: listed by Spark, digested in tasks, counted row by row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_stream(path: str) -> BinaryIO:
    """A stream of bytes from a path as Spark lists it, by pyarrow's file systems (local, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    system, at = fs.FileSystem.from_uri(quote(path, safe="/:@?=&"))
    return system.open_input_stream(at)


@dataclass(frozen=True)
class DigestSettings:
    #: Files up to this many bytes are read by Spark itself, whole, from whatever store it reads.
    whole: int = 32_000_000
    #: Bytes of a larger file that its task holds at a time.
    chunk: int = 8_000_000
    #: Opens a larger file in a task; another one serves stores that pyarrow doesn't know.
    opener: Callable[[str], BinaryIO] = open_stream


def listed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes) of the files under ``path``, folders in it included. Names that begin with a dot or an underscore are
    left out, and so are empty files, as by all of Spark's readers. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"))


def stream_digest(path: str, s: DigestSettings = DigestSettings()) -> tuple[int, str]:
    """Bytes and sha256 of a file, of which a chunk is held at a time."""
    n, sha = 0, hashlib.sha256()
    with s.opener(path) as f:
        while chunk := f.read(s.chunk):
            n += len(chunk)
            sha.update(chunk)
    return n, sha.hexdigest()


def digests(spark: SparkSession, path: str, glob: str = "*", s: DigestSettings = DigestSettings()) -> DataFrame:
    """(path, bytes, sha256) of the files that ``listed`` gives.

    Spark deals files to tasks by their sizes. A larger file is streamed by its task, so its size doesn't matter to memory;
    ``bytes`` is what was read of it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    whole = files.filter(F.col("length") <= s.whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("path").to_pylist():
                n, sha = stream_digest(p, s)
                yield pa.RecordBatch.from_pydict({"path": [p], "bytes": [n], "sha256": [sha]})

    large = files.filter(F.col("length") > s.whole).select("path").mapInArrow(run, "path string, bytes long, sha256 string")
    return whole.unionByName(large)


def folder_digests(files: DataFrame) -> DataFrame:
    """(folder, n_files, bytes, digest) from (path, bytes, sha256): a table's part files as one. The digest is the sum of a
    hash a file of its name and content, so a folder of any number of files is added up before it is shuffled."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.expr("substring(path, 1, length(path) - length(element_at(split(path, '/'), -1)) - 1)")
    return files.groupBy(folder.alias("folder")).agg(
        F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.sum(F.xxhash64(name, "sha256").cast("decimal(20,0)")).cast("string").alias("digest")
    )


def file_rows(table: DataFrame) -> DataFrame:
    """(path, n, digest) a file of a table just read: its rows and the sum of their hashes. A file is split over tasks as in
    any scan. A file without rows isn't listed; ``listed`` has it."""
    hashed = table.select(F.col("_metadata.file_path").alias("path"), F.xxhash64(*[F.col(f"`{c}`") for c in table.columns]).cast("decimal(20,0)").alias("hash"))
    return hashed.groupBy("path").agg(F.count("*").alias("n"), F.sum("hash").cast("string").alias("digest"))
