"""The first records of many text files, at the cost of a few kilobytes of each."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of one read; more follow only while the records asked for have not ended.
CHUNK = 16 << 10
#: Files that one task opens.
FILES = 256
#: Stores that tasks can open themselves, by the scheme of a path, and the name they go by there.
STORES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
HEADS = "file_path string, length long, head string, records int, bytes_read long, second string"


def records_end(text: str, wanted: int) -> tuple[int, int]:
    """Where the ``wanted``-th record ends, quotes minded, and how many records end in ``text``.

    A line break inside quotes ends no record; -1 if fewer records end.
    """
    quoted, found = False, 0
    for at, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif c == "\n" and not quoted:
            found += 1
            if found == wanted:
                return at, found
    return -1, found


def read_head(stream, wanted: int) -> tuple[str, int, int]:
    """Text of the first ``wanted`` records, how many there are, and the bytes read for them."""
    data = b""
    while True:
        part = stream.read(CHUNK)
        data += part
        # A character cut at the end of a chunk comes with the next one.
        text = data.decode("utf-8", "ignore" if part else "replace")
        end, found = records_end(text, wanted)
        if end >= 0:
            return text[:end].rstrip("\r"), wanted, len(data)
        if not part:
            text = text.rstrip("\r\n")
            return text, min(wanted, found + 1) if text else 0, len(data)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; the path is taken literally, as Spark lists it."""
    scheme, colon, rest = path.partition(":")
    if not colon or STORES[scheme] == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(f"{STORES[scheme]}:{quote(rest)}")


def opens_directly(spark: SparkSession, folder: str) -> bool:
    """Whether tasks can open the folder's files; other stores only Spark's readers reach."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store.getUri().getScheme() in STORES


def file_heads(spark: SparkSession, folder: str, wanted: int, **listing) -> DataFrame:
    """(file_path, length, head, records, bytes_read, second) of every file that Spark lists in ``folder``.

    Spark lists the files, but no empty ones; tasks then open them, some hundred each, and read
    from the front until ``wanted`` records have ended. ``second`` is what follows the first.
    """
    files = spark.read.format("binaryFile").options(**listing).load(folder).select("path", "length")
    tasks = max(1, -(-files.count() // FILES))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for path, length in zip(batch["path"], batch["length"]):
                store, inner = store_of(path)
                with store.open_input_stream(inner, buffer_size=CHUNK) as stream:
                    head, records, size = read_head(stream, wanted)
                end, _ = records_end(head, 1)
                lines.append((path, length, head, records, size, head[end + 1:] if end >= 0 else ""))
            yield pd.DataFrame(lines, columns=[c.split()[0] for c in HEADS.split(", ")])

    return files.repartition(tasks, F.xxhash64("path")).mapInPandas(read, HEADS)
