"""A directory of articles as a Spark data source: a folder for each category, a file for each article.

``spark.read.format("articles").load(path)`` gives a row for each file, unreadable ones included: these have no text and say in ``error`` why, so what
is dropped is counted in the same read.  Files are dealt to tasks in batches of about equal bytes.  Compressed files are read by their ending.
Paths may lie in any store that the Arrow library opens by its URI.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "category string, name string, raw_text string, error string"
#: Bytes and files of one task.
BATCH_BYTES, BATCH_FILES = 32 << 20, 10_000
#: Bytes of a file that make a row group of the output, and what a file counts for besides its bytes.
ROWS_AT_ONCE, OPEN_BYTES = 512, 4096


def decoded(content: bytes) -> str:
    """Strict UTF-8, else Latin-1; all line ends become newlines."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


@dataclass
class Batch(InputPartition):
    """Some files of one task."""

    files: list[str] = field(default_factory=list)

    def __init__(self, files: list[str]) -> None:
        super().__init__(None)
        self.files = files


class ArticleReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        if not options.get("path"):
            raise ValueError("a path must be given")
        self.uri = options["path"]
        self.most_bytes = int(options.get("batchBytes", BATCH_BYTES))

    def _store(self) -> tuple[pyarrow.fs.FileSystem, str]:
        uri = self.uri if "://" in self.uri or not self.uri.startswith("file:") else "file://" + self.uri.removeprefix("file:")
        return pyarrow.fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")

    def partitions(self) -> list[Batch]:
        """Files two levels down, in order of their paths, in batches; a path that is not there has none."""
        fs, root = self._store()
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        depth = root.rstrip("/").count("/") + 2
        files = sorted((f.path, f.size or 0) for f in found if f.type != pyarrow.fs.FileType.Directory and f.path.count("/") == depth)
        out, now, size = [], [], 0
        for path, n in files:
            if now and (size + n > self.most_bytes or len(now) >= BATCH_FILES):
                out.append(Batch(now))
                now, size = [], 0
            now.append(path)
            size += n + OPEN_BYTES
        return [*out, Batch(now)] if now else out

    def read(self, partition: Batch | None) -> Iterator[pa.RecordBatch]:
        fs, _ = self._store()
        rows: list[tuple] = []
        for path in partition.files if partition else ():  # Spark reads once where there is nothing to read
            category, name = path.rsplit("/", 2)[1:]
            try:
                with fs.open_input_stream(path, compression="detect") as f:
                    rows.append((category, name, decoded(f.read()), None))
            except (OSError, pa.ArrowException) as e:  # a file that cannot be read is a row that says so
                rows.append((category, name, None, f"{type(e).__name__}: {e}"[:500]))
            if len(rows) >= ROWS_AT_ONCE:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["category", "name", "raw_text", "error"])


class ArticleSource(DataSource):
    """The format ``articles``."""

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArticleReader:
        return ArticleReader(self.options)


def read_files(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(category, name, raw_text, error) of all files; readable ones have a text."""
    spark.dataSource.register(ArticleSource)
    return spark.read.format("articles").option("batchBytes", batch_bytes).load(path)


def dropped(files: DataFrame) -> DataFrame:
    """(category, n_files, n_unreadable), from the one read."""
    return files.groupBy("category").agg(F.count(F.lit(1)).alias("n_files"), F.count("error").alias("n_unreadable"))
