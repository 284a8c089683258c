"""A feed of changes, or a listing, that is handed out page by page, as a source of Spark.

A feed is a folder in which each page is a folder of Parquet files, complete once it has a _SUCCESS; pages follow one
another by name. A page's name is the token from which a reader goes on. As a stream, a reader without a checkpoint
takes none of the pages that are there, as it can't know which of them it has seen, but notes where the feed stands;
with option `from` = `beginning` it takes them too. From then on Spark's checkpoint holds the token: pages are taken
once each, also if the query fails or is stopped between. As a table, all complete pages are read. Each file of a page
is a task of its own.

    register(spark)
    spark.readStream.format("paged").option("path", folder).load()
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

#: The column that names the page of a row.
PAGE = "page"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path.removeprefix('file:')}"
    return pafs.FileSystem.from_uri(path)


@dataclass
class PageFile(InputPartition):
    page: str
    path: str


class Feed:
    """The pages of a folder."""

    def __init__(self, path: str):
        self.path = path

    def pages(self) -> list[str]:
        """Tokens of the complete pages, in order."""
        fs, root = _opened(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        names = [i.base_name for i in found if i.type == pafs.FileType.Directory and not i.base_name.startswith(("_", "."))]
        done = fs.get_file_info([f"{root}/{n}/_SUCCESS" for n in names])
        return sorted(n for n, i in zip(names, done, strict=True) if i.type == pafs.FileType.File)

    def files(self, pages: list[str]) -> list[PageFile]:
        fs, root = _opened(self.path)
        return [PageFile(p, i.path) for p in pages for i in sorted(fs.get_file_info(pafs.FileSelector(f"{root}/{p}")), key=lambda i: i.path) if i.base_name.endswith(".parquet")]

    def rows(self, file: PageFile, schema: StructType) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        wanted = [n for n in schema.names if n != PAGE]
        with fs.open_input_file(file.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=4096, columns=wanted):
                columns = [pa.array([file.page] * batch.num_rows, pa.string()) if n == PAGE else batch.column(n) for n in schema.names]
                yield pa.RecordBatch.from_arrays(columns, schema.names)


class _Table(DataSourceReader):
    def __init__(self, feed: Feed, schema: StructType):
        self.feed, self.schema = feed, schema

    def partitions(self) -> list[PageFile]:
        return self.feed.files(self.feed.pages())

    def read(self, partition: PageFile) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # there are no pages
            yield from self.feed.rows(partition, self.schema)


class _Stream(DataSourceStreamReader):
    def __init__(self, feed: Feed, schema: StructType, beginning: bool):
        self.feed, self.schema, self.beginning = feed, schema, beginning

    def _newest(self) -> dict[str, str]:
        return {"token": (self.feed.pages() or [""])[-1]}

    def initialOffset(self) -> dict[str, str]:
        return {"token": ""} if self.beginning else self._newest()

    def latestOffset(self) -> dict[str, str]:
        return self._newest()

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[PageFile]:
        return self.feed.files([p for p in self.feed.pages() if start["token"] < p <= end["token"]])

    def read(self, partition: PageFile) -> Iterator[pa.RecordBatch]:
        yield from self.feed.rows(partition, self.schema)


class Paged(DataSource):
    """The source `paged`, with options path and from."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def _feed(self) -> Feed:
        return Feed(self.options["path"])

    def schema(self) -> StructType:
        """That of the first page's first file, and the page; an empty feed has to be given one."""
        feed = self._feed()
        files = feed.files(feed.pages()[:1])
        if not files:
            raise ValueError(f"{self.options['path']} has no page yet to take the columns from")
        fs, _ = _opened(self.options["path"])
        with fs.open_input_file(files[0].path) as source:
            found = from_arrow_schema(pq.ParquetFile(source).schema_arrow)
        return StructType([*found.fields, StructField(PAGE, StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Table(self._feed(), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self._feed(), schema, self.options.get("from", "") == "beginning")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Paged)
