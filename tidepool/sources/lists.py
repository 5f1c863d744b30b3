"""Paged lists of videos as a Spark data source, with fetching left to a function.

No network is used here: register PagedList with a fetcher of your own. A fetcher takes a page number and gives rows, or an
empty list after the last page. Which rows count is decided by filters on the DataFrame (in_scope(), pages_until_below()).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "page int, ord int, bvid string, aid long, title string, duration long, comment_counter long, play long, mid long, author string"


def paged_list(fetch: Callable[[int], list[tuple]], first: int = 1, most: int = 50, title: str = "paged_list") -> type[DataSource]:
    """A data source that reads pages first, first + 1, ... for `most` pages, each in a task of its own. An error if the last of these still has rows. fetch must be picklable."""

    class Page(InputPartition):
        def __init__(self, number: int):
            self.number = number

    class Reader(DataSourceReader):
        def partitions(self):
            return [Page(n) for n in range(first, first + most)]

        def read(self, partition) -> Iterator[tuple]:
            rows = fetch(partition.number)
            if rows and partition.number == first + most - 1:
                raise ValueError(f"{title}: page {partition.number} still has rows; raise `most`")
            for place, row in enumerate(rows):
                yield (partition.number, place, *row)

    class PagedList(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self):
            return SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    return PagedList
