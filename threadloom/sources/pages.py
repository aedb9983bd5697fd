"""A batch data source over a paginated listing service, for link snapshots of page categories."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(endpoint: str, query: dict, tries: int = 3, wait: float = 1.0, get: Callable | None = None) -> dict:
    """One request, tried ``tries`` times with a pause that grows by ``wait`` each time."""
    get = get or (lambda url: urllib.request.urlopen(url, timeout=30).read())
    for attempt in range(1, tries + 1):
        try:
            return json.loads(get(f"{endpoint}?{urllib.parse.urlencode(query)}"))
        except Exception:
            if attempt == tries:
                raise
            time.sleep(wait * attempt)
    raise AssertionError


def members(endpoint: str, category: str, get: Callable | None = None) -> Iterator[str]:
    """Titles of a category's articles, following continuation marks; lists are left out."""
    query = {"action": "query", "format": "json", "list": "categorymembers", "cmtitle": category, "cmnamespace": "0", "cmlimit": "500"}
    while True:
        answer = fetch(endpoint, query, get=get)
        for row in answer["query"]["categorymembers"]:
            if row["ns"] == 0 and not row["title"].startswith("List of"):
                yield row["title"]
        if "continue" not in answer:
            return
        query = query | answer["continue"]


class CategoryReader(DataSourceReader):
    """One partition per category."""

    def __init__(self, options: dict):
        self.endpoint = options["endpoint"]
        self.categories = options["categories"].split("|")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.categories]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for title in members(self.endpoint, partition.value):
            yield (partition.value, title)


class CategorySource(DataSource):
    """``spark.read.format("category_pages").option("endpoint", ...).option("categories", "A|B").load()``."""

    @classmethod
    def name(cls) -> str:
        return "category_pages"

    def schema(self) -> str:
        return "category string, title string"

    def reader(self, schema) -> CategoryReader:
        return CategoryReader(self.options)
