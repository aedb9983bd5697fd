"""Article corpora: zip archives and folders of text files, checked against a roster."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.words import url_decoded


def load_zip(spark: SparkSession, path: str) -> DataFrame:
    """``(id, text)`` of the ``.txt`` members of zip archives; ids are the percent-decoded stems, README.txt is skipped.

    One task opens an archive and streams its members; other members raise.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        stem = name.rsplit("/", 1)[-1]
                        if name.endswith("/") or stem == "README.txt":
                            continue
                        if not stem.endswith(".txt"):
                            raise ValueError(f"{name} is no .txt member")
                        yield pd.DataFrame({"id": [unquote(stem[:-4])], "text": [archive.read(name).decode("utf-8-sig")]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id string, text string")


def load_folder(spark: SparkSession, path: str) -> DataFrame:
    """``(id, text)`` of a folder's ``.txt`` files."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("name"), "value").where("name <> 'README.txt'")
    return files.select(url_decoded(F.regexp_replace(url_decoded(F.col("name")), r"\.txt$", "")).alias("id"), F.regexp_replace("value", "^\\ufeff", "").alias("text"))


def check_corpus(docs: DataFrame, nodes: DataFrame) -> None:
    """Raises unless the corpus holds each roster id once and nothing else."""
    repeated = docs.groupBy("id").count().where("count > 1").select("id")
    missing = nodes.select("id").join(docs.select("id"), "id", "left_anti")
    strange = docs.select("id").join(nodes.select("id"), "id", "left_anti")
    for found, what in ((repeated, "repeated"), (missing, "missing"), (strange, "unknown")):
        ids = [str(r.id) for r in found.limit(10).collect()]
        if ids:
            raise ValueError(f"{what} documents: {', '.join(ids)}")
