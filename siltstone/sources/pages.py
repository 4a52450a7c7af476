"""Raw pages: from a folder of HTML files, from the web, and the table of sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.config import Config


def source_table(spark: SparkSession, config: Config) -> DataFrame:
    """All configured sources, of which the last of a name counts."""
    rows = {s.name: (s.name, s.url, s.purpose, s.enabled) for s in config.sources}
    return spark.createDataFrame(list(rows.values()), schemas.SOURCES)


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.coalesce("enabled", F.lit(False)))


def read_html_folder(spark: SparkSession, path: str) -> DataFrame:
    """(source, raw_filename, html) of every ``*.html`` file below a folder."""
    files = spark.read.option("pathGlobFilter", "*.html").text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return files.select(F.regexp_extract(name, r"^(.*)\.html$", 1).alias("source"), name.alias("raw_filename"), F.col("value").alias("html"))


def http_get(url: str, timeout: float = 10.0) -> str:
    """One page; an HTTP error raises."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "siltstone"}), timeout=timeout) as response:
        return response.read().decode(response.headers.get_content_charset() or "utf-8", "replace")


def fetch_pages(sources: DataFrame, get: Callable[[str], str] = http_get) -> DataFrame:
    """Pages of the enabled sources, fetched on the executors; a failure is a row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, url in zip(batch["name"], batch["url"], strict=True):
                try:
                    rows.append((name, f"{name}.html", get(url), None))
                except Exception as error:  # noqa: BLE001  one source must not stop the others
                    rows.append((name, f"{name}.html", None, f"{type(error).__name__}: {error}"[:500]))
            yield pd.DataFrame(rows, columns=schemas.RAW.names)

    return enabled_sources(sources).select("name", "url").repartition("name").mapInPandas(run, schemas.RAW)


def extract_counts(fetched: DataFrame) -> DataFrame:
    """items_in, items_out and fetch_failures of a fetch."""
    return fetched.agg(F.count(F.lit(1)).alias("items_in"), F.count_if(F.col("error").isNull()).alias("items_out"), F.count_if(F.col("error").isNotNull()).alias("fetch_failures"))
