"""A Spark data source for Socrata's JSON API: pages are partitions, filters and order go to the service."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The two public tables: fixed values.
NYC = ("https://data.cityofnewyork.us", "qgea-i56i", "cmplnt_fr_dt,ofns_desc,latitude,longitude,boro_nm,law_cat_cd", "cmplnt_fr_dt")
CHICAGO = ("https://data.cityofchicago.org", "ijzp-q8t2", "date,primary_type,latitude,longitude,community_area", "date")
TIMEOUT = 30


class Page(InputPartition):
    def __init__(self, offset: int, rows: int) -> None:
        self.offset, self.rows = offset, rows


class SocrataReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.columns = options["select"].split(",")

    def partitions(self) -> list[Page]:
        limit, page = int(self.options.get("limit", 20_000)), int(self.options.get("page", 5_000))
        return [Page(at, min(page, limit - at)) for at in range(0, limit, page)]

    def url(self, page: Page) -> str:
        asked = {"$select": self.options["select"], "$limit": page.rows, "$offset": page.offset}
        asked |= {f"${k}": self.options[k] for k in ("where", "order") if self.options.get(k)}
        return f"{self.options['base']}/resource/{self.options['resource']}.json?{urlencode(asked)}"

    def read(self, page: Page) -> Iterator[tuple]:
        with urlopen(self.url(page), timeout=TIMEOUT) as answer:
            for row in json.load(answer):
                yield tuple(None if row.get(c) is None else str(row[c]) for c in self.columns)


class Socrata(DataSource):
    """Options: base, resource, select; where, order, limit, page."""

    @classmethod
    def name(cls) -> str:
        return "socrata"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in self.options["select"].split(","))

    def reader(self, schema) -> SocrataReader:
        return SocrataReader(self.options)


def where(column: str, start: str | None, end: str | None) -> str:
    tests = [f"{column} >= '{start}T00:00:00'"] * bool(start) + [f"{column} <= '{end}T23:59:59'"] * bool(end)
    return " AND ".join([*tests, "latitude IS NOT NULL", "longitude IS NOT NULL"])


def load(spark: SparkSession, table: tuple, limit: int = 20_000, start: str | None = None, end: str | None = None):
    """The raw rows of NYC or CHICAGO, latest first. Feed them to events.nyc or events.chicago."""
    base, resource, select, when = table
    spark.dataSource.register(Socrata)
    options = {"base": base, "resource": resource, "select": select, "limit": str(limit), "where": where(when, start, end), "order": f"{when} DESC"}
    return spark.read.format("socrata").options(**options).load()
