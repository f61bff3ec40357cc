"""Web services that answer with pages of JSON rows, as a Python data source: pages are partitions that tasks fetch."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from urllib.parse import urljoin
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

#: Where a service's answer holds its rows, and the address of the page after it.
KINDS = {
    "web": ("", ""),
    "odata": ("value", "@odata.nextLink"),
    "dataverse": ("value", "@odata.nextLink"),
    "sharepoint": ("value", "@odata.nextLink"),
    "salesforce": ("records", "nextRecordsUrl"),
    "servicenow": ("result", ""),
    "splunk": ("results", ""),
    "google_sheets": ("values", ""),
    "google_analytics": ("rows", ""),
}


class JsonPages(DataSource):
    """Options: url with {page} (from first_page) or {offset} if there are `pages` pages of `page_rows` rows, else links are
    followed by one task; rows and next, dotted paths in the answer; token, sent as a bearer token."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("pages", 1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, i = self.options, partition.value
        url = o["url"].replace("{page}", str(i + int(o.get("first_page", 1)))).replace("{offset}", str(i * int(o.get("page_rows", 0))))
        while url:
            headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {o['token']}"} if "token" in o else {})
            with urlopen(Request(url, headers=headers), timeout=float(o.get("timeout", 60))) as answer:
                found = json.load(answer)
            for row in _at(found, o.get("rows", "")) or ():
                yield _row(row, self.schema)
            link = _at(found, o["next"]) if o.get("next") and "pages" not in o else None
            url = urljoin(url, link) if link else None


def _at(value, path: str):
    """The value at a dotted path; a name that holds dots itself is tried first."""
    if not path or not isinstance(value, dict):
        return None if path else value
    if path in value:
        return value[path]
    head, _, rest = path.partition(".")
    return _at(value.get(head), rest) if rest else None


def _row(row, schema: StructType) -> tuple:
    """Values by name, or by place for a row that is a list; what does not fit its type is NULL, nested values are JSON text."""
    values = list(row) + [None] * len(schema) if isinstance(row, list) else [row.get(f.name) for f in schema]
    out = []
    for f, v in zip(schema, values, strict=False):
        try:
            if v is None:
                out.append(None)
            elif isinstance(f.dataType, BooleanType):
                out.append(v if isinstance(v, bool) else {"true": True, "false": False}[str(v).lower()])
            elif isinstance(f.dataType, LongType):
                out.append(int(v))
            elif isinstance(f.dataType, DoubleType):
                out.append(float(v))
            else:
                out.append(v if isinstance(v, str) else json.dumps(v))
        except (KeyError, TypeError, ValueError):
            out.append(None)
    return tuple(out)


def read(spark: SparkSession, kind: str, url: str, schema: str, **options) -> DataFrame:
    """A service's rows; schema of string, bigint, double and boolean columns."""
    rows, after = KINDS[kind]
    spark.dataSource.register(JsonPages)
    found = {"rows": rows, "next": after, "url": url} | {k: str(v) for k, v in options.items()}
    return spark.read.format("json_pages").schema(schema).options(**found).load()
