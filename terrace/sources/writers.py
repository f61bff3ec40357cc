"""Sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_file(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options) -> None:
    """parquet, orc, csv or json, in folders by partition."""
    writer = df.write.mode(mode).format(kind).options(**({"header": True} if kind == "csv" else {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_table(df: DataFrame, table: str, mode: str = "errorifexists", bucket_by: Sequence[str] = (), buckets: int = 0) -> None:
    """A catalog table; buckets on a join's key spare the join its shuffle."""
    writer = df.write.mode(mode).format("parquet")
    (writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by) if bucket_by else writer).saveAsTable(table)


def with_calculations(df: DataFrame, calculations: Mapping[str, Column]) -> DataFrame:
    """Calculated columns in their order; one may use those before it."""
    for name, value in calculations.items():
        df = df.withColumn(name, value)
    return df


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrites the partitions that df holds, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def best_dimension(df: DataFrame, columns: Sequence[str], most: int = 1000) -> str:
    """Of these columns the one with most distinct values up to `most`, by an approximate count in one pass."""
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first().asDict()
    fit = {c: n for c, n in counts.items() if 1 < n <= most} or counts
    return max(sorted(fit), key=lambda c: fit[c] if c in fit else 0)


def summary(df: DataFrame, dimension: str, measures: Sequence[str]) -> DataFrame:
    return df.groupBy(dimension).agg(*[F.sum(m).alias(f"total_{m}") for m in measures])


def workbook(sheets: Mapping[str, Sequence[Sequence]]) -> bytes:
    """A spreadsheet file of named sheets of rows: text, numbers, booleans, dates and times; None leaves a cell out. For the rows that one task holds."""
    import datetime as dt
    import io
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, dt.date):
            since = v - dt.datetime(1899, 12, 30) if isinstance(v, dt.datetime) else v - dt.date(1899, 12, 30)
            return f"<c><v>{since / dt.timedelta(days=1)!r}</v></c>"
        if isinstance(v, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        return f"<c><v>{v!r}</v></c>"

    ns, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds, package = "http://schemas.openxmlformats.org/package/2006/content-types", "http://schemas.openxmlformats.org/package/2006/relationships"
    part, file = "application/vnd.openxmlformats-officedocument.spreadsheetml", io.BytesIO()
    numbered = list(enumerate(sheets.items(), 1))
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
        names = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{part}.worksheet+xml"/>' for i, _ in numbered)
        rels = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        book.writestr("[Content_Types].xml", f'<Types xmlns="{kinds}">{rels}<Override PartName="/xl/workbook.xml" ContentType="{part}.sheet.main+xml"/>{names}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{link}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{link}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, (name, _) in numbered) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="rId{i}" Type="{link}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered) + "</Relationships>")
        for i, (_, rows) in numbered:
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{ns}"><sheetData>' + "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in rows) + "</sheetData></worksheet>")
    return file.getvalue()
