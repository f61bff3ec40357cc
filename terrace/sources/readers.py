"""Sources. Readers only declare a scan, so filters and columns reach it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import web

#: JDBC address and driver class by kind of server.
JDBC = {
    "sql_server": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433, "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "azure_sql": ("jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true", 1433, "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "synapse": ("jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true", 1433, "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432, "org.postgresql.Driver"),
    "redshift": ("jdbc:redshift://{host}:{port}/{database}", 5439, "com.amazon.redshift.jdbc.Driver"),
    "denodo": ("jdbc:denodo://{host}:{port}/{database}", 9999, "com.denodo.vdp.jdbc.Driver"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306, "com.mysql.cj.jdbc.Driver"),
    "singlestore": ("jdbc:singlestore://{host}:{port}/{database}", 3306, "com.singlestore.jdbc.Driver"),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", 1521, "oracle.jdbc.OracleDriver"),
    "teradata": ("jdbc:teradata://{host}/DATABASE={database},DBS_PORT={port}", 1025, "com.teradata.jdbc.TeraDriver"),
    "sap_hana": ("jdbc:sap://{host}:{port}/?databaseName={database}", 30015, "com.sap.db.jdbc.Driver"),
    "vertica": ("jdbc:vertica://{host}:{port}/{database}", 5433, "com.vertica.jdbc.Driver"),
    "impala": ("jdbc:impala://{host}:{port}/{database}", 21050, "com.cloudera.impala.jdbc.Driver"),
    "presto": ("jdbc:presto://{host}:{port}/{database}", 8080, "com.facebook.presto.jdbc.PrestoDriver"),
    "trino": ("jdbc:trino://{host}:{port}/{database}", 8080, "io.trino.jdbc.TrinoDriver"),
    "starburst": ("jdbc:trino://{host}:{port}/{database}?SSL=true", 443, "io.trino.jdbc.TrinoDriver"),
    "athena": ("jdbc:athena://{host}:{port};Catalog={database}", 443, "com.amazon.athena.jdbc.AthenaDriver"),
    "db2": ("jdbc:db2://{host}:{port}/{database}", 50000, "com.ibm.db2.jcc.DB2Driver"),
    "dremio": ("jdbc:dremio:direct={host}:{port};schema={database}", 31010, "com.dremio.jdbc.Driver"),
    "clickhouse": ("jdbc:clickhouse://{host}:{port}/{database}", 8123, "com.clickhouse.jdbc.ClickHouseDriver"),
    "firebolt": ("jdbc:firebolt:{database}?host={host}&port={port}", 443, "com.firebolt.FireboltDriver"),
}
#: Kinds without a JDBC driver of their own: read through a bridge, whose url and driver the caller names.
BRIDGED = ("essbase", "sap_bw")
#: Kinds of file store: the path says where, `kind` of what format.
STORES = ("azure_blob", "prep_input")
#: Kinds that a connector on the classpath reads, by its format name.
CONNECTORS = {"bigquery": "bigquery", "snowflake": "snowflake", "mongodb": "mongodb", "cosmosdb": "cosmos.oltp", "delta": "delta", "iceberg": "iceberg"}
#: Kinds that are tables of the session's catalog.
CATALOG = ("databricks", "databricks_unity", "spark", "hive", "lakehouse", "published")


class UnknownSource(ValueError):
    """A kind of source that nothing reads: an error when the plan is made, never an empty table."""


def read(spark: SparkSession, kind: str, **at) -> DataFrame:
    """A table by kind of source. Files: path and options; servers: host, database, table or query; catalog: table; web services: url and schema."""
    if kind in ("parquet", "orc", "text", "csv", "json", "xml"):
        return {"csv": csv, "json": json, "xml": xml}.get(kind, lambda s, path, **o: s.read.format(kind).options(**o).load(path))(spark, **at)
    if kind in STORES:
        return read(spark, at.pop("format", "parquet"), **at)
    if kind == "excel":
        return excel(spark, **at)
    if kind == "staged":
        return staged(spark, at["path"])[at["table"]]
    if kind in BRIDGED:
        return spark.read.format("jdbc").options(**{k: str(v) for k, v in at.items()}).load()
    if kind in JDBC:
        return jdbc(spark, kind, **at)
    if kind in CONNECTORS:
        return spark.read.format(CONNECTORS[kind]).options(**at).load()
    if kind in CATALOG:
        return spark.table(at["table"])
    if kind in web.KINDS:
        return web.read(spark, kind, **at)
    raise UnknownSource(f"no reader for {kind}")


def jdbc_options(kind: str, host: str, database: str, table: str | None = None, query: str | None = None, port: int | None = None, split: tuple[str, int, int, int] | None = None, **more) -> dict[str, str]:
    """split: (column, least, greatest, partitions) reads in parallel; without it one task reads all."""
    url, usual, driver = JDBC[kind]
    out = {"url": url.format(host=host, port=port or usual, database=database), "driver": driver} | {k: str(v) for k, v in more.items()}
    out |= {"query": query} if query else {"dbtable": table}
    if split:
        out |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, split), strict=True))
    return out


def jdbc(spark: SparkSession, kind: str, **at) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(kind, **at)).load()


def csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, sep: str | None = None, header: bool = True, **options) -> DataFrame:
    """Text in columns. With a schema the file is read once; bad cells become NULL. Without sep the first line decides."""
    sep = sep or delimiter(spark, path)
    reader = spark.read.options(header=header, sep=sep, mode="PERMISSIVE", **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def delimiter(spark: SparkSession, path: str | Sequence[str]) -> str:
    """The most frequent of comma, semicolon, tab and bar in the first line."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    return max(",;\t|", key=line.count)


def wildcard_union(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """All files that match, with the file each row is from."""
    return csv(spark, path, schema=schema, sep=sep).withColumn("source_file", F.input_file_name())


def json(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = True, rows: str | None = None) -> DataFrame:
    """rows: an array column whose elements are the rows."""
    reader = spark.read.option("multiLine", multiline)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select(F.inline(rows)) if rows else df


def xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def geojson(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A row for each feature: its properties, and its geometry as text."""
    schema = spark.read.option("multiLine", multiline).json(path).select(F.explode("features").alias("f"))
    return schema.select("f.properties.*", F.to_json("f.geometry").alias("geometry"))


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(letters: str) -> int:
    """A column's place, from 0, by its letters."""
    at = 0
    for c in letters:
        at = 26 * at + ord(c) - 64
    return at - 1


def _sheet_file(book, sheet: int | str) -> tuple[str | None, bool]:
    """The part that holds a sheet, by its name or its place among the tabs from 1, and whether the workbook counts days from 1904."""
    import posixpath
    from xml.etree import ElementTree

    if "xl/workbook.xml" not in book.namelist():
        name = f"xl/worksheets/sheet{sheet}.xml"
        return name if name in book.namelist() else None, False
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    since_1904 = any(x.get("date1904") in ("1", "true") for x in root.iter(_SHEET + "workbookPr"))
    tabs = list(root.iter(_SHEET + "sheet"))
    found = next((t for i, t in enumerate(tabs, 1) if sheet == i or sheet == t.get("name")), None)
    if found is None:
        return None, since_1904
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == found.get(_LINK))
    return posixpath.normpath(posixpath.join("/xl", target)).lstrip("/"), since_1904


def _sheet_rows(content: bytes, sheet: int | str) -> tuple[list[dict[int, str]], bool]:
    """The cells of a workbook's sheet, by row and column from 0, as text, and whether days count from 1904. A workbook without
    the sheet has no rows."""
    import io
    import zipfile
    from xml.etree import ElementTree

    def text_of(node) -> str:
        return "".join(t.text or "" for t in node.iter(_SHEET + "t"))

    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part, since_1904 = _sheet_file(book, sheet)
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [text_of(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(_SHEET + "si")]
        rows = []
        for row in ElementTree.fromstring(book.read(part)).iter(_SHEET + "row") if part else ():
            cells: dict[int, str] = {}
            for nth, cell in enumerate(row.iter(_SHEET + "c")):
                letters = cell.get("r", "").rstrip("0123456789")
                at = _column(letters) if letters else nth
                value, kind = cell.find(_SHEET + "v"), cell.get("t")
                if kind == "inlineStr":
                    cells[at] = text_of(cell)
                elif value is not None and value.text is not None and kind != "e":
                    cells[at] = shared[int(value.text)] if kind == "s" else value.text
            rows.append(cells)
        return rows, since_1904


def _typed(c: Column, kind, since_1904: Column) -> Column:
    """A cell's text as a column of that type. Numbers of days are dates; whole numbers may be written with a fraction of zero."""
    from pyspark.sql import types as T

    number = c.try_cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        # day 60 of 1900 is a leap day that never was; days of 1904 count from 0
        days = F.when(since_1904, number + 1462).otherwise(F.when(number < 60, number + 1).otherwise(number)) - 25569
        whole = F.floor(days)
        within = F.round((days - whole) * 86400, 3).cast("decimal(9,3)")
        at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(whole.try_cast("int"), F.lit(0), F.lit(0), within)
        return F.when(number.isNotNull(), at.cast(kind)).otherwise(c.try_cast(kind))
    if isinstance(kind, T.IntegralType):
        return F.coalesce(c.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))
    return c.try_cast(kind)


def workbook_rows(books: DataFrame, schema: str, sheet: int | str = 1, header: bool = True) -> DataFrame:
    """The rows of a sheet of each workbook in the binary column `content`: its columns by place, as the schema names and types
    them; cells that do not fit are NULL. sheet: its name, or its place among the tabs. A workbook is read in one task, as its
    format has no parts; many workbooks are read side by side."""
    from pyspark.sql import types as T

    wanted = T.StructType.fromDDL(schema)
    as_text = ", ".join(f"`{f.name}` string" for f in wanted) + ", `__1904` boolean"

    def cells(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                rows, since_1904 = _sheet_rows(bytes(content), sheet)
                yield pd.DataFrame([[*(r.get(i) for i in range(len(wanted))), since_1904] for r in rows[int(header) :]], columns=[*wanted.names, "__1904"], dtype=object)

    found = books.select("content").mapInPandas(cells, as_text)
    return found.select([_typed(F.col(f"`{f.name}`"), f.dataType, F.col("__1904")).alias(f.name) for f in wanted])


def excel(spark: SparkSession, path: str, schema: str, sheet: int | str = 1, header: bool = True) -> DataFrame:
    """workbook_rows() of the files that match."""
    return workbook_rows(spark.read.format("binaryFile").load(path), schema, sheet, header)


def staged(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The Parquet tables of a folder of staged extracts (a file or a folder each), by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    names = sorted(s.getPath().getName() for s in listed)
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{folder}/{n}") for n in names if not n.startswith(("_", "."))}


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal table, sent to the tasks of what joins it, as the caller holds all of it."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def custom_sql(spark: SparkSession, query: str, parameters: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """A query with named parameters (:name), bound and never pasted; {table} names a DataFrame."""
    return spark.sql(query, args=dict(parameters or {}), **tables)


def templated(options: Mapping[str, str], environment: Mapping[str, str]) -> dict[str, str]:
    """${NAME} in options from the environment given; a name that is not there is an error."""
    import string

    return {k: string.Template(v).substitute(environment) for k, v in options.items()}


def guarded(df: DataFrame, column: str, kind: str) -> DataFrame:
    """column as that type, and what could not be read in column_error."""
    value = F.col(column).try_cast(kind)
    return df.withColumn(f"{column}_error", F.when(value.isNull(), F.col(column))).withColumn(column, value)
