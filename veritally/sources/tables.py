"""Reading tables by suffix, writing result tables, session-scoped storage, templates."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORKBOOKS = (".xlsx", ".xls")


def is_workbook(name: str) -> bool:
    return PurePosixPath(name.lower()).suffix in WORKBOOKS


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """parquet, orc, json, csv (with a header) or xlsx, told by the suffix; any URI that Spark reads. A workbook's header and types are told by a first pass."""
    kind = PurePosixPath(path.rstrip("/")).suffix.lower().lstrip(".")
    if kind == "xlsx":
        from .workbook import read_workbook

        return read_workbook(spark, path, schema=schema)
    if kind not in ("parquet", "orc", "json", "csv"):
        raise ValueError(f"unsupported table format: {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(path, header=True, inferSchema=schema is None) if kind == "csv" else getattr(reader, kind)(path)


def columns(spark: SparkSession, path: str, orientation: str = "vertical") -> list[str]:
    """Canonical column names without reading data; a horizontal table needs its first column."""
    from ..operators.prepare import prepared

    return prepared(read_table(spark, path), orientation).columns


def json_row(df: DataFrame) -> Column:
    """The row as JSON: not-a-number and infinities become null, times are ISO."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        parts.append(c.alias(f.name))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"})


def write_sections(sections: Mapping[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """Each section in a folder of its own under path; returns where. CSV gets nested columns as JSON."""
    out = {}
    for name, df in sections.items():
        at = f"{path.rstrip('/')}/{name.replace(' ', '_')}"
        if fmt == "csv":
            nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
            df = df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested})
            df.write.mode(mode).csv(at, header=True)
        elif fmt == "json":
            df.select(json_row(df).alias("value")).write.mode(mode).text(at)
        else:
            df.write.mode(mode).format(fmt).save(at)
        out[name] = at
    return out


def write_report(sections: Mapping[str, DataFrame], path: str) -> None:
    """A workbook of the sections at any URI, in their order; nested columns are JSON, sections too long for a sheet go on in further ones."""
    from .workbook import write_workbook

    sheets = {}
    for name, df in sections.items():
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
        odd = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.BinaryType, T.DecimalType))]
        sheets[name] = df.withColumns({**{c: F.to_json(F.col(f"`{c}`")) for c in nested}, **{c: F.col(f"`{c}`").cast("string") for c in odd}})
    if sheets:
        write_workbook(next(iter(sheets.values())).sparkSession, sheets, path)


def rebuilt(spark: SparkSession, stored: Mapping[str, str], wanted: Sequence[str]) -> dict[str, DataFrame]:
    """A report of chosen sections from tables that write_sections stored."""
    return {name: spark.read.parquet(at) for name, at in stored.items() if name in wanted}


def page(df: DataFrame, order: Sequence[str | Column], offset: int = 0, limit: int = 25) -> tuple[DataFrame, int]:
    """A page of at most 25 rows, in an order, and the number of all rows."""
    if not 0 <= limit <= 25 or offset < 0:
        raise ValueError("limit is at most 25 and offset at least 0")
    return df.orderBy(*order).offset(offset).limit(limit), df.count()


def header_row(rows: Sequence[Sequence[object]]) -> int:
    """The first of the leading rows with at least three cells that aren't blank."""
    for i, row in enumerate(rows[:12]):
        if sum(v is not None and str(v).strip() != "" for v in row) >= 3:
            return i
    return 0


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows of which any cell contains the text, whatever its case."""
    cells = F.concat_ws("\u0001", *(F.col(f"`{c}`").cast("string") for c in df.columns))
    return df.where(F.contains(F.lower(cells), F.lit(query.lower())))


class Storage:
    """Session-scoped folders on any filesystem that Hadoop reads, object stores included."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, at: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def upload_path(self, session: str, name: str) -> str:
        return f"{self.root}/uploads/{session}/{uuid.uuid4().hex}{PurePosixPath(name).suffix.lower()}"

    def report_path(self, session: str) -> str:
        return f"{self.root}/reports/{session}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame, at: str) -> str:
        df.write.mode("errorifexists").parquet(at)
        return at

    def exists(self, at: str) -> bool:
        fs, path = self._fs(at)
        return fs.exists(path)

    def delete(self, at: str) -> bool:
        if not at.startswith(self.root + "/"):
            raise ValueError("outside of this storage")
        fs, path = self._fs(at)
        return fs.delete(path, True)

    def expired(self, now_ms: int, hours: float = 24) -> list[str]:
        """Session folders that weren't changed for so long; a listing only."""
        out = []
        for kind in ("uploads", "reports"):
            fs, path = self._fs(f"{self.root}/{kind}")
            if fs.exists(path):
                out += [s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory() and s.getModificationTime() < now_ms - hours * 3_600_000]
        return sorted(out)


# The rows of the two templates.
TAX_TEMPLATE = (
    ("GSTR-2B", "ABC PRIVATE LIMITED", "INV-005", "2025-03-05", 10000.0, 1800.0, 0.0, 0.0, 0.0, 11800.0),
    ("GSTR-2B", "ABC PVT LTD", "INV005", "2025-03-05", 5000.0, 900.0, 0.0, 0.0, 0.0, 5900.0),
    ("GSTR-2B", "XYZ ENTERPRISES", "INV-042", "2025-03-10", 20000.0, 0.0, 1800.0, 1800.0, 0.0, 23600.0),
)
GENERAL_TEMPLATE = (
    ("INV-1001", "2025-03-01", "ACME SUPPLIERS LTD", 15450.0, "OPERATIONS"),
    ("INV-1002", "2025-03-02", "GLOBAL TECH SOLUTIONS", 8200.5, "IT SERVICES"),
    ("INV-1003", "2025-03-05", "NEXUS LOGISTICS INC", 24300.0, "LOGISTICS"),
)


def template(spark: SparkSession, tax: bool = False) -> DataFrame:
    if tax:
        from ..operators.prepare import TAX_COLUMNS

        return spark.createDataFrame(TAX_TEMPLATE, list(TAX_COLUMNS))
    return spark.createDataFrame(GENERAL_TEMPLATE, ["Invoice No", "Invoice Date", "Vendor Name", "Amount", "Department"])


def conformed(df: DataFrame, to: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """A table in the shape of another, such as a template: `columns` names the source of each, missing ones are null, types are the target's."""
    source = {**{c: None for c in to.columns}, **columns}
    if unknown := sorted(set(source) - set(to.columns)):
        raise KeyError(f"the target has no columns {', '.join(unknown)}")
    value = lambda c: F.col(f"`{source[c]}`") if source[c] else F.lit(None)
    return df.select(*(value(f.name).try_cast(f.dataType).alias(f.name) for f in to.schema.fields))
