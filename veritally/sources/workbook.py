"""xlsx files by the standard library alone, read and written by tasks.

Reading: every task takes the file through Spark's own reader, so that any URI will do, and parses its range of rows only. Writing:
tasks turn rows into compressed pieces of sheet text. A deflate stream may be cut at byte borders and sums of checks can be combined, so that the driver
only puts the pieces into the file one after another; it never holds more than a piece.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import date, datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import Scratch, _delete

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows that one task parses, rows of a written piece, and rows of a sheet beside its header.
RANGE, PIECE, SHEET = 100_000, 20_000, 1_048_575


def _column(ref: str) -> int:
    n = 0
    for x in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(x) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    cells = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in own | set(range(14, 23)) | {45, 46, 47}}


class Book:
    """An opened workbook: shared texts, date styles, and its sheets' places."""

    def __init__(self, data: bytes, sheet: str | None = None):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.shared = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            for item in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                self.shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        sheets = list(ElementTree.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
        one = next((s for s in sheets if s.get("name") == sheet), None if sheet else next(iter(sheets), None))
        if sheet and one is None:
            raise ValueError(f"no sheet {sheet}")
        self.names = [s.get("name") for s in sheets]
        self.dates = _date_styles(self.zip)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        target = links[one.get(f"{_REL}id")].lstrip("/") if one is not None else None
        self.target = target if target is None or target.startswith("xl/") else f"xl/{target}"

    def cells(self, row: ElementTree.Element) -> list:
        out = []
        for k, c in enumerate(row.iter(f"{_MAIN}c")):
            place = _column(c.get("r")) if c.get("r") else max(k, len(out))
            out += [None] * (place - len(out))
            v, kind = c.find(f"{_MAIN}v"), c.get("t", "n")
            text = v.text if v is not None else None
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif text is None:
                value = None
            elif kind == "s":
                value = self.shared[int(text)]
            elif kind == "b":
                value = text == "1"
            elif kind in ("str", "e"):
                value = text
            elif int(c.get("s", 0)) in self.dates:
                value = datetime(1899, 12, 30) + timedelta(days=float(text))
            else:
                value = float(text)
                value = int(value) if value.is_integer() and abs(value) < 1 << 53 and "." not in text else value
            out.append(value)
        return out

    def rows(self, first: int = 0, last: int | None = None) -> Iterator[list]:
        """Cells of the row elements from first to before last; text outside of them is passed over unparsed, a megabyte at a time."""
        if self.target is None:
            return
        parser, seen, inside = ElementTree.XMLPullParser(["end"]), 0, first == 0
        begin = re.compile(rb"<(?:\w+:)?row[\s>/]")
        with self.zip.open(self.target) as f:
            held, head = b"", b""
            while chunk := f.read(1 << 20):
                held += chunk
                cut = held.rfind(b"<")
                part, held = (held, b"") if cut < 0 else (held[:cut], held[cut:])
                at = 0
                for m in begin.finditer(part):
                    if seen == 0 and not head:
                        head = part[: m.start()] if first else b""
                        if first:
                            parser.feed(head)
                    if seen == first and first:
                        inside, at = True, m.start()
                    if last is not None and seen == last:
                        parser.feed(part[at : m.start()]) if inside else None
                        yield from self._parsed(parser)
                        return
                    seen += 1
                if inside:
                    parser.feed(part[at:])
                    yield from self._parsed(parser)
            if inside:
                parser.feed(held)
                yield from self._parsed(parser)

    def _parsed(self, parser: ElementTree.XMLPullParser) -> Iterator[list]:
        for _, e in parser.read_events():
            if e.tag == f"{_MAIN}row":
                yield self.cells(e)
                e.clear()

    def count(self) -> int:
        n, held, begin = 0, b"", re.compile(rb"<(?:\w+:)?row[\s>/]")
        with self.zip.open(self.target) as f:
            while chunk := f.read(1 << 20):
                held += chunk
                cut = held.rfind(b"<")
                n, held = n + len(begin.findall(held[:cut])), held[cut:]
        return n + len(begin.findall(held))


def rows(data: bytes, sheet: str | None = None) -> Iterator[list]:
    """Cell values of a sheet (the first if not named), row by row."""
    yield from Book(data, sheet).rows()


def _text(v: object) -> str | None:
    if v is None:
        return None
    return v.isoformat(sep=" ") if isinstance(v, datetime) else str(v)


def _names(header: list) -> list[str]:
    return [str(v) if v is not None else f"Unnamed: {i}" for i, v in enumerate(header)]


_KINDS = {frozenset({"int"}): "bigint", frozenset({"float"}): "double", frozenset({"int", "float"}): "double", frozenset({"bool"}): "boolean", frozenset({"datetime"}): "timestamp"}


def _file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _ranges(spark: SparkSession, path: str, n: int, size: int) -> DataFrame:
    """The file beside each range of its rows; each range reads the file by itself, nothing is exchanged."""
    out = None
    for k in range(max(1, -(-n // size))):
        part = _file(spark, path).select("content", F.lit(k * size).alias("first"), F.lit((k + 1) * size).alias("last"))
        out = part if out is None else out.unionByName(part)
    return out


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, schema: T.StructType | str | None = None, size: int = RANGE) -> DataFrame:
    """A sheet of a workbook at any URI, its first row the header; types are told by all cells of a column where no schema is given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                book = Book(data.as_py(), sheet)
                yield pa.record_batch([pa.array([book.count() if book.target else 0]), pa.array([_names(next(book.rows(), []))], pa.list_(pa.string()))], names=["n", "names"])

    head = _file(spark, path).mapInArrow(count, "n long, names array<string>").first()
    parts = _ranges(spark, path, head["n"], size)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seen: list[set[str]] = [set() for _ in head["names"]]
                for k, cells in enumerate(Book(row["content"], sheet).rows(row["first"], row["last"])):
                    for i, v in enumerate(cells[: len(seen)] if k or row["first"] else ()):
                        if v is not None:
                            seen[i].add(type(v).__name__)
                yield pa.record_batch([pa.array([[sorted(s) for s in seen]], pa.list_(pa.list_(pa.string())))], names=["seen"])

    if schema is None:
        found = parts.mapInArrow(kinds, "seen array<array<string>>").collect()  # a row a range
        made = [_KINDS.get(frozenset(x for f in found for x in f["seen"][i]), "string") for i in range(len(head["names"]))]
        schema = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(head["names"], made, strict=True)])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    types = [f.dataType.typeName() for f in schema.fields]
    # a sheet's times have no zone: they are the session's
    plain = T.StructType([T.StructField(f"c{i}", T.TimestampNTZType() if t == "timestamp" else f.dataType) for i, (f, t) in enumerate(zip(schema.fields, types, strict=True))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(plain)

        def put(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), into.types, strict=True)], schema=into)

        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for k, cells in enumerate(Book(row["content"], sheet).rows(row["first"], row["last"])):
                    cells = cells[: len(types)] + [None] * (len(types) - len(cells))
                    if (k or row["first"]) and any(v is not None for v in cells):
                        out.append(tuple(_text(v) if t == "string" else float(v) if t == "double" and v is not None else v for v, t in zip(cells, types, strict=True)))
                    if len(out) >= 10_000:
                        yield put(out)
                        out = []
                if out:
                    yield put(out)

    if not types:
        return spark.createDataFrame([], schema)
    return parts.mapInArrow(read, plain).select(*(F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)))


def sheet_names(names: Sequence[str]) -> list[str]:
    """Names that a workbook takes: without its special characters, at most 31 long, and all different whatever their case."""
    out: list[str] = []
    for name in names:
        plain = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
        tried, n = plain, 1
        while tried.lower() in (x.lower() for x in out):
            n += 1
            tried = f"{plain[: 31 - len(f' ({n})')]} ({n})"
        out.append(tried)
    return out


def _cell(v: object) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f"<c><v>{v!r}</v></c>"
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", v.isoformat(sep=" ") if isinstance(v, datetime) else v.isoformat() if isinstance(v, date) else str(v))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _row(values: Sequence[object]) -> str:
    return f"<row>{''.join(map(_cell, values))}</row>"


_PIECES = "part int, seq int, n long, crc long, size long, data binary"


def _deflated(text: str, last: bool = False) -> tuple[int, int, bytes]:
    """Check sum, size and a stretch of a deflate stream that others may follow, unless it is the last."""
    raw, z = text.encode(), zlib.compressobj(6, zlib.DEFLATED, -15)
    return zlib.crc32(raw), len(raw), z.compress(raw) + z.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            piece = batch.slice(at, PIECE)
            crc, size, data = _deflated("".join(map(_row, zip(*(c.to_pylist() for c in piece.columns), strict=True))))
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([piece.num_rows]), pa.array([crc]), pa.array([size]), pa.array([data], pa.binary())], names=["part", "seq", "n", "crc", "size", "data"])
            seq += 1


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the one of CRC-32, lowest powers in the highest bits."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """The check sum of two stretches behind each other, the second one of `size` bytes."""
    power, base, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            power = _times(base, power)
        base, n = _times(base, base), n >> 1
    return _times(power, first) ^ second


class _Zip:
    """A zip file put together from finished stretches, written once from start to end."""

    def __init__(self, put: Callable[[bytes], None]):
        self.put, self.at, self.entries = put, 0, []

    def _out(self, data: bytes) -> None:
        self.put(data)
        self.at += len(data)

    def add(self, name: str, crc: int, size: int, packed: int, stretches: Iterator[bytes]) -> None:
        start, encoded = self.at, name.encode()
        if max(size, self.at + packed) >= 1 << 32:
            raise ValueError("a workbook holds at most 4 GB; write larger reports with write_sections")
        self._out(struct.pack("<4s5H3I2H", b"PK\3\4", 20, 0x800, 8, 0, 33, crc, packed, size, len(encoded), 0) + encoded)
        for s in stretches:
            self._out(s)
        self.entries.append((encoded, crc, packed, size, start))

    def text(self, name: str, text: str) -> None:
        crc, size, data = _deflated(text, True)
        self.add(name, crc, size, len(data), iter((data,)))

    def close(self) -> None:
        start = self.at
        for name, crc, packed, size, at in self.entries:
            self._out(struct.pack("<4s6H3I5H2I", b"PK\1\2", 20, 20, 0x800, 8, 0, 33, crc, packed, size, len(name), 0, 0, 0, 0, 0, at) + name)
        self._out(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(self.entries), len(self.entries), self.at - start, start, 0))


def write_workbook(spark: SparkSession, sheets: Mapping[str, DataFrame], path: str, most: int = SHEET) -> None:
    """A workbook of named tables at any URI, rows in the tables' order. A table of more than `most` rows goes on in further sheets.

    The file gets its name when it is whole.
    """
    scratch = Scratch(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final, made = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = final.getFileSystem(conf)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, doc, rel = _MAIN[1:-1], _REL[1:-1], "http://schemas.openxmlformats.org/package/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = fs.create(made, True)
    try:
        book, names = _Zip(lambda b: out.write(bytearray(b))), []
        for name, df in sheets.items():
            plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
            pieces = scratch.written(plain.mapInArrow(_pieces, _PIECES)) if df.columns else None
            index = pieces.select("part", "seq", "n", "crc", "size", F.length("data").alias("packed")).orderBy("part", "seq").collect() if pieces else []  # a row a piece
            data = pieces.select("data").orderBy(pieces["part"], pieces["seq"]).toLocalIterator(prefetchPartitions=True) if index else iter(())
            begin, end = _deflated(f'{head}<worksheet xmlns="{main}"><sheetData>{_row(df.columns)}'), _deflated("</sheetData></worksheet>", True)
            groups, room = [[]], most
            for i in index:
                if groups[-1] and room < i["n"]:
                    groups.append([])
                    room = most
                groups[-1].append(i)
                room -= i["n"]
            for group in groups:
                names.append(name)
                crc, size = begin[:2]
                for i in (*group, {"crc": end[0], "size": end[1]}):
                    crc, size = joined_crc(crc, i["crc"], i["size"]), size + i["size"]

                def stretches(n: int = len(group)) -> Iterator[bytes]:
                    yield begin[2]
                    for _ in range(n):
                        yield bytes(next(data)["data"])  # noqa: B023
                    yield end[2]

                book.add(f"xl/worksheets/sheet{len(names)}.xml", crc, size, len(begin[2]) + sum(i["packed"] for i in group) + len(end[2]), stretches())
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.text("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        book.text("_rels/.rels", f'{head}<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheet_names(names), 1))
        book.text("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{doc}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{doc}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        book.text("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{rel}">{links}</Relationships>')
        book.close()
    finally:
        out.close()
        scratch.release()
    if fs.exists(final):
        _delete(spark, path)
    fs.rename(made, final)
