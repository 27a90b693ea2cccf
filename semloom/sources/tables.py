"""Tables in and out: CSV with header rows, folders of CSV, workbooks, Arrow; unit, licence and namespace tables."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Mapping, Sequence
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semloom.operators.reconstruct import ordered_columns
from semloom.terms import CUBE_PREFIXES

ROW = "__row_idx__"


def read_csv(spark: SparkSession, path: str | Sequence[str], header_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table, header) of a CSV file; every cell stays the text that it is.

    header_rows: the first three rows after the column names hold types, units and study stages, and data starts at row
    3. header is (ordinal, column, type, unit, stage), null without such rows. A file is split by lines and read by all
    tasks, unless one of its lines leaves a quote open, so that a cell has a line break: then by one."""
    paths = path if isinstance(path, str) else list(path)
    raw = spark.read.option("header", True).option("multiLine", breaks_lines(spark, paths)).csv(paths)
    if not header_rows:
        return raw, _header(spark, raw.columns, None)
    indexed = with_row_index(raw)
    head = indexed.where(F.col(ROW) < 3).orderBy(ROW).collect()
    return indexed.where(F.col(ROW) >= 3), _header(spark, raw.columns, head)


def breaks_lines(spark: SparkSession, paths: str | Sequence[str]) -> bool:
    """Whether any line of the files has an odd number of quotes, which each cell with a line break needs."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(paths).where(quotes % 2 == 1).isEmpty()


def with_row_index(df: DataFrame) -> DataFrame:
    """df, a scan of files, with the rows' numbers from 0 in the order of its partitions and of the rows within each. Only
    counts per partition are gathered; the scan splits the same files the same way both times."""
    marked = df.withColumn("_at_", F.monotonically_increasing_id())  # the partition above 33 bits of the row in it
    part = F.shiftright("_at_", 33)
    counts = marked.groupBy(part.alias("_part_")).agg(F.count("*").alias("_n_"))
    before = F.sum("_n_").over(Window.orderBy("_part_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part_", F.coalesce(before, F.lit(0)).alias("_off_"))
    row = F.col("_off_") + F.col("_at_").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn("_part_", part).join(F.broadcast(offsets), "_part_").select(*[F.col(f"`{c}`") for c in df.columns], row.alias(ROW))


def _header(spark: SparkSession, columns: Sequence[str], rows) -> DataFrame:
    cell = lambda i, c: (rows[i][c] or "").strip() or None if rows and len(rows) > i else None
    return spark.createDataFrame([(n, c, cell(0, c), cell(1, c), cell(2, c)) for n, c in enumerate(columns)], "ordinal int, column string, type string, unit string, stage string")


def split_header(df: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(table, header) of a table in memory whose first three rows by `order`, a unique number, are the header."""
    head = df.orderBy(order).limit(3).collect()
    rest = df.where(F.col(order) > head[-1][order]) if len(head) == 3 else df.limit(0)
    return rest, _header(df.sparkSession, [c for c in df.columns if c != order], head)


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files of a folder of any file system that Spark reads, by name; their contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()
    if not found:
        raise FileNotFoundError(f"no CSV file in {folder}")
    return sorted(r["path"] for r in found)


def read_csv_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder with the file's name in __source_file__; files need not have equal columns."""
    out = None
    by: dict[tuple, list[str]] = {}
    for n in csv_files(spark, folder):
        by.setdefault(tuple(spark.read.option("header", True).csv(n).columns), []).append(n)
    for group in by.values():
        one = spark.read.option("header", True).option("multiLine", breaks_lines(spark, group)).csv(group).withColumn("__source_file__", F.col("_metadata.file_name"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def save(df: DataFrame, folder: str, name: str, formats: Sequence[str] = ("csv", "parquet", "arrow"), header: DataFrame | None = None) -> list[str]:
    """The table as text columns in each format, columns in order and helpers last; nulls stay null.

    CSV and Parquet are folders written by all tasks; Arrow is one file of one machine, for tables that fit there.
    header: rows to go first in the CSV, of the same columns (see reconstruct.with_header_rows)."""
    cols = ordered_columns([c for c in df.columns if c not in (ROW, "__row__")])
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    done = []
    for f in formats:
        target = f"{folder}/{name}.{f}"
        if f == "csv":
            out = text if header is None else header.orderBy("__row__").drop("__row__").select("__Label__", *[c for c in cols if c != "__Label__"]).coalesce(1)
            out.write.mode("overwrite").option("header", True).csv(target)
        elif f == "parquet":
            text.write.mode("overwrite").parquet(target)
        elif f == "arrow":
            Path(folder).mkdir(parents=True, exist_ok=True)
            feather.write_feather(text.toArrow(), target)
        else:
            raise ValueError(f"unknown format {f!r}")
        done.append(target)
    return done


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(feather.read_table(path))


def licenses(spark: SparkSession, path: str) -> DataFrame:
    """(licenseId, name, isOsiApproved, isDeprecatedLicenseId) of an SPDX licence list in JSON."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("licenses").alias("l")).select("l.licenseId", "l.name", "l.isOsiApproved", "l.isDeprecatedLicenseId")


# --- workbooks

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def read_sheet(path: str, sheet: int = 0) -> list[list[str | float | bool | None]]:
    """The cells of a workbook's sheet, row by row, merged cells as their first. A workbook is a file for people; it is
    read on the driver."""
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        ident = book.findall("m:sheets/m:sheet", _NS)[sheet].get(f"{{{_NS['r']}}}id")
        target = rels[ident].lstrip("/")
        root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    cells: dict[tuple[int, int], object] = {}
    for c in root.iter(f"{{{_NS['m']}}}c"):
        at = _place(c.get("r"))
        kind, v = c.get("t"), c.find("m:v", _NS)
        if kind == "inlineStr":
            cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
        elif v is None or v.text is None:
            continue
        elif kind == "s":
            cells[at] = shared[int(v.text)]
        elif kind == "b":
            cells[at] = v.text == "1"
        elif kind in ("str", "e"):
            cells[at] = v.text if kind == "str" else None
        else:
            x = float(v.text)
            cells[at] = int(x) if x.is_integer() else x
    for m in root.iter(f"{{{_NS['m']}}}mergeCell"):
        a, b = (_place(x) for x in m.get("ref").split(":"))
        for i in range(a[0], b[0] + 1):
            for j in range(a[1], b[1] + 1):
                cells.setdefault((i, j), cells.get(a))
    if not cells:
        return []
    h, w = max(i for i, _ in cells) + 1, max(j for _, j in cells) + 1
    return [[cells.get((i, j)) for j in range(w)] for i in range(h)]


def _place(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def _column(j: int) -> str:
    out = ""
    j += 1
    while j:
        j, r = divmod(j - 1, 26)
        out = chr(65 + r) + out
    return out


def write_sheet(path: str, rows: Sequence[Sequence[object]], name: str = "Sheet1", merged: Sequence[str] = ()) -> None:
    """A workbook of one sheet: contents, no styles."""

    def cell(i: int, j: int, v) -> str:
        ref = f'r="{_column(j)}{i + 1}"'
        if isinstance(v, bool):
            return f'<c {ref} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f"<c {ref}><v>{v}</v></c>"
        return f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
    spans = f'<mergeCells count="{len(merged)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in merged) + "</mergeCells>" if merged else ""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    pkg = "http://schemas.openxmlformats.org/package/2006/"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pkg}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pkg}relationships"><Relationship Id="rId1" Type="{_NS["r"]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pkg}relationships"><Relationship Id="rId1" Type="{_NS["r"]}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="{_NS["m"]}"><sheetData>{body}</sheetData>{spans}</worksheet>')


#: Rows of a data template after the categories: what each column's metadata is.
TEMPLATE_ROWS = ("AltLabel", "Unit", "IsMeasure", "ExistingURI")


def write_data_template(path: str, variables: Sequence, rows: Sequence[Sequence[object]] = ()) -> None:
    """A workbook to fill in: categories (merged over their columns), four rows of metadata, names, data. Column A says
    what each row is. variables: cube.Variable."""
    v = list(variables)
    merged, start = [], 0
    for i in range(1, len(v) + 1):
        if i == len(v) or v[i].category != v[start].category:
            if i - start > 1 and v[start].category:
                merged.append(f"{_column(start + 1)}1:{_column(i)}1")
            start = i
    head = [["Category", *(x.category for x in v)], ["AltLabel", *(x.alt_label for x in v)], ["Unit", *(x.unit for x in v)], ["IsMeasure", *("Yes" if x.is_measure else "No" for x in v)], ["ExistingURI", *(x.existing for x in v)], ["Name", *(x.name for x in v)]]
    write_sheet(path, [*head, *[["", *r] for r in rows]], "Data", merged)


def read_data_template(spark: SparkSession, path: str) -> tuple[list, DataFrame]:
    """(variables, table) of such a workbook. Spaces in names become "_"; columns without any value are dropped;
    ExperimentId is numbered anew if it is missing or has a gap."""
    from semloom.operators.cube import EXPERIMENT, Variable

    cells = read_sheet(path)
    if len(cells) < 6:
        raise ValueError("the workbook has no row of names")
    at = lambda i, j: None if cells[i][j] is None or not str(cells[i][j]).strip() else str(cells[i][j]).strip()
    names = {j: at(5, j).replace(" ", "_") for j in range(1, len(cells[5])) if at(5, j)}
    body = [r for r in cells[6:] if any(x is not None for x in r[1:])]
    used = [j for j in names if any(r[j] is not None for r in body)]
    variables = [Variable(names[j], (at(3, j) or "").lower() == "yes", at(1, j), at(0, j), at(2, j), at(4, j)) for j in names if names[j] != EXPERIMENT or j in used]
    columns: dict[str, list] = {}
    for j in used:
        values = [r[j] for r in body]
        numeric = all(x is None or isinstance(x, int | float) and not isinstance(x, bool) for x in values)
        columns[names[j]] = [None if x is None else float(x) if numeric and any(isinstance(y, float) for y in values) else x if numeric else str(x) for x in values]
    if EXPERIMENT not in columns or any(x is None for x in columns[EXPERIMENT]):
        columns = {EXPERIMENT: list(range(1, len(body) + 1)), **{k: x for k, x in columns.items() if k != EXPERIMENT}}
    return variables, spark.createDataFrame(pa.table(columns))


def write_namespace_template(path: str, prefixes: Mapping[str, str] = CUBE_PREFIXES) -> None:
    write_sheet(path, [["Prefix", "Namespace"], *[[p, iri] for p, iri in sorted(prefixes.items())]], "Namespaces")


def read_namespaces(path: str, defaults: Mapping[str, str] = CUBE_PREFIXES) -> tuple[dict[str, str], str | None]:
    """(prefixes, problem) of a workbook of prefixes and IRIs, on top of the defaults. A prefix that comes again with
    another IRI ends the reading: what came before it stays, and the problem says which it was."""
    out, own = dict(defaults), {}
    for r in read_sheet(path)[1:]:
        if len(r) < 2 or r[0] is None or r[1] is None:
            continue
        p, iri = str(r[0]).strip().lower(), str(r[1]).strip()
        if own.get(p, iri) != iri:
            return out, f"prefix {p!r} stands for {own[p]} and {iri}"
        own[p] = out[p] = iri
    return out, None
