"""Files in and out: PDF uploads, PNG masks, report workbooks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uploads(spark: SparkSession, path: str, page: int = 0) -> DataFrame:
    """One row for each PDF below ``path``: project_id, filename, page_id, n_bytes, pdf. Other files are left out by their first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.where(F.substring("content", 1, 5) == F.lit(b"%PDF-"))
    return found.select(
        F.md5("path").alias("project_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(page).alias("page_id"), F.col("length").alias("n_bytes"),
        F.col("content").alias("pdf"))


def new_projects(files: DataFrame) -> DataFrame:
    """Projects with the defaults of a new one: not calibrated, metres, walls of 2.4."""
    return files.select("project_id", "filename", F.lit(None).cast("double").alias("scale_factor"), F.lit("m").alias("unit"), F.lit(2.4).alias("wall_height"), F.base64("pdf").alias("pdf"))


def data_url_bytes(url: Column) -> Column:
    """Bytes of a data URL or of bare base64."""
    return F.unbase64(F.substring_index(url, ",", -1))


def workbook(rows: list[list]) -> bytes:
    """A workbook with one sheet of numbers and texts."""

    def cell(r: int, c: int, value) -> str:
        name, k = "", c
        while True:
            name, k = chr(65 + k % 26) + name, k // 26 - 1
            if k < 0:
                break
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{name}{r}"><v>{value}</v></c>'
        return "" if value is None else f'<c r="{name}{r}" t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'

    body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kinds = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Measurements" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def workbooks(sheet: DataFrame) -> DataFrame:
    """(project_id, workbook) from sheet(project_id, line, a, b): one project, whose rooms bound it, a row; many projects an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, a, b = batch.column("rows").flatten().flatten()
            line, a, b = line.to_pylist(), a.to_pylist(), b.cast(pa.float64()).to_numpy(zero_copy_only=False).tolist()
            books, at = [], 0
            for n in batch.column("rows").value_lengths().to_pylist():
                rows: list[list] = [[] for _ in range(int(max(line[at : at + n])) + 1)]
                rows[0] = ["Room", "Value"]
                for k in range(at, at + n):
                    rows[int(line[k])] = [a[k], b[k]]
                books.append(workbook(rows))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column("project_id"), pa.array(books, pa.binary())], names=["project_id", "workbook"])

    of = sheet.groupBy("project_id").agg(F.collect_list(F.struct("line", "a", "b")).alias("rows"))
    return of.select(F.col("project_id").cast("long").alias("project_id"), "rows").mapInArrow(run, "project_id long, workbook binary")
