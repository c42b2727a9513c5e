"""Panels and other files from and to CSV, JSON, Parquet, ZIP, workbooks and sparse matrices, with stated schemas: no pass over the data to infer one."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import re
import shutil
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

LONG = "entity long, period date, category string, value double"


def read_long(spark: SparkSession, path: str, kind: str = "parquet", schema: str = LONG) -> DataFrame:
    """A long panel; fields that cannot be parsed are null, and CSV files have a header."""
    source = spark.read.schema(schema)
    return source.option("header", True).csv(path) if kind == "csv" else source.format(kind).load(path)


def write_long(df: DataFrame, path: str, kind: str = "parquet", by: str | None = None) -> None:
    """Write a panel, in one folder for each value of a column if that is given; rows of a folder are brought together first."""
    out = df.repartition(by).write if by else df.write
    out = out.partitionBy(by) if by else out
    (out.option("header", True) if kind == "csv" else out).mode("overwrite").format(kind).save(path)


def read_delimited(spark: SparkSession, path: str, numbers: list[str], sep: str = ";") -> DataFrame:
    """Delimited text with a header, all columns as text but for `numbers`: a decimal comma is read as a point, what is no number is null."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    plain = [F.regexp_replace(F.col(c), "[\\s\u00a0]", "").alias(c) for c in numbers]
    parsed = lambda c: F.expr(f"try_cast(replace(_n.`{c}`, ',', '.') AS double)").alias(c)
    return rows.withColumn("_n", F.struct(*plain, F.lit(0).alias("_"))).select(*[parsed(c) if c in numbers else F.col(c) for c in rows.columns])


def read_matrix(spark: SparkSession, path: str, row: str, name: str = "period", value: str = "label", kind: str = "long") -> DataFrame:
    """A CSV matrix (one row an entity, one column a period) as rows (row, name, value); empty cells stay as nulls."""
    rows = spark.read.option("header", True).csv(path)
    others = [c for c in rows.columns if c != row]
    cells = rows.unpivot([row], others, name, "_v")
    return cells.select(F.expr(f"try_cast(`{row}` AS long)").alias(row), name, F.expr(f"try_cast(_v AS {kind})").alias(value))


def read_tagged(spark: SparkSession, paths: list[str], tag: str = "file") -> DataFrame:
    """Many CSV files with headers of their own, united by column name, with the name of the file; missing columns are null."""
    if not paths:
        raise ValueError("no files")
    parts = [spark.read.option("header", True).csv(p).withColumn(tag, F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.csv)?$", 1)) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties, kind, geometry) of the features of GeoJSON files; geometry and properties as JSON text, so any shape is read."""
    text = spark.read.text(path, wholetext=True)
    features = F.from_json("value", "features array<struct<type:string,properties:string,geometry:string>>")["features"]
    found = text.select(F.explode(features).alias("f"))
    return found.select("f.properties", F.get_json_object("f.geometry", "$.type").alias("kind"), "f.geometry")


def _files(spark: SparkSession, path: str, schema: str, read: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """Rows that `read` takes from the bytes of each file; a file is one unit of work."""
    ship(spark)
    names = [f.split()[0] for f in schema.split(", ")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = read(content)
                while part := list(islice(rows, 65_536)):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (file, *r), strict=True)) for r in part], schema=arrow)

    empty = spark.createDataFrame([], schema)
    arrow = to_arrow_schema(empty.schema)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(step, schema)


def _edges(content: bytes) -> Iterator[tuple]:
    with np.load(io.BytesIO(content), allow_pickle=False) as held:
        kind = held["format"].item()
        kind = kind.decode() if isinstance(kind, bytes) else kind
        if kind not in ("csr", "csc"):
            raise ValueError(f"sparse format {kind}")
        outer = np.repeat(np.arange(len(held["indptr"]) - 1), np.diff(held["indptr"]))
        i, j = (outer, held["indices"]) if kind == "csr" else (held["indices"], outer)
        yield from zip(i.tolist(), j.tolist(), held["data"].astype(float).tolist(), strict=True)


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, j, w) of compressed sparse matrices in .npz files (by rows or by columns)."""
    return _files(spark, path, "file string, i long, j long, w double", _edges)


def _sheet(content: bytes, sheet: int) -> Iterator[tuple]:
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", space)) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", space)]
        for number, row in enumerate(ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iterfind(".//m:row", space), 1):
            cells = {}
            for place, cell in enumerate(row.iterfind("m:c", space), 1):
                value, text = cell.find("m:v", space), cell.find("m:is", space)
                column = re.sub("[^A-Z]", "", cell.get("r") or "") or str(place)
                if value is not None:
                    cells[column] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                elif text is not None:
                    cells[column] = "".join(t.text or "" for t in text.iterfind(".//m:t", space))
            yield int(row.get("r") or number), list(cells.items())


def read_workbook(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(file, row, cells) of one sheet of .xlsx files; cells are a map from column letters to text."""
    return _files(spark, path, "file string, row long, cells map<string,string>", lambda content: _sheet(content, sheet))


def _inflated(content: bytes, column: str, values: frozenset[str], sep: str) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in archive.namelist():
            with archive.open(name) as raw:
                lines = csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline=""), delimiter=sep)
                yield from ((name, list(r.items())) for r in lines if r.get(column) in values)


def read_zipped(spark: SparkSession, path: str, column: str, values: list[str], sep: str = ";") -> DataFrame:
    """(file, entry, fields) of the rows of delimited files in ZIP archives whose column has one of some values; entries are inflated as a stream."""
    wanted = frozenset(values)
    return _files(spark, path, "file string, entry string, fields map<string,string>", lambda content: _inflated(content, column, wanted, sep))


def fetch(url: str, target: str, sha256: str | None = None) -> str:
    """Downloads a file unless it is there already, and returns the digest; another digest than the stated one removes it and raises."""
    if not os.path.exists(target):
        with urllib.request.urlopen(url) as source, open(f"{target}.part", "wb") as out:
            shutil.copyfileobj(source, out)
        os.replace(f"{target}.part", target)
    with open(target, "rb") as file:
        found = hashlib.file_digest(file, "sha256").hexdigest()
    if sha256 is not None and found != sha256:
        os.remove(target)
        raise ValueError(f"{url} has digest {found}")
    return found


def write_bundle(df: DataFrame, path: str, **groups: list[str]) -> None:
    """Nested JSON records: the columns of each group go into an object of that name."""
    inner = {c for names in groups.values() for c in names}
    nested = [F.struct(*names).alias(g) for g, names in groups.items()]
    df.select(*[c for c in df.columns if c not in inner], *nested).write.mode("overwrite").json(path)


def write_client_csv(df: DataFrame, path: str) -> None:
    """CSV for spreadsheets: a byte order mark before the header of each file, every field quoted, quotes doubled."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '""'), F.lit('"'))
    head = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    lines = df.select(F.concat_ws(",", *[quoted(F.col(c).cast("string")) for c in df.columns]).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(([head] if first else []) + batch.column(0).to_pylist(), pa.string())], names=["value"])
                first = False

    lines.mapInArrow(headed, "value string").write.mode("overwrite").text(path, lineSep="\r\n")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report table of a small result; more than `most` rows raise, since they come to the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(map(cell, line)) + " |" for line in lines) + "\n"


def write_names(path: str, names: dict[str, str], key: str = "names") -> None:
    """Writes a mapping of names back into a YAML file under one key; other lines of the file stay as they are."""
    lines = open(path, encoding="utf-8").read().splitlines() if os.path.exists(path) else []
    kept, inside = [], False
    for line in lines:
        inside = line.rstrip() == f"{key}:" or inside and (line.startswith((" ", "\t")) or not line.strip())
        if not inside:
            kept.append(line)
    quoted = [f"  {json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}" for k, v in names.items()]
    with open(path, "w", encoding="utf-8") as file:
        file.write("\n".join([*kept, f"{key}:", *quoted]) + "\n")
