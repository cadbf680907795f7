"""Reading tables, records, captured pages and files; paths go through Spark's file systems."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"csv": "csv", "parquet": "parquet", "pq": "parquet", "jsonl": "json", "ndjson": "json", "json": "json", "xlsx": "xlsx"}


def latest_file(spark: SparkSession, folder: str, pattern: str = "*.{csv,xlsx,parquet,jsonl}") -> str | None:
    """The path of the most recently changed file that matches, null if there is none; only metadata is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return row["path"]


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("pdf", "docx", "txt")) -> DataFrame:
    """path, length, modificationTime of files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").load(folder)
    return files.select("path", "length", "modificationTime")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: csv (header, quoted line ends, byte order mark), parquet, JSON lines, JSON, xlsx."""
    kind = FORMATS.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if kind == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
        return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿")) if df.columns else df
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return spark.read.json(path, multiLine=path.lower().endswith(".json"))
    if kind == "xlsx":
        return read_xlsx(spark, path)
    raise ValueError(f"unknown kind of table: {path}")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, nulls as the empty text."""
    df = read_table(spark, path)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def _xlsx_rows(content: bytes) -> Iterator[tuple[int, dict[str, str]]]:
    """(row number, cells by column letters) of the first sheet: shared and inline strings, sparse rows."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheet = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        for number, row in enumerate(ElementTree.fromstring(book.read(sheet)).iter(f"{ns}row"), 1):
            cells = {}
            for c in row.iter(f"{ns}c"):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                if c.get("t") == "inlineStr":
                    cells[letters] = "".join(t.text or "" for t in c.iter(f"{ns}t"))
                else:
                    value = c.findtext(f"{ns}v") or ""
                    cells[letters] = shared[int(value)] if c.get("t") == "s" and value else value
            yield number, cells


def xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, row, cells (map by column letters) of the first sheet of each workbook."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"]):
                rows = list(_xlsx_rows(bytes(content)))
                yield pd.DataFrame({"path": [p] * len(rows), "row": [r for r, _ in rows], "cells": [c for _, c in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells map<string,string>")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet with its first row as header; all columns are text, blanks null."""
    cells = xlsx_cells(spark, path)
    head = cells.where("row = 1").select("cells").first()
    if head is None:
        raise ValueError(f"an empty workbook: {path}")
    letters = sorted(head["cells"], key=lambda c: (len(c), c))
    body = cells.where("row > 1")
    return body.select(*[F.nullif(F.try_element_at("cells", F.lit(c)), F.lit("")).alias(head["cells"][c]) for c in letters])


def decode_cell(x: Column, schema: str = "array<string>") -> Column:
    """A JSON value kept as text; null where the text is none."""
    t = F.trim(x)
    return F.when((t.startswith("[") & t.endswith("]")) | (t.startswith("{") & t.endswith("}")), F.from_json(t, schema))


def json_reports(spark: SparkSession, folder: str, schema: str, suffix: str = "_gap") -> DataFrame:
    """One JSON document a file, with `cv_key` from the file's name without ``suffix``; broken files are skipped."""
    files = spark.read.text(folder, wholetext=True).select("value", F.regexp_replace(F.col("_metadata.file_name"), rf"({suffix})?\.json$", "").alias("cv_key"))
    parsed = files.withColumn("r", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.where("r is not null and r._corrupt_record is null").select("r.*", "cv_key").drop("_corrupt_record")


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The rows of a query in a database with a JDBC driver; partition options make it a parallel read."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
