"""Sources and sinks: sharded CSV, ragged CSV, tolerant JSON."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_table(spark: SparkSession, path, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV under an explicit schema; empty cells are null, quoted cells may hold newlines."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)


def sharded_csv(spark: SparkSession, path, schema: str, pattern: str = r"_(\d+)-(\d+)\.csv$") -> DataFrame:
    """All shards of a glob with their order by the numbers in the file name: columns shard_from, shard_to."""
    name = F.col("_metadata.file_name")
    df = csv_table(spark, path, schema)
    return df.select("*", F.regexp_extract(name, pattern, 1).try_cast("long").alias("shard_from"), F.regexp_extract(name, pattern, 2).try_cast("long").alias("shard_to"))


def by_file_name(spark: SparkSession, path, schema: str, suffix: str = r"_timestamps?\.csv$", column: str = "feature") -> DataFrame:
    """Tables whose file name is the value of a column."""
    df = csv_table(spark, path, schema)
    return df.select("*", F.regexp_replace(F.col("_metadata.file_name"), suffix, "").alias(column))


def ragged_csv(spark: SparkSession, path, columns: tuple[str, str] = ("file_name", "report")) -> DataFrame:
    """Two-column files with stray commas and quotes: fields after the first are one text again."""

    def fix(frames):
        for pdf in frames:
            out = []
            for content in pdf["value"]:
                rows = csv.reader(io.StringIO(content))
                next(rows, None)
                out += [(r[0], " ".join(x.strip() for x in r[1:]).replace('"', "").strip()) for r in rows if r]
            yield pd.DataFrame(out, columns=list(columns))

    return spark.read.text(path, wholetext=True).mapInPandas(fix, ", ".join(f"{c} string" for c in columns))


def json_lines(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines; malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path, schema: str) -> DataFrame:
    """Files holding one array or object each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_by_fold(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("fold").option("header", True).csv(path)


def _from_files(spark: SparkSession, path, parse, schema: str, pattern: str | None = None) -> DataFrame:
    """Rows of ``parse(file name, bytes)`` over whole files; a file meets one task."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader

    def run(frames):
        for pdf in frames:
            rows = [row for name, content in zip(pdf["path"], pdf["content"], strict=True) for row in parse(name.rsplit("/", 1)[-1], bytes(content))]
            yield pd.DataFrame(rows, columns=[f.strip().split(" ")[0] for f in schema.split(";")])

    return reader.load(path).select("path", "content").mapInPandas(run, schema.replace(";", ","))


def text_files(spark: SparkSession, path, encodings: tuple[str, ...] = ("utf-8-sig", "gbk"), pattern: str | None = None) -> DataFrame:
    """file, text: decoded by the first encoding that fits, else by the last with replacement signs."""

    def parse(name: str, content: bytes):
        for e in encodings:
            try:
                return [(name, content.decode(e))]
            except UnicodeDecodeError:
                pass
        return [(name, content.decode(encodings[-1], "replace"))]

    return _from_files(spark, path, parse, "file string; text string", pattern)


def second_row(spark: SparkSession, path, pattern: str = "*.csv") -> DataFrame:
    """file, cells (map of header to cell) of the second data row of each CSV file; files without one give none."""

    def parse(name: str, content: bytes):
        rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"))))
        return [(name, dict(zip(rows[0], rows[2], strict=False)))] if len(rows) > 2 else []

    return _from_files(spark, path, parse, "file string; cells map<string,string>", pattern)


def first_sheet(spark: SparkSession, path, pattern: str = "*.xlsx") -> DataFrame:
    """file, row (from 0), cells (array of text, null where empty) of the first sheet of each workbook."""

    def parse(name: str, content: bytes):
        import re
        import zipfile
        from xml.etree import ElementTree as ET

        with zipfile.ZipFile(io.BytesIO(content)) as z:
            text_of = lambda e: "".join(t.text or "" for t in e.iter() if t.tag.endswith("}t"))
            have = set(z.namelist())
            shared = [text_of(e) for e in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in have else []
            sheets = sorted((n for n in have if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
            out = []
            for row in (e for e in ET.fromstring(z.read(sheets[0])).iter() if e.tag.endswith("}row")) if sheets else ():
                cells: dict[int, str] = {}
                for c in row:
                    at = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", "")).group():
                        at = at * 26 + ord(ch) - 64
                    at = at - 1 if at else len(cells)
                    value = next((e.text for e in c if e.tag.endswith("}v")), None)
                    cells[at] = text_of(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value is not None else value
                out.append((name, len(out), [cells.get(i) for i in range(max(cells, default=-1) + 1)]))
        return out

    return _from_files(spark, path, parse, "file string; row int; cells array<string>", pattern)


def file_list(spark: SparkSession, path, pattern: str = "*") -> DataFrame:
    """path, file, length of the files below a folder; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")


def done_keys(spark: SparkSession, path) -> DataFrame:
    """The distinct first fields of an output's lines, to resume behind them."""
    return spark.read.text(path).select(F.trim(F.split_part("value", F.lit(","), F.lit(1))).alias("key")).where("key <> ''").distinct()


def ordered_lines(spark: SparkSession, path) -> DataFrame:
    """place (from 0), value of the non-blank lines of small list files, in order."""
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("place", "value"))
