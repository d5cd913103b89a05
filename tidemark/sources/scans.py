"""Scans that survive bad input: what cannot be read is set aside with its file and a reason, and all else is read.

A CSV file is read by the names in its own header.  Headers are looked at first
(a file's first line); files of one header are scanned together and the scans
are united by name, so a file with its columns in another order is read right
and a file without a needed column is set aside as a whole.  Lines with more or
fewer fields than their header, and lines that are no JSON, are set aside one by
one.  A folder that is not there is one more row.
"""

from __future__ import annotations

import csv as text_csv
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAULTS = "file string, line string, reason string"
POSITION = ["_file", "_block", "_pos"]
#: Name of the column that keeps a line which could not be read.
BROKEN = "_broken"


def positioned(df: DataFrame) -> DataFrame:
    """With file, block and row position: the order in which files hold their rows."""
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_pos": F.monotonically_increasing_id()})


@dataclass(frozen=True)
class Scan:
    """``rows`` that were read (None: no file at all), and ``faults`` (file, line, reason): line is NULL where a whole file or folder is meant."""

    rows: DataFrame | None
    faults: DataFrame


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a folder, file or pattern names anything."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def fault(spark: SparkSession, file: str, reason: str) -> DataFrame:
    return spark.createDataFrame([(file, None, reason)], FAULTS)


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FAULTS)


def headers(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file and header: the first line of each file, NULL where none can be read.  Lines are looked at as text only."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    lines = found.option("ignoreCorruptFiles", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("at"))
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    listed = found.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))  # names only
    return listed.join(first, "file", "left")


def names_of(header: str) -> list[str]:
    """Column names of a header line; a repeated name gets a number."""
    seen: dict[str, int] = {}
    out = []
    for name in next(text_csv.reader([header.lstrip("﻿")]), []):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
    return out


def csv(spark: SparkSession, path: str, needed: list[str], extra: list[str] | None = None, glob: str = "*.csv") -> Scan:
    """Columns ``needed``, and ``extra`` ones where a file has them (None: all its columns), as text with their positions.

    Files are grouped by header on the driver, which lists them for any scan.  A file that breaks off (a damaged gzip
    stream) is read up to there; one of which nothing can be read has no header.
    """
    by: dict[tuple[str, ...], list[str]] = defaultdict(list)
    bad = []
    for file, header in headers(spark, path, glob).collect():  # a row per file
        names = tuple(names_of(header)) if header else ()
        lack = sorted(set(needed) - set(names))
        if not names:
            bad.append((file, None, "no header"))
        elif lack:
            bad.append((file, None, f"missing columns: {', '.join(lack)}"))
        else:
            by[names].append(file)
    faults = spark.createDataFrame(sorted(bad), FAULTS)
    rows = []
    for names, same in sorted(by.items()):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, BROKEN)])
        reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
        # whole lines are taken apart, or a line with a field too many would pass where the query names few columns
        part = positioned(reader.option("columnPruning", False).option("ignoreCorruptFiles", True).csv(sorted(same)))
        keep = [n for n in names if n in needed or extra is None or n in extra]
        whole = F.col(BROKEN).isNull() & (F.length(F.concat_ws("", F.col(f"`{names[0]}`"))) >= 0)  # a reader must be asked for more than the broken lines
        rows.append(part.where(whole).select(*(F.col(f"`{n}`") for n in keep), *POSITION))
        wrong = F.format_string(f"not {len(names)} fields, the first is %s", F.coalesce(F.col(f"`{names[0]}`"), F.lit("blank")))
        faults = faults.unionByName(part.where(F.col(BROKEN).isNotNull()).select(F.col("_file").alias("file"), F.col(BROKEN).alias("line"), wrong.alias("reason")))
    return Scan(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows) if rows else None, faults)


#: Names of JSON Lines, files or folders of parts.
JSON_NAMES = r"\.json[a-z]*(\.[a-z0-9]+)?(/|$)"


def json_lines(spark: SparkSession, path: str, schema: str, names: str = JSON_NAMES) -> Scan:
    """JSON Lines below ``path`` by a fixed schema; blank lines are skipped.

    Each line is taken apart whole, whatever columns a query names, so a line is broken for all queries or for none.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(F.col("_metadata.file_path").rlike(names))
    kind = T.StructType([*T.StructType.fromDDL(schema), T.StructField(BROKEN, T.StringType())])
    parsed = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    found = positioned(lines.where(F.trim("value") != "")).select(parsed.alias("_row"), *POSITION)
    why = F.when(F.to_json(F.col("_row").dropFields(BROKEN)) == "{}", "no JSON of the schema").otherwise("JSON with a value of another kind")
    rows = found.where(F.col(f"_row.{BROKEN}").isNull()).select("_row.*", *POSITION).drop(BROKEN)
    return Scan(rows, found.where(F.col(f"_row.{BROKEN}").isNotNull()).select(F.col("_file").alias("file"), F.col(f"_row.{BROKEN}").alias("line"), why.alias("reason")))
