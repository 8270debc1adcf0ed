"""Named tables from files of several formats or from the catalog."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions import fixed
from tabgauge.functions.columns import ref

_FORMATS = {"parquet": "parquet", "orc": "orc", "json": "json", "jsonl": "json", "csv": "csv"}

_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_TRUTH = r"^(true|True|TRUE|false|False|FALSE)$"


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table from a file or folder, by the ending of its name."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in _FORMATS:
        raise ValueError(f"unsupported file format: {ending}")
    if ending == "csv":
        return read_csv(spark, path, **options)
    return spark.read.format(_FORMATS[ending]).options(**options).load(path)


def load_tables(spark: SparkSession, sources: dict[str, str] | str, **options) -> dict[str, DataFrame]:
    """Several named tables: a mapping of names to paths, or a folder of files.

    The folder may be in any storage that Spark reaches.
    """
    if isinstance(sources, str):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sources)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(status.getPath().getName() for status in files.listStatus(place))
        sources = {
            name.rsplit(".", 1)[0]: f"{sources.rstrip('/')}/{name}"
            for name in names
            if name.rsplit(".", 1)[-1].lower() in _FORMATS
        }
    return {name: load_table(spark, path, **options) for name, path in sources.items()}


def catalog_tables(spark: SparkSession, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.table(name) for name in names}


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    encoding: str = "UTF-8",
    multiline: bool = False,
    missing: tuple[str, ...] = fixed.MISSING_TOKENS,
) -> DataFrame:
    """Delimited text with a header; numbers and truth values are recognised.

    Types are decided on all rows in one aggregation, whose single row tells how
    many values of each column fit each type. Dates stay text, so that their
    format is assessed like any other text.

    Line breaks inside quotes need ``multiline=True``: such a file is read by one task,
    because a reader that starts in the middle cannot tell quoted breaks from others.
    Without it such a file is refused, as its rows would be split; a quote inside a field
    that does not begin with one is plain text. `broken_quotes` counts the lines.
    """
    if not multiline and not _open_lines(spark, path, sep, encoding).isEmpty():
        raise ValueError(f"{path} has line breaks inside quotes: read it with multiline=True")
    raw = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("nullValue", "")
        .csv(path)
    )
    names = raw.columns
    cleaned = raw.select(*[F.when(~ref(n).isin(*missing), ref(n)).alias(n) for n in names])
    counted = cleaned.agg(
        *[
            column.alias(f"{kind}{i}")
            for i, n in enumerate(names)
            for kind, column in {
                "all": F.count(ref(n)),
                "whole": F.count(F.when(ref(n).rlike(_WHOLE), F.trim(ref(n)).try_cast("bigint"))),
                "decimal": F.count_if(ref(n).rlike(_DECIMAL)),
                "truth": F.count_if(ref(n).rlike(_TRUTH)),
            }.items()
        ]
    ).first()
    typed = []
    for i, name in enumerate(names):
        total = counted[f"all{i}"]
        value = F.trim(ref(name))
        if total == 0 or (counted[f"decimal{i}"] == total and counted[f"whole{i}"] < total):
            typed.append(value.cast("double").alias(name))
        elif counted[f"whole{i}"] == total:
            typed.append(value.cast("bigint").alias(name))
        elif counted[f"truth{i}"] == total:
            typed.append(value.cast("boolean").alias(name))
        else:
            typed.append(ref(name))
    return cleaned.select(*typed)


def _open_lines(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """Lines with an odd number of quotes, one of them at the beginning of a field."""
    opens = F.col("value").rlike(rf'(^|{re.escape(sep)})\s*"')
    return _odd_lines(spark, path, encoding).where(opens)


def _odd_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    lines = spark.read.option("encoding", encoding).text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.where(quotes % 2 == 1)


def broken_quotes(spark: SparkSession, path: str, encoding: str = "UTF-8") -> int:
    """Lines with an odd number of quotes: parts of rows that have line breaks inside quotes."""
    return _odd_lines(spark, path, encoding).count()


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Store a result; the format follows the ending of the name."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in _FORMATS:
        raise ValueError(f"unsupported file format: {ending}")
    if ending == "csv":
        df = df.select(
            *[
                F.to_json(ref(f.name)).alias(f.name)
                if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
                else ref(f.name)
                for f in df.schema.fields
            ]
        )
    writer = df.write.format(_FORMATS[ending]).mode(mode)
    if ending == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
