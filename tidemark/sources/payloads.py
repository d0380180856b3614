"""Stored payloads as a source: a registry of parsers by source name, a Spark data source that takes filters, and lines that cannot be read put aside.

Payloads lie as ``<root>/<source>/<series_id>/<anything>.json``. ``read`` parses them
with Spark's own readers and works on any store. ``PayloadSource`` is a Spark data source
for roots that all executors mount: it answers filters on the series by not opening
other folders, and filters on the date before a row reaches Spark.
"""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from . import parsers

#: Parsers of a column ``raw`` by source; ``register`` adds others.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"BCB_SGS": parsers.sgs, "FRED": parsers.fred, "FRED_VINTAGES": parsers.fred_vintages, "BCB_FOCUS": parsers.focus, "CFTC_COT": parsers.cot}
ROWS = "series_id string, event_time date, value double"


def register(source: str, parse: Callable[[DataFrame], DataFrame]) -> None:
    """Make ``parse`` the parser of a source."""
    ADAPTERS[source] = parse


def adapter_for(source: str) -> Callable[[DataFrame], DataFrame]:
    """The parser of a source; KeyError names those there are."""
    if source not in ADAPTERS:
        raise KeyError(f"no adapter for {source}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[source]


def read(spark: SparkSession, root: str, source: str) -> DataFrame:
    """The parsed rows of all payloads of a source, with their series_id."""
    files = spark.read.text(f"{root}/{source}/*", wholetext=True).withColumn("series_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return adapter_for(source)(files.withColumnRenamed("value", "raw"))


@dataclass
class Payload(InputPartition):
    path: str
    series_id: str


def _items(source: str, text: str) -> Iterator[tuple[str, str]]:
    """(date, value) texts of a payload; nothing where it cannot be read."""
    try:
        found = json.loads(text)
        if source == "BCB_SGS":
            for x in found:
                day, month, year = x["data"].split("/")
                yield f"{year}-{month}-{day}", x["valor"].replace(",", ".")
        else:
            for x in found["observations"]:
                yield x["date"], x["value"]
    except (ValueError, KeyError, TypeError, AttributeError):
        return


class PayloadReader(DataSourceReader):
    """One partition for each file of the wanted series."""

    BOUNDS = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}

    def __init__(self, root: str, source: str):
        self.root, self.source = root.removeprefix("file://"), source
        self.series: set[str] | None = None
        self.bounds: list[tuple[type, datetime.date]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take filters on the series and the date; the others go back to Spark."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("series_id",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.series = wanted if self.series is None else self.series & wanted
            elif name == ("event_time",) and type(f) in self.BOUNDS and isinstance(f.value, datetime.date):
                self.bounds.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        root = os.path.join(self.root, self.source)
        folders = sorted(d for d in os.listdir(root) if self.series is None or d in self.series) if os.path.isdir(root) else []
        return [Payload(os.path.join(root, d, name), d) for d in folders for name in sorted(os.listdir(os.path.join(root, d))) if name.endswith(".json")]

    def read(self, partition: Payload) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as file:
            text = file.read()
        for day, value in _items(self.source, text):
            try:
                at, number = datetime.date.fromisoformat(day), float(value)
            except (TypeError, ValueError):
                continue
            if number == number and all(self.BOUNDS[kind](at, b) for kind, b in self.bounds):
                yield partition.series_id, at, number


class PayloadSource(DataSource):
    """``spark.read.format("payloads").option("path", root).option("source", name)``: rows (series_id, event_time, value)."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        if self.options.get("source") not in ("BCB_SGS", "FRED"):
            raise ValueError("a source of BCB_SGS or FRED")
        return PayloadReader(self.options["path"], self.options["source"])


def install(spark: SparkSession) -> None:
    """Make the data source known to a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)


def parsed_lines(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON lines as (rows that could be read, rows that could not): the first has the fields of ``schema`` for ``column``, the second the line and why.

    A line that is blank is neither. Other columns stay with their line. Both sides come from one parse,
    which a caller that uses both may want to write once.
    """
    corrupt = "_corrupt"
    others = [c for c in lines.columns if c != column]
    kinds = StructType.fromDDL(schema)
    parsed = F.from_json(column, f"{schema}, {corrupt} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    rows = lines.where(F.trim(F.coalesce(column, F.lit(""))) != "").withColumn("_row", parsed)
    missing = [f.name for f in kinds.fields if not f.nullable]
    lacks = F.array_compact(F.array(*(F.when(F.col(f"_row.{n}").isNull(), F.lit(f"no {n}")) for n in missing)))
    why = F.when(F.col(f"_row.{corrupt}").isNotNull(), F.array(F.lit("not readable"))).otherwise(lacks)
    rows = rows.withColumn("_why", why)
    good = rows.where(F.size("_why") == 0).select(*others, *(F.col(f"_row.{f.name}").alias(f.name) for f in kinds.fields))
    return good, rows.where(F.size("_why") > 0).select(*others, F.col(column).alias("line"), F.array_join("_why", ", ").alias("reason"))


def quarantine_stream(lines: DataFrame, schema: str, good_path: str, bad_path: str, checkpoint: str, column: str = "value"):
    """A stream of JSON lines into two Parquet tables: what could be read, and what could not. A batch that runs again replaces its own files."""

    def write(batch: DataFrame, k: int) -> None:
        good, bad = parsed_lines(batch, schema, column)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={k}")
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={k}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
