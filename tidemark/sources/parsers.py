"""Payload parsers: raw text columns to (series columns..., event_time, value) rows.

Each takes a DataFrame with a string column ``raw`` (one payload a row) and
keeps its other columns. Rows that cannot be read are dropped, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(text: Column | str) -> Column:
    """A decimal with a point or a comma."""
    t = F.col(text) if isinstance(text, str) else text
    return F.try_cast(F.regexp_replace(F.trim(t), ",", "."), "double") if hasattr(F, "try_cast") else F.regexp_replace(F.trim(t), ",", ".").try_cast("double")


def strip_accents(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    marked, plain = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"
    return F.translate(F.lower(text), marked, plain)


def _clean(df: DataFrame) -> DataFrame:
    return df.where(F.col("event_time").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def _items(df: DataFrame, schema: str, path: str | None = None) -> DataFrame:
    parsed = F.from_json("raw", schema)
    return df.withColumn("_i", F.explode(parsed[path] if path else parsed)).drop("raw")


def sgs(df: DataFrame) -> DataFrame:
    """[{data: dd/MM/yyyy, valor: text}]"""
    return _clean(_items(df, "array<struct<data: string, valor: string>>").select(*[c for c in df.columns if c != "raw"], F.try_to_timestamp("_i.data", F.lit("dd/MM/yyyy")).cast("date").alias("event_time"), number("_i.valor").alias("value")))


def fred(df: DataFrame) -> DataFrame:
    """{observations: [{date, value}]}; a point is a missing value."""
    rows = _items(df, "observations array<struct<date: string, value: string>>", "observations")
    return _clean(rows.select(*[c for c in df.columns if c != "raw"], F.col("_i.date").try_cast("date").alias("event_time"), F.col("_i.value").try_cast("double").alias("value")))


def fred_vintages(df: DataFrame) -> DataFrame:
    """Every vintage a row: knowledge_time and vintage_id are the start of its real-time span."""
    rows = _items(df, "observations array<struct<date: string, realtime_start: string, realtime_end: string, value: string>>", "observations")
    start = F.col("_i.realtime_start")
    return _clean(rows.select(*[c for c in df.columns if c != "raw"], F.col("_i.date").try_cast("date").alias("event_time"), start.try_cast("timestamp_ntz").alias("knowledge_time"), start.alias("vintage_id"), F.col("_i.value").try_cast("double").alias("value")))


def focus(df: DataFrame, statistic: str = "Mediana") -> DataFrame:
    """{value: [{Indicador, Data, Media, Mediana}]}"""
    rows = _items(df, "value array<struct<Indicador: string, Data: string, Media: double, Mediana: double>>", "value")
    return _clean(rows.select(*[c for c in df.columns if c != "raw"], F.col("_i.Indicador").alias("indicator"), F.col("_i.Data").try_cast("date").alias("event_time"), F.col(f"_i.{statistic}").alias("value")))


def cot(df: DataFrame) -> DataFrame:
    """Net non-commercial position, long less short; a row with an unreadable leg is dropped."""
    rows = _items(df, "array<struct<report_date_as_yyyy_mm_dd: string, noncomm_positions_long_all: string, noncomm_positions_short_all: string>>")
    net = F.col("_i.noncomm_positions_long_all").try_cast("double") - F.col("_i.noncomm_positions_short_all").try_cast("double")
    return _clean(rows.select(*[c for c in df.columns if c != "raw"], F.substring("_i.report_date_as_yyyy_mm_dd", 1, 10).try_cast("date").alias("event_time"), net.alias("value")))


def ipeadata(df: DataFrame) -> DataFrame:
    """{value: [{VALDATA with offset, VALVALOR}]}, snapped to the month end."""
    rows = _items(df, "value array<struct<VALDATA: string, VALVALOR: double>>", "value")
    day = F.last_day(F.try_to_timestamp(F.col("_i.VALDATA")))
    return _clean(rows.select(*[c for c in df.columns if c != "raw"], day.alias("event_time"), F.col("_i.VALVALOR").alias("value")))


def single_entity(df: DataFrame, schema: str) -> DataFrame:
    """A bare JSON object or an OData list of one, as the struct ``entity``."""
    listed = F.from_json("raw", f"value array<struct<{schema}>>")["value"]
    bare = F.from_json("raw", schema)
    return df.withColumn("entity", F.when(F.size(listed) > 0, F.get(listed, F.lit(0))).otherwise(bare)).drop("raw")


def verified_metadata(df: DataFrame, must: list[str], must_not: list[str], columns: list[str]) -> DataFrame:
    """``df`` with verified: all of ``must`` and none of ``must_not`` occur in the accent-free text of ``columns``."""
    text = strip_accents(F.concat_ws(" ", *columns))
    has = lambda words: [F.contains(text, F.lit(w)) for w in words]
    fine = F.lit(True)
    for c in has(must):
        fine = fine & c
    for c in has(must_not):
        fine = fine & ~c
    return df.withColumn("verified", fine)


BONDS = ("Tesouro IPCA+", "Tesouro IPCA+ com Juros Semestrais")


def treasury_lines(df: DataFrame) -> DataFrame:
    """Rows (title, maturity, base, rate, ttm_years) of the ``;``-separated price file, read with its header as columns, for the inflation-linked bonds."""
    day = lambda c: F.try_to_timestamp(F.col(f"`{c}`"), F.lit("dd/MM/yyyy")).cast("date")
    rows = df.where(F.col("`Tipo Titulo`").isin(*BONDS)).select(F.col("`Tipo Titulo`").alias("title"), day("Data Vencimento").alias("maturity"), day("Data Base").alias("base"), number(F.col("`Taxa Compra Manha`")).alias("rate"))
    return rows.withColumn("ttm_years", F.datediff("maturity", "base") / 365.25).where("ttm_years > 0 AND rate IS NOT NULL")


def constant_maturity(lines: DataFrame, tenor: float, reach: float = 1.5) -> DataFrame:
    """(base, value): each day's rate at ``tenor`` years, linear between the bracketing maturities, an exact hit as it is, else the nearest within ``reach`` held flat.

    A conditional aggregation: a day of any number of bonds sends one row a task.
    """
    t, y = F.col("ttm_years"), F.col("rate")
    low, high = F.when(t <= tenor, t), F.when(t >= tenor, t)
    g = lines.groupBy("base").agg(F.max(low).alias("tl"), F.max_by(y, low).alias("yl"), F.min(high).alias("th"), F.min_by(y, high).alias("yh"))
    inner = F.when(F.col("tl") == F.col("th"), F.col("yl")).otherwise(F.col("yl") + (F.col("yh") - F.col("yl")) * (tenor - F.col("tl")) / (F.col("th") - F.col("tl")))
    below, above = F.col("tl").isNotNull() & (tenor - F.col("tl") <= reach), F.col("th").isNotNull() & (F.col("th") - tenor <= reach)
    value = F.when(F.col("tl").isNotNull() & F.col("th").isNotNull(), inner).when(below, F.col("yl")).when(above, F.col("yh"))
    return g.select("base", value.alias("value")).where("value is not null")


DATE_NAMES = ("Date", "date", "observation_date", "data")


def engine_csv(df: DataFrame) -> DataFrame:
    """(event_time, value) of a CSV frame of strings: the date column is found by name (else the first), the first other column is the value."""
    at = next((c for c in DATE_NAMES if c in df.columns), df.columns[0])
    value = next(c for c in df.columns if c != at)
    return _clean(df.select(F.col(f"`{at}`").try_cast("date").alias("event_time"), F.col(f"`{value}`").try_cast("double").alias("value")))


def csv_folder(spark, path: str, only: list[str] | None = None) -> DataFrame:
    """(series_id, event_time, value) of a folder of two-column CSV files, the file name being the series."""
    rows = spark.read.option("header", True).schema("event_time string, value string").csv(path).withColumn("series_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    rows = rows.where(F.col("series_id").isin(*only)) if only else rows
    return _clean(rows.select("series_id", F.col("event_time").try_cast("date").alias("event_time"), F.col("value").try_cast("double").alias("value")))


def first_available(df: DataFrame, key: str, at: str, value: str, source: str, priority: list[str]) -> DataFrame:
    """For each key the rows of the first source of ``priority`` that has any; sources are never mixed within a key."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(source))
    ranked = df.where((rank > 0) & F.col(value).isNotNull()).withColumn("_rank", rank)
    best = ranked.groupBy(key).agg(F.min("_rank").alias("_best"))
    return ranked.join(best, key).where("_rank = _best").select(key, at, value, source)


def commodity_index(df: DataFrame, at: str, name: str, value: str, weights: dict[str, float]) -> DataFrame:
    """(at, index): members rebased to 100 at their first value, over complete times, weights renormalised over the members there are."""
    w = F.create_map(*(F.lit(x) for item in weights.items() for x in item))
    own = df.where(F.col(name).isin(*weights) & F.col(value).isNotNull())
    first = own.groupBy(name).agg(F.min_by(value, at).alias("_first"))
    rows = own.join(first, name).withColumn("_v", 100 * F.col(value) / F.col("_first")).withColumn("_w", F.element_at(w, F.col(name)))
    total = first.agg(F.count("*").alias("_n"))
    g = rows.groupBy(at).agg(F.count("*").alias("_k"), (F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("index"))
    return g.crossJoin(F.broadcast(total)).where("_k = _n").select(at, "index")  # total has one row


def extrapolated_ppp(last: DataFrame, inflation: DataFrame) -> DataFrame:
    """(year, ppp): the last known factor carried on by relative inflation. ``last`` has one row (year, ppp), ``inflation`` (year, home, abroad) as fractions."""
    rows = inflation.crossJoin(F.broadcast(last.select(F.col("year").alias("_y"), F.col("ppp").alias("_p")))).where(F.col("year") > F.col("_y"))
    from pyspark.sql import Window

    ratio = F.product((1 + F.col("home")) / (1 + F.col("abroad"))).over(Window.partitionBy("_y").orderBy("year").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("year", (F.col("_p") * ratio).alias("ppp"))
