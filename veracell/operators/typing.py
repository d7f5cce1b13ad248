"""Column typing: hidden nulls, boolean / numeric / date / identifier / text detection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veracell.functions import values as V
from veracell.functions.hashing import fingerprint

# Name parts that mark an identifier column.
ID_WORDS = ["id", "code", "key", "number", "num", "no", "idx", "index"]
# Impossible values by name family: name parts, lowest and highest possible value.
IMPOSSIBLE_RULES = [
    (["age"], 0, 150),
    (["hr", "heart_rate", "heartrate", "pulse"], 0, 400),
    (["sbp", "systolic", "sys_bp", "dbp", "diastolic", "dia_bp", "bp"], 0, 400),
    (["temp", "temperature"], 20, 115),
    (["weight", "wt", "mass"], 0, 700),
    (["height", "ht", "stature"], 0, 300),
    (["count", "dose", "volume", "duration", "length", "width"], 0, None),
]
COLUMNS_PER_PASS = 40


def simple_columns(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def long_summary(df: DataFrame, metrics: dict[str, dict[str, Column]]) -> DataFrame:
    """Aggregate many columns in wide passes without a shuffle of rows; one line per column.

    ``metrics`` maps column name to named aggregates; every column has the same metric names.
    """
    names = list(metrics)
    out = None
    for start in range(0, len(names), COLUMNS_PER_PASS):
        part = names[start:start + COLUMNS_PER_PASS]
        wide = df.agg(*[expr.alias(f"{i}_{m}") for i, c in enumerate(part)
                        for m, expr in metrics[c].items()])
        lines = F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(start + i).alias("position"),
                     *[F.col(f"{i}_{m}").alias(m) for m in metrics[c]])
            for i, c in enumerate(part)])
        long = wide.select(F.inline(lines))
        out = long if out is None else out.unionByName(long)
    return out


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, unique_count) over non-null values; the shuffle carries 16 bytes a value."""
    lines = F.array(*[
        F.struct(F.lit(i).alias("i"), fp.h1.alias("h1"), fp.h2.alias("h2"),
                 V.present(df, c).isNotNull().alias("ok"))
        for i, c in enumerate(columns) for fp in [fingerprint(V.as_text(df, c))]])
    counted = (df.select(F.inline(lines)).groupBy("i")
               .agg(F.count_distinct(F.when(F.col("ok"), F.col("h1")),
                                     F.when(F.col("ok"), F.col("h2"))).alias("unique_count")))
    names = F.array(*map(F.lit, columns))
    return counted.select(F.element_at(names, F.col("i") + 1).alias("column_name"),
                          "unique_count")


def hidden_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sentinel strings per string column: how many cells, which patterns."""
    columns = columns or [f.name for f in df.schema.fields
                          if isinstance(f.dataType, T.StringType)]
    return long_summary(df, {c: _hidden(V.col(c)) for c in columns}).drop("position")


def _hidden(c: Column) -> dict[str, Column]:
    return {
        "hidden_null_count": F.count_if(V.is_sentinel(c)),
        "hidden_null_patterns": F.array_sort(F.collect_set(F.when(V.is_sentinel(c), V.strip(c)))),
    }


def _flag_metrics(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(only true/false spellings, how many of them); a double is never a flag."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(False), F.lit(0)
    if isinstance(kind, T.IntegralType):
        c = V.col(name)
        kinds = F.size(F.collect_set(F.when(c.isin(0, 1), c)))
        return F.coalesce(F.bool_and(c.isin(0, 1)), F.lit(False)), kinds
    flags = V.TRUE_WORDS + V.FALSE_WORDS
    word = F.lower(V.strip(V.as_text(df, name)))
    return (F.coalesce(F.bool_and(word.isin(flags)), F.lit(False)),
            F.size(F.collect_set(F.when(word.isin(flags), word))))


def _type_metrics(df: DataFrame, name: str) -> dict[str, Column]:
    """Aggregates that decide a column's type; values are parsed only where the column is text."""
    kind = df.schema[name].dataType
    is_string = isinstance(kind, T.StringType)
    c, text = V.present(df, name), V.as_text(df, name)
    only_flags, flag_kinds = _flag_metrics(df, name)
    none = {"hidden_null_count": F.lit(0).cast("long"),
            "hidden_null_patterns": F.array().cast("array<string>")}
    numeric, dates, length = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    if V.is_numeric(df, name):
        numeric = F.lit(1.0)
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        dates = F.lit(1.0)
    elif is_string:
        numeric = F.avg(F.when(text.isNotNull(), V.to_number(text).isNotNull().cast("double")))
        dates = F.least(sum((F.avg(text.rlike(p).cast("double")) for p in V.DATE_SHAPES),
                            F.lit(0.0)), F.lit(1.0))
        length = F.avg(F.length(text))
    return {
        "row_count": F.count(F.lit(1)),
        "null_count": F.count_if(c.isNull()),
        **(_hidden(text) if is_string else none),
        "only_flags": only_flags,
        "flag_kinds": flag_kinds,
        "numeric_ratio": F.coalesce(numeric, F.lit(0.0)),
        "date_ratio": F.coalesce(dates, F.lit(0.0)),
        "mean_length": F.coalesce(length, F.lit(0.0)),
        "is_text": F.lit(is_string),
    }


def infer_schema(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One line per column: type, confidence, mixed share, nulls, hidden nulls, cardinality."""
    columns = columns or simple_columns(df)
    stats = long_summary(df, {c: _type_metrics(df, c) for c in columns})
    stats = stats.join(F.broadcast(distinct_counts(df, columns)), "column_name", "left")
    filled = F.col("row_count") - F.col("null_count")
    name = F.lower("column_name")
    has_id_word = F.lit(False)
    for w in ID_WORDS:
        has_id_word = has_id_word | name.contains(w)
    share = F.col("unique_count") / F.nullif(filled, F.lit(0))
    kind = (
        F.when(filled == 0, "unknown")
        .when(F.col("only_flags") & (F.col("flag_kinds") <= 4), "boolean")
        .when(F.col("numeric_ratio") > 0.9, "numeric")
        .when(F.col("date_ratio") > 0.7, "datetime")
        .when(has_id_word & (share > 0.8), "identifier")
        .when(F.col("is_text") & (F.col("mean_length") > 50) & (share > 0.8), "free_text")
        .otherwise("categorical")
    )
    t = F.col("inferred_type")
    return (
        stats.withColumn("inferred_type", kind)
        .select(
            "position", "column_name", "inferred_type",
            F.when(t == "unknown", 0.0).when(t == "boolean", 0.95)
            .when(t == "numeric", F.col("numeric_ratio"))
            .when(t == "datetime", F.col("date_ratio"))
            .when(t == "identifier", 0.85).otherwise(0.8).alias("type_confidence"),
            F.when(t == "numeric", F.col("numeric_ratio") < 1.0)
            .when(t == "datetime", F.col("date_ratio") < 0.95)
            .otherwise(F.lit(False)).alias("mixed_type"),
            F.when(t == "numeric", 1.0 - F.col("numeric_ratio"))
            .when(t == "datetime", 1.0 - F.col("date_ratio"))
            .otherwise(0.0).alias("mixed_type_proportion"),
            "row_count", "null_count",
            (F.col("null_count") / F.nullif(F.col("row_count"), F.lit(0))).alias("nullity_rate"),
            "hidden_null_count", "hidden_null_patterns",
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            (F.coalesce("unique_count", F.lit(0)) / F.nullif(F.col("row_count"), F.lit(0)))
            .alias("cardinality_ratio"),
            "mean_length",
        )
    )


def dataset_summary(schema: DataFrame) -> DataFrame:
    """Rows, columns, overall nullity with hidden nulls, and the share of each type."""
    cells = F.sum("row_count")
    one = schema.agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("col_count"),
        (F.sum(F.col("null_count") + F.col("hidden_null_count")) / cells)
        .alias("overall_nullity"))
    kinds = schema.groupBy("inferred_type").agg(F.count(F.lit(1)).alias("type_columns"))
    return kinds.crossJoin(F.broadcast(one)).withColumn(
        "type_share", F.col("type_columns") / F.col("col_count"))


def head_sample(df: DataFrame, column: str, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` non-null values in key order."""
    return (df.where(V.present(df, column).isNotNull()).orderBy(key).limit(n)
            .select(key, V.col(column).alias("sample_value")))


def impossible_rules(columns: list[str], rules=None) -> list[tuple[str, float, float]]:
    """(column, lowest, highest) for each rule whose name parts occur in a column name."""
    out = []
    for c in columns:
        for words, low, high in rules or IMPOSSIBLE_RULES:
            if any(w in c.lower() for w in words):
                out.append((c, low, high))
    return out


def _breaks(value: Column, low, high) -> Column:
    cond = F.lit(False)
    if low is not None:
        cond = cond | (value < low)
    if high is not None:
        cond = cond | (value > high)
    return F.coalesce(cond, F.lit(False))


def impossible_values(df: DataFrame, rules: list[tuple[str, float, float]]) -> DataFrame:
    """Cells that break a rule, as (column_name, value): a projection, no shuffle."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), V.number(df, c).alias("value"),
                 _breaks(V.number(df, c), low, high).alias("bad"))
        for c, low, high in rules])
    return (df.select(F.inline(F.filter(cells, lambda s: s.bad))).drop("bad"))


def impossible_counts(df: DataFrame, rules: list[tuple[str, float, float]]) -> DataFrame:
    """Broken cells per ruled column, zero included; one wide aggregate."""
    by_column: dict[str, list] = {}
    for c, low, high in rules:
        by_column.setdefault(c, []).append(F.count_if(_breaks(V.number(df, c), low, high)))
    return long_summary(df, {c: {"impossible_count": sum(counts[1:], counts[0])}
                             for c, counts in by_column.items()}).drop("position")
