"""Readers by format and sinks for result tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veracell.functions.session import scratch_path


def read_table(spark: SparkSession, path: str, fmt: str | None = None, strings: bool = True,
               json_lines: bool = False, multi_line: bool = True) -> DataFrame:
    """CSV, TSV, JSON or Parquet by extension; refuses empty and one-column tables.

    Line breaks inside quotes belong to their cell. Such a file is read by one task; for large
    files without them, ``multi_line=False`` lets Spark split each file.

    Text formats are read as strings in one pass, and column types are decided by
    ``operators.typing``; with ``strings`` off, Spark's own inference takes an extra pass.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt in ("csv", "tsv"):
        df = (spark.read.option("header", True).option("sep", "\t" if fmt == "tsv" else ",")
              .option("inferSchema", not strings).option("quote", '"').option("escape", '"')
              .option("multiLine", multi_line).csv(path))
    elif fmt == "json":
        reader = spark.read.option("multiLine", not json_lines)
        df = reader.option("primitivesAsString", strings).json(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return check_input(df)


def check_input(df: DataFrame) -> DataFrame:
    if len(df.columns) < 2:
        raise ValueError("a table needs at least two columns")
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def write_table(df: DataFrame, path: str, fmt: str) -> str:
    if fmt in ("csv", "tsv"):
        (df.write.mode("overwrite").option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("sep", "\t" if fmt == "tsv" else ",").csv(path))
    elif fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def round_trip(df: DataFrame, fmt: str) -> DataFrame:
    """Write to the shared scratch folder and read back."""
    path = scratch_path(df.sparkSession, "roundtrip")
    write_table(df, path, fmt)
    return read_table(df.sparkSession, path, fmt, json_lines=True)


# ---- result sinks ------------------------------------------------------------------------------

def anomaly_log(anomalies: DataFrame) -> DataFrame:
    """Flat anomaly table for export."""
    return anomalies.select(
        F.col("row_id").cast("string").alias("row_index"), "anomaly_type", "severity",
        F.format_string("%.3f", F.col("confidence").cast("double")).alias("confidence"),
        F.concat_ws("; ", "flagged_columns").alias("flagged_columns"), "rationale")


def audit_log(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        "transaction_id", F.col("timestamp").cast("string").alias("timestamp"),
        F.col("row_id").cast("string").alias("row_index"), "column_name", "original_value",
        "new_value", "action", "method_trigger", "risk_level", "rationale")


def method_log(methods: DataFrame) -> DataFrame:
    four = [F.format_string("%.4f", F.col(c).cast("double")).alias(c)
            for c in ("composite", "ndc", "ad", "ss", "cp", "ex", "cc")]
    return methods.select("method", *four, "anomaly_count", "duration_ms", "selected")


def write_logs(path: str, anomalies: DataFrame, methods: DataFrame,
               ledger: DataFrame | None = None) -> dict[str, str]:
    """The anomaly log, the method table and the audit log as CSV folders under ``path``."""
    logs = {"anomaly_log": anomaly_log(anomalies), "method_benchmarks": method_log(methods)}
    if ledger is not None:
        logs["audit_log"] = audit_log(ledger)
    return {name: write_table(df, f"{path.rstrip('/')}/{name}", "csv")
            for name, df in logs.items()}


def write_results(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Result tables as parquet, partitioned by run."""
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id") \
            .parquet(f"{path.rstrip('/')}/{name}")


def as_json(df: DataFrame, **short: str) -> DataFrame:
    """One JSON line per row, columns renamed to short keys (new=old) and doubles rounded."""
    fields = short or {c: c for c in df.columns}
    cols = [F.round(c, 4).alias(k) if df.schema[c].dataType.simpleString() == "double"
            else F.col(c).alias(k) for k, c in fields.items()]
    return df.select(F.to_json(F.struct(*cols)).alias("json"))
