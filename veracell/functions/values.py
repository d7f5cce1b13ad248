"""Column expressions for cell values: nulls, coercion, normal forms."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Strings that stand for a missing value (compared after trimming).
SENTINEL_NULLS = [
    "", "N/A", "n/a", "NA", "na", "NULL", "null", "None", "none", "MISSING", "missing", ".", "..",
    "---", "-", "NaN", "nan", "NaT", "-999", "-9999", "9999", "99999", "-1", "999", "888", "777",
    "UNK", "unk", "UNKNOWN", "unknown", "NOT AVAILABLE", "not available", "NOT APPLICABLE",
    "not applicable", "ND", "nd",
]
# Spellings of true and false.
TRUE_WORDS = ["true", "yes", "1", "y", "t"]
FALSE_WORDS = ["false", "no", "0", "n", "f"]
# Date shapes, matched from the start of the value.
DATE_SHAPES = [
    r"^\d{4}-\d{2}-\d{2}",
    r"^\d{2}/\d{2}/\d{4}",
    r"^\d{2}-\d{2}-\d{4}",
    r"^\d{4}/\d{2}/\d{2}",
    r"^\d{2}\w{3}\d{4}",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}",
]
# Formats tried in turn when a date string is parsed.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "ddMMMyyyy",
]
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPACES = " \t\r\n\f"

NUMERIC_TYPES = (T.NumericType,)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    c = col(name)
    return nan_to_null(c) if isinstance(df.schema[name].dataType, FLOAT_TYPES) else c


def as_text(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("string")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    t = strip(c.cast("string"))
    return F.when(t.rlike(NUMBER_SHAPE), t.try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """The column as double, coerced only where its type is not numeric already."""
    if is_numeric(df, name):
        return present(df, name).cast("double")
    return to_number(col(name))


def to_boolean(c: Column) -> Column:
    t = F.lower(strip(c.cast("string")))
    return F.when(t.isin(TRUE_WORDS), F.lit(True)).when(t.isin(FALSE_WORDS), F.lit(False))


def to_datetime(c: Column) -> Column:
    t = strip(c.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS])


def iso_date(c: Column) -> Column:
    return F.date_format(to_datetime(c), "yyyy-MM-dd")


def normal_category(c: Column) -> Column:
    t = F.lower(strip(c.cast("string")))
    return F.when(~t.isin("nan", "none"), t)


def is_sentinel(c: Column) -> Column:
    return strip(c).isin(SENTINEL_NULLS)


def text_number(c: Column) -> Column:
    """A double written as text, without the exponent form for everyday magnitudes."""
    return c.cast("string")


def let(value: Column, body) -> Column:
    """Bind an expression to a lambda variable, so that inner lambdas do not evaluate it again."""
    return F.transform(F.array(value), body)[0]
