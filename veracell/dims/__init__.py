"""Built-in dictionaries (ranges, units, codes, vocabularies) and their lookup by column name.

The tables are metadata of a few hundred lines, kept as CSV text beside this module. Name
matching runs once per column name; values are checked on the rows by ``operators.semantics``.
"""
from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DATA = Path(__file__).parent / "data"


@dataclass(frozen=True)
class Range:
    name: str
    low: float
    high: float
    unit: str = ""
    category: str = ""
    critical_low: float | None = None
    critical_high: float | None = None
    normal_low: float | None = None
    normal_high: float | None = None
    sex: str | None = None
    age_group: str = "adult"
    child_low: float | None = None
    child_high: float | None = None
    loinc: str | None = None
    synonyms: tuple = field(default_factory=tuple)

    @property
    def hard_low(self) -> float:
        return self.low if self.critical_low is None else self.critical_low

    @property
    def hard_high(self) -> float:
        return self.high if self.critical_high is None else self.critical_high


@lru_cache(maxsize=None)
def table(name: str) -> tuple:
    with open(DATA / f"{name}.csv", encoding="utf-8") as f:
        return tuple(csv.DictReader(line for line in f if not line.startswith("#")))


def _num(text: str | None) -> float | None:
    return float(text) if text not in (None, "") else None


@lru_cache(maxsize=None)
def ranges(source: str = "plausible") -> tuple[Range, ...]:
    """Range dictionary ``plausible``, ``extreme`` or ``adult_child``."""
    numbers = ("low", "high", "critical_low", "critical_high", "normal_low", "normal_high",
               "child_low", "child_high")
    out = []
    for r in table(f"ranges_{source}"):
        values = {k: _num(r[k]) for k in numbers if k in r}
        out.append(Range(
            name=r["name"], unit=r["unit"], category=r["category"], sex=r.get("sex") or None,
            age_group=r.get("age_group") or "adult", loinc=r.get("loinc") or None,
            synonyms=tuple(s for s in r["synonyms"].split(";") if s), **values))
    return tuple(out)


def snake(name: str) -> str:
    """Lower case with every run of other characters as one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower().strip()).strip("_")


def _labels(r: Range) -> list[str]:
    return [snake(n) for n in (r.name, *r.synonyms)]


def _pick(found: list[Range], sex: str | None) -> Range | None:
    """The variant for the sex asked for, else the first."""
    same = [r for r in found if sex and r.sex == sex.upper()]
    return (same or found or [None])[0]


def _tiers_affix(name: str, label: str) -> int | None:
    if name == label:
        return 0
    if len(label) >= 3 and (name.startswith(label) or name.endswith(label)):
        return 1
    if len(label) >= 4 and label in name:
        return 2
    return None


def _tiers_word(name: str, label: str) -> int | None:
    if name == label:
        return 0
    if len(label) >= 4 and (name.startswith(label + "_") or name.endswith("_" + label)):
        return 1
    return None


def _tiers_substring(name: str, label: str) -> int | None:
    return 0 if name == label else 1 if label in name or name in label else None


MATCHERS = {"affix": _tiers_affix, "word": _tiers_word, "substring": _tiers_substring}


def all_ranges(column: str, dictionary=None, matcher: str = "affix") -> list[Range]:
    """Every variant of the best-matching entry: exact names first, then the looser tiers."""
    name, tier_of = snake(column), MATCHERS[matcher]
    best, best_tier, best_label = [], None, None
    for r in dictionary if dictionary is not None else ranges():
        for label in _labels(r):
            tier = tier_of(name, label)
            if tier is None or (best_tier is not None and tier > best_tier):
                continue
            if best_tier is None or tier < best_tier:
                best, best_tier, best_label = [r], tier, label
            elif label == best_label and r not in best:
                best.append(r)
    if not best and matcher == "word":
        best = _ruled_ranges(name, dictionary if dictionary is not None else ranges())
    return best


_COMPARE = {"exact": str.__eq__, "prefix": str.startswith, "contains": str.__contains__}


def column_rule(purpose: str, name: str) -> dict | None:
    """The first line of ``column_rules`` for this purpose that a column name meets."""
    return next((r for r in table("column_rules") if r["purpose"] == purpose
                 and _COMPARE[r["compare"]](name, r["text"])), None)


def _ruled_ranges(name: str, dictionary) -> list[Range]:
    """Entries for a column that no name or synonym matches: by rule, or by the rule's limits."""
    rule = column_rule("ranges", name)
    if rule is None:
        return []
    if rule["entry"]:
        return [r for r in dictionary if r.name == rule["entry"]]
    rest = name.removeprefix(rule["text"])
    near = (r for r in dictionary if _tiers_substring(rest, r.name) is not None)
    stem = rule["text"].split("_")[0]
    return [next(near, Range(stem, _num(rule["low"]), _num(rule["high"]),
                             category=rule["category"]))]


def find_range(column: str, sex: str | None = None, dictionary=None,
               matcher: str = "affix") -> Range | None:
    return _pick(all_ranges(column, dictionary, matcher), sex)


def range_by_loinc(code: str) -> Range | None:
    for row in table("loinc_codes"):
        if row["loinc_num"] == code:
            return find_range(row["component"], dictionary=ranges("extreme"), matcher="word")
    return None


def allowed_values(column: str) -> list[str] | None:
    """Accepted spellings of a coded column, None where no rule names the column."""
    rule = column_rule("values", snake(column))
    return rule and [r["value"] for r in table("allowed_values")
                     if r["vocabulary"] == rule["entry"]]


def vocabulary(column: str) -> list[dict] | None:
    """Lines (value, canonical) of the vocabulary a column name belongs to."""
    name = column.lower().strip()
    for key in dict.fromkeys(r["vocabulary"] for r in table("vocabularies")):
        if key in name or name in key:
            return [r for r in table("vocabularies") if r["vocabulary"] == key]
    return None


def unit_factors() -> list[dict]:
    return [{**r, "factor": _num(r["factor"])} for r in table("unit_factors")]


# ---- the same tables as DataFrames ------------------------------------------------------------

RANGE_SCHEMA = (
    "source string, name string, unit string, category string, low double, high double, "
    "critical_low double, critical_high double, normal_low double, normal_high double, "
    "child_low double, child_high double, sex string, loinc string, synonyms array<string>"
)


def range_dim(spark: SparkSession) -> DataFrame:
    """All three range dictionaries with a ``source`` column."""
    rows = [
        (s, r.name, r.unit, r.category, r.low, r.high, r.critical_low, r.critical_high,
         r.normal_low, r.normal_high, r.child_low, r.child_high, r.sex, r.loinc,
         list(r.synonyms))
        for s in ("plausible", "extreme", "adult_child") for r in ranges(s)
    ]
    return spark.createDataFrame(rows, RANGE_SCHEMA)


def inventory(spark: SparkSession) -> DataFrame:
    """Entries per dictionary and category."""
    return range_dim(spark).groupBy("source", "category").count()


def loinc_dim(spark: SparkSession, path: str | None = None) -> DataFrame:
    """LOINC codes: a parquet or CSV dimension if a path is given, else the built-in codes."""
    if path:
        return read_dim(spark, path)
    return spark.createDataFrame(
        [(r["loinc_num"], r["component"], r["unit"]) for r in table("loinc_codes")],
        "loinc_num string, component string, unit string")


def snomed_dim(spark: SparkSession, path: str | None = None) -> DataFrame:
    if path:
        return read_dim(spark, path)
    return spark.createDataFrame(
        [(i, r["concept_id"], r["term"], r["semantic_tag"])
         for i, r in enumerate(table("snomed_concepts"))],
        "ord int, concept_id string, term string, semantic_tag string")


def read_dim(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def unit_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(r["from_unit"], r["to_unit"], r["analyte"], r["factor"]) for r in unit_factors()],
        "from_unit string, to_unit string, analyte string, factor double")


def vocabulary_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(r["vocabulary"], r["value"], r["canonical"] or None) for r in table("vocabularies")],
        "vocabulary string, value string, canonical string")
