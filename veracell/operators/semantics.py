"""Column semantics and dictionary checks: what a column means, which cells break its range."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from veracell import dims
from veracell.dims import Range
from veracell.functions import values as V

# Name patterns of the clinical column types, first hit wins.
FIELD_PATTERNS = {
    "patient_id": [
        r"(?i)(subject|patient|subj|pt|participant)[\s_\-]*(id|num|no|number|code|key)",
        r"(?i)^(subjid|ptid|pid|patid|usubjid|mrn|record_id)$",
    ],
    "visit_date": [
        r"(?i)(visit|encounter|assess|collection)[\s_\-]*(date|dt|datetime)",
        r"(?i)^(visitdt|vdate|asmtdt|rfstdtc|dmdtc)$",
    ],
    "lab_value": [
        r"(?i)(lab|analyte|test|result|biomarker)[\s_\-]*(value|result|orres|stresn)",
        r"(?i)^(lborres|lbstresn|aval)$",
        r"(?i)(hemoglobin|hgb|wbc|rbc|platelet|creatinine|glucose|alt|ast|bun|albumin|sodium|potassium|calcium|cholesterol|hba1c|troponin|crp|tsh)",
    ],
    "vital_sign": [
        r"(?i)(systolic|diastolic|sbp|dbp|blood[\s_]?pressure|bp)",
        r"(?i)(heart[\s_]?rate|hr|pulse)",
        r"(?i)(temperature|temp|body[\s_]?temp)",
        r"(?i)(respiratory[\s_]?rate|resp[\s_]?rate|rr)",
        r"(?i)(oxygen[\s_]?sat|spo2|o2[\s_]?sat)",
        r"(?i)(weight|wt|height|ht|bmi)",
    ],
    "adverse_event": [
        r"(?i)(adverse|ae|event|safety|toxicity)",
        r"(?i)(aeterm|aedecod|aesev|aeser|aerel)",
    ],
    "demographics": [
        r"(?i)^(age|sex|gender|race|ethnic|ethnicity|dob|arm|armcd|treatment[\s_]?group)$",
    ],
    "site_id": [
        r"(?i)(site|center|centre|clinic|facility)[\s_\-]*(id|num|code|name)",
        r"(?i)^(siteid|siteno|country|invid)$",
    ],
    "visit_id": [
        r"(?i)(visit|epoch|period|timepoint)[\s_\-]*(id|num|code|name|label)",
        r"(?i)^(visitnum|visitname|visit|avisitn|avisit)$",
    ],
    "drug_exposure": [
        r"(?i)(drug|medication|dose|dosage|treatment|therapy|conmed)",
        r"(?i)(exdose|extrt|cmdecod|cmtrt)",
    ],
    "eligibility": [
        r"(?i)(eligible|inclusion|exclusion|criteria|ietest)",
    ],
}
# Measurements reported as vital signs; every other range is a lab value.
VITALS = ["systolic_bp", "diastolic_bp", "heart_rate", "temperature", "spo2", "bmi", "weight",
          "height"]
# Code shapes and word lists of clinical text.
ICD10_SHAPE = r"^[A-Z]\d{2}(\.\d{1,4})?$"
LOINC_SHAPE = r"^\d{3,7}-\d$"
EVENT_TERMS = [
    "headache", "nausea", "vomiting", "diarrhea", "dizziness", "fatigue", "rash", "pruritus",
    "pyrexia", "cough", "arthralgia", "myalgia", "insomnia", "dyspnea", "edema", "anemia",
    "neutropenia", "thrombocytopenia", "hypertension", "hypotension", "tachycardia",
    "bradycardia", "constipation", r"abdominal\s*pain", r"back\s*pain", r"chest\s*pain",
    r"upper\s*respiratory", r"urinary\s*tract\s*infection",
]
DRUG_ENDINGS = [
    "mab", "nib", "zole", "pril", "sartan", "statin", "olol", "azine", "cillin", "mycin",
    "floxacin", "prazole", "dipine", "zosin", "gliptin", "tide", "vir", "navir", "etine",
]
CDISC_DOMAINS = {
    "DM": "Demographics", "VS": "Vital Signs", "LB": "Laboratory", "AE": "Adverse Events",
    "CM": "Concomitant Medications", "MH": "Medical History", "EX": "Exposure",
    "DS": "Disposition", "PE": "Physical Examination", "EG": "ECG",
    "IE": "Inclusion/Exclusion", "SV": "Subject Visits", "SE": "Subject Elements",
    "TA": "Trial Arms", "TV": "Trial Visits", "TS": "Trial Summary", "TI": "Trial Inclusion",
    "QS": "Questionnaires", "FA": "Findings About", "SC": "Subject Characteristics",
}
# Factors tried, in this order, when some values look like another unit.
UNIT_GUESSES = [10, 18, 0.1, 1 / 18, 2.54, 0.3937]


# ---- what a column means -----------------------------------------------------------------------

def field_type(name: str) -> str | None:
    return next((t for t, patterns in FIELD_PATTERNS.items()
                 if any(re.search(p, name) for p in patterns)), None)


def candidate_ranges(name: str, dictionary) -> list[tuple[str, Range]]:
    """Dictionary labels with a word that occurs in the column name, in dictionary order.

    A later entry of the same label replaces the bounds but keeps the place of the first.
    """
    labels: dict[str, Range] = {}
    for r in dictionary:
        for label in (r.name, *r.synonyms):
            labels[label] = r
    low = name.lower()
    return [(lab, r) for lab, r in labels.items() if any(w in low for w in
                                                        lab.replace("_", " ").split())]


def field_map(df: DataFrame, columns: list[str] | None = None, dictionary=None) -> DataFrame:
    """Clinical type, confidence and reference range per column.

    Names are matched on the driver; whether values fit a candidate range is one wide aggregate.
    """
    dictionary = dictionary if dictionary is not None else dims.ranges()
    columns = columns or df.columns
    found = {c: candidate_ranges(c, dictionary) for c in columns}
    exprs = []
    for i, c in enumerate(columns):
        if not found[c]:
            continue
        v = V.number(df, c)
        exprs.append(F.count(v).alias(f"n{i}"))
        for j, (_, r) in enumerate(found[c]):
            exprs.append(F.avg(v.between(r.low * 0.5, r.high * 1.5).cast("double"))
                         .alias(f"s{i}_{j}"))
    share = df.agg(*exprs).first().asDict() if exprs else {}
    rows = []
    for i, c in enumerate(columns):
        kind, conf, ref = field_type(c), 0.0, None
        conf = 0.8 if kind else 0.0
        if (share.get(f"n{i}") or 0) > 10:
            hit = next((p for j, p in enumerate(found[c]) if share[f"s{i}_{j}"] > 0.7), None)
            if hit:
                kind, conf, ref = ("vital_sign" if hit[0] in VITALS else "lab_value"), 0.85, hit[1]
        rows.append((c, kind, conf, ref.name if ref else None, ref.low if ref else None,
                     ref.high if ref else None, ref.unit if ref else None))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, clinical_type string, confidence double, range_name string, "
              "range_min double, range_max double, unit string")


def confirm_map(detected: DataFrame, confirmed: DataFrame) -> DataFrame:
    """User-confirmed types (column_name, clinical_type) override detected ones."""
    c = confirmed.select("column_name", F.col("clinical_type").alias("confirmed_type"))
    return detected.join(F.broadcast(c), "column_name", "left").select(
        "column_name", F.coalesce("confirmed_type", "clinical_type").alias("clinical_type"),
        F.when(F.col("confirmed_type").isNotNull(), 1.0).otherwise(F.col("confidence"))
        .alias("confidence"),
        F.col("confirmed_type").isNotNull().alias("user_confirmed"))


def coverage(mapping: DataFrame) -> DataFrame:
    """Columns with and without a clinical meaning, and the share that has one."""
    known = F.coalesce(F.col("clinical_type") != "", F.lit(False))
    return mapping.agg(
        F.count_if(known).alias("matched_count"), F.count_if(~known).alias("skipped_count"),
        F.round(F.count_if(known) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 1)
        .alias("coverage_pct"))


# ---- cells against ranges ----------------------------------------------------------------------

def ranges_for(columns: list[str], dictionary=None, matcher: str = "affix") \
        -> dict[str, list[Range]]:
    """Range variants of each column that has any, sex-specific ones included."""
    out = {c: dims.all_ranges(c, dictionary, matcher) for c in columns}
    return {c: r for c, r in out.items() if r}


def ranges_from(dim: DataFrame, columns: list[str], limit: int = 10_000) -> dict:
    """A user's dictionary DataFrame (column_name, low, high, ...) for the given columns."""
    rows = dim.where(F.col("column_name").isin(columns)).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a range dictionary has one line per column and sex")
    known = {"low", "high", "unit", "category", "critical_low", "critical_high", "normal_low",
             "normal_high", "sex"}
    out: dict[str, list[Range]] = {}
    for r in rows:
        d = {k: v for k, v in r.asDict().items() if k in known}
        out.setdefault(r["column_name"], []).append(Range(name=r["column_name"], **d))
    return out


def bound(variants: list[Range], field: str, sex: Column | None = None) -> Column:
    """A bound of the range; with a sex column, the variant of the row's sex."""
    value = getattr(variants[0], field)
    first = F.lit(value).cast("string" if field == "unit" else "double")
    if sex is None:
        return first
    out = None
    for r in variants:
        if r.sex:
            cond, lit = F.upper(sex) == r.sex, F.lit(getattr(r, field)).cast("double")
            out = F.when(cond, lit) if out is None else out.when(cond, lit)
    return first if out is None else out.otherwise(first)


def _num_text(c: Column) -> Column:
    return c.cast("string")


def cell_checks(df: DataFrame, key: str, ranges: dict[str, list[Range]],
                sex: Column | None = None) -> DataFrame:
    """Cells outside their critical or normal range, with the reason in words.

    A projection with one bounded array per row: nothing is shuffled, plausible cells vanish
    inside the scan stage.
    """
    cells = []
    for c, variants in ranges.items():
        v = V.number(df, c)
        unit = variants[0].unit
        hl, hh = bound(variants, "hard_low", sex), bound(variants, "hard_high", sex)
        nl, nh = bound(variants, "normal_low", sex), bound(variants, "normal_high", sex)
        head = F.concat(F.lit(f"{c}="), _num_text(v))
        normal = F.concat(F.lit(" normal range ("), _num_text(nl), F.lit("-"), _num_text(nh),
                          F.lit(f" {unit})"))
        reason = (
            F.when(v < hl, F.concat(head, F.lit(" below critical minimum ("), _num_text(hl),
                                    F.lit(f" {unit})")))
            .when(v > hh, F.concat(head, F.lit(" above critical maximum ("), _num_text(hh),
                                   F.lit(f" {unit})")))
            .when(v < nl, F.concat(head, F.lit(" below"), normal))
            .when(v > nh, F.concat(head, F.lit(" above"), normal)))
        kind = F.when((v < hl) | (v > hh), "impossible").when((v < nl) | (v > nh), "abnormal")
        cells.append(F.struct(F.lit(c).alias("column_name"), v.alias("value"),
                              kind.alias("verdict"), reason.alias("reason")))
    if not cells:
        return df.select(key, F.lit("").alias("column_name"), F.lit(0.0).alias("value"),
                         F.lit("").alias("verdict"), F.lit("").alias("reason")).limit(0)
    found = F.filter(F.array(*cells), lambda s: s.verdict.isNotNull())
    return df.select(key, F.inline(found))


def impossible_cells(df, key, ranges, sex=None) -> DataFrame:
    return cell_checks(df, key, ranges, sex).where(F.col("verdict") == "impossible")


def abnormal_cells(df, key, ranges, sex=None) -> DataFrame:
    """Cells outside the normal range, whether or not they are also impossible."""
    out = {c: [Range(r.name, r.low, r.high, r.unit, critical_low=float("-inf"),
                     critical_high=float("inf"), normal_low=r.normal_low,
                     normal_high=r.normal_high, sex=r.sex) for r in v]
           for c, v in ranges.items()}
    return cell_checks(df, key, out, sex)


def implausible(df: DataFrame, ranges: dict[str, list[Range]],
                sex: Column | None = None) -> Column:
    """True when any ranged cell of the row is outside its critical range."""
    out = F.lit(False)
    for c, variants in ranges.items():
        v = V.number(df, c)
        out = out | F.coalesce((v < bound(variants, "hard_low", sex))
                               | (v > bound(variants, "hard_high", sex)), F.lit(False))
    return out


def valid_value(value: Column, variants: list[Range] | None) -> Column:
    """Whether a proposed value may be written: finite and inside the critical range."""
    if not variants:
        return F.lit(True)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.coalesce(finite & value.between(variants[0].hard_low, variants[0].hard_high),
                      F.lit(False))


def plausibility_report(df: DataFrame, columns: list[str],
                        ranges: dict[str, list[Range]]) -> DataFrame:
    """Per column: matched or not, checked cells, impossible cells."""
    from veracell.operators.typing import long_summary
    metrics = {}
    for c in columns:
        v, r = V.number(df, c), ranges.get(c)
        bad = implausible(df, {c: r}) if r else F.lit(False)
        metrics[c] = {
            "matched": F.max(F.lit(bool(r))), "category": F.max(F.lit(r[0].category if r else None)
                                                                .cast("string")),
            "checked": F.count(v), "impossible_count": F.count_if(bad)}
    return long_summary(df, metrics).drop("position")


# ---- codes, terms, vocabularies ----------------------------------------------------------------

def classify_text(c: Column) -> Column:
    """ICD-10 code, LOINC code, adverse-event term, drug name or CDISC domain of a text."""
    t = V.strip(c)
    low = F.lower(t)
    out = F.when(t.rlike(ICD10_SHAPE), "icd10_code").when(t.rlike(LOINC_SHAPE), "loinc_code")
    out = out.when(low.rlike("|".join(EVENT_TERMS)), "adverse_event_term")
    drug = F.lit(False)
    for e in DRUG_ENDINGS:
        drug = drug | low.endswith(e)
    out = out.when(drug, "drug_name")
    for prefix, domain in CDISC_DOMAINS.items():
        out = out.when(low.startswith(prefix.lower()),
                       "cdisc_" + domain.lower().replace(" ", "_"))
    return out


GRAM = 3


def _grams(c: Column) -> Column:
    """Distinct character trigrams of a text; a shorter text is its own gram."""
    n = F.length(c)
    return F.when(n < GRAM, F.array(c)).otherwise(F.array_distinct(F.transform(
        F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.substring(c, i, F.lit(GRAM)))))


def _concept_grams(name: Column) -> Column:
    """Trigrams plus all one- and two-character pieces, so that short terms find their names."""
    chars = lambda size: F.transform(F.sequence(F.lit(1), F.length(name) - (size - 1)),
                                     lambda i: F.substring(name, i, F.lit(size)))
    pieces = [F.when(F.length(name) >= s, chars(s)).otherwise(F.array().cast("array<string>"))
              for s in (1, 2, GRAM)]
    return F.array_distinct(F.concat(*pieces))


def match_terms(values: DataFrame, column: str, concepts: DataFrame) -> DataFrame:
    """First concept, in dictionary order, whose name equals or contains each distinct term.

    Terms and names meet on one shared trigram, the one of the term that the fewest names hold,
    so even a dictionary of many thousand concepts is an equi-join and no cross join.
    """
    terms = values.select(F.lower(V.strip(V.col(column))).alias("term")).where(
        F.length("term") > 0).distinct()
    names = concepts.select("ord", "concept_id", F.col("term").alias("concept"),
                            F.lower("term").alias("name"))
    index = names.select("ord", "name", F.explode(_concept_grams(F.col("name"))).alias("gram"))
    sizes = index.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    rarest = (terms.select("term", F.explode(_grams(F.col("term"))).alias("gram"))
              .join(sizes, "gram", "left")
              .groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)),
                                                             "gram")).alias("gram")))
    first = (rarest.join(index, "gram").where(F.col("name").contains(F.col("term")))
             .groupBy("term").agg(F.min("ord").alias("ord")))
    return terms.join(first, "term", "left").join(
        names.select("ord", "concept_id", "concept"), "ord", "left").select(
        "term", "concept_id", "concept", F.col("ord").isNotNull().alias("matched"))


def lookup_concepts(keys: DataFrame, column: str, concepts: DataFrame) -> DataFrame:
    """Concepts by code or by term."""
    by_code = keys.select(column).distinct().join(
        concepts.select(F.col("concept_id").alias(column), "concept_id",
                        F.col("term").alias("concept")), column)
    hits = match_terms(keys, column, concepts).where("matched")
    by_term = keys.select(column).distinct().join(by_code.select(column), column, "left_anti") \
        .withColumn("term", F.lower(V.strip(V.col(column)))) \
        .join(hits, "term").select(column, "concept_id", "concept")
    return by_code.unionByName(by_term)


def diagnosis_coverage(values: DataFrame, column: str, concepts: DataFrame) -> DataFrame:
    """How many cells of a diagnosis column name a known concept."""
    cells = (values.select(F.lower(V.strip(V.col(column))).alias("term"))
             .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    joined = cells.join(match_terms(values, column, concepts), "term", "left")
    filled = F.length("term") > 0
    hit = F.coalesce("matched", F.lit(False))
    return joined.agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(filled & ~hit, F.col("n"))), F.lit(0)).alias("unmatched"),
        F.count_distinct(F.when(hit, F.col("concept"))).alias("matched_concepts"),
        F.count_if(filled & ~hit).alias("unmatched_values"))


def unmatched_terms(values: DataFrame, column: str, concepts: DataFrame, k: int = 20) -> DataFrame:
    return (match_terms(values, column, concepts).where(~F.col("matched"))
            .select("term").orderBy("term").limit(k))


def lookup_loinc(codes: DataFrame, column: str, loinc: DataFrame) -> DataFrame:
    """Codes with their dimension line; unknown codes keep nulls."""
    return codes.join(loinc, codes[column] == loinc["loinc_num"], "left")


def loinc_ranges(spark) -> DataFrame:
    """(loinc_num, range_name, low, high, unit) of every built-in code that has a range."""
    rows = []
    for r in dims.table("loinc_codes"):
        hit = dims.range_by_loinc(r["loinc_num"])
        if hit:
            rows.append((r["loinc_num"], hit.name, hit.low, hit.high, hit.unit))
    return spark.createDataFrame(
        rows, "loinc_num string, range_name string, low double, high double, unit string")


def invalid_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Distinct values outside a vocabulary, with their counts."""
    return (df.where(V.col(column).isNotNull() & ~V.col(column).isin(allowed))
            .groupBy(V.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")))


def canonical(df: DataFrame, column: str, vocab: DataFrame, out: str = "canonical") -> DataFrame:
    """Left join of raw values to their canonical form; unknown values keep null."""
    v = vocab.select(F.col("value").alias("__v"), F.col("canonical").alias(out))
    return df.join(v, V.col(column) == F.col("__v"), "left").drop("__v")


# ---- units -------------------------------------------------------------------------------------

def convert_unit(value: Column, from_unit: Column, to_unit: Column, analyte: Column,
                 factors: list[dict] | None = None, any_analyte: bool = False) -> Column:
    """Unit conversion by a map lookup on (from, to, analyte); temperatures by formula.

    ``any_analyte`` also accepts the first factor of the same unit pair for another analyte.
    """
    factors = factors if factors is not None else dims.unit_factors()
    sep = "\u0001"
    exact = [x for r in factors if r["factor"] is not None for x in
             (F.lit(sep.join((r["from_unit"], r["to_unit"], r["analyte"].lower()))),
              F.lit(float(r["factor"])))]
    out = F.round(value * F.try_element_at(
        F.create_map(*exact), F.concat_ws(sep, from_unit, to_unit, F.lower(analyte))), 4)
    c_to_f = (from_unit == "°C") & (to_unit == "°F")
    f_to_c = (from_unit == "°F") & (to_unit == "°C")
    out = F.coalesce(out, F.when(c_to_f, F.round(value * 9 / 5 + 32, 1))
                     .when(f_to_c, F.round((value - 32) * 5 / 9, 1)))
    if any_analyte:
        pairs: dict[str, float] = {}
        for r in factors:
            if r["factor"] is not None:
                pairs.setdefault(sep.join((r["from_unit"], r["to_unit"])), float(r["factor"]))
        loose = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
        out = F.coalesce(out, F.round(value * F.try_element_at(
            loose, F.concat_ws(sep, from_unit, to_unit)), 4))
    return out


def unit_mismatch(df: DataFrame, column: str, low: float, high: float,
                  guesses: list[float] | None = None) -> DataFrame:
    """Whether out-of-range values look like another unit, and by which factor; one aggregate."""
    guesses = guesses or UNIT_GUESSES
    v = V.number(df, column)
    out = ~v.between(low, high)
    shares = F.array(*[F.coalesce(F.avg(F.when(out, (v * g).between(low, high).cast("double"))),
                                  F.lit(0.0)) for g in guesses])
    one = df.agg(F.count(v).alias("values"), F.count_if(out).alias("out_of_range"),
                 shares.alias("shares"))
    first = F.array_position(F.transform("shares", lambda s: s > 0.7), F.lit(True))
    can = (F.col("values") >= 10) & (F.col("out_of_range") > 0) \
        & (F.col("out_of_range") < F.col("values")) & (first > 0)
    factors = F.array(*[F.lit(float(g)) for g in guesses])
    return one.select(
        "values", "out_of_range", F.coalesce(can, F.lit(False)).alias("mismatch"),
        F.when(can, F.try_element_at(factors, first.cast("int"))).alias("likely_factor"))


def harmonize(value: Column, factor: Column | float, low: float, high: float) -> Column:
    """Multiply the values outside the range, keep the others."""
    return F.when(value.between(low, high), value).otherwise(value * factor)
