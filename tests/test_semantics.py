import pytest
from pyspark.sql import functions as F

from veracell import dims, sources
from veracell.functions import values as V
from veracell.operators import clean as C, semantics as S, typing as TY


def test_lookup_tiers():
    assert dims.find_range("hgb").name == "hemoglobin"
    assert dims.find_range("hemoglobin", "F").normal_high == 15.5
    assert dims.find_range("p_partkey") is None
    assert dims.find_range("p_partkey", matcher="substring") is not None
    assert dims.find_range("gene_expr_TP53", dictionary=dims.ranges("extreme"),
                           matcher="word").name == "gene_expression"
    assert dims.range_by_loinc("718-7").name == "hemoglobin"
    assert dims.allowed_values("patient_sex")[0] == "M"
    assert dims.vocabulary("smoking_status")
    assert len(dims.ranges()) == 91 and len(dims.unit_factors()) == 32


def test_dimensions(spark):
    assert dims.inventory(spark).where("source = 'extreme'").agg(F.sum("count")).first()[0] == 142
    assert dims.snomed_dim(spark).count() == 81
    loinc = dims.loinc_dim(spark)
    codes = spark.createDataFrame([("718-7",), ("x",)], "code string")
    assert {r["component"] for r in S.lookup_loinc(codes, "code", loinc).collect()} \
        == {"hemoglobin", None}


def test_term_matching_takes_first_in_order(spark):
    words = spark.createDataFrame([("heart",), ("HEART DISEASE",), ("x",), ("zzz",), ("",)],
                                  "dx string")
    got = {r["term"]: r["concept"] for r in
           S.match_terms(words, "dx", dims.snomed_dim(spark)).collect()}
    names = [r["term"] for r in dims.table("snomed_concepts")]
    first = lambda t: next((n for n in names if t in n.lower()), None)
    assert got == {t: first(t) for t in ("heart", "heart disease", "x", "zzz")}
    by = S.lookup_concepts(spark.createDataFrame([("84114007",), ("asthma",)], "q string"), "q",
                           dims.snomed_dim(spark)).collect()
    assert {r["concept"] for r in by} == {"Heart failure", "Asthma"}


@pytest.mark.parametrize("text,kind", [
    ("I21.4", "icd10_code"), ("718-7", "loinc_code"), ("mild Headache", "adverse_event_term"),
    ("atorvastatin", "drug_name"), ("AETERM", "cdisc_adverse_events"), ("zebra", None)])
def test_text_class(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.classify_text(F.col("t")).alias("k")).first()["k"] == kind


def test_fields(spark):
    rows = [(f"P{i}", 100.0 + i % 30, 5.0, "2024-01-01") for i in range(50)]
    df = spark.createDataFrame(rows, "patient_id string, glucose double, age double, "
                                     "visit_date string")
    got = {r["column_name"]: (r["clinical_type"], r["confidence"])
           for r in S.field_map(df).collect()}
    assert got["patient_id"] == ("patient_id", 0.8)
    assert got["glucose"] == ("lab_value", 0.85)
    assert got["visit_date"] == ("visit_date", 0.8)


def test_cells(spark):
    df = spark.createDataFrame([(1, 13.0), (2, 55.0), (3, 10.0), (4, None)],
                               "k long, hemoglobin double")
    found = {r["k"]: (r["verdict"], r["reason"]) for r in S.cell_checks(
        df, "k", S.ranges_for(["hemoglobin"])).collect()}
    assert found[2] == ("impossible", "hemoglobin=55.0 above critical maximum (30.0 g/dL)")
    assert found[3][0] == "abnormal"
    assert set(found) == {2, 3}


def test_coercions(spark):
    df = spark.createDataFrame([(" 7 ",), ("1e3",), ("1d",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(V.to_number(F.col("t"))).collect()] == [7, 1000, None, None, None]
    assert TY.infer_schema(df).first()["inferred_type"] == "categorical"


def test_input_guards(spark, tmp_path):
    with pytest.raises(ValueError):
        sources.read_table(spark, "x.docx")
    with pytest.raises(ValueError):
        sources.check_input(spark.range(3).toDF("only"))
    with pytest.raises(ValueError):
        sources.check_input(spark.createDataFrame([], "a int, b int"))
    (tmp_path / "t.csv").write_text('a,b\n1,"x,\"\"y\"\""\n')
    assert sources.read_table(spark, str(tmp_path / "t.csv")).first()["b"] == 'x,"y"'
    (tmp_path / "t.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert sources.read_table(spark, str(tmp_path / "t.json")).count() == 2


def test_unit_conversion(spark):
    df = spark.createDataFrame([(5.0, "mmol/L", "mg/dL", "Glucose"), (37.0, "°C", "°F", ""),
                                (1.0, "mmol/L", "mg/dL", "other")], "v double, a string, b string, "
                                                                    "n string")
    args = [F.col(c) for c in ("v", "a", "b", "n")]
    assert [r[0] for r in df.select(S.convert_unit(*args)).collect()] == [90.09, 98.6, None]
    assert df.select(S.convert_unit(*args, any_analyte=True)).collect()[2][0] == 18.018


def test_actions_keep_types_and_log(spark):
    df = spark.createDataFrame([(1, 250, "a"), (2, 30, "b"), (3, 40, "c")],
                               "k long, age int, t string")
    recs = spark.createDataFrame([(1, "age", "correct_pattern"), (2, "t", "remove_row"),
                                  (3, "t", "review")],
                                 "row_id long, column_name string, recommended_action string")
    out, log = C.apply_actions(df, "k", recs, S.ranges_for(["age"]))
    got = {r["k"]: (r["age"], r["t"]) for r in out.collect()}
    assert got == {1: (25, "a"), 2: (None, None), 3: (40, "c")}
    assert {(r["row_id"], r["action"]) for r in log.collect()} == {
        (1, "correct_pattern"), (2, "remove_row"), (3, "flag_for_review")}
    ledger = C.audit(log, "r", "lof").toPandas()
    assert sorted(t[-4:] for t in ledger["transaction_id"]) == ["0001", "0002", "0003"]
