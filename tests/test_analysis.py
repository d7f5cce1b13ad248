import pytest
from pyspark.sql import functions as F

from veracell.operators import metrics as M, semantics as S
from veracell.plans.analysis import Config, analyze, simulate


@pytest.fixture(scope="module")
def run(spark, trial):
    pdf, _ = trial
    df = spark.createDataFrame(pdf.reset_index(names="k").astype(
        object).where(pdf.reset_index(names="k").notna(), None).infer_objects())
    config = Config(mode="auto", methods="isolation_forest,robust_pca", bootstrap_runs=2, contamination=0.05,
                    with_text=False, detector_options={
                        "isolation_forest": {"trees": 60}, "robust_pca": {"max_iter": 10}})
    return analyze(df, ["k"], config)


def test_every_impossible_value_is_found(spark, run, trial):
    _, planted = trial
    found = S.impossible_cells(run.table, "row_id", S.ranges_for(
        ["systolic_bp", "hemoglobin", "glucose", "age", "heart_rate"]))
    assert planted <= {r["row_id"] for r in found.collect()}


def test_scores_and_anomalies(run, trial):
    _, planted = trial
    n = run.vector["n"]
    flagged = run.scores.where("flagged").count()
    assert 0 < flagged <= 0.2 * n + 1
    assert run.anomalies.count() == flagged
    rows = {r["row_id"]: r for r in run.anomalies.collect()}
    assert len(planted & set(rows)) >= len(planted) - 2
    assert any(r["anomaly_type"] == "impossible_biological_value" for r in rows.values())
    assert all(r["card"]["summary"].startswith("Record #") for r in rows.values())


def test_rules_feed_their_types(run):
    kinds = {r[0] for r in run.rule_anomalies.select("anomaly_type").distinct().collect()}
    assert {"category_encoding_inconsistency", "suspicious_missingness"} <= kinds


def test_cleaning_and_metrics(run):
    assert run.cleaned.where(~F.col("sex").isin("M", "F")).count() == 0
    assert run.ledger.where("action = 'normalize_coding'").count() == 3
    both = M.compare(M.long_metrics(run.before), M.long_metrics(run.after))
    assert both.count() == 5
    assert "anomalies across" in run.narrative.first()[0]
    _, log = simulate(run)
    assert log.count() > 0


def test_tables_are_stored(run, spark, tmp_path):
    run.save(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "anomaly_records"))
    assert back.where("run_id = 'run-001'").count() == run.anomalies.count()
