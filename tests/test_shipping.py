"""Sources, keys and shipping."""
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veracell import sources
from veracell.functions import session
from veracell.functions.session import check_unique
from veracell.operators import clean as C, detectors as DT
from veracell.plans.analysis import Config, analyze

ROOT = str(Path(__file__).resolve().parents[1])


def test_line_breaks_in_quotes_stay_in_their_cell(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('a,b\n1,"x\ny ""q"", z"\n2," w "\n')
    rows = sources.read_table(spark, str(f)).collect()
    assert [tuple(r) for r in rows] == [("1", 'x\ny "q", z'), ("2", " w ")]
    assert sources.read_table(spark, str(f), multi_line=False).count() == 3


def test_json_records_array(spark, tmp_path):
    f = tmp_path / "t.json"
    f.write_text('[{"a": 1, "b": "x\\ny"},\n {"a": 2, "b": null}]')
    assert [tuple(r) for r in sources.read_table(spark, str(f)).collect()] == [
        ("1", "x\ny"), ("2", None)]


@pytest.mark.parametrize("keys", [[1, 1, 2], [1, None, 2]])
def test_keys_must_identify_rows(spark, keys):
    df = spark.createDataFrame([(k, float(i)) for i, k in enumerate(keys)], "k long, v double")
    with pytest.raises(ValueError, match="does not identify"):
        check_unique(df, "k")
    with pytest.raises(ValueError, match="does not identify"):
        analyze(df, ["k"])


def test_causes_are_told_when_every_detector_fails(spark, monkeypatch):
    def broken(*args, **kwargs):
        raise TypeError("no module")

    monkeypatch.setitem(DT.DETECTORS, "isolation_forest", broken)
    df = spark.range(40).select("id", (F.col("id") * 1.5).alias("v"), F.rand(1).alias("w"))
    with pytest.warns(UserWarning), pytest.raises(RuntimeError, match="forest: TypeError: no mod"):
        analyze(df, ["id"], Config(methods="isolation_forest", with_text=False))


def test_one_failing_detector_ends_the_run(spark, monkeypatch):
    """Scores without a method that was asked for would look like a whole result."""
    def broken(*args, **kwargs):
        raise TypeError("no module")

    monkeypatch.setitem(DT.DETECTORS, "lof", broken)
    df = spark.range(40).select("id", (F.col("id") * 1.5).alias("v"), F.rand(1).alias("w"))
    config = Config(methods="autoencoder,lof", with_text=False, bootstrap_runs=2)
    with pytest.warns(UserWarning), pytest.raises(RuntimeError, match="1 of 2 .*lof: TypeError"):
        analyze(df, ["id"], config)


def test_copies_get_a_recommendation(spark):
    rows = spark.createDataFrame(
        [(5, "duplicate_near_duplicate", "low", 1.0, [], "Exact copy", {"a": "1"})],
        "row_id long, anomaly_type string, severity string, confidence double, "
        "flagged_columns array<string>, rationale string, values map<string, string>")
    r = C.recommend(rows).collect()
    assert [(x.column_name, x.recommended_action) for x in r] == [("*", "merge_keep_complete")]
    df = spark.createDataFrame([(5, "1"), (6, "1")], "row_id long, a string")
    cleaned, log = C.apply_actions(df, "row_id", C.recommend(rows))
    assert cleaned.count() == 2 and log.count() == 0


def test_csv_logs_are_written(spark, tmp_path):
    anomalies = spark.createDataFrame(
        [(1, "unit_mismatch", "high", 0.81234, ["a", "b"], "two\nlines")],
        "row_id long, anomaly_type string, severity string, confidence double, "
        "flagged_columns array<string>, rationale string")
    methods = spark.createDataFrame(
        [("lof", *[0.5] * 7, 3, 10, True)],
        "method string, composite double, ndc double, ad double, ss double, cp double, ex double, "
        "cc double, anomaly_count long, duration_ms long, selected boolean")
    paths = sources.write_logs(str(tmp_path), anomalies, methods)
    back = sources.read_table(spark, paths["anomaly_log"], "csv").first()
    assert (back.row_index, back.confidence, back.flagged_columns, back.rationale) == (
        "1", "0.812", "a; b", "two\nlines")
    assert sources.read_table(spark, paths["method_benchmarks"], "csv").first().composite == "0.5000"


def test_scratch_is_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "_handed_out", [])
    df = session.cut_lineage(spark.range(5))
    path = Path(session._handed_out[0].removeprefix("file:"))
    assert df.count() == 5 and path.exists()
    assert session.drop_scratch(spark) == 1 and not path.exists()


@pytest.mark.parametrize("prepare", [
    "from veracell.functions.session import ship; ship(spark)",
    "import __spark_entry__ as e; e.queries()['head_sample_nation'](spark, '%s').count()" % (
        "/root/testdata/sf0.001")])
def test_package_reaches_workers_from_elsewhere(tmp_path, prepare):
    """A session started outside the repository, whose workers have no path to it."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
{prepare}
def run(batches):
    import veracell.functions.arrow
    yield from batches
print("rows", spark.range(3).mapInArrow(run, "id long").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {
        "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, timeout=180,
                         capture_output=True, text=True)
    assert "rows 3" in out.stdout, out.stderr[-2000:]


def test_loops_drop_their_older_states(spark, monkeypatch):
    monkeypatch.setattr(session, "_handed_out", [])
    steps = session.Steps(spark)
    kept = [steps.write(spark.range(i)) for i in range(4)]
    assert [Path(p.removeprefix("file:")).exists() for p in steps.paths] == [True, True]
    assert len(session._handed_out) == 2 and kept[-1].count() == 3
