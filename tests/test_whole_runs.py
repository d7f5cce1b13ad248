"""The registered queries of whole runs and refits use the operators' own defaults."""
import pytest

import __spark_entry__ as entry
from veracell.operators import detectors, replicates
from veracell.plans import analysis

SF = "/root/testdata/sf0.001"


class Called(Exception):
    pass


@pytest.mark.parametrize("name,owner,function,given,options", [
    ("robust_pca_lineitem", detectors, "robust_pca", 1, {}),
    ("bootstrap_stability_lineitem", replicates, "stability", 4, {}),
    ("full_analysis_part", analysis, "analyze", 2, None),
    ("auto_clean_metrics_customer", analysis, "analyze", 3, analysis.Config(mode="auto"))])
def test_defaults(spark, monkeypatch, name, owner, function, given, options):
    def called(*args, **kwargs):
        raise Called(args, kwargs)

    monkeypatch.setattr(owner, function, called)
    with pytest.raises(Called) as got:
        entry.queries()[name](spark, SF)
    args, kwargs = got.value.args
    assert len(args) == given and kwargs == {}
    if options:
        assert args[2] == options


def test_the_analysed_table_is_spread(spark, monkeypatch):
    """A table of one file is not read by one task in every phase."""
    def understood(df, config):
        raise Called(df.rdd.getNumPartitions(), df.count())

    monkeypatch.setattr(analysis, "_understand", understood)
    part = spark.read.parquet(f"{SF}/part.parquet")
    assert part.rdd.getNumPartitions() == 1
    with pytest.raises(Called) as got:
        analysis.analyze(part, ["p_partkey"])
    parts, rows = got.value.args
    assert parts > 1 and rows == part.count()
