import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from veracell.functions.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8)
    s.sparkContext.setLogLevel("ERROR")
    return s


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="session")
def trial():
    """Multi-visit trial with planted errors (the recipe of the blueprint's first fixture)."""
    rng = np.random.default_rng(42)
    rows = []
    for p in range(120):
        sex = rng.choice(["M", "F"])
        base = rng.normal(125, 15), rng.normal(72, 10), rng.normal(13.5 if sex == "M" else 12, 1.5)
        sugar = rng.normal(100, 20)
        for v in range(1, 6):
            rows.append({
                "patient_id": f"PT-{p:04d}", "site_id": f"S{p % 4}", "visit_num": v,
                "age": int(25 + p % 55), "sex": sex,
                "systolic_bp": round(base[0] + rng.normal(0, 5), 1),
                "heart_rate": round(base[1] + rng.normal(0, 4), 1),
                "hemoglobin": round(base[2] + rng.normal(0, .5), 1),
                "glucose": round(sugar + rng.normal(0, 10), 1)})
    df = pd.DataFrame(rows)
    bad_bp = [3, 77, 150, 290]
    df.loc[bad_bp, "systolic_bp"] = [999, -20, 888, 450]
    df.loc[[10, 200], "hemoglobin"] = [50, -3]
    df.loc[[30, 31, 32], "sex"] = ["Male", "female", "m"]
    df.loc[400:414, ["hemoglobin", "glucose"]] = np.nan
    df = pd.concat([df, df.iloc[[5, 5, 6]]], ignore_index=True)
    return df, set(bad_bp) | {10, 200}
