"""The dissociation of outcome and scanner on a small cohort."""

import numpy as np
import pytest

from siftline.operators import linear
from siftline.plans.studies import dissociation


def cohort():
    """240 rows at 12 sites: dimensions 0 and 1 tell three scanners and rows without one apart, dimension 2 the outcome."""
    rng = np.random.default_rng(3)
    at = {"m1": (0.0, 0.0), "m2": (6.0, 0.0), "m3": (0.0, 6.0), None: (6.0, 6.0)}
    rows = []
    for i in range(240):
        y, b = i % 2, list(at)[i // 2 % 4]
        rows.append((f"r{i}", y, f"s{i % 12}", b, [*(np.array(at[b]) + rng.normal(size=2) * 0.5).tolist(), y + rng.normal() * 0.5]))
    return rows


def test_dissociation_counts_all_scanners(spark):
    df = spark.createDataFrame(cohort(), "subject_id string, y int, grp string, scanner string, emb array<double>")
    got = {(r["target"], r["features"]): r for r in dissociation(df).collect()}
    assert got["scanner", "plain"]["classes"] == got["scanner", "projected"]["classes"] == 4
    assert got["scanner", "plain"]["auc"] > 0.9 and got["scanner", "projected"]["auc"] < 0.65
    assert min(got["outcome", x]["auc"] for x in ("plain", "projected")) > 0.8


@pytest.mark.parametrize("most", [1, 2])
def test_directions_as_by_hand(spark, most):
    """Directions from sums by batch, against discriminants from the rows of the other folds."""
    rows = [(x, str(b), [i % 3]) for i, (_, _, _, b, x) in enumerate(cohort())]
    got = linear.batch_directions(spark.createDataFrame(rows, "x array<double>, b string, fold array<int>"), 3, 3, most)
    for j in range(3):
        x, b = np.array([r[0] for r in rows if r[2] != [j]]), np.array([r[1] for r in rows if r[2] != [j]])
        z = (x - x.mean(0)) / x.std(0)
        means = np.stack([z[b == c].mean(0) for c in b])
        val, vec = np.linalg.eig(np.linalg.solve((z - means).T @ (z - means) / len(z) + 1e-6 * np.eye(3), means.T @ means / len(z)))
        want = np.linalg.qr(vec.real[:, np.argsort(-val.real)[:most]] / x.std(0)[:, None])[0]
        assert np.allclose(got[j] @ got[j].T, want @ want.T, atol=1e-6)
