import math

import numpy as np
import pytest

from riskspark.operators import evaluation as ev


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(800), 2)
    p[:270] = 0.4  # one score holds a third of the rows
    y = (rng.random(800) < 0.1 + 0.5 * p).astype(int)
    return y, p, spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, p double").persist()


def brute_roc(y, p):
    points = []
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        points.append((t, (hit & (y == 0)).sum() / (y == 0).sum(), (hit & (y == 1)).sum() / (y == 1).sum()))
    return points


def test_roc_points(data):
    y, p, df = data
    rows = ev.roc_points(df).orderBy("threshold", ascending=False).collect()
    assert np.allclose([tuple(r) for r in rows], brute_roc(y, p), atol=1e-12)


def test_roc_corners_and_origin(data):
    y, p, df = data
    full = brute_roc(y, p)
    neg = [((p == t) & (y == 0)).sum() for t, *_ in full]
    pos = [((p == t) & (y == 1)).sum() for t, *_ in full]
    last = len(full) - 1
    keep = [full[i] for i in range(len(full)) if i in (0, last) or (neg[i], pos[i]) != (neg[i + 1], pos[i + 1])]
    rows = [tuple(r) for r in ev.roc_points(df, drop_intermediate=True, origin=True).orderBy("threshold", ascending=False).collect()]
    assert rows[0] == (math.inf, 0.0, 0.0)
    assert len(rows) == len(keep) + 1 and np.allclose(rows[1:], keep, atol=1e-12)


def test_scalar_metrics(data):
    y, p, df = data
    a, b = p[y == 1], p[y == 0]
    auc = np.mean([(u > v) + 0.5 * (u == v) for u in a for v in b])
    points = [(0.0, 0.0)] + [(f, t) for _, f, t in brute_roc(y, p)]
    ap, before = 0.0, 0.0
    for t, _, recall in brute_roc(y, p):
        ap += (recall - before) * y[p >= t].mean()
        before = recall
    r = ev.metric_bundle(df).first()
    assert r["ROC_AUC"] == pytest.approx(auc)
    assert r["KS_Statistic"] == pytest.approx(max(t - f for f, t in points), abs=5e-5)
    assert r["Average_Precision"] == pytest.approx(ap, abs=5e-5)
    z = (p >= 0.5).astype(int)
    assert r["MCC"] == pytest.approx(np.corrcoef(y, z)[0, 1], abs=5e-5)
    chance = y.mean() * z.mean() + (1 - y.mean()) * (1 - z.mean())
    assert r["Cohens_Kappa"] == pytest.approx(((y == z).mean() - chance) / (1 - chance), abs=5e-5)
    assert r["TP"] == (y & z).sum()


def test_ks_chart_marks_the_first_maximum(data):
    y, p, df = data
    best = max(brute_roc(y, p), key=lambda r: (r[2] - r[1], r[0]))
    marked = ev.ks_chart(df).where("is_max").collect()
    assert [r["threshold"] for r in marked] == [best[0]]


def test_thresholds_equal_brute_force(data):
    y, p, df = data
    best, cost, t_f1, t_cost = 0.0, math.inf, 0.5, 0.5
    for t in np.arange(0.01, 1.00, 0.01):
        z = p >= t
        tp, fp, fn = (z & (y == 1)).sum(), (z & (y == 0)).sum(), (~z & (y == 1)).sum()
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if f1 > best:
            best, t_f1 = f1, t
        if fn * 10000 + fp * 500 < cost:
            cost, t_cost = fn * 10000 + fp * 500, t
    r = ev.threshold_info(df).first()
    assert (r["best_f1_threshold"], r["best_f1_score"]) == (round(t_f1, 2), pytest.approx(best, abs=5e-5))
    assert (r["best_cost_threshold"], r["min_expected_cost"]) == (round(t_cost, 2), cost)
    sweep = ev.threshold_sweep(df)
    assert ev.best_f1_threshold(sweep).first()[0] == r["best_f1_threshold"]
    assert ev.min_cost_threshold(sweep).first()[0] == r["best_cost_threshold"]
    assert sweep.count() == 99


def test_no_positives(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.9)], "label int, p double")
    r = ev.threshold_info(df).first()
    assert (r["best_f1_threshold"], r["best_f1_score"]) == (0.5, 0.0)
    assert (r["best_cost_threshold"], r["min_expected_cost"]) == (0.91, 0.0)
    c = ev.confusion(df.selectExpr("label", "int(p >= 0.5) AS predicted")).first()
    assert tuple(c) == (1, 1, 0, 0)
    assert ev.roc_auc(df).first()[0] is None


@pytest.mark.parametrize("p, tier", [(0.0, 0), (0.30, 0), (0.3001, 1), (0.60, 1), (0.61, 2), (1.0, 2), (5.0, 2)])
def test_tier_edges(spark, p, tier):
    df = spark.createDataFrame([(p,)], "p double")
    assert df.select(ev.risk_tier("p")).first()[0] == ev.RISK_LABELS[tier]


def test_scorecard_keeps_empty_tiers(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.3), (0, 0.2)], "label int, p double")
    rows = [tuple(r) for r in ev.scorecard(df).collect()]
    assert rows == [("Low Risk (<30%)", 3, 1, 33.33), ("Medium Risk (30-60%)", 0, 0, None), ("High Risk (>60%)", 0, 0, None)]


def test_calibration_bins_are_right_closed(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.10001), (1, 0.0), (1, 1.0)], "label int, p double")
    rows = {r["bin"]: (r["n"], r["positive_rate"]) for r in ev.calibration_curve(df).collect()}
    assert rows == {0: (2, 1.0), 1: (1, 0.0), 9: (1, 1.0)}


def test_rows_without_a_score_are_left_out_everywhere(spark):
    rows = [(1, 0.9), (0, 0.2), (1, None), (0, float("nan")), (0, 0.6)]
    df = spark.createDataFrame(rows, "label int, p double")
    whole = spark.createDataFrame([r for r in rows if r[1] is not None and r[1] == r[1]], "label int, p double")
    assert ev.unscored(df).first().asDict() == {"unscored": 2, "positives": 1, "negatives": 1}
    for measure in (ev.metric_bundle, ev.threshold_sweep, ev.scorecard, ev.calibration_curve, ev.ks_chart, ev.roc_points, ev.precision_recall_points):
        assert sorted(map(str, measure(df).collect())) == sorted(map(str, measure(whole).collect()))
