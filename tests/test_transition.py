"""Ridge fits of version changes and of the live model against fits to the rows themselves."""

import numpy as np
import pytest
from conftest import SMALL

from skirmish.plans import catalogue, transition
from skirmish.plans.contest import Tables


def slow_ridge(x, y, weight, penalty):
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.sqrt(np.clip(weight, 1, 1000))[:, None]
    beta = np.linalg.solve((z * w).T @ z + np.diag([0.0] + [penalty] * x.shape[1]), (z * w).T @ y)
    return lambda a: beta[0] + ((a - mean) / scale) @ beta[1:]


def test_transition_ensemble(spark, monkeypatch):
    monkeypatch.setattr(transition, "ENOUGH", 40)
    rows = transition.transitions(Tables(spark, SMALL)).toPandas()
    names = [f"x_{f}" for f in transition.FEATURES]
    got = {(r.version, r.entity): r for r in catalogue.queries()["transition_ensemble"](spark, SMALL).collect()}
    assert got.keys() == set(zip(rows["version"], rows["entity"], strict=True)) and rows["x_notes"].gt(0).any() and rows["x_numeric"].gt(0).any()
    fitted = 0
    for k in sorted(rows["k"].unique()):
        train, test = rows[(rows["k"] < k) & (rows["after"] >= transition.LEAST_GAMES)], rows[rows["k"] == k]
        for column, use in (("ensemble", names), ("no_notes", [names[i] for i in transition.PLAIN])):
            if len(train) < transition.ENOUGH:
                want = np.zeros(len(test))
            else:
                models = [slow_ridge(train[use].to_numpy(float), train["y"].to_numpy(float), train["weight"].to_numpy(float), p) for p in transition.PENALTIES]
                want = np.mean([m(test[use].to_numpy(float)) for m in models], axis=0)
                fitted += 1
            assert [got[v, e][column] for v, e in zip(test["version"], test["entity"], strict=True)] == pytest.approx(want.tolist(), abs=1e-7)
    assert fitted > 8
    scores = {(r.version, r.model): r for r in catalogue.queries()["transition_scores"](spark, SMALL).collect()}
    for v in rows["version"].unique():
        y = rows[rows["version"] == v]["y"]
        assert scores[v, "no_change"].rmse == pytest.approx(np.sqrt((y**2).mean())) and scores[v, "ensemble"].n == len(y)


def test_live_ridge_grid(spark):
    rows = transition.live_rows(Tables(spark, SMALL)).toPandas()
    got = {r.ridge: r for r in catalogue.queries()["live_ridge_grid"](spark, SMALL).collect()}
    cuts = [rows["t"].quantile(q, interpolation="lower") for q in (transition.LEARN, transition.CHOOSE)]
    early = rows[rows["t"] <= cuts[0]]
    x, y = early[list(transition.LIVE)].to_numpy(float), early["y"].to_numpy(float)
    for ridge, r in got.items():
        w = np.zeros(3)
        for _ in range(80):
            p = 1 / (1 + np.exp(-x @ w))
            w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(3), x.T @ (p - y) + ridge * w)
        assert [r.z, r.g, r.gt] == pytest.approx(w.tolist(), abs=1e-3)
    assert sum(r.chosen for r in got.values()) == 1 and min(got.values(), key=lambda r: r.loss).chosen
