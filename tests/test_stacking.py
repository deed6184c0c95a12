"""Bounded fits and carried draft models against plain loops."""

import math
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL

from skirmish.operators import descent, transfer
from skirmish.plans import catalogue, stacking
from skirmish.plans.contest import Tables
from skirmish.plans.draft import FEATURES, features


def projected(x, y, project, start, offset=0.0, ridge=0.0, rounds=60_000):
    """Plain projected gradient steps on the mean log loss."""
    w, rate = project(start), 4 / max(np.linalg.eigvalsh(x.T @ x / len(y) + 4 * ridge * np.eye(x.shape[1]))[-1], 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w + offset)))
        new = project(w - rate * (x.T @ (p - y) / len(y) + ridge * w))
        if np.abs(new - w).max() < 1e-14:
            break
        w = new
    return w


def onto_simplex(k):
    """The nearest point whose first k weights are a distribution, by bisection on the level; others are free."""

    def project(v):
        low, high = v[:k].min() - 1, v[:k].max()
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if np.maximum(v[:k] - level, 0).sum() > 1 else (low, level)
        return np.concatenate([np.maximum(v[:k] - low, 0), v[k:]])

    return project


@pytest.mark.parametrize("seed", range(40))
def test_quadratic_minimum(seed):
    """No projected step from the minimum leads away from it."""
    r = np.random.default_rng(seed)
    k, free = int(r.integers(2, 8)), int(r.integers(0, 3))
    a = r.normal(size=(k + free, k + free + 2 * (seed % 3) - 1))
    h, g = a @ a.T + (1e-9 if seed % 5 else 0) * np.eye(k + free), r.normal(size=k + free) * 3
    if seed % 2:
        w, bounds, project = np.append(np.full(k, 1 / k), r.normal(size=free)), descent.Bounds.simplex(k, free), onto_simplex(k)
        h = h + 1e-3 * np.eye(k + free)
    else:
        low = -r.random(k + free) * (r.random(k + free) > 0.3)
        bounds = descent.Bounds(low, low + r.random(k + free) * (r.random(k + free) > 0.2))
        w, project = bounds.low.copy(), lambda v: np.clip(v, bounds.low, bounds.high)
    x = descent.quadratic_minimum(w, g, h, bounds)
    assert np.allclose(project(x), x, atol=1e-9)
    assert np.allclose(project(x - 0.01 * (g + h @ (x - w))), x, atol=1e-6)


def test_boxed_combiner(spark):
    rows = features(Tables(spark, SMALL)).select("y", *FEATURES).toPandas()
    x, y = rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float)
    got = defaultdict(dict)
    for r in catalogue.queries()["boxed_combiner"](spark, SMALL).collect():
        got[r.subset][r.feature] = r.weight
    assert set(got) == {"all", *[f"without {f}" for f in FEATURES]}
    for subset in ("all", "without entity", "without side"):
        on = np.array([subset != f"without {f}" for f in FEATURES], float)
        low = np.where(np.array(FEATURES) == "side", -0.5, 0) * on
        want = projected(x * on, y, lambda w, low=low, on=on: np.clip(w, low, 2.5 * on), 0.1 * on, ridge=0.002)
        assert [got[subset].get(f, 0.0) for f in FEATURES] == pytest.approx(want.tolist(), abs=1e-5)
    assert any(w == 0 for w in got["all"].values()), "a bound holds"


def contests(spark):
    return sorted(stacking.drafted(Tables(spark, SMALL)).collect(), key=lambda r: r.contest_id)


def slow_logits(rows, state, pairs, s):
    """A candidate's draft logit by loops over entities and pairs."""
    out, own = [], state[s.name]
    for r in rows:
        z = 0.0
        if s.kind == "counts":
            for h in r.hero:
                games, wins = own["games"][abs(h) - 1], own["wins"][abs(h) - 1]
                rate = min(0.92, max(0.08, (wins + s.prior / 2) / (games + s.prior)))
                z += s.scales["hero"] * math.copysign(1, h) * (math.log(rate / (1 - rate)) if games else 0)
        else:
            for g, scale in s.scales.items():
                for h in getattr(r, g):
                    if s.alone or g not in pairs or pairs[g][abs(h) - 1] >= transfer.PAIR_GAMES:
                        z += scale * math.copysign(1, h) * own[g][abs(h) - 1]
            if s.dimensions:
                v = own["factors"].reshape(-1, s.dimensions)
                for sign in (1, -1):
                    side = [abs(h) - 1 for h in r.hero if h * sign > 0]
                    z += sign * sum(float(v[a] @ v[b]) for i, a in enumerate(side) for b in side[i + 1 :])
        out.append(z)
    return out


def slow_learn(rows, state, pairs, models=transfer.ARENA):
    """One version by loops: for each epoch, sums over contests, then the step."""
    state = {n: {g: v.copy() for g, v in own.items()} for n, own in state.items()}
    for s in models:
        own = state[s.name]
        if s.kind == "counts":
            for r in rows:
                for h in r.hero:
                    own["games"][abs(h) - 1] += r.weight
                    own["wins"][abs(h) - 1] += r.weight * (r.y if h > 0 else 1 - r.y)
            continue
        for epoch in range(s.epochs):
            g, c, n = ({k: np.zeros(v.size) for k, v in own.items()} for _ in range(3))
            for r, z in zip(rows, slow_logits(rows, state, pairs, s), strict=True):
                p = 1 / (1 + math.exp(-(own["bias"][0] + own["team"][r.team0 - 1] - own["team"][r.team1 - 1] + z)))
                error, v = r.weight * (r.y - p), r.weight * p * (1 - p)
                uses = [("bias", 0, 1.0), ("team", r.team0 - 1, 1.0), ("team", r.team1 - 1, -1.0)]
                uses += [(k, abs(h) - 1, scale * math.copysign(1, h)) for k, scale in s.scales.items() for h in getattr(r, k)]
                if s.dimensions:
                    f = own["factors"].reshape(-1, s.dimensions)
                    for h in r.hero:
                        rest = sum(f[abs(x) - 1] for x in r.hero if x * h > 0) - f[abs(h) - 1]
                        uses += [("factors", (abs(h) - 1) * s.dimensions + d, math.copysign(1, h) * rest[d]) for d in range(s.dimensions)]
                for k, i, x in uses:
                    g[k][i] += error * x
                    c[k][i] += v * x * x
                    n[k][i] += 1
            for k in own:
                for i in range(own[k].size):
                    if n[k][i]:
                        penalty = n[k][i] * (s.pair_l2 if k in ("synergy", "counter") and s.pair_l2 is not None else s.l2)
                        moved = own[k][i] + s.rate * transfer.GAIN / math.sqrt(1 + 0.6 * epoch) * (g[k][i] - penalty * own[k][i]) / (c[k][i] + penalty)
                        own[k][i] = max(-transfer.LIMITS[k], min(transfer.LIMITS[k], moved))
        if s.alone:
            seen = [i for i, w in enumerate(own["hero"]) if w]
            mean = sum(own["hero"][i] for i in seen) / len(seen)
            for i in seen:
                own["hero"][i] -= mean
    new = {k: v.copy() for k, v in pairs.items()}
    for r in rows:
        for h in r.synergy:
            new["synergy"][abs(h) - 1] += 1
        for h in r.counter:
            new["counter"][abs(h) - 1] += h > 0
    return state, new


def test_candidates_equal_loops(spark, monkeypatch):
    """Three versions: what is known before each, and the logits, as loops have them."""
    monkeypatch.setattr(transfer, "PAIR_GAMES", 2)
    rows = contests(spark)
    names = sorted({r.version for r in rows})[:3]
    known = transfer.walk(stacking.drafted(Tables(spark, SMALL)), [(v, stacking.magnitude(v)) for v in names], stacking.CATALOGUE)
    state, pairs = transfer.fresh(stacking.CATALOGUE), {g: np.zeros(stacking.CATALOGUE.entities**2) for g in ("synergy", "counter")}
    for i, v in enumerate(names):
        state = transfer.carried(state, stacking.magnitude(v)) if i else state
        for name, own in state.items():
            for g, w in own.items():
                assert np.allclose(known[v][0][name][g], w, atol=1e-9), (v, name, g)
        assert all((known[v][1][g] == pairs[g]).all() for g in pairs)
        here = [r for r in rows if r.version == v]
        if i == 2:
            import pandas as pd

            c = transfer.Contests(pd.DataFrame([r.asDict() for r in here]))
            for s in transfer.CANDIDATES:
                assert np.allclose(c.draft(s, state[s.name], transfer.enough(pairs)), slow_logits(here, state, pairs, s), atol=1e-9)
            assert np.abs(c.draft(transfer.CANDIDATES[2], state["interactions_balanced"], transfer.enough(pairs))).max() > 0
        state, pairs = slow_learn(here, state, pairs)


def test_carry_shrinks_by_magnitude():
    state = transfer.fresh(transfer.Catalogue(3, 2, 2))
    for own in state.values():
        for v in own.values():
            v[:] = 1.0
    got = transfer.carried(state, 2.0)
    assert got["base"]["team"][0] == pytest.approx(math.exp(-0.24)) and got["hero_role"]["hero"][0] == pytest.approx(math.exp(-0.26))
    assert got["hero_role"]["role"][0] == pytest.approx(0.92 * math.exp(-0.26)) and got["long_memory"]["synergy"][0] == pytest.approx(math.exp(-0.26))
    assert got["factorization_4"]["factors"][0] == pytest.approx(math.exp(-0.18)) and got["interactions_balanced"]["counter"][0] == pytest.approx(math.exp(-0.45))


def test_stack_weights(spark):
    """Weights lie on the simplex, equal plain projected steps, and fall back under 80 results."""
    t = Tables(spark, SMALL)
    names = [v for v, _ in stacking.versions(t)]
    with descent.kept(stacking.candidate_logits(t)) as rows:
        heat = stacking.temperatures(rows, names)
        got = stacking.stack_weights(rows, names, heat)
        held = rows.toPandas()
    order = held["version"].map({v: i for i, v in enumerate(names)}).to_numpy()
    k = len(transfer.CANDIDATES)
    draft = np.stack(held["draft"].tolist())
    for m in range(len(names)):
        assert got[m].min() >= 0 and got[m].sum() == pytest.approx(1)
        past = (order > 0) & (order < m)
        if past.sum() < 80:
            assert got[m].tolist() == pytest.approx([0.8 / k] * k + [0.2])
        if past.sum() < 40:
            assert (heat[m] == 1).all()
    m = len(names) - 1
    past = (order > 0) & (order < m)
    y, base = held["y"].to_numpy(float)[past], held["base"].to_numpy(float)[past]

    def loss(z):
        p = np.clip(1 / (1 + np.exp(-z)), 0.001, 0.999)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for c in range(k):
        tried = [loss(base + draft[past, c] / h) for h in stacking.TEMPERATURES]
        assert tried[int(np.argmin(np.abs(stacking.TEMPERATURES - heat[m, c])))] == pytest.approx(min(tried), abs=1e-12)
    x = np.column_stack([draft[past] / heat[m], np.zeros(past.sum())])
    want = projected(x, y, onto_simplex(k + 1), np.full(k + 1, 1 / (k + 1)), offset=base)
    assert loss(base + x @ got[m]) == pytest.approx(loss(base + x @ want), abs=1e-9)


def test_logit_stack(spark):
    got = {r.what: r.value for r in catalogue.queries()["logit_stack"](spark, SMALL).collect()}
    rows = features(Tables(spark, SMALL)).select("ts", "y", *stacking.STACK).toPandas().sort_values("ts")
    cut = rows["ts"].quantile(0.8, interpolation="lower")
    early = rows[rows["ts"] <= cut]
    x = np.column_stack([early[list(stacking.STACK)].to_numpy(float), np.ones(len(early))])
    y = early["y"].to_numpy(float)
    w = [*[got[f"weight {f}"] for f in stacking.STACK], got["bias"]]
    assert min(w[:-1]) >= 0 and sum(w[:-1]) == pytest.approx(1)
    want = projected(x, y, onto_simplex(len(stacking.STACK)), np.append(np.full(len(stacking.STACK), 1 / len(stacking.STACK)), 0.0))
    assert w == pytest.approx(want.tolist(), abs=0.02)


def test_temporal_draft(spark):
    """The model that stands alone: two versions by loops, and the scores of the second from its forecasts."""
    rows, models = contests(spark), (transfer.TEMPORAL,)
    names = sorted({r.version for r in rows})
    state, pairs = transfer.fresh(stacking.CATALOGUE, models), {g: np.zeros(stacking.CATALOGUE.entities**2) for g in ("synergy", "counter")}
    state, pairs = slow_learn([r for r in rows if r.version == names[0]], state, pairs, models)
    state = transfer.carried(state, stacking.magnitude(names[1]), models)
    here, own = [r for r in rows if r.version == names[1]], state["temporal"]
    z = [own["bias"][0] + own["team"][r.team0 - 1] - own["team"][r.team1 - 1] + d for r, d in zip(here, slow_logits(here, state, pairs, transfer.TEMPORAL), strict=True)]
    p = 1 / (1 + np.exp(-np.array(z)))
    y = np.array([r.y for r in here])
    got = {r.version: r for r in catalogue.queries()["temporal_draft"](spark, SMALL).collect()}
    assert set(got) == {*names, "all"} and got[names[0]].log_loss == pytest.approx(math.log(2))
    mine = got[names[1]]
    assert mine.n == len(here) and mine.brier == pytest.approx(((p - y) ** 2).mean()) and mine.log_loss == pytest.approx(-np.log(np.where(y, p, 1 - p)).mean())
    assert mine.accuracy == pytest.approx(((p >= 0.5) == y).mean()) and mine.weight is None
    loss = sum(got[v].log_loss * got[v].n for v in names[1:]) / sum(got[v].n for v in names[1:])
    assert got["all"].log_loss == pytest.approx(loss) and got["all"].weight == pytest.approx(min(1, max(0.15, (math.log(2) - loss) / 0.015)) if loss < math.log(2) else 0)


def test_symmetric_challenger(spark):
    """Both sides' probabilities add up to one, and the share is the best of all of them."""
    rows = features(Tables(spark, SMALL)).persist()
    cuts = tuple(rows.agg(stacking.F.percentile_approx("ts", [0.65, 0.8], 10_000).alias("c")).first().c)
    one = stacking.symmetric_forecasts(rows, cuts[0]).toPandas().set_index("contest_id").sort_index()
    other = stacking.symmetric_forecasts(rows.select("contest_id", "ts", "y", *FEATURES), cuts[0])
    seen = stacking.flipped(rows.select("contest_id", "ts", "y", *FEATURES)).toPandas().set_index("contest_id").sort_index()
    assert (seen["y"] == 1 - one["y"]).all() and np.allclose(seen["team_prior"], -one["prior"])
    assert np.allclose(other.toPandas().set_index("contest_id").sort_index()["p"], one["p"])
    assert one["p"].between(0, 1).all() and one["p"].std() > 0
    got = {r.what: r.value for r in catalogue.queries()["symmetric_challenger"](spark, SMALL).collect()}
    z = np.log(np.clip(one["p"], 0.001, 0.999) / (1 - np.clip(one["p"], 0.001, 0.999)))

    def loss(share, part):
        q = np.clip(1 / (1 + np.exp(-(one["prior"] + share * (z - one["prior"]))))[part], 0.001, 0.999)
        return float(-np.where(one["y"][part] > 0, np.log(q), np.log(1 - q)).mean())

    middle, end = (one["ts"] > cuts[0]) & (one["ts"] <= cuts[1]), one["ts"] > cuts[1]
    tried = [loss(s, middle) for s in np.linspace(0, 1, 101)]
    assert loss(got["share"], middle) == pytest.approx(min(tried), abs=1e-9)
    assert got["prior_loss"] == pytest.approx(loss(0, end), abs=1e-6) and got["blend_loss"] == pytest.approx(loss(got["share"], end), abs=1e-6)
    rows.unpersist()


def test_forecasts_of_flipped_contests_are_one_less(spark):
    rows = features(Tables(spark, SMALL)).select("contest_id", "ts", "y", *FEATURES)
    pdf = rows.toPandas()
    mirrored = pdf.assign(contest_id=pdf["contest_id"] + 10**9, y=1 - pdf["y"], **{f: -pdf[f] for f in FEATURES})
    import pandas as pd

    both = spark.createDataFrame(pd.concat([pdf, mirrored]))
    p = stacking.symmetric_forecasts(both, int(pdf["ts"].median())).toPandas().set_index("contest_id")["p"]
    assert np.allclose(p.loc[pdf["contest_id"]].to_numpy() + p.loc[mirrored["contest_id"]].to_numpy(), 1, atol=1e-12)
