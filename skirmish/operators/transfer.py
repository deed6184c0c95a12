"""Draft models that carry what they learned from one version of the game to the next, and learn each version from summed gradients."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.operators.descent import sigmoid, summed


@dataclass(frozen=True)
class Settings:
    """One candidate: its groups of weights with their scales, its rate, penalties, epochs, and how fast it forgets."""

    name: str
    kind: str  # linear, factors, or counts
    carry: float
    rate: float = 0.0
    l2: float = 0.0
    epochs: int = 0
    scales: dict[str, float] = field(default_factory=dict)
    pair_l2: float | None = None
    pair_carry: float | None = None
    dimensions: int = 0
    prior: float = 0.0
    keep_team: float = 0.78
    #: Alone: its forecast is of its own bias and teams too, pairs count from their first contest, and entities' weights are centred after each version.
    alone: bool = False


# The nine candidates. Epochs of full-batch steps are a third of the epochs that steps row by row would take.
CANDIDATES = (
    Settings("hero_ridge", "linear", 0.12, 0.025, 0.003, 2, {"hero": 0.28}),
    Settings("hero_role", "linear", 0.13, 0.025, 0.002, 2, {"hero": 0.25, "role": 0.12}),
    Settings("interactions_balanced", "linear", 0.15, 0.022, 0.0025, 3, {"hero": 0.22, "role": 0.09, "synergy": 0.055, "counter": 0.025}, 0.006),
    Settings("interactions_conservative", "linear", 0.2, 0.018, 0.006, 2, {"hero": 0.2, "role": 0.07, "synergy": 0.04, "counter": 0.018}, 0.018),
    Settings("fast_patch_adapter", "linear", 0.34, 0.03, 0.0035, 2, {"hero": 0.23, "role": 0.09, "synergy": 0.045, "counter": 0.02}, 0.012),
    Settings("long_memory", "linear", 0.07, 0.016, 0.002, 3, {"hero": 0.2, "role": 0.08, "synergy": 0.05, "counter": 0.022}, 0.008, 0.13),
    Settings("factorization_4", "factors", 0.18, 0.018, 0.006, 2, {"hero": 0.18, "role": 0.07}, dimensions=4),
    Settings("factorization_8", "factors", 0.24, 0.014, 0.009, 2, {"hero": 0.17, "role": 0.06}, dimensions=8),
    Settings("bayes_patch_decay", "counts", 0.32, scales={"hero": 0.22}, prior=18.0),
)
BASE = Settings("base", "linear", 0.0, 0.028, 0.004, 3)
TEMPORAL = Settings("temporal", "linear", 0.13, 0.055, 0.0008, 3, {"hero": 0.2, "role": 0.08, "synergy": 0.04, "counter": 0.02}, pair_carry=0.22, keep_team=0.72, alone=True)
ARENA = (BASE, *CANDIDATES)
#: A pair's weight counts once so many contests had it. A step is GAIN times the rate, of a diagonal Newton step.
PAIR_GAMES, GAIN = 30, 10.0
#: Bounds of the weights by group, the share of the bias that a candidate keeps at a new version, and how fast the baseline forgets teams.
LIMITS = {"bias": 2.0, "team": 3.0, "hero": 2.5, "role": 2.5, "synergy": 2.5, "counter": 2.5, "factors": 0.8}
KEEP_BIAS, BASE_FORGETS = 0.9, 0.12


@dataclass(frozen=True)
class Catalogue:
    """How many entities, roles and teams there are: properties of the game, which bound every model's size."""

    entities: int
    roles: int
    teams: int

    def sizes(self, s: Settings) -> dict[str, int]:
        of = {"hero": self.entities, "role": self.entities * self.roles, "synergy": self.entities**2, "counter": self.entities**2}
        if s.kind == "counts":
            return {"games": self.entities, "wins": self.entities}
        out = {"bias": 1, "team": self.teams} | {g: of[g] for g in s.scales}
        return out | ({"factors": self.entities * s.dimensions} if s.dimensions else {})


def seed_factors(entities: int, dimensions: int) -> np.ndarray:
    """First embeddings: small numbers from the 32-bit FNV-1a hash of `entity:dimension`."""
    out = np.zeros((entities, dimensions))
    for e in range(entities):
        for d in range(dimensions):
            h = 2166136261
            for c in f"{e}:{d}".encode():
                h = (h ^ c) * 16777619 % 2**32
            out[e, d] = (h / 0xFFFFFFFF - 0.5) * 0.08
    return out


State = dict[str, dict[str, np.ndarray]]


def fresh(catalogue: Catalogue, models: tuple[Settings, ...] = ARENA) -> State:
    state = {s.name: {g: np.zeros(n) for g, n in catalogue.sizes(s).items()} for s in models}
    for s in models:
        if s.dimensions:
            state[s.name]["factors"] = seed_factors(catalogue.entities, s.dimensions).ravel()
    return state


def carried(state: State, magnitude: float, models: tuple[Settings, ...] = ARENA) -> State:
    """The state at the beginning of a version that differs from the one before by `magnitude`."""
    out: State = {}
    for s in models:
        own = np.exp(-s.carry * magnitude)
        pair = np.exp(-(s.pair_carry if s.pair_carry is not None else 1.5 * s.carry) * magnitude)
        team = np.exp(-BASE_FORGETS * magnitude) if s.name == BASE.name else s.keep_team
        keep = {"bias": KEEP_BIAS, "team": team, "hero": own, "role": 0.92 * own, "synergy": pair, "counter": pair, "factors": np.sqrt(own), "games": own, "wins": own}
        out[s.name] = {g: v * keep[g] for g, v in state[s.name].items()}
    return out


class Flat:
    """A column of arrays of signed numbers (index + 1, negative for the second side) as flat arrays: index, sign, row."""

    def __init__(self, column: pd.Series):
        sizes = column.map(len).to_numpy(int)
        values = np.concatenate(column.tolist()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        self.index, self.sign, self.row = np.abs(values) - 1, np.sign(values).astype(float), np.repeat(np.arange(len(sizes)), sizes)
        self.n = len(sizes)

    def total(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.sign * w[self.index], self.n)


class Contests:
    """A batch of contests: teams (index + 1, 0 if unknown), outcomes, weights, and the flat arrays of each group."""

    def __init__(self, batch: pd.DataFrame):
        self.team0, self.team1 = batch["team0"].to_numpy(int), batch["team1"].to_numpy(int)
        self.y, self.weight = batch["y"].to_numpy(float), batch["weight"].to_numpy(float)
        self.groups = {g: Flat(batch[g]) for g in ("hero", "role", "synergy", "counter")}

    def nuisance(self, own: dict[str, np.ndarray]) -> np.ndarray:
        team = np.append(0.0, own["team"])
        return own["bias"][0] + team[self.team0] - team[self.team1]

    def side_sums(self, factors: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the embeddings of a side's entities, and of their squares, by row."""
        hero = self.groups["hero"]
        on = hero.sign == sign
        v, row = factors[hero.index[on]], hero.row[on]
        total = lambda x: np.stack([np.bincount(row, x[:, d], hero.n) for d in range(x.shape[1])], 1)
        return total(v), total(v * v)

    def draft(self, s: Settings, own: dict[str, np.ndarray], seen: dict[str, np.ndarray]) -> np.ndarray:
        """A candidate's draft logit of each contest. seen: which pairs count (see enough)."""
        if s.kind == "counts":
            rate = np.clip((own["wins"] + 0.5 * s.prior) / (own["games"] + s.prior), 0.08, 0.92)
            return s.scales["hero"] * self.groups["hero"].total(np.where(own["games"] > 0, np.log(rate / (1 - rate)), 0))
        out = np.zeros(len(self.y))
        for g, scale in s.scales.items():
            out += scale * self.groups[g].total(own[g] * seen[g] if g in seen and not s.alone else own[g])
        if s.dimensions:
            factors = own["factors"].reshape(-1, s.dimensions)
            for sign in (1, -1):
                total, squares = self.side_sums(factors, sign)
                out += sign * 0.5 * (total**2 - squares).sum(1)
        return out

    def slopes(self, s: Settings, own: dict[str, np.ndarray], seen: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By group: the sums of gradient, curvature and uses of each weight."""
        p = sigmoid(self.nuisance(own) + self.draft(s, own, seen))
        error, v = self.weight * (self.y - p), self.weight * p * (1 - p)
        out = {"bias": (np.array([error.sum()]), np.array([v.sum()]), np.array([float(len(p))]))}
        n = len(own["team"]) + 1
        both = lambda a, sign: (np.bincount(self.team0, a, n) + sign * np.bincount(self.team1, a, n))[1:]
        out["team"] = both(error, -1), both(v, 1), both(np.ones(len(p)), 1)
        for g, scale in s.scales.items():
            f, size = self.groups[g], len(own[g])
            at = lambda x, f=f, size=size: np.bincount(f.index, x, size)
            out[g] = at(scale * f.sign * error[f.row]), at(scale * scale * v[f.row]), at(np.ones(len(f.row)))
        if s.dimensions:
            hero, factors = self.groups["hero"], own["factors"].reshape(-1, s.dimensions)
            up, down = self.side_sums(factors, 1)[0], self.side_sums(factors, -1)[0]
            rest = np.where(hero.sign[:, None] > 0, up[hero.row], down[hero.row]) - factors[hero.index]
            at = lambda x: np.stack([np.bincount(hero.index, x[:, d], len(factors)) for d in range(s.dimensions)], 1).ravel()
            out["factors"] = at(rest * (hero.sign * error[hero.row])[:, None]), at(rest**2 * v[hero.row, None]), at(np.ones_like(rest))
        return out


def enough(pairs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The pairs with at least PAIR_GAMES contests."""
    return {g: v >= PAIR_GAMES for g, v in pairs.items()}


def learn(rows: DataFrame, state: State, pairs: dict[str, np.ndarray], every: tuple[Settings, ...] = ARENA) -> tuple[State, dict[str, np.ndarray]]:
    """The state and pair counts after a version's contests. Every epoch is one pass: tasks sum the gradients of all models, Spark adds them.

    A weight moves by rate * GAIN / sqrt(1 + 0.6 epoch) of gradient / curvature, both with the penalty l2 for each use of the weight.
    """
    state = {name: {g: v.copy() for g, v in own.items()} for name, own in state.items()}
    models, counted = [s for s in every if s.kind != "counts"], [s for s in every if s.kind == "counts"]
    layout = [(s, g, v.size) for s in models for g, v in state[s.name].items()]
    size, heroes = 3 * sum(n for *_, n in layout), round(next(iter(pairs.values())).size ** 0.5)
    extra, seen, widths = 2 * heroes + sum(v.size for v in pairs.values()), enough(pairs), {g: v.size for g, v in pairs.items()}
    for epoch in range(max(s.epochs for s in models)):
        active, first = {s.name for s in models if epoch < s.epochs}, epoch == 0

        def f(batch: pd.DataFrame, active=active, first=first) -> np.ndarray:
            c = Contests(batch)
            parts = []
            for s in models:
                got = c.slopes(s, state[s.name], seen) if s.name in active else {}
                parts += [np.concatenate(got[g]) if g in got else np.zeros(3 * v.size) for g, v in state[s.name].items()]
            if first:
                hero = c.groups["hero"]
                won = np.where(hero.sign > 0, c.y[hero.row], 1 - c.y[hero.row])
                parts += [np.bincount(hero.index, c.weight[hero.row], heroes), np.bincount(hero.index, c.weight[hero.row] * won, heroes)]
                for g, n in widths.items():
                    up = c.groups[g].sign > 0 if g == "counter" else slice(None)
                    parts.append(np.bincount(c.groups[g].index[up], minlength=n).astype(float))
            return np.concatenate(parts)

        total = summed(rows, f, size + extra * first)
        at = 0
        for s, g, n in layout:
            gradient, curvature, uses = total[at : at + 3 * n].reshape(3, n)
            at += 3 * n
            if s.name not in active:
                continue
            own = state[s.name][g]
            penalty = uses * (s.pair_l2 if g in ("synergy", "counter") and s.pair_l2 is not None else s.l2)
            rate = s.rate * GAIN / np.sqrt(1 + 0.6 * epoch)
            own += rate * np.divide(gradient - penalty * own, curvature + penalty, out=np.zeros(n), where=uses > 0)
            np.clip(own, -LIMITS[g], LIMITS[g], out=own)
        if first:
            for s in counted:
                state[s.name]["games"] += total[at : at + heroes]
                state[s.name]["wins"] += total[at + heroes : at + 2 * heroes]
            at += 2 * heroes
            new = {}
            for g, v in pairs.items():
                new[g] = v + total[at : at + v.size]
                at += v.size
    for s in models:
        if s.alone:
            own = state[s.name]["hero"]
            own[own != 0] -= own[own != 0].mean() if own.any() else 0.0
    return state, new


def walk(rows: DataFrame, versions: list[tuple[str, float]], catalogue: Catalogue, models: tuple[Settings, ...] = ARENA) -> dict[str, tuple[State, dict[str, np.ndarray]]]:
    """What every candidate knows when each version begins. versions: name and magnitude of change, in order; rows have `version` and are kept.

    Versions follow each other (the recurrence is the method), but each is learned in parallel over its contests.
    """
    state, pairs = fresh(catalogue, models), {g: np.zeros(catalogue.entities**2) for g in ("synergy", "counter")}
    known = {}
    for i, (version, magnitude) in enumerate(versions):
        state = carried(state, magnitude, models) if i else state
        known[version] = state, pairs
        if i + 1 < len(versions):
            state, pairs = learn(rows.filter(F.col("version") == version), state, pairs, models)
    return known


def forecasts(rows: DataFrame, known: dict[str, tuple[State, dict[str, np.ndarray]]], models: tuple[Settings, ...] = ARENA) -> DataFrame:
    """contest_id, version, y, base (0 without the baseline), draft (array, in the order of the other models): logits of each contest from what was known when its version began.

    What is known is sent to the tasks: versions x candidates x pairs of the catalogue, whatever the number of contests.
    """
    sent = rows.sparkSession.sparkContext.broadcast({v: (state, enough(pairs)) for v, (state, pairs) in known.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for version, part in batch.groupby("version"):
                state, seen = sent.value[version]
                c = Contests(part)
                draft = np.stack([c.draft(s, state[s.name], seen) + (c.nuisance(state[s.name]) if s.alone else 0) for s in models if s.name != BASE.name], 1)
                base = c.nuisance(state[BASE.name]) if BASE.name in state else 0.0
                yield pd.DataFrame({"contest_id": part["contest_id"], "version": version, "y": part["y"], "base": base, "draft": list(draft)})

    return rows.mapInPandas(run, "contest_id long, version string, y int, base double, draft array<double>")
