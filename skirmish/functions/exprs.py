"""Column functions of the contest domain. They take and return Columns and stay in generated code."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column, bound: float | None = None) -> Column:
    x = clamp(x, -bound, bound) if bound is not None else x
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column, low: float = 0.001) -> Column:
    p = clamp(p, low, 1 - low)
    return F.ln(p / (1 - p))


def round_js(x: Column, digits: int = 0) -> Column:
    """Half up towards positive infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def shrunk(wins: Column, games: Column, prior: Column | float = 0.5, weight: float = 8.0) -> Column:
    """A rate drawn towards a prior that counts as `weight` games."""
    return (wins + prior * F.lit(float(weight))) / (games + F.lit(float(weight)))


def pair_low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def pair_high(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def pair_key(a: Column, b: Column, sep: str = "|") -> Column:
    """The unordered pair's key: by text for text columns, by value for numbers."""
    return F.concat(F.least(a, b).cast("string"), F.lit(sep), F.greatest(a, b).cast("string"))


def oriented(p: Column, a: Column, b: Column) -> Column:
    """A probability stored for the lower of the pair, as seen by a."""
    return F.when(a <= b, p).otherwise(1 - p)


def best_of(p: Column, maps: int = 3) -> Column:
    """Probability to win a series of at most `maps` maps."""
    p = clamp(p, 0.001, 0.999)
    terms = [F.lit(float(comb(maps, k))) * F.pow(p, F.lit(float(k))) * F.pow(1 - p, F.lit(float(maps - k))) for k in range(maps // 2 + 1, maps + 1)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def implied_map(series: Column, maps: int = 3, steps: int = 60) -> Column:
    """The map probability whose series probability is given, by bisection."""
    target = clamp(series, 0.001, 0.999)
    start = F.struct(F.lit(0.001).alias("low"), F.lit(0.999).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        below = best_of(middle, maps) < target
        return F.struct(F.when(below, middle).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["low"] + s["high"]) / 2)


def convert_series(p: Column, from_maps: int = 3, to_maps: int = 5) -> Column:
    return best_of(implied_map(p, from_maps), to_maps)


def information(wins: Column, losses: Column, single: float = 0.6, base: float = 0.72, bonus: float = 0.28) -> Column:
    """How much a series tells: less for a single map, more for a decisive score."""
    maps = wins + losses
    return F.when(maps == 1, F.lit(single)).otherwise(F.lit(base) + F.lit(bonus) * F.abs(wins - losses) / F.greatest(maps, F.lit(1)))


def evidence_weight(winner_score: Column, loser_score: Column, base: float = 0.72, bonus: float = 0.28) -> Column:
    """Weight of a finished series: a sweep gets the whole bonus, a close one the share of its margin."""
    margin = clamp((winner_score - loser_score - 1) / F.greatest(winner_score - 1, F.lit(1)), 0.0, 1.0)
    known = (winner_score >= 0) & (loser_score >= 0) & (winner_score > loser_score)
    return F.when(~F.coalesce(known, F.lit(False)), F.lit(base)).when(loser_score == 0, F.lit(base + bonus)).otherwise(F.lit(base) + F.lit(bonus) * margin)


def score_probability(needed: int, a: int, b: int, first: Column, rest: Column, won_a: int = 0, won_b: int = 0) -> Column:
    """Probability that a series at won_a:won_b ends a:b; the first open map may have its own probability."""
    left_a, left_b = a - won_a, b - won_b
    if left_a < 0 or left_b < 0 or max(a, b) != needed or min(a, b) >= needed:
        return F.lit(0.0)

    def ends(x: int, y: int) -> Column:
        """x wins of a and y of b remain, the last map to the winner, all with the same probability."""
        if x < 0 or y < 0:
            return F.lit(0.0)
        if a == needed:
            if x == 0:
                return F.lit(1.0 if y == 0 else 0.0)
            return F.lit(float(comb(x - 1 + y, y))) * F.pow(rest, F.lit(float(x))) * F.pow(1 - rest, F.lit(float(y)))
        if y == 0:
            return F.lit(1.0 if x == 0 else 0.0)
        return F.lit(float(comb(y - 1 + x, x))) * F.pow(rest, F.lit(float(x))) * F.pow(1 - rest, F.lit(float(y)))

    if left_a == 0 and left_b == 0:
        return F.lit(1.0)
    return first * ends(left_a - 1, left_b) + (1 - first) * ends(left_a, left_b - 1)


def log_loss(y: Column, p: Column, low: float = 0.001) -> Column:
    p = clamp(p, low, 1 - low)
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def brier(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def correct(y: Column, p: Column) -> Column:
    """A probability of one half counts as a call for side 0."""
    return F.when((p >= 0.5) == (y == 1), 1).otherwise(0)


def _imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of unsigned 32-bit numbers, in longs without overflow."""
    high, low = F.shiftright(a, 16), a.bitwiseAND(65535)
    return (F.shiftleft((high * b).bitwiseAND(65535), 16) + low * b).bitwiseAND(4294967295)


def mulberry(seed: Column, k: Column) -> Column:
    """Draw k (from 1) of the counter-based 32-bit generator with this seed: a number in [0, 1)."""
    u32 = lambda x: x.bitwiseAND(4294967295)
    s = u32(seed + _imul(u32(k), F.lit(0x6D2B79F5).cast("long")))
    v = _imul(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(1))
    v = u32(v + _imul(v.bitwiseXOR(F.shiftright(v, 7)), v.bitwiseOR(61))).bitwiseXOR(v)
    return u32(v.bitwiseXOR(F.shiftright(v, 14))) / F.lit(4294967296.0)


def seed_of(text: Column) -> Column:
    """A 32-bit seed: the first eight hex digits of the SHA-256."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def live_map(prior: Column, seconds: Column, lead: Column, c: tuple[float, float, float]) -> Column:
    """Probability of side 0 from the prior and the lead; null before minute 10, after 20, or without a lead."""
    minute = clamp(seconds / 60, 10.0, 20.0)
    thousands = lead / 1000
    raw = F.lit(c[0]) * logit(prior, 0.01) + F.lit(c[1]) * thousands + F.lit(c[2]) * thousands * ((minute - 10) / 10)
    return F.when((seconds >= 600) & (seconds <= 1200) & lead.isNotNull(), clamp(sigmoid(raw, 20.0), 0.01, 0.99))


def live_availability(phase: Column, seconds: Column, lead: Column) -> Column:
    return (
        F.when(phase == "draft", "draft")
        .when(lead.isNull(), "gold_unavailable")
        .when(seconds < 600, "waiting_for_10_minutes")
        .when(seconds > 1200, "outside_validated_range_after_20")
        .when(seconds.isin(600, 900, 1200), "validated_fixed_window")
        .otherwise("validated_window_interpolation")
    )


def live_settled(seconds: Column, lead: Column, kills: Column) -> Column:
    """Whether the state has decided the map already."""
    aligned = (lead == 0) | (kills == 0) | (F.signum(lead) == F.signum(kills))
    size = F.abs(lead)
    return F.coalesce((seconds >= 600) & ((size >= 15000) | ((seconds >= 1200) & (size >= 9000) & (F.abs(kills) >= 8) & aligned) | ((seconds >= 2100) & (size >= 6000) & aligned)), F.lit(False))


def evidence_score(games: Column, direct: Column, roster: Column) -> Column:
    return 100 * (0.6 * (1 - F.exp(-games / 6)) + 0.1 * (1 - F.exp(-direct / 1.5)) + 0.3 * clamp(roster, 0.0, 1.0))


def decision(games: Column, direct: Column, roster: Column, pct: Column, min_margin: float = 5.0) -> Column:
    """roulette, even, pass or pick for a probability in percent and the evidence behind it."""
    evidence, margin = evidence_score(games, direct, roster), F.abs(pct - 50)
    score = round_js(evidence * (0.65 + 0.35 * clamp(margin / 15, 0.0, 1.0)))
    roulette = (evidence < 43) | ((margin < 4) & (evidence < 62))
    half_width = clamp(17 - evidence * 0.11, 4.0, 20.0)
    lower = clamp(F.greatest(pct, 100 - pct) - half_width, 50.0, 99.0)
    return F.when(roulette, "roulette").when(margin < min_margin, "even").when((lower <= 50) | (score < 55), "pass").otherwise("pick")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def shares_of(applied: Column) -> Column:
    """What each of an ordered array of logits adds to the probability: sums of the array up to it, through the sigmoid, less those before it.

    The shares of all of them add up to the probability less a half. Null logits add nothing.
    """
    start = F.struct(F.lit(0.0).alias("z"), F.array().cast("array<double>").alias("out"))

    def step(held: Column, x: Column) -> Column:
        z = held["z"] + F.coalesce(x, F.lit(0.0))
        return F.struct(z.alias("z"), F.concat(held["out"], F.array(sigmoid(z) - sigmoid(held["z"]))).alias("out"))

    return F.aggregate(applied, start, step, lambda held: held["out"])
