"""Fitted models. Most have no SQL form; tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.functions import exprs as X
from skirmish.operators import ratings
from skirmish.operators.descent import kept
from skirmish.operators.evaluation import scores
from skirmish.plans.contest import CONTEST, FORECAST, TEAMS, Tables, with_
from skirmish.plans.meetings import pair_series
from skirmish.plans.registry import query


def series(t: Tables) -> DataFrame:
    """Finished contests as series: a pair's contests of a group in a month. a, b, score of a (1, 0, or a half for a tie), weight.

    Their number is bounded by teams, groups and months, whatever the number of contests, so all of them fit a task.
    """
    score = F.when(F.col("wins") > F.col("losses"), 1.0).when(F.col("wins") < F.col("losses"), 0.0).otherwise(0.5)
    return pair_series(t).select("contest_id", "ts", "family", "group_id", "a", "b", score.alias("score"), X.information(F.col("wins"), F.col("losses")).alias("weight"), "wins", "losses")


@query()
def elo_walkforward(t: Tables) -> DataFrame:
    return ratings.walk_forward(series(t), [m for m in ratings.arena() if m["model"] == "elo_k24"])


@query()
def team_arena(t: Tables) -> DataFrame:
    """Scores of 21 rating models, each walking all decided series in order."""
    return ratings.walk_forward(series(t).filter("score <> 0.5")).groupBy("model").agg(*scores())


@query()
def arena_selection(t: Tables) -> DataFrame:
    """The best model of each family and of all, by log loss and then Brier score."""
    table = team_arena(t).withColumn("kind", F.regexp_extract("model", "^[a-z]+", 0))
    best = lambda g: g.agg(F.min_by("model", F.struct("log_loss", "brier")).alias("model"), F.min("log_loss").alias("log_loss"))
    return best(table.groupBy("kind")).unionByName(best(table.groupBy(F.lit("all").alias("kind"))))


@query()
def batch_bt(t: Tables) -> DataFrame:
    return ratings.bradley_terry(series(t), 1_000_000_000, half_life_days=365.0, group="family")


def _pairs(t: Tables) -> DataFrame:
    rows = t.forecast("family", "side0_team", "side1_team")
    p = F.when(F.col("side0_team") < F.col("side1_team"), F.col("p")).otherwise(1 - F.col("p"))
    return rows.groupBy("family", F.least("side0_team", "side1_team").alias("a"), F.greatest("side0_team", "side1_team").alias("b")).agg(F.avg(p).alias("p"))


@query()
def online_bt(t: Tables) -> DataFrame:
    played = series(t).select("family", "a", "b", F.col("score").alias("won"), X.evidence_weight(F.greatest("wins", "losses"), F.least("wins", "losses")).alias("weight"))
    return ratings.online_update(_pairs(t), played, "family")


@query()
def influence_trace(t: Tables) -> DataFrame:
    """What each result of a tournament (a group's contests of a month) adds to the pairs' probabilities of its year."""
    month = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM")
    single = X.information(F.lit(1), F.lit(0))  # each contest is left out by itself, as a single map
    rows = t.finished().select(F.concat_ws("|", "group_id", month).alias("tournament"), "family", "contest_id", F.col("side0_team").alias("a"), F.col("side1_team").alias("b"), F.col("side0_win").cast("double").alias("won"), single.alias("weight"))
    pairs = rows.select("tournament", "family").distinct().join(_pairs(t), "family").select(F.col("tournament").alias("tournament"), "a", "b", "p")  # a new column: rows has the old one
    return ratings.leave_one_out(pairs, rows.drop("family"), "tournament", "contest_id")


@query()
def live_evaluator(t: Tables) -> DataFrame:
    """The online layer replayed: each contest's forecast, and what it was after the results of all days before in its tournament (a group's contests of a month)."""
    month = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM")
    sides = t.contest().select("contest_id", F.col("side0_team").alias("a"), F.col("side1_team").alias("b"))
    rows = t.forecast().join(sides, "contest_id").select("contest_id", F.concat_ws("|", "group_id", month).alias("tournament"), F.floor(F.col("ts") / 86400).alias("day"), "a", "b", "p", F.col("y").alias("won"), X.information(F.lit(1), F.lit(0)).alias("weight"))
    return ratings.prequential_live(rows, "tournament", "day").select("contest_id", "tournament", F.col("won").alias("y"), "p", "p_live")


@query(with_(CONTEST, TEAMS, FORECAST, body="""SELECT version, count(*)::DOUBLE AS xx_0_0, round(sum(p), 4) AS xx_0_1, round(sum(p * p), 4) AS xx_1_1, sum(y)::DOUBLE AS xy_0, round(sum(p * y), 4) AS xy_1 FROM forecast GROUP BY ALL"""))
def normal_sums(t: Tables) -> DataFrame:
    rows = t.forecast().withColumn("one", F.lit(1.0))
    got = ratings.normal_equations(rows, ["p"], "y", "one", "version")
    return got.select("version", "xx_0_0", F.round("xx_0_1", 4).alias("xx_0_1"), F.round("xx_1_1", 4).alias("xx_1_1"), F.col("xy_0").cast("double").alias("xy_0"), F.round("xy_1", 4).alias("xy_1"))


@query()
def ridge_transition(t: Tables) -> DataFrame:
    """Ridge coefficients of a quarter's change on the one before, for four penalties, from one pass of sums."""
    from skirmish.plans.sequences import version_transition_diff

    rows = version_transition_diff(t).withColumn("w", F.col("games").cast("double")).na.drop()
    row = ratings.normal_equations(rows.withColumn("x", F.col("games_change").cast("double")), ["x"], "rate_change", "w").first()
    out = [(lam, *map(float, ratings.solve_ridge(row, 1, lam))) for lam in (0.1, 1.0, 10.0, 100.0)]
    return t.spark.createDataFrame(out, "penalty double, constant double, slope double")


@query()
def live_map_irls(t: Tables) -> DataFrame:
    """Coefficients of the live model: prior logit, lead and lead by time, without constant (sides are symmetric)."""
    rows = t.live().join(t.forecast().select(F.col("contest_id").alias("event_id"), "p", "y"), "event_id")
    g = (F.col("lead") - 20) / 10
    x = rows.select("y", X.logit(F.col("p")).alias("z"), g.alias("g"), (g * ((F.col("t") % 600) / 600)).alias("gt"))
    with kept(x) as held:
        beta = ratings.fit_logistic(held, ["z", "g", "gt"], "y")
    return t.spark.createDataFrame([("z", float(beta[0])), ("g", float(beta[1])), ("gt", float(beta[2]))], "feature string, beta double")


@query()
def combiner_fit(t: Tables) -> DataFrame:
    """A frozen logistic combiner of two forecasts: the teams' rates and the home side's rate."""
    from skirmish.plans.sequences import side_prior

    rows = t.forecast().join(side_prior(t).select("contest_id", F.col("p").alias("q")), "contest_id")
    x = rows.select("y", X.logit(F.col("p")).alias("team"), X.logit(F.col("q")).alias("side"))
    with kept(x) as held:
        beta = ratings.fit_logistic(held, ["team", "side"], "y", ridge=2.0)
    return t.spark.createDataFrame([("team", float(beta[0])), ("side", float(beta[1]))], "feature string, beta double")
