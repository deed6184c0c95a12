"""Ordered state: sessions, series, prefix rates and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions.exprs import logit, shrunk, sigmoid
from skirmish.operators.windows import chrono_split, decayed_counts, earlier_sums, prefix_counts, sessionize, sessionize_global, time_decayed_counts
from skirmish.plans.contest import CONTEST, ENTITIES, FORECAST, LIVE, TEAMS, Tables, with_
from skirmish.plans.registry import query

HOUR = 3600


@query(with_(CONTEST, body="""SELECT contest_id, sum(brk) OVER (ORDER BY ts, contest_id)::BIGINT AS session FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= 28800 AND group_id = lag(group_id) OVER w THEN 0 ELSE 1 END AS brk FROM contest WINDOW w AS (ORDER BY ts, contest_id))"""))
def sessionize_global_previous(t: Tables) -> DataFrame:
    """A contest joins the one just before it among all contests: same group, at most 8 hours later."""
    return sessionize_global(t.contest(), ["group_id"], "ts", "contest_id", 8 * HOUR).select("contest_id", "session")


@query(with_(LIVE, body="""SELECT event_id, match_id, sum(brk) OVER (PARTITION BY match_id ORDER BY t, event_id)::BIGINT AS session FROM (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY match_id ORDER BY t, event_id) <= 28800 THEN 0 ELSE 1 END AS brk FROM live)"""))
def sessionize_keyed(t: Tables) -> DataFrame:
    return sessionize(t.live(), ["match_id"], "t", "event_id", 8 * HOUR).select("event_id", "match_id", "session")


@query(with_(LIVE, body="""SELECT event_id, match_id, coalesce(k, first_k, -session) AS series_id FROM (SELECT *, min(k) OVER (PARTITION BY match_id, session) AS first_k FROM (
  SELECT event_id, match_id, CASE WHEN k % 4 = 0 THEN k END AS k, sum(brk) OVER (PARTITION BY match_id ORDER BY t, event_id)::BIGINT AS session FROM (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY match_id ORDER BY t, event_id) <= 43200 THEN 0 ELSE 1 END AS brk FROM live)))"""))
def sessionize_provider(t: Tables) -> DataFrame:
    """An explicit id wins; a row without one takes the id known in its 12-hour island, else the island's own."""
    rows = sessionize(t.live().withColumn("k", F.when(F.col("k") % 4 == 0, F.col("k"))), ["match_id"], "t", "event_id", 12 * HOUR)
    known = F.min("k").over(Window.partitionBy("match_id", "session"))
    return rows.select("event_id", "match_id", F.coalesce(F.col("k").cast("long"), known.cast("long"), -F.col("session")).alias("series_id"))


SERIES = """series AS (SELECT match_id, session, min(t) AS start_t, max(t) AS last_t, count(*) AS maps, count(*) FILTER (WHERE lead > 20) AS wins,
  string_agg(event_id::VARCHAR, ',' ORDER BY t, event_id) AS ids FROM (SELECT *, sum(brk) OVER (PARTITION BY match_id ORDER BY t, event_id)::BIGINT AS session FROM (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY match_id ORDER BY t, event_id) <= 28800 THEN 0 ELSE 1 END AS brk FROM live)) GROUP BY ALL)"""


def series(t: Tables) -> DataFrame:
    rows = sessionize(t.live(), ["match_id"], "t", "event_id", 8 * HOUR)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id"))), lambda x: x["event_id"].cast("string")), ",")
    return rows.groupBy("match_id", "session").agg(F.min("t").alias("start_t"), F.max("t").alias("last_t"), F.count("*").alias("maps"), F.count_if(F.col("lead") > 20).alias("wins"), ids.alias("ids"))


@query(with_(LIVE, SERIES, body="SELECT *, maps - wins AS losses FROM series"))
def series_rollup(t: Tables) -> DataFrame:
    return series(t).withColumn("losses", F.col("maps") - F.col("wins"))


@query(with_(LIVE, SERIES, body="SELECT match_id, session, CASE WHEN maps >= 4 THEN 5 WHEN maps >= 2 THEN 3 ELSE 1 END AS best_of, greatest(wins, maps - wins) >= (CASE WHEN maps >= 4 THEN 3 WHEN maps >= 2 THEN 2 ELSE 1 END) AS complete FROM series"))
def series_in_progress(t: Tables) -> DataFrame:
    best_of = F.when(F.col("maps") >= 4, 5).when(F.col("maps") >= 2, 3).otherwise(1)
    needed = F.floor(best_of / 2) + 1
    return series(t).select("match_id", "session", best_of.alias("best_of"), (F.greatest("wins", F.col("maps") - F.col("wins")) >= needed).alias("complete"))


#: An entity may be on both sides of a contest: the first side's row comes first.
TURN = "2 * contest_id + side"


@query(with_(CONTEST, ENTITIES, body="""SELECT contest_id, side, entity, prior_games, prior_wins, (prior_wins + 9)::DOUBLE / (prior_games + 18)::DOUBLE AS rate FROM (
  SELECT contest_id, side, entity, count(won) OVER w AS prior_games, coalesce(sum(won) OVER w, 0)::BIGINT AS prior_wins FROM appearances WINDOW w AS (PARTITION BY entity ORDER BY ts, contest_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""))
def prefix_rates(t: Tables) -> DataFrame:
    rows = prefix_counts(t.appearances().withColumn("turn", F.expr(TURN)), ["entity"], "ts", "turn", "won")
    return rows.select("contest_id", "side", "entity", "prior_games", "prior_wins", shrunk(F.col("prior_wins"), F.col("prior_games"), 0.5, 18.0).alias("rate"))


@query(with_(CONTEST, ENTITIES, body="""SELECT contest_id, side, entity, round(coalesce(sum(u) OVER w, 0) * pow(0.72, age), 5) AS games, round(coalesce(sum(u * won) OVER w, 0) * pow(0.72, age), 5) AS wins FROM (
  SELECT *, pow(0.72, -age) AS u FROM (SELECT *, (e - min(e) OVER (PARTITION BY entity))::DOUBLE AS age FROM (
  SELECT a.*, v.e FROM appearances a JOIN (SELECT version, row_number() OVER (ORDER BY min(ts)) AS e FROM finished GROUP BY version) v USING (version))))
  WINDOW w AS (PARTITION BY entity ORDER BY ts, contest_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def decayed_prefix(t: Tables) -> DataFrame:
    """Counts that fade by 0.72 at each new version, in closed form."""
    versions = t.finished().groupBy("version").agg(F.min("ts").alias("since"))
    epochs = versions.select("version", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("since")).alias("e"))
    rows = t.appearances().join(F.broadcast(epochs), "version")  # a row a quarter
    got = decayed_counts(rows.withColumn("turn", F.expr(TURN)), ["entity"], "ts", "turn", "e", "won", 0.72)
    return got.select("contest_id", "side", "entity", F.round("decayed_games", 5).alias("games"), F.round("decayed_wins", 5).alias("wins"))


@query(with_(CONTEST, TEAMS, body="""SELECT contest_id, side, team, round((coalesce(sum(u * won) OVER w, 0) * pow(2.0, -age) + 4) / (coalesce(sum(u) OVER w, 0) * pow(2.0, -age) + 8), 5) AS strength FROM (
  SELECT *, pow(2.0, age) AS u FROM (SELECT *, (ts - min(ts) OVER (PARTITION BY team)) / (86400.0 * 90) AS age FROM team_rows))
  WINDOW w AS (PARTITION BY team ORDER BY ts, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def time_decayed_prefix(t: Tables) -> DataFrame:
    """Wins and games with a half-life of 90 days against an undecayed prior of 8 games."""
    rows = time_decayed_counts(t.team_rows(), ["team"], "ts", "contest_id", "won", 90.0, since=694_224_000)
    return rows.select("contest_id", "side", "team", F.round((F.col("wins") + 4) / (F.col("weight") + 8), 5).alias("strength"))


@query(with_(CONTEST, ENTITIES, body="""SELECT low, high, n, round(residual / (n + 24.0), 5) AS synergy FROM (SELECT a.entity AS low, b.entity AS high, count(*) AS n, sum(a.res) AS residual FROM (
    SELECT r.*, won - avg(r.rate) OVER (PARTITION BY contest_id, side) AS res FROM (
      SELECT *, (coalesce(sum(won) OVER w, 0) + 9.0) / (count(won) OVER w + 18.0) AS rate FROM appearances WINDOW w AS (PARTITION BY entity ORDER BY ts, contest_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) r) a
  JOIN appearances b ON a.contest_id = b.contest_id AND a.side = b.side AND a.entity < b.entity GROUP BY ALL)"""))
def residual_synergy(t: Tables) -> DataFrame:
    """What a pair wins beyond the mean prefix rate of its side."""
    rows = prefix_counts(t.appearances().withColumn("turn", F.expr(TURN)), ["entity"], "ts", "turn", "won").withColumn("rate", shrunk(F.col("prior_wins"), F.col("prior_games"), 0.5, 18.0))
    sides = rows.groupBy("contest_id", "side").agg((F.max("won") - F.avg("rate")).alias("res"), F.array_sort(F.collect_list("entity")).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b > a), lambda b: F.struct(a.alias("low"), b.alias("high")))))
    got = sides.select("res", F.explode(pairs).alias("p")).groupBy("p.low", "p.high").agg(F.count("*").alias("n"), F.sum("res").alias("r"))
    return got.select("low", "high", "n", F.round(F.col("r") / (F.col("n") + 24.0), 5).alias("synergy"))


@query(with_(CONTEST, ENTITIES, body="""SELECT contest_id, side, entity, round((count(*) OVER e + 2.0) / (count(*) OVER v + 300.0), 6) AS propensity FROM appearances
  WINDOW e AS (PARTITION BY version, side, entity ORDER BY ts, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY version, side ORDER BY ts, contest_id, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def event_propensity(t: Tables) -> DataFrame:
    source = t.appearances().select("contest_id", "side", "entity", "ts", "version", F.struct("contest_id", "entity").alias("turn"))
    mine = earlier_sums(source, ["version", "side", "entity"], "ts", "contest_id", {"mine": F.lit(1)})
    both = earlier_sums(mine, ["version", "side"], "ts", "turn", {"all": F.lit(1)}, source=source)
    return both.select("contest_id", "side", "entity", F.round((F.col("mine") + 2.0) / (F.col("all") + 300.0), 6).alias("propensity"))


@query(with_(CONTEST, ENTITIES, body="""SELECT version, entity, games, games - lag(games) OVER w AS games_change, round(rate - lag(rate) OVER w, 6) AS rate_change FROM (
  SELECT v.version, v.since, e.entity, coalesce(g.games, 0) AS games, (coalesce(g.wins, 0) + 9.0) / (coalesce(g.games, 0) + 18.0) AS rate
  FROM (SELECT version, min(ts) AS since FROM finished GROUP BY ALL) v, (SELECT DISTINCT entity FROM appearances) e LEFT JOIN (SELECT version, entity, count(*) AS games, sum(won) AS wins FROM appearances GROUP BY ALL) g ON g.version = v.version AND g.entity = e.entity)
  WINDOW w AS (PARTITION BY entity ORDER BY since)"""))
def version_transition_diff(t: Tables) -> DataFrame:
    """Change of each entity from version to version; absent ones count as no games."""
    rows = t.appearances().groupBy("version", "entity").agg(F.count("*").alias("games"), F.sum("won").alias("wins"))
    versions = t.finished().groupBy("version").agg(F.min("ts").alias("since")).agg(F.collect_list(F.struct("version", "since")).alias("v"))  # a few dozen
    grid = rows.select("entity").distinct().join(F.broadcast(versions)).select("entity", F.explode("v").alias("v")).select("entity", "v.version", "v.since")
    full = grid.join(rows, ["version", "entity"], "left").fillna(0, ["games", "wins"]).withColumn("rate", shrunk(F.col("wins"), F.col("games"), 0.5, 18.0))
    w = Window.partitionBy("entity").orderBy("since")
    return full.select("version", "entity", "games", (F.col("games") - F.lag("games").over(w)).alias("games_change"), F.round(F.col("rate") - F.lag("rate").over(w), 6).alias("rate_change"))


@query(with_(CONTEST, body="""SELECT contest_id, fold FROM finished JOIN (SELECT version, CASE WHEN r >= floor(n * 0.8) THEN 2 WHEN r >= floor(n * 0.65) THEN 1 ELSE 0 END AS fold FROM (
  SELECT version, row_number() OVER (ORDER BY min(ts), version) - 1 AS r, count(*) OVER () AS n FROM finished GROUP BY version)) USING (version)"""))
def chronological_split(t: Tables) -> DataFrame:
    return chrono_split(t.finished(), "version", "ts", (0.65, 0.8)).select("contest_id", "fold")


@query(with_(CONTEST, body="""SELECT a.f AS test_fold, count(*) AS train_rows, max(b.ts) AS train_until FROM (SELECT DISTINCT f FROM (SELECT ntile(5) OVER (ORDER BY ts, contest_id) AS f FROM finished)) a
  JOIN (SELECT ts, ntile(5) OVER (ORDER BY ts, contest_id) AS f FROM finished) b ON b.f < a.f GROUP BY ALL"""))
def expanding_folds(t: Tables) -> DataFrame:
    """For each fold in time, how much lies before it. Ranks come from counts of days, so no task sorts all rows; folds are summed, not joined."""
    rows = t.finished().select("ts", "contest_id", F.floor(F.col("ts") / 86400).alias("day"))
    days = rows.groupBy("day").agg(F.count("*").alias("k"))
    order = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("day", F.coalesce(F.sum("k").over(order), F.lit(0)).alias("start"), F.sum("k").over(Window.partitionBy(F.lit(0))).alias("all"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("day").orderBy("ts", "contest_id")) - 1
    small, rest = F.floor(F.col("all") / 5), F.col("all") % 5  # the first folds have one row more
    fold = F.when(rank < rest * (small + 1), F.floor(rank / (small + 1))).otherwise(rest + F.floor((rank - rest * (small + 1)) / F.greatest(small, F.lit(1))))
    folds = rows.join(starts, "day").select("ts", (fold + 1).alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.max("ts").alias("until"))
    w = Window.partitionBy(F.lit(0)).orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    return folds.select(F.col("f").alias("test_fold"), F.sum("n").over(w).alias("train_rows"), F.max("until").over(w).alias("train_until")).filter("train_rows is not null")


@query(with_(CONTEST, TEAMS, body="SELECT contest_id, side, team, (sum(won) OVER w)::BIGINT AS wins, (count(*) OVER w - sum(won) OVER w)::BIGINT AS losses, (count(*) OVER w)::BIGINT AS round FROM team_rows WINDOW w AS (PARTITION BY family, team ORDER BY ts, contest_id ROWS UNBOUNDED PRECEDING)"))
def running_standings(t: Tables) -> DataFrame:
    rows = earlier_sums(t.team_rows(), ["family", "team"], "ts", "contest_id", {"w": F.col("won"), "n": F.lit(1)})
    wins, games = F.col("w") + F.col("won"), F.col("n") + 1
    return rows.select("contest_id", "side", "team", wins.alias("wins"), (games - wins).alias("losses"), games.alias("round"))


@query(with_(CONTEST, TEAMS, FORECAST, body="""SELECT contest_id, n, round(loss, 5) AS log_loss, round(acc, 6) AS accuracy FROM (SELECT contest_id, version, ts, count(*) OVER w AS n,
  avg(-(y * ln(p) + (1 - y) * ln(1 - p))) OVER w AS loss, avg(((p >= 0.5) = (y = 1))::INT) OVER w AS acc FROM forecast WINDOW w AS (PARTITION BY version ORDER BY ts, contest_id ROWS UNBOUNDED PRECEDING))
  QUALIFY row_number() OVER (PARTITION BY version ORDER BY ts DESC, contest_id DESC) <= 24"""))
def running_scores(t: Tables) -> DataFrame:
    """Scores of all forecasts so far, the last 24 of each version."""
    from skirmish.functions.exprs import correct, log_loss

    y, p = F.col("y"), F.col("p")
    one = t.forecast().select("contest_id", "version", "ts", log_loss(y, p).alias("l"), correct(y, p).alias("c"))
    rows = earlier_sums(one, ["version"], "ts", "contest_id", {"n": F.lit(1), "loss": F.col("l"), "right": F.col("c")})
    n = F.col("n") + 1
    sizes = one.groupBy("version").agg(F.count("*").alias("all"))  # a row a quarter
    last = rows.join(F.broadcast(sizes), "version").filter(F.col("all") - n < 24)
    return last.select("contest_id", n.alias("n"), F.round((F.col("loss") + F.col("l")) / n, 5).alias("log_loss"), F.round((F.col("right") + F.col("c")) / n, 6).alias("accuracy"))


@query(with_(CONTEST, body="""SELECT contest_id, p, flag FROM (SELECT contest_id, round(1 / (1 + exp(-(ln(h / (1 - h)) - ln(a / (1 - a))))), 5) AS p, n > 0 AS flag FROM (
  SELECT contest_id, (coalesce(sum(side0_win) OVER w, 0) + 9.0) / (count(*) OVER w + 18.0) AS h, 0.5 AS a, count(*) OVER w AS n FROM finished WINDOW w AS (PARTITION BY family ORDER BY ts, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""))
def side_prior(t: Tables) -> DataFrame:
    """The home side's rate before each contest of a year."""
    rows = earlier_sums(t.finished().select("contest_id", "ts", "family", "side0_win"), ["family"], "ts", "contest_id", {"w": F.col("side0_win"), "n": F.lit(1)})
    h = shrunk(F.col("w"), F.col("n"), 0.5, 18.0)
    return rows.select("contest_id", F.round(sigmoid(logit(h) - logit(F.lit(0.5))), 5).alias("p"), (F.col("n") > 0).alias("flag"))
