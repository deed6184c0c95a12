"""Which tournaments count for a team, what its series weigh, and what that says of pairs; audits of rows and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import exprs as X
from skirmish.operators.joins import first_reason
from skirmish.operators.windows import prefix_counts
from skirmish.plans.contest import CONTEST, ENTITIES, FORECAST, TEAMS, Tables, with_
from skirmish.plans.registry import query
from skirmish.plans.sequences import TURN

# Weight of a tournament by members that its sampled line-up shares with the roster, contests sampled, members of a roster, the half-life of a result in days, and prior series of a pair's direct record.
ROSTER_WEIGHTS, SAMPLED, ROSTER, HALF_LIFE, DIRECT_PRIOR = {5: 1.0, 4: 0.25, 3: 0.07}, 3, 5, 45.0, 6.0
#: Members of a team: entities stand for eight of them.
MEMBERS = 8

_WEIGHT = "CASE overlap " + " ".join(f"WHEN {k} THEN {w}" for k, w in ROSTER_WEIGHTS.items()) + " ELSE 0 END::DOUBLE"
_MONTH = "strftime(make_timestamp(ts * 1000000), '%Y-%m')"
ACCEPTED = f"""members AS (SELECT DISTINCT contest_id, team, entity % {MEMBERS} AS m FROM appearances),
rosters AS (SELECT team, list(m) AS roster FROM (SELECT team, m, row_number() OVER (PARTITION BY team ORDER BY count(*) DESC, m) AS r FROM members GROUP BY team, m) WHERE r <= {ROSTER} GROUP BY team),
lineups AS (SELECT contest_id, team, list(m) AS x FROM members GROUP BY ALL),
sampled AS (SELECT team, tournament, games, contest_id, ts FROM (SELECT team, contest_id, ts, group_id || '|' || {_MONTH} AS tournament, row_number() OVER (PARTITION BY team, group_id || '|' || {_MONTH} ORDER BY ts DESC, contest_id DESC) AS r, count(*) OVER (PARTITION BY team, group_id || '|' || {_MONTH}) AS games FROM team_rows) WHERE r <= {SAMPLED}),
accepted AS (SELECT *, {_WEIGHT} AS weight, CASE WHEN sample IS NULL THEN 'sample_unavailable' WHEN {_WEIGHT} = 0 THEN 'sample_roster_mismatch' ELSE 'accepted' END AS reason FROM (
  SELECT s.team, s.tournament, max(s.games) AS games, arg_max(l.contest_id, (s.ts, s.contest_id)) FILTER (WHERE l.x IS NOT NULL) AS sample, coalesce(arg_max(len(list_intersect(l.x, r.roster)), (s.ts, s.contest_id)) FILTER (WHERE l.x IS NOT NULL), 0) AS overlap
  FROM sampled s LEFT JOIN lineups l ON l.contest_id = s.contest_id AND l.team = s.team LEFT JOIN rosters r ON r.team = s.team GROUP BY ALL))"""


def _tournament() -> Column:
    return F.concat_ws("|", "group_id", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM"))


def accepted(t: Tables) -> DataFrame:
    """team, tournament, games, sample, overlap, weight, reason: the newest of a tournament's last three contests with a line-up decides for all of its contests."""
    members = t.appearances().select("contest_id", "team", (F.col("entity") % MEMBERS).alias("m")).distinct()
    uses = members.groupBy("team", "m").agg(F.count("*").alias("n"))
    rosters = uses.groupBy("team").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "m"))), 1, ROSTER), lambda x: x["m"]).alias("roster"))  # eight members
    lineups = members.groupBy("contest_id", "team").agg(F.collect_set("m").alias("x"))
    rows = t.team_rows().select("team", "contest_id", "ts", _tournament().alias("tournament"))
    games = rows.groupBy("team", "tournament").agg(F.count("*").alias("games"))
    newest = Window.partitionBy("team", "tournament").orderBy(F.desc("ts"), F.desc("contest_id"))
    sampled = rows.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= SAMPLED)
    found = sampled.join(lineups, ["contest_id", "team"], "left").groupBy("team", "tournament").agg(F.max_by(F.struct("contest_id", "x"), F.when(F.col("x").isNotNull(), F.struct("ts", "contest_id"))).alias("s"))
    got = found.join(rosters, "team", "left").join(games, ["team", "tournament"])
    overlap = F.coalesce(F.size(F.array_intersect("s.x", "roster")), F.lit(0))
    overlap = F.when(F.col("s").isNull() | F.col("roster").isNull(), 0).otherwise(overlap)
    weight = F.lit(0.0)
    for k, w in ROSTER_WEIGHTS.items():
        weight = F.when(F.col("overlap") == k, w).otherwise(weight)
    got = got.select("team", "tournament", "games", F.col("s.contest_id").alias("sample"), overlap.cast("long").alias("overlap")).withColumn("weight", weight)
    return got.withColumn("reason", first_reason([("sample_unavailable", F.col("sample").isNull()), ("sample_roster_mismatch", F.col("weight") == 0)]))


@query(with_(CONTEST, ENTITIES, TEAMS, ACCEPTED, body="SELECT team, tournament, games, sample, overlap, weight, reason FROM accepted"))
def tournament_acceptance(t: Tables) -> DataFrame:
    return accepted(t)


_INFO = "CASE WHEN wins + losses = 1 THEN 0.6 ELSE 0.72 + 0.28 * abs(wins - losses) / (wins + losses) END"
WEIGHED = f"""played AS (SELECT side0.team, side0.opponent, group_id || '|' || {_MONTH} AS tournament, max(ts) AS ts, sum(won)::BIGINT AS wins, sum(1 - won)::BIGINT AS losses FROM team_rows side0 GROUP BY ALL),
weighed AS (SELECT p.team, p.opponent, wins::DOUBLE / (wins + losses) AS score, weight * ({_INFO}) * pow(0.5, ((SELECT max(ts) FROM finished) - ts) / 86400.0 / {HALF_LIFE}) AS w FROM played p JOIN accepted a ON a.team = p.team AND a.tournament = p.tournament),
strengths AS (SELECT team, count(*) AS series, sum(w) AS games, sum(w * score) AS wins FROM weighed GROUP BY team)"""


def weighed(t: Tables) -> DataFrame:
    """team, opponent, score, w: each series (a pair's contests of a tournament) from either side, weighed by roster, information and age."""
    played = t.team_rows().groupBy("team", "opponent", _tournament().alias("tournament")).agg(F.max("ts").alias("ts"), F.sum("won").alias("wins"), F.sum(1 - F.col("won")).alias("losses"))
    now = t.finished().agg(F.max("ts").alias("now"))  # one row
    rows = played.join(accepted(t).select("team", "tournament", "weight"), ["team", "tournament"]).join(F.broadcast(now))
    w = F.col("weight") * X.information(F.col("wins"), F.col("losses")) * F.pow(F.lit(0.5), (F.col("now") - F.col("ts")) / 86400.0 / HALF_LIFE)
    return rows.select("team", "opponent", (F.col("wins") / (F.col("wins") + F.col("losses"))).alias("score"), w.alias("w"))


@query(with_(CONTEST, ENTITIES, TEAMS, ACCEPTED, WEIGHED, body="SELECT team, series, round(games, 5) AS effective, round(wins / nullif(games, 0), 5) AS rate FROM strengths"))
def weighted_evidence(t: Tables) -> DataFrame:
    """Each team's effective number of series and its weighted rate."""
    got = weighed(t).groupBy("team").agg(F.count("*").alias("series"), F.sum("w").alias("games"), F.sum(F.col("w") * F.col("score")).alias("wins"))
    return got.select("team", "series", F.round("games", 5).alias("effective"), F.round(F.try_divide("wins", "games"), 5).alias("rate"))


_BO3, _BO5 = "(q * q * (3 - 2 * q))", "(q * q * q * (10 - 15 * q + 6 * q * q))"


@query(with_(CONTEST, ENTITIES, TEAMS, ACCEPTED, WEIGHED, body=f"""SELECT a, b, round(games, 5) AS direct_games, round(p, 5) AS map_p, round({_BO3}, 5) AS raw_bo3, round({_BO5}, 5) AS raw_bo5, round(reliability, 5) AS reliability,
  round(0.5 + ({_BO3} - 0.5) * reliability, 5) AS bo3, round(0.5 + ({_BO5} - 0.5) * reliability, 5) AS bo5 FROM (SELECT *, greatest(0.001, least(0.999, p)) AS q FROM (
    SELECT x.team AS a, y.team AS b, coalesce(d.games, 0) AS games, least(x.reliability, y.reliability) AS reliability, ({DIRECT_PRIOR} / (1 + exp(-(x.s - y.s))) + coalesce(d.wins, 0)) / ({DIRECT_PRIOR} + coalesce(d.games, 0)) AS p
    FROM rated x JOIN rated y ON x.team < y.team LEFT JOIN direct d ON d.team = x.team AND d.opponent = y.team))""").replace("\nSELECT a, b, round(games", """,
rated AS (SELECT s.team, ln((s.wins + 4) / (s.games + 8) / (1 - (s.wins + 4) / (s.games + 8))) AS s, r.reliability FROM strengths s JOIN (SELECT team, avg(weight) AS reliability FROM accepted GROUP BY team) r ON r.team = s.team),
direct AS (SELECT team, opponent, sum(w) AS games, sum(w * score) AS wins FROM weighed GROUP BY ALL)
SELECT a, b, round(games""", 1))
def pair_prediction(t: Tables) -> DataFrame:
    """Every pair of teams: the map from indirect strength and weighted direct record, series of three and five, and these drawn to one half as far as rosters are unreliable."""
    one = weighed(t)
    strength = one.groupBy("team").agg(X.logit(X.shrunk(F.sum(F.col("w") * F.col("score")), F.sum("w"), 0.5, 8.0), 0.0).alias("s"))
    rated = strength.join(accepted(t).groupBy("team").agg(F.avg("weight").alias("r")), "team")
    teams = rated.agg(F.array_sort(F.collect_list(F.struct("team", "s", "r"))).alias("x"))  # a few dozen teams
    pairs = F.flatten(F.transform("x", lambda u: F.transform(F.filter("x", lambda v: v["team"] > u["team"]), lambda v: F.struct(u["team"].alias("a"), v["team"].alias("b"), (u["s"] - v["s"]).alias("gap"), F.least(u["r"], v["r"]).alias("r")))))
    direct = one.groupBy(F.col("team").alias("a"), F.col("opponent").alias("b")).agg(F.sum("w").alias("games"), F.sum(F.col("w") * F.col("score")).alias("wins"))
    rows = teams.select(F.explode(pairs).alias("p")).select("p.*").join(direct, ["a", "b"], "left").fillna(0.0, ["games", "wins"])
    p = (X.sigmoid(F.col("gap")) * DIRECT_PRIOR + F.col("wins")) / (DIRECT_PRIOR + F.col("games"))
    drawn = lambda q: F.round(0.5 + (q - 0.5) * F.col("r"), 5)
    three, five = X.best_of(p, 3), X.best_of(p, 5)
    return rows.select("a", "b", F.round("games", 5).alias("direct_games"), F.round(p, 5).alias("map_p"), F.round(three, 5).alias("raw_bo3"), F.round(five, 5).alias("raw_bo5"), F.round("r", 5).alias("reliability"), drawn(three).alias("bo3"), drawn(five).alias("bo5"))


#: Why a contest has no rich row, in the order of the checks.
REASONS = ("unfinished", "no_events", "no_participants", "no_team_history", "no_entity_history")


@query(with_(CONTEST, ENTITIES, TEAMS, FORECAST, body="""SELECT reason, count(*) AS n, round(avg(total), 2) AS total FROM (SELECT o.o_orderkey, o.o_totalprice AS total, CASE WHEN o.o_orderstatus = 'P' THEN 'unfinished' WHEN coalesce(e.events, 0) = 0 THEN 'no_events' WHEN coalesce(p.least, 0) < 1 THEN 'no_participants'
    WHEN coalesce(f.games, 0) < 8 THEN 'no_team_history' WHEN coalesce(h.known, 0) < 3 THEN 'no_entity_history' ELSE 'accepted' END AS reason FROM orders o
  LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'N') AS events FROM lineitem GROUP BY ALL) e ON e.l_orderkey = o.o_orderkey
  LEFT JOIN (SELECT contest_id, least(count(*) FILTER (WHERE side = 0), count(*) FILTER (WHERE side = 1)) AS least FROM entities GROUP BY ALL) p ON p.contest_id = o.o_orderkey
  LEFT JOIN (SELECT contest_id, min(n) AS games FROM (SELECT contest_id, count(*) OVER (PARTITION BY team ORDER BY ts, contest_id) - 1 AS n FROM team_rows) GROUP BY ALL) f ON f.contest_id = o.o_orderkey
  LEFT JOIN (SELECT contest_id, min(n) AS known FROM (SELECT contest_id, count(*) OVER (PARTITION BY entity ORDER BY ts, contest_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM appearances) GROUP BY ALL) h ON h.contest_id = o.o_orderkey) GROUP BY reason"""))
def rich_rows(t: Tables) -> DataFrame:
    """Contests that have all that a rich row needs (events, participants, the teams' and the entities' history), and the first thing that each of the others lacks."""
    events = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "N").alias("events"))
    sides = t.entities().groupBy(F.col("contest_id").alias("o_orderkey")).agg(F.least(F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)).alias("fewest"))
    teams = prefix_counts(t.team_rows(), ["team"], "ts", "contest_id", "won").groupBy(F.col("contest_id").alias("o_orderkey")).agg(F.min("prior_games").alias("games"))
    known = prefix_counts(t.appearances().withColumn("turn", F.expr(TURN)), ["entity"], "ts", "turn", "won").groupBy(F.col("contest_id").alias("o_orderkey")).agg(F.min("prior_games").alias("known"))
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    for side in (events, sides, teams, known):
        rows = rows.join(side, "o_orderkey", "left")
    below = lambda c, least: F.coalesce(F.col(c), F.lit(0)) < least
    reason = first_reason(list(zip(REASONS, (F.col("o_orderstatus") == "P", below("events", 1), below("fewest", 1), below("games", 8), below("known", 3)), strict=True)))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("total"))


#: What a version must have to stand alone, and to count at all: contests, series, tournaments, teams, contests of an entity, and the share of entities with so many.
ALONE, VIABLE = (1000, 300, 10, 20, 20, 0.9), (200, 100, 5, 20, 5, 0.7)
#: Versions that must stand alone before a model is trained.
NEEDED = 8


def _all_sql(limits: tuple, share: str) -> str:
    return f"maps >= {limits[0]} AND series >= {limits[1]} AND leagues >= {limits[2]} AND teams >= {limits[3]} AND {share} >= {limits[5]}"


GATES = f"""by_version AS (SELECT version, count(*) AS maps, count(DISTINCT group_id || '|' || {_MONTH} || '|' || least(side0_team, side1_team) || '|' || greatest(side0_team, side1_team)) AS series, count(DISTINCT group_id || '|' || {_MONTH}) AS leagues, min(ts) AS since FROM finished GROUP BY version),
covered AS (SELECT version, count(*) FILTER (WHERE n >= {ALONE[4]})::DOUBLE / (SELECT count(DISTINCT entity) FROM appearances) AS covered, count(*) FILTER (WHERE n >= {VIABLE[4]})::DOUBLE / (SELECT count(DISTINCT entity) FROM appearances) AS viable_covered FROM (SELECT version, entity, count(*) AS n FROM appearances GROUP BY ALL) GROUP BY version),
gates AS (SELECT *, {_all_sql(ALONE, 'covered')} AS standalone, {_all_sql(VIABLE, 'viable_covered')} AS viable, since = min(since) OVER () OR since = max(since) OVER () AS partial FROM (
  SELECT v.version, maps, series, leagues, teams, since, coalesce(covered, 0) AS covered, coalesce(viable_covered, 0) AS viable_covered FROM by_version v JOIN (SELECT version, count(DISTINCT team) AS teams FROM team_rows GROUP BY ALL) USING (version) LEFT JOIN covered USING (version)))"""


def gates(t: Tables) -> DataFrame:
    tournament = _tournament()
    pair = F.concat_ws("|", tournament, F.least("side0_team", "side1_team"), F.greatest("side0_team", "side1_team"))
    rows = t.finished().groupBy("version").agg(F.count("*").alias("maps"), F.count_distinct(pair).alias("series"), F.count_distinct(tournament).alias("leagues"), F.min("ts").alias("since"))
    teams = t.team_rows().groupBy("version").agg(F.count_distinct("team").alias("teams"))
    uses = t.appearances().groupBy("version", "entity").agg(F.count("*").alias("n"))
    universe = uses.select("entity").distinct().agg(F.count("*").alias("u"))  # one row
    share = lambda least: F.count_if(F.col("n") >= least) / F.first("u")
    covered = uses.join(F.broadcast(universe)).groupBy("version").agg(share(ALONE[4]).alias("covered"), share(VIABLE[4]).alias("viable_covered"))
    got = rows.join(teams, "version").join(covered, "version", "left").fillna(0.0, ["covered", "viable_covered"])
    passes = lambda limits, c: (F.col("maps") >= limits[0]) & (F.col("series") >= limits[1]) & (F.col("leagues") >= limits[2]) & (F.col("teams") >= limits[3]) & (F.col(c) >= limits[5])
    whole = Window.partitionBy(F.lit(0))  # a row a version
    partial = (F.col("since") == F.min("since").over(whole)) | (F.col("since") == F.max("since").over(whole))
    return got.withColumn("standalone", passes(ALONE, "covered")).withColumn("viable", passes(VIABLE, "viable_covered")).withColumn("partial", partial)


@query(with_(CONTEST, ENTITIES, TEAMS, GATES, body="SELECT version, maps, series, leagues, teams, round(covered, 6) AS covered, round(viable_covered, 6) AS viable_covered, standalone, viable, partial FROM gates"))
def coverage_gates(t: Tables) -> DataFrame:
    """Each version against both sets of limits; the first and last version are cut by the window."""
    return gates(t).select("version", "maps", "series", "leagues", "teams", F.round("covered", 6).alias("covered"), F.round("viable_covered", 6).alias("viable_covered"), "standalone", "viable", "partial")


@query(with_(CONTEST, ENTITIES, TEAMS, GATES, body=f"""SELECT count(*) AS versions, count(*) FILTER (WHERE NOT partial) AS complete, count(*) FILTER (WHERE NOT partial AND viable) AS viable, count(*) FILTER (WHERE NOT partial AND standalone) AS standalone,
  count(*) FILTER (WHERE NOT partial AND standalone) >= {NEEDED} AND count(*) FILTER (WHERE NOT partial AND viable) = count(*) FILTER (WHERE NOT partial) AS sufficient FROM gates"""))
def coverage_deployment(t: Tables) -> DataFrame:
    """Whether enough complete versions stand alone and all of them are viable."""
    n = lambda c: F.count_if(~F.col("partial") & c)
    complete, viable, standalone = n(F.lit(True)), n(F.col("viable")), n(F.col("standalone"))
    return gates(t).agg(F.count("*").alias("versions"), complete.alias("complete"), viable.alias("viable"), standalone.alias("standalone"), ((standalone >= NEEDED) & (viable == complete)).alias("sufficient"))


@query()
def artifact_metadata(t: Tables) -> DataFrame:
    """table, files, bytes, newest (seconds of the last change), rows: what Spark says of each table's files."""
    out = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        m = F.col("_metadata")
        files = getattr(t, name).select(m["file_path"].alias("f"), m["file_size"].alias("b"), m["file_modification_time"].alias("at")).groupBy("f").agg(F.max("b").alias("b"), F.max("at").alias("at"), F.count("*").alias("n"))
        row = files.agg(F.lit(name).alias("table"), F.count("*").alias("files"), F.sum("b").alias("bytes"), F.unix_timestamp(F.max("at")).alias("newest"), F.sum("n").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out
