"""Read models: merges, snapshots, point-in-time views, decisions, and live rules in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import exprs as X
from skirmish.operators.joins import upsert
from skirmish.operators.windows import islands
from skirmish.plans.contest import CONTEST, FORECAST, LIVE, TEAMS, Tables, with_
from skirmish.plans.registry import query
from skirmish.streaming.live import state_hash


@query("""WITH o AS (SELECT o_custkey AS owner, o_orderkey AS v, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS prio, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS total FROM orders)
  SELECT owner, arg_max(prio, v) FILTER (WHERE prio IS NOT NULL) AS prio, arg_max(total, v) FILTER (WHERE total IS NOT NULL) AS total, max(v) AS v FROM o GROUP BY ALL""")
def upsert_merge(t: Tables) -> DataFrame:
    """New values that aren't null win column by column."""
    rows = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("v"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("prio"), F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")).alias("total"))
    cut = 3000
    old, new = rows.filter(F.col("v") < cut), rows.filter(F.col("v") >= cut)
    return upsert(old, new, ["owner"], "v")


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS root, (o_orderkey * 7) % 50 AS done, o_orderstatus AS kind FROM orders)
  SELECT root, min(id) FILTER (WHERE kind <> 'P') AS original, arg_max(id, (done, id)) AS latest, count(*) AS revisions FROM s GROUP BY ALL""")
def snapshot_lineage(t: Tables) -> DataFrame:
    """Each root's first published and its furthest snapshot."""
    s = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("root"), ((F.col("o_orderkey") * 7) % 50).alias("done"), F.col("o_orderstatus").alias("kind"))
    return s.groupBy("root").agg(F.min(F.when(F.col("kind") != "P", F.col("id"))).alias("original"), F.max_by("id", F.struct("done", "id")).alias("latest"), F.count("*").alias("revisions"))


@query(with_(CONTEST, body="SELECT contest_id, ts, CASE WHEN ts <= 915148800 - 86400 * 30 THEN side0_win END AS side0_win FROM contest WHERE ts <= 915148800"))
def point_in_time(t: Tables) -> DataFrame:
    """What was known at a time: later contests are absent, results that came later are unknown."""
    at = 915148800
    return t.contest().filter(F.col("ts") <= at).select("contest_id", "ts", F.when(F.col("ts") <= at - 86400 * 30, F.col("side0_win")).alias("side0_win"))


@query(with_(CONTEST, TEAMS, FORECAST, body="""SELECT b.contest_id, (b.contest_id % 90) - 10 AS lead_minutes, CASE WHEN (b.contest_id % 90) - 10 < 0 THEN 'after_start' WHEN (b.contest_id % 90) - 10 < 15 THEN 'late' ELSE 'actionable' END AS timeliness,
  CASE WHEN (b.contest_id % 90) - 10 < 15 THEN 'void' WHEN (p >= 0.5) = (y = 1) THEN 'won' ELSE 'lost' END AS grade FROM forecast b"""))
def bet_grading(t: Tables) -> DataFrame:
    lead = (F.col("contest_id") % 90) - 10
    timely = F.when(lead < 0, "after_start").when(lead < 15, "late").otherwise("actionable")
    grade = F.when(lead < 15, "void").when(X.correct(F.col("y"), F.col("p")) == 1, "won").otherwise("lost")
    return t.forecast().select("contest_id", lead.alias("lead_minutes"), timely.alias("timeliness"), grade.alias("grade"))


@query(with_(CONTEST, TEAMS, FORECAST, body="""SELECT version, variant, count(*) AS n, sum(((q >= 0.5) = (y = 1))::INT)::BIGINT AS correct, round(avg((q - y) * (q - y)), 6) AS brier FROM (
  SELECT version, 'adaptive' AS variant, y, p AS q FROM forecast UNION ALL SELECT version, 'static', y, first_value(p) OVER (PARTITION BY version ORDER BY ts, contest_id) FROM forecast) WHERE greatest(q, 1 - q) >= 0.51 GROUP BY ALL"""))
def decision_eval(t: Tables) -> DataFrame:
    """Accepted calls of the first forecast of a version against those of the current one."""
    first = t.forecast().groupBy("version").agg(F.min_by("p", F.struct("ts", "contest_id")).alias("static"))
    rows = t.forecast().join(F.broadcast(first), "version")  # a row a quarter
    both = rows.select("version", "y", F.explode(F.array(F.struct(F.lit("adaptive").alias("variant"), F.col("p").alias("q")), F.struct(F.lit("static").alias("variant"), F.col("static").alias("q")))).alias("s")).select("version", "y", "s.*")
    y, q = F.col("y"), F.col("q")
    return both.filter(F.greatest(q, 1 - q) >= 0.51).groupBy("version", "variant").agg(F.count("*").alias("n"), F.sum(X.correct(y, q)).alias("correct"), F.round(F.avg(X.brier(y, q)), 6).alias("brier"))


@query(with_(LIVE, body="""SELECT match_id, h AS state_hash, min(event_id) AS event_id, count(*) AS copies FROM (
  SELECT *, sha256(concat_ws('|', phase, (t // 30)::VARCHAR, round(lead / 250)::BIGINT::VARCHAR, (k % 3)::VARCHAR)) AS h FROM live) GROUP BY ALL"""))
def live_dedup_hash(t: Tables) -> DataFrame:
    rows = t.live().withColumn("k3", F.col("k") % 3)
    return rows.groupBy("match_id", state_hash(extra=("k3",)).alias("state_hash")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("copies"))


@query(with_(LIVE, body="""SELECT match_id, max(t) AS last_t, (SELECT max(t) FROM live) - max(t) AS age, CASE WHEN (SELECT max(t) FROM live) - max(t) <= 300 THEN 'fresh' WHEN (SELECT max(t) FROM live) - max(t) <= 7200 THEN 'retained' ELSE 'gone' END AS status FROM live GROUP BY ALL"""))
def grace_retention(t: Tables) -> DataFrame:
    """Matches by the age of their last row: fresh, kept for a while, or gone."""
    last = t.live().groupBy("match_id").agg(F.max("t").alias("last_t"))
    age = F.max("last_t").over(Window.partitionBy(F.lit(0))) - F.col("last_t")  # a row a match
    return last.select("match_id", "last_t", age.alias("age"), F.when(age <= 300, "fresh").when(age <= 7200, "retained").otherwise("gone").alias("status"))


@query(with_(LIVE, body="""SELECT event_id, match_id, row_number() OVER (PARTITION BY match_id, island ORDER BY t, event_id) AS stable FROM (SELECT *, sum(brk) OVER (PARTITION BY match_id ORDER BY t, event_id) AS island FROM (
  SELECT *, CASE WHEN phase = lag(phase) OVER (PARTITION BY match_id ORDER BY t, event_id) THEN 0 ELSE 1 END AS brk FROM live))"""))
def stability_islands(t: Tables) -> DataFrame:
    """How many equal states in a row, counted up to each row."""
    w = Window.partitionBy("match_id").orderBy("t", "event_id")
    rows = islands(t.live(), ["match_id"], ["t", "event_id"], ~F.col("phase").eqNullSafe(F.lag("phase").over(w)) | F.lag("event_id").over(w).isNull())
    return rows.select("event_id", "match_id", F.row_number().over(Window.partitionBy("match_id", "island").orderBy("t", "event_id")).cast("long").alias("stable"))


@query(with_(LIVE, body="SELECT match_id, phase, arg_min(event_id, (t, event_id)) AS frozen_event, arg_min(lead, (t, event_id)) AS frozen_lead, arg_max(lead, (t, event_id)) AS current_lead FROM live GROUP BY ALL"))
def freeze_once(t: Tables) -> DataFrame:
    """The first state of each hash is kept whatever follows."""
    key = F.struct("t", "event_id")
    return t.live().groupBy("match_id", "phase").agg(F.min_by("event_id", key).alias("frozen_event"), F.min_by("lead", key).alias("frozen_lead"), F.max_by("lead", key).alias("current_lead"))


@query(with_(LIVE, body="SELECT event_id, match_id, t FROM live QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY t DESC, event_id DESC) <= 20"))
def history_cap(t: Tables) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy(F.desc("t"), F.desc("event_id"))
    return t.live().withColumn("r", F.row_number().over(w)).filter("r <= 20").select("event_id", "match_id", "t")


@query(with_(LIVE, body="SELECT t // 60 AS minute, count(*) AS calls, count(*) > 2 AS over_budget FROM live GROUP BY ALL"))
def call_budget_minutes(t: Tables) -> DataFrame:
    return t.live().groupBy(F.floor(F.col("t") / 60).alias("minute")).agg(F.count("*").alias("calls")).withColumn("over_budget", F.col("calls") > 2)


@query(with_(CONTEST, TEAMS, FORECAST, body="""SELECT c.contest_id, c.version, c.side0_team, c.side1_team, round(f.p, 6) AS p, s.wins AS team_wins, coalesce(e.n, 0) AS live_rows, CASE WHEN c.side0_win IS NULL THEN 'open' WHEN (f.p >= 0.5) = (c.side0_win = 1) THEN 'right' ELSE 'wrong' END AS status
  FROM contest c LEFT JOIN forecast f USING (contest_id) LEFT JOIN (SELECT family, team, sum(won)::BIGINT AS wins FROM team_rows GROUP BY ALL) s ON s.family = c.family AND s.team = c.side0_team
  LEFT JOIN (SELECT event_id AS contest_id, count(*) AS n FROM events GROUP BY ALL) e ON e.contest_id = c.contest_id"""))
def combined_state(t: Tables) -> DataFrame:
    """Contests with forecast, standing and live rows: the read model of everything."""
    wins = t.team_rows().groupBy("family", F.col("team").alias("side0_team")).agg(F.sum("won").alias("team_wins"))
    live = t.events.groupBy(F.col("event_id").alias("contest_id")).agg(F.count("*").alias("n"))
    rows = t.contest().join(t.forecast().select("contest_id", "p"), "contest_id", "left").join(wins, ["family", "side0_team"], "left").join(live, "contest_id", "left")
    status = F.when(F.col("side0_win").isNull(), "open").when((F.col("p") >= 0.5) == (F.col("side0_win") == 1), "right").otherwise("wrong")
    return rows.select("contest_id", "version", "side0_team", "side1_team", F.round("p", 6).alias("p"), "team_wins", F.coalesce("n", F.lit(0)).alias("live_rows"), status.alias("status"))


@query(with_(CONTEST, TEAMS, body="""SELECT family, hash, hash <> lag(hash) OVER (ORDER BY family) OR lag(hash) OVER (ORDER BY family) IS NULL AS changed FROM (
  SELECT family, sha256(string_agg(team || ':' || w, ',' ORDER BY team)) AS hash FROM (SELECT family, team, sum(won)::BIGINT::VARCHAR AS w FROM team_rows GROUP BY ALL) GROUP BY ALL)"""))
def change_detection(t: Tables) -> DataFrame:
    """A hash of each year's standings, and whether it differs from the year before: what has to be computed anew."""
    per = t.team_rows().groupBy("family", "team").agg(F.sum("won").cast("string").alias("w"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("team", "w"))), lambda x: F.concat(x["team"], F.lit(":"), x["w"])), ",")
    hashed = per.groupBy("family").agg(F.sha2(text.cast("binary"), 256).alias("hash"))
    before = F.lag("hash").over(Window.partitionBy(F.lit(0)).orderBy("family"))  # a row a year
    return hashed.select("family", "hash", ((F.col("hash") != before) | before.isNull()).alias("changed"))


@query("SELECT o_orderkey AS contest_id, ('0x' || substr(sha256('profile:' || o_orderkey::VARCHAR), 1, 8))::BIGINT AS seed FROM orders")
def deterministic_seed(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("contest_id"), X.seed_of(F.concat(F.lit("profile:"), F.col("o_orderkey").cast("string"))).alias("seed"))


@query(with_(CONTEST, body="""SELECT contest_id, key, round(oriented, 6) AS oriented FROM (SELECT contest_id, least(side0_team, side1_team) || '|' || greatest(side0_team, side1_team) AS key,
  CASE WHEN side0_team <= side1_team THEN (total % 100) / 100 ELSE 1 - (total % 100) / 100 END AS oriented FROM contest)"""))
def pair_orientation(t: Tables) -> DataFrame:
    p = (F.col("total") % 100) / 100
    return t.contest().select("contest_id", X.pair_key(F.col("side0_team"), F.col("side1_team")).alias("key"), F.round(X.oriented(p, F.col("side0_team"), F.col("side1_team")), 6).alias("oriented"))


#: A call is made where a side has at least this chance; a variant replaces another only over so many contests.
CALL, EVIDENCE = 0.58, 8
_SCORED = "count(*) AS n, sum(((q >= 0.5) = (y = 1))::INT)::BIGINT AS correct, avg((q - y) * (q - y)) AS brier, avg(-(y * ln(greatest(0.001, least(0.999, q))) + (1 - y) * ln(1 - greatest(0.001, least(0.999, q))))) AS loss"


@query(with_(CONTEST, TEAMS, FORECAST, f"""first AS (SELECT version, arg_min(p, (ts, contest_id)) AS s FROM forecast GROUP BY version)""", body=f"""SELECT a.version, a.n, s.correct AS static_correct, a.correct AS adaptive_correct, accepted, accepted_correct, a.n - accepted AS pass,
  CASE WHEN wins THEN 'adaptive' ELSE 'static' END AS selected, CASE WHEN a.n < {EVIDENCE} THEN 'insufficient_temporal_evidence' WHEN wins THEN 'adaptive_improves_accuracy_and_proper_scores' ELSE 'adaptive_failed_production_gate' END AS reason FROM (
    SELECT a.*, s.correct AS sc, a.n >= {EVIDENCE} AND a.correct >= s.correct AND round(a.brier, 9) < round(s.brier, 9) AND round(a.loss, 9) < round(s.loss, 9) AS wins FROM (
      SELECT version, {_SCORED}, count(*) FILTER (WHERE greatest(q, 1 - q) >= {CALL}) AS accepted, count(*) FILTER (WHERE greatest(q, 1 - q) >= {CALL} AND (q >= 0.5) = (y = 1)) AS accepted_correct FROM (SELECT version, y, p AS q FROM forecast) GROUP BY version) a
    JOIN (SELECT version, {_SCORED} FROM (SELECT version, y, s AS q FROM forecast JOIN first USING (version)) GROUP BY version) s ON s.version = a.version) a
  JOIN (SELECT version, {_SCORED} FROM (SELECT version, y, s AS q FROM forecast JOIN first USING (version)) GROUP BY version) s ON s.version = a.version"""))
def decision_gate(t: Tables) -> DataFrame:
    """For each version: the calls that its current forecasts allow and how many were right, and whether they may replace the version's first forecast."""
    first = t.forecast().groupBy("version").agg(F.min_by("p", F.struct("ts", "contest_id")).alias("s"))
    rows = t.forecast().join(F.broadcast(first), "version")  # a row a version
    y, call = F.col("y"), F.greatest(F.col("p"), 1 - F.col("p")) >= CALL
    both = [f(F.col(q)).alias(f"{name}_{c}") for q, c in (("p", "a"), ("s", "s")) for name, f in (("correct", lambda x: F.sum(X.correct(y, x))), ("brier", lambda x: F.round(F.avg(X.brier(y, x)), 9)), ("loss", lambda x: F.round(F.avg(X.log_loss(y, x)), 9)))]
    got = rows.groupBy("version").agg(F.count("*").alias("n"), F.count_if(call).alias("accepted"), F.count_if(call & (X.correct(y, F.col("p")) == 1)).alias("accepted_correct"), *both)
    enough = F.col("n") >= EVIDENCE
    wins = enough & (F.col("correct_a") >= F.col("correct_s")) & (F.col("brier_a") < F.col("brier_s")) & (F.col("loss_a") < F.col("loss_s"))
    reason = F.when(~enough, "insufficient_temporal_evidence").when(wins, "adaptive_improves_accuracy_and_proper_scores").otherwise("adaptive_failed_production_gate")
    return got.select("version", "n", F.col("correct_s").alias("static_correct"), F.col("correct_a").alias("adaptive_correct"), "accepted", "accepted_correct", (F.col("n") - F.col("accepted")).alias("pass"), F.when(wins, "adaptive").otherwise("static").alias("selected"), reason.alias("reason"))


#: Observations of a match that its history shows.
SHOWN = 120


@query(with_(LIVE, body=f"""SELECT event_id, match_id, t, row_number() OVER (PARTITION BY match_id ORDER BY t, event_id)::INTEGER AS place, (lead > 20) = won AS right_side FROM (
  SELECT *, arg_max(lead, (t, event_id)) OVER (PARTITION BY match_id) > 20 AS won, row_number() OVER (PARTITION BY match_id ORDER BY t DESC, event_id DESC) AS r FROM live) WHERE r <= {SHOWN}"""))
def graded_history(t: Tables) -> DataFrame:
    """The last 120 observations of each match, oldest first, and whether each led to the side that was ahead at the end."""
    last = t.live().groupBy("match_id").agg((F.max_by("lead", F.struct("t", "event_id")) > 20).alias("won"))
    newest = Window.partitionBy("match_id").orderBy(F.desc("t"), F.desc("event_id"))
    rows = t.live().withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= SHOWN)
    place = F.row_number().over(Window.partitionBy("match_id").orderBy("t", "event_id"))
    return rows.join(last, "match_id").select("event_id", "match_id", "t", place.alias("place"), ((F.col("lead") > 20) == F.col("won")).alias("right_side"))
