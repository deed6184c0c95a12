"""Inference by joins, and the decisions made on forecasts: lookups, labels, gates, calibration and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.functions import exprs as X
from skirmish.operators.evaluation import bins_of_equal_count
from skirmish.plans.contest import CONTEST, ENTITIES, FORECAST, TEAMS, Tables, with_
from skirmish.plans.registry import query

BASE = (CONTEST, TEAMS, FORECAST)
# Scale of a pair's coefficient, half-life in days of a result, and the least sizes of the labels.
SYNERGY_SCALE, HALF_LIFE, HIGH, MEDIUM = 0.04, 45.0, 40.0, 15.0


@query(with_(CONTEST, ENTITIES, body=f"""SELECT contest_id, side, count(*) AS pairs, count(coefficient) AS found, count(*) FILTER (WHERE fresh) AS fresh, coalesce(nullif(round({SYNERGY_SCALE} * coalesce(sum(coefficient), 0), 6), 0), 0) AS value FROM (
  SELECT a.contest_id, a.side, coalesce(x.c, y.c) AS coefficient, x.c IS NOT NULL AS fresh FROM appearances a JOIN appearances b ON a.contest_id = b.contest_id AND a.side = b.side AND a.entity < b.entity
  LEFT JOIN (SELECT low, high, c FROM pairs WHERE family = (SELECT max(family) FROM finished) AND n >= 2) x ON x.low = a.entity AND x.high = b.entity
  LEFT JOIN (SELECT low, high, sum(n * c) / sum(n) AS c FROM pairs WHERE family < (SELECT max(family) FROM finished) GROUP BY ALL HAVING sum(n) >= 3) y ON y.low = a.entity AND y.high = b.entity) GROUP BY ALL""").replace("\nSELECT contest_id, side, count(*) AS pairs", """,
pairs AS (SELECT a.family, a.entity AS low, b.entity AS high, count(*) AS n, avg(a.won) - 0.5 AS c FROM appearances a JOIN appearances b ON a.contest_id = b.contest_id AND a.side = b.side AND a.entity < b.entity GROUP BY ALL)
SELECT contest_id, side, count(*) AS pairs""", 1))
def coefficient_lookup(t: Tables) -> DataFrame:
    """Each side's pairs with the latest year's coefficient, else that of the years before, else none."""
    sides = t.appearances().groupBy("contest_id", "side", "family").agg(F.max("won").alias("won"), F.array_sort(F.collect_list("entity")).alias("x"))
    inside = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b > a), lambda b: F.struct(a.alias("low"), b.alias("high")))))
    pairs = sides.select("contest_id", "side", "family", "won", F.explode(inside).alias("p")).select("contest_id", "side", "family", "won", "p.low", "p.high")
    sums = pairs.groupBy("family", "low", "high").agg(F.count("*").alias("n"), (F.avg("won") - 0.5).alias("c"))
    last = t.finished().agg(F.max("family").alias("last"))  # one row
    sums = sums.join(F.broadcast(last))
    fresh = sums.filter("family = last and n >= 2").select("low", "high", F.col("c").alias("active"))
    legacy = sums.filter("family < last").groupBy("low", "high").agg((F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("legacy"), F.sum("n").alias("n")).filter("n >= 3").drop("n")
    rows = pairs.join(fresh, ["low", "high"], "left").join(legacy, ["low", "high"], "left").withColumn("c", F.coalesce("active", "legacy"))
    return rows.groupBy("contest_id", "side").agg(F.count("*").alias("pairs"), F.count("c").alias("found"), F.count("active").alias("fresh"), F.round(SYNERGY_SCALE * F.coalesce(F.sum("c"), F.lit(0.0)), 6).alias("value"))


@query(with_(CONTEST, TEAMS, body=f"""SELECT a, b, round(effective, 4) AS effective, CASE WHEN effective >= {HIGH} THEN 'high' WHEN effective >= {MEDIUM} THEN 'medium' ELSE 'low' END AS label, round(least(0.18, 0.04 + 0.32 / sqrt(4 + effective)), 4) AS uncertainty FROM (
  SELECT p.a, p.b, least(x.s, y.s) AS effective FROM (SELECT DISTINCT least(side0_team, side1_team) AS a, greatest(side0_team, side1_team) AS b FROM finished) p
  JOIN samples x ON x.team = p.a JOIN samples y ON y.team = p.b)""").replace("\nSELECT a, b, round(effective", f""",
samples AS (SELECT team, sum(pow(0.5, ((SELECT max(ts) FROM finished) - ts) / 86400.0 / {HALF_LIFE})) AS s FROM team_rows GROUP BY team)
SELECT a, b, round(effective""", 1))
def effective_sample(t: Tables) -> DataFrame:
    """The smaller decayed number of contests of a pair's teams, its label, and the uncertainty that it leaves."""
    now = t.finished().agg(F.max("ts").alias("now"))  # one row
    weight = F.pow(F.lit(0.5), (F.col("now") - F.col("ts")) / 86400.0 / HALF_LIFE)
    samples = t.team_rows().join(F.broadcast(now)).groupBy("team").agg(F.sum(weight).alias("s"))
    pairs = t.finished().select(F.least("side0_team", "side1_team").alias("a"), F.greatest("side0_team", "side1_team").alias("b")).distinct()
    rows = pairs.join(samples.select(F.col("team").alias("a"), F.col("s").alias("x")), "a").join(samples.select(F.col("team").alias("b"), F.col("s").alias("y")), "b").withColumn("effective", F.least("x", "y"))
    label = F.when(F.col("effective") >= HIGH, "high").when(F.col("effective") >= MEDIUM, "medium").otherwise("low")
    return rows.select("a", "b", F.round("effective", 4).alias("effective"), label.alias("label"), F.round(F.least(F.lit(0.18), 0.04 + 0.32 / F.sqrt(4 + F.col("effective"))), 4).alias("uncertainty"))


@query(with_(CONTEST, TEAMS, body="""SELECT family, count(*) AS paths, count(DISTINCT path) AS different, round(1 - count(DISTINCT path) / count(*), 6) AS duplicate_rate FROM (
  SELECT family, team, version, string_agg(won::VARCHAR, '' ORDER BY ts, contest_id) AS path FROM team_rows GROUP BY ALL) GROUP BY ALL"""))
def distinct_paths(t: Tables) -> DataFrame:
    """Different runs of results: exact counts of path hashes."""
    steps = F.array_sort(F.collect_list(F.struct("ts", "contest_id", "won")))
    paths = t.team_rows().groupBy("family", "team", "version").agg(F.sha2(F.array_join(F.transform(steps, lambda s: s["won"].cast("string")), ""), 256).alias("path"))
    got = paths.groupBy("family").agg(F.count("*").alias("paths"), F.count_distinct("path").alias("different"))
    return got.withColumn("duplicate_rate", F.round(1 - F.col("different") / F.col("paths"), 6))


@query(with_(*BASE, body="""SELECT 'equal_count' AS kind, round(sum(n * gap) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM (
  SELECT y, p, (row_number() OVER (ORDER BY p, contest_id) - 1) // ceil(count(*) OVER () / 10.0)::BIGINT AS bin FROM forecast) GROUP BY bin)
  UNION ALL SELECT 'fixed_width', round(sum(n * gap) / sum(n), 6) FROM (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM forecast GROUP BY least(9, floor(p * 10)))"""))
def calibration_error(t: Tables) -> DataFrame:
    """The expected calibration error itself, over bins of equal count and of equal width."""
    gap = F.abs(F.avg("p") - F.avg("y")).alias("gap")
    whole = lambda bins, kind: bins.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece")).select(F.lit(kind).alias("kind"), "ece")
    equal = bins_of_equal_count(t.forecast(), "p", "contest_id").groupBy("bin").agg(F.count("*").alias("n"), gap)
    width = t.forecast().groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).alias("bin")).agg(F.count("*").alias("n"), gap)
    return whole(equal, "equal_count").unionByName(whole(width, "fixed_width"))


def _best_of_sql(n: int) -> str:
    return {3: "(q * q * (3 - 2 * q))", 5: "(q * q * q * (10 - 15 * q + 6 * q * q))"}[n]


_TEMPERED = "1 / (1 + exp(-ln(r / (1 - r)) / (0.65 + 0.005 * k)))"
_CLAMPED = "greatest(0.001, least(0.999, {0}))"


@query(with_(*BASE, body=f"""SELECT maps, 0.65::DOUBLE + 0.005::DOUBLE * best AS temperature FROM (SELECT maps, arg_min(k, (loss, k)) AS best FROM (SELECT maps, k, round(avg(-(y * ln({_CLAMPED.format('c')}) + (1 - y) * ln(1 - {_CLAMPED.format('c')}))), 9) AS loss FROM (
  SELECT maps, k, y, {_TEMPERED} AS c FROM (SELECT maps, y, {_CLAMPED.format('raw')} AS r FROM (
    SELECT 3 AS maps, y, {_best_of_sql(3)} AS raw FROM (SELECT y, {_CLAMPED.format('p')} AS q FROM forecast) UNION ALL SELECT 5, y, {_best_of_sql(5)} FROM (SELECT y, {_CLAMPED.format('p')} AS q FROM forecast))), (SELECT unnest(range(0, 201))::INT AS k)) GROUP BY ALL) GROUP BY ALL)"""))
def series_temperature(t: Tables) -> DataFrame:
    """For series of 3 and 5 maps, the best of 201 temperatures. Rows meet the temperatures in their own task; 402 partial sums a task are shuffled."""
    p = F.col("p")
    kinds = F.array(*[F.struct(F.lit(n).alias("maps"), X.logit(X.best_of(p, n)).alias("z")) for n in (3, 5)])
    rows = t.forecast().select("y", F.explode(kinds).alias("s")).select("y", "s.maps", "s.z", F.explode(F.sequence(F.lit(0), F.lit(200))).alias("k"))
    temp = 0.65 + 0.005 * F.col("k")
    loss = rows.groupBy("maps", "k").agg(F.round(F.avg(X.log_loss(F.col("y"), X.sigmoid(F.col("z") / temp))), 9).alias("loss"))
    best = loss.groupBy("maps").agg(F.min_by("k", F.struct("loss", "k")).alias("k"))
    return best.select("maps", temp.alias("temperature"))


@query(with_(*BASE, body="""SELECT version, round(loss_delta, 5) AS loss_delta, round(brier_delta, 5) AS brier_delta, round(upper95, 5) AS upper95, groups,
  CASE WHEN groups < 3 THEN 'insufficient' WHEN round(loss_delta, 5) < 0 AND round(brier_delta, 5) < 0 AND round(upper95, 5) < 0 THEN 'candidate' WHEN round(loss_delta, 5) < 0 THEN 'experimental' ELSE 'shadow' END AS status FROM (
  SELECT version, sum(l) / sum(n) AS loss_delta, sum(b) / sum(n) AS brier_delta, avg(l / n) + 1.96 * coalesce(stddev_samp(l / n), 0) / sqrt(count(*)) AS upper95, count(*) AS groups FROM (
    SELECT version, group_id, count(*) AS n, sum(-(y * ln(greatest(0.001, least(0.999, p))) + (1 - y) * ln(1 - greatest(0.001, least(0.999, p)))) - ln(2.0)) AS l, sum((p - y) * (p - y) - 0.25) AS b FROM forecast GROUP BY ALL) GROUP BY ALL)"""))
def acceptance_gates(t: Tables) -> DataFrame:
    """A model against the neutral forecast in each version: deltas, the upper bound of the mean over tournament groups, and the verdict."""
    y, p = F.col("y"), F.col("p")
    groups = t.forecast().groupBy("version", "group_id").agg(F.count("*").alias("n"), F.sum(X.log_loss(y, p) - F.ln(F.lit(2.0))).alias("l"), F.sum((p - y) * (p - y) - 0.25).alias("b"))
    each = F.col("l") / F.col("n")
    got = groups.groupBy("version").agg(F.round(F.sum("l") / F.sum("n"), 5).alias("loss_delta"), F.round(F.sum("b") / F.sum("n"), 5).alias("brier_delta"), F.round(F.avg(each) + 1.96 * F.coalesce(F.stddev_samp(each), F.lit(0.0)) / F.sqrt(F.count("*")), 5).alias("upper95"), F.count("*").alias("groups"))
    better = F.col("loss_delta") < 0
    status = F.when(F.col("groups") < 3, "insufficient").when(better & (F.col("brier_delta") < 0) & (F.col("upper95") < 0), "candidate").when(better, "experimental").otherwise("shadow")
    return got.withColumn("status", status)


@query("""SELECT view_key, version, CASE WHEN failed AND NOT ready THEN 'error' WHEN building THEN 'running' ELSE 'ready' END AS status, ready AND building AND building_hash <> input_hash AS stale FROM (
  SELECT o_custkey AS view_key, count(*) AS version, bool_or(o_orderstatus = 'F') AS ready, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'P' AS failed, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'O' AS building,
    max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS input_hash, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS building_hash FROM orders GROUP BY ALL)""")
def read_model_freshness(t: Tables) -> DataFrame:
    """State of each materialised view from its log: ready, running or failed, and whether a build on newer input is under way."""
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("last")
    done = F.col("o_orderstatus") == "F"
    rows = t.orders.groupBy(F.col("o_custkey").alias("view_key")).agg(F.count("*").alias("version"), F.bool_or(done).alias("ready"), F.max(F.when(done, F.col("o_orderkey"))).alias("input_hash"), last)
    building, failed = F.col("last.o_orderstatus") == "O", F.col("last.o_orderstatus") == "P"
    status = F.when(failed & ~F.col("ready"), "error").when(building, "running").otherwise("ready")
    return rows.select("view_key", "version", status.alias("status"), (F.col("ready") & building & (F.col("last.o_orderkey") != F.col("input_hash"))).alias("stale"))
