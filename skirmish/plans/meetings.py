"""Series of a pair's contests, schedules that meet them, assignments of participants, and audits of sources and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import exprs as X
from skirmish.operators.assignment import UNIT, assign
from skirmish.operators.windows import islands
from skirmish.plans.contest import CONTEST, ENTITIES, TEAMS, Tables, with_
from skirmish.plans.records import parse_quality
from skirmish.plans.registry import ORACLES, query

HOUR = 3600
# Hours around a schedule that a contest may lie in, hours of the latest cluster, soft targets of strata.
AROUND, CLUSTER, NEAR = 36 * HOUR, 12 * HOUR, 12 * HOUR
TARGET = 40

SERIES = """meetings AS (SELECT min(contest_id) AS contest_id, max(ts) AS ts, family, group_id, a, b, (sum(won))::BIGINT AS wins, (count(*) - sum(won))::BIGINT AS losses FROM (
  SELECT *, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m') AS month, least(side0_team, side1_team) AS a, greatest(side0_team, side1_team) AS b,
    CASE WHEN side0_team < side1_team THEN side0_win ELSE 1 - side0_win END AS won FROM finished) GROUP BY family, group_id, a, b, month)"""


def pair_series(t: Tables) -> DataFrame:
    """A pair's finished contests of a group in a month: the first id, the last time, wins and losses of the smaller team."""
    won = F.when(F.col("side0_team") < F.col("side1_team"), F.col("side0_win")).otherwise(1 - F.col("side0_win"))
    rows = t.finished().select("contest_id", "ts", "family", "group_id", F.least("side0_team", "side1_team").alias("a"), F.greatest("side0_team", "side1_team").alias("b"), won.alias("won"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM").alias("month"))
    sums = rows.groupBy("family", "group_id", "a", "b", "month").agg(F.min("contest_id").alias("contest_id"), F.max("ts").alias("ts"), F.sum("won").alias("wins"), F.sum(1 - F.col("won")).alias("losses"))
    return sums.drop("month")


@query(with_(CONTEST, SERIES, body="""SELECT contest_id, a, b, wins, losses, round(CASE WHEN wins + losses = 1 THEN 0.6 ELSE 0.72 + 0.28 * abs(wins - losses)::DOUBLE / (wins + losses) END, 6) AS information,
  round(CASE WHEN wins = losses THEN 0.72 WHEN least(wins, losses) = 0 THEN 1.0 ELSE 0.72 + 0.28 * least(1, greatest(0, (abs(wins - losses) - 1)::DOUBLE / greatest(greatest(wins, losses) - 1, 1))) END, 6) AS evidence FROM meetings"""))
def series_information(t: Tables) -> DataFrame:
    """How much each series tells of its pair's strength, and its weight as live evidence."""
    rows = pair_series(t)
    evidence = X.evidence_weight(F.greatest("wins", "losses"), F.least("wins", "losses"))
    return rows.select("contest_id", "a", "b", "wins", "losses", F.round(X.information(F.col("wins"), F.col("losses")), 6).alias("information"), F.round(evidence, 6).alias("evidence"))


@query(with_(CONTEST, TEAMS, body="""SELECT contest_id, team, group_id, sum(brk) OVER (PARTITION BY team, group_id ORDER BY ts, contest_id)::BIGINT AS session FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= 28800 * 30 AND opponent = lag(opponent) OVER w THEN 0 ELSE 1 END AS brk FROM team_rows WINDOW w AS (PARTITION BY team, group_id ORDER BY ts, contest_id))"""))
def sessionize_opponent(t: Tables) -> DataFrame:
    """Sessions of a team in a group: the opponent of the contest before it, and at most ten days since."""
    keys, order = ["team", "group_id"], ["ts", "contest_id"]
    w = Window.partitionBy(*keys).orderBy(*order)
    same = (F.col("ts") - F.lag("ts").over(w) <= 8 * HOUR * 30) & (F.col("opponent") == F.lag("opponent").over(w))
    return islands(t.team_rows(), keys, order, ~F.coalesce(same, F.lit(False)), "session").select("contest_id", "team", "group_id", "session")


@query(with_(CONTEST, f"quality AS ({ORACLES['parse_quality']})", body="""SELECT version, count(*) AS n, round(avg(quality), 4) AS quality, count(*) FILTER (WHERE quality = 1) AS whole, count(*) FILTER (WHERE quality < 0.8) AS poor
  FROM contest JOIN quality USING (contest_id) GROUP BY version"""))
def source_quality(t: Tables) -> DataFrame:
    """Mean quality of each version's records, and how many are whole or poor."""
    rows = t.contest().select("contest_id", "version").join(parse_quality(t), "contest_id")
    return rows.groupBy("version").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 4).alias("quality"), F.count_if(F.col("quality") == 1).alias("whole"), F.count_if(F.col("quality") < 0.8).alias("poor"))


@query("""WITH made AS (SELECT year(o_orderdate)::VARCHAR || 'q' || quarter(o_orderdate)::VARCHAR AS version, o_orderdate AS made_at, o_orderkey FROM orders),
dim AS (SELECT version, since, lead(since) OVER (ORDER BY since) AS until FROM (SELECT version, min(made_at) AS since FROM made GROUP BY ALL))
SELECT version, count(*) AS n, count(*) FILTER (WHERE l_shipdate < since OR coalesce(l_shipdate >= until, false)) AS errors FROM made JOIN dim USING (version) JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def interval_errors(t: Tables) -> DataFrame:
    """Lines dated outside the interval of the version that their order claims."""
    version = F.concat(F.year("o_orderdate").cast("string"), F.lit("q"), F.quarter("o_orderdate").cast("string"))
    made = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", version.alias("version"))
    since = made.groupBy("version").agg(F.min("o_orderdate").alias("since"))
    dim = since.withColumn("until", F.lead("since").over(Window.partitionBy(F.lit(0)).orderBy("since")))  # a row a quarter
    rows = t.lineitem.select("l_orderkey", "l_shipdate").join(made.select("l_orderkey", "version"), "l_orderkey").join(F.broadcast(dim), "version")
    wrong = (F.col("l_shipdate") < F.col("since")) | F.coalesce(F.col("l_shipdate") >= F.col("until"), F.lit(False))
    return rows.groupBy("version").agg(F.count("*").alias("n"), F.count_if(wrong).alias("errors"))


@query(with_(CONTEST, body="""SELECT version, n, max(total) FILTER (WHERE r = least(floor(n * 0.025), n - 1)) AS low, max(total) FILTER (WHERE r = least(floor(n * 0.975), n - 1)) AS high,
  round(quantile_cont(total, 0.025), 6) AS low_between, round(quantile_cont(total, 0.975), 6) AS high_between FROM (
  SELECT version, total, row_number() OVER (PARTITION BY version ORDER BY total) - 1 AS r, count(*) OVER (PARTITION BY version) AS n FROM contest) GROUP BY version, n"""))
def index_percentiles(t: Tables) -> DataFrame:
    """Percentiles by index, floor(n q) of the sorted totals, and interpolated ones. Counts of equal totals are sorted, not rows."""
    counts = t.contest().groupBy("version", "total").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("version").orderBy("total"))
    rows = counts.withColumn("last", upto - 1).withColumn("first", F.col("last") - F.col("k") + 1).withColumn("n", F.sum("k").over(Window.partitionBy("version")))

    def at(q: float) -> tuple:
        return F.least(F.floor(F.col("n") * q), F.col("n") - 1), (F.col("n") - 1) * F.lit(q)

    def holds(i):
        return F.max(F.when((F.col("first") <= i) & (i <= F.col("last")), F.col("total")))

    names = (("low", 0.025), ("high", 0.975))
    whole = [holds(at(q)[0]).alias(name) for name, q in names]
    sides = [holds(f(at(q)[1])).alias(f"{name}_{side}") for name, q in names for side, f in (("under", F.floor), ("over", F.ceil))]
    got = rows.groupBy("version", "n").agg(*whole, *sides)
    between = lambda name, q: F.col(f"{name}_under") + (F.col(f"{name}_over") - F.col(f"{name}_under")) * (at(q)[1] - F.floor(at(q)[1]))
    return got.select("version", "n", "low", "high", *[F.round(between(name, q), 6).alias(f"{name}_between") for name, q in names])


@query("""SELECT o_orderkey AS contest_id, l_linenumber AS slot, l_partkey AS entity FROM (
  SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01' AND o_orderkey < 40000 ORDER BY o_orderkey DESC LIMIT 100) JOIN lineitem ON l_orderkey = o_orderkey""")
def keyset_page_slots(t: Tables) -> DataFrame:
    """A page of contests with their participants: the page is at most 100 rows, so it is sent to the participants."""
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    page = t.orders.filter((F.col("o_orderdate") >= day("1997-01-01")) & (F.col("o_orderdate") < day("1998-01-01")) & (F.col("o_orderkey") < 40000)).select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(100)
    rows = t.lineitem.filter("l_orderkey < 40000").join(F.broadcast(page), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderkey").alias("contest_id"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("entity"))


@query("""WITH c AS (SELECT o_orderkey AS contest_id, year(o_orderdate) AS v, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS g, c_nationkey AS team FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT v, month, count(*) AS n FROM c GROUP BY ALL), l AS (SELECT v, g, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT v, team, count(*) AS n FROM c GROUP BY ALL)
SELECT contest_id, 1000 * ((m.n < 40)::INT + (l.n < 40)::INT + (p.n < 40)::INT) - least(m.n, l.n, p.n) AS priority FROM c JOIN m USING (v, month) JOIN l USING (v, g) JOIN p USING (v, team)""")
def collection_strata(t: Tables) -> DataFrame:
    """What to collect next over three strata of a version (here a year): month, group and team."""
    home = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team"))
    c = t.orders.select("o_custkey", F.col("o_orderkey").alias("contest_id"), F.year("o_orderdate").alias("v"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("g")).join(home, "o_custkey")
    rows, names = c, []
    for key in ("month", "g", "team"):
        names.append(f"n_{key}")
        rows = rows.join(F.broadcast(c.groupBy("v", key).agg(F.count("*").alias(f"n_{key}"))), ["v", key])  # some hundred rows
    scarce = sum(((F.col(n) < TARGET).cast("int") for n in names), F.lit(0))
    return rows.select("contest_id", (1000 * scarce - F.least(*names)).alias("priority"))


SCHEDULE = """played AS (SELECT contest_id AS other, CASE WHEN contest_id % 13 = 0 THEN NULL ELSE ts END AS ts, group_id, version, least(side0_team, side1_team) AS low, greatest(side0_team, side1_team) AS high FROM finished),
open_ AS (SELECT contest_id, CASE WHEN contest_id % 7 = 0 THEN NULL ELSE ts END AS ts, group_id, version, least(side0_team, side1_team) AS low, greatest(side0_team, side1_team) AS high FROM contest WHERE side0_win IS NULL)"""


def _schedule(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Open contests (some without a time) and finished ones (some without), with their pairs."""
    rows = t.contest().select("contest_id", "ts", "group_id", "version", F.least("side0_team", "side1_team").alias("low"), F.greatest("side0_team", "side1_team").alias("high"), "side0_win")
    time = lambda m: F.when(F.col("contest_id") % m != 0, F.col("ts"))
    return rows.filter("side0_win is null").withColumn("ts", time(7)).drop("side0_win"), rows.filter("side0_win is not null").withColumn("ts", time(13)).drop("side0_win").withColumnRenamed("contest_id", "other")


@query(with_(CONTEST, SCHEDULE, body=f"""SELECT o.contest_id, p.other, 'around' AS rule FROM open_ o JOIN played p ON o.low = p.low AND o.high = p.high AND abs(o.ts - p.ts) <= {AROUND}
UNION ALL SELECT o.contest_id, p.other, 'untimed' FROM open_ o JOIN played p ON o.low = p.low AND o.high = p.high AND o.ts IS NOT NULL AND p.ts IS NULL AND o.version = p.version AND o.group_id = p.group_id
UNION ALL SELECT o.contest_id, p.other, 'cluster' FROM open_ o JOIN (SELECT *, max(ts) OVER (PARTITION BY low, high) AS last FROM played) p ON o.low = p.low AND o.high = p.high AND o.ts IS NULL AND p.last - p.ts <= {CLUSTER}"""))
def schedule_contests(t: Tables) -> DataFrame:
    """Contests of a scheduled pair: those within 36 hours, those without a time in its stage; for a schedule without a time the pair's latest 12 hours.

    Times meet by cells of 36 hours, so that a pair with many contests is no single group.
    """
    left, right = _schedule(t)
    pair = ["low", "high"]
    cell = lambda c: F.floor(F.col(c) / AROUND)
    timed = left.filter("ts is not null").select("contest_id", F.col("ts").alias("at"), *pair).withColumn("cell", cell("at"))
    cells = right.filter("ts is not null").select("other", "ts", *pair).withColumn("cell", F.explode(F.array(*[cell("ts") + d for d in (-1, 0, 1)])))
    around = timed.join(cells, [*pair, "cell"]).filter(F.abs(F.col("at") - F.col("ts")) <= AROUND).select("contest_id", "other", F.lit("around").alias("rule"))
    stage = [*pair, "version", "group_id"]
    untimed = left.filter("ts is not null").select("contest_id", *stage).join(right.filter("ts is null").select("other", *stage), stage).select("contest_id", "other", F.lit("untimed").alias("rule"))
    last = right.groupBy(*pair).agg(F.max("ts").alias("last"))  # a row a pair
    latest = right.join(last, pair).filter(F.col("last") - F.col("ts") <= CLUSTER).select("other", *pair)
    cluster = left.filter("ts is null").select("contest_id", *pair).join(latest, pair).select("contest_id", "other", F.lit("cluster").alias("rule"))
    return around.unionByName(untimed).unionByName(cluster)


@query(with_(CONTEST, SCHEDULE, body=f"""SELECT other, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(contest_id) END AS linked FROM (
  SELECT p.other, o.contest_id FROM played p JOIN open_ o ON o.low = p.low AND o.high = p.high AND p.ts IS NOT NULL AND (abs(o.ts - p.ts) <= {NEAR} OR (o.ts IS NULL AND o.version = p.version AND o.group_id = p.group_id))
  WHERE o.contest_id % 5 <> 0) GROUP BY ALL"""))
def live_link(t: Tables) -> DataFrame:
    """Running contests meet open, unlinked ones of their pair within 12 hours, or of the same stage if these have no time; one candidate links."""
    left, right = _schedule(t)
    left = left.filter("contest_id % 5 <> 0")  # the others are linked already
    pair, stage = ["low", "high"], ["low", "high", "version", "group_id"]
    live = right.filter("ts is not null")
    cell = lambda c: F.floor(F.col(c) / NEAR)
    timed = left.filter("ts is not null").select("contest_id", F.col("ts").alias("at"), *pair).withColumn("cell", F.explode(F.array(*[cell("at") + d for d in (-1, 0, 1)])))
    near = live.withColumn("cell", cell("ts")).join(timed, [*pair, "cell"]).filter(F.abs(F.col("at") - F.col("ts")) <= NEAR).select("other", "contest_id")
    staged = live.join(left.filter("ts is null").select("contest_id", *stage), stage).select("other", "contest_id")
    return near.unionByName(staged).groupBy("other").agg(F.count("*").alias("candidates"), F.when(F.count("*") == 1, F.min("contest_id")).alias("linked"))


SEATS = 5


@query(with_(CONTEST, ENTITIES, body=f"""SELECT contest_id, side, replace(seats, '{SEATS}', '-') AS seats, round(value / 1e9, 5) + 0 AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY contest_id, side ORDER BY value DESC, seats) AS best FROM dp WHERE i = n AND spare = 0) WHERE best = 1""").replace("WITH contest", "WITH RECURSIVE contest", 1).replace("\nSELECT contest_id, side, replace", f""",
seated AS (SELECT *, (entity + contest_id) % {SEATS} AS seat FROM appearances),
evidence AS (SELECT team, seat, entity, round(1e9 * ln(least(0.95, greatest(0.05, (sum(won) + 4.0) / (count(*) + 8.0))) / (1 - least(0.95, greatest(0.05, (sum(won) + 4.0) / (count(*) + 8.0))))))::BIGINT AS e FROM seated GROUP BY ALL HAVING count(*) >= 2),
sides AS (SELECT contest_id, side, any_value(team) AS team, list(entity ORDER BY entity) AS x, count(*) AS n FROM appearances GROUP BY ALL),
dp AS (SELECT contest_id, side, team, x, n, 0 AS i, 0 AS used, greatest(n - {SEATS}, 0) AS spare, '' AS seats, 0::BIGINT AS value FROM sides
  UNION ALL SELECT contest_id, side, team, x, n, i, used, spare, seats, value FROM (SELECT *, row_number() OVER (PARTITION BY contest_id, side, used, spare ORDER BY value DESC, seats) AS r FROM (
    SELECT d.contest_id, d.side, d.team, d.x, d.n, d.i + 1 AS i, CASE WHEN c.s < {SEATS} THEN d.used + (1 << c.s) ELSE d.used END::INTEGER AS used, d.spare - (c.s = {SEATS})::INT AS spare, d.seats || c.s::VARCHAR AS seats, d.value + coalesce(e.e, 0) AS value
    FROM dp d JOIN (SELECT unnest(range(0, {SEATS + 1}))::INTEGER AS s) c ON d.i < d.n AND (CASE WHEN c.s < {SEATS} THEN (d.used // (1 << c.s)) % 2 = 0 ELSE d.spare > 0 END)
    LEFT JOIN evidence e ON e.team = d.team AND e.seat = c.s AND e.entity = d.x[d.i + 1])) WHERE r = 1)
SELECT contest_id, side, replace""", 1))
def best_assignment(t: Tables) -> DataFrame:
    """Seats for all entities of a side that have most evidence together; ties go to the smaller order of seats. Beyond five entities as few as must stay without.

    Evidence of each entity's seats comes from one join; the orders are weighed within the side's row, by sets of taken seats.
    """
    rows = t.appearances().withColumn("seat", F.pmod(F.col("entity") + F.col("contest_id"), F.lit(SEATS)).cast("int"))
    rate = X.shrunk(F.sum("won"), F.count("*"), 0.5, 8.0)
    known = rows.groupBy("team", "seat", "entity").agg(F.round(UNIT * X.logit(rate, 0.05)).cast("long").alias("e"), F.count("*").alias("n")).filter("n >= 2")
    known = known.groupBy("team", "entity").agg(F.map_from_entries(F.collect_list(F.struct("seat", "e"))).alias("m"))  # at most five seats
    own = F.array(*[F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0).cast("long")) for s in range(SEATS)])
    members = rows.select("contest_id", "side", "team", "entity").join(known, ["team", "entity"], "left").select("contest_id", "side", "entity", own.alias("own"))
    sides = members.groupBy("contest_id", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("entity", "own"))), lambda x: x["own"]).alias("evidence"))
    best = assign(sides, ["contest_id", "side"], SEATS)
    return best.select("contest_id", F.col("side").cast("int").alias("side"), "seats", F.round(F.col("value") / float(UNIT), 5).alias("value"))
