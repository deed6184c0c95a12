"""Win rates, pairs, profiles and standings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions.exprs import logit, round_js, shrunk, sigmoid
from skirmish.operators.joins import pairs_within
from skirmish.plans.contest import CONTEST, ENTITIES, TEAMS, Tables, with_
from skirmish.plans.registry import query


def record(won: str = "won") -> list[Column]:
    return [F.count("*").alias("games"), F.sum(won).alias("wins")]


def rate(prior: Column | float, weight: float) -> Column:
    return F.round(shrunk(F.col("wins"), F.col("games"), prior, weight), 6)


@query(with_(CONTEST, ENTITIES, body="""SELECT entity, count(*) AS games, sum(won)::BIGINT AS wins, max(ts) AS last_ts,
  round((sum(won) + g.p * 18) / (count(*) + 18.0), 6) AS rate FROM appearances, (SELECT avg(won) AS p FROM appearances) g GROUP BY entity, g.p"""))
def entity_rates(t: Tables) -> DataFrame:
    """Games, wins, last game and a rate drawn towards the global one; one shuffle of partial counts."""
    got = t.appearances().groupBy("entity").agg(*record(), F.max("ts").alias("last_ts"))
    every = Window.partitionBy(F.lit(0))  # a row an entity
    prior = F.sum("wins").over(every) / F.sum("games").over(every)
    return got.withColumn("rate", rate(prior, 18.0))


@query(with_(CONTEST, ENTITIES, body="SELECT team, entity, count(*) AS games, sum(won)::BIGINT AS wins, round((sum(won) + 0.5 * 6) / (count(*) + 6.0), 6) AS rate FROM appearances GROUP BY ALL HAVING count(*) >= 2"))
def team_entity_rates(t: Tables) -> DataFrame:
    return t.appearances().groupBy("team", "entity").agg(*record()).filter("games >= 2").withColumn("rate", rate(0.5, 6.0))


@query(with_(CONTEST, body="""SELECT l_suppkey AS account, p_size AS entity, count(DISTINCT contest_id) AS games, count(DISTINCT CASE WHEN won = 1 THEN contest_id END) AS wins,
  round((count(DISTINCT CASE WHEN won = 1 THEN contest_id END) + 3.0) / (count(DISTINCT contest_id) + 6.0), 6) AS rate FROM (
    SELECT l_suppkey, p_size, contest_id, CASE l_linestatus WHEN 'F' THEN side0_win ELSE 1 - side0_win END AS won
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN finished ON contest_id = l_orderkey) GROUP BY ALL"""))
def account_entity_rates(t: Tables) -> DataFrame:
    c = t.finished().select(F.col("contest_id").alias("l_orderkey"), "side0_win")
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("entity"))
    won = F.when(F.col("l_linestatus") == "F", F.col("side0_win")).otherwise(1 - F.col("side0_win"))
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus").join(parts, "l_partkey").join(c, "l_orderkey")
    once = rows.groupBy(F.col("l_suppkey").alias("account"), "entity", "l_orderkey").agg(F.max(won).alias("won"))
    return once.groupBy("account", "entity").agg(*record()).withColumn("rate", rate(0.5, 6.0))


@query(with_(CONTEST, ENTITIES, body="""SELECT a.entity AS low, b.entity AS high, count(*) AS games, sum(a.won)::BIGINT AS wins, round((sum(a.won) + 12.0) / (count(*) + 24.0), 6) AS rate
  FROM appearances a JOIN appearances b ON a.contest_id = b.contest_id AND a.side = b.side AND a.entity < b.entity GROUP BY ALL HAVING count(*) >= 2"""))
def pair_synergy(t: Tables) -> DataFrame:
    """Pairs on one side, made inside the collected side (a few entities), so that rows don't meet themselves in a join."""
    pairs = pairs_within(t.appearances(), ["contest_id", "side", "won"], "entity")
    return pairs.groupBy("low", "high").agg(*record()).filter("games >= 2").withColumn("rate", rate(0.5, 24.0))


@query(with_(CONTEST, ENTITIES, body="""SELECT a.entity AS entity, b.entity AS against, count(*) AS games, sum(a.won)::BIGINT AS wins, round((sum(a.won) + 12.0) / (count(*) + 24.0), 6) AS rate
  FROM appearances a JOIN appearances b ON a.contest_id = b.contest_id AND a.side <> b.side GROUP BY ALL HAVING count(*) >= 2"""))
def pair_counter(t: Tables) -> DataFrame:
    """Directed pairs across sides, both directions."""
    sides = t.appearances().groupBy("contest_id").agg(*[F.collect_set(F.when(F.col("side") == s, F.struct("entity", "won"))).alias(f"s{s}") for s in (0, 1)])
    cross = lambda x, y: F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: F.struct(a["entity"].alias("entity"), b["entity"].alias("against"), a["won"].alias("won")))))
    rows = sides.select(F.explode(F.concat(cross("s0", F.col("s1")), cross("s1", F.col("s0")))).alias("p")).select("p.*")
    return rows.groupBy("entity", "against").agg(*record()).filter("games >= 2").withColumn("rate", rate(0.5, 24.0))


@query(with_(CONTEST, ENTITIES, body="""SELECT lineup, count(*) AS games, sum(won)::BIGINT AS wins, round((sum(won) + 8.0) / (count(*) + 16.0), 6) AS rate FROM (
  SELECT contest_id, side, max(won) AS won, string_agg(entity::VARCHAR, '-' ORDER BY entity) AS lineup FROM appearances GROUP BY contest_id, side HAVING count(*) >= 2) GROUP BY ALL"""))
def lineup_rates(t: Tables) -> DataFrame:
    key = F.array_join(F.transform(F.array_sort(F.collect_list("entity")), lambda x: x.cast("string")), "-")
    sides = t.appearances().groupBy("contest_id", "side").agg(F.max("won").alias("won"), key.alias("lineup"), F.count("*").alias("k")).filter("k >= 2")
    return sides.groupBy("lineup").agg(*record()).withColumn("rate", rate(0.5, 16.0))


@query("""WITH d AS (SELECT p_size AS entity, l_orderkey AS contest, l_linenumber AS role, l_returnflag = 'N' AS pick FROM lineitem JOIN part ON p_partkey = l_partkey),
 n AS (SELECT count(DISTINCT contest) AS contests FROM d), r AS (SELECT entity, max(k) * 1.0 / sum(k) AS top FROM (SELECT entity, role, count(*) AS k FROM d GROUP BY ALL) GROUP BY ALL)
 SELECT entity, picks, bans, contested, round((picks + 1.0) / (contests + 2), 6) AS pick_rate, round((bans + 1.0) / (contests + 2), 6) AS ban_rate, round((early + 1.0) / (contested + 2), 6) AS first_phase, round(1 - top, 6) AS flex
 FROM (SELECT entity, count(*) FILTER (WHERE pick) AS picks, count(*) FILTER (WHERE NOT pick) AS bans, count(*) AS contested, count(*) FILTER (WHERE role <= 2) AS early FROM d GROUP BY ALL) JOIN r USING (entity), n""")
def priority_flex(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("entity"))
    d = t.lineitem.select("l_partkey", F.col("l_orderkey").alias("contest"), F.col("l_linenumber").alias("role"), (F.col("l_returnflag") == "N").alias("pick")).join(parts, "l_partkey")
    contests = d.agg(F.count_distinct("contest").alias("contests"))
    per_role = d.groupBy("entity", "role").agg(F.count("*").alias("k"), F.count_if("pick").alias("p"))
    got = per_role.groupBy("entity").agg(F.sum("p").alias("picks"), F.sum(F.col("k") - F.col("p")).alias("bans"), F.sum("k").alias("contested"), F.sum(F.when(F.col("role") <= 2, F.col("k")).otherwise(0)).alias("early"), F.max("k").alias("top"))
    share = lambda x, of: F.round((F.col(x) + 1.0) / (F.col(of) + 2), 6)
    rows = got.join(F.broadcast(contests))  # one row
    return rows.select("entity", "picks", "bans", "contested", share("picks", "contests").alias("pick_rate"), share("bans", "contests").alias("ban_rate"), share("early", "contested").alias("first_phase"), F.round(1 - F.col("top") / F.col("contested"), 6).alias("flex"))


@query(with_(CONTEST, TEAMS, body="""SELECT team, count(*) AS games, sum(won)::BIGINT AS wins, count(*) FILTER (WHERE family >= 1999) AS recent_games, coalesce(sum(won) FILTER (WHERE family >= 1999), 0)::BIGINT AS recent_wins,
  count(*) FILTER (WHERE group_id = '1-URGENT') AS urgent_games, coalesce(sum(won) FILTER (WHERE group_id = '1-URGENT'), 0)::BIGINT AS urgent_wins, count(*) FILTER (WHERE side = 0) AS home_games, coalesce(sum(won) FILTER (WHERE side = 0), 0)::BIGINT AS home_wins FROM team_rows GROUP BY ALL"""))
def context_records(t: Tables) -> DataFrame:
    """The same record over several subsets, in one pass."""
    parts = {"": F.lit(True), "recent_": F.col("family") >= 1999, "urgent_": F.col("group_id") == "1-URGENT", "home_": F.col("side") == 0}
    return t.team_rows().groupBy("team").agg(*[x for k, c in parts.items() for x in (F.count_if(c).alias(f"{k}games"), F.sum(F.when(c, F.col("won")).otherwise(0)).alias(f"{k}wins"))])


@query("""WITH m AS (SELECT c_nationkey AS team, round(avg(o_totalprice), 4) AS size, round(avg((o_orderpriority = '1-URGENT')::INT), 6) AS urgency, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
 SELECT team, size, urgency, n, round(percent_rank() OVER (ORDER BY size), 6) AS size_rank, round(percent_rank() OVER (ORDER BY urgency), 6) AS urgency_rank FROM m""")
def style_percentiles(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team")), "o_custkey")
    m = rows.groupBy("team").agg(F.round(F.avg("o_totalprice"), 4).alias("size"), F.round(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")), 6).alias("urgency"), F.count("*").alias("n"))
    rank = lambda c: F.round(F.percent_rank().over(Window.partitionBy(F.lit(0)).orderBy(c)), 6)
    alone = F.count("*").over(Window.partitionBy(F.lit(0))) <= 1
    return m.select("*", F.when(alone, 0.5).otherwise(rank("size")).alias("size_rank"), F.when(alone, 0.5).otherwise(rank("urgency")).alias("urgency_rank"))


@query("""WITH l AS (SELECT l_suppkey AS account, p_size AS entity, l_linenumber AS role, l_quantity AS q, l_tax AS x FROM lineitem JOIN part ON p_partkey = l_partkey),
 e AS (SELECT account, entity, count(*) AS k FROM l GROUP BY ALL), r AS (SELECT account, role, count(*) AS k FROM l GROUP BY ALL)
 SELECT account, count(*) AS games, round(avg(q), 6) AS mean_q, round(sum(q) / greatest(1, sum(x)), 4) AS ratio, count(DISTINCT entity) AS pool,
  (SELECT role FROM r WHERE r.account = l.account ORDER BY k DESC, role LIMIT 1) AS main_role,
  (SELECT string_agg(entity::VARCHAR, ',' ORDER BY k DESC, entity) FROM (SELECT * FROM e WHERE e.account = l.account ORDER BY k DESC, entity LIMIT 3)) AS top3 FROM l GROUP BY account""")
def account_profile(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("entity"))
    rows = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("account"), F.col("l_linenumber").alias("role"), "l_quantity", "l_tax").join(parts, "l_partkey")
    main = rows.groupBy("account", "role").agg(F.count("*").alias("k")).groupBy("account").agg(F.max_by("role", F.struct("k", -F.col("role"))).alias("main_role"))
    per = rows.groupBy("account", "entity").agg(F.count("*").alias("k"))
    best = F.slice(F.sort_array(F.collect_list(F.struct(-F.col("k"), F.col("entity").alias("e")))), 1, 3)
    top = per.groupBy("account").agg(F.count("*").alias("pool"), F.array_join(F.transform(best, lambda x: x["e"].cast("string")), ",").alias("top3"))
    got = rows.groupBy("account").agg(F.count("*").alias("games"), F.round(F.avg("l_quantity"), 6).alias("mean_q"), F.round(F.sum("l_quantity") / F.greatest(F.lit(1.0), F.sum("l_tax")), 4).alias("ratio"))
    return got.join(top, "account").join(main, "account")


@query(with_(CONTEST, TEAMS, body="""SELECT team, n, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM (
  SELECT team, count(*) AS n, floor(100 * (0.45 * least(1, count(*) / 50.0) + 0.35 * avg((side = 0)::INT) + 0.2 * avg((family >= 1998)::INT)) + 0.5)::BIGINT AS score FROM team_rows GROUP BY ALL)"""))
def quality_grade(t: Tables) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    score = round_js(100 * (0.45 * F.least(F.lit(1.0), F.count("*") / 50) + 0.35 * share(F.col("side") == 0) + 0.2 * share(F.col("family") >= 1998))).cast("long")
    s = F.col("score")
    return t.team_rows().groupBy("team").agg(F.count("*").alias("n"), score.alias("score")).withColumn("grade", F.when(s >= 85, "A").when(s >= 70, "B").when(s >= 50, "C").otherwise("D"))


@query(with_(CONTEST, TEAMS, body="""SELECT family, team, n, score FROM (SELECT family, team, count(*) AS n, round(abs(avg(won) - 0.5) * sqrt(least(count(*), 40) / 40.0) * (0.55 + 0.45 * avg((side = 0)::INT)), 6) AS score FROM team_rows GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY family ORDER BY score DESC, team) <= 3"""))
def storyline_topk(t: Tables) -> DataFrame:
    score = F.abs(F.avg("won") - 0.5) * F.sqrt(F.least(F.count("*"), F.lit(40)) / 40) * (0.55 + 0.45 * F.avg((F.col("side") == 0).cast("int")))
    got = t.team_rows().groupBy("family", "team").agg(F.count("*").alias("n"), F.round(score, 6).alias("score"))
    return got.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("score"), "team"))).filter("r <= 3").drop("r")


@query(with_(CONTEST, TEAMS, body="SELECT family, team, sum(won)::BIGINT AS wins, (count(*) - sum(won))::BIGINT AS losses, rank() OVER (PARTITION BY family ORDER BY sum(won) DESC, count(*) - sum(won), team)::INTEGER AS place FROM team_rows GROUP BY family, team"))
def standings(t: Tables) -> DataFrame:
    got = t.team_rows().groupBy("family", "team").agg(F.sum("won").alias("wins"), F.sum(1 - F.col("won")).alias("losses"))
    return got.withColumn("place", F.rank().over(Window.partitionBy("family").orderBy(F.desc("wins"), "losses", "team")))


@query(with_(CONTEST, TEAMS, body="""SELECT o.family, o.team, sum(w.wins)::BIGINT AS buchholz FROM (SELECT DISTINCT family, team, opponent FROM team_rows) o
  JOIN (SELECT family, team, sum(won) AS wins FROM team_rows GROUP BY ALL) w ON w.family = o.family AND w.team = o.opponent GROUP BY ALL"""))
def buchholz(t: Tables) -> DataFrame:
    """Sum of the wins of a team's distinct opponents."""
    rows = t.team_rows()
    wins = rows.groupBy("family", F.col("team").alias("opponent")).agg(F.sum("won").alias("wins"))
    return rows.select("family", "team", "opponent").distinct().join(wins, ["family", "opponent"]).groupBy("family", "team").agg(F.sum("wins").alias("buchholz"))


@query(with_(CONTEST, TEAMS, body="""SELECT low, high, games, wins, round((ind * 6 + wins) / (6.0 + games), 6) AS p FROM (
  SELECT least(side0_team, side1_team) AS low, greatest(side0_team, side1_team) AS high, count(*) AS games,
    sum(CASE WHEN side0_team < side1_team THEN side0_win ELSE 1 - side0_win END)::BIGINT AS wins FROM finished GROUP BY ALL) JOIN (
  SELECT a.team AS low, b.team AS high, 1 / (1 + exp(-(ln(a.r / (1 - a.r)) - ln(b.r / (1 - b.r))))) AS ind FROM
    (SELECT team, (sum(won) + 4.0) / (count(*) + 8.0) AS r FROM team_rows GROUP BY ALL) a, (SELECT team, (sum(won) + 4.0) / (count(*) + 8.0) AS r FROM team_rows GROUP BY ALL) b WHERE a.team < b.team) USING (low, high)"""))
def h2h_shrunk(t: Tables) -> DataFrame:
    """Direct record of both orientations, drawn towards the indirect probability."""
    strength = t.team_rows().groupBy("team").agg(logit(shrunk(F.sum("won"), F.count("*"), 0.5, 8.0)).alias("s"))
    won = F.when(F.col("side0_team") < F.col("side1_team"), F.col("side0_win")).otherwise(1 - F.col("side0_win"))
    direct = t.finished().groupBy(F.least("side0_team", "side1_team").alias("low"), F.greatest("side0_team", "side1_team").alias("high")).agg(F.count("*").alias("games"), F.sum(won).alias("wins"))
    rows = direct.join(strength.select(F.col("team").alias("low"), F.col("s").alias("a")), "low").join(strength.select(F.col("team").alias("high"), F.col("s").alias("b")), "high")
    return rows.select("low", "high", "games", "wins", F.round((sigmoid(F.col("a") - F.col("b")) * 6 + F.col("wins")) / (F.lit(6.0) + F.col("games")), 6).alias("p"))


@query("""SELECT s1.s_nationkey AS low, s2.s_nationkey AS high, round(avg(s1.a - s2.a), 4) AS gap FROM (SELECT s_nationkey, sum(s_acctbal) AS a FROM supplier GROUP BY ALL) s1
  JOIN (SELECT s_nationkey, sum(s_acctbal) AS a FROM supplier GROUP BY ALL) s2 ON s1.s_nationkey < s2.s_nationkey GROUP BY ALL""")
def all_pairs(t: Tables) -> DataFrame:
    """All unordered pairs of a small set of entities (nations), made inside one array of them."""
    one = t.supplier.groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("a")).agg(F.array_sort(F.collect_list(F.struct("s_nationkey", "a"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b["s_nationkey"] > a["s_nationkey"]), lambda b: F.struct(a["s_nationkey"].alias("low"), b["s_nationkey"].alias("high"), F.round(a["a"] - b["a"], 4).alias("gap")))))
    return one.select(F.explode(pairs).alias("p")).select("p.*")


@query(with_(CONTEST, ENTITIES, body="""SELECT version, entity, games, round((wins + prior * 18) / (games + 18.0), 6) AS rate FROM (
  SELECT version, entity, count(*) AS games, sum(won) AS wins FROM appearances GROUP BY ALL) JOIN (
  SELECT entity, greatest(0.4, least(0.6, (sum(won) + 15.0) / (count(*) + 30.0))) AS prior FROM appearances GROUP BY ALL) USING (entity)"""))
def two_level_prior(t: Tables) -> DataFrame:
    """A version's rate drawn towards the entity's own, which is drawn towards one half and clamped."""
    rows = t.appearances()
    by_version = rows.groupBy("version", "entity").agg(*record())
    prior = by_version.groupBy("entity").agg(shrunk(F.sum("wins"), F.sum("games"), 0.5, 30.0).alias("prior"))
    clamped = F.greatest(F.lit(0.4), F.least(F.lit(0.6), F.col("prior")))
    return by_version.join(prior, "entity").select("version", "entity", "games", F.round(shrunk(F.col("wins"), F.col("games"), clamped, 18.0), 6).alias("rate"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= '2000-01-01' GROUP BY ALL")
def information_sums(t: Tables) -> DataFrame:
    """Weighted sums with the filter pushed into the scan and all aggregation partial before the shuffle."""
    rows = t.lineitem.filter(F.col("l_shipdate") <= F.lit("2000-01-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


# Prior games of an entity's professional rate, of its rate in a version, and of a pair's.
PRO_GAMES, VERSION_GAMES, DIRECTED_GAMES = 30.0, 18.0, 24.0
LEVELS = f"""domains AS (SELECT a.*, f.group_id < '3' AS pro FROM appearances a JOIN finished f ON f.contest_id = a.contest_id),
whole AS (SELECT coalesce(avg(won) FILTER (WHERE NOT pro), 0.5) AS base FROM domains),
entity_rates_ AS (SELECT entity, (count(*) FILTER (WHERE pro AND won = 1) + coalesce(avg(won) FILTER (WHERE NOT pro), (SELECT base FROM whole)) * {PRO_GAMES}) / (count(*) FILTER (WHERE pro) + {PRO_GAMES}) AS rate FROM domains GROUP BY entity)"""


def _entity_levels(t: Tables) -> DataFrame:
    """entity, rate: professional results drawn to the entity's ranked rate, that to all entities' where it has none."""
    rows = t.appearances().join(t.finished().select("contest_id", (F.col("group_id") < "3").alias("pro")), "contest_id")
    base = rows.filter("not pro").agg(F.coalesce(F.avg("won"), F.lit(0.5)).alias("base"))  # one row
    got = rows.groupBy("entity").agg(F.count_if(F.col("pro")).alias("n"), F.count_if(F.col("pro") & (F.col("won") == 1)).alias("w"), F.avg(F.when(~F.col("pro"), F.col("won"))).alias("ranked"))
    return got.join(F.broadcast(base)).select("entity", ((F.col("w") + F.coalesce("ranked", "base") * PRO_GAMES) / (F.col("n") + PRO_GAMES)).alias("rate"))


@query(with_(CONTEST, ENTITIES, LEVELS, body=f"SELECT version, entity, count(*) AS games, round((sum(won) + any_value(rate) * {VERSION_GAMES}) / (count(*) + {VERSION_GAMES}), 6) AS rate FROM appearances JOIN entity_rates_ USING (entity) GROUP BY version, entity"))
def three_level_rates(t: Tables) -> DataFrame:
    """An entity's rate in a version, drawn to its professional rate, which is drawn to its ranked one."""
    rows = t.appearances().groupBy("version", "entity").agg(*record()).join(_entity_levels(t), "entity")
    return rows.select("version", "entity", "games", F.round(shrunk(F.col("wins"), F.col("games"), F.col("rate"), VERSION_GAMES), 6).alias("rate"))


@query(with_(CONTEST, ENTITIES, LEVELS, body=f"""SELECT x AS entity, y AS against, games, round((wins + greatest(0.4, least(0.6, 0.5 + (a.rate - b.rate) / 2)) * {DIRECTED_GAMES}) / (games + {DIRECTED_GAMES}), 6) AS rate FROM (
  SELECT a.entity AS x, b.entity AS y, count(*) AS games, sum(a.won) AS wins FROM appearances a JOIN appearances b ON a.contest_id = b.contest_id AND a.side <> b.side AND a.entity <> b.entity GROUP BY ALL HAVING count(*) >= 2)
  JOIN entity_rates_ a ON a.entity = x JOIN entity_rates_ b ON b.entity = y"""))
def directional_counters(t: Tables) -> DataFrame:
    """How an entity does against each other one, drawn to a half moved by half of the difference of their rates, within 0.4 and 0.6."""
    own = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("entity")))
    sides = t.appearances().groupBy("contest_id").agg(own(0).alias("x0"), own(1).alias("x1"), F.max(F.when(F.col("side") == 0, F.col("won"))).alias("w"))
    met = F.flatten(F.transform("x0", lambda a: F.transform(F.filter("x1", lambda b: b != a), lambda b: F.struct(a.alias("x"), b.alias("y")))))
    pairs = sides.select("w", F.explode(met).alias("p")).select("p.x", "p.y", "w")
    both = pairs.unionAll(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), (1 - F.col("w")).alias("w")))
    got = both.groupBy("x", "y").agg(F.count("*").alias("games"), F.sum("w").alias("wins")).filter("games >= 2")
    level = _entity_levels(t)
    rows = got.join(level.select(F.col("entity").alias("x"), F.col("rate").alias("a")), "x").join(level.select(F.col("entity").alias("y"), F.col("rate").alias("b")), "y")
    prior = F.least(F.lit(0.6), F.greatest(F.lit(0.4), 0.5 + (F.col("a") - F.col("b")) / 2))
    return rows.select(F.col("x").alias("entity"), F.col("y").alias("against"), "games", F.round(shrunk(F.col("wins"), F.col("games"), prior, DIRECTED_GAMES), 6).alias("rate"))
