"""Raw rows made comparable: roles, tags, versions, identities, predicates and checks of input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.plans.contest import CONTEST, ENTITIES, LIVE, Tables, with_
from skirmish.plans.registry import query


def role_of(position: Column, lane: Column, roaming: Column) -> Column:
    """The estimated position if it rounds to 1..5, else the lane's role (a roaming third lane is 4), else 0."""
    estimated = F.floor(F.coalesce(position, F.lit(0.0)) + 0.5)
    return F.when(estimated.between(1, 5), estimated).when(lane.isin(1, 2), lane).when(lane == 3, F.when(roaming, 4).otherwise(3)).otherwise(0).cast("int")


def live_role(role: Column, slot: Column) -> Column:
    """An explicit role 1..5, else the slot's: 0..4 counts from 0, 5 is 5."""
    return F.when(role.between(1, 5), role).when(slot.between(0, 4), slot + 1).when(slot == 5, F.lit(5)).cast("int")


def known_team(team: Column, contest: Column, side: Column) -> Column:
    """A team's name, or one of its own for an unknown team, so that unknown teams are never the same team."""
    return F.when(team > 0, F.concat(F.lit("team:"), team.cast("string"))).otherwise(F.concat_ws(":", F.lit("unknown"), contest.cast("string"), side.cast("string")))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, CASE WHEN floor(l_quantity / 10 + 0.5) BETWEEN 1 AND 4 THEN floor(l_quantity / 10 + 0.5)::INT
  WHEN l_linenumber IN (1, 2) THEN l_linenumber WHEN l_linenumber = 3 THEN CASE WHEN l_tax > 0.04 THEN 4 ELSE 3 END ELSE 0 END AS role FROM lineitem""")
def role_normalisation(t: Tables) -> DataFrame:
    """Quantity as position (5 counts as not estimated), line number as lane, tax as roaming."""
    position = F.when(F.col("l_quantity") < 45, F.col("l_quantity") / 10)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", role_of(position, F.col("l_linenumber"), F.col("l_tax") > 0.04).alias("role"))


@query(with_(LIVE, body="""SELECT event_id, CASE WHEN phase = 'click' AND k % 9 BETWEEN 1 AND 5 THEN k % 9 WHEN k % 7 BETWEEN 0 AND 4 THEN k % 7 + 1 WHEN k % 7 = 5 THEN 5 END AS role FROM live"""))
def live_roles(t: Tables) -> DataFrame:
    rows = t.live()
    explicit = F.when(F.col("phase") == "click", F.col("k") % 9)
    return rows.select("event_id", live_role(explicit, F.col("k") % 7).alias("role"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'pro' ELSE 'high_mmr' END AS domain, CASE WHEN regexp_matches(given, '^[0-9]+\\.[0-9]+[a-zA-Z]?$') THEN given END AS version, NOT (given GLOB '[0-9].[0-9]*') AS malformed FROM (
  SELECT *, p_size::VARCHAR || CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE '.' END || (p_partkey % 40)::VARCHAR || CASE p_partkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'rc' ELSE '' END AS given FROM part)""")
def domain_and_version(t: Tables) -> DataFrame:
    """The domain of a league id, a version that matches the provider's pattern, and those a cleaning pass would void."""
    given = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 5 == 0, "-").otherwise("."), (F.col("p_partkey") % 40).cast("string"), F.when(F.col("p_partkey") % 4 == 0, "b").when(F.col("p_partkey") % 4 == 1, "rc").otherwise(""))
    rows = t.part.withColumn("given", given)
    league = F.col("p_size") % 3
    return rows.select("p_partkey", F.when(league > 0, "pro").otherwise("high_mmr").alias("domain"), F.when(F.col("given").rlike(r"^[0-9]+\.[0-9]+[a-zA-Z]?$"), F.col("given")).alias("version"), (~F.col("given").rlike(r"^[0-9]\.[0-9]")).alias("malformed"))


SIDES = """FROM orders JOIN customer ON c_custkey = o_custkey"""


@query(f"""SELECT team, count(*) AS contests FROM (SELECT CASE WHEN c_nationkey > 0 THEN 'team:' || c_nationkey::VARCHAR ELSE 'unknown:' || o_orderkey::VARCHAR || ':0' END AS team {SIDES}) GROUP BY ALL""")
def unknown_identities(t: Tables) -> DataFrame:
    """Contests of each team; those without an id each count for themselves, which also keeps the id 0 from being a hot key."""
    home = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = t.orders.select("o_orderkey", "o_custkey").join(home, "o_custkey")
    return rows.groupBy(known_team(F.col("c_nationkey"), F.col("o_orderkey"), F.lit(0)).alias("team")).agg(F.count("*").alias("contests"))


@query("SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS total FROM part WHERE p_type LIKE 'ECONOMY%' GROUP BY ALL")
def prefix_predicate(t: Tables) -> DataFrame:
    """LIKE 'x%' as a prefix test, which reaches the scan."""
    return t.part.filter(F.col("p_type").startswith("ECONOMY")).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query(with_(ENTITIES.split(",\nappearances")[0], body="""SELECT contest_id, n0, n1, shared, CASE WHEN n0 > 5 OR n1 > 5 THEN 'too_many' WHEN shared > 0 THEN 'duplicate_across_sides' WHEN n0 = 0 OR n1 = 0 THEN 'one_side' ELSE 'ok' END AS verdict, least(n0, n1) / 5.0::DOUBLE AS completeness FROM (
  SELECT contest_id, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1, count(*) - count(DISTINCT entity) AS shared FROM entities GROUP BY ALL)"""))
def draft_validation(t: Tables) -> DataFrame:
    """Whether the picks of both sides can be a draft: at most five each, no entity on both sides; and how complete it is."""
    sides = t.entities().groupBy("contest_id").agg(F.collect_set(F.when(F.col("side") == 0, F.col("entity"))).alias("a"), F.collect_set(F.when(F.col("side") == 1, F.col("entity"))).alias("b"))
    rows = sides.select("contest_id", F.size("a").cast("long").alias("n0"), F.size("b").cast("long").alias("n1"), F.size(F.array_intersect("a", "b")).cast("long").alias("shared"))
    verdict = F.when((F.col("n0") > 5) | (F.col("n1") > 5), "too_many").when(F.col("shared") > 0, "duplicate_across_sides").when((F.col("n0") == 0) | (F.col("n1") == 0), "one_side").otherwise("ok")
    return rows.withColumn("verdict", verdict).withColumn("completeness", F.least("n0", "n1") / 5.0)


@query(with_(CONTEST, body="""SELECT team, count(*) AS contests, sum(won)::BIGINT AS wins FROM (SELECT side0_team AS team, side0_win AS won, group_id FROM finished UNION ALL SELECT side1_team, 1 - side0_win, group_id FROM finished) WHERE group_id <> '1-URGENT' GROUP BY ALL"""))
def baseline_without_live_group(t: Tables) -> DataFrame:
    """Baseline counts that leave out the group which the live layer counts itself."""
    return t.team_rows().filter("group_id <> '1-URGENT'").groupBy("team").agg(F.count("*").alias("contests"), F.sum("won").alias("wins"))


@query(with_(CONTEST, body="""SELECT contest_id, least(side0_team, side1_team) AS low, greatest(side0_team, side1_team) AS high, CASE WHEN side0_team < side1_team THEN a ELSE b END AS low_score, CASE WHEN side0_team < side1_team THEN b ELSE a END AS high_score FROM (
  SELECT *, CASE side0_win WHEN 1 THEN 2 ELSE ts % 2 END::INT AS a, CASE side0_win WHEN 1 THEN (ts // 86400) % 2 ELSE 2 END::INT AS b FROM finished)"""))
def score_orientation(t: Tables) -> DataFrame:
    """Scores turned to the order of the pair."""
    won = F.col("side0_win") == 1
    rows = t.finished().withColumn("a", F.when(won, 2).otherwise(F.col("ts") % 2).cast("int")).withColumn("b", F.when(won, F.floor(F.col("ts") / 86400) % 2).otherwise(2).cast("int"))
    first = F.col("side0_team") < F.col("side1_team")
    return rows.select("contest_id", F.least("side0_team", "side1_team").alias("low"), F.greatest("side0_team", "side1_team").alias("high"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("low_score"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("high_score"))


@query("""SELECT l_orderkey, count(*) AS players, string_agg(l_partkey::VARCHAR || ':' || l_quantity::BIGINT::VARCHAR, ',' ORDER BY l_partkey, l_quantity) AS slim FROM lineitem GROUP BY ALL HAVING count(*) >= 4""")
def slim_documents(t: Tables) -> DataFrame:
    """Documents with two fields a child; those with too few children are dropped. Only these columns are read."""
    child = F.struct("l_partkey", F.col("l_quantity").cast("long").alias("q"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(child)).alias("players")).filter(F.size("players") >= 4)
    text = F.array_join(F.transform("players", lambda p: F.concat_ws(":", p["l_partkey"].cast("string"), p["q"].cast("string"))), ",")
    return rows.select("l_orderkey", F.size("players").cast("long").alias("players"), text.alias("slim"))


@query(with_(LIVE, body="""SELECT match_id, phase, arg_min(event_id, (t, event_id)) AS first_event, arg_min(k % 2, (t, event_id))::INT AS side FROM live GROUP BY ALL"""))
def first_event_of_each_kind(t: Tables) -> DataFrame:
    """The first event of each kind in a match, and the side that had it."""
    first = F.min(F.struct("t", "event_id", (F.col("k") % 2).alias("side"))).alias("f")
    return t.live().groupBy("match_id", "phase").agg(first).select("match_id", "phase", F.col("f.event_id").alias("first_event"), F.col("f.side").alias("side"))


@query(with_(LIVE, body="""SELECT match_id, n, leads[11] AS exact, leads[least(n, 11)] AS clamped FROM (SELECT match_id, count(*) AS n, list(lead ORDER BY t, event_id) AS leads FROM live GROUP BY ALL)"""))
def minute_values(t: Tables) -> DataFrame:
    """The value at minute 10 of a match's series under both rules: null beyond its end, or its last."""
    rows = t.live().groupBy("match_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", "lead"))), lambda x: x["lead"]).alias("leads"))
    return rows.select("match_id", "n", F.get("leads", F.lit(10)).alias("exact"), F.get("leads", (F.least("n", F.lit(11)) - 1).cast("int")).alias("clamped"))
