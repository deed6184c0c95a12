"""Checks of rows before they are used, coverage of targets, style of teams, and what is shown of effects and opinions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import exprs as X
from skirmish.operators.joins import first_reason
from skirmish.plans.contest import CONTEST, ENTITIES, FORECAST, LIVE, TEAMS, Tables, with_
from skirmish.plans.evaluations import opinion_completion
from skirmish.plans.explain import signal_shares
from skirmish.plans.registry import ORACLES, query

#: Least participants of a usable contest; answers of one respondent, and what an answer's key looks like.
PARTICIPANTS, ANSWERS, KEY = 3, 120, "^[a-z][a-z_]*$"


@query(f"""SELECT o_orderkey AS contest_id, coalesce(n, 0) AS participants, coalesce(d, 0) AS entities, CASE WHEN n IS NULL OR n < {PARTICIPANTS} THEN 'too_few' WHEN zero > 0 THEN 'unknown_entity' WHEN d < n THEN 'repeated_entity' WHEN sides < 2 THEN 'one_side' ELSE 'usable' END AS reason
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT p_size) FILTER (WHERE p_size > 0) AS d, count(*) FILTER (WHERE coalesce(p_size, 0) <= 0) AS zero, count(DISTINCT l_linestatus) AS sides FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL) ON l_orderkey = o_orderkey""")
def usable_contests(t: Tables) -> DataFrame:
    """Contests with enough participants on both sides, each a different known entity; the others with the first thing that is wrong."""
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("e"))
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linestatus").join(parts, "l_partkey", "left")
    known = F.col("e") > 0
    got = rows.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_distinct(F.when(known, F.col("e"))).alias("d"), F.count_if(~F.coalesce(known, F.lit(False))).alias("zero"), F.count_distinct("l_linestatus").alias("sides"))
    all_ = t.orders.select("o_orderkey").join(got, "o_orderkey", "left")
    reason = first_reason([("too_few", F.coalesce("n", F.lit(0)) < PARTICIPANTS), ("unknown_entity", F.col("zero") > 0), ("repeated_entity", F.col("d") < F.col("n")), ("one_side", F.col("sides") < 2)], "usable")
    return all_.select(F.col("o_orderkey").alias("contest_id"), F.coalesce("n", F.lit(0)).alias("participants"), F.coalesce("d", F.lit(0)).alias("entities"), reason.alias("reason"))


@query(with_(LIVE, body=f"""SELECT match_id, count(*) AS answers, count(*) FILTER (WHERE NOT regexp_matches(coalesce(phase, ''), '{KEY}')) AS bad_keys, count(*) FILTER (WHERE lead IS NULL OR lead < 0 OR lead > 100) AS bad_values,
  count(*) <= {ANSWERS} AND count(*) FILTER (WHERE NOT regexp_matches(coalesce(phase, ''), '{KEY}')) = 0 AND count(*) FILTER (WHERE lead IS NULL OR lead < 0 OR lead > 100) = 0 AS valid FROM live GROUP BY match_id"""))
def answer_validation(t: Tables) -> DataFrame:
    """Each respondent's answers: how many, how many with a key or a value (0 to 100) that can't be, and whether all may be taken."""
    bad_key, bad_value = ~F.coalesce(F.col("phase"), F.lit("")).rlike(KEY), ~F.coalesce(F.col("lead").between(0, 100), F.lit(False))
    got = t.live().groupBy("match_id").agg(F.count("*").alias("answers"), F.count_if(bad_key).alias("bad_keys"), F.count_if(bad_value).alias("bad_values"))
    return got.withColumn("valid", (F.col("answers") <= ANSWERS) & (F.col("bad_keys") == 0) & (F.col("bad_values") == 0))


_TARGETS = {"result": "side0_win", "forecast": "p", "events": "events", "shipped": "last_ship", "participants": "k"}


@query(with_(CONTEST, ENTITIES, TEAMS, FORECAST, body="SELECT version, count(*) AS n, " + ", ".join(f"count({c}) AS {n}" for n, c in _TARGETS.items()) + """, count(side0_win + p + events + k) FILTER (WHERE last_ship IS NOT NULL) AS complete FROM (
  SELECT c.*, f.p, l.events, l.last_ship, e.k FROM contest c LEFT JOIN (SELECT contest_id, p FROM forecast) f ON f.contest_id = c.contest_id LEFT JOIN (SELECT l_orderkey, nullif(count(*) FILTER (WHERE l_returnflag = 'N'), 0) AS events, max(l_shipdate) AS last_ship FROM lineitem GROUP BY ALL) l ON l.l_orderkey = c.contest_id
  LEFT JOIN (SELECT contest_id, CASE WHEN count(DISTINCT side) = 2 THEN count(*) END AS k FROM entities GROUP BY ALL) e ON e.contest_id = c.contest_id) GROUP BY version"""))
def target_coverage(t: Tables) -> DataFrame:
    """How many contests of each version have each target, and how many have all."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("contest_id")).agg(F.nullif(F.count_if(F.col("l_returnflag") == "N"), F.lit(0).cast("long")).alias("events"), F.max("l_shipdate").alias("last_ship"))
    sides = t.entities().groupBy("contest_id").agg(F.when(F.count_distinct("side") == 2, F.count("*")).alias("k"))
    rows = t.contest().join(t.forecast().select("contest_id", "p"), "contest_id", "left").join(lines, "contest_id", "left").join(sides, "contest_id", "left")
    whole = F.lit(True)
    for c in _TARGETS.values():
        whole = whole & F.col(c).isNotNull()
    return rows.groupBy("version").agg(F.count("*").alias("n"), *[F.count(c).alias(n) for n, c in _TARGETS.items()], F.count_if(whole).alias("complete"))


_STYLE = {"length": "count(*)", "pace": "sum(l_quantity)", "value": "sum(l_extendedprice)", "margin": "avg(l_discount)", "tax": "avg(l_tax)", "variety": "count(DISTINCT l_partkey)", "returns": "avg((l_returnflag = 'R')::INT)", "open": "avg((l_linestatus = 'O')::INT)", "largest": "max(l_extendedprice)", "spread": "max(l_quantity) - min(l_quantity)"}


@query(with_(CONTEST, TEAMS, body="SELECT team, count(*) AS n, " + ", ".join(f"round(avg({k}), 5) AS {k}" for k in _STYLE) + " FROM team_rows LEFT JOIN (SELECT l_orderkey, " + ", ".join(f"{v} AS {k}" for k, v in _STYLE.items()) + " FROM lineitem GROUP BY l_orderkey) ON l_orderkey = contest_id GROUP BY team"))
def style_metrics(t: Tables) -> DataFrame:
    """The mean of ten measures of its contests for each team; contests without one are left out of its mean."""
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    share = lambda c, v: F.avg((F.col(c) == v).cast("int"))
    made = {"length": F.count("*"), "pace": F.sum(q), "value": F.sum(price), "margin": F.avg("l_discount"), "tax": F.avg("l_tax"), "variety": F.count_distinct("l_partkey"), "returns": share("l_returnflag", "R"), "open": share("l_linestatus", "O"), "largest": F.max(price), "spread": F.max(q) - F.min(q)}
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("contest_id")).agg(*[v.alias(k) for k, v in made.items()])
    rows = t.team_rows().select("contest_id", "team").join(lines, "contest_id", "left")
    return rows.groupBy("team").agg(F.count("*").alias("n"), *[F.round(F.avg(k), 5).alias(k) for k in _STYLE])


#: Effects of a contest that are shown.
TOP = 3


@query(f"SELECT contest_id, signal, learned, row_number() OVER w AS place FROM ({ORACLES['signal_shares']}) WINDOW w AS (PARTITION BY contest_id ORDER BY abs(learned) DESC, k) QUALIFY row_number() OVER w <= {TOP}")
def top_effects(t: Tables) -> DataFrame:
    """The three signals that move each contest's probability most, either way."""
    place = F.row_number().over(Window.partitionBy("contest_id").orderBy(F.abs("learned").desc(), "k"))
    return signal_shares(t).withColumn("place", place).filter(F.col("place") <= TOP).select("contest_id", "signal", "learned", "place")


#: Share of a respondent's opinion in a blended forecast.
OPINION = 0.35


@query(with_(CONTEST, TEAMS, f"opinions AS ({ORACLES['opinion_completion']})", body=f"""SELECT o.low, o.high, round({OPINION} * o.p + {1 - OPINION} / (1 + exp(-(ln(a.r / (1 - a.r)) - ln(b.r / (1 - b.r))))), 4) AS p, o.answered FROM opinions o
  JOIN (SELECT team, (sum(won) + 4.0) / (count(*) + 8.0) AS r FROM team_rows GROUP BY ALL) a ON a.team = 't' || lpad(o.low::VARCHAR, 2, '0') JOIN (SELECT team, (sum(won) + 4.0) / (count(*) + 8.0) AS r FROM team_rows GROUP BY ALL) b ON b.team = 't' || lpad(o.high::VARCHAR, 2, '0')"""))
def opinion_blend(t: Tables) -> DataFrame:
    """Opinions on every pair, answered or completed, blended by weight with the teams' strengths."""
    s = t.team_rows().groupBy("team").agg(X.logit(X.shrunk(F.sum("won"), F.count("*"), 0.5, 8.0), 0.0).alias("s"))
    of = lambda c, name: s.select(F.substring("team", 2, 9).cast("int").alias(c), F.col("s").alias(name))
    rows = opinion_completion(t).join(of("low", "a"), "low").join(of("high", "b"), "high")
    return rows.select("low", "high", F.round(OPINION * F.col("p") + (1 - OPINION) * X.sigmoid(F.col("a") - F.col("b")), 4).alias("p"), "answered")
