"""Scores, calibration, resampling, gates and the scalar functions of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import exprs as X
from skirmish.operators.evaluation import bins_of_equal_count, cluster_bootstrap, pearson, scores, weighted_moments
from skirmish.plans.contest import CONTEST, FORECAST, LIVE, TEAMS, Tables, with_
from skirmish.plans.registry import query

LOSS = "-(y * ln(greatest(0.001, least(0.999, p))) + (1 - y) * ln(1 - greatest(0.001, least(0.999, p))))"
SCORES = f"count(*) AS n, round(avg({LOSS}), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(((p >= 0.5) = (y = 1))::INT), 6) AS accuracy, round(avg(p), 6) AS predicted, round(avg(y), 6) AS actual"
ALL = (CONTEST, TEAMS, FORECAST)


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" and c not in keep else F.col(c) for c, k in df.dtypes])


@query(with_(*ALL, body=f"SELECT {SCORES} FROM forecast"))
def proper_scores(t: Tables) -> DataFrame:
    return rounded(t.forecast().agg(*scores()))


@query(with_(*ALL, body=f"SELECT coalesce(version, 'all') AS version, {SCORES} FROM forecast GROUP BY ROLLUP (version)"))
def scores_by_version(t: Tables) -> DataFrame:
    return rounded(t.forecast().rollup("version").agg(*scores()).withColumn("version", F.coalesce("version", F.lit("all"))))


@query(with_(*ALL, body="""SELECT bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS actual, round(abs(avg(p) - avg(y)), 6) AS gap FROM (
  SELECT y, p, ((row_number() OVER (ORDER BY p, contest_id) - 1) // ceil(count(*) OVER () / 10.0)::BIGINT)::BIGINT AS bin FROM forecast) GROUP BY ALL"""))
def ece_equal_count(t: Tables) -> DataFrame:
    b = bins_of_equal_count(t.forecast(), "p", "contest_id").groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("actual"))
    return rounded(b.withColumn("gap", F.abs(F.col("predicted") - F.col("actual"))))


@query(with_(*ALL, body="SELECT least(9, floor(p * 10))::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS actual FROM forecast GROUP BY ALL"))
def ece_width(t: Tables) -> DataFrame:
    b = F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("long")
    return rounded(t.forecast().groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("actual")))


@query(with_(*ALL, body="""SELECT m AS margin, count(*) FILTER (WHERE abs(p - 0.5) * 100 >= m) AS called, round(count(*) FILTER (WHERE abs(p - 0.5) * 100 >= m) / count(*), 6) AS coverage,
  round(avg(((p >= 0.5) = (y = 1))::INT) FILTER (WHERE abs(p - 0.5) * 100 >= m), 6) AS accuracy FROM forecast, (SELECT unnest(range(3, 16)) AS m) GROUP BY ALL"""))
def selective_margin(t: Tables) -> DataFrame:
    """All margins in one pass: each is a conditional aggregate, no copy of the rows."""
    y, p = F.col("y"), F.col("p")
    far = lambda m: F.abs(p - 0.5) * 100 >= m
    per = [F.struct(F.lit(m).cast("long").alias("margin"), F.count_if(far(m)).alias("called"), F.round(F.count_if(far(m)) / F.count("*"), 6).alias("coverage"), F.round(F.avg(F.when(far(m), X.correct(y, p))), 6).alias("accuracy")) for m in range(3, 16)]
    return t.forecast().agg(F.array(*per).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


@query("""SELECT l_returnflag, round(CASE WHEN count(*) >= 3 THEN corr(l_quantity, l_extendedprice) END, 6) AS r, NULL::DOUBLE AS constant FROM lineitem GROUP BY ALL""")
def pearson_guarded(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("one", F.lit(1.0))
    return rows.groupBy("l_returnflag").agg(F.round(pearson("l_quantity", "l_extendedprice"), 6).alias("r"), pearson("one", "l_quantity").alias("constant"))


@query("""SELECT l_returnflag, round(sqrt(sum(w * (x - y) * (x - y)) / sum(w)), 6) AS rmse, round(sum(w * abs(x - y)) / sum(w), 6) AS mae,
  round((sum(w * x * y) * sum(w) - sum(w * x) * sum(w * y)) / sqrt((sum(w * x * x) * sum(w) - sum(w * x) * sum(w * x)) * (sum(w * y * y) * sum(w) - sum(w * y) * sum(w * y))), 5) AS correlation
  FROM (SELECT l_returnflag, l_quantity AS w, l_discount AS x, l_tax AS y FROM lineitem) GROUP BY ALL""")
def weighted_moments_by_flag(t: Tables) -> DataFrame:
    got = t.lineitem.groupBy("l_returnflag").agg(*weighted_moments("l_discount", "l_tax", "l_quantity"))
    return got.select("l_returnflag", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), F.round("correlation", 5).alias("correlation"))


def _tempered(p: str, temperature: str) -> str:
    return f"1 / (1 + exp(-ln(greatest(0.001, least(0.999, {p})) / (1 - greatest(0.001, least(0.999, {p})))) / {temperature}))"


@query(with_(*ALL, body=f"""SELECT k, round(temperature, 6) AS temperature, round(avg({LOSS}), 6) AS log_loss FROM (SELECT k, temperature, y, {_tempered('q', 'temperature')} AS p FROM (
  SELECT y, p AS q, k, 0.55 * pow(4 / 0.55, k / 80.0) AS temperature FROM forecast, (SELECT unnest(range(0, 81)) AS k))) GROUP BY ALL"""))
def temperature_grid(t: Tables) -> DataFrame:
    """Log loss at 81 temperatures: each row meets them in its own task, and 81 partial sums a task are shuffled."""
    temp = F.lit(0.55) * F.pow(F.lit(4 / 0.55), F.col("k") / 80.0)
    rows = t.forecast().select("y", X.logit(F.col("p")).alias("z"), F.explode(F.sequence(F.lit(0), F.lit(80)).cast("array<long>")).alias("k"))
    loss = F.round(F.avg(X.log_loss(F.col("y"), X.sigmoid(F.col("z") / temp))), 6)
    return rows.groupBy("k").agg(loss.alias("log_loss")).select("k", F.round(temp, 6).alias("temperature"), "log_loss")


@query(with_(*ALL, body=f"""SELECT arg_min(k, (loss, k)) AS best, round(min(loss), 6) AS log_loss FROM (SELECT k, avg({LOSS}) AS loss FROM (SELECT k, y, {_tempered('q', '(0.6 + 0.1 * k)')} AS p FROM (
  SELECT y, p AS q, unnest(range(0, 7)) AS k FROM forecast)) GROUP BY ALL)"""))
def sharpness_arena(t: Tables) -> DataFrame:
    y, z = F.col("y"), X.logit(F.col("p"))
    losses = t.forecast().agg(*[F.avg(X.log_loss(y, X.sigmoid(z / (0.6 + 0.1 * k)))).alias(f"k{k}") for k in range(7)])
    best = F.array_min(F.array(*[F.struct(F.col(f"k{k}").alias("loss"), F.lit(k).cast("long").alias("k")) for k in range(7)]))
    return losses.select(best["k"].alias("best"), F.round(best["loss"], 6).alias("log_loss"))


_DRAW = """(SELECT i, r, (xor(v2, v2 >> 14) & 4294967295) / 4294967296.0 AS u FROM (
  SELECT i, r, (xor(((v1 + ((xor(v1, v1 >> 7) * (v1 | 61)) % 4294967296)) & 4294967295), v1)) AS v2 FROM (
  SELECT i, r, ((xor(s, s >> 15)::HUGEINT * (s | 1)::HUGEINT) % 4294967296)::BIGINT AS v1 FROM (
  SELECT id // n AS i, id % n AS r, ((12345 + (((id + 1)::HUGEINT * 1831565813) % 4294967296)) % 4294967296)::BIGINT AS s FROM (SELECT unnest(range(0, 200 * n)) AS id, n FROM (SELECT count(*) AS n FROM c))))))"""
_DRAW = _DRAW.replace("((xor(v1, v1 >> 7) * (v1 | 61)) % 4294967296)", "((xor(v1, v1 >> 7)::HUGEINT * (v1 | 61)::HUGEINT) % 4294967296)::BIGINT")


@query(with_(*ALL, body=f"""SELECT i AS iteration, round(sum(total) / sum(k), 6) AS mean_delta FROM (SELECT d.i, c.total, c.k FROM {_DRAW} d, (SELECT count(*) AS n FROM c) nn
  JOIN c ON c.rank = floor(d.u * nn.n)::BIGINT) GROUP BY ALL""").replace("WITH ", "WITH ", 1).replace("\nSELECT i AS iteration", f""",
c AS (SELECT row_number() OVER (ORDER BY version) - 1 AS rank, total, k FROM (SELECT version, sum({LOSS} - ln(2)) AS total, count(*) AS k FROM forecast GROUP BY ALL))
SELECT i AS iteration""", 1))
def cluster_bootstrap_deltas(t: Tables) -> DataFrame:
    """Mean loss against a coin in 200 resamples of whole versions, drawn by a counter-based generator."""
    rows = t.forecast().select("version", (X.log_loss(F.col("y"), F.col("p")) - F.ln(F.lit(2.0))).alias("delta"))
    return cluster_bootstrap(rows, "version", "delta", 200, 12345).select("iteration", F.round("mean_delta", 6).alias("mean_delta"))


def _gate(t: Tables) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    return t.forecast().groupBy("group_id").agg(F.count("*").alias("n"), F.sum(X.correct(y, p)).alias("right"), F.sum(F.lit(1) - y).alias("right_away"), F.avg(X.log_loss(y, p)).alias("ll"), F.avg(X.brier(y, p)).alias("br"))


@query(with_(*ALL, body=f"""SELECT group_id, n, CASE WHEN n >= 8 AND c >= a AND br < 0.25 AND ll < ln(2) THEN 'adaptive' ELSE 'static' END AS selected,
  CASE WHEN n < 8 THEN 'insufficient_temporal_evidence' WHEN c >= a AND br < 0.25 AND ll < ln(2) THEN 'adaptive_improves_accuracy_and_proper_scores' ELSE 'adaptive_failed_production_gate' END AS reason FROM (
  SELECT group_id, count(*) AS n, sum(((p >= 0.5) = (y = 1))::INT) AS c, sum(1 - y) AS a, avg({LOSS}) AS ll, avg((p - y) * (p - y)) AS br FROM forecast GROUP BY ALL)"""))
def gate_decision(t: Tables) -> DataFrame:
    """The forecast replaces a coin only where it wins on accuracy and both proper scores over enough contests."""
    wins = (F.col("right") >= F.col("right_away")) & (F.col("br") < 0.25) & (F.col("ll") < F.ln(F.lit(2.0)))
    enough = F.col("n") >= 8
    reason = F.when(~enough, "insufficient_temporal_evidence").when(wins, "adaptive_improves_accuracy_and_proper_scores").otherwise("adaptive_failed_production_gate")
    return _gate(t).select("group_id", "n", F.when(enough & wins, "adaptive").otherwise("static").alias("selected"), reason.alias("reason"))


@query("""SELECT l_returnflag, l_linestatus, len(reasons) = 0 AS activate, array_to_string(reasons, ';') AS reasons FROM (SELECT l_returnflag, l_linestatus, list_filter([
  CASE WHEN l_returnflag = 'R' THEN 'not_as_of' END, CASE WHEN n > d THEN 'not_deduplicated' END, CASE WHEN cover < 0.8 THEN 'low_coverage' END, CASE WHEN r >= 0.98 THEN 'near_duplicate' END, CASE WHEN delta >= 0 THEN 'no_gain' END], lambda x: x IS NOT NULL) AS reasons FROM (
  SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey * 8 + l_linenumber) AS d, avg((l_quantity > 5)::INT) AS cover, abs(corr(l_quantity, l_extendedprice)) AS r, avg(l_discount) - 0.05 AS delta FROM lineitem GROUP BY ALL))""")
def external_gate(t: Tables) -> DataFrame:
    """Every unmet condition of a feature's acceptance, by name."""
    got = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_distinct(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("d"), F.avg((F.col("l_quantity") > 5).cast("int")).alias("cover"),
        F.abs(pearson("l_quantity", "l_extendedprice")).alias("r"), (F.avg("l_discount") - 0.05).alias("delta"),
    )
    tests = {"not_as_of": F.col("l_returnflag") == "R", "not_deduplicated": F.col("n") > F.col("d"), "low_coverage": F.col("cover") < 0.8, "near_duplicate": F.col("r") >= 0.98, "no_gain": F.col("delta") >= 0}
    reasons = F.array_compact(F.array(*[F.when(c, name) for name, c in tests.items()]))
    return got.select("l_returnflag", "l_linestatus", (F.size(reasons) == 0).alias("activate"), F.array_join(reasons, ";").alias("reasons"))


@query("""SELECT contest_id, round(ev, 4) AS evidence, CASE WHEN ev < 43 OR (mg < 4 AND ev < 62) THEN 'roulette' WHEN mg < 5 THEN 'even'
  WHEN greatest(50, least(99, greatest(pct, 100 - pct) - greatest(4, least(20, 17 - ev * 0.11)))) <= 50 OR floor(ev * (0.65 + 0.35 * least(1, mg / 15)) + 0.5) < 55 THEN 'pass' ELSE 'pick' END AS status FROM (
  SELECT contest_id, pct, abs(pct - 50) AS mg, 100 * (0.6 * (1 - exp(-g / 6.0)) + 0.1 * (1 - exp(-d / 1.5)) + 0.3 * r) AS ev FROM (
  SELECT o_orderkey AS contest_id, (o_orderkey % 13)::DOUBLE AS g, (o_orderkey % 4)::DOUBLE AS d, (o_orderkey % 11) / 10.0 AS r, (5 + o_orderkey % 91)::DOUBLE AS pct FROM orders))""")
def confidence_decision(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    games, direct, roster, pct = (k % 13).cast("double"), (k % 4).cast("double"), (k % 11) / 10.0, (5 + k % 91).cast("double")
    return t.orders.select(k.alias("contest_id"), F.round(X.evidence_score(games, direct, roster), 4).alias("evidence"), X.decision(games, direct, roster, pct).alias("status"))


@query(with_(*ALL, body="""SELECT contest_id, round(q * q * (3 - 2 * q), 6) AS bo3, round(q * q * q * (10 - 15 * q + 6 * q * q), 6) AS bo5 FROM (SELECT contest_id, greatest(0.001, least(0.999, p)) AS q FROM forecast)"""))
def best_of_convert(t: Tables) -> DataFrame:
    p = F.col("p")
    return t.forecast().select("contest_id", F.round(X.best_of(p, 3), 6).alias("bo3"), F.round(X.best_of(p, 5), 6).alias("bo5"))


@query("""WITH RECURSIVE b AS (SELECT s / 100.0::DOUBLE AS target, 0.001::DOUBLE AS lo, 0.999::DOUBLE AS hi, 0 AS i FROM range(1, 100) x(s) UNION ALL
  SELECT target, CASE WHEN m * m * (3 - 2 * m) < target THEN m ELSE lo END, CASE WHEN m * m * (3 - 2 * m) < target THEN hi ELSE m END, i + 1 FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE i < 60))
  SELECT target, round((lo + hi) / 2, 6) AS map_p FROM b WHERE i = 60""")
def implied_map_bisect(t: Tables) -> DataFrame:
    return t.spark.range(1, 100).select((F.col("id") / 100.0).alias("target")).select("target", F.round(X.implied_map(F.col("target"), 3), 6).alias("map_p"))


@query(with_(*ALL, body="""SELECT contest_id, round(p * p, 6) AS s20, round(2 * p * p * (1 - p), 6) AS s21, round(2 * p * (1 - p) * (1 - p), 6) AS s12, round((1 - p) * (1 - p), 6) AS s02,
  round(0.8 + 0.2 * p, 6) AS from_10 FROM forecast"""))
def exact_scores(t: Tables) -> DataFrame:
    """Terminal scores of a best of three, and the chance to win it from 1:0 with 0.8 for the current map."""
    p = F.col("p")
    s = lambda a, b: F.round(X.score_probability(2, a, b, p, p), 6)
    ahead = X.score_probability(2, 2, 0, F.lit(0.8), p, 1, 0) + X.score_probability(2, 2, 1, F.lit(0.8), p, 1, 0)
    return t.forecast().select("contest_id", s(2, 0).alias("s20"), s(2, 1).alias("s21"), s(1, 2).alias("s12"), s(0, 2).alias("s02"), F.round(ahead, 6).alias("from_10"))


# Nodes and weights of the 9-point Gauss-Hermite rule.
NODES = (-3.1909932017815276, -2.266580584531843, -1.468553289216668, -0.7235510187528376, 0.0, 0.7235510187528376, 1.468553289216668, 2.266580584531843, 3.1909932017815276)
WEIGHTS = (0.00003960697726326, 0.004943624275537, 0.088474527394377, 0.432651559002556, 0.720235215606051, 0.432651559002556, 0.088474527394377, 0.004943624275537, 0.00003960697726326)


@query(with_(*ALL, body="SELECT contest_id, round((" + " + ".join(f"{w} / (1 + exp(-(ln(p / (1 - p)) + {2 ** 0.5 * 0.35 * x})))" for x, w in zip(NODES, WEIGHTS)) + f") / {sum(WEIGHTS)}, 6) AS p_form FROM forecast"))
def gauss_hermite(t: Tables) -> DataFrame:
    """The forecast averaged over a normal team form of 0.35 logits."""
    z = X.logit(F.col("p"))
    total = F.aggregate(F.arrays_zip(F.array(*map(F.lit, NODES)).alias("x"), F.array(*map(F.lit, WEIGHTS)).alias("w")), F.lit(0.0), lambda a, n: a + n["w"] * X.sigmoid(z + n["x"] * (2**0.5 * 0.35)))
    return t.forecast().select("contest_id", F.round(total / sum(WEIGHTS), 6).alias("p_form"))


LIVE_C = (0.8, 0.25, 0.12)


@query(with_(LIVE, body=f"""SELECT event_id, CASE WHEN phase = 'purchase' THEN 'draft' WHEN s < 600 THEN 'waiting_for_10_minutes' WHEN s > 1200 THEN 'outside_validated_range_after_20' WHEN s IN (600, 900, 1200) THEN 'validated_fixed_window' ELSE 'validated_window_interpolation' END AS availability,
  round(CASE WHEN s BETWEEN 600 AND 1200 THEN greatest(0.01, least(0.99, 1 / (1 + exp(-({LIVE_C[0]} * ln(0.55 / 0.45) + {LIVE_C[1]} * g + {LIVE_C[2]} * g * ((s / 60.0 - 10) / 10)))))) END, 6) AS p,
  s >= 600 AND (abs(g) >= 15 OR (s >= 1200 AND abs(g) >= 9 AND abs(kl) >= 8 AND (g = 0 OR kl = 0 OR sign(g) = sign(kl))) OR (s >= 2100 AND abs(g) >= 6 AND (g = 0 OR kl = 0 OR sign(g) = sign(kl)))) AS settled
  FROM (SELECT event_id, phase, t % 2700 AS s, (lead - 20) * 200 / 1000 AS g, k % 21 - 10 AS kl FROM live)"""))
def live_map_estimate(t: Tables) -> DataFrame:
    s, lead = F.col("t") % 2700, (F.col("lead") - 20) * 200
    phase = F.when(F.col("phase") == "purchase", "draft").otherwise("game")
    return t.live().select("event_id", X.live_availability(phase, s, lead).alias("availability"), F.round(X.live_map(F.lit(0.55), s, lead, LIVE_C), 6).alias("p"), X.live_settled(s, lead, F.col("k") % 21 - 10).alias("settled"))


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), s AS (SELECT label, d, sum(x) AS s, sum(x * x) AS q FROM e GROUP BY ALL),
  f AS (SELECT label, round(0.5 * sum(s * s - q), 4) AS fm FROM s GROUP BY ALL), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL)
  SELECT c.label, n, fm FROM c LEFT JOIN f ON c.label IS NOT DISTINCT FROM f.label""")
def fm_score_all(t: Tables) -> DataFrame:
    """Pairwise interactions of all members of a class: half the difference of the squared sum and the sum of squares, over all components."""
    x = t.embeddings.select("label", F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    sums = x.groupBy("label", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    fm = sums.groupBy(F.col("label").alias("of")).agg(F.round(0.5 * F.sum(F.col("s") * F.col("s") - F.col("q")), 4).alias("fm"))
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n")).join(fm, F.col("label").eqNullSafe(F.col("of")), "left").select("label", "n", "fm")


@query(with_(*ALL, body="SELECT group_id, round(stddev_samp(r) * 4, 6) AS form_sd, count(*) AS teams FROM (SELECT group_id, side0_team, sum(y - p) / (count(*) + 8.0) AS r FROM forecast JOIN contest USING (contest_id, group_id) GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL"))
def team_form_sd(t: Tables) -> DataFrame:
    rows = t.forecast().join(t.contest().select("contest_id", "side0_team"), "contest_id")
    r = rows.groupBy("group_id", "side0_team").agg((F.sum(F.col("y") - F.col("p")) / (F.count("*") + 8.0)).alias("r"), F.count("*").alias("k")).filter("k >= 3")
    return r.groupBy("group_id").agg(F.round(F.stddev_samp("r") * 4, 6).alias("form_sd"), F.count("*").alias("teams"))


@query("""WITH a AS (SELECT least(c_nationkey, s_nationkey) AS low, greatest(c_nationkey, s_nationkey) AS high, avg(CASE WHEN c_nationkey < s_nationkey THEN c_acctbal > 0 ELSE c_acctbal <= 0 END::INT) * 100 AS pct
    FROM customer JOIN supplier ON c_custkey % 97 = s_suppkey % 97 WHERE c_nationkey <> s_nationkey GROUP BY ALL),
  g AS (SELECT team, avg(z) AS s FROM (SELECT low AS team, z FROM (SELECT *, ln(greatest(0.1, least(0.9, pct / 100)) / (1 - greatest(0.1, least(0.9, pct / 100)))) AS z FROM a) UNION ALL SELECT high, -ln(greatest(0.1, least(0.9, pct / 100)) / (1 - greatest(0.1, least(0.9, pct / 100)))) FROM a) GROUP BY ALL)
  SELECT x.team AS low, y.team AS high, round(coalesce(a.pct / 100, greatest(0.1, least(0.9, 1 / (1 + exp(-0.78 * (x.s - y.s)))))), 5) AS p, a.pct IS NOT NULL AS answered
  FROM g x JOIN g y ON x.team < y.team LEFT JOIN a ON a.low = x.team AND a.high = y.team""")
def opinion_completion(t: Tables) -> DataFrame:
    """Pairs with an answer keep it; the others follow from the teams' mean logits."""
    # Each side is counted by key modulo 97 and nation first: the join is of counts, whatever the number of rows.
    asked = t.customer.groupBy((F.col("c_custkey") % 97).alias("k"), "c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("plus"), F.count_if(F.col("c_acctbal") <= 0).alias("minus"))
    by = t.supplier.groupBy((F.col("s_suppkey") % 97).alias("k"), "s_nationkey").agg(F.count("*").alias("times"))
    rows = asked.join(by, "k").filter("c_nationkey <> s_nationkey")
    yes = F.when(F.col("c_nationkey") < F.col("s_nationkey"), F.col("plus")).otherwise(F.col("minus"))
    a = rows.groupBy(F.least("c_nationkey", "s_nationkey").alias("low"), F.greatest("c_nationkey", "s_nationkey").alias("high")).agg((F.sum(yes * F.col("times")) / F.sum((F.col("plus") + F.col("minus")) * F.col("times")) * 100).alias("pct"))
    z = X.logit(F.col("pct") / 100, 0.1)
    g = a.select(F.explode(F.array(F.struct(F.col("low").alias("team"), z.alias("z")), F.struct(F.col("high").alias("team"), (-z).alias("z")))).alias("r")).groupBy("r.team").agg(F.avg("r.z").alias("s"))
    one = g.agg(F.array_sort(F.collect_list(F.struct("team", "s"))).alias("x"))  # a few dozen teams
    pairs = F.flatten(F.transform("x", lambda u: F.transform(F.filter("x", lambda v: v["team"] > u["team"]), lambda v: F.struct(u["team"].alias("low"), v["team"].alias("high"), (u["s"] - v["s"]).alias("gap")))))
    full = one.select(F.explode(pairs).alias("p")).select("p.*").join(a, ["low", "high"], "left")
    return full.select("low", "high", F.round(F.coalesce(F.col("pct") / 100, X.clamp(X.sigmoid(0.78 * F.col("gap")), 0.1, 0.9)), 5).alias("p"), F.col("pct").isNotNull().alias("answered"))


@query("SELECT n_regionkey AS region, k AS signature, n, rank FROM (SELECT n_regionkey, k, n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, k)::INTEGER AS rank FROM (SELECT n_regionkey, substr(sha256(p_type || o_orderstatus), 1, 4) AS k, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)) WHERE rank <= 3")
def scenario_counts(t: Tables) -> DataFrame:
    """The most frequent outcome signatures of each region."""
    rows = t.lineitem.select("l_partkey", "l_orderkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"), "l_orderkey")
    rows = rows.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey").join(t.nation.select("n_nationkey", "n_regionkey"), "n_nationkey")
    k = F.substring(F.sha2(F.concat("p_type", "o_orderstatus").cast("binary"), 256), 1, 4)
    got = rows.groupBy(F.col("n_regionkey").alias("region"), k.alias("signature")).agg(F.count("*").alias("n"))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("n"), "signature"))).filter("rank <= 3")
