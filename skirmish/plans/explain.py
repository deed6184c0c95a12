"""A contest's forecast from its teams and draft, and what each signal adds to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions import exprs as X
from skirmish.plans.contest import CONTEST, Tables, with_
from skirmish.plans.draft import ALL, FEATURES, WEIGHTS, states
from skirmish.plans.registry import query
from skirmish.sources.schedule import schedule

# Weights of the team prior and of the draft between even teams and clear favourites, the gap in logits between the two, members of a whole draft, and the bounds of the forecast.
CLOSE_PRIOR, CLEAR_PRIOR, CLOSE_DRAFT, CLEAR_DRAFT, CLEAR_GAP, WHOLE, FLOOR, CEILING = 0.45, 1.0, 2.15, 1.15, 1.4, 5.0, 0.08, 0.92
SIGNALS = ("team_prior", *FEATURES[1:])

_T = f"least(1, greatest(0, abs(base) / {CLEAR_GAP}))"
_GAP = f"({_T} * {_T} * (3 - 2 * {_T}))"
_EXPLAINED = (
    *ALL,
    """counted AS (SELECT contest_id, least(count(*) FILTER (WHERE side = 0), count(*) FILTER (WHERE side = 1)) AS k, count(*) - count(DISTINCT entity) AS twice FROM appearances GROUP BY ALL)""",
    f"""inputs AS (SELECT f.* EXCLUDE (team_prior), ln(q / (1 - q)) AS base, least(1, coalesce(k, 0) / {WHOLE}) AS whole, CASE WHEN coalesce(k, 0) = 0 THEN 'no_picks' WHEN twice > 0 THEN 'invalid_picks' ELSE 'ok' END AS status
  FROM features f JOIN (SELECT contest_id, greatest(0.01, least(0.99, p)) AS q FROM forecast) USING (contest_id) LEFT JOIN counted USING (contest_id))""",
    f"applied AS (SELECT contest_id, 0 AS k, 'team_prior' AS signal, {WEIGHTS[0]} * base AS learned, base * ({CLOSE_PRIOR} + {CLEAR_PRIOR - CLOSE_PRIOR} * {_GAP}) AS heuristic FROM inputs WHERE status = 'ok' UNION ALL "
    + " UNION ALL ".join(f"SELECT contest_id, {i}, '{n}', {w} * {n}{'' if n == 'side' else ' * whole'}, {n} * whole * ({CLOSE_DRAFT} + {CLEAR_DRAFT - CLOSE_DRAFT} * {_GAP}) FROM inputs WHERE status = 'ok'" for i, (n, w) in enumerate(zip(FEATURES, WEIGHTS, strict=True)) if i)
    + ")",
)


def explained(t: Tables) -> DataFrame:
    """contest_id, status, completeness, and the logits that each signal adds, in order: `learned` by the combiner's weights, `heuristic` by the gap between the teams.

    A contest without picks on a side, or with one entity picked twice, has a status and no logits. With fewer than five on a side,
    all signals of the draft count in proportion (the side of the map in the learned combiner counts whole).
    """
    rows = states(t).withColumn("base", X.logit(F.col("p"), 0.01))
    fewest = F.least("n0", "n1")
    status = F.when(fewest == 0, "no_picks").when(F.col("shared") > 0, "invalid_picks").otherwise("ok")
    whole = F.least(F.lit(1.0), fewest / WHOLE)
    x = X.clamp(F.abs("base") / CLEAR_GAP, 0.0, 1.0)
    gap = x * x * (3 - 2 * x)
    draft = CLOSE_DRAFT + (CLEAR_DRAFT - CLOSE_DRAFT) * gap
    learned = [WEIGHTS[0] * F.col("base"), *[w * F.col(n) * (F.lit(1.0) if n == "side" else whole) for n, w in zip(FEATURES[1:], WEIGHTS[1:], strict=True)]]
    heuristic = [F.col("base") * (CLOSE_PRIOR + (CLEAR_PRIOR - CLOSE_PRIOR) * gap), *[F.col(n) * whole * draft for n in FEATURES[1:]]]
    ok = status == "ok"
    return rows.select("contest_id", status.alias("status"), whole.alias("completeness"), F.when(ok, F.array(*learned)).alias("learned"), F.when(ok, F.array(*heuristic)).alias("heuristic"))


def rounded(x: Column) -> Column:
    """To five digits; probabilities that are short fractions lie on halves of the last one, which the last bit of a sum would tip."""
    return F.round(x + 1e-9, 5)


def _total(x: Column | str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


@query(with_(*_EXPLAINED, body=f"""SELECT i.contest_id, status, round(whole, 6) AS completeness, CASE WHEN status = 'ok' THEN round(greatest({FLOOR}, least({CEILING}, 1 / (1 + exp(-l)))) + 1e-9, 5) END AS probability, CASE WHEN status = 'ok' THEN round(greatest({FLOOR}, least({CEILING}, 1 / (1 + exp(-h)))) + 1e-9, 5) END AS heuristic,
  round(1 / (1 + exp(-l0)) + 1e-9, 5) AS team_prior, round(1 / (1 + exp(-(l - l0))) + 1e-9, 5) AS draft_only FROM inputs i LEFT JOIN (
    SELECT contest_id, sum(learned) AS l, sum(heuristic) AS h, sum(learned) FILTER (WHERE k = 0) AS l0 FROM applied GROUP BY ALL) a ON a.contest_id = i.contest_id"""))
def active_inference(t: Tables) -> DataFrame:
    """The forecast of each contest from teams and draft, learned and heuristic, its team and draft parts alone, and whether the picks allow one."""
    learned, first = _total("learned"), F.get("learned", F.lit(0))
    bounded = lambda z: rounded(X.clamp(X.sigmoid(z), FLOOR, CEILING))
    return explained(t).select(
        "contest_id", "status", F.round("completeness", 6).alias("completeness"), F.when(F.col("status") == "ok", bounded(learned)).alias("probability"), F.when(F.col("status") == "ok", bounded(_total("heuristic"))).alias("heuristic"),
        rounded(X.sigmoid(first)).alias("team_prior"), rounded(X.sigmoid(learned - first)).alias("draft_only"),
    )


def _share_sql(c: str) -> str:
    return f"coalesce(nullif(round(1 / (1 + exp(-sum({c}) OVER w)) - 1 / (1 + exp(-(sum({c}) OVER w - {c}))) + 1e-9, 5), 0), 0) AS {c}"


@query(with_(*_EXPLAINED, body=f"SELECT contest_id, k::INTEGER AS k, signal, {_share_sql('learned')}, {_share_sql('heuristic')} FROM applied WINDOW w AS (PARTITION BY contest_id ORDER BY k)"))
def signal_shares(t: Tables) -> DataFrame:
    """What each signal adds to a contest's probability, in order. With the team prior first, a contest's shares add up to its probability (before bounds) less a half."""
    both = F.arrays_zip(F.array(*map(F.lit, SIGNALS)).alias("signal"), X.shares_of(F.col("learned")).alias("learned"), X.shares_of(F.col("heuristic")).alias("heuristic"))
    rows = explained(t).filter("status = 'ok'").select("contest_id", F.posexplode(both).alias("k", "s"))
    return rows.select("contest_id", "k", "s.signal", rounded(F.col("s.learned")).alias("learned"), rounded(F.col("s.heuristic")).alias("heuristic"))


#: Pages have years of this century: seconds by which contests are moved, the present, the first day of playoffs, and contests a page.
SHIFT, NOW, PLAYOFFS, PAGE = 1_000_000_000, 1_883_612_800, "2026-08-20", 20
_HEADS = ("Group stage", "Elimination Round", "Playoff")


def schedule_pages(t: Tables) -> DataFrame:
    """page_id, html: pages of the schedule, twenty numbers of contests each, with a tab, headings before the items, names with entities and accents, and dates in the page's ways."""
    named = t.nation.select(F.concat(F.lit("t"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("team"), F.concat(F.replace("n_name", F.lit("A"), F.lit("Á")), F.lit(" &amp; Co")).alias("name"))
    c = t.contest().withColumn("ts", F.col("ts") + SHIFT).select("contest_id", "ts", "side0_win", "total", "side0_team", "side1_team")
    c = c.join(named.select(F.col("team").alias("side0_team"), F.col("name").alias("name0")), "side0_team").join(named.select(F.col("team").alias("side1_team"), F.col("name").alias("name1")), "side1_team")
    day = F.date_format(F.timestamp_seconds("ts"), "dd.MM.yy")
    hour = F.concat(F.lpad((F.col("contest_id") % 24).cast("string"), 2, "0"), F.lit(":30"))
    said = F.when(F.col("side0_win") == 1, F.concat(day, F.lit(" в "), hour)).when(F.col("side0_win") == 0, F.when(F.col("contest_id") % 2 == 0, "<span>LIVE</span>").otherwise(F.concat(F.lit("Завтра в "), hour))).otherwise("")
    head = F.when(F.col("contest_id") % 7 == 0, F.concat(F.lit("<h3>"), day, F.lit("</h3>"))).otherwise("")
    item = F.concat(head, F.lit('<div class="item_x"><div class="date_x">'), said, F.lit('</div><img alt="'), F.col("name0"), F.lit('"><img alt="'), F.col("name1"), F.lit('"><span class="vs_x">vs</span><img alt="Unknown"></div>'))
    page = F.floor(F.col("contest_id") / PAGE)
    rows = c.groupBy(page.alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("contest_id", item.alias("x")))), lambda r: r["x"]), "").alias("items"))
    top = F.concat(F.lit('<div class="tab_x isActive_y"><span>Раунд '), (F.col("page_id") % 5 + 1).cast("string"), F.lit("</span></div>"), F.when(F.col("page_id") % 4 == 3, "").otherwise(F.concat(F.lit("<h2>"), F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("page_id") % 4 % 3 + 1).cast("int")), F.lit("</h2>"))))
    return rows.select("page_id", F.concat(top, "items").alias("html"))


@query(with_(CONTEST, body=f"""SELECT page_id, item, team_a, team_b, CASE WHEN stage = 'playoff' AND coalesce(scheduled_date, CASE WHEN live THEN today END) >= DATE '{PLAYOFFS}' THEN date_diff('day', DATE '{PLAYOFFS}', coalesce(scheduled_date, CASE WHEN live THEN today END)) + 1 ELSE page_id % 5 + 1 END::INTEGER AS round,
  scheduled_at, scheduled_date, stage, live FROM (SELECT page_id, item, side0_team AS team_a, side1_team AS team_b, today, coalesce(side0_win = 0 AND contest_id % 2 = 0, false) AS live,
    CASE WHEN side0_win = 1 THEN epoch(day)::BIGINT WHEN side0_win = 0 AND contest_id % 2 = 1 THEN epoch(today + 1)::BIGINT END + (contest_id % 24) * 3600 + 1800 - 10800 AS scheduled_at,
    CASE WHEN side0_win = 1 THEN day WHEN side0_win = 0 AND contest_id % 2 = 1 THEN today + 1 WHEN side0_win = 0 THEN NULL ELSE headed END::DATE AS scheduled_date,
    CASE page_id % 4 WHEN 0 THEN 'swiss' WHEN 1 THEN 'playin' WHEN 2 THEN 'playoff' ELSE 'swiss' END AS stage FROM (
      SELECT *, contest_id // {PAGE} AS page_id, row_number() OVER (PARTITION BY contest_id // {PAGE} ORDER BY contest_id)::INTEGER AS item, make_timestamp((ts + {SHIFT}) * 1000000)::DATE AS day, make_timestamp(({NOW} + 10800)::BIGINT * 1000000)::DATE AS today,
        last_value(CASE WHEN contest_id % 7 = 0 THEN make_timestamp((ts + {SHIFT}) * 1000000)::DATE END IGNORE NULLS) OVER (PARTITION BY contest_id // {PAGE} ORDER BY contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS headed,
        row_number() OVER (PARTITION BY contest_id // {PAGE}, least(side0_team, side1_team), greatest(side0_team, side1_team) ORDER BY contest_id) AS nth FROM contest) WHERE nth = 1)"""))
def schedule_items(t: Tables) -> DataFrame:
    """The schedule read back from its pages: an item a row, with what pages say in words, entities and headings."""
    names = t.nation.select(F.concat(F.upper(F.regexp_replace("n_name", "[^A-Za-z0-9]", "")), F.lit("CO")).alias("key"), F.concat(F.lit("t"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("team"))
    return schedule(schedule_pages(t), names, NOW, 180, PLAYOFFS)
