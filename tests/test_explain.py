"""Forecasts of drafts and the shares of their signals."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skirmish.functions import exprs as X
from skirmish.plans import explain
from skirmish.plans.contest import Tables


def test_shares_add_up(spark):
    rows = spark.createDataFrame([([0.3, -1.2, None, 2.0],), ([],), ([0.0],)], "x array<double>")
    got = [r.s for r in rows.select(X.shares_of(F.col("x")).alias("s")).collect()]
    s = lambda z: 1 / (1 + 2.718281828459045**-z)
    assert got[0] == pytest.approx([s(0.3) - 0.5, s(-0.9) - s(0.3), 0, s(1.1) - s(-0.9)]) and got[1] == [] and got[2] == [0]
    assert sum(got[0]) == pytest.approx(s(1.1) - 0.5)


def test_shares_of_every_contest_add_up_to_its_probability(spark, sf):
    t = Tables(spark, sf)
    forecasts = {r.contest_id: r for r in explain.active_inference(t).collect()}
    sums = defaultdict(lambda: [0.0, 0.0, 0])
    for r in explain.signal_shares(t).collect():
        held = sums[r.contest_id]
        held[0], held[1], held[2] = held[0] + r.learned, held[1] + r.heuristic, held[2] + 1
    ok = {i for i, r in forecasts.items() if r.status == "ok"}
    assert set(sums) == ok and {r.status for r in forecasts.values()} >= {"ok", "invalid_picks"}
    for i in ok:
        r = forecasts[i]
        assert sums[i][2] == len(explain.SIGNALS) and 0 < r.completeness <= 1
        for total, p in ((sums[i][0], r.probability), (sums[i][1], r.heuristic)):
            assert min(explain.CEILING, max(explain.FLOOR, total + 0.5)) == pytest.approx(p, abs=1e-4)
    assert all(r.probability is None for i, r in forecasts.items() if i not in ok)


def test_schedule_of_pages(spark):
    """Explicit times, today, live without a time, carried stages and dates, aliases, repeated pairs, and pages without items."""
    from datetime import date, datetime, timezone

    from skirmish.sources.schedule import schedule

    names = spark.createDataFrame([("REDS", "reds"), ("REDSTEAM", "reds"), ("BLUES", "blues"), ("GREENS", "greens"), ("ELANCO", "elan")], "key string, team string")
    item = lambda when, *alts: f'<div class="c item_a"><div class="date_x">{when}</div>' + "".join(f'<img src="x" alt="{a}">' for a in alts) + "<span>vs</span></div>"
    pages = [
        (1, '<div class="tab_x isActive_y"><span>Раунд 2</span></div>' + item("14.08.26 в 08:00", "Reds", "Blues", "Greens") + item("Сегодня в 13:00", "Greens", "REDS team") + item("Завтра в 01:05", "Blues", "Greens") + item("LIVE", "Reds", "Blues")),
        (2, '<div class="tab_x isActive_y"><span>Elimination Round</span></div>' + item("<span>LIVE</span>", "Élan &amp; Co", "Reds") + item("", "Blues", "Greens") + item("", "Blues", "Nobody")),
        (3, '<div class="tab_x isActive_y"><span>Текущие</span></div><h3>Плей-офф</h3>' + item("21.08.26 в 02:00", "Reds", "Blues") + "<h3>22.08.26</h3>" + item("", "Reds", "Greens")),
        (4, ""), (5, None), (6, "<p>nothing</p>"),
    ]
    now = int(datetime(2026, 8, 13, 10, 15, tzinfo=timezone.utc).timestamp())
    at = lambda *x: int(datetime(*x, tzinfo=timezone.utc).timestamp())
    got = sorted(tuple(r) for r in schedule(spark.createDataFrame(pages, "page_id int, html string"), names, now).collect())
    assert got == [
        (1, 1, "reds", "blues", 2, at(2026, 8, 14, 5), date(2026, 8, 14), "swiss", False),
        (1, 2, "greens", "reds", 2, at(2026, 8, 13, 10), date(2026, 8, 13), "swiss", False),
        (1, 3, "blues", "greens", 2, at(2026, 8, 13, 22, 5), date(2026, 8, 14), "swiss", False),
        (2, 1, "elan", "reds", 1, None, None, "playin", True),
        (2, 2, "blues", "greens", 1, None, None, "playin", False),
        (3, 1, "reds", "blues", 2, at(2026, 8, 20, 23), date(2026, 8, 21), "playoff", False),
        (3, 2, "reds", "greens", 3, None, date(2026, 8, 22), "playoff", False),
    ]
