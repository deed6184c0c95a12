"""Operators against plain loops and known values."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skirmish.functions import exprs as X
from skirmish.operators import evaluation, joins, ratings, windows
from skirmish.sources import readers, sinks
from skirmish.streaming import live


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_series_scores(spark):
    p, half = F.lit(0.8), F.lit(0.5)
    got = one(spark, *[X.score_probability(2, a, b, half, half) for a, b in ((2, 0), (2, 1), (1, 2), (0, 2))])
    assert list(got) == pytest.approx([0.25] * 4)
    assert list(one(spark, X.score_probability(2, 2, 0, p, half, 1, 0), X.score_probability(2, 2, 1, p, half, 1, 0), X.score_probability(2, 1, 2, p, half, 1, 0))) == pytest.approx([0.8, 0.1, 0.1])
    five = [X.score_probability(3, a, b, F.lit(0.6), F.lit(0.6), 2, 1) for a, b in ((3, 1), (3, 2), (2, 3))]
    assert sum(one(spark, *five)) == pytest.approx(1.0)


def test_best_of_and_inverse(spark):
    got = one(spark, X.best_of(F.lit(0.6), 3), X.implied_map(X.best_of(F.lit(0.6), 3), 3), X.best_of(F.lit(0.6), 5), X.convert_series(F.lit(0.5)))
    assert list(got) == pytest.approx([0.648, 0.6, 0.68256, 0.5])


def test_weights_and_rounding(spark):
    got = one(spark, X.evidence_weight(F.lit(2), F.lit(1)), X.evidence_weight(F.lit(2), F.lit(0)), X.information(F.lit(1), F.lit(0)), X.round_js(F.lit(-2.5)), X.round_js(F.lit(2.5)))
    assert [float(x) for x in got] == pytest.approx([0.72, 1.0, 0.6, -2, 3])


def test_live_map(spark):
    c = (0.8, 0.25, 0.12)
    p = one(spark, *[X.live_map(F.lit(0.6), F.lit(t), F.lit(5000.0), c) for t in (599, 600, 720, 1200, 1201)], X.live_map(F.lit(0.4), F.lit(720), F.lit(-5000.0), c))
    assert p[0] is None and p[4] is None and p[2] + p[5] == pytest.approx(1)
    a = one(spark, *[X.live_availability(F.lit("game"), F.lit(t), F.lit(1.0)) for t in (599, 600, 720, 1201)])
    assert list(a) == ["waiting_for_10_minutes", "validated_fixed_window", "validated_window_interpolation", "outside_validated_range_after_20"]


def test_generator_is_sequential(spark):
    def draws(seed, n):
        out, s = [], seed
        mask = 0xFFFFFFFF
        for _ in range(n):
            s = (s + 0x6D2B79F5) & mask
            v = ((s ^ (s >> 15)) * (s | 1)) & mask
            v = ((v + (((v ^ (v >> 7)) * (v | 61)) & mask)) & mask) ^ v
            out.append(((v ^ (v >> 14)) & mask) / 2**32)
        return out

    got = [r[0] for r in spark.range(1, 101).select(X.mulberry(F.lit(4242).cast("long"), F.col("id"))).collect()]
    assert got == draws(4242, 100)


def test_as_of(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 5)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 10, "x"), ("a", 15, "y"), ("a", 20, "z")], "k string, rt int, v string")
    got = lambda strict: {r.id: r.v for r in joins.as_of(left, right, ["k"], "t", "rt", ["v"], strict=strict).collect()}
    assert got(False) == {1: "x", 2: "z", 3: None}
    assert got(True) == {1: None, 2: "y", 3: None}


def test_unique_candidate_and_upsert(spark):
    pairs = spark.createDataFrame([(1, 5), (2, 6), (2, 7)], "p int, c int")
    assert {(r.p, r.linked) for r in joins.unique_candidate(pairs, "p").collect()} == {(1, True), (2, False)}
    old = spark.createDataFrame([(1, "a", None, 1)], "k int, x string, y string, v int")
    new = spark.createDataFrame([(1, None, "b", 2), (2, "c", None, 1)], "k int, x string, y string, v int")
    assert {tuple(r) for r in joins.upsert(old, new, ["k"], "v").collect()} == {(1, "a", "b", 2), (2, "c", None, 1)}


def test_sessions(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 10), (3, "a", 20), (4, "a", 28820), (5, "a", 57621)], "id int, k string, t int")
    assert [r.session for r in windows.sessionize(rows, ["k"], "t", "id", 28800).orderBy("id").collect()] == [1, 1, 1, 1, 2]
    for cell in (7, 86400):  # rows alone in their cell, and all in one
        assert [r.session for r in windows.sessionize_global(rows, ["k"], "t", "id", 28800, cell=cell).orderBy("id").collect()] == [1, 2, 3, 3, 4]


def test_schedule_and_links(spark, tmp_path):
    """Times at the limits, one just outside, and rows without a time."""
    from skirmish.plans import meetings

    hour = 3600
    schema = "contest_id long, ts long, group_id string, version string, side0_team string, side1_team string, side0_win int"
    rows = [
        (1, 100 * hour, "g", "v", "a", "b", None), (7, 0, "g", "v", "a", "b", None),  # 7 has no time in the schedule
        (2, 136 * hour, "g", "v", "b", "a", 1), (3, 136 * hour + 1, "g", "v", "a", "b", 0), (4, 64 * hour, "g", "w", "a", "b", 0),
        (26, 500 * hour, "g", "v", "a", "b", 1), (6, 100 * hour, "g", "v", "a", "c", 1), (8, 112 * hour, "h", "v", "a", "b", 1), (9, 112 * hour + 1, "h", "v", "a", "b", 1),
    ]  # fmt: skip  # 26 has no time either

    class Fixed(meetings.Tables):
        def contest(self):
            return spark.createDataFrame(rows, schema)

    t = Fixed(spark, "")
    got = {(r.contest_id, r.other, r.rule) for r in meetings.schedule_contests(t).collect()}
    around = {(1, x, "around") for x in (2, 4, 8, 9)}
    assert got == around | {(1, 26, "untimed"), (7, 2, "cluster"), (7, 3, "cluster")}
    links = {r.other: (r.candidates, r.linked) for r in meetings.live_link(t).collect()}
    assert links == {2: (1, 7), 3: (1, 7), 8: (1, 1)}


def test_best_assignment(spark, sf):
    """Each side's value and order is the best over all orders of seats, found by a plain loop; all sides have a row."""
    from itertools import permutations
    from math import log

    from skirmish.plans import meetings

    t = meetings.Tables(spark, sf)
    rows = t.appearances().select("contest_id", "side", "team", "entity", "won").toPandas()
    rows["seat"] = (rows["entity"] + rows["contest_id"]) % 5
    sums = rows.groupby(["team", "seat", "entity"])["won"].agg(["sum", "count"])
    rate = ((sums["sum"] + 4) / (sums["count"] + 8)).clip(0.05, 0.95)
    known = {k: round(1e9 * log(p / (1 - p))) for k, p in rate[sums["count"] >= 2].items()}
    want = {}
    for (contest, side, team), g in rows.groupby(["contest_id", "side", "team"]):
        x = sorted(g["entity"])
        seats = [*range(5), *[9] * max(len(x) - 5, 0)]
        value = lambda p, x=x, team=team: sum(known.get((team, s, e), 0) for s, e in zip(p, x, strict=True))
        orders = [p for p in set(permutations(seats, len(x))) if len(x) <= 5 or p.count(9) == len(x) - 5]
        best = min(orders, key=lambda p: (-value(p), p))
        want[contest, side] = "".join("-" if s == 9 else str(s) for s in best), round(value(best) / 1e9, 5)
    got = {(r.contest_id, r.side): (r.seats, r.value) for r in meetings.best_assignment(t).collect()}
    assert got.keys() == want.keys() == {(r.contest_id, r.side) for r in t.appearances().select("contest_id", "side").distinct().collect()}
    assert all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 2e-5 for k, v in want.items())


def test_more_members_than_seats():
    from skirmish.operators.assignment import best_seats

    value, code = best_seats(np.array([[[5, 0], [4, 9], [7, 1]], [[0, 0], [0, 0], [0, 0]]], np.int64))
    assert value.tolist() == [16, 0] and code.tolist() == [2 * 9 + 1 * 3 + 0, 0 * 9 + 1 * 3 + 2]


def test_series_walk_the_whole_history(spark, sf):
    """Later years start from the ratings of the years before."""
    from skirmish.plans import models

    t = models.Tables(spark, sf)
    got = models.elo_walkforward(t).toPandas().set_index("contest_id")["p"]
    rows = models.series(t).toPandas().sort_values(["ts", "contest_id"])
    assert rows["weight"].nunique() > 1
    rating = dict.fromkeys([*rows["a"], *rows["b"]], 1500.0)
    for r in rows.itertuples():
        p = 1 / (1 + 10 ** ((rating[r.b] - rating[r.a]) / 400))
        assert abs(got[r.contest_id] - p) < 1e-9
        change = 24 * r.weight * (r.score - p)
        rating[r.a], rating[r.b] = rating[r.a] + change, rating[r.b] - change


def test_prefix_doesnt_leak(spark):
    data = [(i, "a", i // 3, i % 2) for i in range(12)]
    f = lambda d: [tuple(r) for r in windows.decayed_counts(windows.prefix_counts(spark.createDataFrame(d, "id int, k string, e int, won int"), ["k"], "id", "id", "won"), ["k"], "id", "id", "e", "won", 0.72).orderBy("id").select("prior_games", "prior_wins", "decayed_games", "decayed_wins").collect()]
    base, changed = f(data), f(data[:-1] + [(11, "a", 3, 0)])
    assert base == changed
    games = wins = 0.0
    for (i, _, e, won), got in zip(data, base, strict=True):
        if i and e != data[i - 1][2]:
            games, wins = games * 0.72, wins * 0.72
        assert got[2:] == pytest.approx((games, wins))
        games, wins = games + 1, wins + won


def test_pearson_and_bins(spark):
    rows = spark.createDataFrame([(float(i), float(i % 7), 1.0) for i in range(50)], "x double, y double, c double")
    r = rows.agg(evaluation.pearson("x", "y").alias("r"), evaluation.pearson("x", "c").alias("n")).first()
    d = rows.toPandas()
    assert r.r == pytest.approx(d.x.corr(d.y)) and r.n is None
    b = evaluation.bins_of_equal_count(rows.withColumn("p", F.col("x") / 50), "p", "x", 8).groupBy("bin").count().orderBy("bin").collect()
    assert [x["count"] for x in b] == [7] * 7 + [1]


def test_bootstrap_is_partition_free(spark):
    rows = spark.createDataFrame([(f"c{i % 7}", float(i)) for i in range(60)], "c string, d double")
    a, b = (sorted(evaluation.cluster_bootstrap(x, "c", "d", 30, 9).collect()) for x in (rows, rows.repartition(7)))
    assert [(x[0], round(x[1], 9)) for x in a] == [(x[0], round(x[1], 9)) for x in b]


def test_walk_is_prequential():
    rows = pd.DataFrame({"a": list("xyxzy"), "b": list("yzzyx"), "ts": [0.0, 86400, 2e5, 3e5, 4e5], "score": [1.0, 0, 1, 1, 0], "weight": [1.0] * 5})
    for m in ratings.arena():
        p = ratings.walk(rows, m["family"], m["step"], m["half_life"], m["extra"])
        assert p[0] == pytest.approx(0.5) and ((p > 0) & (p < 1)).all()
        other = rows.assign(score=[1.0, 0, 1, 1, 1])
        assert ratings.walk(other, m["family"], m["step"], m["half_life"], m["extra"]) == pytest.approx(p)


def test_online_update():
    base = pd.DataFrame({"a": list("aab"), "b": list("bcc"), "p": [0.5, 0.5, 0.5]})
    one_win = lambda w: ratings.update_live(base, pd.DataFrame({"a": ["a"], "b": ["b"], "won": [1.0], "weight": [w]}), 0.4)
    sweep, close = one_win(1.0), one_win(0.72)
    assert sweep.p[0] > close.p[0] > 0.5
    through = ratings.update_live(base, pd.DataFrame({"a": ["a", "b"], "b": ["b", "c"], "won": [1.0, 1.0], "weight": [1.0, 1.0]}), 0.4)
    assert through.p[1] > 0.5
    assert ratings.update_live(base, base.head(0).assign(won=[], weight=[]), 0.4).equals(base)


def test_ridge_and_logistic(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -0.5])))).astype(float)
    rows = spark.createDataFrame(pd.DataFrame({"u": x[:, 0], "v": x[:, 1], "y": y, "w": 1.0}))
    beta = ratings.fit_logistic(rows, ["u", "v"], "y", ridge=1.0)
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.abs(x.T @ (y - p) - beta).max() < 1e-6
    got = ratings.solve_ridge(ratings.normal_equations(rows, ["u", "v"], "y", "w").first(), 2, 3.0)
    a = np.c_[np.ones(300), x]
    assert got == pytest.approx(np.linalg.solve(a.T @ a + np.diag([0, 3, 3]), a.T @ y))


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"id": 1, "x": "p"}))
    (tmp_path / "in/b.json").write_text("{broken")
    rows = readers.json_documents(spark, str(tmp_path / "in"), "id long, x string")
    assert readers.rejected(rows).count() == 1
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), "id long").count() == 2
    low, high = spark.createDataFrame([(1, "low"), (2, "low")], "id int, v string"), spark.createDataFrame([(2, "high")], "id int, v string")
    assert {tuple(r) for r in readers.by_precedence([low, high], ["id"]).collect()} == {(1, "low"), (2, "high")}
    odd = spark.createDataFrame([('[{"a":1}]',), ('{"results":[{"a":2},{"a":3}]}',)], "j string")
    assert sorted(len(r[0]) for r in odd.select(readers.payload("j", "struct<a:int>")).collect()) == [1, 2]
    assert sinks.checkpoint(low, str(tmp_path / "out"), {"known": F.col("id") > 1}) == {"known": 1} and not (tmp_path / "out").exists()
    assert sinks.checkpoint(low, str(tmp_path / "out"), {"known": F.col("id") > 0}) == {"known": 0} and (tmp_path / "out").exists()
    assert [r.id for r in sinks.insert_ignore(low.filter("id = 1"), low, ["id"]).collect()] == [2]
    assert sinks.manifest(low, "v", "id").first().n == 2


def test_every_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    sinks.artifact(rows, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.json"))) == 1
    sinks.lines(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    for kind in ("x", "y"):
        sinks.append(rows, str(tmp_path / "audit"), kind)
    audit = {(r.kind, r.payload) for r in spark.read.parquet(str(tmp_path / "audit")).collect()}
    assert audit == {(k, p) for k in "xy" for p in ('{"id":1,"v":"a"}', '{"id":2}')}
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "id int, version int, v string")
    old.write.parquet(str(tmp_path / "old"))
    sinks.merge(str(tmp_path / "old"), spark.createDataFrame([(1, 2, "c"), (2, 4, "over"), (3, 1, "d")], old.schema), ["id"], "version", str(tmp_path / "merged"))
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "merged")).collect()} == {(1, "c"), (2, "over"), (3, "d")}  # new rows win


def test_load_is_whole_or_nothing(spark, tmp_path):
    path = str(tmp_path / "mart")
    parents, children = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "id int, child int")
    assert sinks.load({"parents": parents, "children": children}, path) == 1
    new = sinks.replace_children(sinks.current(spark, path, "parents"), sinks.current(spark, path, "children"), spark.createDataFrame([(1, "z")], parents.schema), spark.createDataFrame([(1, 12)], children.schema), "id")
    assert sinks.load(new, path) == 2
    assert {tuple(r) for r in sinks.current(spark, path, "parents").collect()} == {(1, "z"), (2, "b")}
    assert {tuple(r) for r in sinks.current(spark, path, "children").collect()} == {(1, 12), (2, 20)}
    broken = children.withColumn("child", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        sinks.load({"parents": parents, "children": broken}, path)
    assert sinks.current(spark, path, "parents").filter("v = 'z'").count() == 1
    # Another writer has claimed the next version and is not done: this one takes the one behind it, and no one reads the open one.
    assert sinks._new_file(spark, f"{path}/{sinks.CLAIMS}/00000003") and not sinks._new_file(spark, f"{path}/{sinks.CLAIMS}/00000003")
    parents.write.parquet(f"{path}/version=00000003/parents")
    assert sinks._versions(spark, path) == [1, 2]
    assert sinks.load({"parents": parents, "children": children}, path) == 4
    assert {tuple(r) for r in sinks.current(spark, path, "parents").collect()} == {(1, "a"), (2, "b")}


def test_checkpoints_hold_what_was_checked(spark, tmp_path):
    """A frame that differs each time it is computed is computed once."""
    odd = spark.range(4).select("id", F.expr("uuid()").alias("v"))
    assert sinks.checkpoint(odd, str(tmp_path / "o"), {"known": F.col("id") < 4}) == {"known": 0}
    assert sinks.checkpoint(odd, str(tmp_path / "o"), {"known": F.col("id") < 3}) == {"known": 1}
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["o"]
    sinks.verified_checkpoint(odd, str(tmp_path / "v"), ["v"], ["v"], 4)
    with pytest.raises(ValueError, match="already"):
        sinks.verified_checkpoint(odd, str(tmp_path / "v"), ["v"], ["v"], 4)


def test_verified_checkpoint(spark, tmp_path):
    import hashlib

    rows = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id int, p double")
    for bad, expected in ((rows, 3), (rows.union(rows), 4), (rows.withColumn("p", F.when(F.col("id") == 1, F.col("p"))), 2)):
        with pytest.raises(ValueError):
            sinks.verified_checkpoint(bad, str(tmp_path / "c"), ["id"], ["p"], expected)
        assert not (tmp_path / "c").exists()
    got = sinks.verified_checkpoint(rows, str(tmp_path / "c"), ["id"], ["p"], 2).collect()
    assert got and all(hashlib.sha256((tmp_path / "c/data" / r.file).read_bytes()).hexdigest() == r.sha256 for r in got)


def test_earlier_sums_equal_a_loop(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.randrange(3), r.randrange(400_000), r.randrange(2)) for i in range(120)]
    rows += [(i, k, t, w) for i, _, t, w in rows[:40] for k in (0, 1)]  # several rows of one unit, some with its key
    df = spark.createDataFrame(rows, "unit int, k int, ts int, won int")
    for keys in (["k"], []):
        got = sorted(tuple(x) for x in windows.earlier_sums(df, keys, "ts", "unit", {"w": F.col("won"), "n": F.lit(1)}).collect())
        mine = lambda a, b, keys=keys: (not keys or a[1] == b[1]) and (b[2], b[0]) < (a[2], a[0])
        assert got == sorted((*a, sum(b[3] for b in rows if mine(a, b)), sum(1 for b in rows if mine(a, b))) for a in rows)


def test_online_combiner_equals_a_loop():
    from skirmish.plans import draft

    r = np.random.default_rng(1)
    rows = pd.DataFrame(r.normal(size=(130, 8)), columns=list(draft.FEATURES)).assign(group_id="g", contest_id=range(130), ts=r.permutation(130), y=r.integers(0, 2, 130))
    w, want = list(draft.WEIGHTS), {}
    for i, (_, x) in enumerate(rows.sort_values("ts").iterrows()):
        z = sum(a * x[n] for a, n in zip(w, draft.FEATURES, strict=True))
        p = 1 / (1 + np.exp(-max(-12, min(12, z))))
        w = [min(2.5, max(0, a - 0.045 / (1 + i / 350) ** 0.5 * ((p - x.y) * x[n] + 0.002 * a))) for a, n in zip(w, draft.FEATURES, strict=True)]
        if i >= 100:
            want[x.contest_id] = p
    got = draft.learn_online(rows).set_index("contest_id")["p"].to_dict()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "h"), (1, 20, "h"), (2, 5, "q")], "match_id long, t long, hash string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    got = {r.match_id: (r.stable, r.frozen) for r in run(live.frozen(stream()), "freeze", "update")}
    assert got == {1: (2, "h"), 2: (1, None)}
    timed = stream().withColumn("at", F.timestamp_seconds("t"))
    assert len(run(live.deduplicated(timed, ["match_id", "hash"], "at"), "dedup", "append")) == 2
    done = spark.createDataFrame([(2,)], "match_id long")
    assert {r.match_id for r in run(live.suppressed(stream(), done, "match_id"), "suppress", "append")} == {1}
    assert sum(r.calls for r in run(live.call_budget(timed, "at"), "budget", "update")) == 3

    def grace():
        """What a run adds that goes on from the one before."""
        found = []
        q = live.with_grace(stream(), 120).writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).outputMode("update")
        q.option("checkpointLocation", str(tmp_path / "grace")).trigger(availableNow=True).start().awaitTermination()
        return {(r.match_id, r.t, r.retained) for r in found}

    assert grace() == {(1, 20, "fresh"), (2, 5, "fresh")}
    more = spark.createDataFrame([(3, 900, "z")], "match_id long, t long, hash string")
    more.write.mode("append").parquet(str(tmp_path / "in"))
    assert grace() == {(3, 900, "fresh"), (1, 20, "expired"), (2, 5, "expired")}
    state = spark.createDataFrame([(1, 0.7)], "match_id long, p double")
    assert {(r.match_id, r.p) for r in run(live.overlay(stream(), state, "match_id", F.col("t") >= 10), "overlay", "append")} == {(1, 0.7), (3, None)}
    won = live.progress(stream().withColumn("at", F.timestamp_seconds("t")), "match_id", "at", F.col("hash") == "h")
    assert {(r.match_id, r.maps, r.wins, r.complete) for r in run(won, "progress", "complete")} == {(1, 2, 2, True), (2, 1, 0, True), (3, 1, 0, True)}
    assert live.fresh(rows, F.lit(310)).count() == 2


def test_entry_works_without_llm(tmp_path):
    """In a copy without the corpus operators, their tests and the pipeline, all other queries register."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "skirmish", tmp_path / "skirmish", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import re, __spark_entry__ as e; q = e.queries(); assert 'entity_rates' in q and len(q) > 140 and not any(re.match(r'op[0-9]+_|pipeline', x) for x in [*q, *e.oracle_sql()])"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})


def test_influence_of_every_result(spark, sf):
    """Every finished contest is left out once, and against all other results of its tournament."""
    from skirmish.operators import ratings
    from skirmish.plans import catalogue
    from skirmish.plans.contest import Tables

    got = catalogue.queries()["influence_trace"](spark, sf).groupBy("contest_id").count().collect()
    want = {r.contest_id for r in Tables(spark, sf).finished().select("contest_id").collect()}
    assert {r.contest_id for r in got} == want and len({r["count"] for r in got}) <= 7  # the pairs of each year
    base = pd.DataFrame({"g": 1, "a": ["x", "x", "y"], "b": ["y", "z", "z"], "p": [0.5, 0.6, 0.7]})
    played = pd.DataFrame({"g": 1, "id": range(20), "a": ["x", "y"] * 10, "b": ["z"] * 20, "won": [1.0, 0.0, 0.0, 1.0] * 5, "weight": 0.7})
    rows = ratings.leave_one_out(spark.createDataFrame(base), spark.createDataFrame(played), "g", "id").toPandas()
    whole = ratings.update_live(base, played, 0.4)
    for i in range(20):
        mine = rows[rows["id"] == i].sort_values(["a", "b"])["influence"].to_numpy()
        assert np.allclose(mine, (whole["p"] - ratings.update_live(base, played.drop(i), 0.4)["p"]).to_numpy())


def test_fm_score_of_every_component(spark, sf):
    from skirmish.plans import catalogue

    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    for r in catalogue.queries()["fm_score_all"](spark, sf).collect():
        v = np.stack(e[e["label"] == r.label]["embedding"]).astype(float)
        assert r.n == len(v) and abs(r.fm - 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())) < 1e-3


def test_live_evaluator_equals_refits_from_nothing(spark, sf):
    """Every contest of three tournaments against a fit to all earlier days' results, one by one."""
    from datetime import datetime, timezone

    from skirmish.functions import exprs as X
    from skirmish.operators import ratings
    from skirmish.plans import catalogue
    from skirmish.plans.contest import Tables

    t = Tables(spark, sf)
    rows = t.forecast().join(t.contest().select("contest_id", "side0_team", "side1_team"), "contest_id").toPandas()
    rows["day"] = rows["ts"] // 86400
    rows["tournament"] = rows["group_id"] + "|" + rows["ts"].map(lambda x: datetime.fromtimestamp(x, timezone.utc).strftime("%Y-%m"))
    weight = spark.range(1).select(X.information(F.lit(1), F.lit(0)).alias("w")).first().w
    got = {r.contest_id: r for r in catalogue.queries()["live_evaluator"](spark, sf).collect()}
    assert got.keys() == set(rows["contest_id"])
    moved = 0
    for name in rows["tournament"].value_counts().index[:3]:
        mine = rows[rows["tournament"] == name]
        for day in sorted(mine["day"].unique()):
            upto, past = mine[mine["day"] <= day], mine[mine["day"] < day]
            base = {}
            for (d, a, b), g in upto.assign(a=upto[["side0_team", "side1_team"]].min(axis=1), b=upto[["side0_team", "side1_team"]].max(axis=1)).groupby(["day", "a", "b"]):
                base[a, b] = np.mean([p if x == a else 1 - p for p, x in zip(g["p"], g["side0_team"], strict=True)])
            pairs = pd.DataFrame([(a, b, p) for (a, b), p in base.items()], columns=["a", "b", "p"])
            played = pd.DataFrame({"a": past["side0_team"], "b": past["side1_team"], "won": past["y"].astype(float), "weight": weight})
            teams = np.unique(pairs[["a", "b"]])
            # Offsets from pairs with known odds: what a fit adds to an even pair of each two teams.
            fitted = ratings.update_live(pairs, played, 0.4).set_index(["a", "b"])["p"]
            for r in mine[mine["day"] == day].itertuples():
                a, b = sorted((r.side0_team, r.side1_team))
                gain = np.log(fitted[a, b] / (1 - fitted[a, b])) - ratings.clipped_logit(np.array([base[a, b]]))[0]
                z = ratings.clipped_logit(np.array([r.p]))[0] + (gain if r.side0_team == a else -gain)
                want = 1 / (1 + np.exp(-z)) if len(past) else r.p
                assert abs(got[r.contest_id].p_live - want) < 1e-5 and len(teams) > 1
                moved += abs(want - r.p) > 1e-3
    assert moved > 5


WINDOWED = ("prefix_rates", "decayed_prefix", "residual_synergy", "time_decayed_prefix", "asof_latest_forecast", "event_propensity", "running_scores", "running_standings", "side_prior", "decision_eval")


@pytest.mark.parametrize("name", WINDOWED)
def test_no_window_holds_all_rows_of_a_key(spark, sf, name):
    """Windows over contests are over a cell of time of a key; those along a key's cells have a row a cell, and those over versions a row a version."""
    import re

    from skirmish.plans import catalogue

    plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_cell#" in w or "since#" in w for w in re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", plan))


def test_as_of_over_cells(spark):
    """Against a loop, over cells of any width, with ties and keys without a right row."""
    from skirmish.operators.joins import as_of

    r = np.random.default_rng(3)
    left = [(int(i), f"k{r.integers(4)}", int(r.integers(300))) for i in range(120)]
    right = [(f"k{r.integers(3)}", int(r.integers(300)), int(j)) for j in range(90)]
    for cell in (7, 1000):
        for strict in (False, True):
            got = as_of(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, u int, v int"), ["k"], "t", "u", ["v"], tie="v", strict=strict, cell=cell).collect()
            for g in got:
                past = [(u, v) for k, u, v in right if k == g.k and (u < g.t or (u == g.t and not strict))]
                assert g.v == (max(past)[1] if past else None)
            assert len(got) == len(left)
