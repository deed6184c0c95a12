"""What the plans of queries shuffle, and how often they read their tables."""

from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skirmish.operators import joins, windows
from skirmish.plans import catalogue, draft, stacking


def plan(spark, sf, name):
    return catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "scans"), [("draft_features", 4), ("active_inference", 4), ("layer_ablation", 4), ("signal_shares", 4), ("top_effects", 4), ("draft_rates", 2)])
def test_draft_reads_lines_once_a_level(spark, sf, name, scans):
    """Lines are read twice a level of sums (once for what stood when a day began), not once for each rate; equal shuffles are then made once."""
    got = plan(spark, sf, name)
    assert sum("FileScan" in x and "l_orderkey" in x for x in got.splitlines()) <= scans


def test_candidates_are_counted_before_rows_meet(spark, sf):
    """No window sorts (and no shuffle moves) the pairs of unique_candidate_link."""
    assert "Window" not in plan(spark, sf, "unique_candidate_link")


@pytest.mark.parametrize("seconds", [None, 1, 10, 86400])
def test_pairs_in_blocks(spark, monkeypatch, seconds):
    """One frequent key: every pair once, cut into blocks, with equal times, negative ones and nulls."""
    monkeypatch.setattr(joins, "BLOCK", 3)
    data = [(i, "a" if i % 5 else "b", (i * 7) % 31 - 9) for i in range(60)] + [(90, None, 3), (91, "a", None), (92, "c", 1)]
    rows = spark.createDataFrame(data, "id long, k string, t long")
    got = joins.pairs_among(rows, ["k"], "id", *(("t", seconds) if seconds else ())).collect()
    near = lambda s, t: not seconds or (s is not None and t is not None and abs(s - t) <= seconds)
    want = {(i, j, s, t) for i, k, s in data for j, m, t in data if k and k == m and i < j and near(s, t)}
    assert sorted((r.low, r.high) for r in got) == sorted(x[:2] for x in want)
    if seconds:
        assert {(r.low, r.high, r.low_ts, r.high_ts) for r in got} == want


@pytest.mark.parametrize("name", ["symmetric_pair_join", "interval_join"])
def test_pairs_are_made_behind_a_rebalancing_shuffle(spark, sf, name):
    """The join itself makes pairs of blocks; pairs of rows are made in tasks of equal bytes, not in a key's task."""
    assert "REBALANCE" in plan(spark, sf, name)


def test_combiner_streams_its_groups():
    """Batches that cut groups anywhere give what whole groups give."""
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"group_id": np.repeat(["a", "b"], [230, 170]), "contest_id": np.arange(400), "ts": np.arange(400) // 3, "y": rng.integers(0, 2, 400)} | {f: rng.normal(size=400) for f in draft.FEATURES})
    want = pd.concat([draft.learn_online(g) for _, g in rows.groupby("group_id")])
    got = pd.concat(draft.learn_along(rows[i : i + 37] for i in range(0, 400, 37)))
    assert got["contest_id"].tolist() == want["contest_id"].tolist()
    assert np.allclose(got["p"], want["p"], rtol=0, atol=1e-12)


def test_forest_has_few_tasks_for_few_rows(spark):
    """A small history is one task of each pass, however its rows are divided."""
    rows = spark.range(400).repartition(16).select(F.col("id").alias("contest_id"), F.col("id").alias("ts"), (F.col("id") % 2).cast("int").alias("y"), *[((F.col("id") * (k + 3)) % 17 / 17.0).alias(f) for k, f in enumerate(draft.FEATURES)])
    spark.sparkContext.setJobGroup("forest", "forest")
    stacking.symmetric_forecasts(rows.persist(), 300)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("forest") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert tasks and sorted(tasks)[len(tasks) // 2] <= 2


@pytest.mark.parametrize("name", ["patch_transfer", "temporal_draft", "transfer_ensemble", "transition_ensemble", "transition_scores"])
def test_forecasts_are_made_once(spark, sf, name):
    """The result reads the few sums made while the rows were kept; it doesn't walk the contests again."""
    assert "FileScan" not in plan(spark, sf, name)


@pytest.mark.parametrize(("name", "most"), [("draft_rates", 1), ("draft_features", 3)])
def test_picks_are_never_sorted(spark, sf, name, most):
    """Windows run along the cells of a key alone (the first level is planned twice for the second); a contest's picks and pairs are not rows that windows sort and spill."""
    lines = [x for x in plan(spark, sf, name).splitlines() if "Window [" in x]
    assert lines and len(lines) <= most and not any("before_" in x for x in lines)


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_sums_beside_units(spark, size):
    """Sums of earlier units by loops: keys that a unit has twice, null keys and cells, units without items, batches that cut cells anywhere."""
    rng = np.random.default_rng(3)
    units = [(None if i % 29 == 0 else int(i // 40), i, [(None if k == 4 else f"k{k}", int(v), float(v) / 8) for k, v in zip(rng.integers(0, 5, i % 4), rng.integers(0, 9, i % 4), strict=True)]) for i in range(200)]
    rows = spark.createDataFrame(units, "day int, id long, items array<struct<k string, v long, x double>>").select(F.struct(F.col("day").alias("ts"), "id").alias("u"), "items", (F.col("id") * 2).alias("twice"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {r.u.id: r for r in windows.earlier_beside(rows, F.col("items"), ["k"], ["v", "x"], "u", "u.ts", ["twice"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(units)
    before = {}
    for _, i, items in sorted(units, key=lambda r: (-1 if r[0] is None else r[0], r[1])):
        assert got[i].twice == 2 * i and got[i].before_v == [before.get(k, (0, 0))[0] for k, _, _ in items]
        assert got[i].before_x == pytest.approx([before.get(k, (0, 0))[1] for k, _, _ in items])
        for k, v, x in items:
            a, b = before.get(k, (0, 0))
            before[k] = (a + v, b + x)


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_sums_of_made_items(spark, monkeypatch, size):
    """The same with items that a function makes of batches of units: null cells and keys, a key twice in a unit, cells in batches."""
    rng = np.random.default_rng(4)
    units = [(None if i % 29 == 0 else int(i // 40), i, [(None if k == 4 else f"k{k}", int(v), float(v) / 8) for k, v in zip(rng.integers(0, 5, i % 4), rng.integers(0, 9, i % 4), strict=True)]) for i in range(200)]
    rows = spark.createDataFrame(units, "day int, id long, items array<struct<k string, v long, x double>>").select(F.struct(F.col("day").alias("ts"), "id").alias("u"), "items", (F.col("id") * 2).alias("twice"))
    whole, summed = windows.cell_in_order, windows.cell_sums
    monkeypatch.setattr(windows, "cell_in_order", lambda *a: whole(*a, rows=size))
    monkeypatch.setattr(windows, "cell_sums", lambda *a: summed(*a, rows=size))
    schema = "_cell long, u struct<ts int, id long>, twice long, before_v array<long>, before_x array<double>"
    got = {r.u.id: r for r in windows.earlier_of(rows, lambda b: b.column("items"), "k string, v long, x double", ["k"], ["v", "x"], "u", "cast(u.ts as long)", ["twice"], (lambda b: b, schema)).collect()}
    assert len(got) == len(units)
    before = {}
    for _, i, items in sorted(units, key=lambda r: (-1 if r[0] is None else r[0], r[1])):
        assert got[i].twice == 2 * i and got[i].before_v == [before.get(k, (0, 0))[0] for k, _, _ in items]
        assert got[i].before_x == pytest.approx([before.get(k, (0, 0))[1] for k, _, _ in items])
        for k, v, x in items:
            a, b = before.get(k, (0, 0))
            before[k] = (a + v, b + x)


def test_contests_are_shuffled_once_by_day(spark, sf):
    """The sums of days and the sums within them read one shuffle of the contests."""
    df = catalogue.queries()["draft_rates"](spark, sf)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert any("ReusedExchange" in x and "_cell" in x for x in final.splitlines())


def test_sets_are_summed_in_place(spark, sf):
    """The entities of a side are bits that codegen's sums hold in place: no aggregate of objects, which sorts all lines, and no rows of picks exploded from them."""
    got = plan(spark, sf, "draft_rates")
    assert "bit_or" in got and "ObjectHashAggregate" not in got and "collect_set" not in got and "Generate" not in got
    orders = [x for x in got.splitlines() if "FileScan" in x and "o_orderkey" in x]
    assert len({x.split("FileScan")[1].split("[")[1].split("]")[0].count(",") for x in orders}) == 1  # the same columns, so shuffled once


@pytest.mark.parametrize(("change", "size"), [("p_size", 13), ("p_size + 13", 10_000), ("p_size + 30", 10_000), ("p_size * 3 - 20", 13)])
def test_rates_of_any_entities(spark, sf, tmp_path, change, size):
    """Entities beyond the bits of a long have the same rates, whole; batches cut cells anywhere."""
    for f in Path(sf).iterdir():
        (tmp_path / f.name).symlink_to(f)
    (tmp_path / "part.parquet").unlink()
    spark.read.parquet(f"{sf}/part.parquet").withColumn("p_size", F.expr(change).cast("int")).write.parquet(str(tmp_path / "part.parquet"))
    want = [(r[0], r[1], eval(change, {"p_size": r[2]}), *r[3:]) for r in catalogue.queries()["draft_rates"](spark, sf).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = [tuple(r) for r in catalogue.queries()["draft_rates"](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) > 1000 and sorted(got) == sorted(want)


@pytest.mark.parametrize("rows", [1, 90, 1000])
def test_sums_of_cells(rows):
    """Partial sums of cells add up, however many batches they take together: null cells, keys as dictionaries and nulls among them."""
    rng = np.random.default_rng(5)
    units = pa.RecordBatch.from_pydict({"_cell": pa.array([None if i % 9 == 0 else int(i % 3) for i in range(400)]), "n": pa.array(rng.integers(0, 4, 400))})

    def items(batch):
        n = batch.column("n").to_numpy()
        names = pa.array(np.arange(n.sum()) % 3, pa.int32())
        columns = [pa.DictionaryArray.from_arrays(names, pa.array(["a", "b", None])), pa.array(np.arange(n.sum()) + 1), pa.array(np.arange(n.sum()) / 4)]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.StructArray.from_arrays(columns, ["k", "v", "x"]))

    batches = [units.slice(i, 40) for i in range(0, 400, 40)]
    got, want = {}, {}
    for b in windows.cell_sums(lambda b: items(b), ["k"], ["v", "x"], rows)(iter(batches)):
        for r in b.to_pylist():
            s = got.get((r["_cell"], r["k"]), (0, 0))
            got[r["_cell"], r["k"]] = (s[0] + r["v"], s[1] + r["x"])
    for lot in ([units] if rows == 1000 else [units.slice(i, 40 * -(-rows // 40)) for i in range(0, 400, 40 * -(-rows // 40))]):
        for c, found in zip(lot.column("_cell").to_pylist(), items(lot).to_pylist(), strict=True):
            for i in found:
                s = want.get((c, i["k"]), (0, 0))
                want[c, i["k"]] = (s[0] + i["v"], s[1] + i["x"])
    assert got == want


def test_pages_are_read_once(spark, sf):
    """Each page is cut once, what it says once is not read again for each item, and names' keys are made once."""
    lines = plan(spark, sf, "schedule_items").split("+- == Initial Plan ==")[-1].splitlines()
    assert sum("l_orderkey" in x and "FileScan" in x for x in lines) == 1
    assert sum("ArrowEvalPython" in x for x in lines) == 1 and sum("Generate posexplode" in x for x in lines) == 2
    behind = lines[: max(i for i, x in enumerate(lines) if "Generate posexplode" in x)]
    assert not any("isActive" in x for x in behind)


@pytest.mark.parametrize("name", ["symmetric_pair_join", "interval_join"])
def test_blocks_are_made_once(spark, sf, name):
    """Both sides of the join of blocks read one shuffle of them, and no two blocks make more rows than generated code should hold."""
    df = catalogue.queries()[name](spark, sf)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("Window [" in x for x in final.splitlines()) == 1 and joins.BLOCK**2 <= 2**14


def test_rematches_come_in_order(spark, sf):
    """Blocks in the units' order make pairs with the lower one first: nothing is turned pair by pair. The rebalancing shuffle sorts no blocks, as a round robin does."""
    got = plan(spark, sf, "symmetric_pair_join")
    assert "REBALANCE_PARTITIONS_BY_COL" in got and "least(low" not in got and "least(_a" not in got


@pytest.mark.parametrize("seconds", [None, 10])
def test_pairs_of_keys_with_one_hash(spark, monkeypatch, seconds):
    """All keys share one hash, units come twice (also across blocks): each pair as often as rows make it, none of a unit with itself."""
    monkeypatch.setattr(joins, "BLOCK", 3)
    monkeypatch.setattr(joins.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    data = [(i // 2, "abc"[i % 3], (i * 7) % 31 - 9) for i in range(60)] + [(None, "a", 3), (70, None, 3)]
    rows = spark.createDataFrame(data, "id long, k string, t long")
    got = joins.pairs_among(rows, ["k"], "id", *(("t", seconds) if seconds else ())).collect()
    want = [(i, j) for i, k, s in data for j, m, t in data if None not in (i, j, k) and k == m and i < j and (not seconds or abs(s - t) <= seconds)]
    assert sorted((r.low, r.high) for r in got) == sorted(want)
