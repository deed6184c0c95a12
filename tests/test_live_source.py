"""The landing folder as a source, and the ledger of locks as a sink, over restarts and batches that run again."""

import json

from skirmish.sources import landing, sinks

SCHEMA = "match_id long, lead double, phase string"


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    (folder / f".{name}").rename(folder / name)


def test_landing_neither_loses_nor_repeats_rows(spark, tmp_path):
    landing.register(spark)
    folder, out = tmp_path / "in", tmp_path / "out"
    land(folder, "001.jsonl", [{"match_id": 1, "lead": 5, "phase": "draft"}, "broken {", {"match_id": 2, "lead": "x", "extra": 1}])
    land(folder, "002.jsonl", [{"match_id": 3, "phase": True}])

    def run():
        """All that has landed goes through, and the query stops."""
        stream = spark.readStream.format("landing").schema(SCHEMA).load(f"file://{folder}")
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(map(tuple, spark.read.parquet(str(out)).collect()))

    first = [(1, 5.0, "draft"), (2, None, None), (3, None, None)]
    assert run() == first and run() == first
    land(folder, "003.jsonl", [{"match_id": 4, "lead": 1.5, "phase": "game"}])
    assert run() == [*first, (4, 1.5, "game")]
    assert run() == [*first, (4, 1.5, "game")]
    whole = spark.read.format("landing").schema(SCHEMA).load(f"file://{folder}")
    assert sorted(map(tuple, whole.collect())) == [*first, (4, 1.5, "game")]


def test_locks_never_change(spark, tmp_path):
    path = str(tmp_path / "ledger")
    write = sinks.lock_ledger(path, "match_id", "locked_at", "starts_at")
    frame = lambda rows: spark.createDataFrame(rows, "match_id long, p double, locked_at long, starts_at long")
    read = lambda name: sorted((r.batch_id, r.match_id, r.p, *([r.reason] if name == "refused" else [])) for r in spark.read.parquet(f"{path}/{name}").collect())
    batches = [
        [(1, 0.6, 10, 100), (1, 0.7, 12, 100), (2, 0.5, 100, 100), (3, 0.4, 99, 100)],
        [(1, 0.9, 5, 100), (2, 0.55, 50, 100), (4, 0.1, 7, None)],
        [],
    ]
    for n, rows in enumerate(batches):
        write(frame(rows), n)
    accepted = [(0, 1, 0.6), (0, 3, 0.4), (1, 2, 0.55)]
    refused = sorted([(0, 1, 0.7, "locked"), (0, 2, 0.5, "late"), (1, 1, 0.9, "locked"), (1, 4, 0.1, "no_start")])
    assert read("locks") == accepted and read("refused") == refused
    for n in (1, 0, 1):  # batches that run again change nothing
        write(frame(batches[n]), n)
    assert read("locks") == accepted and read("refused") == refused
    assert sinks.locks(spark, path).count() == 3


def test_ledger_of_a_stream_that_restarts(spark, tmp_path):
    path, folder = str(tmp_path / "ledger"), tmp_path / "in"

    def run(rows):
        spark.createDataFrame(rows, "match_id long, p double, locked_at long, starts_at long").write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("match_id long, p double, locked_at long, starts_at long").parquet(str(folder))
        write = sinks.lock_ledger(path, "match_id", "locked_at", "starts_at")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return {r.match_id: r.p for r in sinks.locks(spark, path).collect()}

    assert run([(1, 0.6, 10, 100)]) == {1: 0.6}
    assert run([(1, 0.1, 11, 100), (2, 0.2, 5, 6)]) == {1: 0.6, 2: 0.2}
