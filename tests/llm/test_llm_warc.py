"""Archives written and read back."""

import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from skirmish.llm import queries, warc

PAGES = "page_id long, url string, html string, digest string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "p") for r in rows], PAGES)


def test_query_equals_sql(spark, sf):
    got = queries.op6_warc(spark, sf)
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = duck.execute(queries.OP6_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(repr, got.select(*names).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None))) == sorted(map(repr, want.fetchdf().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)))


def test_payloads_round_trip_and_files_are_deterministic(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    first = warc.write(table, f"file://{tmp_path}/a", roll_bytes=4000, shard_bytes=20_000)
    again = warc.write(table.orderBy("html"), f"file://{tmp_path}/b", roll_bytes=4000, shard_bytes=20_000)
    assert sorted(first.collect()) == sorted(again.collect()) and first.count() > 3
    for m in first.collect():
        assert hashlib.sha256(Path(tmp_path, "a", m.file).read_bytes()).hexdigest() == m.sha256
    want = {r.page_id: (r.html or "").encode() for r in table.collect()}
    got = warc.read(spark, f"file://{tmp_path}/a", first).collect()
    payload = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert {r.page_id: payload[r.page_id if r.refers_to is None else r.refers_to] for r in got} == want
    assert len(got) == len(want) and not list(Path(tmp_path, "a").glob(".*.tmp"))


def test_files_depend_on_the_rows_alone(spark, tmp_path):
    """100,000 rows in two partitionings, cut by other range samples, give equal files."""
    rows = spark.range(100_000).selectExpr("id * 7 % 100003 as page_id", "concat('http://x/', id) as url", "repeat(substr(sha2(string(id % 60000), 256), 1, 20), int(1 + id % 60000 % 11)) as html")
    one = warc.write(rows.repartition(3), f"file://{tmp_path}/a", roll_bytes=200_000, shard_bytes=1_000_000)
    two = warc.write(rows.repartition(11, "url"), f"file://{tmp_path}/b", roll_bytes=200_000, shard_bytes=1_000_000)
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() > 20
    assert {p.name for p in Path(tmp_path, "a").glob("*.gz")} == {r.file for r in one.collect()}
    first = [r.first_page for r in sorted(one.collect())]
    assert first == sorted(first)
    got = warc.read(spark, f"file://{tmp_path}/b", two, payloads=False)
    assert got.count() == 100_000 and got.filter("record_type = 'revisit'").count() > 10_000


def test_splitters_cut_by_bytes(spark):
    rows = spark.createDataFrame([(i if i % 9 else None, f"{i:064d}", 100) for i in range(-50, 50)], "page_id long, digest string, bytes long")
    cuts = warc.splitters(rows, 1000)
    assert cuts == warc.splitters(rows.repartition(7), 1000) and len(cuts) == 9 and cuts == sorted(cuts)
    assert warc.splitters(rows, 10_000) == [] == warc.splitters(rows.limit(0), 10)


def test_only_files_of_the_manifest_count(spark, tmp_path):
    manifest = warc.write(pages(spark, [(1, "u", "a" * 300)]), f"file://{tmp_path}/w")
    Path(tmp_path, "w", "part-000009-00000.warc.gz").write_bytes(b"left by a lost attempt")
    assert warc.read(spark, f"file://{tmp_path}/w", manifest).count() == 1


def test_edges(spark, tmp_path):
    same, short = "ä" * 50, "s" * 99
    rows = [(5, "u", same), (3, None, same), (4, "http://x/ y\r\nz", same), (1, "u", short), (2, "u", short), (7, "u", None), (8, "u", ""), (None, None, "n"), (9, "u", "x" * 1_000_000), (9, "u", "x" * 1_000_000), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]
    got = warc.read(spark, f"file://{tmp_path}/w", warc.write(pages(spark, rows), f"file://{tmp_path}/w", roll_bytes=500)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append((r.record_type, r.refers_to, r.payload_bytes))
    assert by[3] == [("response", None, 100)] and by[4] == by[5] == [("revisit", 3, 100)]
    assert by[1] == by[2] == [("response", None, 99)] and by[7] == by[8] == [("response", None, 0)] and by[None] == [("response", None, 1)]
    assert by[9] == [("response", None, 1_000_000)] * 2 and len(got) == len(rows)
    assert next(r.url for r in got if r.page_id == 4) == "http://x/%20y%0D%0Az"
    empty = warc.write(pages(spark, []), f"file://{tmp_path}/e")
    assert empty.count() == 0 and warc.read(spark, f"file://{tmp_path}/e", empty).count() == 0


def test_members_of_any_length():
    parts = [b"a" * 10, b"", bytes(range(256)) * 400, b"z"]
    data = b"".join(gzip.compress(p) for p in parts)
    for step in (1, 7, 1 << 14):
        assert list(warc.members(data, step)) == parts
    with pytest.raises(ValueError):
        list(warc.members(data[:-3]))


def test_a_record_is_a_gzip_member_with_headers():
    digest = hashlib.sha256(b"abc").hexdigest()
    text = gzip.decompress(warc.page_record(1, "http://x/", b"abc", digest, None))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\nabc\r\n\r\n")
    row = warc.parse(text)
    assert (row["page_id"], row["payload"], row["payload_digest"]) == (1, b"abc", digest)
