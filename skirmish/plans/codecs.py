"""Hashes, stable JSON, signatures and patterns: values that are written in one place and read in another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions import exprs as X
from skirmish.plans.contest import CONTEST, FORECAST, LIVE, TEAMS, Tables, with_
from skirmish.plans.registry import query

# The multiplier of the 32-bit FNV hash and the two starts that make a double hash.
FNV_PRIME, STARTS = 16777619, (2166136261, 2538058380)


def fnv32(text: Column, start: int) -> Column:
    """The 32-bit FNV-1a hash of a text's characters, from a start."""
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME, F.lit(1 << 32))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(start).cast("long"), step)


_FNV = "list_reduce(list_concat([{0}::BIGINT], list_transform(list_filter(string_split(url, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


@query(f"SELECT page_id, sha1(url) AS sha1, lpad(lower(to_hex({_FNV.format(STARTS[0])})), 8, '0') || lpad(lower(to_hex({_FNV.format(STARTS[1])})), 8, '0') AS double_hash FROM pages")
def url_hashes(t: Tables) -> DataFrame:
    """SHA-1 and a double 32-bit hash of each page's address."""
    part = lambda s: F.lpad(F.lower(F.hex(fnv32(F.col("url"), s))), 8, "0")
    return t.pages.select("page_id", F.sha1(F.col("url").cast("binary")).alias("sha1"), F.concat(*map(part, STARTS)).alias("double_hash"))


def stable_json(entries: Column) -> Column:
    """A map of texts as JSON with its keys in order, so that equal maps are equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))), {"ignoreNullFields": "false"})


@query(with_(LIVE, body="SELECT event_id, j AS json, sha256(j) AS digest FROM (SELECT event_id, json_object('k', k::VARCHAR, 'lead', round(lead)::BIGINT::VARCHAR, 'match', match_id::VARCHAR, 'phase', phase)::VARCHAR AS j FROM live)"))
def stable_events(t: Tables) -> DataFrame:
    """Each event as stable JSON, and the digest by which equal ones are told."""
    text = lambda c: F.col(c).cast("string")
    entries = F.create_map(F.lit("phase"), F.col("phase"), F.lit("match"), text("match_id"), F.lit("lead"), F.round("lead").cast("long").cast("string"), F.lit("k"), text("k"))
    return t.live().select("event_id", stable_json(entries).alias("json")).select("event_id", "json", F.sha2(F.col("json").cast("binary"), 256).alias("digest"))


PHASES = ("click", "login", "purchase", "signup", "view")


def signature(counts: list[Column]) -> Column:
    """A hex digit for each count, 15 and more as f."""
    return F.concat(*[F.lower(F.hex(F.least(c, F.lit(15)).cast("long"))) for c in counts])


def decoded(sig: Column, k: int) -> Column:
    """The counts that a signature of k digits holds."""
    return F.array(*[F.conv(F.substring(sig, i + 1, 1), 16, 10).cast("long") for i in range(k)])


@query(with_(LIVE, body="SELECT signature, count(*) AS matches, sum(events)::BIGINT AS events, any_value(total)::BIGINT AS total FROM (SELECT match_id, count(*) AS events, "
  + " || ".join(f"lower(to_hex(least(15, count(*) FILTER (WHERE phase = '{p}'))))" for p in PHASES) + " AS signature, " + " + ".join(f"least(15, count(*) FILTER (WHERE phase = '{p}'))" for p in PHASES) + " AS total FROM live GROUP BY match_id) GROUP BY signature"))
def match_signatures(t: Tables) -> DataFrame:
    """Matches by the signature of their events' kinds, and the events that the signature itself says."""
    per = t.live().groupBy("match_id").agg(F.count("*").alias("events"), signature([F.count_if(F.col("phase") == p) for p in PHASES]).alias("signature"))
    got = per.groupBy("signature").agg(F.count("*").alias("matches"), F.sum("events").alias("events"))
    return got.withColumn("total", F.aggregate(decoded(F.col("signature"), len(PHASES)), F.lit(0).cast("long"), lambda a, b: a + b))


_WRITTEN = "strftime(o_orderdate, '%d.%m.%Y %H:%M ') || CASE o_orderkey % 3 WHEN 0 THEN '+03:00' WHEN 1 THEN '-05:30' ELSE '+00:00' END || ' score ' || (o_orderkey % 4)::VARCHAR || ':' || (o_orderkey % 3)::VARCHAR"
_PART = r"regexp_extract(x, '(\d{{2}})\.(\d{{2}})\.(\d{{4}}) (\d{{2}}):(\d{{2}}) ([+-])(\d{{2}}):(\d{{2}})', {0})"


@query(f"""SELECT contest_id, epoch(make_timestamp({_PART.format(3)}::BIGINT, {_PART.format(2)}::BIGINT, {_PART.format(1)}::BIGINT, {_PART.format(4)}::BIGINT, {_PART.format(5)}::BIGINT, 0))::BIGINT - away * 60 AS at, away AS offset_minutes,
  floor((epoch(make_timestamp({_PART.format(3)}::BIGINT, {_PART.format(2)}::BIGINT, {_PART.format(1)}::BIGINT, {_PART.format(4)}::BIGINT, {_PART.format(5)}::BIGINT, 0))::BIGINT - away * 60) / 86400.0)::BIGINT AS day,
  regexp_extract(x, 'score (\\d+):(\\d+)', 1)::INTEGER AS a, regexp_extract(x, 'score (\\d+):(\\d+)', 2)::INTEGER AS b FROM (
    SELECT contest_id, x, ({_PART.format(7)}::INTEGER * 60 + {_PART.format(8)}::INTEGER) * CASE {_PART.format(6)} WHEN '-' THEN -1 ELSE 1 END AS away FROM (SELECT o_orderkey AS contest_id, {_WRITTEN} AS x FROM orders))""")
def written_results(t: Tables) -> DataFrame:
    """Times with offsets and scores read back from the text in which they were written: seconds, day, offset and both scores."""
    k = F.col("o_orderkey")
    away = F.when(k % 3 == 0, "+03:00").when(k % 3 == 1, "-05:30").otherwise("+00:00")
    text = F.concat(F.date_format("o_orderdate", "dd.MM.yyyy HH:mm "), away, F.lit(" score "), (k % 4).cast("string"), F.lit(":"), (k % 3).cast("string"))
    pattern, score = r"(\d{2})\.(\d{2})\.(\d{4}) (\d{2}):(\d{2}) ([+-])(\d{2}):(\d{2})", r"score (\d+):(\d+)"
    part = lambda i: F.regexp_extract("x", pattern, i)
    minutes = (part(7).cast("int") * 60 + part(8).cast("int")) * F.when(part(6) == "-", -1).otherwise(1)
    days = F.datediff(F.to_date(F.concat(part(3), part(2), part(1)), "yyyyMMdd"), F.lit("1970-01-01").cast("date")).cast("long")
    at = days * 86400 + part(4).cast("int") * 3600 + part(5).cast("int") * 60 - minutes * 60
    rows = t.orders.select(k.alias("contest_id"), text.alias("x"))
    return rows.select("contest_id", at.alias("at"), minutes.alias("offset_minutes"), F.floor(at / 86400).alias("day"), F.regexp_extract("x", score, 1).cast("int").alias("a"), F.regexp_extract("x", score, 2).cast("int").alias("b"))


def _five_sql(a: int, b: int) -> str:
    """Probability of a final score of a best of five."""
    ways = {(3, 0): 1, (3, 1): 3, (3, 2): 6, (2, 3): 6, (1, 3): 3, (0, 3): 1}[a, b]
    return f"round({ways} * pow(q, {a}) * pow(1 - q, {b}), 6) AS s{a}{b}"


SCORES = ((3, 0), (3, 1), (3, 2), (2, 3), (1, 3), (0, 3))


@query(with_(CONTEST, TEAMS, FORECAST, body="SELECT contest_id, " + ", ".join(_five_sql(a, b) for a, b in SCORES) + ", round(0.6 + 0.4 * q, 6) AS from_21 FROM (SELECT contest_id, p AS q FROM forecast)"))
def exact_scores_five(t: Tables) -> DataFrame:
    """Final scores of a best of five, and the chance to win it from 2:1 with 0.6 for the current map."""
    p = F.col("p")
    ahead = X.score_probability(3, 3, 1, F.lit(0.6), p, 2, 1) + X.score_probability(3, 3, 2, F.lit(0.6), p, 2, 1)
    return t.forecast().select("contest_id", *[F.round(X.score_probability(3, a, b, p, p), 6).alias(f"s{a}{b}") for a, b in SCORES], F.round(ahead, 6).alias("from_21"))
