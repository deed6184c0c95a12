"""Audits, manifests and assembly of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.operators.joins import first_reason, validity
from skirmish.operators.windows import latest
from skirmish.plans.contest import CONTEST, ENTITIES, TEAMS, Tables, with_
from skirmish.plans.registry import query


@query(with_(CONTEST, body="SELECT * FROM contest"))
def contest_base(t: Tables) -> DataFrame:
    return t.contest()


@query("""SELECT l_orderkey AS contest_id, count(*) AS n_rows, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_linenumber) AS numbers
  FROM lineitem GROUP BY ALL HAVING count(*) > 7 OR count(DISTINCT l_linenumber) <> count(*)""")
def integrity_audit(t: Tables) -> DataFrame:
    got = t.lineitem.groupBy(F.col("l_orderkey").alias("contest_id")).agg(F.count("*").alias("n_rows"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_linenumber").alias("numbers"))
    return got.filter("n_rows > 7 or numbers <> n_rows")


@query("""SELECT least(c_nationkey, s_nationkey) AS low, greatest(c_nationkey, s_nationkey) AS high, o_orderdate AS at, count(*) AS n,
    string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN supplier ON s_suppkey = l_suppkey
  GROUP BY ALL HAVING count(*) > 1""")
def duplicate_audit(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem.filter("l_linenumber = 1"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    keys = [F.least("c_nationkey", "s_nationkey").alias("low"), F.greatest("c_nationkey", "s_nationkey").alias("high"), F.col("o_orderdate").alias("at")]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), ids.alias("ids")).filter("n > 1")


@query(with_(CONTEST, body="""SELECT version, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(side0_win) AS finished,
  count(*) FILTER (WHERE group_id = '1-URGENT') AS urgent, round(avg(total), 4) AS mean_total FROM contest GROUP BY ALL"""))
def version_manifest(t: Tables) -> DataFrame:
    return t.contest().groupBy("version").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("side0_win").alias("finished"),
        F.count_if(F.col("group_id") == "1-URGENT").alias("urgent"), F.round(F.avg("total"), 4).alias("mean_total"),
    )


@query(with_(CONTEST, ENTITIES, body="""SELECT version, count(DISTINCT contest_id) AS contests, count(DISTINCT entity) AS entities,
  string_agg(DISTINCT team, ',' ORDER BY team) AS teams, max(upper_median) AS upper_median, round(max(share), 6) AS share FROM (
    SELECT a.*, m.upper_median, m.share FROM appearances a JOIN (
      SELECT version, list_sort(list(n))[(count(*) // 2) + 1] AS upper_median, avg((n >= 5)::INT) AS share FROM (
        SELECT version, entity, count(*) AS n FROM appearances GROUP BY ALL) GROUP BY ALL) m USING (version)) GROUP BY ALL"""))
def coverage_audit(t: Tables) -> DataFrame:
    rows = t.appearances()
    per_entity = rows.groupBy("version", "entity").agg(F.count("*").alias("n"))
    s = F.array_sort(F.collect_list("n"))
    spread = per_entity.groupBy("version").agg(F.get(s, F.floor(F.size(s) / 2).cast("int")).alias("upper_median"), F.round(F.avg((F.col("n") >= 5).cast("int")), 6).alias("share"))
    whole = rows.groupBy("version").agg(F.count_distinct("contest_id").alias("contests"), F.count_distinct("entity").alias("entities"), F.array_join(F.sort_array(F.collect_set("team")), ",").alias("teams"))
    return whole.join(spread, "version")


@query(with_(CONTEST, body="""SELECT version, first_ts, next_ts AS until, n, (first_ts = min(first_ts) OVER ()) OR (next_ts IS NULL) AS partial,
  (SELECT count(*) FROM contest c WHERE c.version = d.version AND (c.ts < d.first_ts OR c.ts >= d.next_ts))::INTEGER AS boundary_errors FROM (
  SELECT version, first_ts, n, lead(first_ts) OVER (ORDER BY first_ts) AS next_ts FROM (
    SELECT version, min(ts) AS first_ts, count(*) AS n FROM contest GROUP BY ALL)) d"""))
def version_timeline(t: Tables) -> DataFrame:
    """Each version's interval of validity, whether it is cut by the window, and rows outside of it."""
    rows = t.contest()
    dim = validity(rows.groupBy("version").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")), "first_ts")
    joined = rows.select("version", "ts").join(F.broadcast(dim), "version")  # a row a quarter
    wrong = F.count_if((F.col("ts") < F.col("first_ts")) | F.coalesce(F.col("ts") >= F.col("until"), F.lit(False)))
    first = F.min("first_ts").over(Window.partitionBy(F.lit(0)))
    return joined.groupBy("version", "first_ts", "until", "n").agg(wrong.cast("int").alias("boundary_errors")).withColumn("partial", (F.col("first_ts") == first) | F.col("until").isNull())


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY (CASE l_returnflag WHEN 'N' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1""")
def source_precedence_dedup(t: Tables) -> DataFrame:
    """One row a key: the best source wins, then the latest."""
    rank = F.when(F.col("l_returnflag") == "N", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    order = [rank.desc(), F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey"), F.desc("l_quantity")]
    return latest(t.lineitem, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(with_(CONTEST, body="""SELECT version, count(DISTINCT team) AS teams, count(*) AS slots FROM (
  SELECT version, side0_team AS team FROM contest UNION ALL SELECT version, side1_team FROM contest) GROUP BY ALL"""))
def union_distinct_sides(t: Tables) -> DataFrame:
    both = t.contest().select("version", F.explode(F.array("side0_team", "side1_team")).alias("team"))
    return both.groupBy("version").agg(F.count_distinct("team").alias("teams"), F.count("*").alias("slots"))


@query("""SELECT o_orderkey AS contest_id, round(((o_totalprice > 1000)::INT + (o_orderstatus IN ('F', 'O'))::INT + (o_orderpriority IS NOT NULL)::INT
    + (coalesce(n, 0) > 0)::INT + (coalesce(n, 0) <= 7)::INT + (coalesce(parts, 0) = coalesce(n, 0))::INT) / 6.0, 6) AS quality
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL) l ON l_orderkey = o_orderkey""")
def parse_quality(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"))
    rows = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").fillna(0, ["n", "parts"])
    checks = [F.col("o_totalprice") > 1000, F.col("o_orderstatus").isin("F", "O"), F.col("o_orderpriority").isNotNull(), F.col("n") > 0, F.col("n") <= 7, F.col("parts") == F.col("n")]
    total = sum((c.cast("int") for c in checks), F.lit(0))
    return rows.select(F.col("o_orderkey").alias("contest_id"), F.round(total / F.lit(6.0), 6).alias("quality"))


@query("""SELECT CASE WHEN n IS NULL THEN 'no_participants' WHEN o_orderstatus = 'P' THEN 'unfinished' WHEN n < 2 THEN 'too_few' WHEN parts < n THEN 'repeated_entity' ELSE 'accepted' END AS reason, count(*) AS n
  FROM (SELECT o_orderstatus, l.n, l.parts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL) l ON l_orderkey = o_orderkey) GROUP BY ALL""")
def reject_reasons(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k"), F.count_distinct("l_partkey").alias("parts"))
    rows = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    reason = first_reason([("no_participants", F.col("k").isNull()), ("unfinished", F.col("o_orderstatus") == "P"), ("too_few", F.col("k") < 2), ("repeated_entity", F.col("parts") < F.col("k"))])
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS contest_id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum((l_returnflag = 'N')::INT) = 3)")
def semi_full_draft(t: Tables) -> DataFrame:
    full = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("picks")).filter("picks = 3")
    return t.orders.join(full, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("o_orderkey").alias("contest_id"), F.col("o_orderstatus").alias("status"))


@query("SELECT o_orderkey AS contest_id, o_custkey AS owner FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
def anti_unlinked(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.col("o_orderkey").alias("contest_id"), F.col("o_custkey").alias("owner"))


@query("SELECT c_custkey AS owner, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_finished FROM customer")
def exists_flag(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has_finished", F.lit(True))
    return t.customer.select("c_custkey").join(done, "c_custkey", "left").select(F.col("c_custkey").alias("owner"), F.coalesce("has_finished", F.lit(False)).alias("has_finished"))


@query("SELECT o_orderkey AS contest_id FROM orders WHERE o_totalprice > 200000 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def except_missing(t: Tables) -> DataFrame:
    return t.orders.filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("contest_id")).subtract(t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey"))


@query("SELECT o_orderkey AS contest_id, o_totalprice AS total FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paging(t: Tables) -> DataFrame:
    first = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.orderBy(first, F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25).select(F.col("o_orderkey").alias("contest_id"), F.col("o_totalprice").alias("total"))


@query(with_(CONTEST, TEAMS, body="SELECT family, team, contest_id, ts FROM team_rows QUALIFY row_number() OVER (PARTITION BY family, team ORDER BY ts DESC, contest_id DESC) <= 3"))
def topk_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("family", "team").orderBy(F.desc("ts"), F.desc("contest_id"))
    return t.team_rows().withColumn("r", F.row_number().over(w)).filter("r <= 3").select("family", "team", "contest_id", "ts")


@query("SELECT doc_id, sha256(text) AS checksum, md5(coalesce(source, '')) AS source_id FROM documents")
def doc_checksum(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.md5(F.coalesce("source", F.lit("")).cast("binary")).alias("source_id"))


@query(r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]'))) AS with_digits,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), '(^|[^a-z])(the|der|les|los)([^a-z]|$)'))) AS with_article, len(string_split(text, chr(10))) AS n_lines FROM documents""")
def text_feature_counts(t: Tables) -> DataFrame:
    notes = F.split("text", "\n", -1)
    hits = lambda p, f=lambda x: x: F.size(F.filter(notes, lambda x: f(x).rlike(p))).cast("long")
    return t.documents.select("doc_id", hits("[0-9]").alias("with_digits"), hits("(^|[^a-z])(the|der|les|los)([^a-z]|$)", F.lower).alias("with_article"), F.size(notes).cast("long").alias("n_lines"))


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k, event_type || ':' || coalesce(props->>'$.k', '?') AS tag FROM events")
def json_props(t: Tables) -> DataFrame:
    p = F.from_json("props", "k int", {"mode": "PERMISSIVE"})
    return t.events.select("event_id", p["k"].alias("k"), F.concat("event_type", F.lit(":"), F.coalesce(p["k"].cast("string"), F.lit("?"))).alias("tag"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(html, '<html[^>]*lang="([a-z]*)"', 1) AS lang,
  len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links, coalesce(regexp_extract_all(html, '<a href="([^"]*)"', 1)[1], '') AS first_link FROM pages""")
def schedule_parse(t: Tables) -> DataFrame:
    """Fields cut out of raw pages by patterns: title, language, links."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return t.pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.regexp_extract("html", '<html[^>]*lang="([a-z]*)"', 1).alias("lang"),
        F.size(links).cast("long").alias("n_links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"),
    )


@query("""SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, sum(strlen(coalesce(text, ''))) :: BIGINT AS bytes
  FROM conversations GROUP BY ALL HAVING count(*) >= 2""")
def assemble_children(t: Tables) -> DataFrame:
    """Children nested under their parent in order; parents with too few are dropped."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    got = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(rows, lambda r: r["role"]), ">").alias("roles"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    return got.filter("turns >= 2")


@query("""WITH c AS (SELECT o_orderpriority AS g, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS s, o_orderkey FROM orders),
 gm AS (SELECT g, month, count(*) AS n FROM c GROUP BY ALL), gs AS (SELECT g, s, count(*) AS n FROM c GROUP BY ALL)
 SELECT o_orderkey AS contest_id, 1000 * ((gm.n < 40)::INT + (gs.n < 1000)::INT) - least(gm.n, gs.n) AS priority FROM c JOIN gm USING (g, month) JOIN gs USING (g, s)""")
def collection_priority(t: Tables) -> DataFrame:
    """What to collect next: 1000 for each stratum below its soft target, less the scarcest stratum's count."""
    c = t.orders.select(F.col("o_orderkey").alias("contest_id"), F.col("o_orderpriority").alias("g"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("s"))
    gm, gs = c.groupBy("g", "month").agg(F.count("*").alias("n1")), c.groupBy("g", "s").agg(F.count("*").alias("n2"))
    score = 1000 * ((F.col("n1") < 40).cast("int") + (F.col("n2") < 1000).cast("int")) - F.least("n1", "n2")
    return c.join(gm, ["g", "month"]).join(gs, ["g", "s"]).select("contest_id", score.alias("priority"))


@query("SELECT o_orderkey AS contest_id, o_totalprice AS total FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01' AND o_orderkey < 40000 ORDER BY o_orderkey DESC LIMIT 100")
def keyset_page(t: Tables) -> DataFrame:
    """One page of a keyset-paginated scan; the filters reach the Parquet reader."""
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    rows = t.orders.filter((F.col("o_orderdate") >= day("1997-01-01")) & (F.col("o_orderdate") < day("1998-01-01")) & (F.col("o_orderkey") < 40000))
    return rows.orderBy(F.desc("o_orderkey")).limit(100).select(F.col("o_orderkey").alias("contest_id"), F.col("o_totalprice").alias("total"))
