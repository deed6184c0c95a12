"""The driver's tables seen as contests: sides, participants, ordered events, forecasts. And the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions.exprs import epoch, logit, shrunk, sigmoid
from skirmish.operators.windows import earlier_in_cells


class Tables:
    """Parquet tables of one folder, and the contest views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _orders(self, lines: DataFrame, *more: str) -> DataFrame:
        """Contests of orders with a row in lines (contest_id, s_suppkey, and more columns to keep)."""
        home = self.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey"))
        away = self.supplier.select("s_suppkey", "s_nationkey")
        team = lambda c: F.concat(F.lit("t"), F.lpad(F.col(c).cast("string"), 2, "0"))
        rows = self.orders.join(home, "o_custkey").withColumnRenamed("o_orderkey", "contest_id").join(lines, "contest_id").join(away, "s_suppkey").filter("c_nationkey <> s_nationkey")
        return rows.select(
            "contest_id",
            epoch(F.col("o_orderdate")).alias("ts"),
            F.col("o_orderpriority").alias("group_id"),
            F.concat(F.year("o_orderdate").cast("string"), F.lit("q"), F.quarter("o_orderdate").cast("string")).alias("version"),
            F.year("o_orderdate").alias("family"),
            team("c_nationkey").alias("side0_team"),
            team("s_nationkey").alias("side1_team"),
            F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("side0_win"),
            F.col("o_totalprice").alias("total"),
            *more,
        )

    def contest(self) -> DataFrame:
        """One row an order between two different teams: the customer's nation and the nation of the order's first supplier."""
        return self._orders(self.lineitem.groupBy(F.col("l_orderkey").alias("contest_id")).agg(F.min("l_suppkey").alias("s_suppkey")))

    def drafts(self, packed: bool = False) -> DataFrame:
        """Finished contests with x0 and x1, the sorted entities of either side (see entities): one pass over the lines gives them and the first supplier.

        packed: the sets come as longs with a bit for each entity, which tasks sum in place; as arrays all the same if an entity is not in 0 to 63.
        """
        parts = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("entity"))
        first = F.coalesce(F.col("l_linestatus") == "F", F.lit(False))
        if packed and parts.filter("entity < 0 or entity > 63").isEmpty():
            of = lambda on: F.coalesce(F.bit_or(F.when(on, F.expr("shiftleft(1L, entity)"))), F.lit(0).cast("long"))
        else:
            of = lambda on: F.array_sort(F.collect_set(F.when(on, F.col("entity"))))
        lines = self.lineitem.join(parts, "l_partkey", "left").groupBy(F.col("l_orderkey").alias("contest_id")).agg(F.min("l_suppkey").alias("s_suppkey"), of(first).alias("x0"), of(~first).alias("x1"))
        return self._orders(lines, "x0", "x1").filter("side0_win is not null")

    def finished(self) -> DataFrame:
        return self.contest().filter("side0_win is not null")

    def entities(self) -> DataFrame:
        """contest_id, side, entity: the distinct sizes of an order's parts on either side."""
        parts = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("entity"))
        side = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
        return self.lineitem.select(F.col("l_orderkey").alias("contest_id"), side.alias("side"), "l_partkey").join(parts, "l_partkey").select("contest_id", "side", "entity").distinct()

    def appearances(self) -> DataFrame:
        """Entities of finished contests with the contest and whether their side won."""
        c = self.finished().select("contest_id", "ts", "version", "family", "side0_team", "side1_team", "side0_win")
        won = F.when(F.col("side") == 0, F.col("side0_win")).otherwise(1 - F.col("side0_win"))
        team = F.when(F.col("side") == 0, F.col("side0_team")).otherwise(F.col("side1_team"))
        return self.entities().join(c, "contest_id").select("contest_id", "side", "entity", "ts", "version", "family", team.alias("team"), won.alias("won"))

    def team_rows(self) -> DataFrame:
        """Two rows a finished contest: each team, its opponent, and whether it won."""
        sides = F.array(
            F.struct(F.lit(0).alias("side"), F.col("side0_team").alias("team"), F.col("side1_team").alias("opponent"), F.col("side0_win").alias("won")),
            F.struct(F.lit(1).alias("side"), F.col("side1_team").alias("team"), F.col("side0_team").alias("opponent"), (1 - F.col("side0_win")).alias("won")),
        )
        return self.finished().select("contest_id", "ts", "group_id", "version", "family", F.explode(sides).alias("s")).select("contest_id", "ts", "group_id", "version", "family", "s.*")

    def forecast(self, *more: str, source: DataFrame | None = None) -> DataFrame:
        """Leakage-free forecasts of finished contests: contest_id, ts, group_id, version, y, p, from both teams' earlier rates, and more columns of the contests. source: drafts, in place of finished."""
        contests = self.finished() if source is None else source
        units = contests.select(F.struct("ts", "contest_id", "group_id", "version").alias("u"), F.col("side0_win").alias("y"), "side0_team", "side1_team", *[m for m in more if m not in ("side0_team", "side1_team")])
        result = lambda s, won: F.struct(F.col(f"side{s}_team").alias("team"), F.lit(s).alias("side"), won.cast("long").alias("wins"), F.lit(1).cast("long").alias("games"))
        rows = earlier_in_cells(units, F.array(result(0, F.col("y")), result(1, 1 - F.col("y"))), ["team"], ["wins", "games"], "u", "floor(u.ts / 86400)")
        strength = logit(shrunk(F.col("before_wins"), F.col("before_games"), 0.5, 8.0), 0.001)
        both = rows.groupBy("_cell", "u", "y", *more).agg(F.sum(F.when(F.col("side") == 0, strength).otherwise(-strength)).alias("gap"))
        return both.select("u.*", "y", sigmoid(F.col("gap")).alias("p"), *more).select("contest_id", "ts", "group_id", "version", "y", "p", *more)

    def live(self) -> DataFrame:
        """events as telemetry: match (user), seconds, phase, lead, payload number."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select("event_id", F.col("user_id").alias("match_id"), epoch(F.col("ts")).alias("t"), F.col("event_type").alias("phase"), F.col("value").alias("lead"), k.alias("k"))


CONTEST = """contest AS (
  SELECT o_orderkey AS contest_id, floor(epoch(o_orderdate))::BIGINT AS ts, o_orderpriority AS group_id,
    year(o_orderdate)::VARCHAR || 'q' || quarter(o_orderdate)::VARCHAR AS version, year(o_orderdate)::INTEGER AS family,
    't' || lpad(c_nationkey::VARCHAR, 2, '0') AS side0_team, 't' || lpad(s_nationkey::VARCHAR, 2, '0') AS side1_team,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END::INTEGER AS side0_win, o_totalprice AS total
  FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY ALL) f ON f.l_orderkey = o_orderkey
    JOIN supplier ON s_suppkey = sk WHERE c_nationkey <> s_nationkey),
finished AS (SELECT * FROM contest WHERE side0_win IS NOT NULL)"""
ENTITIES = """entities AS (
  SELECT DISTINCT l_orderkey AS contest_id, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS side, p_size AS entity
  FROM lineitem JOIN part ON p_partkey = l_partkey),
appearances AS (
  SELECT e.contest_id, side, entity, ts, version, family, CASE side WHEN 0 THEN side0_team ELSE side1_team END AS team,
    CASE side WHEN 0 THEN side0_win ELSE 1 - side0_win END AS won
  FROM entities e JOIN finished f ON f.contest_id = e.contest_id)"""
TEAMS = """team_rows AS (
  SELECT contest_id, ts, group_id, version, family, 0 AS side, side0_team AS team, side1_team AS opponent, side0_win AS won FROM finished
  UNION ALL SELECT contest_id, ts, group_id, version, family, 1, side1_team, side0_team, 1 - side0_win FROM finished)"""
FORECAST = """rated AS (
  SELECT *, (coalesce(sum(won) OVER w, 0) + 4.0) / (count(won) OVER w + 8.0) AS r FROM team_rows
  WINDOW w AS (PARTITION BY team ORDER BY ts, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
forecast AS (
  SELECT a.contest_id, a.ts, a.group_id, a.version, a.won AS y, 1 / (1 + exp(-(ln(a.r / (1 - a.r)) - ln(b.r / (1 - b.r))))) AS p
  FROM rated a JOIN rated b ON a.contest_id = b.contest_id AND a.side = 0 AND b.side = 1)"""
LIVE = """live AS (
  SELECT event_id, user_id AS match_id, floor(epoch(ts))::BIGINT AS t, event_type AS phase, value AS lead, (props->>'$.k')::INTEGER AS k FROM events)"""


def with_(*views: str, body: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body
