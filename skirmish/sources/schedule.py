"""Schedules read from web pages: items with both sides, time, date, round, stage and whether they are live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The page's marks and its words for today, tomorrow, live and the stages.
TAB = r'class="[^"]*tab_[^"]*isActive_[^"]*"[^>]*>\s*<span>([^<]*)</span>'
ITEM, DATE, PARTICIPANT, HEADING = r'<div class="[^"]*item_[^"]*"', r'(?is)<div[^>]*class="[^"]*date_[^"]*"[^>]*>(.*?)</div>', r'(?i)<img[^>]+alt="([^"]+)"[^>]*>', r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"
EXPLICIT, DAY = r"(\d{2})\.(\d{2})\.(\d{2})\s+в\s+(\d{2}):(\d{2})", r"(\d{2})\.(\d{2})\.(\d{2})"
RELATIVE = r"(?iu)(сегодня|завтра)\s+в\s+(\d{2}):(\d{2})"
TODAY, TOMORROW, LIVE = r"(?iu)^сегодня(?![\p{L}])", r"(?iu)^завтра(?![\p{L}])", r"(?i)\bLIVE\b"
STAGES = (("playin", r"(?u)elimination\s+round|стыки|play[\s-]?in"), ("playoff", r"(?u)playoff|плей-офф"), ("swiss", r"(?u)group|групп|swiss|раунд\s*[1-5]\b"))


def decoded(html: Column) -> Column:
    """Text of a piece of HTML: the entities that pages use, then without tags and blanks around it."""
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


@F.pandas_udf(StringType())
def name_key(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A name's key: decomposed by NFKD, ASCII letters and digits alone, in capitals. Spark has no function for the former."""
    for s in names:
        yield s.str.normalize("NFKD").str.replace("[^A-Za-z0-9]", "", regex=True).str.upper()


def stage_of(text: Column) -> Column:
    clean = F.lower(F.regexp_replace(text, r"\s+", " "))
    out = F.when(clean.rlike(STAGES[0][1]), STAGES[0][0])
    for name, words in STAGES[1:]:
        out = out.when(clean.rlike(words), name)
    return out


def _date(text: Column, pattern: str) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.try_to_timestamp(F.concat(F.lit("20"), part(3), part(2), part(1)), F.lit("yyyyMMdd")).cast("date")


def schedule(pages: DataFrame, names: DataFrame, now: int, offset_minutes: int = 180, playoff_start: str = "2026-08-20") -> DataFrame:
    """page_id, item, team_a, team_b, round, scheduled_at (epoch seconds), scheduled_date, stage, live for each item of each page.

    pages: page_id, html. names: key (see name_key), team. A page is cut at its items; what stands before the first item, and the
    headings between items, hold for the items that follow: a stage or a date that an item lacks is that of the last heading, a stage
    else that of the active tab. Items without two different known sides are left out, and so are later ones of a pair on its
    page. Times are local to offset_minutes; today and tomorrow are counted from `now`. In a playoff the round is the day since its
    start. Null, empty and other pages have no items; a page is one row's work, pages are spread.
    """
    whole = pages.filter((F.length("html") > 0) & F.col("page_id").isNotNull()).select("page_id", "html")
    tabs = F.regexp_extract_all("html", F.lit("(?is)" + TAB), F.lit(1))
    tab = F.coalesce(decoded(F.try_element_at(tabs, F.lit(-1))), F.lit(""))
    first = F.regexp_extract("tab", r"\d+", 0)
    # What a page says once is read before its items become rows, or it would be read again for each of them. Outer generators add no
    # filters that cut the page once more.
    cut = whole.select("page_id", tab.alias("tab"), F.split("html", f"(?i)(?={ITEM})").alias("chunks"))
    cut = cut.select("page_id", stage_of(F.col("tab")).alias("tab_stage"), F.when(first != "", first.try_cast("int")).otherwise(1).alias("first"), "chunks")
    parts = cut.select("page_id", "tab_stage", "first", F.posexplode_outer("chunks").alias("item", "chunk"))
    # An item's own text ends where the next heading begins; that heading is for the items behind it.
    heads = F.transform(F.regexp_extract_all("chunk", F.lit(HEADING), F.lit(1)), decoded)
    parts = parts.withColumn("heads", heads).withColumn("own", F.regexp_replace("chunk", HEADING, " "))
    said = lambda f: F.try_element_at(F.filter(F.transform("heads", f), lambda x: x.isNotNull()), F.lit(-1))
    before = Window.partitionBy("page_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("head_stage", F.last(said(stage_of), ignorenulls=True).over(before)).withColumn("head_date", F.last(said(lambda h: _date(h, DAY)), ignorenulls=True).over(before))

    inner = F.regexp_extract("own", DATE, 1)
    text = F.trim(F.regexp_replace(decoded(F.when(F.col("own").rlike(DATE), inner).otherwise(F.col("own"))), r"\s+", " "))
    rows = carried.filter(F.col("item") > 0).withColumn("text", text)
    day = F.to_date(F.timestamp_seconds(F.lit(now + 60 * offset_minutes)))
    hours = lambda i, pattern: 3600 * F.regexp_extract("text", pattern, i).try_cast("int") + 60 * F.regexp_extract("text", pattern, i + 1).try_cast("int")
    seconds = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long") * 86400 - 60 * offset_minutes
    coming = F.when(F.lower(F.regexp_extract("text", RELATIVE, 1)) == "завтра", F.date_add(day, 1)).otherwise(day)
    at = F.when(F.col("text").rlike(EXPLICIT), seconds(_date(F.col("text"), EXPLICIT)) + hours(4, EXPLICIT)).when(F.col("text").rlike(RELATIVE), seconds(coming) + hours(2, RELATIVE))
    date = F.when(F.col("text").rlike(DAY), _date(F.col("text"), DAY)).when(F.col("text").rlike(TOMORROW), F.date_add(day, 1)).when(F.col("text").rlike(TODAY), day)
    live = F.col("text").rlike(LIVE)
    stage = F.coalesce(stage_of(decoded(F.col("own"))), F.col("head_stage"), F.col("tab_stage"))
    alts = F.regexp_extract_all("own", F.lit(PARTICIPANT), F.lit(1))
    rows = rows.select("page_id", "item", "first", at.alias("scheduled_at"), date.alias("date"), "head_date", stage.alias("stage"), live.alias("live"), alts.alias("alts"))
    rows = rows.select("page_id", "item", F.struct("first", "scheduled_at", F.coalesce("date", F.when(~F.col("live"), F.col("head_date"))).alias("scheduled_date"), "stage", "live").alias("said"), "alts")

    # Both sides: the first two different known names. A left join, since an inner one would have each name's key made twice.
    alt = rows.select("page_id", "item", "said", F.posexplode_outer("alts").alias("at", "alt")).withColumn("key", name_key(decoded(F.col("alt"))))
    known = alt.join(names.select("key", "team"), "key", "left").groupBy("page_id", "item")
    found = F.collect_list(F.when(F.col("team").isNotNull(), F.struct("at", "team")))
    rows = known.agg(F.first("said").alias("said"), F.transform(F.array_sort(found), lambda x: x["team"]).alias("teams")).withColumn("teams", F.array_distinct("teams")).filter(F.size("teams") > 1)
    rows = rows.select("page_id", "item", F.col("teams")[0].alias("team_a"), F.col("teams")[1].alias("team_b"), "said.*")
    days = F.datediff(F.coalesce("scheduled_date", F.when(F.col("live"), day)), F.lit(playoff_start).cast("date"))
    number = F.when((F.col("stage") == "playoff") & (days >= 0), days + 1).otherwise(F.col("first"))
    pair = Window.partitionBy("page_id", F.least("team_a", "team_b"), F.greatest("team_a", "team_b")).orderBy("item")
    return rows.withColumn("nth", F.row_number().over(pair)).filter("nth = 1").select("page_id", "item", "team_a", "team_b", number.cast("int").alias("round"), "scheduled_at", "scheduled_date", "stage", "live")
