"""Audit of how sources differ: each source's terms that stand out in its language, and the divergence of every two sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.llm.common import Scratch

#: A language keeps the terms that at least so many of its documents have; shares are counted in units of 1 / SCALE.
LEAST_DOCS, SCALE = 3, 1_000_000_000
#: Bits of a value that one histogram ranks, and bytes of a tied item.
DIGIT_BITS, DIGIT_BYTES = 12, 2
#: A group is cut no further when so few rows are left in its last cell; they are sorted with those above.
FINISH = 256
#: Parts over which the rows of one group are spread when they meet what is known of the group.
SALTS = 16
#: Distinct (group, term) entries that a task gathers before it emits them.
GATHER = 300_000

GROUP = ["lang", "source"]
#: Bytes of a term: A-Z become a-z, other ASCII but letters separates, all bytes of characters beyond ASCII stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with the term), summed within tasks only."""
    schema = "lang string, source string, term binary, n long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), (total, having) in held.items():
                n = len(total)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64()), pa.array([having[t] for t in total], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        entries = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = text.as_py().translate(_TERM_BYTES).split()
                if not terms:
                    continue
                total, having = held.setdefault((lang, source), (Counter(), Counter()))
                entries -= len(total)
                total.update(terms)
                having.update(set(terms))
                entries += len(total)
                if entries > GATHER:
                    yield from emit()
                    entries = 0
        yield from emit()

    plain = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in GROUP], F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(run, schema).withColumn("term", F.col("term").cast("string"))


def kept_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, lang_n (occurrences in the language), lead (true in one row of each term of a language): terms kept, where they occur.

    One shuffle by language and term: sums by source, then the language's, over rows of one term.
    """
    summed = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    wide = summed.withColumn("lang_n", F.sum("n").over(term)).withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lead", F.min("source").over(term) == F.col("source"))
    return wide.filter(F.col("lang_docs") >= LEAST_DOCS).drop("docs", "lang_docs")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), lang_total, terms (kept terms of the language): a row for each group that occurs."""
    groups = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in GROUP]).distinct()
    sums = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.sum(F.col("lead").cast("long")).alias("leads"))
    filled = groups.join(sums, GROUP, "left").fillna(0, ["total", "leads"])
    langs = filled.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("leads").alias("terms"))
    return filled.join(langs, "lang").select(*GROUP, "total", "lang_total", "terms")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact at any count; null without kept terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.call_function("div", above, F.nullif((total + terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))) + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def with_groups(rows: DataFrame, groups: DataFrame, spread: str) -> DataFrame:
    """rows with the columns of their group. A group's rows are spread by `spread` over SALTS parts, to each of which its row in groups is sent."""
    salts = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salts, [*GROUP, "_salt"]).drop("_salt")


def divergences(rated: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum over all kept terms of excess(p of source, p of item).

    rated: lang, source, term, p, p0 (the share of a term that the group hasn't), for terms that the group has. A term
    that neither has adds the same for all terms: the baseline, times the number of terms. Terms of one group change
    that by a sum over its distinct shares, whatever the terms are; only terms that both have are met in a join, and
    correct what the two groups' own sums have said of them. Each unordered pair is met once, for both directions.
    """
    ends = totals.select(*GROUP, "terms", share(F.lit(0), F.col("total"), F.col("terms")).alias("p0"))
    other = ends.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    # The result has a row for each ordered pair of sources.
    pairs = ends.join(other, "lang").filter("source <> item")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    shares = rated.groupBy(*GROUP, "p").agg(F.count("*").alias("m"))
    met = shares.join(pairs, GROUP).groupBy(*GROUP, "item").agg(F.sum(F.col("m") * (excess(p, q0) - excess(p0, q0))).alias("there"), F.sum(F.col("m") * (excess(q0, p) - excess(q0, p0))).alias("back"))
    both = met.select(*GROUP, "item", F.col("there").alias("part")).unionAll(met.select("lang", "item", "source", "back"))

    a = rated.select("lang", "term", "source", "p", "p0")
    b = rated.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    q = F.col("q")
    shared = a.join(b, ["lang", "term"]).filter("source < item")
    fixes = shared.groupBy(*GROUP, "item").agg(
        F.sum(excess(p, q) - excess(p, q0) - excess(p0, q) + excess(p0, q0)).alias("there"),
        F.sum(excess(q, p) - excess(q, p0) - excess(q0, p) + excess(q0, p0)).alias("back"),
    )
    parts = both.unionAll(fixes.select(*GROUP, "item", "there")).unionAll(fixes.select("lang", "item", "source", "back"))
    base = pairs.select(*GROUP, "item", F.coalesce(F.col("terms") * excess(p0, q0), F.lit(0)).alias("part"))
    return base.unionAll(parts).groupBy(*GROUP, "item").agg(F.sum("part").cast("long").alias("value"))


def radix_top(rows: DataFrame, k: int, scratch: Scratch, finish: int = FINISH) -> DataFrame:
    """The k rows of each group with the largest value, ties to the smaller item in UTF-8 bytes: rows with rank (int, from 1).

    rows: lang, source, item (unique in its group), value (long, not negative). No group is sorted whole. Histograms over the
    highest DIGIT_BITS bits give the cell in which a group's k-th value lies; only that cell is cut again by the next
    bits, until at most `finish` rows are in it. If more rows than that have the k-th value itself, histograms over the
    items' leading bytes cut them in the same way. What is above the cut (at most k + finish rows a group) is ranked.
    """
    top = rows.agg(F.max("value").alias("v")).first().v
    shift = DIGIT_BITS * -(-max(int(top or 0).bit_length(), 1) // DIGIT_BITS)
    # A group's state: value >> shift of its last cell, rows still needed from there, and the cell's rows.
    state = rows.groupBy(*GROUP).agg(F.count("*").alias("inside")).withColumn("prefix", F.lit(0).cast("long")).withColumn("need", F.lit(k).cast("long"))
    cuts = []

    def settle(found: DataFrame, cut: DataFrame) -> DataFrame:
        """Note the cut of groups that need no more cells; the other groups."""
        cuts.append(cut)
        return found.filter(F.col("inside") > F.greatest(F.lit(finish), "need"))

    state = scratch.staged(state, "radix")
    small = F.col("inside") <= F.greatest(F.lit(finish), "need")
    still = settle(state, state.filter(small).select(*GROUP, F.lit(0).cast("long").alias("least"), F.lit(None).cast("binary").alias("upto")))

    def narrowed(digit: Column, at: Column, ascending: bool) -> DataFrame:
        """The cell of the next digit in which each open group's last row lies."""
        here = with_groups(rows, still, "item").filter(at)
        cells = here.groupBy(*GROUP, "prefix", "need", digit.alias("digit")).agg(F.count("*").alias("inside"))
        order = Window.partitionBy(*GROUP).orderBy(F.col("digit").asc() if ascending else F.col("digit").desc()).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("inside").over(order), F.lit(0))
        return cells.withColumn("before", before).filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("inside") >= F.col("need"))).withColumn("need", F.col("need") - F.col("before"))

    while shift and not still.isEmpty():
        above, shift = shift, shift - DIGIT_BITS
        at = F.shiftright("value", above) == F.col("prefix") if above < 64 else F.lit(True)
        found = narrowed(F.shiftright("value", shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)), at, ascending=False)
        found = scratch.staged(found.select(*GROUP, (F.shiftleft("prefix", DIGIT_BITS) + F.col("digit")).alias("prefix"), "need", "inside"), "radix")
        still = settle(found, found.filter(small).select(*GROUP, F.shiftleft("prefix", shift).alias("least"), F.lit(None).cast("binary").alias("upto")))

    # Rows equal in value: `kth` is the value, and the prefix is now of the item's bytes.
    still = still.withColumnRenamed("prefix", "kth").withColumn("prefix", F.lit(b""))
    width, bytes_of = 0, F.col("item").cast("binary")
    while not still.isEmpty():
        at = (F.col("value") == F.col("kth")) & (F.substring(bytes_of, 1, width) == F.col("prefix") if width else F.lit(True))
        found = narrowed(F.struct("kth", F.substring(bytes_of, width + 1, DIGIT_BYTES).alias("b")), at, ascending=True)
        width += DIGIT_BYTES
        found = scratch.staged(found.select(*GROUP, F.col("digit.kth").alias("kth"), F.concat("prefix", "digit.b").alias("prefix"), "need", "inside"), "radix")
        longest = F.lit(width)
        still = settle(found, found.filter(small).select(*GROUP, F.col("kth").alias("least"), F.concat("prefix", F.lit(b"")).alias("upto"), longest.alias("width")))

    cut = cuts[0].withColumn("width", F.lit(0))
    for x in cuts[1:]:
        cut = cut.unionByName(x if "width" in x.columns else x.withColumn("width", F.lit(0)))
    over = with_groups(rows, cut, "item").filter((F.col("value") > F.col("least")) | ((F.col("value") == F.col("least")) & (F.col("upto").isNull() | (F.expr("substring(cast(item as binary), 1, width)") <= F.col("upto")))))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item").asc()))
    return over.select(*GROUP, "item", "value", rank.cast("int").alias("rank")).filter(F.col("rank") <= k)


def audit(docs: DataFrame, k: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows (divergence from every other source of the language) and `term` rows (the k terms that most exceed the language's share).

    docs: lang, source, text (null: empty); other columns are ignored, whatever their names. A source without kept terms has the
    share of an unseen term for each, and so takes part in pairs; a language without kept terms has pairs of value 0.
    Repeated rows count as often as they occur. Ranks fall by value, ties by the item's UTF-8 bytes. Shares are whole
    numbers and sums are exact. Texts of any length are counted whole. Empty table: no rows.
    """
    scratch = Scratch()
    kept = scratch.staged(kept_terms(docs), "audit-kept")
    totals = scratch.staged(group_totals(docs, kept), "audit-totals")
    all_of = with_groups(kept, totals, "term")
    total, terms = F.col("total"), F.col("terms")
    p, p0 = share(F.col("n"), total, terms).alias("p"), share(F.lit(0), total, terms).alias("p0")
    q = share(F.col("lang_n"), F.col("lang_total"), terms).alias("q")
    rated = scratch.staged(all_of.select(*GROUP, "term", p, p0, q), "audit-rated")

    met = divergences(rated, totals)
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item").asc()))
    pair = met.select(*GROUP, F.lit("pair").alias("part"), "item", "value", rank.cast("int").alias("rank"))
    ahead = rated.filter("p > q").select(*GROUP, F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    term = radix_top(scratch.staged(ahead, "audit-ahead"), k, scratch)
    return pair.unionByName(term.select(*GROUP, F.lit("term").alias("part"), "item", "value", "rank"))
