"""Exact Jaccard join of word-shingle sets: overlaps are counted in fragments of the global frequency order and summed per pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import _BASE, MIX1, MIX2, Scratch, Words, lean, mix64, staged, text_slices
from skirmish.llm.graph import components

WORDS, PERCENT = 5, 80
#: Fragments of the global order in which overlaps are counted apart, rows of one task of a count by shingle, and rounds in
#: which lists meet one of their sets before what is left is compared pair by pair.
FRAGMENTS, TASK_ROWS, STARS = 8, 1 << 20, 3


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct shingles of each text, sorted by text and hash. A text of fewer words is one shingle."""
    w = Words(texts, lower=True)
    h, at = w.grams(words)
    doc = w.doc[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < words))
    if len(few):
        word, begin = w.hashes(), np.concatenate([[0], np.cumsum(w.counts)])
        whole = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            on = w.counts[few] > k
            whole[on] = (whole[on] + word[begin[few[on]] + k]) * _BASE
        h = np.concatenate([h, mix64(whole + w.counts[few].astype(np.uint64) * MIX1)])
        doc = np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


def set_ids(doc: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first shingle of each text, number of its shingles, id of its set): equal sets have equal ids, of two 64-bit sums."""
    edge = np.searchsorted(doc, np.arange(texts + 1))
    n = np.diff(edge)
    sums = []
    for c in (MIX1, MIX2):
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ c), dtype=np.uint64)])
        sums.append(upto[edge[1:]] - upto[edge[:-1]])
    return edge, n, mix64(sums[0] ^ mix64(sums[1] + n.astype(np.uint64) * MIX2)).view(np.int64)


def least_overlap(n, percent: int = PERCENT):
    """The least overlap of a set of n with any set at the threshold: ceil(n * percent / 100)."""
    return (n * percent + 99) // 100


def spare(n):
    """How many shared shingles beyond the first a longer prefix has to show."""
    return np.maximum(1, n // 8)


def _signatures(percent: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2).to_pylist()
            for a, b in text_slices(col):
                doc, h = shingles(col[a:b], words)
                edge, n, c = set_ids(doc, h, b - a)
                keep = n - least_overlap(n, percent) + spare(n)
                keep = np.minimum(np.where(n > 0, keep, 0), n)
                first = np.arange(len(h)) - edge[doc] < keep[doc]
                prefix = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32), pa.array(h[first].view(np.int64)))
                columns = [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n.astype(np.int64)), pa.array(c), prefix]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n", "c", "prefix"])

    return run


def _parts(rows: DataFrame, n_rows: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS))


def _grouped(rows: DataFrame, parts: int, key, schema: str, use) -> DataFrame:
    """use(rows) on all rows of a hash range of key at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from use(pa.Table.from_batches(held)).to_batches()

    return rows.repartition(parts, key).mapInArrow(lean(run), schema)


def shared_counts(signatures: DataFrame, n_rows: int) -> DataFrame:
    """c, shared: at least how many of its prefix shingles another set's prefix has. A map task sends a shingle once, whatever its copies."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, once = np.unique(batch.column(0).to_numpy(), return_index=True)
            lists = batch.column(1).take(pa.array(once))
            h, doc = lists.flatten().to_numpy(), np.repeat(ids, np.diff(lists.offsets.to_numpy()))
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1 if len(h) else np.zeros(0, bool)
            # One row a shingle: with its set if only one here has it, else with none; and counts of what is settled here.
            who, times = np.unique(doc[many], return_counts=True)
            keys = np.concatenate([h[new], mix64(who.astype(np.uint64)).view(np.int64)])
            docs = pa.array(np.concatenate([doc[new], who]), mask=np.concatenate([many[new], np.zeros(len(who), bool)]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), docs, pa.array(np.concatenate([np.zeros(new.sum(), np.int64), times]))], ["h", "c", "times"])

    def count(t: pa.Table) -> pa.Table:
        h, times = t["h"].to_numpy(), t["times"].to_numpy()
        known = t["c"].is_valid().to_numpy(zero_copy_only=False)
        doc = t["c"].fill_null(0).to_numpy()
        settled, open_ = times > 0, times == 0
        order = np.lexsort((doc[open_], known[open_], h[open_]))
        hs, ds, ks = h[open_][order], doc[open_][order], known[open_][order]
        if len(hs):
            new = np.append(True, (hs[1:] != hs[:-1]) | (ks[1:] != ks[:-1]) | (ds[1:] != ds[:-1]))
            hs, ds, ks = hs[new], ds[new], ks[new]
        same = hs[1:] == hs[:-1]
        twice = (np.append(False, same) | np.append(same, False) if len(hs) else np.zeros(0, bool)) & ks
        return pa.table({"c": pa.array(np.concatenate([ds[twice], doc[settled]])), "k": pa.array(np.concatenate([np.ones(twice.sum(), np.int64), times[settled]]))})

    rows = signatures.select("c", "prefix").mapInArrow(lean(spread), "h long, c long, times long")
    return _grouped(rows, _parts(rows, n_rows), "h", "c long, k long", count).groupBy("c").agg(F.sum("k").alias("shared"))


def hot_shingles(sets: DataFrame, n_rows: int, parts: int) -> dict[int, int]:
    """The shingles of more than 1 in `parts` of all rows, with their counts; at most 2 * parts come to the driver.

    A batch reports those with 1 in 2 * parts of its own rows. What it leaves out is less than half of such a shingle's rows, so
    reports that add up to 1 in 2 * parts of all rows miss none. Only where a shingle is counted depends on it.
    """

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, k = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            on = k >= max(2, k.sum() / (2 * parts))
            yield pa.RecordBatch.from_arrays([pa.array(h[on], pa.int64()), pa.array(k[on], pa.int64())], ["h", "k"])

    found = sets.select("shingles").mapInArrow(lean(heavy), "h long, k long").groupBy("h").agg(F.sum("k").alias("k"))
    return {r.h: r.k for r in found.filter(F.col("k") >= max(2, n_rows // (2 * parts))).collect()}


def in_order(sets: DataFrame, n_rows: int) -> DataFrame:
    """The sets, one row for each fragment of the global order in which a set has a shingle that another set has too.

    c, n (the set's size), size (its shingles that others have), f (the fragment), before (of these, how many are in earlier
    fragments), part (those in this one, in order). The order is by floor(log2 of the number of sets that have a shingle), then
    by hash. It's cut at frequencies 4, 8, 16, ..., so fragment f has the shingles of 2**(f+1) sets to twice as many less one, the last all
    others. Rows of a hot shingle, whose count is known, skip the count and go straight to their sets.
    """
    parts = _parts(sets, n_rows)
    hot = hot_shingles(sets, n_rows, parts)
    hot_h = np.array(sorted(hot), np.int64)
    hot_log = np.array([int(hot[h]).bit_length() - 1 for h in sorted(hot)], np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(2), batch.column(0).to_numpy()
            h, c = lists.flatten().to_numpy(), np.repeat(ids, np.diff(lists.offsets.to_numpy()))
            log = np.zeros(len(h), np.int64)
            if len(hot_h):
                at = np.minimum(np.searchsorted(hot_h, h), len(hot_h) - 1)
                log = np.where(hot_h[at] == h, hot_log[at], 0)
            # A set's own row says its size.
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h, batch.column(1).to_numpy()])), pa.array(np.concatenate([c, ids])), pa.array(np.concatenate([log, np.full(len(ids), -1)]))], ["h", "c", "log"])

    def count(t: pa.Table) -> pa.Table:
        h, c, log = (t[k].to_numpy() for k in ("h", "c", "log"))
        open_ = log == 0
        _, group, times = np.unique(h[open_], return_inverse=True, return_counts=True)
        log = log.copy()
        log[open_] = (np.frexp(times.astype(float))[1] - 1)[group]
        on = log != 0
        return pa.table({"h": pa.array(h[on]), "c": pa.array(c[on]), "log": pa.array(log[on])})

    def pack(t: pa.Table) -> pa.Table:
        h, c, log = (t[k].to_numpy() for k in ("h", "c", "log"))
        own = log < 0
        ids = np.sort(c[own])
        total = h[own][np.argsort(c[own], kind="stable")]
        h, c, log = h[~own], c[~own], log[~own]
        order = np.lexsort((h.view(np.uint64), log, c))
        h, c, f = h[order], c[order], np.minimum(log[order] - 1, FRAGMENTS - 1)
        new = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (f[1:] != f[:-1]))) if len(h) else np.zeros(0, np.int64)
        mine = np.searchsorted(ids, c[new])
        first, last = np.searchsorted(c, ids, "left"), np.searchsorted(c, ids, "right")
        values = pa.ListArray.from_arrays(np.append(new, len(h)).astype(np.int32), pa.array(h))
        return pa.table({"c": pa.array(c[new]), "n": pa.array(total[mine]), "size": pa.array((last - first)[mine]), "f": pa.array(f[new]), "before": pa.array(new - first[mine]), "part": values})

    rows = sets.select("c", "n", "shingles").mapInArrow(lean(spread), "h long, c long, log long")
    counted = _grouped(rows, parts, F.when(F.col("log") == 0, F.col("h")).otherwise(F.col("c")), "h long, c long, log long", count)
    return _grouped(counted, parts, "c", "c long, n long, size long, f long, before long, part array<long>", pack)


def verified(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """The pairs x, y whose sets reach the threshold. Overlaps are counted in each fragment of the order apart, and summed per pair."""
    x = ordered.select(F.col("c").alias("x"), F.col("n").alias("nx"), "f", F.col("part").alias("px"))
    y = ordered.select(F.col("c").alias("y"), F.col("n").alias("ny"), "f", F.col("part").alias("py"))
    both = pairs.select("x", "y").join(x, "x").join(y, ["y", "f"])
    overlap = both.select("x", "y", "nx", "ny", F.size(F.array_intersect("px", "py")).alias("k")).groupBy("x", "y", "nx", "ny").agg(F.sum("k").alias("k"))
    return overlap.filter(F.col("k") * 100 >= (F.col("nx") + F.col("ny") - F.col("k")) * percent).select("x", "y")


def linked(ordered: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """node, component: the components of the sets that link with another (None: no set does)."""
    staged = scratch.staged
    need = F.floor((F.col("n") * percent + 99) / 100)
    take = F.col("n") - need + 1 - (F.col("n") - F.col("size"))
    # own: the set's shingles that no other has; s: how many it has from this one on, which bounds the overlap with a set that
    # has none of those before.
    lists = ordered.withColumn("take", (take - F.col("before")).cast("int")).filter("take > 0")
    lists = lists.select("c", "n", "size", "before", F.posexplode(F.slice("part", F.lit(1), F.col("take"))).alias("at", "h"))
    lists = lists.select("c", "n", "h", (F.col("n") - F.col("size")).alias("own"), (F.col("size") - F.col("before") - F.col("at")).alias("s"))
    lists = staged(lists, "join-lists")

    def possible(n1, s1, n2, s2):
        """Whether two sets can link, by their sizes and by how many shingles they have from their first common one on."""
        most = F.least(s1, s2)
        return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (most * 100 >= (n1 + n2 - most) * percent)

    def largest(rows: DataFrame) -> DataFrame:
        """h, largest: the component with the most sets of each list that holds several."""
        sizes = rows.groupBy("h", "component").agg(F.count("*").alias("k"))
        sizes = sizes.groupBy("h").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.count("*").alias("parts"))
        return staged(sizes.filter("parts > 1").select("h", "largest"), "join-largest")

    def labelled(part: DataFrame | None) -> DataFrame:
        if part is None:
            return lists.withColumn("component", F.col("c"))
        return lists.join(part.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c"))

    links, part = None, None
    for _ in range(STARS):
        # Each list's most common component sends its set with the fewest shingles of its own to meet the rest of the list.
        rows, mine = labelled(part), F.struct("own", "n", "c")
        if part is None:
            first = rows.groupBy("h").agg(F.min(mine).alias("first"))
        else:
            rows = staged(rows.join(largest(rows), "h"), "join-rows")
            first = rows.filter("component = largest").groupBy("h").agg(F.min(mine).alias("first"))
            rows = rows.filter("component <> largest")
        met = rows.join(staged(first, "join-first"), "h").filter((F.col("first.c") != F.col("c")) & possible(F.col("n"), F.col("n") - F.col("own"), F.col("first.n"), F.col("first.n") - F.col("first.own")))
        best = met.groupBy("c", F.col("first.c").alias("x")).agg(F.count("*").alias("k")).groupBy(F.col("c").alias("y")).agg(F.max_by("x", F.struct("k", "x")).alias("x"))
        new = staged(verified(staged(best, "join-pairs"), ordered, percent), "join-links")
        if new.isEmpty():
            break
        links = new if links is None else links.union(new)
        part = scratch.add(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))))

    # What is left: lists that hold several components, each list's largest against the others and these among themselves.
    rows = labelled(part)
    mixed = staged(rows.join(largest(rows), "h"), "join-mixed")
    one = mixed.filter("component <> largest").select("h", F.col("c").alias("x"), F.col("n").alias("n1"), F.col("s").alias("s1"), F.col("component").alias("c1"))
    met = mixed.groupBy("h", F.col("component").alias("c2")).agg(F.max("s").alias("s2"), F.min("n").alias("low"), F.max("n").alias("high"))

    def reachable(most):
        """Whether a set can link with one of a component, whose smallest has `low` shingles, if they share at most `most`."""
        return most * 100 >= (F.col("n1") + F.greatest("low", most) - most) * percent

    goal = one.join(staged(met, "join-met"), "h").filter((F.col("c1") != F.col("c2")) & (F.col("high") * 100 >= F.col("n1") * percent) & (F.col("n1") * 100 >= F.col("low") * percent) & reachable(F.least("s1", "s2")))
    goal = staged(goal.groupBy("x", "n1", "c2").agg(F.min("low").alias("low")), "join-goals")
    # A set shares with any member of a component at most the shingles that the component has at all.
    token = F.explode("part").alias("token")
    has = ordered if part is None else ordered.join(part.select(F.col("node").alias("c"), "component"), "c", "left")
    has = has.withColumn("c2", F.col("c") if part is None else F.coalesce("component", "c")).join(goal.select("c2").distinct(), "c2", "left_semi").select("c2", token).distinct()
    asks = goal.join(ordered.select(F.col("c").alias("x"), "part"), "x").select("x", "c2", "n1", "low", token)
    open_ = asks.join(staged(has, "join-has"), ["c2", "token"]).groupBy("x", "c2", "n1", "low").agg(F.count("*").alias("most")).filter(reachable(F.col("most")))
    open_ = staged(open_.select("x", "c2"), "join-open")

    two = mixed.select("h", F.col("c").alias("y"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("component").alias("c2"))
    able = possible(F.col("n1"), F.col("s1"), F.col("n2"), F.col("s2"))
    asked = staged(one.join(open_, "x"), "join-asked")
    cross = asked.join(two, ["h", "c2"]).filter(able).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    more = staged(verified(staged(cross, "join-pairs"), ordered, percent), "join-links")
    if more.isEmpty():
        return part
    links = more if links is None else links.union(more)
    return scratch.add(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))))


def classes(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, t: a hash of the text, n: number of shingles, c: the set) and the sets with a shingle (c, least: the smallest
    doc_id of a row with it, rep: the row of the component to keep, component: the smallest doc_id of the component)."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    plain = plain.select("doc_id", F.xxhash64("text").alias("t"), "text")
    scratch = Scratch()
    staged = scratch.staged
    full_rows = staged(plain.mapInArrow(lean(_signatures(percent, words)), "doc_id long, t long, n long, c long, prefix array<long>"), "join-signatures")
    n_rows = full_rows.agg(F.sum(F.size("prefix"))).first()[0] or 0
    shared = staged(shared_counts(full_rows.filter("n > 0"), n_rows), "join-shared")
    rows = staged(full_rows.drop("prefix"), "join-rows")
    scratch.clear(shared, rows)
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t")
    sets = staged(rows.filter("n > 0").groupBy("c", "n").agg(F.min("doc_id").alias("least"), F.min(row).alias("rep")), "join-classes")
    enough = F.greatest(F.lit(1), F.floor(F.floor((F.col("n") * percent + 99) / 100) / 8))
    close = sets.join(shared, "c").filter(F.col("shared") >= enough)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0).to_pylist()
            for a, b in text_slices(col):
                doc, h = shingles(col[a:b], words)
                edge, n, c = set_ids(doc, h, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], pa.array(c), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(h.view(np.int64)))], ["want", "c", "n", "shingles"])

    reps = close.select(F.col("rep.doc_id").alias("id"), F.col("rep.t").alias("t2"), F.col("c").alias("want")).hint("shuffle_hash")
    chosen = plain.join(reps, plain["doc_id"].eqNullSafe(F.col("id")) & (F.col("t") == F.col("t2")))
    texts = chosen.select("text", "want").mapInArrow(lean(full), "want long, c long, n long, shingles array<long>").filter("want = c").drop("want")
    texts = staged(texts, "join-sets")
    if not texts.groupBy("c").count().filter("count > 1").isEmpty():  # repeated rows
        texts = staged(texts.dropDuplicates(["c"]), "join-sets")
    n_tokens = texts.agg(F.sum("n")).first()[0] or 0
    ordered = staged(in_order(texts, n_tokens), "join-fragments")
    scratch.clear(rows, sets, ordered)
    part = linked(ordered, percent, scratch)
    if part is not None:
        sets = sets.join(part.select(F.col("node").alias("c"), "component"), "c", "left")
    sets = staged(sets.withColumn("group", F.coalesce("component", "c") if part is not None else F.col("c")).drop("component"), "join-groups")
    groups = sets.groupBy("group").agg(F.min("least").alias("component"), F.min("rep").alias("keep"), F.count("*").alias("sets"))
    several = staged(groups.filter("sets > 1").drop("sets"), "join-several")
    named = sets.join(several, "group", "left").select("c", F.when(F.col("keep").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"), F.coalesce("keep", "rep").alias("keep"))
    named = staged(named, "join-named")
    scratch.clear(rows, named)
    return rows, named


def join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Components of near-copies: doc_id, n_shingles, component_id, a row per row of docs.

    docs: doc_id, text; other columns are ignored. A-Z are lowered. A set: the distinct shingles of `words` words; with fewer
    words the whole sequence as one; null or blank text: the empty set, which links with nothing. Two sets link when
    100 * intersection >= percent * union. component_id: the smallest doc_id reachable by links, itself included; null if no
    row of the component has a doc_id. Rows are classed by their sets, so repeated rows, a doc_id on several texts (its rows may
    have different components) and null doc_ids take part like others. Empty table: no rows. Shingles and sets are told apart
    by 64-bit hashes.

    1. Each set's prefix in hash order holds 20 % of it, and an eighth more; sets at the threshold share at least an eighth
       of the smaller in it. Sets whose prefix shares less with all others link with nothing and are done.
    2. Of the rest, shingles found in one set are dropped, the others ordered by frequency. The order is cut into FRAGMENTS, and
       a set has a row in each (`in_order`). Overlaps are counted in each fragment apart and summed per pair (`verified`).
    3. The rarest 20 % of a set are its prefix; sets that link share a shingle in it. The set of a prefix shingle's list with the
       fewest shingles of its own is compared with the others (each set with the one it meets most), and links give
       components; lists with several components do so again.
    4. What then shares a prefix shingle and is in different components is compared pair by pair, but for sets that share too
       little with all of a component together. Pairs within one are not compared, as they couldn't change it.
    """
    rows, named = classes(docs, percent, words)
    out = rows.join(named.select("c", "component"), "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of docs that stay when one row of each component of `join` does: that with the smallest doc_id (null last).

    Of rows with that doc_id and different texts, the one with the smallest text hash stays; of repeated rows any one. Rows
    without a word link with nothing and all stay. Columns are those of docs. Empty table: no rows.
    """
    rows, named = classes(docs, percent, words)
    labelled = rows.filter("n > 0").join(named.select("c", "keep"), "c")
    copies = labelled.groupBy("doc_id", "t").agg(F.count("*").alias("k"), F.first("keep").alias("keep"))
    copies = staged(copies.select("k", F.col("doc_id").alias("_id"), F.col("t").alias("_t"), (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("t") == F.col("keep.t"))).alias("stays")), "join-copies")
    id_, text = docs["doc_id"].cast("long"), docs["text"].cast("string")

    def matches(other: DataFrame) -> Column:
        return id_.eqNullSafe(other["_id"]) & (F.xxhash64(text) == other["_t"])

    gone = copies.filter("not stays").select("_id", "_t").hint("shuffle_hash")
    left = docs.join(gone, matches(gone), "left_anti")
    repeated = copies.filter("stays and k > 1").select("_id", "_t")
    if repeated.isEmpty():
        return left
    twice = repeated.hint("shuffle_hash")
    several = docs.join(twice, matches(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated.hint("shuffle_hash"), matches(repeated), "left_anti").union(several)
