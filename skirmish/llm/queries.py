"""The queries of the training-data operators: each runs one operator over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import divergence, exact, language, lm, mixing, neighbours, packing, pii, quality, repeats, runs, similarity, warc
from skirmish.llm.common import WORD, shared_dir

#: The tokenizers' files; a parameter of the operators that use them.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold() -> F.Column:
    """crc32 of doc_id as text, modulo 5."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: The key of the queries' pseudonyms; a real run takes its own.
PII_KEY = "example-key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key=PII_KEY)


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("train", F.coalesce(fold() != 1, F.lit(True)))
    scored = lm.score(docs, tokenizer_path("piece_bpe_32k.model"))
    held_out = F.coalesce(fold() == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "piece_score")


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(F.coalesce(fold(), F.lit(1)) != 0))
    found = language.identify(docs, model)
    return found.select("doc_id", (F.coalesce(fold(), F.lit(1)) == 0).alias("held_out"), "lang_pred", "score")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, manifest, payloads=False).drop("url")


OP6_SQL = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER same THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))
"""


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = quality.fit_lines(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, chain).drop("content_words")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), total_share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.join(table(spark, sf_dir, "documents"), percent=80, words=5)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), k=200)


OP11_SQL = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
  tokens AS (SELECT lang, source, row, unnest(found) AS term FROM docs),
  kept AS (SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
  counted AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term),
  every AS (SELECT lang, source, term, coalesce(n, 0) AS n, lang_n FROM (SELECT DISTINCT lang, source FROM docs) JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)),
  summed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v, sum(n) OVER (PARTITION BY lang) AS lang_total FROM every),
  rated AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 1)) // (total + v) AS BIGINT) AS p, CAST(1 + (1000000000 * (lang_n + 1)) // (lang_total + v) AS BIGINT) AS q FROM summed),
  pairs AS (SELECT a.lang, a.source, b.source AS item FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source),
  met AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN met USING (lang, source, item)
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM rated WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM parts
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 200
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classes(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text. With h = crc32 of doc_id as text and g = h div 10, a tenth of the texts (h % 10 = 0) repeat from word g % n on, each p = 1 + (n - a) div (3 + g % 8) words."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    planted = F.coalesce(h % 10 == 0, F.lit(False))
    words = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), h.alias("h"), F.when(planted, F.regexp_extract_all(docs["text"], F.lit(WORD), F.lit(0))).alias("words"))
    g, n = F.call_function("div", F.col("h"), F.lit(10)), F.size("words")
    sized = words.withColumn("n", n.cast("int")).withColumn("a", F.when(F.col("n") > 0, F.pmod(g, F.col("n"))).cast("int"))
    sized = sized.withColumn("p", (1 + F.call_function("div", F.col("n") - F.col("a"), 3 + F.pmod(g, F.lit(8)))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("words", 1, F.col("a")), F.slice(again, 1, F.col("n") - F.col("a"))), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_planted_runs(table(spark, sf_dir, "documents")), least=24, copies=3)
    # Runs are ordered by start, then period: the first of those with the greatest exact length / period is the result's.
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.col("best")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", F.reduce("runs", none, better)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.call_function("div", 1000 * best["length"], best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_pii, op2_lattice_lm, op3_harmonic_packing, op4_language_id, op5_repeats, op6_warc, op7_neighbours, op8_quality_rules, op9_mixing, op10_jaccard_join, op11_source_divergence, op12_exact_dedup, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op6_warc": OP6_SQL, "op11_source_divergence": OP11_SQL, "op12_exact_dedup": OP12_SQL}
