"""Registered queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weekwatch.llm import licences, ngram_lm, sketches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Further queries of an operator that has its own in ``QUERIES``.
VARIANTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, into: dict = QUERIES):
    """Register a query, with its SQL when one can be written."""

    def wrap(fn):
        into[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weekwatch.llm import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weekwatch.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op9_tag_path_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weekwatch.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def held_out(id_column: str):
    """True for ids whose rows labels are never learned from."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from weekwatch.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


_WORDS = """[w for w in regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')]"""


@query("op8_decontaminate", f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS s
    FROM (SELECT *, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS s
    FROM (SELECT *, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, n, i, item FROM dw JOIN bw USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos ON w.doc_id = pos.doc_id LEFT JOIN its ON w.doc_id = its.doc_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from weekwatch.llm import decontaminate

    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=None)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from weekwatch.llm import repeats

    done = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))




@query("op2_licence_scan", licences.oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op4_sketch_fingerprints", sketches.oracle())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op6_stupid_backoff", ngram_lm.oracle(_WORDS))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    scored = ngram_lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                         F.round("mean_log_score", 4).alias("mean_log_score"))


@query("op6_every_word", ngram_lm.oracle_apart(_WORDS), VARIANTS)
def op6_every_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op6, but each word has its own count, those beyond the vocabulary too."""
    from pyspark.sql import functions as F

    scored = ngram_lm.score(table(spark, sf_dir, "documents"), apart=True)
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                         F.round("mean_log_score", 4).alias("mean_log_score"))


@query("op7_ordinal_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade 2 is good and not toxic, 1 one of the two, 0 neither; a document is kept if grade 2 is likelier than not."""
    from pyspark.sql import functions as F

    from weekwatch.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = table(spark, sf_dir, "labels").filter(~held_out("doc_id")).withColumn(
        "grade", F.col("quality") + 1 - F.col("toxic"))
    graded = quality.grade(docs, quality.train(docs, ratings, 3))
    return graded.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_above_0"), F.col("tails")[1].alias("p_above_1"),
                         (F.col("tails")[1] >= 0.5).alias("keep"))


@query("op13_tree_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weekwatch.llm import tree_bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = tree_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op11_grammar_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the words of each document; in every tenth one the words from a chosen one on repeat with a period."""
    from pyspark.sql import functions as F

    from weekwatch.llm import word_runs

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    # without lambdas, so that the expression may stand below a Python function
    words, g = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""), F.floor(F.col("h") / 10)
    n = F.greatest(F.size(words), F.lit(1))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    periodic = F.array_join(F.slice(F.concat(F.slice(words, 1, a), again), F.lit(1), n), " ")
    text = F.when(F.col("h") % 10 == 0, periodic).otherwise(F.col("text"))
    done = word_runs.collapse_runs(docs.select("doc_id", text.alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return done.withColumns({"best": best, "listed": listed}).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length",
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_multi_index_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM (SELECT * FROM e WHERE vec_id % 100 = 0) a JOIN e r ON a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS k
    FROM p JOIN (SELECT * FROM s WHERE NOT same) USING (anchor_id)
    WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 5""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from weekwatch.llm import multi_index

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.hard_negatives(rows, F.col("vec_id") % 100 == 0, label=moved)
