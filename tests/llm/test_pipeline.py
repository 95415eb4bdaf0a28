import hashlib
import random

import public_tokenizers

import corpus_pipeline
from weekwatch.llm import bpe


def build(spark, folder):
    rng = random.Random(11)
    plain = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    body = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    docs, labels = {}, []
    for i in range(160):
        words = body(60).split()
        toxic = i % 4 == 0
        if toxic:
            for insult in ("idiot", "moron", "scum"):
                words.insert(rng.randrange(len(words)), insult)
        docs[i] = " ".join(words)
        labels.append((i, 1, int(toxic)))
    passage = body(70)
    docs |= {201: body(30) + " " + passage + " " + body(30), 202: body(25) + " " + passage + " " + body(25)}
    docs |= {203: docs[1], 204: docs[2] + " idiot moron", 205: "", 206: None, 208: body(3000)}
    item = body(14)
    docs[207] = body(40) + " " + item + " " + body(40)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, passage


def test_run(spark, tmp_path):
    docs, passage = build(spark, tmp_path)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {i for i in range(0, 160, 4)} | {203, 204, 207} | {206}  # 206, a null text, is a copy of 205, an empty one
    assert set(docs) - set(got) == gone
    for i, r in got.items():
        if i == 202:
            assert passage[40:-40] not in r.text and passage in got[201].text and len(r.text) < len(docs[202]) - 250
        else:
            assert r.text == docs[i]
        assert r.n_chars == len(r.text) and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    own = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert all(list(r.ids) == own.encode(r.text) for r in got.values())


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    build(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("score", docs_column())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_near_copies_with_repeated_and_missing_ids(spark, tmp_path):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words stand here"), (None, "a b c d"), (None, "lonely text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == [(0, "lonely text of its own"), (1, "a b c d"), (1, "other words stand here")]


def test_columns_of_any_name_stay_in_every_stage(spark, tmp_path):
    from pyspark.sql import functions as F

    build(spark, tmp_path)
    names = ["_row", "_id", "_mark", "_group", "_score", "_doc", "_copy", "_text", "_bpe", "_z", "_r", "_rows", "_packed", "kept", "spans", "n_bytes", "rows",
             "word", "component_id", "n_words", "n_hit", "items", "mark", "a.b"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id > 120").select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for again in (docs, docs.unionByName(docs.filter("doc_id = 201"))):
        rows = again
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}-{rows is again}-{again is docs}"
            stage(spark, rows, str(tmp_path)).write.parquet(path)
            rows = spark.read.parquet(path)
            assert rows.columns[:len(docs.columns)] == docs.columns, name
            assert rows.count() > 0
            for r in rows.collect():
                assert [r[n] for n in names] == list(range(len(names))), name


def test_cutting_repeats_keeps_one_worker_for_each_task(spark):
    """No stage of the plan has a second Python function; a task would hold a second worker's memory for it."""
    from weekwatch.llm import repeats

    docs = spark.createDataFrame([(1, "ä" * 120), (2, "xä" + "ä" * 120)], "doc_id long, text string")
    passes = [df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
              for df in (corpus_pipeline.cut_repeats(spark, docs, ""), repeats.remove_repeats(docs))]
    assert passes[0] == passes[1], passes
    cut = repeats.remove_repeats(docs, width=99, whole_characters=True).orderBy("doc_id").collect()
    assert [r.kept for r in cut] == [bytes(r.kept).decode("utf-8", "ignore") for r in
                                     repeats.remove_repeats(docs, width=99).orderBy("doc_id").collect()]
