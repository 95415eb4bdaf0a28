"""Tree concatenation against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from weekwatch.llm import tree_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return tree_bpe.encoder(PATH)


def long_texts():
    rng = random.Random(5)
    yield "a" * 5003
    yield "ab" * 1500 + "a"
    yield " " * 777 + "x" + "\n" * 333
    yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000))
    yield "".join(rng.choice("thein") for _ in range(3000))
    yield "9" * 901 + "!" * 700 + "=-" * 400
    yield "é" * 500 + "東京" * 300 + "🙂" * 200 + "ב" * 100
    yield "".join(rng.choice(["Ġ", "ss", "ing", "tion", "ation", "un"]) for _ in range(900))


TEXTS = ["", " ", "Hello world", "it's  we'll\tnot   DON'T", "<|endoftext|>", "a <|endoftext|><|endoftext|> b<|endoftext", "x" * 64 + "y",
         "՘a࢏ 1꭬", "“Quoted” – café…", "\x00\x1c\x1f \x85", "सन् २०२४ ٣٤ Ⅷ ½"]


@pytest.mark.parametrize("text", [*TEXTS, *long_texts()], ids=str.__len__)
def test_equals_the_library(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(library, own, text):
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeinorst", min_size=2, max_size=400), st.data())
def test_join_anywhere(own, text, data):
    data_ = text.encode()
    at = data.draw(st.integers(0, len(data_)))
    assert own.join(own.plain(data_[:at]), own.plain(data_[at:])) == own.plain(data_)


def test_queue_equals_loop(own):
    data = next(t for t in list(long_texts())[4:]).encode()[:250]
    assert own._queued([own.byte_id[b] for b in data]) == own.plain(data)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_rows_spread_and_not(spark, library):
    texts = [None, *TEXTS, *TEXTS, *long_texts(), "word " * 900, "x" * 1000 + " <|endoftext|> " + "y" * 1000]
    clash = "1 AS row, 2 AS key, 3 AS at, 4 AS made, 5 AS n_tokens, 6 AS opened, 7 AS head, 8 AS `a.b`"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", *clash.split(", "))
    done = tree_bpe.round_trip(df, PATH, ids="ids", spread=700, leaf=96)
    assert done.columns == ["doc_id", "text", "row", "key", "at", "made", "opened", "head", "a.b", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    got = {r["doc_id"]: r for r in done.collect()}
    for i, text in enumerate(texts):
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == expected(library, text), i
        assert len(got[i]["ids"]) == got[i]["n_tokens"] and got[i]["made"] == 4
    assert tree_bpe.round_trip(df.filter("false"), PATH).count() == 0


def test_encode_then_decode(spark, library):
    df = spark.createDataFrame([(1, "some text <|endoftext|>"), (1, "some text <|endoftext|>"), (2, None)], "doc_id long, text string")
    ids = tree_bpe.encode(df, PATH)
    assert [r["ids"] for r in ids.orderBy("doc_id").collect()] == [library.encode("some text <|endoftext|>").ids] * 2 + [[]]
    assert [r["back"] for r in tree_bpe.decode(ids, PATH, out="back").orderBy("doc_id").collect()] == ["some text <|endoftext|>"] * 2 + [""]
