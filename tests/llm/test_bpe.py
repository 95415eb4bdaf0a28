import base64
import random

import public_tokenizers
import tiktoken

from weekwatch.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = ["", "Hello world's  end\n\n", "a" * 5000, "ab" * 2000, " " * 900 + "x", "　漢字 \U0001f600 é½²", "\x1c\x85 \t",
         "x" * 99 + "é" * 400, "<|endoftext|>"]


def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_tiktoken_and_round_trips():
    own, want, rng = bpe.Codec(PATH, PATTERN), reference(), random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab  \n\t'sée12漢　.-tT") for _ in range(rng.randrange(60))) for _ in range(200)]
    for text in texts:
        ids = own.encode(text)
        assert ids == want.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_one_merge_at_a_time_gives_the_same():
    own, want = bpe.Codec(PATH, PATTERN), reference()
    pieces = [b"aaaa", b"abababab", b"lowering", b" unbelievable", "ééé".encode()]
    assert own.merge(pieces, False) == own.merge(pieces) == [want.encode_ordinary(p.decode()) for p in pieces]


def test_table(frame):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, TEXTS[5])]
    got = bpe.round_trip(frame(rows), PATH, PATTERN, ids="ids").collect()
    want = reference()
    assert len(got) == 5 and got[2] == got[3] and {r.fp for r in got} == {"old"}
    for r, (_, text) in zip(got, rows):
        assert r.ids == want.encode_ordinary(text or "") and r.n_tokens == len(r.ids)
    back = bpe.decode(bpe.encode(frame(rows), PATH, PATTERN), PATH, PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for _, t in rows]
    assert bpe.round_trip(frame([]), PATH, PATTERN).count() == 0
