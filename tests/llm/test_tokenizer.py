"""Ids against the public library's own encoder."""

import random
from pathlib import Path

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import tokenizer as tok

if not Path(tok.VOCABULARY_DIR).exists():
    pytest.skip("no vocabulary files here", allow_module_level=True)

VOCAB = tok.vocabulary()
PLAIN = tiktoken.Encoding("plain", pat_str=tok.PATTERN, mergeable_ranks=VOCAB.whole, special_tokens={})
RNG = random.Random(3)
TEXTS = [
    "", " ", "\n\n\n", "Hello world", "it's they'll", "文件編號：第 12 號", "a" * 3000, "中" * 900, "ab" * 1500, "<|endoftext|>", "😀👩‍💻", "　　全形", "x​y", "１２３", "\t\ttab  end ",
    *("".join(RNG.choice("abc 一二三é🙂\n1") for _ in range(RNG.randint(1, 300))) for _ in range(80)),
]


def test_ids_equal_library():
    packed = tok.Encoder(VOCAB).encode([*TEXTS, None])
    assert [list(memoryview(p).cast("i")) for p in packed] == [*(PLAIN.encode_ordinary(t) for t in TEXTS), []]


def test_both_trees_agree():
    merger = tok.Merger(VOCAB)
    pieces = sorted({"".join(RNG.choice("abcde一二三") for _ in range(RNG.randint(2, 40))).encode() for _ in range(400)})
    groups = {}
    for p in pieces:
        groups.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(p)
    for width, members in groups.items():
        many = [list(memoryview(m).cast("i")) for m in merger.merge_many(members, width)]
        assert many == [merger.merge_one(p) for p in members]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    [packed] = tok.Encoder(VOCAB).encode([text])
    ids = list(memoryview(packed).cast("i")) if packed else []
    assert ids == PLAIN.encode_ordinary(text) and PLAIN.decode(ids) == text


def test_column(spark):
    df = spark.createDataFrame([(1, "甲 text", "x"), (2, None, "y"), (3, "", None), (4, "甲 text", "z"), (None, "n", "n")], "doc_id bigint, text string, ids string")
    rows = {r["doc_id"]: r["ids"] for r in tok.encode_ids(df, "text", ["doc_id"]).collect()}
    assert rows == {1: PLAIN.encode_ordinary("甲 text"), 2: [], 3: [], 4: PLAIN.encode_ordinary("甲 text"), None: PLAIN.encode_ordinary("n")}
    counts = {r["doc_id"]: r["n"] for r in tok.encode_ids(df, "text", ["doc_id"], "n", counts_only=True).collect()}
    assert counts[2] == 0 and counts[1] == len(rows[1])
    assert tok.encode_ids(df.limit(0), "text", ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        tok.encode_ids(df, "text", ["ids"])


def test_other_vocabulary(spark):
    df = spark.createDataFrame([(1, "多語言 text")], "doc_id bigint, text string")
    other = tiktoken.Encoding("other", pat_str=tok.PATTERN, mergeable_ranks=tok.vocabulary("byte_bpe_multi_50k").whole, special_tokens={})
    assert tok.encode_ids(df, "text", ["doc_id"], name="byte_bpe_multi_50k").first()["ids"] == other.encode_ordinary("多語言 text")


def test_positions_of_long_runs_stay_below_the_rank(monkeypatch):
    merger = tok.Merger(tok.vocabulary())
    piece = ("".join(random.Random(3).choices("etaoinshr", k=3000))).encode()
    right = merger.merge_one(piece)
    monkeypatch.setattr(tok, "_SHIFT", 10)  # as if the run were longer than the positions that fit
    assert merger.merge_one(piece) == right


def test_a_piece_of_two_mebibytes():
    rng = random.Random(1)
    rare = lambda n: "".join(chr(rng.randrange(0xF0000, 0x10F000)) for _ in range(n))
    text = rare(270_000) + "".join(rng.choices("!?=-*#/", k=6000)) + rare(260_000) + "".join(rng.choices("!?=-*#/", k=6000))
    assert len(text.encode()) > 1 << 21 and tok.Encoder(VOCAB).cut(text) == [text]
    ids = tok.Merger(VOCAB).merge_one(text.encode())
    assert ids == PLAIN.encode_ordinary(text) and PLAIN.decode(ids) == text
