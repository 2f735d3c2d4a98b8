"""Pairs against comparison of all pairs."""

import itertools
import random

import pytest

from foliospark.llm import neardup as nd

FIELDS = ["structured_text", "display_text"]
SCHEMA = "result_id bigint, structured_text string, display_text string, text_id string, digest string, key int"


def runs(text):
    s = "".join(text.split()) if text else ""
    return {s[i : i + 5] for i in range(len(s) - 4)}


def brute(rows, threshold=0.7):
    found = set()
    for f, name in enumerate(FIELDS):
        sets = {r[0]: runs(r[f + 1]) for r in rows if r[0] is not None}
        for a, b in itertools.combinations(sorted(sets), 2):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12:
                found.add((name, a, b))
    return found


def made(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh一二三四") for _ in range(rng.randint(3, 7)))
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [word()], [words[k], word()], words[k : k + 1][::-1]])
            body = " ".join(words) or word()
        else:
            body = " ".join(word() for _ in range(rng.randint(20, 120)))
        rows.append((i + 1, body, body if rng.random() < 0.5 else " ".join(word() for _ in range(40)), "x", "y", 1))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    rows = made(seed)
    got = [tuple(r) for r in nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), "result_id", FIELDS).collect()]
    expected = brute(rows)
    assert len(got) == len(set(got)) and len(expected) > 40
    assert set(got) <= expected and len(set(got)) >= 0.99 * len(expected)


def test_edge_cases(spark):
    long = "字句" * 20_000 + "尾"
    rows = [(1, None, None), (2, "", "   "), (3, "abcd", "abc\nd"), (4, "abcde", "a b c d e"), (5, "ab cde", "zzzzzz"), (6, long, "abcde"), (7, long, None), (None, "abcde", "abcde"), (4, "abcde", "a b c d e")]
    df = spark.createDataFrame([(*r, "t", "d", 0) for r in rows], SCHEMA)
    got = {tuple(r) for r in nd.near_duplicate_pairs(df, "result_id", FIELDS).collect()}
    assert got == {("structured_text", 4, 5), ("structured_text", 6, 7), ("display_text", 4, 6)}
    classes = {(r["field"], r["row_id"]): (r["copies"], r["links"]) for r in nd.near_duplicate_classes(df, "result_id", FIELDS).collect()}
    assert classes["structured_text", 4] == (2, 0) and ("structured_text", 1) not in classes
    assert nd.near_duplicate_pairs(df.limit(0), "result_id", FIELDS).collect() == []
    assert nd.near_duplicate_links(df, "result_id", FIELDS).collect() == nd.near_duplicate_links(df.limit(0), "result_id", FIELDS).collect() == []


def test_copies_cost_one_text(spark):
    rows = [(i, "同一份內容，一字不差。" * 3, f"各不相同 {i} {i * 7919} {i * 104729}", "", "", 0) for i in range(1, 61)]
    members, links = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA), "result_id", FIELDS)
    assert links.filter("text_a = text_b").count() == 0
    assert members.filter("field = 'structured_text'").select("text_id").distinct().count() == 1
    assert nd.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), "result_id", FIELDS).filter("field_name = 'structured_text'").count() == 60 * 59 // 2


def test_variant_keys_tolerate_one_position():
    sign = nd.signature(nd.run_hashes("某一份不長也不短的文字內容"), nd.hash_orders(nd.SEGMENTS * nd.SEGMENT))
    other = sign.copy()
    other[::nd.SEGMENT] ^= 1  # one position of every segment
    same = nd.variant_keys(sign) == nd.variant_keys(other)
    assert same.reshape(nd.SEGMENTS, nd.SEGMENT).sum(axis=1).tolist() == [1] * nd.SEGMENTS
    other[1::nd.SEGMENT] ^= 1  # two positions: no key is left
    assert not (nd.variant_keys(sign) == nd.variant_keys(other)).any()


@pytest.mark.parametrize("seed", [3, 4])
def test_hot_keys_lose_no_link(spark, monkeypatch, seed):
    rows = made(seed)
    # boilerplate that far more texts share than HOT, with bodies of their own of all sizes
    rng = random.Random(seed)
    shared = " ".join("".join(rng.choice("abcdefgh一二三四") for _ in range(6)) for _ in range(60))
    rows += [(1000 + i, f"{shared} " + " ".join(f"{i * 7919 + k:05d}" for k in range(i % 30)), None, "", "", 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rows)
    monkeypatch.setattr(nd, "HOT", 3)
    hot = []
    exact = nd._pairs_of_hot
    monkeypatch.setattr(nd, "_pairs_of_hot", lambda bodies, per_mille: hot.append(bodies.count()) or exact(bodies, per_mille))
    got = [tuple(r) for r in nd.near_duplicate_pairs(df, "result_id", FIELDS).collect()]
    assert hot and hot[0] > 30 and len(got) == len(set(got)) and set(got) <= expected and len(got) >= 0.99 * len(expected)
    among = {p for p in expected if p[1] >= 1000}
    assert among and among <= set(got)  # all of these are hot: none may be missed


def test_hot_texts_are_joined_exactly(spark):
    rows = [(i, "".join(r[1].split())) for i, r in enumerate(made(5)) if len("".join(r[1].split())) >= 5]
    df = spark.createDataFrame(rows, "text_id bigint, body string")
    candidates = {tuple(r) for r in nd._pairs_of_hot(df, 700).collect()}
    assert {(a, b) for _, a, b in brute([(i, t, None) for i, t in rows])} <= candidates and len(candidates) < len(rows) ** 2 / 4
    assert nd._pairs_of_hot(df.limit(0), 700).collect() == []


def test_runs_of_keys_over_batches(spark):
    rng = random.Random(1)
    rows = sorted({(rng.choice([1, 2, *range(10, 400)]), t) for t in range(3000)} | {(5, t) for t in range(700)})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        index = spark.createDataFrame(rows, "key bigint, text_id bigint").coalesce(1).sortWithinPartitions("key", "text_id")
        found = [tuple(r) for r in nd._paired(index).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = {}
    for key, text in rows:
        groups.setdefault(key, []).append(text)
    assert sorted(p for p in found if p[1] is not None) == sorted(p for g in groups.values() if len(g) <= nd.HOT for p in itertools.combinations(g, 2))
    assert sorted(a for a, b in found if b is None) == groups[5] and len(groups[5]) > nd.HOT


@pytest.mark.parametrize("alike, least", [(0.70, 0.99), (0.75, 0.995), (0.8, 0.999), (0.9, 1.0)])
def test_recall_by_alikeness(alike, least):
    rng = random.Random(7)
    orders = nd.hash_orders(nd.SEGMENTS * nd.SEGMENT)
    found = tried = 0
    while tried < 400:
        size = rng.randint(150, 400)
        common = round(2 * size * alike / (1 + alike))  # of two sets of this size
        pool = [rng.getrandbits(64) for _ in range(2 * size - common)]
        a, b = (nd.np.array(s, dtype=nd.np.uint64) for s in (pool[:size], pool[:common] + pool[size:]))
        keys = (nd.variant_keys(nd.signature(s, orders)) for s in (a, b))
        found += bool((next(keys) == next(keys)).any())
        tried += 1
    assert found >= least * tried
