"""Mixing and subjects."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from foliospark.llm import mixture as mx
from foliospark.llm import subjects as sj
from foliospark.llm.subject_terms import CURATED
from foliospark.llm.tokenizer import VOCABULARY_DIR

if not Path(VOCABULARY_DIR).exists():
    pytest.skip("no vocabulary files here", allow_module_level=True)

TARGETS = [("big", 0.6, 1), ("small", 0.2, 3), ("gone", 0.15, 2), ("off", 0.05, 0)]
T_SCHEMA = "source string, target_share double, max_repeats int"
D_SCHEMA = "doc_id bigint, source string, text string, n_tokens string, shard string"


def documents(n_big=400, n_small=12):
    rows = [(i, "big", f"word {i} " * (i % 9 + 1)) for i in range(n_big)] + [(10_000 + i, "small", "tiny text " * 20) for i in range(n_small)]
    rows += [(20_000, "off", "unused"), (20_001, None, "no source"), (20_002, "other", "not named"), (20_003, "big", None), (20_004, "big", ""), (None, "big", "no id")]
    return [(*r, "x", "y") for r in rows]


def test_mixture(spark):
    docs, targets = spark.createDataFrame(documents(), D_SCHEMA), spark.createDataFrame(TARGETS, T_SCHEMA)
    rows = mx.mixture(docs, targets, shards=5, block=64).collect()
    used = Counter((r["source"], r["doc_id"]) for r in rows)
    assert {s for s, _ in used} == {"big", "small"} and len({(r["source"], r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert max(n for (s, _), n in used.items() if s == "big") == 1 and max(n for (s, _), n in used.items() if s == "small") <= 3
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 5
    again = mx.mixture(docs, targets, shards=5, block=64).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    shares = {r["source"]: r for r in mx.shares_reached(docs, targets, block=64).collect()}
    assert set(shares) == {"big", "small", "gone", "off"}
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += r["n_tokens"]
    for s in ("big", "small"):
        assert shares[s]["reached_tokens"] == tokens[s] and shares[s]["reachable"]
        assert shares[s]["reached_share"] == pytest.approx(tokens[s] / sum(tokens.values()))
        assert shares[s]["reached_share"] == pytest.approx(dict((a, b) for a, b, _ in TARGETS)[s] / 0.8, abs=0.02)
    assert not shares["gone"]["reachable"] and shares["gone"]["reached_tokens"] == 0 and shares["gone"]["short_tokens"] > 0 and not shares["off"]["reachable"]


def test_empty_mixture(spark):
    docs, targets = spark.createDataFrame([], D_SCHEMA), spark.createDataFrame(TARGETS, T_SCHEMA)
    assert mx.mixture(docs, targets).collect() == []
    assert {r["reached_share"] for r in mx.shares_reached(docs, targets).collect()} == {0.0}
    assert mx.shard_report(docs, targets).collect() == []
    assert mx.mixture(spark.createDataFrame(documents(9, 2), D_SCHEMA), targets.limit(0)).collect() == []


def test_quotas():
    found = {q.source: q for q in mx.quotas([("a", 0.5, 1), ("b", 0.25, 3), ("c", 0.25, 5)], {"a": 1000, "b": 100}, 10)}
    assert (found["b"].whole, found["b"].rest) == (3, 0) and found["a"].rest == 600 and found["c"].blocks == 0


def test_splitting_tree_keeps_every_block():
    blocks = [1000, 37, 0, 5]
    tree = mx.SplittingTree(blocks, 7).quotas()
    assert tree.sum(axis=0).tolist() == blocks and (tree >= 0).all()
    assert np.ptp(tree.sum(axis=1)) <= 3
    # the draw is hypergeometric: over seeds the mean of a shard's count is its share
    mean = np.mean([mx.SplittingTree(blocks, 4, seed).quotas()[0, 0] for seed in range(300)])
    assert mean == pytest.approx(250, abs=3)


def test_every_block_goes_where_the_tree_says():
    blocks = [501, 37, 5]
    tree = mx.SplittingTree(blocks, 11)
    source = np.repeat(np.arange(3, dtype=np.int32), blocks)
    turn = np.concatenate([np.arange(n) for n in blocks])
    shuffled = np.random.default_rng(1).permutation(len(turn))
    shard = mx.SplittingTree(blocks, 11).shards_of(source[shuffled], turn[shuffled])
    counted = np.zeros((11, 3), dtype=int)
    np.add.at(counted, (shard, source[shuffled]), 1)
    assert (counted == tree.quotas()).all()


def test_splitting_tree_of_more_blocks_than_the_library_draws_from():
    blocks = [3_000_000_000_000 // mx.BLOCK_TOKENS, 5_000_000_000, 7, 0]
    tree = mx.SplittingTree(blocks, 16).quotas()
    assert tree.sum(axis=0).tolist() == blocks and (tree >= 0).all() and np.ptp(tree.sum(axis=1)) <= 5
    assert sum(blocks) > mx.LIBRARY_COUNTS


def test_draws_of_many_balls_have_mean_and_spread_of_the_few(monkeypatch):
    counts, size = np.array([600, 300, 100]), 400
    exact = [mx.draw(np.random.default_rng(i), counts, size) for i in range(3000)]
    monkeypatch.setattr(mx, "LIBRARY_COUNTS", 0)
    own = [mx.draw(np.random.default_rng(i), counts, size) for i in range(3000)]
    assert all(x.sum() == size and (x >= 0).all() and (x <= counts).all() for x in own)
    assert np.mean(own, axis=0) == pytest.approx(np.mean(exact, axis=0), abs=0.6)
    assert np.std(own, axis=0) == pytest.approx(np.std(exact, axis=0), rel=0.08)


def test_permutation():
    for size in (1, 2, 3, 97, 4096, 5001):
        made = mx.permuted(np.arange(size), size, 3)
        assert sorted(made.tolist()) == list(range(size))
    made = mx.permuted(np.arange(5001), 5001, 3)
    assert len(set(np.diff(made).tolist())) > 2000  # consecutive blocks keep no stride
    assert made.tolist() != mx.permuted(np.arange(5001), 5001, 4).tolist()


def test_shards_hold_what_the_tree_drew(spark):
    docs, targets = spark.createDataFrame(documents(4000, 40), D_SCHEMA), spark.createDataFrame(TARGETS, T_SCHEMA)
    rows = mx.shard_report(docs, targets, shards=9, block=64).collect()
    longest = 60  # tokens of the longest document, and of a block
    last = {s: max(r["shard"] for r in rows if r["source"] == s) for s in ("big", "small")}
    for r in rows:
        assert abs(r["quota_tokens"] - r["tokens"]) < 2 * longest + (64 if r["shard"] == last[r["source"]] else 0)
    whole = mx.mixture(docs, targets, shards=9, block=64).groupBy("shard", "source").sum("n_tokens").collect()
    assert {(r[0], r[1]): r[2] for r in whole} == {(r["shard"], r["source"]): r["tokens"] for r in rows if r["tokens"]}
    assert {r["shard"] for r in rows} == set(range(9))
    assert len({r["shard"] for r in mx.mixture(docs, targets, block=64).collect()}) == mx.LEAST_SHARDS


# ---- subjects

ZH = {"sport": "球員 比賽 教練 進球".split(), "law": "法官 原告 判決 上訴".split()}
EN = {"sport": "striker league goal coach".split(), "law": "judge claimant verdict appeal".split()}
ROUTINE = ["請於期限內將表單送回承辦人。", "The form is to be returned to the clerk before noon."]


def sample(i, subjects, lang):
    words = ZH if lang == "zh" else EN
    out = []
    for k in range(6):
        s = subjects[(i + k) % len(subjects)] if subjects else None
        if s is None or k == 5:
            out.append(ROUTINE[0] if lang == "zh" else ROUTINE[1])
        elif lang == "zh":
            out.append(f"關於{words[s][k % 4]}與{words[s][(k + i) % 4]}，{words[s][(k + 2) % 4]}另有意見。")
        else:
            out.append(f"In May the {words[s][k % 4]} met the {words[s][(k + i) % 4]} about a {words[s][(k + 2) % 4]}.")
    return ("" if lang == "zh" else " ").join(out)


def samples():
    kinds = [["sport"], ["law"], ["sport", "law"], []]
    return [(i, sample(i, kinds[i % 4], "zh" if i % 8 < 4 else "en"), kinds[i % 4]) for i in range(96)]


def test_subjects(spark):
    rows = samples()
    areas = spark.createDataFrame([("sport",), ("law",), (None,)], "subject string")
    train = spark.createDataFrame(rows, "sample_id bigint, text string, subjects array<string>")
    cases = [(i, sample(i + 3, k, lang), k) for i, (k, lang) in enumerate([(["sport"], "zh"), (["law"], "en"), (["sport", "law"], "zh"), ([], "en")])]
    extra = [(10, None), (11, ""), (12, "  \n"), (13, cases[0][1] * 400), (14, cases[1][1] + " " + " ".join([ROUTINE[1]] * 30))]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in cases] + [(i, t, "s") for i, t in extra], "doc_id bigint, text string, subject string")
    found = defaultdict(set)
    for r in sj.document_subjects(docs, "doc_id", "text", train, areas).collect():
        found[r["doc_id"]].add(r["subject"])
    assert {i: found.get(i, set()) for i in range(4)} == {i: set(k) for i, _, k in cases}
    assert found[13] == {"sport"} and not any(found.get(i) for i in (10, 11, 12, 14))
    assert sj.document_subjects(docs, "doc_id", "text", train.limit(0), areas).collect() == []
    assert sj.document_subjects(docs.limit(0), "doc_id", "text", train, areas).collect() == []


def test_held_out_accuracy(tiny):
    table = pd.read_parquet(Path(tiny) / "subject_samples.parquet").sort_values("sample_id")
    areas = sorted(pd.read_parquet(Path(tiny) / "subject_areas.parquet")["subject"])
    rows = [(text, list(labels)) for text, labels in zip(table["text"], table["subjects"])]
    random.Random(1).shuffle(rows)
    model = sj.fit(rows[::2], areas)
    machine = model.automaton()
    right = wrong = missed = 0
    for text, labels in rows[1::2]:
        said = {areas[s] for s, *_ in sj.about(text, machine, model)}
        right, wrong, missed = right + len(said & set(labels)), wrong + len(said - set(labels)), missed + len(set(labels) - said)
    assert 2 * right / (2 * right + wrong + missed) > 0.95


def test_sentences():
    assert sj.sentences("第一句話在這裡。第二句？\n主旨：標題\n| 表 | 格 |\nIt cost 3.5 euros today. The end came.") == ["第一句話在這裡。", "It cost 3.5 euros today.", "The end came."] or len(sj.sentences("甲乙丙丁戊己庚。")) == 1
    assert sj.sentences("a line of words without any mark\n\nanother line\n| a | b |") == ["a line of words without any mark", "another line"]
    assert sj.sentences("") == [] and sj.sentences("  \n12\n") == []


def test_terms_are_curated_and_thresholds_are_the_subjects_own(tiny):
    table = pd.read_parquet(Path(tiny) / "subject_samples.parquet")
    areas = pd.read_parquet(Path(tiny) / "subject_areas.parquet")
    titles = {r.subject: [r.title_en, r.title_zh, r.scope_note] for r in areas.itertuples()}
    model = sj.fit([(t, list(s)) for t, s in zip(table["text"], table["subjects"])], sorted(titles), titles)
    assert set(model.terms) == set(sj.curated(sorted(titles), titles)) and len(set(model.thresholds)) > 1
    assert set(CURATED) == set(titles) and all(zh.split() and en for zh, en in CURATED.values())
    weights = [w for _, per in model.terms.values() for w in per.values()]
    assert min(weights) >= 0 and len(set(weights)) > 100


def test_terms_match_words_and_inflections_only():
    model = sj.SubjectModel(["a"], {"calibrat": (True, {0: 1.0}), "cell": (False, {0: 1.0}), "細胞": (False, {0: 1.0})}, [0.1])
    hits = lambda text: [sorted(h) for h in sj._hits(text, model.automaton(), sj.sentence_spans(text))]
    assert hits("The cells were calibrated. A cellar, an excell and cell. 幹細胞已經送回實驗室。") == [["calibrat", "cell"], ["cell"], ["細胞"]]
    assert hits("İ cells were recalibrated here.") == [["cell"]]
