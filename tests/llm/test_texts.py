"""Spelling, encoding and scans on small corpora made here."""

import difflib
import random

import pytest

from foliospark.llm import garble, lookalike, scans
from foliospark.llm.charstats import character_costs

RNG = random.Random(11)
NOUNS = "會議 紀錄 契約 工程 學生 醫師 報告 預算 電話 地址 公司 部門 日期 編號 附件 申請 內容 結果 意見 時間".split()
WORDS = "the report meeting contract engineer student doctor budget office date number appendix result opinion time quarter letter between further certain".split()


def zh(n=6):
    return "".join("".join(RNG.choice(NOUNS) for _ in range(4)) + "，請於" + RNG.choice(NOUNS) + "前辦理。" for _ in range(n))


def en(n=6):
    return " ".join(" ".join(RNG.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(n))


def corpus():
    return [zh() for _ in range(60)] + [en() for _ in range(60)]


def frame(spark, texts, extra="r"):
    return spark.createDataFrame([(i, t, extra, extra) for i, t in enumerate(texts)], "result_id bigint, structured_text string, restored string, kinds string")


# ---- encoding


WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("big5", "latin-1"), ("big5", "gbk"), ("utf-8", "gbk")]


def garbled(text, written, read):
    raw = text.encode(written)
    return raw.decode(read, "folio_controls" if read == "cp1252" else "strict")


def test_restores_what_can_be_restored(spark):
    base = corpus()
    passages = {"en": "The façade cost €45 – the owner’s café agreed.", "zh": zh(2)}
    cases = []
    for written, read in WRONG:
        for kind, text in passages.items():
            try:
                raw = text.encode(written)
                wrong = "".join(chr(b) if read in ("cp1252", "cp1251") and not _decodes(bytes([b]), read) else bytes([b]).decode(read) for b in raw) if read not in ("gbk",) else raw.decode(read)
            except UnicodeError:
                continue
            if read == "cp1251" and "\x98" in wrong:
                continue
            cases.append((wrong, text))
    texts = base + [f"{zh(1)}\n{wrong}\n{zh(1)}" for wrong, _ in cases]
    rows = {r["result_id"]: r for r in garble.repair_encoding(frame(spark, texts), "result_id", "structured_text").collect()}
    assert not any(rows[i]["affected"] for i in range(len(base)))
    found = [rows[len(base) + i] for i in range(len(cases))]
    assert all(r["affected"] for r in found)
    right = sum(text in r["restored"] for r, (_, text) in zip(found, cases))
    assert right >= len(cases) - 2 and len(cases) >= 8


ESCAPED = {
    "備註 \\u8acb\\u65bc\\u671f\\u9593 三樓": ("備註 請於期間 三樓", ["unescape"]),
    "附件 &#35531;&#26044;&#26371;&#35696; 完": ("附件 請於會議 完", ["unescape"]),
    "the caf&eacute; agreed": ("the café agreed", ["unescape"]),
    "內容 %E8%AB%8B%E6%96%BC%E6%9C%83%E8%AD%B0。": ("內容 請於會議。", ["unescape"]),
    "the na&Atilde;&macr;ve result": ("the naïve result", ["unescape", "encode cp1252", "decode utf-8"]),
    "the na&#195;&#175;ve result": ("the naïve result", ["unescape", "encode cp1252", "decode utf-8"]),
}
#: Escapes in their right place, or of nothing but ASCII.
NOT_GARBLED = ["see https://www.example.com/%E8%AB%8B%E6%96%BC?a=1", "profit &amp; loss of 5%20 and 100%", "path C:\\users\\u12 and R&D; done"]


def test_escapes_are_restored(spark):
    texts = [*corpus(), *ESCAPED, *NOT_GARBLED]
    rows = {r["result_id"]: r for r in garble.repair_encoding(frame(spark, texts), "result_id", "structured_text").collect()}
    start = len(texts) - len(ESCAPED) - len(NOT_GARBLED)
    for i, (text, (right, path)) in enumerate(ESCAPED.items()):
        row = rows[start + i]
        assert row["affected"] and row["restored"] == right, text
        assert [p["path"] for p in row["passages"]] in ([path], [[path[0], "encode latin-1", *path[2:]]]), text
    assert not any(rows[len(texts) - 1 - i]["affected"] for i in range(len(NOT_GARBLED)))


def test_rounds_are_not_limited(spark):
    text = "naïve café"
    for _ in range(4):
        text = text.encode().decode("latin-1")
    rows = garble.repair_encoding(frame(spark, [*corpus(), f"a {text} b"]), "result_id", "structured_text").collect()
    found = next(r for r in rows if r["affected"])
    assert found["restored"] == "a naïve café b" and len(found["passages"][0]["path"]) == 8


def test_two_rounds_of_different_encodings(spark):
    text = "請於會議前辦理，契約工程報告"
    wrong = text.encode("big5").decode("latin-1").encode().decode("latin-1")
    rows = garble.repair_encoding(frame(spark, [*corpus(), f"a\n{wrong}\nb"]), "result_id", "structured_text").collect()
    assert next(r for r in rows if r["affected"])["restored"] == f"a\n{text}\nb"


def _decodes(raw, name):
    try:
        raw.decode(name)
        return True
    except UnicodeDecodeError:
        return False


def test_double_and_lost(spark):
    twice = "naïve café".encode().decode("cp1252").encode().decode("cp1252")
    texts = [*corpus(), f"a {twice} b", "lost � here", "Foreign words: Москва, Αθήνα, カタログ, naïve, lǜchá and 5° C.", None, "", "表單" * 30_000]
    rows = {r["result_id"]: r for r in garble.repair_encoding(frame(spark, texts), "result_id", "structured_text").collect()}
    double, lost, foreign, null, empty, long = (rows[len(texts) - 6 + i] for i in range(6))
    assert double["restored"] == "a naïve café b" and double["passages"][0]["path"][-1] == "decode utf-8"
    assert lost["affected"] and lost["lost"] == 1 and lost["restored"] == "lost � here"
    assert not foreign["affected"] and not null["affected"] and null["restored"] is None and empty["restored"] == "" and not long["affected"]
    assert garble.garbled_ids(frame(spark, []), "result_id", "structured_text").collect() == []
    assert character_costs(frame(spark, []), "structured_text") == {}


# ---- spelling


SPELLED = {
    "Ｆｕｌｌ width": ("Full width", ["full_width"]),
    "mail a＠b": ("mail a@b", ["full_width"]),
    "café au lait": ("café au lait", ["accent"]),
    "no break": ("no break", ["space"]),
    "zero​width﻿": ("zerowidth", ["widthless"]),
    "發⽂⽇期 ﬁle 年": ("發文日期 file 年", ["compatibility"]),
    "the rероrt is": ("the report is", ["lookalike"]),
    "Тhе date": ("The date", ["lookalike"]),
    "the budgеtоffice": ("the budgetoffice", ["lookalike"]),
    "odd Zуqqх word": ("odd Zуqqх word", ["suspected"]),
}
ORDINARY = ["全形，標點。　空格", "“quotes” – dash", "Москва Київ Αθήνα", "β and Ω and 5 µm", "👩‍💻 👨‍👩‍👧", "naïve café", "１２３", "", None]


def test_spelling(spark):
    texts = [*corpus(), *SPELLED, *ORDINARY]
    rows = {r["result_id"]: r for r in lookalike.consistent_spelling(frame(spark, texts), "result_id", "structured_text").collect()}
    start = len(texts) - len(SPELLED) - len(ORDINARY)
    got = {t: (rows[start + i]["spelling"], rows[start + i]["kinds"]) for i, t in enumerate(SPELLED)}
    assert got == SPELLED
    assert set(rows) == set(range(start, start + len(SPELLED)))
    ids = [r[0] for r in lookalike.misspelled_ids(frame(spark, texts), "result_id", "structured_text").collect()]
    assert sorted(ids) == sorted(i for i, r in rows.items() if r["kinds"] != ["suspected"]) and len(ids) == len(rows) - 1


def test_garbled_passages_are_left_alone(spark):
    wrong = "naïve café résumé".encode().decode("cp1252")
    texts = [*corpus(), f"note: {wrong}", f"Ｎｏｔｅ: {wrong}"]
    rows = {r["result_id"]: r for r in lookalike.consistent_spelling(frame(spark, texts), "result_id", "structured_text").collect()}
    assert set(rows) == {len(texts) - 1} and rows[len(texts) - 1]["spelling"] == f"Note: {wrong}"
    assert lookalike.misspelled_ids(frame(spark, []), "result_id", "structured_text").collect() == []


def test_dominant_script():
    assert lookalike.dominant("plain") is None and lookalike.dominant("Москва") is None
    assert lookalike.dominant("Мocквa") == "cyrillic" and lookalike.spelled_in("Мocквa", "cyrillic") == "Москва"
    assert lookalike.dominant("dеsk") == "latin" and lookalike.mixed_tokens("Αthens") == {"Αthens": ["Athens"]}


# ---- scans


def scan_corpus():
    return [zh(12) for _ in range(40)] + [en(12) for _ in range(60)] + ["股份有限公司的期間與人員名單，土木工程未完成，日期如下。" * 3 for _ in range(30)]


SCANS = {
    "the con-\ntract was further between": ["hyphen"],
    "the engincer and the docfor met": ["misread"],
    "rnaybe vvith a c0ntract": ["misread"],
    "股份有眼公司的期問與入員名單": ["misread"],
    "共l2,3O4件": ["misread"],
    "## 第 1 頁\n\nACME FILES\ntext of one\n\n## 第 2 頁\n\nACME FILES\nmore text": ["header"],
    "## 第 1 頁\n\ntext of one\n- 1 -\n\n## 第 2 頁\n\nmore text\n- 2 -": ["page_no"],
    "甲公司　內部文件   1\n內容甲。\n內容乙。\n2   甲公司　內部文件\n內容丙。": ["header", "page_no"],
    "Page 3 of 9\nthe report": ["page_no"],
    "## 第 1 頁\n\nDear Ms. Doe,\nthe report\n\n## 第 2 頁\n\nDear Ms. Doe,\nthe result": [],
    "plain line\nbreaks of the report\nsee page 8 of 18 in the appendix.": [],
    "自己已經確認，土木與士官": [],
    "": [], "　": [],
}


@pytest.fixture(scope="module")
def lexicon_and_rows(spark):
    texts = [*scan_corpus(), *SCANS, None]
    start = len(texts) - len(SCANS) - 1
    df = spark.createDataFrame([(i, t, "pdf_scanned" if i >= start else "word", "n") for i, t in enumerate(texts)], "result_id bigint, structured_text string, doc_type string, noise string")
    return df, start


def test_scanned_noise(spark, lexicon_and_rows):
    df, start = lexicon_and_rows
    found = {}
    for r in scans.scanned_noise(df, "result_id", "structured_text", "doc_type").collect():
        found.setdefault(r["result_id"] - start, []).append(r["noise"])
    got = {t: sorted(found.get(i, [])) for i, t in enumerate(SCANS)}
    assert got == SCANS


def test_scanned_text(spark, lexicon_and_rows):
    df, start = lexicon_and_rows
    rows = {r["result_id"] - start: r["repaired"] for r in scans.scanned_text(df, "result_id", "structured_text", "doc_type").collect()}
    fixed = {t: rows[i] for i, t in enumerate(SCANS)}
    texts = list(SCANS)
    assert fixed[texts[0]] == "the contract was further between"
    assert fixed[texts[1]] == "the engineer and the doctor met"
    assert fixed[texts[3]] == "股份有限公司的期間與人員名單" and fixed[texts[4]] == "共12,304件"
    assert "ACME" not in fixed[texts[5]] and "- 1 -" not in fixed[texts[6]]
    assert rows[len(SCANS)] is None


def test_page_numbers():
    for line in ("3", "- 3 -", "[12]", "第 l 頁", "第 2 頁，共 5 頁", "Pa9e 2 of 4", "P.7", "3/9", "～4～", "* 5 *"):
        assert scans.is_page_number(line), line
    for line in ("", "2024-01-02", "請參閱第 7 頁", "12 件", "3.5.1.2", "see page 3", "a"):
        assert not scans.is_page_number(line), line


def test_word_cost():
    assert scans.word_cost("vvith", "with") == pytest.approx(0.2) and scans.word_cost("modem", "modern") == pytest.approx(0.2)
    assert scans.word_cost("cat", "dog") > 2 and scans.word_cost("same", "same") == 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], "result_id bigint, structured_text string, doc_type string")
    assert scans.scanned_noise(df, "result_id", "structured_text", "doc_type").collect() == []


def test_rare_right_words_repair_misreadings_in_large_corpora(spark):
    # so many other words and windows that a share of all occurrences would leave the right ones out
    filler = ["a " * 2_500_000] * 2 + ["日 " * 2_500_000]
    right = ["the engineer met us"] * 100 + ["土木工程"] * 10
    rows = [(-1 - i, t, "text") for i, t in enumerate(filler + right)]
    rows += [(1, "an engincer met us", "image"), (2, "見土本工程", "image"), (3, "the engineer met us", "image"), (4, "見土木工程", "image")]
    df = spark.createDataFrame(rows, "result_id bigint, structured_text string, doc_type string")
    assert {tuple(r) for r in scans.scanned_noise(df, "result_id", "structured_text", "doc_type").collect()} == {(1, "misread"), (2, "misread")}
    fixed = {r["result_id"]: r["repaired"] for r in scans.scanned_text(df, "result_id", "structured_text", "doc_type").collect()}
    assert fixed == {1: "an engineer met us", 2: "見土木工程", 3: "the engineer met us", 4: "見土木工程"}


def test_answers_do_not_hang_on_the_bitmap(spark, monkeypatch, lexicon_and_rows):
    df, _ = lexicon_and_rows
    expected = {tuple(r) for r in scans.scanned_noise(df, "result_id", "structured_text", "doc_type").collect()}
    monkeypatch.setattr(scans, "bitmap", lambda answers: b"\xff" * (scans.BITS // 8))
    assert {tuple(r) for r in scans.scanned_noise(df, "result_id", "structured_text", "doc_type").collect()} == expected


def test_header_variants_far_apart(spark):
    """A header misread beyond the known pairs, with many other lines at page edges before it."""
    head = "ANNUAL INSPECTION OF THE NORTHERN DEPOT"
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(5))
    top = {1: head, 40: "ANNUAL INSPEKTION QF THE NORTHERN DEPQT"}
    pages = [f"## 第 {k} 頁\n\n{top.get(k) or line()}\n{line()}\n{line()}" for k in range(1, 41)]
    page = scans.layout("\n\n".join(pages))
    assert page.header and [line for line, kind in zip(page.lines, page.kinds) if kind == "header"] == [head, "ANNUAL INSPEKTION QF THE NORTHERN DEPQT"]


def test_variants_miss_none():
    rng = random.Random(4)
    keys = []
    for _ in range(60):
        base = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 40)))
        keys.append(base)
        for _ in range(2):
            chars = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 10))):
                k = rng.randrange(len(chars))
                chars[k : k + 1] = rng.choice([["z"], [], [chars[k], "y"]])
            keys.append("".join(chars))
    alike = {(a, b) for b in range(len(keys)) for a in range(b) if abs(len(keys[a]) - len(keys[b])) <= 2 and difflib.SequenceMatcher(None, keys[a], keys[b]).ratio() >= 0.9}
    found = set(scans._variants(keys))
    assert len(alike) > 60 and alike <= found and len(found) < len(keys) ** 2 / 8


def test_long_words_are_repaired(spark):
    word = "electroencephalographically"
    assert set(scans._deletes(word)) == {"<" + word[:11], ">" + word[-11:]} and len(list(scans._deletes("a" * 6000))) == 2
    assert set(scans._forms("x" + word)) & set(scans._deletes(word)) and set(scans._forms(word[:-1])) & set(scans._deletes(word))
    texts = [f"we measured it {word} once"] * 30 + [f"we measured it {word.replace('graph', 'grapb')} once", f"we measured it {word} once"]
    df = spark.createDataFrame([(i, t, "image") for i, t in enumerate(texts)], "result_id bigint, structured_text string, doc_type string")
    assert [tuple(r) for r in scans.scanned_noise(df, "result_id", "structured_text", "doc_type").collect()] == [(30, "misread")]
    fixed = scans.scanned_text(df, "result_id", "structured_text", "doc_type").filter("result_id = 30").first()["repaired"]
    assert fixed == texts[0]
