"""Personal data on cases made here, with a field trained on a small corpus made here."""

import random
import re

import pytest

from foliospark.llm import personal as p

RNG = random.Random(7)
GIVEN = "明華英傑文玉志雅婷君豪宜芳"
NAMES = [s + "".join(RNG.sample(GIVEN, 2)) for s in "王李張陳林佘駱甄" for _ in range(6)]


def national(k):
    for digit in range(10):
        number = f"A1{k % 10**7:07d}{digit}"
        if p.valid_national(number):
            return number
    raise AssertionError


def training():
    for name in NAMES:
        yield f"姓名：{name}\n申請人：{name}，手機 0912-{RNG.randint(100, 999)}-{RNG.randint(100, 999)}\n業務由{name}經理承辦。\n流程說明與時程安排如下。"
        yield f"Dear Ms. Alice Marlow,\nThe report of Hallam Services was filed.\nSigned by Alice Marlow at No. 5, Oak Road, Leeds"


@pytest.fixture(scope="module")
def finder():
    return p.PersonalData(p.train(training()))


GOOD = national(1234567)
FOUND = [
    ("請洽 x.y+z@mail.co 或 ops(at)site.org", {("email", "x.y+z@mail.co"), ("email", "ops(at)site.org")}),
    ("寄 info＠site.org", {("email", "info＠site.org")}),
    ("電話：(02) 2345-6789", {("phone", "(02) 2345-6789")}),
    ("手機 0912 345 678，國外 +44 1632 960417", {("phone", "0912 345 678"), ("phone", "+44 1632 960417")}),
    ("致電 001 44 1632 960 417", {("phone", "001 44 1632 960 417")}),
    (f"身分證字號：{GOOD}", {("id_number", GOOD)}),
    (f"證號 {GOOD[0]}-{GOOD[1:]}", {("id_number", f"{GOOD[0]}-{GOOD[1:]}")}),
    (f"身分證：{GOOD[:5]}​{GOOD[5:]}", {("id_number", f"{GOOD[:5]}​{GOOD[5:]}")}),
    ("Passport no. AB1234567 was issued to Ms. Alice Marlow.", {("id_number", "AB1234567"), ("person_name", "Alice Marlow")}),
    ("SSN 912-34-5678 was printed", {("id_number", "912-34-5678")}),
    ("健保卡號 000012345678 由王明華本人提供", {("id_number", "000012345678"), ("person_name", "王明華")}),
    ("設籍臺中市西屯區文心路二段12巷3弄45號6樓之7。", {("address", "臺中市西屯區文心路二段12巷3弄45號6樓之7")}),
    ("The parcel goes to Flat 6, 90 Oak Rd., Leeds.", {("address", "Flat 6, 90 Oak Rd., Leeds")}),
    ("Address: No. 25, Ln. 20, Oak Road, North Dist., Leeds City", {("address", "No. 25, Ln. 20, Oak Road, North Dist., Leeds City")}),
    ("Dear Mr. Bob T. Carver,", {("person_name", "Bob T. Carver")}),
    ("匯款帳號：06792867144462", set()), ("信用卡號 9464-7211-4213-0674", set()), ("流水號 A123456780 已入庫", set()), ("發票 QV-47053836 金額 NT$ 5,976。", set()), ("ISBN 979-0-1559-2447-6", set()),
    ("統一編號：04595257", set()), ("出生日期：1986/03/22", set()), ("Road works on section 36 take 5 weeks at Hallam Services.", set()), ("文心路改善工程共44號標的", set()),
    ("主機 192.0.2.137 版本 1.0.7", set()), ("《手機號碼#0912345678》與《姓名》", set()), ("", set()),
]


@pytest.mark.parametrize("text,expected", FOUND, ids=[t[:18] for t, _ in FOUND])
def test_found(finder, text, expected):
    assert {(kind, text[a:b]) for a, b, kind in finder.find(text)} == expected


def test_skip_edges_carry_a_name(finder):
    bare = "後續由陳玉婷複核，再送陳玉婷簽名。"
    model = p.Field(finder.model.weights, p.MOST_SKIP)
    introduced = "姓名：陳玉婷\n" + bare
    texts = [introduced[a:b] for a, b, kind in p.PersonalData(model).find(introduced) if kind == "person_name"]
    assert texts.count("陳玉婷") == 3


def test_message_passing_is_consistent():
    a, b = p.Node(0, 2, "person_name", "k", 4.0, ()), p.Node(9, 11, "person_name", "k", -1.0, ())
    p.PersonalData(p.Field({}, 3.0)).settle(nodes := [a, b])
    # two nodes with an agreement potential: exact marginals by enumeration
    import math

    weight = lambda x, y: math.exp(4 * x - y + 3 * x * y)
    exact = [math.log(sum(weight(1, y) for y in (0, 1)) / sum(weight(0, y) for y in (0, 1))), math.log(sum(weight(x, 1) for x in (0, 1)) / sum(weight(x, 0) for x in (0, 1)))]
    assert [n.belief for n in nodes] == pytest.approx(exact, abs=1e-6) and nodes[1].belief > 0


def test_check_digit():
    assert p.valid_national("A123456789") and not p.valid_national("A123456780") and not p.valid_national("1123456789") and not p.valid_national("")


RESULTS = "result_id bigint, structured_text string, display_text string, kind string, field_name string"


def test_columns(spark):
    rows = [(i, t, "《姓名》" if i % 2 else t, "k", "f") for i, t in enumerate(training())]
    rows += [(1000, "姓名：王明華\n王明華又來了，姓名：王明華", None, "k", "f"), (1001, None, "", "k", "f"), (1000, "姓名：王明華\n王明華又來了，姓名：王明華", None, "k", "f"), (1002, "說明" * 20_000 + " a@b.co", None, "", "")]
    findings = [(1, "EMAIL", "a@b.co"), (2, None, None), (3, "PERSON_NAME_FIELD", "如附件"), (4, "PASSPORT", "345368553"), (5, "BANK_ACCOUNT", "0756254082764"), (6, "TW_ADDRESS", "至臺中市西屯區文心路12號"), (1, "EMAIL", "a@b.co")]
    found = p.personal_data(spark.createDataFrame(rows, RESULTS), spark.createDataFrame(findings, "finding_id bigint, entity string, text string")).collect()
    got = {tuple(r) for r in found}
    assert len(got) == len(found)
    assert {r for r in got if r[1] >= 1000} == {("structured_text", 1000, "person_name", "王明華"), ("structured_text", 1002, "email", "a@b.co")}
    assert {r for r in got if r[0] == "finding_text"} == {("finding_text", 1, "email", "a@b.co"), ("finding_text", 4, "id_number", "345368553"), ("finding_text", 6, "address", "臺中市西屯區文心路12號")}


def test_masked_changes_nothing_else(spark, finder):
    text = "姓名：王明華  手機0912-345-678。\n尾 ﬁ"
    rows = {r["id"]: r["masked"] for r in p.masked(spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, t string"), "id", "t", finder.model).collect()}
    assert rows == {1: "姓名：[PERSON_NAME]  手機[PHONE]。\n尾 ﬁ", 2: None, 3: ""}


def test_empty(spark):
    empty = p.personal_data(spark.createDataFrame([], RESULTS), spark.createDataFrame([], "finding_id bigint, entity string, text string"))
    assert empty.collect() == []


def test_every_field_is_masked(spark):
    rows = [(i, t, None) for i, t in enumerate(training())] + [(1000, "電話：(02) 2345-6789", "寄 a@b.co"), (1000, "電話：(02) 2345-6789", "寄 a@b.co"), (1001, None, "")]
    results = spark.createDataFrame(rows, "result_id bigint, structured_text string, display_text string")
    findings = spark.createDataFrame([(1, "EMAIL", "a@b.co"), (2, None, None), (4, "PASSPORT", "345368553"), (5, "BANK_ACCOUNT", "345368553"), (1, "EMAIL", "a@b.co")], "finding_id bigint, entity string, text string")
    made = p.masked_data(results, findings).collect()
    got = {(r["field_name"], r["row_id"]): r["masked"] for r in made}
    assert len(made) == len(got) == 2 * (len(rows) - 1) + 4
    assert got["structured_text", 1000] == "電話：[PHONE]" and got["display_text", 1000] == "寄 [EMAIL]"
    assert got["structured_text", 1001] is None and got["display_text", 1001] == ""
    snippets = {k: v for (name, k), v in got.items() if name == "finding_text"}
    assert snippets == {1: "[EMAIL]", 2: None, 4: "[ID_NUMBER]", 5: "345368553"}


# ---- the field: what is learned, what edges add

OWN = [a + b for a in "沅璟霽漾笙峤" for b in "稷芮蔚苓粲昀"]
UNLABELLED = ("茲派{}前往現場量測。", "會議改由{}代打卡，餘照舊。", "隨函附上{}存查聯。")


def office(rng, name, lines):
    filler = ["流程與時程安排如下。", "文件已存檔，餘不贅述。", "毛利率較去年增加三成。", "馬拉松路線改為河濱公園。", "本季報告已送出。"]
    return "\n".join(rng.sample(filler, 2) + [line.format(name) for line in lines])


def labelled_corpus(rng, n=300):
    """Texts whose detector replaced the names after labels and left the bare ones."""
    for _ in range(n):
        name = rng.choice("桑闕褚戚邵殷") + rng.choice(OWN)
        lines = ["姓名：{}", rng.choice(UNLABELLED)] if rng.random() < 0.7 else ["申請人：{}", "立書人：{}"]
        text = office(rng, name, lines)
        yield text, re.sub(f"(?<=[名人]：){name}", "《姓名》", text)


@pytest.fixture(scope="module")
def learned():
    return p.train(labelled_corpus(random.Random(3)))


def recall(model, texts):
    finder = p.PersonalData(model)
    right = total = 0
    for text, name in texts:
        places = {m.start() for m in re.finditer(name, text)}
        total += len(places)
        right += len(places & {a for a, b, kind in finder.find(text) if kind == "person_name" and text[a:b] == name})
    return right / total


def test_names_without_any_listed_label_are_found(learned):
    rng = random.Random(5)
    texts = [(office(rng, name, [rng.choice(UNLABELLED)]), name) for name in (rng.choice("桑闕褚戚邵殷") + rng.choice(OWN) for _ in range(200))]
    assert recall(learned, texts) >= 0.95
    assert recall(p.Field(), texts) < 0.2  # by cues alone they are not
    found = [text[a:b] for text, _ in texts for a, b, _ in p.PersonalData(learned).find(text)]
    assert sum(len(f) == 3 and f[1:] in OWN for f in found) >= 0.97 * len(found)


def test_skip_edges_are_worth_recall_on_unseen_templates(learned):
    rng = random.Random(6)
    unseen = ["旋即{}，竟遲未回覆。", "幸得{}、亦未反對。"]
    names = ["賴" + rng.choice("慧達怡") + rng.choice("珮錚綺") for _ in range(150)]  # of parts no training text has
    texts = [(office(rng, name, ["姓名：{}", *unseen]), name) for name in names]
    bare = p.Field(learned.weights, 0.0)
    assert recall(learned, texts) >= 0.95 and recall(learned, texts) - recall(bare, texts) >= 0.3


def test_similar_names_share_a_potential():
    nodes = [p.Node(0, 3, "person_name", "邵沅霽", 4.0, ()), p.Node(20, 23, "person_name", "邵沅露", -0.4, ()), p.Node(40, 43, "person_name", "闕笙笙", -0.4, ()), p.Node(60, 65, "phone", "0", 1.0, ())]
    p.PersonalData(p.Field({}, 3.0)).settle(nodes)
    assert nodes[1].belief > 0 > nodes[2].belief


def test_of_overlapping_nodes_one_holds():
    make = lambda: [p.Node(0, 3, "person_name", "a", 5.0, ()), p.Node(2, 6, "person_name", "b", 4.9, ()), p.Node(1, 4, "phone", "c", 4.8, ()), p.Node(10, 13, "person_name", "d", 2.0, ())]
    p.PersonalData(p.Field({}, 3.0)).settle(nodes := make())
    assert [n.belief > 0 for n in nodes] == [True, False, False, True]
    # a node elsewhere of equal content decides between alternatives
    nodes = [*make(), p.Node(30, 34, "person_name", "b", 6.0, ())]
    p.PersonalData(p.Field({}, 3.0)).settle(nodes)
    assert [n.belief > 0 for n in nodes] == [False, True, False, True, True]


def test_labels_from_the_displayed_form():
    text = "姓名：邵沅霽，電話 02-2345-6789 帳號 12345678901"
    shown = "姓名：《姓名》，電話 《市話號碼#0a1b2c3d》 帳號 《銀行帳號》"
    assert [(text[a:b], label) for a, b, label in p.labelled_spans(text, shown)] == [("邵沅霽", "姓名"), ("02-2345-6789", "市話號碼"), ("12345678901", "銀行帳號")]
    for other in (None, text, "", "另一份《姓名》", "姓名：《姓名》《地址》，", text + "《姓名》"):
        assert p.labelled_spans(text, other) == []
    spans = p.labelled_spans(text, shown)
    node = lambda a, b, kind: p.Node(a, b, kind, "", 0.0, ())
    at = text.index
    assert p._label(node(3, 6, "person_name"), spans, int) == 1 and p._label(node(at("02"), at("02") + 12, "phone"), spans, int) == 1
    assert p._label(node(at("1234567890"), len(text), "phone"), spans, int) == 0 and p._label(node(0, 2, "person_name"), spans, int) is None


def test_labels_outweigh_cues():
    rng = random.Random(2)
    rows = []
    for _ in range(200):  # what follows this word is a card, whatever it looks like
        number = f"09{rng.randrange(10**8):08d}"
        rows.append((f"會員代碼 {number} 已建檔", "會員代碼 《信用卡號》 已建檔"))
        rows.append((f"手機 {number}", "手機 《手機號碼》"))
    finder = p.PersonalData(p.train(rows))
    assert finder.find("會員代碼 0911222333 已建檔") == [] and len(finder.find("手機 0911222333")) == 1
    assert len(p.PersonalData(p.Field()).find("會員代碼 0911222333 已建檔")) == 1
