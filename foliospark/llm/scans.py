"""Problem 5: text of scanned pages made continuous and readable again.

Running headers and footers, printed page numbers, words broken over two lines and misread
characters are found and repaired, and the lines of a paragraph joined. Misreadings are judged
against a lexicon of the whole corpus: words in Latin script, and windows of three characters around
every ideograph that has a double. A symmetric-delete index (each entry under every form with one
character left out) yields the entries one edit away; a weighted edit distance, cheap for pairs that
scanners confuse, keeps the likely ones, and their frequency and that of the word pairs around
decide. For ideographs the entries are the windows, and the form that both sides meet under is the
window with its ideograph left out; only pairs that scanners confuse are candidates. Digits read as letters
inside a number need no lexicon.

The lexicon holds every entry counted ``LEAST_COUNT`` times and stays a distributed table. The scanned
texts say which words (between their neighbours) and ideographs (with two characters on either side)
they ask about; each such question is answered once, by joins with the index and the counts. Only a bitmap
of the questions answered with a repair is broadcast; it spares most texts the join of the answers, and
what it lets through by chance finds no answer there.

No noise: the headings ``## 第 N 頁``, greetings, mentions of pages inside sentences, plain line breaks.

Defined cases: null and empty texts have no noise and stay as they are; a header must stand at least
twice in the text; redelivered rows give the same noise and count once.
"""

from __future__ import annotations

import difflib
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow import broadcast, map_rows

SCANNED = ("pdf_scanned", "pdf_mixed", "image")
#: How often an entry of the lexicon must have been counted.
LEAST_COUNT = 3
#: How much more frequent the repair must be than what was read, and the dearest edit.
TIMES, DEAREST = 8, 0.72
#: A word that is itself frequent (of this share of all words; a misreading may be) must be so much rarer, also between its neighbours.
KNOWN_SHARE, TIMES_KNOWN, TIMES_BETWEEN = 5e-6, 40, 8
#: Windows of three characters that must speak for another ideograph.
LEAST_EVIDENCE = 5
#: Bits of the bitmap of answered questions, and of each piece in which it is made.
BITS, PIECE_BITS = 1 << 26, 1 << 16

# What scanners take for one another; the first of each pair is what tends to be read.
CONFUSED_IDEOGRAPHS = "己已 己巳 末未 曰日 入人 入八 問間 貟員 靣面 杳查 眼限 木本 科料 犬大 太大 犬太 尸戶 士土 干千 于千 干于 夭天 田由 田甲 母毋 侯候 毫亳 折拆 折析 冶治 今令 代伐 佳住 住往 刀力 九丸 王玉 王主 玉主 午牛 免兔 徒徙 微徵 待侍 持特 技枝 抹抺 栽裁 烏鳥 睛晴 撒撤 辨辯 賣買 遣遺 弊幣 壁璧 斤斥 子予 子孑 弋戈 戌戍 戊戌 汨汩 淮准 爪瓜 貝見 貝具 皿血 目自 白自 日目 早旱 旦且 名各 古吉 石右 困因 困囚 哀衰 署暑 棟楝 崇祟 密蜜 根很 億憶 培倍 失矢 夫天 夫失 元无 无天 內肉 勿物 毛手 手于 卯印 卬印 卜上 丁了 丈文 叉又 又叉 口囗 吏更 昔皆 宣宜 官宮 宮官 客容 帥師 師帥 慕幕 慕暮 昧味 未朱 來耒 比此 氷水 永水 沒役 泊洎 注往 深探 清請 請清 猶獨 獨濁 祖袓 祟崇 科枓 積債 績積 續績 縣懸 聞間 間聞 開問 閉閑 閑間 隊除 除徐 陪部 項頂 頂項 須預 預須 領頒 題頡 風鳳 魚漁 鬥門"
CONFUSED_LETTERS = {("0", "o"): 0.2, ("1", "l"): 0.2, ("1", "i"): 0.2, ("!", "i"): 0.2, ("!", "l"): 0.2, ("|", "l"): 0.2, ("|", "i"): 0.2, ("5", "s"): 0.25, ("8", "b"): 0.3, ("6", "b"): 0.35, ("9", "g"): 0.25, ("c", "e"): 0.3, ("e", "c"): 0.35, ("b", "h"): 0.3, ("h", "b"): 0.35, ("f", "t"): 0.3, ("t", "f"): 0.35, ("i", "l"): 0.3, ("l", "i"): 0.3, ("u", "n"): 0.4, ("n", "u"): 0.4, ("a", "o"): 0.5, ("o", "a"): 0.5, ("m", "rn"): 0.2, ("rn", "m"): 0.2, ("vv", "w"): 0.2, ("w", "vv"): 0.25, ("d", "cl"): 0.3, ("cl", "d"): 0.25, ("h", "li"): 0.35, ("li", "h"): 0.3, ("nn", "m"): 0.4, ("ii", "u"): 0.4, ("y", "v"): 0.5, ("v", "y"): 0.5, ("q", "g"): 0.4, ("g", "q"): 0.4, ("2", "z"): 0.35, ("s", "5"): 0.4, ("ri", "n"): 0.45, ("n", "ri"): 0.4, ("rn", "nn"): 0.35, ("nn", "rn"): 0.35, ("j", "i"): 0.45}

_DOUBLES: dict[str, set[str]] = defaultdict(set)
for _pair in CONFUSED_IDEOGRAPHS.split():
    _DOUBLES[_pair[0]].add(_pair[1])
    _DOUBLES[_pair[1]].add(_pair[0])
_DOUBTFUL = re.compile("[" + "".join(_DOUBLES) + "]")
_WORD = re.compile("[A-Za-z0-9!]+(?:'[a-z]+)?")
#: Characters of no width, which cut a word for the patterns only.
_WIDTHLESS = ("\u200b", "\u200c", "\u200d", "\u2060", "\ufeff")
_PLAIN_WORD = re.compile("[a-z]+")
_EMAIL_LIKE = re.compile(r"\S*[@＠_/\\]\S*|\S+\.(?:example|test|com|org|net)\S*", re.I)
_HEADING = re.compile("## 第 [0-9]+ 頁$")
_NUMBER = re.compile("(?<![A-Za-z0-9@._])[0-9lIOo][0-9lIOo,./:-]*(?![A-Za-z0-9@_])")
_BROKEN = re.compile("([A-Za-z]{2,})[-‐‑¬­]\n((?:\n*## 第 [0-9]+ 頁\n+)?)\\s*([a-z]{2,})")
_EDGE_NUMBER = re.compile("^(?P<first>[0-9lIOo]{1,4})(?:\\s{2,}|[　\\t|])\\s*(?=\\S)|(?<=\\S)(?:\\s{2,}|[　\\t|])\\s*(?P<last>[0-9lIOo]{1,4})$")
_PAGE_NUMBER = re.compile(
    "(?:[-–—~～*＊•·\\[(（〔【<]{0,2} ?[0-9]{1,4} ?[-–—~～*＊•·\\])）〕】>]{0,2}|[0-9]{1,4} ?[/／] ?[0-9]{1,4}|[Pp][.． ]{0,2}[0-9]{1,4}|[Pp]a[g9q][ec] ?[0-9]{1,4}(?: ?(?:of|/|0f) ?[0-9]{1,4})?|第 ?[0-9]{1,4} ?[頁页](?:[，,、 /]{0,2}共 ?[0-9]{1,4} ?[頁页])?|[0-9]{1,4} of [0-9]{1,4})$"
)
_NO_HEADER = re.compile("(?:Dear|Yours|Best|Kind|Sincerely|順頌|此致|敬啟|敬上|謹啟|\\||#|[-*•] )|.{1,10}[:：]|.*[。.!?！？；;，,、:：…)）]$|[“「『\"]")


def _digits(text: str) -> str:
    """Letters read for digits as digits, where the piece has a digit."""
    if any(c.isdigit() for c in text):
        return re.sub("[lI|](?=[0-9 ]|$)|(?<=[0-9 ])[lI|]|^[lI|](?=[0-9 ])", "1", re.sub("(?<=[0-9 ])[oO]|[oO](?=[0-9])", "0", text))
    return re.sub("(?<![A-Za-z])[lI](?![A-Za-z])", "1", text)


def is_page_number(line: str) -> bool:
    """Whether a line is nothing but a printed page number, perhaps misread."""
    line = line.strip()
    return 0 < len(line) <= 24 and _PAGE_NUMBER.match(_digits(line)) is not None


_CANON = {c: min({c} | d) for c, d in _DOUBLES.items()} | {"0": "o", "O": "o", "1": "l", "I": "l", "i": "l", "!": "l", "|": "l", "5": "s", "8": "b", "9": "g", "c": "e", "h": "b", "t": "f", "u": "n"}


def _canon(line: str) -> str:
    """A form in which misread variants of a line are the same."""
    line = re.sub("rn|nn", "m", re.sub("vv", "w", line.lower()))
    return "".join(_CANON.get(c, c) for c in line if not c.isspace())


@dataclass
class Layout:
    """What each line of a text is: kind is text, heading, header, page_no or blank."""

    lines: list[str]
    kinds: list[str]
    header: bool = False
    page_no: bool = False


def layout(text: str) -> Layout:
    """Find page numbers and running headers."""
    lines = text.split("\n")
    kinds = ["blank" if not s.strip() else "heading" if _HEADING.match(s.strip()) else "page_no" if is_page_number(s) else "text" for s in lines]
    out = Layout(lines, kinds, page_no="page_no" in kinds)
    pages: list[list[int]] = [[]]
    for i, kind in enumerate(kinds):
        if kind == "heading":
            pages.append([])
        elif kind == "text":
            pages[-1].append(i)
    pages = [p for p in pages if p]
    several = len(pages) > 1
    at_edge = {i for p in pages for i in (*p[:2], *p[-2:])} if several else set()
    page_of = {i: k for k, p in enumerate(pages) for i in p}
    groups: dict[str, list[int]] = defaultdict(list)
    numbered: set[int] = set()
    for p in pages:
        for i in p:
            line = lines[i].strip()
            bare = _EDGE_NUMBER.sub("", line).strip()
            if bare != line:
                numbered.add(i)
            if 4 <= len(bare) <= 90 and not _NO_HEADER.match(bare):
                groups[_canon(bare)].append(i)
    edges = [(key, members) for key, members in groups.items() if len(key) > 7 and any(i in at_edge for i in members)]
    for a, b in _variants([key for key, _ in edges]):  # misread beyond the known pairs; only page edges are compared
        (key_a, members_a), (key_b, members_b) = edges[a], edges[b]
        if members_a and members_b and difflib.SequenceMatcher(None, key_a, key_b).ratio() >= 0.9:
            members_a += members_b
            members_b.clear()
    for members in groups.values():
        at = [i for i in members if i in at_edge] if several else []
        if len({page_of[i] for i in at}) >= 2:
            chosen = at
        elif len(members) >= 2 and not lines[members[0]].strip()[0].islower():
            chosen = members  # printed pages need not be those of the headings
        elif len(members) >= 2 and sum(i in numbered for i in members) >= 2:
            chosen = members
        else:
            continue
        out.header = True
        for i in chosen:
            kinds[i] = "header"
            out.page_no |= i in numbered
    return out


def _variants(keys: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs a < b of keys that may be at least 0.9 alike, from their common runs of three characters.

    Of keys with n and m characters at least 0.45 * (n + m) match in order. Between two matching blocks some
    character of either key does not match, which bounds the blocks; each loses two runs. So many runs the
    keys have in common, of which equal ones count as often as they occur.
    """
    holders: dict[str, list[int]] = defaultdict(list)
    for b, key in enumerate(keys):
        shared: Counter = Counter()
        runs = Counter(key[i : i + 3] for i in range(len(key) - 2))
        most = max(runs.values(), default=1)
        for run in runs:
            shared.update(holders[run])
            holders[run].append(b)
        for a, common in sorted(shared.items()):
            n, m = len(keys[a]), len(key)
            matching = math.ceil(0.45 * (n + m) - 1e-9)
            blocks = n + m - 2 * matching + 1
            if abs(n - m) <= 2 and common * most >= matching - 2 * blocks:
                yield a, b


def word_cost(read: str, meant: str, most: float = 2.0) -> float:
    """Weighted edit distance from what was read to what was meant."""
    n, m = len(read), len(meant)
    table = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            best = 9.0
            if i and j:
                best = table[i - 1][j - 1] + (0.0 if read[i - 1] == meant[j - 1] else CONFUSED_LETTERS.get((read[i - 1], meant[j - 1]), 1.0))
            if i:
                best = min(best, table[i - 1][j] + 1.0)
            if j:
                best = min(best, table[i][j - 1] + 1.0)
            for a, b in ((1, 2), (2, 1)):
                if i >= a and j >= b and (cost := CONFUSED_LETTERS.get((read[i - a : i], meant[j - b : j]))) is not None:
                    best = min(best, table[i - a][j - b] + cost)
            table[i][j] = best
    return table[n][m]


#: Letters of a word from which its ends stand for its deletion forms, and of such an end.
LONG_WORD, END = 24, 11


def _deletes(word: str) -> Iterator[str]:
    """The word and it with one character left out; of a long word its two ends, of which one edit leaves one whole."""
    if len(word) >= LONG_WORD:
        yield "<" + word[:END]
        yield ">" + word[-END:]
    if len(word) <= LONG_WORD + 2:
        yield word
        for i in range(len(word)):
            yield word[:i] + word[i + 1 :]


def _forms(read: str) -> set[str]:
    """What was read, and it with one confused pair put right, under every form with one character left out."""
    forms = {read}
    for a, b in CONFUSED_LETTERS if len(read) <= LONG_WORD + 2 else ():
        at = read.find(a)
        while at >= 0:
            forms.add(read[:at] + b + read[at + len(a) :])
            at = read.find(a, at + 1)
    return {less for form in forms for less in _deletes(form)}


class Asked:
    """Notes the questions of texts: a word between its neighbours, an ideograph among its neighbours."""

    def __init__(self) -> None:
        self.terms: set[tuple[str, str]] = set()

    def get(self, sort: str, term: str) -> str | None:
        self.terms.add((sort, term))
        return None


class Probed(Asked):
    """Notes the questions that may have an answer."""

    def __init__(self, bitmap: bytes):
        super().__init__()
        self.bitmap = bitmap

    def get(self, sort: str, term: str) -> str | None:
        bit = _bit(sort, term)
        if self.bitmap[bit >> 3] >> (bit & 7) & 1:
            self.terms.add((sort, term))
        return None


class Answers:
    """The answers to the questions of one text."""

    def __init__(self, answers: list[tuple[str, str]]):
        self.answers = dict(answers)

    def get(self, sort: str, term: str) -> str | None:
        return self.answers.get(sort + term)


def _bit(sort: str, term: str) -> int:
    return zlib.crc32((sort + term).encode()) & (BITS - 1)


def _normal(line: str) -> str:
    return re.sub("[0-9]", "9", line)


def _continuous(text: str) -> str:
    """Lines joined where ideographs meet, so that windows reach over line breaks."""
    return re.sub("(?<=[一-鿿，、])\n(?=[一-鿿，、。])", "", text)


def count(df: DataFrame, column: str, type_col: str) -> DataFrame:
    """sort, term, n: words (w), word pairs (p) and windows (c) of all texts; questions about words (t) and ideographs (x) of the scanned ones."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        counters: dict[str, Counter] = {sort: Counter() for sort in "wpc"}
        words, pairs, windows = counters.values()
        asked = Asked()
        scan = Scan(asked)

        def flush() -> Iterator[tuple]:
            for sort, counter in counters.items():
                yield from ((sort, term, n) for term, n in counter.items())
                counter.clear()
            yield from ((sort, term, 1) for sort, term in asked.terms)
            asked.terms.clear()

        for text, kind in rows:
            if not text:
                continue
            found = _PLAIN_WORD.findall(_EMAIL_LIKE.sub(" ", text).lower())
            words.update(found)
            pairs.update(f"{a} {b}" for a, b in zip(found, found[1:]))
            flat = _normal(_continuous(text))
            for m in _DOUBTFUL.finditer(flat):
                i = m.start()
                for a in (i - 2, i - 1, i):
                    if a >= 0 and len(window := flat[a : a + 3]) == 3:
                        windows[f"{i - a}{window}"] += 1
            if kind in SCANNED:
                scan.ask(text)
            if len(windows) + len(pairs) + len(asked.terms) > 1_000_000:
                yield from flush()
        yield from flush()

    counted = map_rows(df.select(column, type_col), run, "sort string, term string, n bigint", flush=16384).groupBy("sort", "term").agg(F.sum("n").alias("n"))
    return cut_lineage(counted.filter(F.col("sort").isin("t", "x") | (F.col("n") >= LEAST_COUNT)))


def _entries(counted: DataFrame, sort: str) -> DataFrame:
    return counted.filter(F.col("sort") == sort)


def _bit_length(column) -> Column:
    return F.when(column > 0, F.length(F.bin(column))).otherwise(0)


def word_answers(counted: DataFrame) -> DataFrame:
    """term, meant: the questions about words that have an answer."""
    words = _entries(counted, "w").select(F.col("term").alias("word"), "n")
    stats = words.agg(F.sum("n"), F.max("n")).first()
    known = max(LEAST_COUNT, int((stats[0] or 0) * KNOWN_SHARE))
    #: Words this frequent can be no misreading of any word.
    certain = max(known, (stats[1] or 0) // TIMES_KNOWN + 1)
    part = F.split("term", " ")
    asked = _entries(counted, "t").select("term", part[0].alias("before"), part[1].alias("read"), part[2].alias("after"))
    own = F.coalesce(F.col("n"), F.lit(0))
    reads = asked.select("read").distinct().join(words.withColumnRenamed("word", "read"), "read", "left").select("read", own.alias("own")).filter(F.col("own") < certain)

    def read_forms(rows: Iterable[tuple]) -> Iterator[tuple]:
        for read, n in rows:
            for form in _forms(read):
                yield form, read, n

    def word_forms(rows: Iterable[tuple]) -> Iterator[tuple]:
        for word, n in rows:
            for form in set(_deletes(word)):
                yield form, word, n

    def costs(rows: Iterable[tuple]) -> Iterator[tuple]:
        for read, n, word, times in rows:
            cost = word_cost(read, word)
            if 0 < cost <= DEAREST:
                yield read, n, word, times, cost

    index = words.filter((F.length("word") >= 3) & (F.col("n") >= TIMES * (LEAST_COUNT - 1)))
    near = map_rows(reads, read_forms, "form string, read string, own bigint").join(map_rows(index, word_forms, "form string, word string, n bigint"), "form")
    enough = F.when(F.col("own") >= known, TIMES_KNOWN * F.col("own")).otherwise(TIMES * F.greatest("own", F.lit(LEAST_COUNT - 1)))
    near = near.filter((F.col("word") != F.col("read")) & (F.col("n") >= enough) & (F.abs(F.length("word") - F.length("read")) <= 2))
    likely = map_rows(near.select("read", "own", "word", "n").distinct(), costs, "read string, own bigint, word string, n bigint, cost double")

    def pair(a: str, b: str, read: bool) -> Column:
        return F.struct(F.concat_ws(" ", a, b).alias("pair"), F.lit(read).alias("of_read"))

    meant = [pair("before", "word", False), pair("word", "after", False)]
    ways = F.when(F.col("own") >= known, F.array(*meant, pair("before", "read", True), pair("read", "after", True))).otherwise(F.array(*meant))
    asked = asked.join(likely, "read").select("term", "own", "word", F.col("n").alias("times"), "cost", F.inline(ways))
    pairs = _entries(counted, "p").select(F.col("term").alias("pair"), "n")
    found = asked.join(pairs, "pair", "left").groupBy("term", "own", "word", "times", "cost")
    said = F.coalesce(F.col("n"), F.lit(0))
    found = found.agg(F.sum(F.when(F.col("of_read"), 0).otherwise(said)).alias("context"), F.sum(F.when(F.col("of_read"), said).otherwise(0)).alias("own_context"))
    spoken = (F.col("own") < known) | (F.col("context") >= TIMES_BETWEEN * F.col("own_context") + LEAST_COUNT)
    score = F.least(F.lit(6.0), _bit_length(F.col("times")) / 3) + F.least(F.lit(4), _bit_length(F.col("context"))) - 6 * F.col("cost")
    best = found.filter(spoken).withColumn("score", score).filter("score > 0").groupBy("term").agg(F.max(F.struct("score", "word")).alias("best"))
    return best.select(F.concat(F.lit("t"), "term").alias("term"), F.col("best.word").alias("meant"))


def ideograph_answers(counted: DataFrame) -> DataFrame:
    """term, meant: the questions about ideographs that have an answer."""
    doubles = F.create_map(*[F.lit(x) for c, d in _DOUBLES.items() for x in (c, "".join(sorted(d)))])
    at = F.substring("term", 1, 1).cast("int")
    around = F.expr("substring(term, 2)")
    asked = _entries(counted, "x").select("term", at.alias("at"), around.alias("around"))
    asked = asked.withColumn("read", F.expr("substring(around, at + 1, 1)"))
    # a window is known by the place of its ideograph and the two characters beside it
    asked = asked.select("term", "read", F.explode(F.expr("""transform(filter(sequence(0, 2), d -> at >= d AND at - d + 3 <= length(around)),
        d -> concat(d, substring(around, at - d + 1, d), substring(around, at + 2, 2 - d)))""")).alias("beside"))  # fmt: skip
    windows = _entries(counted, "c").withColumn("d", F.substring("term", 1, 1).cast("int"))
    windows = windows.selectExpr("concat(d, substring(term, 2, d), substring(term, d + 3)) AS beside", "substring(term, d + 2, 1) AS char", "n")
    said = asked.join(windows, "beside").filter((F.col("char") == F.col("read")) | F.contains(doubles[F.col("read")], F.col("char")))
    said = said.groupBy("term", "read", "char").agg(F.sum("n").alias("total"), F.count("*").alias("ends"))
    other = F.col("char") != F.col("read")
    said = said.groupBy("term").agg(F.max(F.when(other, F.struct("total", "ends", "char"))).alias("best"), F.max(F.when(~other, F.col("total"))).alias("own"))
    total = F.col("best.total")
    own = F.greatest(F.coalesce("own", F.lit(0)), F.lit(LEAST_COUNT - 1))
    sure = (total >= LEAST_EVIDENCE) & (total >= TIMES * own) & ((F.col("best.ends") >= 2) | (total >= 20 * LEAST_COUNT))
    return said.filter(sure).select(F.concat(F.lit("x"), "term").alias("term"), F.col("best.char").alias("meant"))


def bitmap(answers: DataFrame) -> bytes:
    """The bits of all terms; it has ``BITS`` bits whatever their number."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        pieces: dict[int, bytearray] = defaultdict(lambda: bytearray(PIECE_BITS // 8))
        for piece, bit in rows:
            pieces[piece][bit >> 3] |= 1 << (bit & 7)
        for piece, bits in pieces.items():
            yield piece, bytes(bits)

    bit = F.crc32(F.encode("term", "utf-8")).bitwiseAND(BITS - 1)
    bits = answers.select((bit / PIECE_BITS).cast("int").alias("piece"), (bit % PIECE_BITS).cast("int").alias("bit")).distinct().repartition("piece")
    out = bytearray(BITS // 8)
    for r in map_rows(bits, run, "piece int, bits binary", flush=64).toLocalIterator():
        out[r["piece"] * PIECE_BITS // 8 : (r["piece"] + 1) * PIECE_BITS // 8] = r["bits"]
    return bytes(out)


class Scan:
    """Finds and repairs the noise of one text."""

    def __init__(self, lex: Asked | Answers):
        self.lex = lex

    def ask(self, text: str) -> None:
        """Put every question about the text, whatever its layout."""
        self.ideographs(text)
        for line in text.split("\n"):
            self.words(line)

    def ideographs(self, text: str) -> list[tuple[int, str]]:
        """(offset, meant) of misread ideographs, judged over line breaks."""
        found = []
        back = [i for i, c in enumerate(text) if not (c == "\n" and 0 < i < len(text) - 1 and _joins(text[i - 1], text[i + 1]))]
        flat = _normal("".join(text[i] for i in back))
        for m in _DOUBTFUL.finditer(flat):
            i = m.start()
            char = self.lex.get("x", f"{min(i, 2)}{flat[max(0, i - 2) : i + 3]}")
            if char:
                found.append((back[i], char))
        return found

    def words(self, line: str) -> list[tuple[int, int, str]]:
        """(start, end, meant) of misread words and numbers of a line."""
        found = []
        hidden = _EMAIL_LIKE.sub(lambda m: "\0" * len(m.group()), line)
        matches = list(_WORD.finditer(hidden))
        for k, m in enumerate(matches):
            piece = m.group()
            lower = piece.lower()
            if len(piece) < 3 or piece.isdigit() or sum(c.isdigit() for c in piece) > len(piece) // 2:
                continue
            if m.start() and hidden[m.start() - 1] in "-\0" or piece.isupper():
                continue
            if hidden[max(0, m.start() - 1) : m.start()] in _WIDTHLESS or hidden[m.end() : m.end() + 1] in _WIDTHLESS:
                continue  # part of a word
            if "!" in piece and piece.index("!") == len(piece) - 1:
                continue
            before = matches[k - 1].group().lower() if k else ""
            after = matches[k + 1].group().lower() if k + 1 < len(matches) else ""
            meant = self.lex.get("t", f"{before} {lower} {after}")
            if meant:
                found.append((*m.span(), meant.capitalize() if piece[0].isupper() else meant))
        for m in _NUMBER.finditer(hidden):
            piece = m.group().rstrip(",./:-")
            if re.fullmatch("[A-Za-z][0-9]{9}", piece):  # a national number begins with a letter
                continue
            if m.start() and hidden[m.start() - 1] == "-" and sum(c.isdigit() for c in piece) < 4:
                continue
            if re.search("[0-9]", piece) and re.search("[lIOo]", piece):
                fixed = re.sub("[lI]", "1", re.sub("[Oo]", "0", piece))
                found.append((m.start(), m.start() + len(piece), fixed))
        return found

    def noise(self, text: str) -> tuple[list[str], Layout, list[tuple[int, str]], list[list[tuple[int, int, str]]]]:
        """The kinds of noise, and what is needed to repair them."""
        page = layout(text)
        kinds = [name for name, there in (("header", page.header), ("page_no", page.page_no)) if there]
        kept = "\n".join("" if k in ("header", "page_no", "blank") else s for s, k in zip(page.lines, page.kinds))
        squeezed = re.sub("\n{2,}(?=[a-z])", "\n", kept)
        if _BROKEN.search(squeezed):
            kinds.append("hyphen")
        ideographs = self.ideographs(text)
        halves = {i for i, line in enumerate(page.lines) if re.search("[A-Za-z][-‐‑¬­]$", line.rstrip())}
        words = []
        before = -1  # the last line of text, perhaps on the page before
        for i, line in enumerate(page.lines):
            spans = self.words(line) if page.kinds[i] != "heading" else []
            if i in halves and spans and spans[-1][1] >= len(line.rstrip()) - 1:
                spans = spans[:-1]  # half a word
            if spans and (before in halves or i - 1 in halves) and not line[: spans[0][0]].strip():
                spans = spans[1:]
            if page.kinds[i] == "text":
                before = i
            words.append(spans)
        if ideographs or any(words):
            kinds.append("misread")
        return sorted(kinds), page, ideographs, words

    def repair(self, text: str) -> tuple[list[str], str]:
        """The kinds of noise and the text in continuous paragraphs."""
        kinds, page, ideographs, words = self.noise(text)
        chars = list(text)
        for i, char in ideographs:
            chars[i] = char
        lines = "".join(chars).split("\n")
        out: list[str] = []
        for line, kind, spans in zip(lines, page.kinds, words):
            if kind in ("header", "page_no"):
                continue
            for a, b, meant in reversed(spans):
                line = line[:a] + meant + line[b:]
            out.append(line.rstrip())
        body = _BROKEN.sub(lambda m: m.group(2) + m.group(1) + m.group(3), "\n".join(out))
        return kinds, _paragraphs(body)


def _joins(a: str, b: str) -> bool:
    return ("一" <= a <= "鿿" or a in "，、") and ("一" <= b <= "鿿" or b in "，、。")


def _paragraphs(body: str) -> str:
    """Join the lines of a paragraph: a line goes on unless it ends a sentence or is much shorter than the longest."""
    lines = body.split("\n")
    width = max((len(s) for s in lines if not s.startswith(("#", "|"))), default=0)
    out: list[str] = []
    going = False
    for line in lines:
        plain = bool(line.strip()) and not line.startswith(("#", "|", "- "))
        if going and plain and out:
            wide = "一" <= out[-1][-1:] <= "鿿" or out[-1][-1:] in "，、。；"
            out[-1] += line.lstrip() if wide else " " + line.lstrip()
        else:
            out.append(line)
        going = plain and len(line) >= 0.75 * width and not re.search("[。.!?！？:：]$", line)
    return re.sub("\n{3,}", "\n\n", "\n".join(out)).strip()


def _judged(df: DataFrame, id_col: str, column: str, type_col: str, work: Callable[[Scan, str | None], tuple], schema: str) -> DataFrame:
    """id and what ``work`` makes of each scanned text, given the answers to its questions."""
    counted = count(df, column, type_col)
    answers = cut_lineage(word_answers(counted).union(ideograph_answers(counted)))
    shared = broadcast(df, bitmap(answers))  # BITS bits

    def probe(rows: Iterable[tuple]) -> Iterator[tuple]:
        probed = Probed(shared.value)
        scan = Scan(probed)
        for row_id, text in rows:
            if row_id is not None:
                probed.terms.clear()
                made = work(scan, text)
                if probed.terms:
                    yield row_id, text, [sort + term for sort, term in probed.terms], *(None for _ in made)
                else:
                    yield row_id, None, None, *made

    def answer(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row_id, text, found in rows:
            yield row_id, *work(Scan(Answers([(x["term"], x["meant"]) for x in found or []])), text)

    texts = df.filter(F.col(type_col).isin(*SCANNED)).select(id_col, column)
    probed = cut_lineage(map_rows(texts, probe, f"{id_col} bigint, text string, asked array<string>, {schema}", flush=512))
    sure = probed.filter("asked is null").drop("text", "asked")
    open_ = probed.filter("asked is not null")
    found = open_.select(id_col, F.explode("asked").alias("term")).distinct().join(answers, "term")
    found = found.groupBy(id_col).agg(F.collect_list(F.struct("term", "meant")).alias("found"))
    rest = open_.select(id_col, "text").join(found, id_col, "left").select(id_col, "text", "found")
    return sure.union(map_rows(rest, answer, f"{id_col} bigint, {schema}", flush=512))


def scanned_noise(df: DataFrame, id_col: str, column: str, type_col: str) -> DataFrame:
    """id, noise: each kind of noise of each scanned text, once."""
    kinds = _judged(df, id_col, column, type_col, lambda scan, text: (scan.noise(text)[0] if text else [],), "kinds array<string>")
    return kinds.select(id_col, F.explode("kinds").alias("noise")).distinct()


def scanned_text(df: DataFrame, id_col: str, column: str, type_col: str) -> DataFrame:
    """id, repaired, noise: the scanned texts as continuous paragraphs; null for a null text."""

    def work(scan: Scan, text: str | None) -> tuple:
        kinds, fixed = scan.repair(text) if text else ([], text)
        return fixed, kinds

    return _judged(df, id_col, column, type_col, work, "repaired string, noise array<string>")
