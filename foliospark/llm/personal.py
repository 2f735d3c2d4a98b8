"""Problem 4: personal data inside free text.

A text is a skip-chain conditional random field whose nodes are the spans that could be personal
data (patterns that miss as little as possible). A node's potential adds what its cues say before anything
is learned (labels, titles, check digits) and weights learned for its features: its form and words, the
cue and its distance, the characters and words beside it. Neighbouring nodes share a chain potential; nodes
of equal content anywhere in the text share a skip potential, nodes of similar content (names of one
length that differ in one letter or character, numbers with the same ending) a weaker one, so that a name
introduced by a label is also found where it stands bare. Nodes that overlap are alternatives, of which at
most one holds. Loopy message passing settles all labels of a text together, with the best set of
nodes that do not overlap found exactly in between; exact checks (check digits) decide at the end.

Training is from labelled rows: what the batch's own detector replaced in ``display_text``, aligned with
``structured_text``, labels the nodes of a bounded sample of rows (``SAMPLE_TEXTS``, the lowest hashes of the
ids), for and against. Since that detector misses things, nodes it left are labelled only where their cues
are decisive; once trained, the field labels what it is sure of itself, names that the sample knows from
other places or is sure of all parts of among it, and is trained again. Everything else runs on all texts.

Defined cases: null and empty texts hold nothing; characters of no width inside a piece belong to
it; a piece that stands several times in a field comes out once; placeholders of the form 《…》 and
what stands in them are no personal data; very long texts are one field graph like any other; without
labelled rows the cues alone label.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validators import IDENTITY_WEIGHTS, LETTER_CODES, LETTERS
from .arrow import broadcast, map_rows

#: Texts to train on.
SAMPLE_TEXTS = 1500
#: A node whose cues alone are so certain serves as an example for, or against.
DECISIVE_FOR, DECISIVE_AGAINST = 2.4, -4.0
#: The most and least that learned weights may add to a node's potential.
MOST_LEARNED, LEAST_LEARNED = 6.0, -6.0
#: A belief so sure labels a node for the second training; how strongly weights are held to zero; passes.
SURE, HELD, PASSES = 3.0, 0.01, 6
#: Weight, in the first training, of a span that could be a name but has parts no known name has, as an example against.
DOUBTED = 1.0
#: Potential of neighbours both being personal data, and the most that of equal nodes may reach.
CHAIN, MOST_SKIP = 0.3, 4.0
#: Share of the skip potential between similar nodes.
SIMILAR = 0.4
ROUNDS = 12
#: Belief, at most, of a node that a better alternative bars.
BARRED = -8.0

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON_NAME]"}

# Family names, words that tell what a number is.
SURNAMES = "王李張劉陳楊黃趙吳周徐孫馬朱胡郭何高林羅鄭梁謝宋唐許韓馮鄧曹彭曾蕭田董潘袁蔡蔣余于杜葉程魏蘇呂丁任盧姚沈鍾姜崔譚陸范汪廖石金韋賈夏付方鄒熊白孟秦邱侯江尹薛閻段雷龍黎史陶賀毛郝顧龔邵萬覃武錢戴嚴莫孔向常湯康易喬賴文施洪季佘駱闕殷倪祁甄滕莘桑鄔柏邰龐晏鄺褚戚翁欒霍岑司竇連古涂游莊柯卓阮溫翟湛單辛管祝左涂"
DOUBLE_SURNAMES = ("歐陽", "司馬", "上官", "諸葛", "張簡", "范姜", "司徒", "夏侯", "皇甫", "尉遲")
ID_CUES = "身分證|證號|國民身|居留證|護照|健保卡?|社會安全|ID number|National ID|ID no|Passport|passport|PASSPORT|SSN|Social Security|NHI|Health card|health card|Resident|ARC"
PHONE_CUES = "電話|手機|專線|傳真|聯繫|致電|請電|洽詢|Tel|TEL|Phone|phone|Mobile|mobile|Fax|call|Call|Cell|Reached at"
OTHER_CUES = "帳號|帳戶|存摺|轉帳|account|Account|流水號|序號|Serial|serial|發票|Receipt|receipt|Invoice|ISBN|統一編號|統編|字第|卡號|信用卡|Card|VISA|登記號|Order|batch|Batch|訂單|單號|車牌|經緯度|Position|版本|build|Host|主機|編號|檔號|Ratio|比例|日期|Date|金額|Our reference|Version"
_CUE = re.compile(f"(?P<id>{ID_CUES})|(?P<phone>{PHONE_CUES})|(?P<other>{OTHER_CUES})")
ORGANISATION = {"Services", "Partners", "Ltd", "Works", "Group", "Holdings", "Inc", "Corp", "Limited", "Company", "Bank", "City", "Dist", "District", "County", "Road", "Rd", "Street", "St", "Lane", "Ln", "Avenue", "Ave", "Boulevard", "Foundation", "University", "School", "Hospital", "Court", "Office", "Department", "Committee", "Institute", "Association", "Choir", "Museum", "Hall", "Library", "Centre", "Center", "Club", "Union", "Agency", "Board", "Trust", "College"}
NO_NAME = {"The", "Our", "Your", "This", "That", "These", "Those", "Dear", "Subject", "Place", "Date", "Name", "Address", "Contact", "Present", "Minutes", "Note", "Open", "Once", "Until", "During", "After", "Before", "Because", "Both", "Neither", "Each", "About", "What", "When", "Would", "Please", "Costs", "Yours", "Best", "Kind", "Page", "Draft", "Valid", "Prepared", "Report", "Position", "Phone", "Mobile", "Passport", "National", "Serial", "Bank", "Card", "Receipt", "Ratio", "Host", "See", "End", "Item", "Qty", "Price", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "Tel", "Fax", "Signed", "Signature", "Represented", "Questions", "Volume", "Flat", "In", "As", "It", "If", "No", "We", "To", "Of", "By", "At", "On", "For", "And", "With", "From", "According", "Reached", "Road", "Internal", "Total", "Order", "Mr", "Mrs", "Ms", "Dr", "Miss", "Prof"}

_NUMERALS = "0-9一二三四五六七八九十百零〇"
_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@| ?@ ?|\s?[\(\[]at[\)\]]\s?| AT )[A-Za-z0-9-]+(?:(?:\.|\s?[\(\[]dot[\)\]]\s?| DOT )[A-Za-z0-9-]+)*(?:\.|\s?[\(\[]dot[\)\]]\s?| DOT )[A-Za-z]{2,}")
_PHONE = re.compile(
    r"(?<![A-Za-z0-9])(?<![0-9][.,/:-])(?:"
    r"(?:\(\+886\)|\+886|00886)[ .-]?(?:\(0\)|0)?(?:9\d\d[ .-]?\d{3}[ .-]?\d{3}|[2-8]\d?[ .-]?\d{3,4}[ .-]?\d{4})"
    r"|(?:\(\+\d{1,3}\)|\+\d{1,3}|00\d?[ .-]\d{1,3})(?:[ .-]?\(\d{1,5}\)|[ .-]?\d{2,5}){1,5}"
    r"|09\d\d[ .-]?\d{3}[ .-]?\d{3}"
    r"|(?:\(0[2-8]\d{0,2}\)[ ]?|0[2-8]\d{0,2}[ .-]?)\d{3,4}[ .-]?\d{4}"
    r")(?![0-9A-Za-z])(?![.,/:-][0-9])"
)
_NATIONAL = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][ -]?[1289]\d\d[ -]?\d{3}[ -]?\d{3}(?![0-9A-Za-z])")
_PASSPORT = re.compile(r"(?<![A-Za-z0-9-])(?:[A-Z]{1,2}\d{7,8}|\d{9})(?![0-9A-Za-z-])")
_HEALTH = re.compile(r"(?<![0-9A-Za-z-])(?:\d{12}|\d{4} \d{4} \d{4})(?![0-9A-Za-z-])")
_SOCIAL = re.compile(r"(?<![0-9A-Za-z-])\d{3}[- ]\d\d[- ]\d{4}(?![0-9A-Za-z-])")
_ROAD_END = re.compile(f"(?:(?:路|街|大道)(?:[{_NUMERALS}]{{1,3}}段)?|[巷弄段])[0-9一二三四五六七八九十百之-]*?(?:[{_NUMERALS}]{{1,6}}巷)?(?:[{_NUMERALS}]{{1,4}}弄)?[{_NUMERALS}]{{1,7}}(?:之[{_NUMERALS}]{{1,3}})?號(?:之[{_NUMERALS}]{{1,3}})?(?:[{_NUMERALS}]{{1,4}}樓)?(?:之[{_NUMERALS}]{{1,3}})?(?:[0-9]{{1,4}}室)?")
_ROAD_START = re.compile("(?:(?P<first>[一-鿿]{1,4})(?P<kind>[縣市]))?(?:(?P<second>[一-鿿]{1,4})[區鄉鎮市])?(?:[一-鿿]{1,3}[村里])?(?P<road>[一-鿿]{1,5})$")
_BEFORE_PLACE = set("設籍於至處址住在居寄到為是地位登記現送往：之訊")
_STREET = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:Flat|Apt\.?|Unit|Room|Suite) ?[0-9]+[A-Z]?, ?)?(?:[0-9]+F(?:-[0-9]+)?, ?)?(?:No\. ?[0-9]+(?:-[0-9]+)?, ?|[0-9]+(?:-[0-9]+)? )(?:Aly\. ?[0-9]+, ?)?(?:Ln\. ?[0-9]+, ?)?(?:Sec\. ?[0-9]+, ?)?"
    r"[A-Z][A-Za-z]+(?: [A-Z][a-z]+)? (?:Rd\.|Road|St\.|Street|Ave\.|Avenue|Lane|Ln\.|Blvd\.|Boulevard|Drive|Dr\.|Way|Place|Pl\.|Square|Court)(?:, ?Sec\. ?[0-9]+)?(?:, ?[A-Z][A-Za-z]+ (?:Dist\.|District|Township|Vil\.))?(?:, ?[A-Z][A-Za-z]+(?: City| County)?(?![a-z]))?"
)
_NAME_ZH = re.compile(f"(?:{'|'.join(DOUBLE_SURNAMES)}|[{SURNAMES}])(?=[一-鿿])")
_NAME_EN = re.compile(r"(?<![A-Za-z])[A-Z][a-z]{1,14}(?: [A-Z]\.){0,2} [A-Z][a-z]{1,20}(?:-[A-Z][a-z]+)?(?![A-Za-z])")
_NOT_GIVEN = set("皆的了和與及於由請先女小經本敬以為是在有之者向對及其所提並應將已未因此該等也就不會可第各每此如若倘則得需各依據出到說現居持為身證電手統申乙甲立收聯簽日，。、：；（）公司處部中心股份有限科技物流文教精密實業顧問")
_LEFT_ZH = re.compile("(?:姓名|申請人|收件人|寄件人|立書人|代表|代表人|紀錄|記錄|出席|列席|主席|聯絡人?|負責人|持有人|車主|承辦人|代理人姓名|簽收人|監護人|當事人|被保險人|經辦人|受款人|[收申立件書請]入)(?:姓名)?[為是]?[：: 　]*$|聯絡(?:人|⼈|入)?(?:姓名)?[為：]$")
_LIST_ZH = re.compile("(?:出席|列席|出席者)[：:].*、$")
#: Words and marks that persons often follow, whatever the text.
_WEAK_LEFT_ZH = re.compile("(?:[（(由、,，為向據洽寄給致交請與和]|^)$")
_RIGHT_ZH = re.compile("(?:[ 　]*(?:(?:先生|女士|小姐)(?![一-鿿]{1,4}[館團會校院社廳隊金])|經理|主任|醫師|老師|教授|君(?![一-鿿])|敬上|謹上|啟)|[，,](?:電話|手機|身分證|證號|統一編號|聯絡))")
_WEAK_RIGHT_ZH = re.compile("$|[）)，、。,]|[　 ]")
_LEFT_EN = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Miss|Prof)\.? |(?:Name|Contact|Questions|Signature|Present|Attn|Applicant|Recipient)[:：] ?|(?:Signed|Represented|taken|prepared|Prepared) by |[^A-Za-z0-9 ][：:] ?)$")
_LIST_EN = re.compile(r"Present[:：] .*, $")
_RIGHT_EN = re.compile(r"(?:, Tel|　敬上|[ 　]*(?:先生|女士|經理)|[，,](?:電話|手機|身分證|證號))")
_LAST_WORD, _NEXT_WORD = re.compile(r"[A-Za-z]+[^A-Za-z]*$"), re.compile(r"[^A-Za-z]*[A-Za-z]+")
_PLACEHOLDER = re.compile("《[^《》\n]{1,40}》")
_WIDTHLESS = re.compile("[­͏​‌‍⁠﻿]")
_MISREAD = re.compile("(?<=[0-9])[OoQ](?=[0-9 -])|(?<=[0-9 -][0-9])[OoQ]|(?<=[0-9])[lI|](?=[0-9])|(?<![A-Za-z0-9])O(?=9[0-9]{2}[ .-]?[0-9]{3})")
_PROMISING = re.compile(f"@|[0-9]{{3}}|號|AT |\\bat[)\\]]|[A-Z][a-z]+ [A-Z]|[{SURNAMES}]")


def _shadow_map() -> dict[int, str]:
    table = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    table |= {0xFF0C: "，", 0xFF1A: "：", 0xFF08: "（", 0xFF09: "）", 0xFF1B: "；", 0xFF01: "！", 0xFF1F: "？", 0xA0: " ", 0x2007: " ", 0x202F: " "}
    for point in (*range(0x2F00, 0x2FD6), *range(0xF900, 0xFB00)):
        plain = unicodedata.normalize("NFKC", chr(point))
        if len(plain) == 1:
            table[point] = plain
    return table


_SHADOW = _shadow_map()


def valid_national(number: str) -> bool:
    """Check digit of the national and residence numbers: a letter and nine digits."""
    at = LETTERS.find(number[:1].upper())
    if at < 0 or len(number) != 10 or not number[1:].isdigit():
        return False
    digits = [*divmod(LETTER_CODES[at], 10), *map(int, number[1:])]
    return sum(d * w for d, w in zip(digits, IDENTITY_WEIGHTS)) % 10 == 0


@dataclass(slots=True)
class Node:
    """A span that could be personal data, with the log-odds its cues give it."""

    start: int
    end: int
    kind: str
    key: str
    cues: float
    words: tuple[str, ...]
    belief: float = 0.0


def _cue(left: str) -> tuple[str, int]:
    """The last word before the span that says what a number is, and its distance."""
    found = ""
    at = 0
    for m in _CUE.finditer(left):
        found, at = m.lastgroup or "", m.end()
    return found, len(left) - at


def _number_nodes(line: str) -> list[Node]:
    nodes = []
    for m in _PHONE.finditer(line):
        a, b = m.span()
        piece = m.group()
        digits = re.sub("[^0-9]", "", piece)
        cue, far = _cue(line[max(0, a - 28) : a])
        abroad = piece.lstrip("(").startswith("+") or digits.startswith("00")
        if not (9 <= len(digits) <= 16) or (not abroad and len(digits) > 10):
            continue
        cut = any(c in piece for c in " .-()")
        score = 3.5 if abroad else 3.0 if cut else 1.0 if digits.startswith("09") else -1.5
        if not abroad and not digits.startswith("09") and len(digits) < 9:
            score -= 3
        score += 4.0 if cue == "phone" else -7.0 if cue == "other" else -2.0 if cue == "id" and far < 4 else 0.0
        key = "0" + digits[3:] if digits.startswith("886") else digits
        form = "abroad" if abroad else "cut" if cut else "mobile" if digits.startswith("09") else "bare"
        nodes.append(Node(a, b, "phone", key, score, (f"pf:{form}", f"pd:{len(digits)}", f"pc:{cue}:{_near(far)}", *_around(line, a, b, "p"))))
    for m in _NATIONAL.finditer(line):
        a, b = m.span()
        number = re.sub("[ -]", "", m.group()).upper()
        cue, far = _cue(line[max(0, a - 28) : a])
        right = valid_national(number)
        score = (5.0 if right else -9.0) + (2.0 if cue == "id" else -4.0 if cue == "other" else 0.0)
        nodes.append(Node(a, b, "id_number", number, score, (f"nv:{right}", f"nc:{cue}:{_near(far)}", *_around(line, a, b, "n"))))
    for pattern, words, base in ((_PASSPORT, "護照|[Pp]assport|PASSPORT", -6.0), (_HEALTH, "健保|NHI|[Hh]ealth card|Health insurance", -6.0), (_SOCIAL, "SSN|Social Security|社會安全", 0.5)):
        for m in pattern.finditer(line):
            a, b = m.span()
            left = line[max(0, a - 28) : a]
            cue, far = _cue(left)
            said = re.search(words, left) is not None and cue == "id"
            score = base + (10.0 if said else -3.0 if cue else 0.0)
            shape = re.sub("[0-9]", "9", re.sub("[A-Z]", "A", m.group()))
            nodes.append(Node(a, b, "id_number", re.sub("[ -]", "", m.group()), score, (f"if:{shape}", f"is:{said}", f"ic:{cue}:{_near(far)}", *_around(line, a, b, "i"))))
    return nodes


def _near(far: int) -> int:
    """Whether a cue stands right before, near or far."""
    return 0 if far < 3 else 1 if far < 8 else 2


def _around(line: str, a: int, b: int, tag: str) -> tuple[str, ...]:
    """Features of what stands beside a span: up to three characters on the left, two on the right; digits are alike."""
    left, right = re.sub("[0-9]", "9", line[max(0, a - 3) : a]), re.sub("[0-9]", "9", line[b : b + 2])
    left = left if a > 3 else "^" + left  # the beginning of a line, and below its end
    right = right if len(right) == 2 else right + "$"
    return (f"{tag}l1:{left[-1:]}", f"{tag}l2:{left[-2:]}", f"{tag}l3:{left[-3:]}", f"{tag}r1:{right[:1]}", f"{tag}r2:{right[:2]}")


def _address_nodes(line: str) -> list[Node]:
    nodes = []
    if "號" in line:
        for m in _ROAD_END.finditer(line):
            before = line[max(0, m.start() - 16) : m.start()]
            if m.group()[0] in "巷弄段":
                continue
            start = _ROAD_START.search(before)
            if not start or not start.group("road"):
                continue
            a = m.start() - len(before) + start.start()
            head = line[a : m.start()]
            while len(head) > 2 and head[0] in _BEFORE_PLACE:  # verbs and labels before the place
                head = head[1:]
            trimmed = re.search("[一-鿿]{2,3}[縣市][一-鿿]{1,3}[區鄉鎮市][一-鿿]{1,4}$|[一-鿿]{2,3}[縣市區鄉鎮][一-鿿]{1,4}$", head)
            has_area = trimmed is not None
            if has_area:
                head = trimmed.group()
                while len(head) > 3 and head[0] in _BEFORE_PLACE:
                    head = head[1:]
            else:
                head = head[-4:]
                while len(head) > 1 and head[0] in _BEFORE_PLACE:
                    head = head[1:]
            a = m.start() - len(head)
            nodes.append(Node(a, m.end(), "address", line[a : m.end()], 5.0 if has_area else 0.5, _around(line, a, m.end(), "a")))
    if "," in line or "." in line:
        for m in _STREET.finditer(line):
            nodes.append(Node(*m.span(), "address", m.group(), 5.0, _around(line, *m.span(), "s")))
    return nodes


def _name_nodes(line: str) -> list[Node]:
    nodes = []
    for m in _NAME_ZH.finditer(line):
        a = m.start()
        size = len(m.group())
        left = line[max(0, a - 12) : a]
        lead = 4.5 if _LEFT_ZH.search(left) else 3.5 if "、" in left[-1:] and _LIST_ZH.search(line[:a]) else 0.7 if _WEAK_LEFT_ZH.search(left) else -0.8
        for given in (2, 1):
            b = a + size + given
            piece = line[a + size : b]
            if len(piece) < given or not all("一" <= c <= "鿿" for c in piece):
                continue
            if any(c in _NOT_GIVEN for c in piece):
                continue
            right = line[b : b + 8]
            tail = 5.0 if _RIGHT_ZH.match(right) else 0.5 if _WEAK_RIGHT_ZH.match(right) else -1.2
            if given == 1 and right[:1] and "一" <= right[0] <= "鿿" and tail < 0 and right[0] not in _NOT_GIVEN:
                tail -= 1.0
            words = (f"zs:{m.group()}", *(f"zg:{c}" for c in piece), f"zn:{size}{given}", *_around(line, a, b, "z"))
            nodes.append(Node(a, b, "person_name", line[a:b], -3.0 + lead + tail, words))
    for m in _NAME_EN.finditer(line):
        a, b = m.span()
        parts = m.group().split(" ")
        first, last = parts[0], parts[-1]
        if first in NO_NAME or last in NO_NAME:
            continue
        left, right = line[max(0, a - 18) : a], line[b : b + 14]
        score = -2.6 + (5.1 if _LEFT_EN.search(left) else 3.5 if _LIST_EN.search(line[:a]) else 0.0)
        score += 4.0 if _RIGHT_EN.match(right) else 0.0
        score += 2.2 if not line[:a].strip() and re.fullmatch("[,. 　]*", line[b:]) else 0.0
        if first in ORGANISATION or last in ORGANISATION:
            score -= 12.0
        elif re.match("[-‐¬\u00ad] *$", right):  # half a word, broken at the end of a line
            score -= 8.0
        elif re.match(r" (?:Ltd|Inc|Group|Services|Partners|Works|City|Road|Rd|St|Lane|Avenue|Foundation)\b", right):
            score -= 8.0
        before, after = _LAST_WORD.search(left), _NEXT_WORD.match(right)
        words = (f"ef:{first}", f"el:{last}", f"et:{last[-4:]}", f"eb:{before.group() if before else ''}", f"ea:{after.group() if after else ''}", *_around(line, a, b, "e"))
        nodes.append(Node(a, b, "person_name", m.group(), score, words))
    return nodes


def line_nodes(line: str) -> list[Node]:
    """All nodes of one line of shadow text."""
    if _PROMISING.search(line) is None:
        return []
    nodes = []
    if "@" in line or "AT " in line or "at)" in line or "at]" in line:
        nodes += [Node(*m.span(), "email", m.group().lower(), 7.0, ()) for m in _EMAIL.finditer(line)]
    if re.search("[0-9]{3}", line):
        nodes += _number_nodes(line)
    if re.search("[0-9一二三四五六七八九十]", line):
        nodes += _address_nodes(line)
    nodes += _name_nodes(line)
    return nodes


@dataclass
class Field:
    """The learned part of the potentials."""

    weights: dict[str, float] = field(default_factory=dict)
    skip: float = MOST_SKIP


class PersonalData:
    """Finds personal data in texts with one trained field."""

    def __init__(self, model: Field):
        self.model = model
        self.lines: dict[str, list[Node]] = {}

    def nodes(self, text: str, prefix: str = "") -> tuple[list[Node], list[int] | None]:
        """Nodes in shadow offsets, and the shadow's map to the text if it lacks characters of it."""
        back = None
        shadow = text.translate(_SHADOW)
        if _WIDTHLESS.search(shadow):
            back = [i for i, c in enumerate(shadow) if not _WIDTHLESS.match(c)]
            shadow = "".join(shadow[i] for i in back)
        if "《" in shadow:
            shadow = _PLACEHOLDER.sub(lambda m: "\0" * len(m.group()), shadow)
        if _MISREAD.search(shadow):
            shadow = _MISREAD.sub(lambda m: "0" if m.group() in "OoQ" else "1", shadow)
        found: list[Node] = []
        at = 0
        for line in shadow.split("\n"):
            known = self.lines.get(prefix + line)
            if known is None:
                known = line_nodes(prefix + line)
                if len(self.lines) > 20_000:
                    self.lines.clear()
                self.lines[prefix + line] = known
            shift = at - len(prefix)
            found += [Node(n.start + shift, n.end + shift, n.kind, n.key, n.cues, n.words) for n in known if n.start >= len(prefix)]
            at += len(line) + 1
        return found, back

    def potential(self, node: Node) -> float:
        get = self.model.weights.get
        return node.cues + max(LEAST_LEARNED, min(MOST_LEARNED, sum([get(w, 0.0) for w in node.words])))

    def settle(self, nodes: list[Node]) -> None:
        """Sets each node's belief in log-odds: loopy message passing over chain and skip edges, alternatives settled exactly.

        Overlapping nodes exclude each other. Given the messages, the best set of nodes that do not overlap is
        found exactly; what it leaves out is barred and says nothing to its neighbours when messages pass again.
        """
        for n in nodes:
            n.belief = self.potential(n)
        # what stands too low to be lifted by its neighbours, and stands once, is settled
        low = -(self.model.skip + 2 * CHAIN)
        counts = Counter((n.kind, n.key) for n in nodes)
        live = [n for n in nodes if n.belief > low or counts[n.kind, n.key] > 1]
        live.sort(key=lambda n: n.start)
        edges = self._edges(live)
        base = [n.belief for n in live]
        total = _passed(base, edges)
        barred = _left_out(live, total)
        if barred and edges:
            total = _passed([BARRED if i in barred else x for i, x in enumerate(base)], edges)
        for i, n in enumerate(live):
            n.belief = min(total[i], -abs(total[i]), BARRED) if i in barred else total[i]

    def _edges(self, nodes: list[Node]) -> list[tuple[int, int, float]]:
        """Chain and skip edges with their weights, for nodes sorted by start."""
        edges: list[tuple[int, int, float]] = []
        last = -1  # the node that ends last so far
        for j, n in enumerate(nodes):
            if last >= 0 and nodes[last].end <= n.start <= nodes[last].end + 30 and nodes[last].kind != n.kind:
                edges.append((last, j, CHAIN))
            if last < 0 or n.end >= nodes[last].end:
                last = j
        same: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, n in enumerate(nodes):
            same[n.kind, n.key].append(i)
        hubs = {}
        for content, members in same.items():  # a star around the most certain occurrence: few edges, and no way is long
            hub = hubs[content] = max(members, key=lambda i: nodes[i].belief)
            edges += [(hub, i, self.model.skip) for i in members if i != hub]
        alike: dict[tuple, int] = {}
        for (kind, key), hub in hubs.items():
            for form in _similar_forms(kind, key):
                other = alike.setdefault(form, hub)
                if other != hub and not (nodes[other].start < nodes[hub].end and nodes[hub].start < nodes[other].end):
                    edges.append((other, hub, SIMILAR * self.model.skip))
        return edges

    def find(self, text: str, prefix: str = "") -> list[tuple[int, int, str]]:
        """(start, end, kind) of each piece, in order and without overlaps, in offsets of the text."""
        nodes, back = self.nodes(text, prefix)
        if not nodes:
            return []
        self.settle(nodes)
        kept: list[tuple[int, int, str]] = []
        for n in sorted((n for n in nodes if n.belief > 0), key=lambda n: n.start):
            if n.kind == "id_number" and n.key[:1].isalpha() and n.key[1:2] in "12" and len(n.key) == 10 and not valid_national(n.key):
                continue  # an exact check after inference
            kept.append((n.start, n.end, n.kind))
        return kept if back is None else [(back[a], back[b - 1] + 1, kind) for a, b, kind in kept]


def _passed(base: list[float], edges: list[tuple[int, int, float]]) -> list[float]:
    """Beliefs after messages went along all edges until they settle."""
    messages = [[0.0, 0.0] for _ in edges]
    total = base[:]
    for _ in range(ROUNDS if edges else 0):
        moved = 0.0
        for k, (i, j, w) in enumerate(edges):
            forth, back_ = messages[k]
            new_forth, new_back = _message(total[i] - back_, w), _message(total[j] - forth, w)
            total[j] += new_forth - forth
            total[i] += new_back - back_
            moved = max(moved, abs(new_forth - forth), abs(new_back - back_))
            messages[k] = [new_forth, new_back]
        if moved < 1e-3:
            break
    return total


def _left_out(nodes: list[Node], beliefs: list[float]) -> set[int]:
    """The nodes with a positive belief outside the set of greatest total belief in which none overlap."""
    order = sorted((i for i, belief in enumerate(beliefs) if belief > 0), key=lambda i: nodes[i].end)
    ends = [nodes[i].end for i in order]
    best = [0.0]
    taken: list[tuple[bool, int]] = []
    for place, i in enumerate(order):
        before = bisect.bisect_right(ends, nodes[i].start, 0, place)
        with_it = best[before] + beliefs[i]
        taken.append((with_it > best[-1], before))
        best.append(max(with_it, best[-1]))
    out = set(order)
    place = len(order)
    while place:
        chosen, before = taken[place - 1]
        if chosen:
            out.discard(order[place - 1])
        place = before if chosen else place - 1
    return out


def _message(cavity: float, weight: float) -> float:
    """What a node of this log-odds tells a neighbour, in log-odds: the potential rewards both being personal data."""
    c = max(-30.0, min(30.0, cavity))
    return math.log((1.0 + math.exp(weight + c)) / (1.0 + math.exp(c)))


def _similar_forms(kind: str, key: str) -> list[tuple]:
    """What similar contents share: a name with one character left open, a number's ending."""
    if kind == "person_name" and len(key) >= 3:
        return [(kind, len(key), i, key[:i] + key[i + 1 :]) for i in range(len(key))]
    return [(kind, key[-8:])] if kind == "phone" and len(key) > 8 else []


#: Kinds of the labels that a batch's detector puts in place of what it finds.
LABEL_KINDS = {"電子郵件": "email", "手機號碼": "phone", "市話號碼": "phone", "身分證字號": "id_number", "居留證號": "id_number", "護照號碼": "id_number", "健保卡號": "id_number", "地址": "address", "姓名": "person_name"}
_STAND_IN = re.compile("《([^《》#\n]{1,12})(?:#[0-9a-f]{8})?》")


def labelled_spans(text: str, shown: str | None) -> list[tuple[int, int, str]]:
    """(start, end, label) of what was replaced between a text and its displayed form; none if they do not align."""
    pieces = _STAND_IN.split(shown) if shown and shown != text else [""]
    if len(pieces) < 3 or not text.startswith(pieces[0]):
        return []
    spans, at = [], len(pieces[0])
    for k in range(1, len(pieces), 2):
        after = pieces[k + 1]
        end = text.find(after, at + 1) if after else len(text) if k + 2 == len(pieces) else -1
        if end <= at:
            return []
        spans.append((at, end, pieces[k]))
        at = end + len(after)
    return spans if at == len(text) else []


def _label(node: Node, spans: list[tuple[int, int, str]], offset: Callable[[int], int]) -> int | None:
    """What the labelled spans say of a node: for, against (another kind, or other bounds), or nothing."""
    a, b = offset(node.start), offset(node.end - 1) + 1
    for start, end, label in spans:
        if start < b and a < end:
            kind = LABEL_KINDS.get(label)
            if kind == node.kind and (a, b) == (start, end):
                return 1
            return None if kind == node.kind and node.kind in ("address", "person_name") and (start <= a and b <= end or a <= start and end <= b) else 0
    return None


def train(texts: Iterable[str | tuple[str, str | None]]) -> Field:
    """The field's weights by logistic regression over labelled nodes, and its skip potential by how equal nodes agree.

    Texts come alone or with their displayed form. A node's cues are the starting point that learned weights
    correct. The first training is on labels and decisive cues, the second also on what the first makes sure.
    """
    finder = PersonalData(Field())
    known: list[list[tuple[Node, int | None]]] = []
    for item in texts:
        text, shown = item if isinstance(item, tuple) else (item, None)
        nodes, back = finder.nodes(text)
        spans = labelled_spans(text, shown)
        offset = (lambda i: i) if back is None else back.__getitem__
        known.append([(n, _label(n, spans, offset)) for n in nodes])
    # names that a label or a decisive cue vouches for stand for themselves wherever else the sample has them
    vouched = [n for nodes in known for n, label in nodes if n.kind == "person_name" and (label == 1 or label is None and n.cues >= DECISIVE_FOR)]
    names, parts = {n.key for n in vouched}, {w for n in vouched for w in n.words if w.startswith(_PARTS)}
    agree, differ = 0, 0
    examples: list[tuple[Node, int, float]] = []
    for nodes in known:
        groups: dict[tuple[str, str], list[bool]] = defaultdict(list)
        for n, label in nodes:
            if label is None and n.kind == "person_name" and n.key in names:
                examples.append((n, 1, 1.0))
                continue
            if label is None and (n.cues >= DECISIVE_FOR or n.cues <= DECISIVE_AGAINST):
                label = int(n.cues > 0)
            if label is not None:
                examples.append((n, label, 1.0))
                groups[n.kind, n.key].append(bool(label))
            elif n.kind == "person_name" and not _likely(n, parts):
                examples.append((n, 0, DOUBTED))
        for said in groups.values():
            for x, y in zip(said, said[1:]):
                agree, differ = agree + (x == y), differ + (x != y)
    skip = min(MOST_SKIP, max(0.5, math.log((agree + 1) / (differ + 1))))
    settled = PersonalData(Field(_regression(examples), skip))
    again: list[tuple[Node, int, float]] = []
    for nodes in known:
        settled.settle([n for n, _ in nodes])
        end = -1  # of the last span made of known parts, the longest of those that begin there
        for n, label in sorted(nodes, key=lambda p: (p[0].start, -p[0].end)):
            made = n.kind == "person_name" and _likely(n, parts, all)
            if label is None and (n.kind == "person_name" and n.key in names or abs(n.belief) >= SURE):
                label = int(n.belief > 0 or n.kind == "person_name" and n.key in names)
            if label is not None:
                again.append((n, label, 1.0))
            elif made:
                again.append((n, int(n.start >= end), DOUBTED))
            end = max(end, n.end) if made else end
    return Field(_regression(again), skip)


#: Features that are parts of a name.
_PARTS = ("zs:", "zg:", "ef:", "el:")


def _likely(node: Node, parts: set[str], enough: Callable[[list[bool]], bool] = any) -> bool:
    """Whether a name could be one by its parts: all characters of one in ideographs, either word of another (or ``enough``), stand in names vouched for."""
    own = [w in parts for w in node.words if w.startswith(_PARTS)]
    return all(own) if node.words[0].startswith("z") else enough(own)


def _regression(examples: list[tuple[Node, int, float]]) -> dict[str, float]:
    """What the features say beside the cues: weights held to zero that make the labels likely."""
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(float)
    for _ in range(PASSES):
        for n, label, share in examples:
            z = n.cues + sum([weights[w] for w in n.words])
            error = share * (label - 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))))
            if abs(error) > 0.02:
                for w in n.words:
                    g = error - HELD * weights[w]
                    squares[w] += g * g
                    weights[w] += 0.4 * g / math.sqrt(1.0 + squares[w])
    counts = Counter(w for n, *_ in examples for w in n.words)
    return {w: round(v, 3) for w, v in weights.items() if counts[w] >= 3 and abs(v) > 0.05}


def train_on(df: DataFrame, id_col: str, column: str, size: int = SAMPLE_TEXTS, shown: str | None = None) -> Field:
    """Train on the ``size`` rows whose ids hash lowest; first only ids are ranked, then those rows are read.

    ``shown`` names the displayed form, whose placeholders label the text.
    """
    ids = df.filter(F.col(column).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(size)
    picked = [r[0] for r in ids.collect()]  # at most ``size`` numbers
    columns = [F.col(column), F.col(shown) if shown else F.lit(None).cast("string")]
    rows = df.filter(F.col(id_col).isin(picked)).select(id_col, *columns).dropDuplicates([id_col]).orderBy(id_col)
    return train((r[1], r[2]) for r in rows.collect() if r[1])


def pieces(df: DataFrame, id_col: str, columns: list[str], model: Field, prefix_col: str | None = None) -> DataFrame:
    """field_no, row_id, kind, pii_text: each distinct piece of each column; ``prefix_col`` gives the words before a snippet."""
    shared = broadcast(df, model)  # at most a weight for each word around the sample's nodes

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        finder = PersonalData(shared.value)
        for row_id, prefix, *texts in rows:
            if row_id is None:
                continue
            before: dict[str, list[tuple[str, str]]] = {}
            for i, text in enumerate(texts):
                if not text:
                    continue
                if text not in before:
                    before[text] = list(dict.fromkeys((kind, text[a:b]) for a, b, kind in finder.find(text, prefix or "")))
                for kind, piece in before[text]:
                    yield i, row_id, kind, piece

    chosen = df.select(id_col, F.col(prefix_col) if prefix_col else F.lit(None).cast("string"), *columns)
    return map_rows(chosen, run, "field_no int, row_id bigint, kind string, pii_text string")


def masked(df: DataFrame, id_col: str, columns: str | list[str], model: Field, prefix_col: str | None = None) -> DataFrame:
    """The text of each column with typed placeholders and nothing else changed; null for a null text.

    Of one column, given by name: id, masked, pieces. Of a list: field_no, row_id, masked, pieces.
    ``prefix_col`` gives the words before a snippet.
    """
    shared = broadcast(df, model)
    single = isinstance(columns, str)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        finder = PersonalData(shared.value)
        for row_id, prefix, *texts in rows:
            if row_id is None:
                continue
            for i, text in enumerate(texts):
                out, at = [], 0
                found = finder.find(text, prefix or "") if text else []
                for a, b, kind in found:
                    out += [text[at:a], PLACEHOLDER[kind]]
                    at = b
                made = (row_id, text if text is None else "".join([*out, text[at:]]), len(found))
                yield made if single else (i, *made)

    chosen = df.select(id_col, F.col(prefix_col) if prefix_col else F.lit(None).cast("string"), *([columns] if single else columns))
    schema = f"{id_col} bigint, masked string, pieces int" if single else "field_no int, row_id bigint, masked string, pieces int"
    return map_rows(chosen, run, schema, flush=512)


#: What a detector's entity says of the snippet, as the words that would stand before it.
ENTITY_WORDS = {
    "TW_ID_NUMBER": "身分證字號：", "TW_MOBILE": "手機：", "TW_LANDLINE": "電話：", "EMAIL": "電子郵件：", "CREDIT_CARD": "信用卡號：", "TW_COMPANY_ID": "統一編號：", "PASSPORT": "護照號碼：",
    "BANK_ACCOUNT": "", "TW_ADDRESS": "地址：", "PERSON_NAME_FIELD": "姓名：", "BIRTHDAY_FIELD": "出生日期：", "NHI_CARD": "健保卡號：", "TW_RESIDENT_ID": "居留證號：", "VEHICLE_PLATE": "車牌號碼：",
}


FIELD_NAMES = ["structured_text", "display_text"]


def _field_name() -> Column:
    return F.element_at(F.array(*map(F.lit, FIELD_NAMES)), F.col("field_no") + 1)


def _before(findings: DataFrame) -> DataFrame:
    words = F.element_at(F.create_map(*[F.lit(x) for pair in ENTITY_WORDS.items() for x in pair]), F.col("entity"))
    return findings.select("finding_id", "text", F.when(F.col("entity").isNotNull(), words).alias("before"))


def personal_data(results: DataFrame, findings: DataFrame, size: int = SAMPLE_TEXTS) -> DataFrame:
    """field_name, row_id, kind, pii_text: each distinct piece of personal data of both text fields and the snippets."""
    model = train_on(results, "result_id", "structured_text", size, "display_text")
    fields = pieces(results, "result_id", FIELD_NAMES, model).withColumn("field_name", _field_name())
    snippets = _before(findings.filter("text is not null"))
    snippets = pieces(snippets, "finding_id", ["text"], model, "before").withColumn("field_name", F.lit("finding_text"))
    columns = ["field_name", "row_id", "kind", "pii_text"]
    return fields.select(*columns).union(snippets.select(*columns)).distinct()


def masked_data(results: DataFrame, findings: DataFrame, size: int = SAMPLE_TEXTS) -> DataFrame:
    """field_name, row_id, masked, pieces: both text fields and the snippets with typed placeholders, null texts included."""
    model = train_on(results, "result_id", "structured_text", size, "display_text")
    fields = masked(results, "result_id", FIELD_NAMES, model).withColumn("field_name", _field_name())
    snippets = masked(_before(findings), "finding_id", ["text"], model, "before").withColumn("field_name", F.lit("finding_text"))
    columns = ["field_name", "row_id", "masked", "pieces"]
    return fields.select(*columns).union(snippets.select(*columns)).dropDuplicates(["field_name", "row_id"])
