"""Problem 3: texts decoded with another encoding than they were written in.

A passage is a node of a graph; its edges encode it (text to bytes), decode it (bytes to text) or
unescape it (text to text: ``&#35531;``, ``&eacute;``, ``\\u8acb``, ``%E8%AB%8B``). A best-first search
walks the graph from the passage as found: the frontier is ordered by the plausibility cost of the text
a node stands for, visited states are remembered by hash, and the cheapest text reached is the
restoration, provided that it is cheaper than the passage by a margin that depends on how much the
last step proves (strict UTF-8 with multi-byte sequences hardly ever succeeds by chance; the two-byte
encodings often do; an escape must stand for letters).

A text is expanded if the step to it proves itself, it is cheaper than the text it came from and still
holds odd characters or escapes. Costs fall along every path, so the search ends by itself: neither rounds nor steps are limited.

The cost of a text is the sum of its characters' bits over the corpus (``charstats``), with a
fixed cost for what never stands in a text by right: escapes, replacement characters, C1 controls,
private and unassigned characters. The last three also mark a passage that can't be restored as garbled.

Only lines that hold an escape or a character which is not ordinary in the corpus are searched. Within a
line the whole line, then runs of escapes, the runs without ideographs, then the words are tried.

Defined cases: null and empty texts are unaffected; a very long line is searched like any other;
foreign words and symbols that no path makes cheaper stay as they are, and so do escapes in addresses
of the web and escapes of plain ASCII.
"""

from __future__ import annotations

import codecs
import heapq
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .arrow import broadcast, map_rows
from .charstats import WORST, character_costs

#: Encodings a text may have been read with, and those it may have been written in.
READ_WITH = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "cp850", "cp1250", "koi8_r", "gbk", "cp950", "cp932", "cp949")
WRITTEN_IN = ("utf-8", "cp950", "gbk")
DOUBLE_BYTE = {"gbk", "cp950", "cp932", "cp949"}
#: Bits by which a restoration must be cheaper.
UTF8_MARGIN, OTHER_MARGIN, OTHER_SHARE = 3.0, 8.0, 0.3
#: Wide characters that a two-byte encoding must yield to prove itself: at once, and after other steps.
OTHER_LEAST, AGAIN_LEAST = 2, 6
#: Most bits a wide character of a text restored from a two-byte encoding may cost on average.
OTHER_BITS = 6.0
#: Share of a decoded text that may be lost bytes.
MOST_LOST = 0.2
#: Bits of an escape, beside those of its characters.
ESCAPE_BITS = 6.0
#: A line is looked at if it holds a character of more than this many bits.
ORDINARY_BITS = 8.0

_ESCAPE = r"&(?:#\d{2,7}|#x[0-9A-Fa-f]{2,6}|[A-Za-z][A-Za-z0-9]{1,30});|\\u[0-9a-fA-F]{4}|(?:%[0-9A-Fa-f]{2}){2,}"
_ESCAPES = re.compile(_ESCAPE)
_ESCAPED_RUN = re.compile(f"(?:{_ESCAPE})+(?:[ -]?(?:{_ESCAPE})+)*")
_ADDRESS_OR_ESCAPE = re.compile(f"(?P<address>https?://\\S+)|{_ESCAPE}")
_IDEOGRAPHIC = re.compile("[⺀-鿿가-힯豈-﫿︰-￯]+")
_WORD = re.compile("[^ \t\ufffd]+")
_LOST_LETTER = re.compile(r"(?<![?\w])\?[a-z]{2,}\?(?!\w)|[A-Za-z]\?[a-z]{2,}|[a-z]\?[a-z]+\?")


def _keep_controls(error: UnicodeError):
    """Encode the C1 controls that stand for bytes undefined in a code page as those bytes."""
    if isinstance(error, UnicodeEncodeError):
        part = error.object[error.start : error.end]
        if all(0x80 <= ord(c) < 0xA0 for c in part):
            return part.encode("latin-1"), error.end
    raise error


codecs.register_error("folio_controls", _keep_controls)


@lru_cache(maxsize=1 << 14)
def _misplaced(char: str) -> bool:
    return char == "�" or 0x80 <= ord(char) < 0xA0 or unicodedata.category(char) in ("Cn", "Co", "Cs")


class GarbleSearch:
    """Finds and restores garbled passages, given the characters' costs."""

    def __init__(self, costs: dict[str, float]):
        self.costs = costs
        self.unseen = costs.get("", WORST)
        ordinary = {c for c, bits in costs.items() if c and bits <= ORDINARY_BITS and self._plain(c)}
        ordinary |= {chr(c) for c in range(32, 127)} | set("\n\r\t　‘’“”—–…、。，：；？！（）「」『』《》·℃")
        self.odd = re.compile("[^" + re.escape("".join(sorted(ordinary))) + "]")

    @staticmethod
    def _plain(char: str) -> bool:
        """Characters whose frequency is evidence: ideographs and full-width forms."""
        return "㐀" <= char <= "鿿" or "！" <= char <= "～" or "　" <= char <= "〿"

    def cost(self, text: str) -> float:
        get, unseen = self.costs.get, self.unseen
        total = 0.0
        for char in text:
            bits = get(char, unseen)
            total += bits if bits < 1 or not _misplaced(char) else WORST
        if "&" in text or "\\u" in text or "%" in text:
            total += ESCAPE_BITS * len(_ESCAPES.findall(text))
        return total

    def search(self, passage: str, hint: tuple[str, ...] = ()) -> tuple[float, str, tuple[str, ...]]:
        """Gain in bits, cheapest acceptable text and the path to it; no gain leaves the passage.

        ``hint`` is the path that restored another passage of the same text: if it restores this one
        without loss, nothing else is tried.
        """
        start = self.cost(passage)
        if hint and (again := self._follow(passage, hint)) is not None:
            gain = start - self.cost(again)
            if "\ufffd" not in again and self._proves(passage, again, hint, gain, start):
                return gain, again, hint
        best = (0.0, passage, ())
        # price of the text a node stands for, order of arrival, state, path, price of the text before
        frontier: list[tuple[float, int, str | bytes, tuple[str, ...], float]] = [(start, 0, passage, (), math.inf)]
        visited = {(str, hash(passage))}
        count = 0
        while frontier:
            cost, _, state, path, before = heapq.heappop(frontier)
            if isinstance(state, str) and not self._goes_on(state, cost, before):
                continue
            for step, reached, price in self._edges(state, cost, path):
                mark = (type(reached), hash(reached))  # a text and its bytes may hash alike
                if mark in visited:
                    continue
                visited.add(mark)
                count += 1
                if isinstance(reached, str):
                    gain = start - price
                    if gain <= 0 or not self._proves(passage, reached, (*path, step), gain, start):
                        continue
                    if gain > best[0]:
                        best = (gain, reached, (*path, step))
                heapq.heappush(frontier, (price, count, reached, (*path, step), cost))
        return best

    def _goes_on(self, text: str, cost: float, before: float) -> bool:
        """Whether a text is worth expanding: it must be cheaper than the one before, and still be odd."""
        return cost < before and (before == math.inf or "\ufffd" not in text and (self.odd.search(text) is not None or _ESCAPES.search(text) is not None))

    def _edges(self, state: str | bytes, cost: float, path: tuple[str, ...]) -> Iterator[tuple[str, str | bytes, float]]:
        if isinstance(state, bytes):
            for name in WRITTEN_IN:
                if path[-1] == f"encode {name}":  # back to where it came from
                    continue
                text = state.decode(name, "replace")
                lost = text.count("\ufffd")
                if lost and (len(path) > 1 or lost > MOST_LOST * len(text) + 1):  # what was already right loses nothing
                    continue
                yield f"decode {name}", text, self.cost(text)
            return
        for name in READ_WITH:
            try:
                raw = state.encode(name, "folio_controls")
            except UnicodeError:
                continue
            if not raw.isascii():
                yield f"encode {name}", raw, cost
        if _ESCAPES.search(state):
            plain = _unescape(state)
            if plain != state:
                yield "unescape", plain, self.cost(plain)

    @staticmethod
    def _follow(passage: str, path: tuple[str, ...]) -> str | None:
        state: str | bytes = passage
        try:
            for step in path:
                what, _, name = step.partition(" ")
                state = state.encode(name, "folio_controls") if what == "encode" else state.decode(name) if what == "decode" else _unescape(state)
        except UnicodeError:
            return None
        return state

    def _proves(self, passage: str, reached: str, path: tuple[str, ...], gain: float, start: float) -> bool:
        step = path[-1]
        lost = reached.count("\ufffd")
        if step == "unescape":
            made = Counter(c for c in reached if c > "\x7f")
            made.subtract(c for c in passage if c > "\x7f")
            return gain > UTF8_MARGIN and not lost and any(n > 0 and c.isalpha() for c, n in made.items()) and not any(map(_misplaced, made))
        if step == "decode utf-8":
            return gain > UTF8_MARGIN and sum(c > "\x7f" for c in reached) > 2 * lost
        wide = [c for c in reached if "\u3000" <= c <= "\u9fff" or "\uff01" <= c <= "\uff5e"]
        if len(wide) < (OTHER_LEAST if len(path) == 2 else AGAIN_LEAST) or lost > MOST_LOST * len(wide) or self.cost("".join(wide)) > OTHER_BITS * len(wide):
            return False
        return gain > max(OTHER_MARGIN, OTHER_SHARE * start)

    def passages(self, text: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
        """(start, end, restored or the passage itself, path) of each garbled passage, in order."""
        found: list[tuple[int, int, str, tuple[str, ...]]] = []
        if self.odd.search(text) is None and not _ESCAPES.search(text) and "?" not in text:
            return found
        at = 0
        hint: tuple[str, ...] = ()
        for line in text.split("\n"):
            if self.odd.search(line) or _ESCAPES.search(line):
                spans = self._line(line, hint)
                hint = next((path for *_, path in spans if path), hint)
                found += [(at + a, at + b, fixed, path) for a, b, fixed, path in spans]
            at += len(line) + 1
        if found:
            found += self._lost_letters(text, found)
            found.sort()
        return found

    def _line(self, line: str, hint: tuple[str, ...]) -> list[tuple[int, int, str, tuple[str, ...]]]:
        body = line.strip(" \t\r")
        lead = line.find(body) if body else 0
        if "\ufffd" not in body:
            gain, fixed, path = self.search(body, hint)
            if gain > 0 and self.odd.search(fixed) is None and path != ("unescape",):
                return [(lead, lead + len(body), fixed, path)]
            parts = self._parts(line, hint)
            if gain > 0 and gain >= sum(part[-1] for part in parts) and path != ("unescape",):
                return [(lead, lead + len(body), fixed, path)]
        else:
            return self._lossy(line, hint)
        found = [part[:4] for part in parts]
        for m in re.finditer("[^ ]*[\x80-\x9f][^ ]*", line):  # what no path restores, but is garbled
            if not any(a < m.end() and m.start() < b for a, b, *_ in found):
                found.append((*m.span(), m.group(), ()))
        return sorted(found)

    def _lossy(self, line: str, hint: tuple[str, ...]) -> list[tuple[int, int, str, tuple[str, ...]]]:
        """A line that lost characters is one passage from its first odd character to its last; what
        stands between the losses is restored where it is long enough to prove anything."""
        marks = [m.start() for m in self.odd.finditer(line)]
        start, end = marks[0], marks[-1] + 1
        pieces = [p for p in self._pieces(line, hint) if start <= p[0] and p[1] <= end]
        path = max(pieces, key=lambda p: p[-1])[3] if pieces else ()
        inner = [(a - start, b - start, fixed, path) for a, b, fixed, *_ in pieces]
        return [(start, end, splice(line[start:end], inner), path)]

    def _pieces(self, line: str, hint: tuple[str, ...]) -> list[tuple[int, int, str, tuple[str, ...], float]]:
        """What stands between replacement characters and is cheaper when decoded anew."""
        found = []
        for m in re.finditer("[^\ufffd]{2,}", line):
            if self.odd.search(m.group()):
                gain, fixed, path = self.search(m.group(), hint)
                if gain > 0:
                    found.append((m.start(), m.end(), fixed, path, gain))
        return found

    def _parts(self, line: str, hint: tuple[str, ...]) -> list[tuple[int, int, str, tuple[str, ...], float]]:
        """Runs without ideographs, else words, that are cheaper when decoded anew."""
        found = []
        for m in _ESCAPED_RUN.finditer(line):  # an escape ends where it ends; what stands around it is not garbled by it
            if "://" not in line[line.rfind(" ", 0, m.start()) + 1 : m.start()]:
                gain, fixed, path = self.search(m.group())
                if gain > 0:
                    found.append((*m.span(), fixed, path, gain))
        at = 0
        runs: list[tuple[int, int]] = []
        for m in _IDEOGRAPHIC.finditer(line):  # ideographs stand between the runs
            runs.append((at, m.start()))
            at = m.end()
        runs.append((at, len(line)))
        for a, b in runs:
            if b <= a or self.odd.search(line, a, b) is None or any(x < b and a < y for x, y, *_ in found):
                continue
            gain, fixed, path = self.search(line[a:b], hint) if b - a < len(line) else (0.0, "", ())
            if gain > 0:
                found.append((a, b, fixed, path, gain))
        for m in _WORD.finditer(line):
            a, b = m.span()
            if self.odd.search(line, a, b) and not any(x < b and a < y for x, y, *_ in found):
                gain, fixed, path = self.search(m.group(), hint)
                if gain > 0:
                    found.append((a, b, fixed, path, gain))
        return sorted(found, key=lambda f: f[0])

    @staticmethod
    def _lost_letters(text: str, found: list) -> list[tuple[int, int, str, tuple[str, ...]]]:
        """Question marks inside words, where the text is garbled elsewhere: letters that were lost."""
        return [(m.start(), m.end(), m.group(), ()) for m in _LOST_LETTER.finditer(text) if not any(a < m.end() and m.start() < b for a, b, *_ in found)]


def _unescape(text: str) -> str:
    """Escapes replaced by what they stand for, but in addresses of the web; bytes are read as UTF-8."""

    def plain(m: re.Match) -> str:
        piece = m.group()
        if m.group("address"):
            return piece
        if piece[0] == "&":
            return html.unescape(piece)
        if piece[0] == "\\":
            return chr(int(piece[2:], 16))
        try:
            return bytes.fromhex(piece.replace("%", "")).decode("utf-8")
        except UnicodeDecodeError:
            return piece

    out = _ADDRESS_OR_ESCAPE.sub(plain, text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", out) else out


def splice(text: str, passages: list[tuple[int, int, str, tuple[str, ...]]]) -> str:
    """The text with each passage replaced by its restoration."""
    out, at = [], 0
    for a, b, fixed, _ in passages:
        if a < at:
            continue
        out += [text[at:a], fixed]
        at = b
    return "".join([*out, text[at:]])


def repair_encoding(df: DataFrame, id_col: str, column: str, costs: dict[str, float] | None = None) -> DataFrame:
    """id, affected, restored, lost, passages: one row per input row with an id.

    ``restored`` is the text with every restorable passage put right (the text itself where nothing
    was wrong, null for a null text); ``lost`` counts passages that can't be restored at all; ``passages``
    holds start, end, text and path of each in code points of the input.
    """
    shared = broadcast(df, character_costs(df, column) if costs is None else costs)  # at most one entry per code point

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        searcher = GarbleSearch(shared.value)
        for row_id, text in rows:
            if row_id is None:
                continue
            found = searcher.passages(text) if text else []
            restored = splice(text, found) if found else text
            spans = [{"start": a, "end": b, "text": text[a:b], "path": list(path)} for a, b, _, path in found]
            yield row_id, bool(found), restored, sum(not path for *_, path in found), spans

    kind = "affected boolean, restored string, lost int, passages array<struct<start:int,end:int,text:string,path:array<string>>>"
    return map_rows(df.select(id_col, column), run, f"{id_col} bigint, {kind}", flush=512)


def garbled_ids(df: DataFrame, id_col: str, column: str, costs: dict[str, float] | None = None) -> DataFrame:
    """Ids of the rows that hold a garbled passage, each once."""
    return repair_encoding(df, id_col, column, costs).filter("affected").select(id_col).distinct()
