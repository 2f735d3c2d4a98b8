"""Problem 2: text that shows like ordinary text and is spelled with other characters.

What is unambiguous is put right character by character: full-width Latin letters and at signs,
compatibility and radical forms, letters with a separate accent that have a composed form, no-break
spaces, characters of no width. Look-alike letters are judged by token: a token's dominant script is
that of its letters which no other script has a double for, else that of most letters; only in a
token of mixed scripts are the others' letters replaced by their doubles, and only when the result
is in the corpus vocabulary: a token of one script that any text holds, or one made of two parts of such
tokens (a whole one, or a beginning and an ending that ``SHARED_BY`` different ones share), as names and
compounds are that no text spells ordinarily. A mixed token whose result is not in the vocabulary stays as
it is, is reported as suspected and makes no case by itself.

Garbled passages (problem 3) are left alone. No cases: Chinese punctuation, the ideographic space,
composed accents, typographic quotes, words wholly in one script, joiners inside emoji.

Defined cases: a null text stays null and needs nothing; empty texts likewise; other columns with any
name are ignored; each row comes out once for each input row with an id.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow import broadcast, map_rows
from .charstats import character_costs
from .garble import GarbleSearch

#: Letters of other scripts that look like a Latin letter.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝӏкмтвнгпбАВЕЗКМНОРСТУХІЈЅЬӧӓёѐїҫӡ", "aeopcyxijshdqwlkmtbhrnbABE3KMHOPCTYXIJSböäëèïçʒ"))
GREEK = dict(zip("ανορικυτγηχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "avopikutynxwABEZHIKMNOPTYX"))
#: Letters that are taken for no Latin letter's double even though the tables map them.
_WEAK = set("кмтвнгпбЬӡγηωкЗ")
SPACES = "   "
WIDTHLESS = "­͏᠎​‌‍⁠⁡⁢⁣⁤﻿"
#: Radical forms without a compatibility mapping of their own.
RADICALS = {"⺀": "丶", "⺃": "乚", "⺅": "亻", "⺈": "刀", "⺉": "刂", "⺌": "小", "⺕": "彐", "⺗": "心", "⺘": "扌", "⺝": "月", "⺠": "民", "⺡": "氵", "⺣": "灬", "⺤": "爪", "⺥": "爫", "⺩": "王", "⺫": "目", "⺬": "示", "⺮": "竹", "⺯": "糸", "⺲": "罒", "⺶": "羊", "⺷": "羊", "⺻": "聿", "⺼": "月", "⺾": "艹", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "見", "⻆": "角", "⻈": "訁", "⻉": "貝", "⻋": "車", "⻌": "辶", "⻑": "長", "⻒": "長", "⻓": "長", "⻔": "門", "⻘": "青", "⻙": "韋", "⻚": "頁", "⻛": "風", "⻜": "飛", "⻝": "食", "⻢": "馬", "⻤": "鬼", "⻥": "魚", "⻦": "鳥", "⻨": "麥", "⻩": "黃", "⻬": "齊", "⻮": "齒", "⻰": "龍"}

#: A beginning or ending belongs to the vocabulary if so many different words share it, and has so many letters.
SHARED_BY, LEAST_PART = 3, 3

_FULLWIDTH = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0xFF20))


def _compatibility() -> dict[str, str]:
    """Letters that stand for other letters: by Unicode's own decompositions, not by a list."""
    table = {}
    for point in (*range(0x80, 0x3131), *range(0x318F, 0xD800), *range(0xF900, 0xFFDD), *range(0x1D400, 0x1D7CC), *range(0x2F800, 0x2FA20)):
        char = chr(point)
        if char in "ªºµ" or char in _FULLWIDTH or not unicodedata.decomposition(char):
            continue
        plain = unicodedata.normalize("NFKC", char)
        if plain == char:
            continue
        radical = 0x2E80 <= point < 0x2FE0
        ideograph = 0xF900 <= point < 0xFB00 or point >= 0x2F800
        letter = unicodedata.category(char) in ("Lu", "Ll", "Lt", "Lo") and all(unicodedata.category(c)[0] in "LM" for c in plain)
        if radical or ideograph or letter:
            table[char] = plain
    return table | RADICALS


COMPATIBLE = _compatibility()
_REPLACED = str.maketrans(COMPATIBLE | {c: unicodedata.normalize("NFKC", c) for c in _FULLWIDTH})
_PLAIN_KINDS = {"full_width": frozenset(_FULLWIDTH), "compatibility": frozenset(COMPATIBLE), "space": frozenset(SPACES)}
_WIDTHLESS = re.compile(f"[{WIDTHLESS}]")
_MARKED = re.compile("[^\\W\\d_][̀-ͯ]+")
_TOKEN = re.compile("(?:[^\\W\\d_][̀-ͯ]*)+")
_OTHER = re.compile("[Ͱ-ϿЀ-ԯ]")
#: Characters without which a text is spelled ordinarily. A set is probed faster than a class of astral ranges.
_DOUBTFUL = frozenset(_FULLWIDTH) | frozenset(SPACES) | frozenset(WIDTHLESS) | frozenset(COMPATIBLE) | frozenset(map(chr, (*range(0x300, 0x370), *range(0x370, 0x400), *range(0x400, 0x530))))
_EMOJI = re.compile("[←-⯿〰〽️\U0001f000-\U0001faff⃣]")


def script(letter: str) -> str:
    """latin, greek, cyrillic or other."""
    if letter < "ɐ" or "Ḁ" <= letter < "ἀ":
        return "latin"
    if "Ͱ" <= letter < "Ѐ" or "ἀ" <= letter < " ":
        return "greek"
    return "cyrillic" if "Ѐ" <= letter < "԰" else "other"


def dominant(token: str) -> str | None:
    """The script a token of mixed Latin, Greek and Cyrillic letters is meant in; None if not mixed."""
    sure: dict[str, int] = {}
    every: dict[str, int] = {}
    for letter in token:
        if unicodedata.combining(letter):
            continue
        kind = script(letter)
        every[kind] = every.get(kind, 0) + 1
        double = letter in _LATIN_DOUBLES if kind == "latin" else letter not in _WEAK and (letter in CYRILLIC or letter in GREEK)
        if not double:
            sure[kind] = sure.get(kind, 0) + 1
    if "other" in every or len(every) < 2:
        return None
    scores = sure or every
    return max(scores, key=lambda k: (scores[k], every[k], k == "latin"))


_LATIN_DOUBLES = {latin for letter, latin in (CYRILLIC | GREEK).items() if letter not in _WEAK}
_TO_LATIN = str.maketrans(GREEK | CYRILLIC)
_TO_CYRILLIC = str.maketrans({v: k for k, v in CYRILLIC.items() if k not in _WEAK} | {g: c for c, v in CYRILLIC.items() for g, w in GREEK.items() if v == w and c not in _WEAK})
_TO_GREEK = str.maketrans({v: k for k, v in GREEK.items() if k not in _WEAK} | {c: g for c, v in CYRILLIC.items() for g, w in GREEK.items() if v == w and g not in _WEAK})
_INTO = {"latin": _TO_LATIN, "cyrillic": _TO_CYRILLIC, "greek": _TO_GREEK}


def spelled_in(token: str, target: str) -> str | None:
    """The token with the doubles of the target script, or None if a letter has none."""
    fixed = unicodedata.normalize("NFC", token.translate(_INTO[target]))
    return fixed if all(script(c) == target or unicodedata.combining(c) for c in fixed) else None


def plain_form(text: str) -> tuple[str, list[str]]:
    """The text without the unambiguous cases, and which kinds it had."""
    kinds = [name for name, chars in _PLAIN_KINDS.items() if not chars.isdisjoint(text)]
    out = text.translate(_REPLACED).translate({ord(c): " " for c in SPACES}) if kinds else text

    def widthless(match: re.Match) -> str:
        a, b = match.span()
        if match.group() == "‍" and a and _EMOJI.match(match.string[a - 1]) and _EMOJI.match(match.string[b : b + 1]):
            return match.group()
        return ""

    if _WIDTHLESS.search(out):
        cleaned = _WIDTHLESS.sub(widthless, out)
        if cleaned != out:
            kinds.append("widthless")
            out = cleaned
    composed = _MARKED.sub(lambda m: unicodedata.normalize("NFC", m.group()), out)
    if composed != out:
        kinds.append("accent")
    return composed, kinds


def mixed_tokens(text: str) -> dict[str, list[str]]:
    """The possible meant forms of each token of mixed scripts: in its dominant script, then in Latin."""
    found = {}
    for m in _TOKEN.finditer(text):
        token = m.group()
        if _OTHER.search(token) and (target := dominant(token)):
            forms = [spelled_in(token, into) for into in dict.fromkeys((target, "latin"))]
            found[token] = [form for form in forms if form]
    return found


class _Pieces:
    """The parts of a text outside its garbled passages."""

    def __init__(self, searcher: GarbleSearch):
        self.searcher = searcher

    def __call__(self, text: str) -> list[tuple[bool, str]]:
        out, at = [], 0
        for a, b, *_ in self.searcher.passages(text):
            if a >= at:
                out += [(True, text[at:a]), (False, text[a:b])]
                at = b
        return [*out, (True, text[at:])]


_MIXED = "array<struct<token:string,forms:array<string>>>"
_REPAIRED = "array<struct<token:string,form:string>>"


def _first_pass(df: DataFrame, id_col: str, column: str, shared) -> DataFrame:
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        pieces = _Pieces(GarbleSearch(shared.value))
        for row_id, text in rows:
            if row_id is None:
                continue
            if not text or _DOUBTFUL.isdisjoint(text):
                yield row_id, text, [], []
                continue
            done, kinds, mixed = [], [], {}
            for sound, piece in pieces(text):
                if sound and not _DOUBTFUL.isdisjoint(piece):
                    piece, had = plain_form(piece)
                    kinds += had
                    mixed |= mixed_tokens(piece)
                done.append(piece)
            yield row_id, "".join(done), sorted(set(kinds)), [{"token": t, "forms": f} for t, f in mixed.items()]

    return map_rows(df.select(id_col, column), run, f"row_id bigint, plain string, kinds array<string>, mixed {_MIXED}", flush=1024)


def vocabulary_forms(df: DataFrame, column: str) -> DataFrame:
    """form: every token of one script in the corpus, lower case; repeated ones merged per partition first."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        seen: set[str] = set()
        cut = re.compile("[^\\W\\d_]+").findall
        wide = re.compile("[⺀-￿\U00010000-\U0010ffff]+")
        for (text,) in rows:
            if text:
                tokens = set(cut(wide.sub(" ", text).lower())) - seen
                seen |= tokens
                for token in tokens:
                    if token.isascii() or len({script(c) for c in token}) == 1:
                        yield (token,)
                if len(seen) > 1_000_000:
                    seen.clear()

    return map_rows(df.select(column), run, "form string").distinct()


def _compounds(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """token, place, form of the forms made of two parts of the vocabulary; only parts that are asked about are counted."""
    unknown = cut_lineage(unknown)
    longest = unknown.agg(F.max(F.length("form"))).first()[0]  # no longer part can be asked about
    if longest is None:
        return unknown
    form = F.lower("form")
    cuts = F.sequence(F.lit(2), F.length("form") - 2)
    split = unknown.filter(F.length("form") >= 4).select("token", "place", "form", F.explode(cuts).alias("cut"))
    split = split.select("token", "place", "form", F.left(form, F.col("cut")).alias("first"), F.substr(form, F.col("cut") + 1).alias("last"))
    sides = {}
    for side, part in (("first", lambda n: F.left("word", n)), ("last", lambda n: F.right("word", n))):
        sizes = F.sequence(F.lit(2), F.least(F.length("word"), F.lit(longest)))
        parts = words.filter(F.length("word") >= 2).select("word", F.explode(sizes).alias("n")).select(part(F.col("n")).alias(side), (F.col("n") == F.length("word")).alias("whole"))
        asked = parts.join(split.select(side).distinct(), side, "left_semi")
        counted = asked.groupBy(side).agg(F.count("*").alias("n"), F.max("whole").alias("whole"))
        sides[side] = counted.filter(f"whole or n >= {SHARED_BY} and length({side}) >= {LEAST_PART}").select(side)
    return split.join(sides["first"], "first", "left_semi").join(sides["last"], "last", "left_semi").select("token", "place", "form").distinct()


def consistent_spelling(df: DataFrame, id_col: str, column: str, costs: dict[str, float] | None = None) -> DataFrame:
    """id, spelling, kinds, repaired, suspected: one row per input row with an id.

    ``spelling`` is the text in its one consistent form; ``kinds`` names what needed it (full_width,
    compatibility, space, widthless, accent, lookalike, suspected); ``repaired`` and ``suspected``
    list the tokens of mixed scripts that were replaced and left.
    """
    shared = broadcast(df, character_costs(df, column) if costs is None else costs)
    first = cut_lineage(_first_pass(df, id_col, column, shared).filter("size(kinds) > 0 or size(mixed) > 0"))
    tokens = first.select(F.explode("mixed").alias("m")).select("m.token", F.posexplode("m.forms").alias("place", "form")).distinct()
    words = cut_lineage(vocabulary_forms(df, column).withColumnRenamed("form", "word"))
    whole = tokens.join(words, F.lower("form") == F.col("word"), "left_semi")
    known = whole.union(_compounds(tokens.join(whole.select("token").distinct(), "token", "left_anti"), words))
    known = known.groupBy(F.col("token").alias("good")).agg(F.min_by("form", "place").alias("fixed"))
    used = first.select("row_id", F.explode("mixed").alias("m")).select("row_id", "m.token").join(known, F.col("token") == F.col("good"), "left")
    judged = used.groupBy("row_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("good").isNotNull(), F.struct("token", F.col("fixed").alias("form"))))).alias("repaired"),
        F.sort_array(F.collect_set(F.when(F.col("good").isNull(), F.col("token")))).alias("suspected"),
    )
    joined = first.join(judged, "row_id", "left").dropDuplicates(["row_id"])

    def finish(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row_id, plain, kinds, repaired, suspected in rows:
            forms = {r["token"]: r["form"] for r in repaired or ()}
            if forms:
                plain = _TOKEN.sub(lambda m: forms.get(m.group(), m.group()), plain)
            kinds = sorted([*kinds, *["lookalike"] * bool(forms), *["suspected"] * bool(suspected)])
            yield row_id, plain, kinds, [{"token": t, "form": f} for t, f in forms.items()], list(suspected or ())

    schema = f"row_id bigint, plain string, kinds array<string>, repaired {_REPAIRED}, suspected array<string>"
    changed = map_rows(joined.select("row_id", "plain", "kinds", "repaired", "suspected"), finish, schema, flush=1024)
    return changed.withColumnsRenamed({"row_id": id_col, "plain": "spelling"})


def misspelled_ids(df: DataFrame, id_col: str, column: str, costs: dict[str, float] | None = None) -> DataFrame:
    """Ids of the rows whose text needed another spelling, each once; tokens only suspected to make no case."""
    needed = F.exists("kinds", lambda kind: kind != "suspected")
    return consistent_spelling(df, id_col, column, costs).filter(needed).select(id_col).distinct()
