"""Problem 8: the subjects a document is about.

The terms of a subject are curated: ``subject_terms`` lists them in both languages, beside the words
of the subject's titles and scope note. Their weights are fitted on labelled samples: how much likelier
a term makes the subject, times its rarity. A multi-pattern automaton finds all terms of all subjects
in one pass over a whole text. A sentence's score for a subject is the sum of its distinct terms' weights
normalised by the sentence's length; the sentence is about every subject whose own calibrated
threshold it reaches, and a document is about every subject that at least a third of its sentences
are about.

The model is fitted on the driver from the labelled samples, a table of fixed size (``MOST_SAMPLES``
bounds it); everything else runs on all documents in one narrow pass.

Defined cases: null, empty and blank texts have no subject; in a text without any sentence mark every
line with words is a sentence; samples with null text are left out, those with null subjects count as
having none; without samples no threshold is calibrated and nothing has a subject; ties with a threshold count as about.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import broadcast, map_rows
from .subject_terms import CURATED

#: Labelled rows used to fit the model; the lowest ids, should there be more.
MOST_SAMPLES = 5000
#: Rounds of guessing what the samples' sentences are about: their labels only say it of the whole.
ROUNDS = 3
#: Preference for a subject that the sample is labelled with.
LABELLED = 1.5
#: Share of the best subject's score from which a sample's sentence counts as about another subject too.
ALSO = 0.6
#: Weight of terms that no sample has, as a share of the mean weight.
UNSEEN = 0.8
#: Least log-odds of a term that counts.
LEAST_ODDS = 0.7
#: Share of the sentences from which a document is about a subject, as a fraction.
SHARE = (1, 3)

_SENTENCE = re.compile("[^。！？!?\\n]+?(?:[。！？!?]+|(?<!\\d)\\.(?=\\s|[”’\"')\\]]|$)|\\n|$)[”’」』\"')\\]]*|[^。！？!?\\n]+")
_CONTENT = re.compile("[a-zA-Z]{2,}|[㐀-鿿]{2,}")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Where the sentences stand: pieces that end with a sentence mark; lines, where no piece does."""
    spans, lines, at = [], [], 0
    for line in text.split("\n"):
        if line.strip() and _CONTENT.search(line) and not line.startswith(("|", "#")):
            lines.append((at, at + len(line)))
        for m in _SENTENCE.finditer(line):
            piece = m.group().strip()
            if piece and _is_sentence(piece) and _CONTENT.search(piece):
                start = m.start() + len(m.group()) - len(m.group().lstrip())
                spans.append((at + start, at + start + len(piece)))
        at += len(line) + 1
    return spans or lines


def sentences(text: str) -> list[str]:
    """The sentences of a text."""
    return [text[a:b] for a, b in sentence_spans(text)]


def _is_sentence(piece: str) -> bool:
    """Headings, labels, greetings and table rows are no sentences."""
    if piece.startswith(("|", "#")):
        return False
    return piece[-1] in "。！？.!?”’」』\"')]" and len(piece) >= 8


@dataclass
class SubjectModel:
    """Weights of the terms for each subject, and the score a sentence must reach for it."""

    subjects: list[str]
    #: Term as it is searched for: whether it may go on, and its weight for each subject by number.
    terms: dict[str, tuple[bool, dict[int, float]]] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def automaton(self):
        """All terms of all subjects in one automaton."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, (open_end, weights) in self.terms.items():
            if weights:
                machine.add_word(term, (len(term), open_end, term, tuple(weights.items())))
        if len(machine):
            machine.make_automaton()
        return machine


def curated(subjects: list[str], titles: dict[str, Iterable[str | None]]) -> dict[str, tuple[bool, dict[int, float]]]:
    """The terms of the subjects, each of weight one, from the curated list and the titles and notes."""
    found: dict[str, tuple[bool, dict[int, float]]] = {}
    for i, subject in enumerate(subjects):
        zh, en = CURATED.get(subject, ("", ""))
        said = [w for title in titles.get(subject, ()) for w in re.findall("[a-z]{4,}|[㐀-鿿]{2,}", (title or "").lower())]
        for term in [*zh.split(), *(" ".join(t.split()) for t in en.split(",")), *said, subject.lower()]:
            open_end = term.endswith("-")
            term = term.rstrip("-")
            if term and (term not in found or i not in found[term][1]):
                before = found.get(term, (open_end, {}))
                found[term] = (before[0] or open_end, before[1] | {i: 1.0})
    return found


def _hits(text: str, machine, spans: list[tuple[int, int]]) -> list[dict[str, tuple[tuple[int, float], ...]]]:
    """The distinct terms of each sentence with their weights, from one pass over the text."""
    hits: list[dict[str, tuple[tuple[int, float], ...]]] = [{} for _ in spans]
    if not spans or not len(machine):
        return hits
    lower = text.lower()
    if len(lower) != len(text):  # some letters grow in lower case
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    at, (start, end), size = 0, spans[0], len(lower)
    for last, (length, open_end, term, weights) in machine.iter(lower):
        while last >= end and at + 1 < len(spans):
            at += 1
            start, end = spans[at]
        first = last - length + 1
        if first < start or last >= end:
            continue
        if term[0] <= "⺀":
            if first and lower[first - 1].isalpha():
                continue
            after = last + 1
            if not open_end and after < size and lower[after].isalpha():
                if lower[after] != "s" or after + 1 < size and lower[after + 1].isalpha():
                    continue
        hits[at][term] = weights
    return hits


def _scores(text: str, hits: list[dict], spans: list[tuple[int, int]]) -> list[dict[int, float]]:
    """Score of each sentence for the subjects that any of its terms speaks for, normalised by length."""
    table = []
    for found, (a, b) in zip(hits, spans):
        row: dict[int, float] = {}
        if found:
            size = math.sqrt(max(1.0, (b - a) / (40 if text[a:b].isascii() else 15)))
            for weights in found.values():
                for subject, weight in weights:
                    row[subject] = row.get(subject, 0.0) + weight / size
        table.append(row)
    return table


def about(text: str, machine, model: SubjectModel) -> list[tuple[int, int, int]]:
    """(subject, sentences about it, sentences) of every subject with a share of at least a third."""
    spans = sentence_spans(text)
    counts: Counter = Counter()
    for row in _scores(text, _hits(text, machine, spans), spans):
        counts.update(s for s, score in row.items() if score >= model.thresholds[s])
    return [(s, n, len(spans)) for s, n in sorted(counts.items()) if n * SHARE[1] >= len(spans) * SHARE[0]]


def fit(samples: Iterable[tuple[str | None, list[str] | None]], subjects: list[str], titles: dict[str, Iterable[str | None]] | None = None) -> SubjectModel:
    """Weights by a few rounds of guessing each sentence's subjects among its sample's, then the thresholds."""
    index = {s: i for i, s in enumerate(subjects)}
    rows = [(text, frozenset(index[s] for s in labels or () if s in index)) for text, labels in samples if text]
    model = SubjectModel(subjects, curated(subjects, titles or {}), [math.inf] * len(subjects))
    machine = model.automaton()
    texts = [(text, spans, _hits(text, machine, spans), labels) for text, labels in rows if (spans := sentence_spans(text))]
    parts = [(frozenset(found), labels) for _, _, hits, labels in texts for found in hits]
    if not any(found for found, _ in parts):
        return model
    for _ in range(ROUNDS):
        guessed = []
        for found, labels in parts:
            score: Counter = Counter()
            for term in found:
                for s, weight in model.terms[term][1].items():
                    score[s] += weight * (LABELLED if s in labels else 1.0)
            best = max(score.values(), default=0.0)
            guessed.append((found, frozenset(s for s, v in score.items() if v >= ALSO * best) if best > 0 else frozenset()))
        _weigh(model, guessed)
    scored = [(_scores(text, [{t: tuple(model.terms[t][1].items()) for t in found} for found in hits], spans), labels) for text, spans, hits, labels in texts]
    model.thresholds = [_threshold(scored, s) for s in range(len(subjects))]
    return model


def _weigh(model: SubjectModel, guessed: list[tuple[frozenset[str], frozenset[int]]]) -> None:
    """New weights: log-odds of the subject given the term, times the term's rarity."""
    total: Counter = Counter()
    inside: Counter = Counter()
    per: Counter = Counter()
    for found, subjects in guessed:
        per.update(subjects)
        total.update(found)
        inside.update((term, s) for term in found for s in subjects)
    everything = len(guessed)
    seen: list[float] = []
    for term, (_, weights) in model.terms.items():
        n = total[term]
        for s in list(weights) if n else ():
            k = inside[term, s]
            odds = math.log((k + 0.5) / (per[s] + 1)) - math.log((n - k + 0.5) / (everything - per[s] + 1))
            rarity = math.log((everything + 1) / (n + 0.5)) / math.log(everything + 1)
            weights[s] = odds * rarity if odds >= LEAST_ODDS else 0.0
            seen.append(weights[s])
    usual = UNSEEN * sum(seen) / max(1, len(seen))
    for term, (_, weights) in model.terms.items():
        if not total[term]:
            weights.update(dict.fromkeys(weights, usual))


def _threshold(scored: list[tuple[list[dict[int, float]], frozenset[int]]], subject: int) -> float:
    """The subject's threshold of most agreement with the samples' labels; of equal ones the middle."""
    results = []
    for step in range(1, 81):
        threshold = step * 0.1
        right = wrong = missed = 0
        for table, labels in scored:
            n = sum(row.get(subject, 0.0) >= threshold for row in table)
            said, true = n * SHARE[1] >= len(table) * SHARE[0], subject in labels
            right, wrong, missed = right + (said and true), wrong + (said and not true), missed + (true and not said)
        results.append((2 * right / max(1, 2 * right + wrong + missed), threshold))
    top = max(results)[0]
    best = [t for f, t in results if f == top]
    return best[len(best) // 2]


def document_subjects(df: DataFrame, id_col: str, column: str, samples: DataFrame, areas: DataFrame) -> DataFrame:
    """id, subject, about, sentences: a row for each subject a document is about."""
    named = [r.asDict() for r in areas.filter(F.col("subject").isNotNull()).collect()]  # a row a subject
    titles: dict[str, list[str | None]] = {}
    for row in named:
        titles.setdefault(row["subject"], []).extend(row.get(c) for c in ("title_en", "title_zh", "scope_note"))
    picked = samples.filter(F.col("text").isNotNull()).select("sample_id", "text", "subjects").orderBy("sample_id").limit(MOST_SAMPLES)
    model = broadcast(df, fit([(r["text"], r["subjects"]) for r in picked.collect()], sorted(titles), titles))  # bounded by MOST_SAMPLES

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        machine = model.value.automaton()
        for row_id, text in rows:
            if row_id is not None and text:
                for s, n, total in about(text, machine, model.value):
                    yield row_id, model.value.subjects[s], n, total

    return map_rows(df.select(id_col, column), run, f"{id_col} bigint, subject string, about int, sentences int")
