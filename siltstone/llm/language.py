"""Languages of texts and of the segments inside mixed texts.

The script of a word, by a table of code point ranges, narrows the candidates to
the languages whose samples are written in it. Every word has a score for each
candidate, from the letter runs and whole words of clean samples; a second pass
adds the confidently labelled sentences of a bounded sample of the texts
themselves. Viterbi over the words of a text, with a penalty for switching the
language that is low between lines and sentences and higher inside them, labels
every word; the runs of one label within a sentence are the spans. Words in a
script without language, and words like none of the samples, speak for no
language, and a sentence with too many of them has no label.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import latest

#: Bounds on what is fitted on the driver: clean samples, and labelled texts of the second pass with the longest that may be among them.
MAX_SAMPLES, FIT_TEXTS, FIT_CHARS = 20_000, 1_500, 20_000
#: Cost of switching the language between lines, between sentences, inside a sentence; in nats.
BETWEEN_LINES, BETWEEN_SENTENCES, INSIDE = 1.0, 2.0, 8.0
#: Range of the score of one word, and weight of its letter runs.
SPREAD, RUN_WEIGHT = 6.0, 0.5
#: What a label adds to each word in the fit of the second pass, in nats.
HINT = 0.7
#: Share of a sentence's words that one language needs for the whole sentence to be written in it.
WHOLE = 0.65
#: Share of a word's three-letter runs that must be known, and share of a sentence's words that must be so.
KNOWN_RUNS, KNOWN_WORDS = 0.5, 0.34
#: Share of the words of a language's samples that make their script one of its own.
SCRIPT_SHARE = 0.05

#: First code points of the ranges of scripts; a range ends where the next one starts.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"),
    (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "cherokee"), (0x1400, "canadian"), (0x1680, "ogham"), (0x16A0, "runic"), (0x1700, "philippine"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "canadian"), (0x1900, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x212A, "latin"), (0x212C, "other"), (0x2C60, "latin"), (0x2C80, "coptic"), (0x2D00, "georgian"), (0x2D30, "tifinagh"),
    (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E00, "han"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3190, "han"),
    (0x31F0, "kana"), (0x3200, "han"), (0xA000, "yi"), (0xA4D0, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAB30, "latin"), (0xAB70, "cherokee"), (0xABC0, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0x10000, "other"), (0x1B000, "kana"), (0x1B300, "other"), (0x20000, "han"),
)
_STARTS = [start for start, _ in SCRIPTS]

#: Spellings of the languages (two- and three-letter codes, English and own names).
SPELLINGS = {
    "de": "de deu ger german deutsch",
    "en": "en eng english englisch",
    "es": "es spa spanish español espanol castellano castilian",
    "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish",
    "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский",
}
_CODES = {name: code for code, names in SPELLINGS.items() for name in names.split()}

SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+")
QUOTED = re.compile("“[^“”\n]*”|«[^«»\n]*»|„[^„“”\n]*[“”]|\"[^\"\n]*\"|`[^`\n]*`")
#: A token with one of these is an address, code or a number.
NO_WORD = re.compile(r"[@_=<>{}\\/|$#\d]|\bwww\.")
#: A command, an assignment, or a comment or prompt that goes on like code.
CODE_LINE = re.compile(r"\s*(?:\$\s|\S+\s*=\s*\S+\s*$|[>#]\s.*[@_=<>{}\\/|$\d])")
NO_WORD_TOKEN = re.compile(rf"(?<!\S)\S*(?:{NO_WORD.pattern})\S*")
_LETTER = r"[^\W\d_]"
WORD = re.compile(f"{_LETTER}+(?:['’]{_LETTER}+)*")
#: The same where letters are followed by combining marks.
MARKED_WORD = re.compile(f"(?:{_LETTER}[\u0300-\u036f]*)+(?:['’](?:{_LETTER}[\u0300-\u036f]*)+)*")


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label names in whatever spelling; None for other or no languages."""
    if not label:
        return None
    low = label.strip().lower()
    return _CODES.get(low) or _CODES.get(re.split(r"[-_ (,;]", low)[0])


def script_of(word: str) -> str:
    """The script of most letters of a word, by the first one at a tie."""
    if word.isascii():
        return "latin"
    return Counter(SCRIPTS[max(0, bisect_right(_STARTS, ord(c)) - 1)][1] for c in word if c.isalpha()).most_common(1)[0][0]


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


@dataclass(slots=True)
class Sentence:
    """The words of a sentence, and where to find them: the part of a line, which starts at ``offset`` in the text."""

    line: int
    words: list[str]
    plain: str
    start: int
    stop: int
    offset: int
    pattern: re.Pattern

    def places(self) -> list[tuple[int, int]]:
        """Positions of each word in the text."""
        return [(self.offset + m.start(), self.offset + m.end()) for m in self.pattern.finditer(self.plain, self.start, self.stop)]


def sentences(text: str) -> Iterator[Sentence]:
    """The sentences with counted words; lines end at every line feed.

    Quoted phrases, code, addresses and numbers have no counted words.
    """
    pattern = WORD if unicodedata.is_normalized("NFC", text) else MARKED_WORD
    offset = 0
    for line_no, line in enumerate(text.split("\n")):
        if line and not CODE_LINE.match(line):
            plain = QUOTED.sub(_blank, line)
            if NO_WORD.search(plain):
                plain = NO_WORD_TOKEN.sub(_blank, plain)
            at = 0
            for stop, after in [*(m.span() for m in SENTENCE_END.finditer(plain)), (len(plain), len(plain))]:
                if found := pattern.findall(plain, at, stop):
                    words = " ".join(found).lower()
                    if pattern is MARKED_WORD:
                        words = unicodedata.normalize("NFC", words)
                    yield Sentence(line_no, words.split(" "), plain, at, stop, offset, pattern)
                at = after
        offset += len(line) + 1


def letter_runs(word: str, sizes: tuple[int, ...] = (1, 2, 3, 4)) -> Iterator[str]:
    framed = f"<{word}>"
    for n in sizes:
        for i in range(len(framed) - n + 1):
            yield framed[i : i + n]


@dataclass
class Model:
    """Log-probabilities for each language: of letter runs and words, row 0 for unknown ones."""

    langs: list[str]
    run_rows: dict[str, int]
    run_logs: np.ndarray
    word_rows: dict[str, int]
    word_logs: np.ndarray
    #: script -> which languages are written in it
    scripts: dict[str, np.ndarray]
    place: dict[str, int] = field(default_factory=dict)
    made: np.ndarray | None = None

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each word, and whether the word is known; the rows of words met before are kept, up to half a million."""
        if len(self.place) > 500_000:
            self.place.clear()
        if fresh := sorted({w for w in words if w not in self.place}):
            rows = np.stack([self._score(w) for w in fresh])
            start = len(self.place)
            self.made = rows if start == 0 else np.concatenate([self.made[:start], rows])
            self.place.update(zip(fresh, range(start, start + len(fresh))))
        if not words:
            return np.zeros((0, len(self.langs))), np.zeros(0, bool)
        rows = self.made[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]
        return rows[:, :-1], rows[:, -1] > 0

    def _score(self, word: str) -> np.ndarray:
        """Scores of the languages from -SPREAD to 0 and, last, 1 for a known word; an unknown one scores 0 for all."""
        out = np.zeros(len(self.langs) + 1)
        script, rows = self.scripts.get(script_of(word)), self.run_rows
        if script is None:
            return out
        runs = [rows.get(run, 0) for run in letter_runs(word, (3,))]
        if word not in self.word_rows and sum(at > 0 for at in runs) < KNOWN_RUNS * len(runs):
            return out
        total = RUN_WEIGHT * self.run_logs[[rows.get(run, 0) for run in letter_runs(word)]].sum(axis=0) + self.word_logs[self.word_rows.get(word, 0)]
        total = np.where(script, total, -np.inf)
        out[:-1], out[-1] = np.maximum(total - total.max(), -SPREAD), 1
        return out


def fit(samples: list[tuple[str, list[str]]]) -> Model:
    """From (language, words of a sentence). Words are also counted without their accents."""
    langs = sorted({lang for lang, _ in samples})
    at = {lang: i for i, lang in enumerate(langs)}
    blank = [0.0] * len(langs)
    runs: dict[str, list[float]] = {}
    words: dict[str, list[float]] = {}
    written: dict[str, np.ndarray] = {}
    script = cache(script_of)
    for (lang, word), n in Counter((lang, w) for lang, own in samples for w in own).items():
        written.setdefault(script(word), np.zeros(len(langs)))[at[lang]] += n
        bare = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
        for form, weight in ((word, n), (bare, 0.3 * n)) if bare != word else ((word, n),):
            weight, i = math.sqrt(weight), at[lang]
            words.setdefault(form, blank[:])[i] += weight
            for run in letter_runs(form):
                row = runs.get(run)
                if row is None:
                    row = runs[run] = blank[:]
                row[i] += weight
    total = sum(written.values(), np.zeros(len(langs)))
    scripts = {name: own >= SCRIPT_SHARE * total for name, own in written.items() if (own >= SCRIPT_SHARE * total).any()}

    def logs(table: dict[str, list[float]], smooth: float) -> tuple[dict[str, int], np.ndarray]:
        # row 0, of unknown runs and words, speaks for no language
        values = np.array([blank, *table.values()])
        total = values.sum(axis=0) + smooth * max(1, len(table))
        out = np.log((values + smooth) / total)
        out[0] = 0
        return {k: i for i, k in enumerate(table, 1)}, out

    return Model(langs, *logs(runs, 0.3), *logs(words, 0.1), scripts)


def viterbi(scores: list[np.ndarray], costs: list[np.ndarray]) -> list[np.ndarray]:
    """Best labels of each text: scores (words, languages), cost of switching before each word.

    Texts of like length go side by side, as many as fill half a million cells.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(scores)
    order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: len(scores[i]))
    while order:
        longest = len(scores[order[-1]])
        take = max(1, 500_000 // longest)
        some, order = order[-take:], order[:-take]
        k = scores[some[0]].shape[1]
        sizes = np.array([len(scores[i]) for i in some])
        now, cost = np.zeros((longest, len(some), k)), np.zeros((longest, len(some), 1))
        for j, i in enumerate(some):
            now[: sizes[j], j], cost[: sizes[j], j, 0] = scores[i], costs[i]
        best, came = now[0].copy(), np.zeros((longest, len(some), k), np.int8)
        stay = np.arange(k, dtype=np.int8)
        first = np.searchsorted(sizes, np.arange(longest), "right")
        for t in range(1, longest):
            own = best[first[t] :]
            moved = own.max(axis=1, keepdims=True) - cost[t, first[t] :]
            switch = moved > own
            came[t, first[t] :] = np.where(switch, own.argmax(axis=1)[:, None], stay)
            best[first[t] :] = np.where(switch, moved, own) + now[t, first[t] :]
        label = np.zeros((longest, len(some)), np.int8)
        label[sizes - 1, np.arange(len(some))] = best.argmax(axis=1)
        for t in range(longest - 1, 0, -1):
            open_ = np.arange(first[t], len(some))
            label[t - 1, open_] = came[t, open_, label[t, open_]]
        for j, i in enumerate(some):
            out[i] = label[: sizes[j], j]
    return out


@dataclass(slots=True)
class Span:
    """The words ``first`` and the ``n_words`` from it on of a sentence, which are of one language."""

    line: int
    sentence: int
    first: int
    lang: str
    n_words: int
    confidence: float
    #: whether the sentence as a whole is written in the language
    whole: bool
    of: Sentence

    def place(self) -> tuple[int, int]:
        """From the start of its first word to the end of its last one in the text."""
        places = self.of.places()
        return places[self.first][0], places[self.first + self.n_words - 1][1]


def spans(model: Model, texts: list[str | None], hints: list[str | None] | None = None) -> list[list[Span]]:
    """The spans of each text, in order; sentences are numbered over the text, those without label included.

    A hint, a language code for each text, adds HINT to every known word of that
    language. The confidence of a span is the softmax of its summed word scores,
    drawn towards none by the weight of one word: (n * p + 1 / languages) / (n + 1).
    """
    parsed = [list(sentences(t)) if t else [] for t in texts]
    flat = [s for own in parsed for s in own]
    every, known = model.scores([w for s in flat for w in s.words])
    result: list[list[Span]] = [[] for _ in parsed]
    if not flat:
        return result
    sizes = np.fromiter((len(s.words) for s in flat), np.int64, len(flat))
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    counts = np.fromiter(map(len, parsed), np.int64, len(parsed))
    text_of = np.repeat(np.arange(len(parsed)), counts)
    lines = np.fromiter((s.line for s in flat), np.int64, len(flat))
    same_line = np.append(False, (lines[1:] == lines[:-1]) & (text_of[1:] == text_of[:-1]))
    cost = np.full(len(every), INSIDE)
    cost[firsts] = np.where(same_line, BETWEEN_SENTENCES, BETWEEN_LINES)
    # the words of a text, as ends of its part of all words
    cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))]
    if hints:
        for i, hint in enumerate(hints):
            if hint in model.langs:
                part = slice(cuts[i], cuts[i + 1])
                every[part, model.langs.index(hint)] += HINT * known[part]
    parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
    label = np.concatenate(viterbi([every[part] for part in parts], [cost[part] for part in parts]))

    told = np.add.reduceat(known, firsts, dtype=np.int64) >= KNOWN_WORDS * sizes
    fresh = np.ones(len(label), bool)
    fresh[1:] = label[1:] != label[:-1]
    fresh[firsts] = True
    begins = np.flatnonzero(fresh)
    lengths = np.diff(np.append(begins, len(label)))
    codes = label[begins].astype(np.int64)
    total = np.add.reduceat(every, begins, axis=0)
    odds = np.exp(np.clip(total - np.take_along_axis(total, codes[:, None], 1), -50, 50)).sum(axis=1)
    sure = (lengths / odds + 1 / len(model.langs)) / (lengths + 1)
    sentence = np.searchsorted(ends, begins, "right")
    whole, number = lengths >= WHOLE * sizes[sentence], sentence - (np.cumsum(counts) - counts)[text_of[sentence]]
    keep = told[sentence]
    columns = (sentence, text_of[sentence], number, begins - firsts[sentence], codes, lengths, sure, whole)
    for at, text, no, first, code, n, p, is_whole in zip(*(c[keep].tolist() for c in columns)):
        s = flat[at]
        result[text].append(Span(s.line, no, first, model.langs[code], n, p, is_whole, s))
    return result


def trained(samples: DataFrame, texts: DataFrame, fit_texts: int = FIT_TEXTS) -> Model:
    """Model from ``samples(lang, text)`` and up to ``fit_texts`` rows of ``texts(result_id, text, language)``, taken by a hash of the key.

    Those rows have a label that names a language and at most FIT_CHARS
    characters; their labels only tilt the scores, as part of them is wrong. More
    than MAX_SAMPLES samples raise ValueError; samples without language or text
    are skipped.
    """
    clean = samples.where("lang is not null and text is not null").select("lang", "text").limit(MAX_SAMPLES + 1).collect()
    if len(clean) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} language samples")
    known = [(label_code(r.lang) or r.lang, s.words) for r in clean for s in sentences(r.text)]
    model = fit(known)
    if not model.langs:
        return model
    labelled = texts.where(F.col("text").isNotNull() & (F.length("text") <= FIT_CHARS) & _code_of("language").isNotNull())
    some = labelled.select("result_id", "text", "language").orderBy(F.xxhash64("result_id"), "result_id").limit(fit_texts).collect()
    return refit(known, [r.text for r in some], [label_code(r.language) for r in some])


def refit(known: list[tuple[str, list[str]]], texts: list[str], hints: list[str | None]) -> Model:
    """Model from clean sentences and from texts, in two passes.

    In the first pass every sentence of a text counts for the text's main
    language, so that a phrase counts for the language of the texts it is used
    in; in the second pass for its own language, if that is beyond doubt.
    """
    model = fit(known)
    added = []
    for text, own in zip(texts, spans(model, texts, hints)):
        total: Counter = Counter()
        for span in own:
            total[span.lang] += span.n_words
        if total and total.most_common(1)[0][1] >= 0.6 * total.total():
            main = total.most_common(1)[0][0]
            added.extend((main, s.words) for s in sentences(text))
    model = fit(known + added)
    added = []
    for text, own in zip(texts, spans(model, texts)):
        parsed = list(sentences(text))
        added.extend((span.lang, parsed[span.sentence].words) for span in own if span.whole and span.n_words >= 3 and span.confidence * (span.n_words + 1) > 0.98 * span.n_words)
    return fit(known + added)


def _batches(texts: DataFrame, samples: DataFrame, schema: str, of):
    """``of(key, spans, label)`` gives the rows of each text; one pass over the texts, in Python batches."""
    shared = texts.sparkSession.sparkContext.broadcast(trained(samples, texts))
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows: list[tuple] = []
            if model.langs:
                keys, every, labels = (batch.column(i).to_pylist() for i in range(3))
                for key, own, label in zip(keys, spans(model, every), labels):
                    rows.extend(of(key, own, label))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return texts.select("result_id", "text", "language").mapInArrow(run, schema)


SPAN_SCHEMA = "result_id bigint, line_no int, sentence_no int, start_pos int, end_pos int, lang string, n_words int, confidence double, is_whole boolean"


def language_spans(texts: DataFrame, samples: DataFrame) -> DataFrame:
    """One row for each run of words of one language in a sentence of ``texts(result_id, text, language)``.

    ``line_no`` counts every line from 0, ``sentence_no`` the sentences of a text
    that hold words; positions are code points, end exclusive. ``is_whole`` tells
    whether the language has the share WHOLE of the sentence's words. Null texts,
    texts without words, and sentences in other scripts or of unknown words give
    no rows; without samples there are none for any text.
    """
    return _batches(texts, samples, SPAN_SCHEMA, lambda key, own, _: [(key, x.line, x.sentence, *x.place(), x.lang, x.n_words, x.confidence, x.whole) for x in own])


LANGUAGE_SCHEMA = "result_id bigint, line_no int, lang string, n_words int, confidence double, right_label boolean"


def of_text(key: int, own: list[Span], label: str | None) -> Iterator[tuple]:
    """Rows of LANGUAGE_SCHEMA for the spans of one text."""
    if not own:
        return
    total: dict[str, list[float]] = {}
    lines: dict[tuple[int, str], list[float]] = {}
    for x in own:
        for at in (total.setdefault(x.lang, [0, 0.0]), *([lines.setdefault((x.line, x.lang), [0, 0.0])] if x.whole else [])):
            at[0] += x.n_words
            at[1] += x.n_words * x.confidence
    main = min(total, key=lambda lang: (-total[lang][0], -sum(x.whole for x in own if x.lang == lang), lang))
    yield key, -1, main, total[main][0], total[main][1] / total[main][0], label_code(label) == main
    for (line, lang), (n, sure) in lines.items():
        if lang != main:
            yield key, line, lang, n, sure / n, None


def languages(results: DataFrame, samples: DataFrame) -> DataFrame:
    """Languages of every result, one row for each (result_id, line_no, lang).

    ``results(result_id, text, language, loaded_at)``, each key in its last
    loaded delivery. line_no -1 is the main language, the one with most words
    (ties: more whole sentences, then the first code), with ``right_label`` telling
    whether the label names it; from 0 on, a language other than the main one in
    which at least one whole sentence of that line is written, ``right_label``
    null. ``confidence`` is the mean over the words concerned. Extra columns are
    ignored. A text is labelled and summed up where it is read, in one pass.
    """
    rows = latest(results.select("result_id", "text", "language", "loaded_at"), "result_id", heavy=True)
    return _batches(rows, samples, LANGUAGE_SCHEMA, of_text)


def segments(results: DataFrame, samples: DataFrame) -> DataFrame:
    """The spans of every result (see language_spans), each key in its last loaded delivery."""
    return language_spans(latest(results.select("result_id", "text", "language", "loaded_at"), "result_id", heavy=True), samples)


def _code_of(column: str):
    """label_code as a column expression."""
    low = F.lower(F.trim(column))
    table = F.create_map(*[F.lit(x) for pair in sorted(_CODES.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.split(low, r"[-_ (,;]")[0]))
