"""Evaluation texts that leak into training text.

The items are normalised to word numbers and put into one generalised suffix
automaton. Training tokens stream through it; at each token the automaton knows
the longest suffix that occurs in some item. Wherever that length reaches the
run length, the run of so many words is one state of the automaton, and the
state knows the items that hold it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of Unicode letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Bound on the words of one automaton, which has at most twice as many states and is broadcast; more items make several.
MAX_ITEM_WORDS = 250_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def lowered(text: str) -> tuple[str, list[int] | None]:
    """The text in lower case and, if that has another length, the place in the text that each of its characters stems from."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    # the whole is lowered at once, as some letters depend on their neighbours; its length is that of the letters alone
    return low, [i for i, c in enumerate(text) for _ in c.lower()]


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers, read through ``runs``."""

    numbers: dict[str, int]
    steps: list[dict[int, int]]
    links: list[int]
    lengths: list[int]
    run: int
    #: state -> state that holds its last ``run`` words
    at_run: list[int]
    #: that state -> items that hold the run
    holders: dict[int, tuple[int, ...]]
    #: item -> number of its distinct runs
    totals: dict[int, int]

    def runs(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(index of the last word, longest match, state of the run) wherever a run of an item ends."""
        steps, links, lengths, run, at_run, number = self.steps, self.links, self.lengths, self.run, self.at_run, self.numbers.get
        state = length = 0
        for i, word in enumerate(words):
            n = number(word)
            if n is None:
                state = length = 0
                continue
            to = steps[state].get(n)
            if to is None:
                while state and to is None:
                    state = links[state]
                    to = steps[state].get(n)
                if to is None:
                    state = length = 0
                    continue
                length = min(length, lengths[state])
            state, length = to, length + 1
            if length >= run:
                yield i, length, at_run[state]


def build(items: list[tuple[int, str | None]], run: int) -> Automaton:
    """Items with fewer words than ``run`` have no run and cannot be found; equal items share their states."""
    numbers: dict[str, int] = {}
    steps: list[dict[int, int]] = [{}]
    links, lengths = [-1], [0]

    def state_of(length: int, to: dict[int, int]) -> int:
        steps.append(to)
        lengths.append(length)
        links.append(0)
        return len(steps) - 1

    def split(parent: int, n: int, child: int) -> int:
        """The state for the words of ``parent`` and ``n`` alone, parted from ``child``."""
        part = state_of(lengths[parent] + 1, dict(steps[child]))
        links[part] = links[child]
        links[child] = part
        while parent >= 0 and steps[parent].get(n) == child:
            steps[parent][n] = part
            parent = links[parent]
        return part

    coded: list[tuple[int, list[int]]] = []
    for key, text in items:
        code = [numbers.setdefault(w, len(numbers)) for w in words_of(text)]
        coded.append((key, code))
        last = 0
        for n in code:
            child = steps[last].get(n)
            if child is not None:
                last = child if lengths[child] == lengths[last] + 1 else split(last, n, child)
                continue
            new, parent = state_of(lengths[last] + 1, {}), last
            while parent >= 0 and n not in steps[parent]:
                steps[parent][n] = new
                parent = links[parent]
            if parent >= 0:
                child = steps[parent][n]
                links[new] = child if lengths[child] == lengths[parent] + 1 else split(parent, n, child)
            last = new
    at_run = [-1] * len(steps)
    for state in sorted(range(1, len(steps)), key=lengths.__getitem__):
        if lengths[state] >= run:
            at_run[state] = state if lengths[links[state]] < run else at_run[links[state]]
    automaton = Automaton(numbers, steps, links, lengths, run, at_run, {}, {})
    holders: dict[int, list[int]] = {}
    names = {number: word for word, number in numbers.items()}
    for key, code in coded:
        if own := {state for _, _, state in automaton.runs([names[n] for n in code])}:
            automaton.totals[key] = len(own)
            for state in own:
                holders.setdefault(state, []).append(key)
    automaton.holders = {state: tuple(keys) for state, keys in holders.items()}
    return automaton


LEAK_SCHEMA = "doc_id bigint, item_id bigint, shared int, total int, longest int"


def _automata(items: DataFrame, run: int) -> list:
    """Automata of ``items(item_id, text)``, broadcast: one, or as many as MAX_ITEM_WORDS calls for; each is built from its own items alone."""
    texts = items.where("item_id is not null").select("item_id", "text").withColumn("n", F.coalesce(F.size(F.split("text", r"[^\p{L}\p{N}]+")), F.lit(0)))
    size = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
    n_parts = -(-size // MAX_ITEM_WORDS) or 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(n_parts))
    spark = items.sparkSession
    return [spark.sparkContext.broadcast(build([(r.item_id, r.text) for r in texts.where(part == i).orderBy("item_id").collect()], run)) for i in range(n_parts)]


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 5, least: float = 0.3) -> DataFrame:
    """Documents with the items of whose distinct runs at least the share ``least`` occurs in them.

    ``documents(doc_id, text)``, ``items(item_id, text)``; one row for each
    document and item: ``shared`` of ``total`` distinct runs, and the ``longest``
    match in words at one of them, with any item of the same automaton. Documents stay where they are read, nothing is shuffled; they
    are read again for each automaton beyond the first. Null or empty texts and
    texts shorter than a run match nothing; no items or no documents give no rows;
    extra columns are ignored. A repeated document key gives a row for each
    repetition.
    """
    found = [documents.select("doc_id", "text").mapInArrow(_matcher(shared, least), LEAK_SCHEMA) for shared in _automata(items, run)]
    if len(found) == 1:
        return found[0]
    return reduce(DataFrame.unionByName, found)


def _matcher(shared_automaton, least: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared_automaton.value
        holders, totals = automaton.holders, automaton.totals
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                longest: dict[int, int] = {}
                for _, length, state in automaton.runs(words_of(text)):
                    if longest.get(state, 0) < length:
                        longest[state] = length
                if not longest:
                    continue
                found: dict[int, list[int]] = {}
                for state, length in longest.items():
                    for item in holders[state]:
                        at = found.setdefault(item, [0, 0])
                        at[0] += 1
                        at[1] = max(at[1], length)
                out.extend((key, item, n, totals[item], most) for item, (n, most) in found.items() if n >= least * totals[item])
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "shared", "total", "longest"])

    return match


def without_leaks(documents: DataFrame, items: DataFrame, run: int = 5, least: float = 0.3, span_words: int = 8) -> DataFrame:
    """Every document without the spans that it shares with the items.

    A matched span of at least ``span_words`` words is cut out; a document that
    holds the share ``least`` of an item's runs loses all its spans of ``run``
    words or more of that item. ``removed_words`` counts the words of those
    spans. A span reaches from the first letter of its first word to the last
    of its last word. A null text stays null, with no words removed.
    """
    marked = documents.select(F.col("doc_id").cast("bigint"), "text", F.array().cast("array<struct<a:int,b:int>>").alias("spans"))
    for shared in _automata(items, run):
        marked = marked.mapInArrow(_marker(shared, run, least, span_words), "doc_id bigint, text string, spans array<struct<a:int,b:int>>")
    return marked.mapInArrow(_cut, "doc_id bigint, text string, removed_words int")


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _marker(shared_automaton, run: int, least: float, span_words: int):
    """Adds the spans of one automaton, as places in the text, to those of the automata before."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared_automaton.value
        for batch in batches:
            every = []
            for text, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                every.append(before + [{"a": a, "b": b} for a, b in _shared_spans(automaton, text, run, least, span_words)] if text else before)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(every, _SPANS)], names=["doc_id", "text", "spans"])

    return mark


def _shared_spans(automaton: Automaton, text: str, run: int, least: float, span_words: int) -> list[tuple[int, int]]:
    low, at_char = lowered(text)
    places = [m.span() for m in WORD.finditer(low)]
    hits = list(automaton.runs([low[a:b] for a, b in places]))
    if at_char is not None:
        # a word reaches to the end of the character that its last letter stems from
        places = [(at_char[a], at_char[b - 1] + 1) for a, b in places]
    count: dict[int, set[int]] = {}
    for _, _, state in hits:
        for item in automaton.holders[state]:
            count.setdefault(item, set()).add(state)
    bad = {item for item, states in count.items() if len(states) >= least * automaton.totals[item]}
    spans: list[list[int]] = []
    for end, length, state in hits:
        if length >= span_words or not bad.isdisjoint(automaton.holders[state]):
            first = end - (length if length >= span_words else run) + 1
            if spans and first <= spans[-1][1] + 1:
                spans[-1] = [min(first, spans[-1][0]), end]
            else:
                spans.append([first, end])
    return [(places[first][0], places[end][1]) for first, end in spans]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, removed = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kept, at, gone = [], 0, 0
            for a, b in sorted((x["a"], x["b"]) for x in spans):
                kept.append(text[at : max(at, a)])
                gone += len(WORD.findall(text[max(at, a) : b]))
                at = max(at, b)
            texts.append("".join(kept) + text[at:] if spans else text)
            removed.append(gone)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["doc_id", "text", "removed_words"])
