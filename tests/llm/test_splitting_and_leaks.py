import re
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import leakage, splitting

T0 = datetime(2030, 1, 1)
WORDS = re.compile("[^ \t\n\r ]+")

texts = st.lists(st.sampled_from(["a", "Bb", "c.", "D!", "e?", "#", "## H"]), min_size=0, max_size=60).flatmap(
    lambda w: st.lists(st.sampled_from([" ", "\n", "\n\n", "  ", "\t", " ", "\n\n\n"]), min_size=len(w), max_size=len(w)).map(lambda g: "".join(a + b for a, b in zip(w, g)))
)


def sentences(text):
    return [s for p in text.split("\n\n") for s in re.split("(?<=[.!?])[ \t\n\r ]+(?=[A-Z])", p)]


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(1, 12), st.integers(0, 6))
def test_words_round_trip_and_limits(text, limit, overlap):
    cut, pieces = splitting.split_words(text, limit, overlap)
    words = WORDS.findall(text)
    if len(words) <= limit:
        assert cut == "whole" and len(pieces) == 1
        return
    assert cut == ("forced" if any(len(WORDS.findall(s)) > limit for s in sentences(text)) else "natural")
    assert [w for s, n, e, _, _ in pieces for w in WORDS.findall(text[n:e])] == words
    for (start, new, end, size, repeated), before in zip(pieces, [None, *pieces]):
        assert size == len(WORDS.findall(text[start:end])) <= limit and repeated == len(WORDS.findall(text[start:new])) <= overlap
        # the overlap is whole unless the piece before is smaller
        assert repeated == (min(overlap, limit - 1, before[3]) if before else 0)
        if repeated:
            assert text[start:new].split()[-1] == text[: before[2]].split()[-1]
    if cut == "natural":
        ends = {len(WORDS.findall(text[:n])) for _, n, _, _, _ in pieces}
        borders, n = {0}, 0
        for s in sentences(text):
            size = len(WORDS.findall(s))
            # only a sentence that does not fit beside the overlap is cut within
            borders.update(range(n + 1, n + size + 1) if size > limit - min(overlap, limit - 1) else [n + size])
            n += size
        assert ends <= borders


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 12), st.integers(0, 6))
def test_chars_round_trip(text, limit, overlap):
    _, pieces = splitting.split_chars(text, limit, overlap)
    assert "".join(text[n:e] for _, n, e, _, _ in pieces) == text and all(e - s <= limit or len(text) <= limit for s, _, e, _, _ in pieces)


def test_overlap_is_kept_where_it_fits():
    _, pieces = splitting.split_words("a b c d e f g h i j", 4, 2)
    assert [p[4] for p in pieces] == [0, 2, 2, 2]


def test_overlap_is_whole_before_a_paragraph_of_several_sentences():
    text = "a b c d e f.\n\nG h i j k. L m n o p."
    assert [p[4] for p in splitting.split_words(text, 10, 4)[1]] == [0, 4, 4]
    assert [p[4] for p in splitting.split_chars(text, 20, 8)[1]][1:] == [8, 8]
    # a sentence alone that does not fit beside the overlap is cut where the piece is full, between characters only if a word is too long
    text = "a b c d e f.\n\nG h i j k l m n."
    assert [(text[n:e], r) for _, n, e, _, r in splitting.split_words(text, 10, 4)[1]] == [("a b c d e f.", 0), ("G h i j k l", 4), ("m n.", 4)]
    text = "Aaaa bbbb. Cccc dddd eeee."
    assert [(text[n:e], r) for _, n, e, _, r in splitting.split_chars(text, 16, 6)[1]] == [("Aaaa bbbb. ", 0), ("Cccc dddd ", 6), ("eeee.", 6)]


def test_very_long_text():
    cut, pieces = splitting.split_words("w " * 300_000, 512, 64)
    assert cut == "forced" and len(pieces) > 600


def test_oversized_chunks(spark):
    requests = spark.createDataFrame(
        [(1, 3, 1, T0), (1, 2, 0, datetime(2031, 1, 1)), (2, None, None, T0), (3, 0, 5, T0)], "request_id bigint, chunk_size int, chunk_overlap int, loaded_at timestamp"
    )
    chunks = spark.createDataFrame(
        [(10, "One two. Three", 1, T0, "x"), (10, "One two. Three", 1, datetime(2032, 1, 1), "x"), (11, "one two", 1, T0, "x"), (12, "w " * 513, 2, T0, "x"), (13, "w " * 513, None, T0, "x"), (14, "w " * 512, 9, T0, "x"), (15, None, 1, T0, "x"), (16, "", 1, T0, "x"), (17, "two words", 3, T0, "x"), (None, "a b c", 1, T0, "x")],
        "chunk_id bigint, text string, ingest_id bigint, loaded_at timestamp, size_limit string",
    )
    got = sorted({(r.chunk_id, r.cut) for r in splitting.split_oversized(splitting.oversized_chunks(chunks, requests)).collect()})
    assert got == [(10, "natural"), (12, "forced"), (13, "forced"), (17, "forced")]
    assert splitting.oversized_chunks(chunks.limit(0), requests.limit(0)).count() == 0


ITEMS = [(1, "The quick brown fox jumps over the lazy dog today"), (2, "quick brown fox jumps over a wall of bricks"), (3, "too short text"), (4, None), (5, "The QUICK brown fox; jumps over the lazy dog today")]


def brute(docs, items, run, least):
    grams = lambda t: {tuple(w[i : i + run]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - run + 1)}
    return {(d, i) for d, t in docs for i, x in items if (g := grams(x)) and len(g & grams(t)) >= least * len(g)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=5), st.lists(st.lists(st.sampled_from("abcd"), max_size=25), max_size=4))
def test_automaton_against_brute_force(items, docs):
    items, docs = [(i, " ".join(x)) for i, x in enumerate(items)], [(i, " ".join(x)) for i, x in enumerate(docs)]
    automaton = leakage.build(items, 3)
    found = set()
    for d, t in docs:
        states = {s for _, _, s in automaton.runs(leakage.words_of(t))}
        for i, total in automaton.totals.items():
            if sum(i in automaton.holders[s] for s in states) >= 0.3 * total:
                found.add((d, i))
    assert found == {(d, i) for d, i in brute(docs, items, 3, 0.3)}


def test_leaks(spark):
    docs = [(1, "intro. quick brown FOX, jumps over the lazy dog! outro"), (2, "nothing here at all to see"), (3, None), (4, ""), (5, "fox_jumps over"), (6, "x " * 50_000 + ITEMS[0][1])]
    table, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(table, items).collect()}
    assert got == brute(docs, ITEMS, 5, 0.3)
    clean = {r.doc_id: (r.text, r.removed_words) for r in leakage.without_leaks(table, items).collect()}
    assert clean[1] == ("intro. ! outro", 8) and clean[2] == (docs[1][1], 0) and clean[3] == (None, 0) and clean[4] == ("", 0)
    assert leakage.leaked_items(table.limit(0), items).count() == 0 and leakage.leaked_items(table, items.limit(0)).count() == 0


def test_clean_keeps_case_where_lower_case_is_longer(spark):
    docs = [(1, "İstanbul Is A BIG City."), (2, f"İİ {ITEMS[0][1]} İ Stays HERE"), (3, f"ΑΣ ΣΑΣ, {ITEMS[0][1].upper()}. ΟΔΟΣ")]
    table, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    clean = {r.doc_id: r.text for r in leakage.without_leaks(table, items).collect()}
    assert clean == {1: docs[0][1], 2: "İİ  İ Stays HERE", 3: "ΑΣ ΣΑΣ, . ΟΔΟΣ"}
    for _, text in docs:
        low, at = leakage.lowered(text)
        assert at is None or len(at) == len(low)


def test_many_items_make_several_automata(spark, monkeypatch):
    items = [*ITEMS, *((10 + i, f"item number {i} says that rivers run slowly past hill {i} and mill {i % 3} at night") for i in range(12))]
    docs = [(1, f"intro. {ITEMS[0][1]}! outro"), (2, f"{items[7][1]} then {items[9][1]}. end"), (3, None), (4, "")]
    table, known = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one = leakage.without_leaks(table, known).collect()
    monkeypatch.setattr(leakage, "MAX_ITEM_WORDS", 40)
    assert len(leakage._automata(known, 5)) > 3
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(table, known).collect()} == brute(docs, items, 5, 0.3)
    assert leakage.without_leaks(table, known).collect() == one and one[1].text == " then . end"
