import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as T


def test_tokens_and_ids(one):
    assert one(T.tokens(F.col("t")), t="Don't use C++ v2.0 x_1 Äpfel-mus -foo it's") == ["don't", "use", "v2", "x_1", "pfel-mus", "foo", "it's"]
    for token, number in {"apple": 523792574, "fast": 835998747, "don't": 1500549786, "transformer": 1608536403}.items():
        assert one(T.token_id(F.col("t")), t=token) == number
    assert one(T.tokens(F.lit(None).cast("string"))) == []


def test_ids_and_hashes(one, spark):
    assert one(T.point_id(F.col("u"), F.col("i")), u="https://example.com/a", i=3) == "d5576fa1-0f5b-51db-8d2c-de3a33c9bb56"
    assert one(T.point_id(F.col("u"), F.col("i")), u="https://example.com", i=0) == "45ac6e13-fc7a-581f-a745-b415b3a0da85"
    assert one(T.fingerprint(F.col("t")), t="green apple") == "58b779f2ce1ec179"
    assert one(T.text_hash(F.col("t")), t=" Hello World ").startswith("b94d27b9934d3e08")
    assert spark.sql("select cast(null as string) u, 1 i").select(T.point_id(F.col("u"), F.col("i"))).head()[0] is None


def test_words(one):
    assert one(T.word_count(F.col("t")), t="a b c\x85d  ") == 4
    assert one(T.truncated(F.col("t"), 2), t="a  b c") == "a b"
    assert one(T.truncated(F.col("t"), 3), t="a  b c") == "a  b c"
    assert one(T.estimated_tokens(F.col("t")), t="a b c") == 3
    assert one(T.sentences(F.col("t")), t="One. Two! Three? four. É") == ["One.", "Two!", "Three? four. É"]


CHUNKS = "A b c.\n\nD e. F g h i. j k.\n\nl1 l2 l3 l4 l5 l6 l7 l8"


def test_chunks(one):
    assert one(T.chunks(F.col("t"), 6, 0), t=CHUNKS) == ["A b c.\n\nD e.", "F g h i. j k.", "l1 l2 l3 l4 l5 l6", "l7 l8"]
    assert one(T.chunks(F.col("t"), 6, 2), t=CHUNKS) == ["A b c.\n\nD e.", "D e.\n\nF g h i. j k.", "j k.\n\nl1 l2 l3 l4 l5 l6", "l5 l6\n\nl7 l8"]
    assert one(T.chunks(F.lit(None).cast("string"), 6, 2)) == [] and one(T.chunks(F.col("t"), 6, 2), t=" \n\n ") == []


def model_chunks(text, size, overlap):
    """Plain model of the chunker."""
    segments = []
    for paragraph in (p.strip() for p in text.split("\n\n")):
        if not paragraph:
            continue
        if len(paragraph.split()) <= size:
            segments.append(paragraph)
            continue
        held = ""
        for sentence in re.split(r"(?<=[.!?])\s+(?=[A-Z])", paragraph):
            w = sentence.split()
            if len(w) > size:
                segments += [held] * bool(held) + [" ".join(w[i : i + size]) for i in range(0, len(w), size)]
                held = ""
            elif held and len(held.split()) + len(w) > size:
                segments.append(held)
                held = sentence
            else:
                held = f"{held} {sentence}" if held else sentence
        segments += [held] * bool(held)
    merged = []
    for s in segments:
        if merged and len(merged[-1].split()) + len(s.split()) <= size:
            merged[-1] += "\n\n" + s
        else:
            merged.append(s)
    return merged[:1] + [" ".join(a.split()[-overlap:]) + "\n\n" + b if overlap else b for a, b in zip(merged, merged[1:])]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "B", "cc.", "D.", "e!", "F?", "g"]), min_size=1, max_size=30), min_size=1, max_size=5), st.integers(2, 9), st.integers(0, 4))
def test_chunks_like_model(spark, paragraphs, size, overlap):
    text = "\n\n".join(" ".join(p) for p in paragraphs)
    # a window of a sentence may be merged with its neighbours, never packed with sentences
    got = spark.range(1).select(T.chunks(F.lit(text), size, overlap)).head()[0]
    assert got == model_chunks(text, size, overlap)


@pytest.mark.parametrize("line", ["Subscribe to our newsletter", "ACCEPT all  cookies", "we use cookies", "Cookie policy", "privacy policy", "terms of service", "terms service", "Share this article", "follow us on x", "click here to subscribe", "Sign up for newsletter", "Advertisement", "sponsored content", "All rights reserved", "copyright © 2020", "|---|:--|", "| | |"])
def test_cleaner_drops_lines(one, line):
    assert one(T.cleaned(F.col("t")), t=f"keep\n {line} \nthis") == "keep\nthis"


def test_boilerplate_words_cover_the_patterns():
    # a text with none of these words can hold no boilerplate line: each pattern must need one of them
    for pattern in T.BOILERPLATE:
        needed = re.sub(r"\([^()]*\)\?", "", pattern).replace(r"\s+", " ")
        assert any(word in needed for word in T._BOILERPLATE_WORDS), pattern


def test_cleaner(one, spark):
    assert one(T.cleaned(F.col("t")), t="---\na: 1\n---\nﬁne ‘x’ “y” – — … z​­") == "fine 'x' \"y\" - -- ... z"
    assert one(T.cleaned(F.col("t")), t="a[edit] b [Citation needed] [7]\n\n\n\n\nwow!!!! ok??") == "a b  [7]\n\nwow! ok??"
    assert spark.sql("select cast(null as string) t").select(T.cleaned(F.col("t"))).head()[0] is None
    assert one(T.cleaned(F.col("t")), t="") == ""
    long = "Ｆｕｌｌ width. " * 20_000
    assert one(T.cleaned(F.col("t")), t=long) == unicodedata.normalize("NFKC", long).strip()
