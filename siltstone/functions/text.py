"""Text functions as column expressions: words, hashes, cleaning, chunking."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The stop words of the sparse index, and its token pattern.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "of", "to", "in", "on",
    "for", "with", "by", "is", "are", "was", "were", "be", "been", "being",
    "this", "that", "these", "those", "it", "its", "as", "at", "from",
)
TOKEN = "[A-Za-z0-9][A-Za-z0-9'_-]*"
#: Fixed value: the name space of point ids.
POINT_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

#: A line is boilerplate if one of these occurs in it, in any case.
BOILERPLATE = (
    r"subscribe\s+to\s+(our\s+)?newsletter",
    r"accept\s+all\s+cookies",
    r"we\s+use\s+cookies",
    r"cookie\s+policy",
    r"privacy\s+policy",
    r"terms\s+(of\s+)?service",
    r"share\s+this\s+article",
    r"follow\s+us\s+on",
    r"click\s+here\s+to\s+subscribe",
    r"sign\s+up\s+for\s+(our\s+)?newsletter",
    r"advertisement",
    r"sponsored\s+content",
    r"all\s+rights\s+reserved",
    r"copyright\s+©",
)
#: Bracketed marks of wikis, taken out of a line; in one pattern, so that a line is gone through once.
WIKI_MARKS = r"(?i)\[(?:edit|citation needed|when\?|who\?|why\?|update|clarification needed|vague|dubious[^\]]*|note \d+|further explanation needed)\]"
#: Typographic signs and their plain spelling.
PLAIN_SIGNS = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("…", "..."))
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Fixed value: the characters between words.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words of which a boilerplate line holds at least one.
_BOILERPLATE_WORDS = ("newsletter", "cookie", "privacy", "service", "article", "follow", "subscribe", "advertisement", "sponsored", "rights", "copyright")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES + " "))


def words(text: Column) -> Column:
    """The runs between white space of any kind; null for null."""
    # one pass to plain blanks, and a split by one character, spare the regular expression
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(words(text)))


def truncated(text: Column, most: int) -> Column:
    """The text itself if it has at most ``most`` words, else its first words joined by a blank."""
    return F.when(F.size(words(text)) <= most, text).otherwise(F.array_join(F.slice(words(text), 1, most), " "))


def estimated_tokens(text: Column) -> Column:
    return F.floor(word_count(text) * F.lit(1.3)).cast("int")


def text_hash(text: Column) -> Column:
    """The same for texts that differ in case and surrounding white space."""
    return F.sha2(F.lower(trimmed(text)), 256)


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def point_id(url: Column, chunk_index: Column) -> Column:
    """Version 5 UUID of ``url:chunk_index`` in POINT_NAMESPACE; null where either is null."""
    name = F.concat(url, F.lit(":"), chunk_index.cast("string"))
    digest = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)) + 8))
    dash = F.lit("-")
    return F.concat(
        F.substring(digest, 1, 8), dash, F.substring(digest, 9, 4), dash, F.lit("5"), F.substring(digest, 14, 3), dash,
        variant, F.substring(digest, 18, 3), dash, F.substring(digest, 21, 12),
    )


def tokens(text: Column, least: int = 2) -> Column:
    """Tokens of the sparse index in order, repeated ones included; empty for null and empty text."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*STOP_WORDS))


def token_id(token: Column) -> Column:
    """Unsigned 32-bit number of a token."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


def token_ids(found: pa.Array) -> np.ndarray:
    """token_id of each of many tokens; each different one is hashed once."""
    coded = found.dictionary_encode()
    return np.array([int(md5(t.encode()).hexdigest()[:8], 16) for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Compatibility form of Unicode (NFKC); Spark has no function for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def cleaned(text: Column) -> Column:
    """Text without invisible and typographic signs, front matter, boilerplate lines, table rules and wiki marks.

    Runs of the same !?,; from three on become one sign, three and more line
    ends become two. Null stays null, a text of nothing but noise becomes empty.
    """
    t = F.regexp_replace(compatible(text), "[​‌‍﻿­]", "")
    for sign, plain in PLAIN_SIGNS:
        t = F.replace(t, F.lit(sign), F.lit(plain))
    t = F.regexp_replace(t, r"(?s)\A---(?U:\s*)\n.*?\n---(?U:\s*)\n", "")
    return bound(t, _without_noise)


def _without_noise(t: Column) -> Column:
    noise = "(?i)(?U)" + "|".join(f"(?:{p})" for p in BOILERPLATE)
    rules = r"(?U)^[|\s:]*-{2,}[|\s:-]*$", r"(?U)^[|\s]+$"
    suspect = bound(F.lower(t), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in _BOILERPLATE_WORDS]))
    lines = F.transform(F.split(t, _LINE_END), trimmed)
    lines = F.when(suspect, F.filter(lines, lambda x: ~x.rlike(noise))).otherwise(lines)
    lines = F.filter(lines, lambda x: ~((x.startswith("|") | x.startswith("-") | x.startswith(":")) & (x.rlike(rules[0]) | x.rlike(rules[1]))))
    marked = F.transform(lines, lambda x: F.when(F.contains(x, F.lit("[")), trimmed(F.regexp_replace(x, WIKI_MARKS, ""))).otherwise(x))
    t = F.regexp_replace(F.array_join(marked, "\n"), r"([!?,;])\1{2,}", "$1")
    return trimmed(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    """Split after . ! or ? and white space before a letter A-Z."""
    return F.split(text, r"(?U)(?<=[.!?])\s+(?=[A-Z])")


def fixed_windows(text: Column, size: int) -> Column:
    """Windows of ``size`` words joined by blanks, the last one shorter; empty for a text without words."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size))
        return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " ")), lambda x: x != "")

    return bound(words(text), cut)


def _pack(parts: Column, size: int, glue: str) -> Column:
    """Greedy packing of array<struct<s,n>> into texts of at most ``size`` words; a part above it stands alone."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("text"), F.lit(0).alias("n"))

    def step(acc: Column, part: Column) -> Column:
        fits = (acc["n"] > 0) & (acc["n"] + part["n"] <= size)
        flushed = F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["text"]))).otherwise(acc["out"])
        return F.struct(
            F.when(fits, acc["out"]).otherwise(flushed).alias("out"),
            F.when(fits, F.concat(acc["text"], F.lit(glue), part["s"])).otherwise(part["s"]).alias("text"),
            F.when(fits, acc["n"] + part["n"]).otherwise(part["n"]).alias("n"),
        )

    return F.aggregate(parts, zero, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["text"]))).otherwise(acc["out"]))


def _counted(texts: Column) -> Column:
    return F.transform(texts, lambda s: F.struct(s.alias("s"), F.size(words(s)).alias("n")))


def chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Chunks of a text as an array, by paragraphs, sentences and, for longer sentences, windows of words.

    Paragraphs end at two line feeds. A paragraph within ``size`` words is a
    segment; a longer one is packed from its sentences; a sentence longer than
    that is cut into windows. Neighbouring segments are merged while they fit.
    Every chunk but the first opens with the last ``overlap`` words of the segment
    before it, so that it may exceed ``size`` by so many. Null and blank texts
    give an empty array.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), trimmed), lambda p: p != "")

    def parts(s: Column) -> Column:
        # a window of a cut sentence counts as full, so that nothing is packed with it
        windows = F.transform(fixed_windows(s["s"], size), lambda w: F.struct(w.alias("s"), F.lit(size).alias("n")))
        return F.when(s["n"] > size, windows).otherwise(F.array(s))

    def segments(p: Column) -> Column:
        return F.when(p["n"] <= size, F.array(p["s"])).otherwise(_pack(F.flatten(F.transform(_counted(sentences(p["s"])), parts)), size, " "))

    merged = _pack(_counted(F.flatten(F.transform(_counted(paragraphs), segments))), size, "\n\n")
    if overlap <= 0:
        return merged
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("array<string>").alias("last"))

    def opened(acc: Column, s: Column) -> Column:
        chunk = F.when(acc["last"].isNull(), s).otherwise(F.concat(F.array_join(acc["last"], " "), F.lit("\n\n"), s))
        return F.struct(F.concat(acc["out"], F.array(chunk)).alias("out"), bound(words(s), lambda w: F.slice(w, -F.least(F.lit(overlap), F.size(w)), overlap)).alias("last"))

    return F.aggregate(merged, zero, opened, lambda acc: acc["out"])
