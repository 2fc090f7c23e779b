"""Personal data in free text: mentions with their places, and the text with typed placeholders.

What a term discloses is measured by its co-occurrence with protected entities
over the whole corpus, as pointwise mutual information in bits, and everything
that is not told by its form alone is decided so:

- Names have no form. A capitalised word right after a listed given name or an
  initial, with particles between them or not, is a family name there by the
  disclosure of the whole word among its capitalised occurrences. Elsewhere the
  beginnings and endings of terms are the back-off: those that disclose a person
  tell family names, listed or seen before or not. What stands before family names
  far more often than elsewhere is a given name in turn.
- Numbers have a form that other numbers share. Telephone and identity numbers are
  candidates by pattern, and the term before a candidate confirms or rejects it:
  where the numbers after a term are protected far less often than numbers in
  general, it is rejected.
- Mail boxes and street addresses are told by their form.

Counts and thresholds are shares of the corpus, so that they behave alike at every
size. In the cleaned text a family name that stands alone is generalised too.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import ensure_checkpoint_dir

#: Letters of beginnings and endings, and the least disclosure in bits of either.
BEGINNING, ENDINGS = 4, (3, 4, 5)
ENDING_BITS, BEGINNING_BITS = 6.0, 4.0
#: The same for a whole capitalised word. All three are lowered to half of what can be reached where protected neighbours are frequent.
WORD_BITS = 4.0
#: Least share of a disclosing ending's occurrences that stand beside a protected entity, and least number of them.
LEAST_SHARE, LEAST_SEEN = 0.25, 2
#: An affix needs this share of all neighbours of protected entities too, so that at most four times the inverse disclose, whatever the corpus.
LEAST_PART = 1e-5
#: How many bits less than numbers in general the numbers after a term may be protected, and least digits of a number that counts.
REJECT_BITS, LEAST_DIGITS = 1.0, 6
#: Share of the occurrences of a word that must stand before a family name for it to be a given name.
GIVEN_SHARE = 0.5
#: Bound on the listed given names, which are broadcast.
MAX_GIVEN = 200_000

#: Titles and determiners that are no given names.
NO_GIVEN = frozenset("mr mrs ms miss dr prof sir herr frau mme mlle monsieur madame sr sra srta señor señora don doña dhr mevr the a an el la le les der die das".split())
#: What may stand between a given name and a family name.
PARTICLES = frozenset("van von vom der den de del della dello di da das do dos du d' la las le los ter ten te zu zur zum af av bin ibn al el y e".split())
DETERMINERS = frozenset(("the", "a", "an"))
#: Kinds of ways that follow, precede or end the name of a street.
AFTER = "street|st|road|rd|lane|ln|avenue|ave|av|drive|dr|court|ct|boulevard|blvd|close|crescent|terrace|place|pl|square|sq|way|row|walk|grove|gardens|mews|hill|parkway|highway"
#: Kinds of ways whose full stop belongs to them unless a sentence may end there; after St, Ave, Av and Dr it always does.
ABBREVIATED = "rd|ln|blvd|ct|pl|sq"
BEFORE_FR = "rue|avenue|av\\.|chemin|boulevard|bd|allée|impasse|place|quai|route|cours|passage|square"
BEFORE_ES = "calle|c/|avenida|avda\\.?|av\\.|plaza|paseo|camino|carrer|rua|travessa|largo|praça|via|viale|piazza|corso|vicolo"
ENDING_DE = "straße|strasse|str\\.|weg|gasse|allee|platz|damm|ufer|ring|steig|straat|laan|gracht|plein|kade"

_LETTER = "[^\\W\\d_]"
_NUMBER = r"\d{1,4}(?:\s?[a-zA-Z]\b|\s(?:bis|ter|quater)\b|[-/]\d{1,4}\b)?"
_NAME_WORD = rf"{_LETTER}[\w'’-]*"

_BOX, _HOST = r"(?<![\w.+-])\w[\w.+-]*", r"[\w-]+"
_END = r"[A-Za-z]{2,}(?![\w-]|\.\w)"
EMAIL = re.compile(
    rf"{_BOX}(?:@|[ \t]@[ \t]|[ \t]?[\[(]at[\])][ \t]?)(?:{_HOST}\.)+{_END}"
    rf"|{_BOX}[ \t]?[\[(]at[\])][ \t]?(?:{_HOST}[ \t]?[\[(]dot[\])][ \t]?)+{_END}"
    rf"|{_BOX}[ \t]at[ \t](?:{_HOST}[ \t]dot[ \t])+{_END}",
    re.I,
)
#: What stands before or after an address that is no mail box: of repositories and packages.
NO_BOX_BEFORE, NO_BOX_AFTER = re.compile(r"(?:://|/)$"), re.compile(r"^(?::[\w./~-]|/)")
NO_BOX_NAMES = frozenset(("git", "hg", "svn"))

PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
    r"|\+\d{1,3}(?:[ .-]?\d{1,5}){2,6}"
    r"|00\d{2}(?:[ .-]\d{1,8}){2,5}"
    r"|\(\d{3}\)\s?\d{3}[ .-]\d{4}"
    r"|\d{3}([.-])\d{3}\1\d{4}"
    r"|0\d{2,4}/\d{5,9}"
    r"|0\d([ .-])\d\d\2\d\d\2\d\d\2\d\d"
    r"|0\d{3,4}[ -]\d{3}[ -]?\d{3,4}"
    r")(?![\w]|[.-]\d)"
)
IDENTITY = re.compile(
    r"(?<![\w./+-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{3}-\d{3}-\d{3}|\d{2} \d{3} \d{3} \d{3}|\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}"
    r"|[A-Z]{2} \d{2} \d{2} \d{2} [A-Z]|[A-Z]{2}\d{6}[A-Z]|[A-Z]\d{8}|\d{8}[A-Z]|[XYZ]\d{7}[A-Z])(?![\w]|[-./]\d)"
)
#: Any number long enough to be taken for one of the two, and the term before it, two words if the last is short.
NUMBER = re.compile(r"(?<![\w.+/-])[+(]?\d[\d(). /-]{3,}\d")
BEFORE_NUMBER = re.compile(rf"({_LETTER}+)(?:[^\w\n]+({_LETTER}{{1,3}}))?[^\w\n]*$")

STREET = re.compile(
    rf"(?<![\w+.,-])(?:{_NUMBER}[ \t ]+(?!the\b)(?:{_NAME_WORD}[ \t ]+){{1,3}}?(?:(?:St|Ave|Av|Dr)\.|(?:{ABBREVIATED})\.(?=[,;]|[ \t ]+(?-i:[a-z0-9]))|(?:{AFTER})\b)(?![ \t ]+view\b)"
    rf"|{_NUMBER},?[ \t ]+(?:{BEFORE_FR})[ \t ]+(?:(?:de la|de l['’]|de|des|du|d['’])[ \t ]*)?[A-ZÀ-Ý][\w'’-]*(?:[ \t ]+[A-ZÀ-Ý][\w'’-]*){{0,3}}"
    rf"|\b(?:{BEFORE_ES})[ \t ]+(?:(?:de las|de los|de la|del|de|da|do|dei|della|delle)[ \t ]+)?[A-ZÀ-Ý][\w'’-]*(?:[ \t ]+[A-ZÀ-Ý][\w'’-]*){{0,3}},?[ \t ]+(?:n[º°o]\.?[ \t ]*|n\.[ \t ]*)?{_NUMBER}"
    rf"|[A-ZÄÖÜ][\w-]*(?:{ENDING_DE})[ \t ]+{_NUMBER})",
    re.I,
)
#: The words that a street address cannot do without.
STREET_WORD = re.compile(rf"(?:{AFTER}|{BEFORE_FR}|{BEFORE_ES})$|.+(?:{ENDING_DE})$", re.I)
_STRIP = "\"'()<>[]{}|,;:!?.*_—–-“”„«»…>"
CORE = re.compile(rf"{_LETTER}+(?:[-'’]{_LETTER}+)*$")
INITIALS = frozenset(f"{c}." for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class StreetWords:
    """Tells the tokens that are or end in a kind of street; keeps what it told."""

    def __init__(self) -> None:
        self.told: dict[str, bool] = {}

    def any_in(self, tokens: list[str]) -> bool:
        told = self.told
        found = False
        for token in tokens:
            known = told.get(token)
            if known is None:
                if len(told) > 500_000:
                    told.clear()
                bare = token.strip("\"'()<>[]{}|,;:!?")
                known = told[token] = bool(STREET_WORD.match(bare) or STREET_WORD.match(bare.rstrip(".")))
            found = found or known
        return found


class Spans:
    """Places that do not overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        """Whether the place was free; it is taken then."""
        at = bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True

    def free(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return not (at and self.ends[at - 1] > start)


def structured(text: str, streets: StreetWords | None = None, taken: Spans | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of mail boxes, street addresses, and candidates for telephone and identity numbers, without overlaps."""
    found: list[tuple[str, int, int]] = []
    taken = Spans() if taken is None else taken

    def take(kind: str, m: re.Match) -> None:
        if taken.take(m.start(), m.end()):
            found.append((kind, m.start(), m.end()))

    if "@" in text or "(at)" in text or "[at]" in text or (" at " in text and " dot " in text) or "AT" in text:
        for m in EMAIL.finditer(text):
            box = re.split(r"\s?(?:@|\[at\]|\(at\)|\bat\b)\s?", m.group(0), maxsplit=1, flags=re.I)[0]
            if not (box.lower() in NO_BOX_NAMES or NO_BOX_BEFORE.search(text[max(0, m.start() - 3) : m.start()]) or NO_BOX_AFTER.match(text[m.end() : m.end() + 2])):
                take("email", m)
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group(0)) <= 15:
            take("phone", m)
    for m in IDENTITY.finditer(text):
        take("id_number", m)
    if (streets or StreetWords()).any_in(text.split()):
        for m in STREET.finditer(text):
            take("street_address", m)
    return sorted(found, key=lambda x: x[1])


def term_before(text: str, at: int) -> str | None:
    """The term before a number on its line, in lower case."""
    m = BEFORE_NUMBER.search(text[max(0, at - 40) : at])
    return None if m is None else " ".join(w for w in m.groups() if w).lower()


def other_numbers(text: str, taken: Spans) -> Iterator[int]:
    """Starts of the numbers that are no candidates."""
    for m in NUMBER.finditer(text):
        if sum(c.isdigit() for c in m.group(0)) >= LEAST_DIGITS and taken.free(m.start(), m.end()):
            yield m.start()


def core(token: str) -> str | None:
    """The bare word of a token between white space, in lower case; None for what is not a word."""
    word = token.strip(_STRIP)
    return word.lower() if CORE.match(word) else None


def bare(word: str) -> str:
    """The word without the ending of the English genitive."""
    return word[:-2] if word[-2:] in ("'s", "’s") else word


def affixes(word: str) -> Iterator[tuple[str, str]]:
    """('<', beginning) and ('>', ending) of each part of a word that is long enough; endings of several lengths."""
    for part in re.split("[-'’]", word):
        if len(part) > BEGINNING:
            yield "<", part[:BEGINNING]
            for n in ENDINGS:
                if len(part) > n:
                    yield ">", part[-n:]


def family_after(tokens: list[str], i: int, forms: frozenset[str]) -> int | None:
    """Number of the capitalised token that ends the name begun by the given name or initial ``i``, past initials and at most three particles."""
    j = i + 1
    while j < len(tokens) and tokens[j] in INITIALS:
        j += 1
    most = j + 3
    while j < min(most, len(tokens) - 1) and tokens[j].lower() in PARTICLES:
        j += 1
    return j if j < len(tokens) and tokens[j][:1].isupper() and tokens[j] not in forms else None


def _forms(given: frozenset[str]) -> frozenset[str]:
    return frozenset(x for g in given for x in (g.capitalize(), g.upper())) | INITIALS


def _count(given: frozenset[str]):
    """Rows (kind, term, seen, beside): kind '<' and '>' are affixes, 'w' whole words, 'n' capitalised ones; beside counts protected neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _forms(given)
        for batch in batches:
            seen: Counter = Counter()
            beside: Counter = Counter()
            direct: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                tokens = text.split()
                seen.update(tokens)
                for i in [i for i, t in enumerate(tokens) if t in forms]:
                    if i and tokens[i - 1].lower() in DETERMINERS:
                        continue
                    if i + 1 < len(tokens) and tokens[i + 1][:1].isupper():
                        beside[tokens[i + 1]] += 1
                    if tokens[i] in INITIALS and i and tokens[i - 1] in forms:
                        continue
                    if (j := family_after(tokens, i, forms)) is not None:
                        direct[tokens[j]] += 1
                        if tokens[j - 1].lower() in PARTICLES:
                            beside[tokens[j]] += 1
            rows: dict[tuple[str, str], list[int]] = {}
            for token, n in seen.items():
                if (word := core(token)) is None:
                    continue
                for key in (("w", word), *affixes(word)):
                    at = rows.setdefault(key, [0, 0])
                    at[0] += n
                    at[1] += beside.get(token, 0)
                if token.strip(_STRIP)[:1].isupper():
                    at = rows.setdefault(("n", bare(word)), [0, 0])
                    at[0] += n
                    at[1] += direct.get(token, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows]), pa.array([t for _, t in rows]), pa.array([a for a, _ in rows.values()], pa.int64()), pa.array([b for _, b in rows.values()], pa.int64())],
                names=["kind", "term", "seen", "beside"],
            )

    return run


class Families:
    """Tells family names by the disclosing affixes; keeps what it told."""

    def __init__(self, terms: frozenset[str]) -> None:
        self.terms, self.told = terms, {}

    def is_family(self, token: str) -> bool:
        known = self.told.get(token)
        if known is None:
            if len(self.told) > 500_000:
                self.told.clear()
            word = core(token)
            known = self.told[token] = word is not None and any(
                len(p) > BEGINNING and f"<{p[:BEGINNING]}" in self.terms and any(f">{p[-n:]}" in self.terms for n in ENDINGS) for p in re.split("[-'’]", word)
            )
        return known


_SPACE = r"[ \t ]+"
_INITIAL = r"[A-ZÀ-ÖØ-Þ]\."
LEFT = re.compile(rf"(?:({_LETTER}[\w'’-]*){_SPACE})?((?:{_INITIAL}[ \t ]*)*)$")
RIGHT = re.compile(rf",{_SPACE}({_LETTER}[\w'’-]*|{_INITIAL})")


#: A word as a whole, genitive included, not within an address or a file name.
WHOLE_WORD = re.compile(rf"(?<![\w@.+-]){_LETTER}+(?:[-'’]{_LETTER}+)*(?![\w@-]|\.\w)")


def name_candidates(text: str, families: Families) -> list[tuple[int, int, str | None, int, int, str | None, int]]:
    """Each family name with its surroundings: (start, end, word before, its start, start of initials or -1, word after a comma, its end)."""
    hits = {t.strip(_STRIP) for t in text.split() if families.is_family(t)}
    out = []
    for m in WHOLE_WORD.finditer(text) if hits else ():
        word, start = m.group(0), m.start()
        if word not in hits:
            word = bare(word)
            if word not in hits:
                continue
        end, base = start + len(word), max(0, start - 60)
        left = LEFT.search(text[base:start])
        before, initials = left.group(1), left.group(2)
        right = RIGHT.match(text[end : end + 60])
        determined = before is None or not re.search(r"\b(?:the|The)\s+$", text[max(0, base + left.start(1) - 6) : base + left.start(1)])
        out.append(
            (start, end, before.lower() if before and determined else None, base + left.start(1) if before else -1, base + left.start(2) if initials else -1,
             right.group(1).lower() if right else None, end + right.end(1) if right else -1)
        )
    return out


def direct_names(text: str, forms: frozenset[str], families: Families) -> list[tuple[int, int, str | None, bool]]:
    """(start, end, last word, whether an initial begins it) of each name of a given name or initial and a word that affixes do not tell.

    The word is None where affixes tell it and particles stand before it.
    """
    if forms.isdisjoint(tokens := text.split()):
        return []
    places = [m.start() for m in re.finditer(r"\S+", text)]
    out = []
    if len(places) != len(tokens):
        # the separators of str.split that are no white space to a pattern
        places, at = [], 0
        for token in tokens:
            places.append(at := text.index(token, at))
            at += len(token)
    for i in [i for i, t in enumerate(tokens) if t in forms]:
        before = tokens[i - 1] if i else ""
        if before.lower() in DETERMINERS or (tokens[i] in INITIALS and before in forms) or (before.endswith(",") and families.is_family(before)):
            continue
        if (j := family_after(tokens, i, forms)) is None or (word := core(tokens[j])) is None or len(bare(word)) < 2:
            continue
        told = families.is_family(tokens[j])
        if told and tokens[j - 1].lower() not in PARTICLES:
            continue
        out.append((places[i], places[j] + len(bare(word)), None if told else bare(word), tokens[i] in INITIALS))
    return out


FOUND = "doc_id bigint, kind string, start_pos int, end_pos int, given string, given_start int, initial_start int, after string, after_end int, n int"


def _scan(shared, given: frozenset[str]):
    """Rows of FOUND: mentions and candidates, and for each batch the terms before other numbers, kind 'number', with their count n.

    ``given`` holds the term before a telephone or identity number, and the word
    before a family name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families, streets = Families(shared.value), StreetWords()
        forms = _forms(given)
        names = [x.split()[0] for x in FOUND.split(", ")]
        types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
        for batch in batches:
            rows: list[tuple] = []
            numbers: Counter = Counter()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                taken = Spans()
                for kind, a, b in structured(text, streets, taken):
                    rows.append((key, kind, a, b, term_before(text, a) if kind in ("phone", "id_number") else None, -1, -1, None, -1, 1))
                numbers.update(term_before(text, a) for a in other_numbers(text, taken))
                for a, b, word, initial in direct_names(text, forms, families):
                    if not taken.free(a, b):
                        continue
                    if word is None:
                        taken.take(a, b)
                        rows.append((key, "person_name", a, b, None, -1, -1, None, -1, 1))
                    else:
                        rows.append((key, "direct", a, b, word, -1, a if initial else -1, None, -1, 1))
                rows.extend((key, "family", a, b, *rest, 1) for a, b, *rest in name_candidates(text, families) if taken.free(a, b))
            rows.extend((None, "number", -1, -1, term, -1, -1, None, -1, n) for term, n in numbers.items() if term)
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def _prior(counts: DataFrame, kind: str) -> float:
    """Share of the occurrences of terms of a kind that stand beside a protected entity; 1 if none does."""
    base = counts.where(F.col("kind") == kind).agg(F.sum("seen").alias("seen"), F.sum("beside").alias("beside")).head()
    return (base["beside"] or 0) / max(1, base["seen"] or 0) or 1.0


def _bits(part: Column, whole: Column, prior: float | Column) -> Column:
    return F.log2((part / whole) / (F.lit(prior) if isinstance(prior, float) else prior))


def disclosing_affixes(counts: DataFrame) -> list[str]:
    """Beginnings ('<') and endings ('>') that disclose a person; not more than four times 1 / LEAST_PART, as each needs that share of all neighbours."""
    prior = _prior(counts, "w")
    bits = _bits(F.col("beside"), F.col("seen"), prior)
    # no term can have more bits than this; where neighbours are frequent half of it is asked for
    half = math.log2(1 / prior) / 2
    total = counts.where("kind = 'w'").agg(F.sum("beside")).head()[0] or 0
    ending = (F.col("kind") == ">") & (bits >= min(ENDING_BITS, half)) & (F.col("beside") / F.col("seen") >= LEAST_SHARE) & (F.col("beside") >= LEAST_SEEN)
    beginning = (F.col("kind") == "<") & (bits >= min(BEGINNING_BITS, half))
    told = counts.where("kind in ('<', '>') and beside > 0").where(F.col("beside") >= LEAST_PART * total).where(ending | beginning)
    return [r.kind + r.term for r in told.select("kind", "term").collect()]


def numbers_told(found: DataFrame) -> DataFrame:
    """The telephone and identity numbers of ``found`` but those after a term that rejects them."""
    numbers = found.where("kind in ('phone', 'id_number', 'number')").withColumn("hit", F.when(F.col("kind") != "number", F.col("n")).otherwise(0))
    base = numbers.where("given is not null").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).head()
    prior = (base["hit"] or 0) / max(1, base["n"] or 0) or 1.0
    terms = numbers.where("given is not null").groupBy("given").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).where("hit > 0")
    rejecting = terms.where(_bits(F.col("hit") + 0.5, F.col("n") + 1, prior) < -REJECT_BITS).select("given")
    return numbers.where("hit > 0").join(rejecting, "given", "left_anti").select("doc_id", "kind", "start_pos", "end_pos")


def personal_data(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """Mentions (doc_id, kind, start_pos, end_pos) in ``documents(doc_id, text)``, positions in code points, end exclusive.

    Kinds: email, phone, id_number, street_address, person_name, and term for a
    family name that stands alone. ``given_names(given_name)`` need not be
    complete. A null or empty text has no mentions; rows with a null key are
    dropped; extra columns are ignored. More listed names than MAX_GIVEN raise
    ValueError, as those are broadcast.
    """
    spark = documents.sparkSession
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    listed = [r[0] for r in given_names.where("given_name is not null").select(F.lower(F.trim("given_name"))).distinct().limit(MAX_GIVEN + 1).collect()]
    if len(listed) > MAX_GIVEN:
        raise ValueError(f"more than {MAX_GIVEN} given names")
    given = frozenset(listed)
    counts = texts.select("text").mapInArrow(_count(given), "kind string, term string, seen bigint, beside bigint").groupBy("kind", "term").agg(F.sum("seen").alias("seen"), F.sum("beside").alias("beside"))
    ensure_checkpoint_dir(spark)
    counts = counts.checkpoint()
    found = texts.mapInArrow(_scan(spark.sparkContext.broadcast(frozenset(disclosing_affixes(counts))), given), FOUND).checkpoint()

    # words beside given names, by their own disclosure; a word after initials alone must be seen so twice
    prior = _prior(counts, "n")
    least = min(WORD_BITS, math.log2(1 / prior) / 2)
    disclosed = counts.where("kind = 'n' and beside > 0").where(_bits(F.col("beside"), F.col("seen"), prior) >= least)
    direct = (
        found.where("kind = 'direct'")
        .join(disclosed.select(F.col("term").alias("given"), "beside"), "given")
        .where((F.col("initial_start") < 0) | (F.col("beside") >= LEAST_SEEN))
        .select("doc_id", F.lit("person_name").alias("kind"), "start_pos", "end_pos")
    )

    # a word is a given name if it is listed, or stands before family names for a good part of its occurrences
    family = found.where("kind = 'family'").drop("kind")
    before = family.where("given is not null").groupBy(F.col("given").alias("term")).agg(F.count("*").alias("n_before"))
    learned = (
        before.join(counts.where("kind = 'w'").select("term", "seen"), "term")
        .where((F.col("n_before") >= GIVEN_SHARE * F.col("seen")) & (F.col("n_before") >= LEAST_SEEN) & ~F.col("term").isin(*NO_GIVEN))
        .select("term")
    )
    names = learned.unionByName(spark.createDataFrame([(g,) for g in sorted(given)], "term string")).distinct()
    told = (
        family.join(names.select(F.col("term").alias("given"), F.lit(True).alias("is_given")), "given", "left")
        .join(names.select(F.col("term").alias("after"), F.lit(True).alias("is_after")), "after", "left")
        .withColumn("is_after", F.coalesce("is_after", F.lit(False)) | F.coalesce(F.col("after").rlike(r"^\p{L}\.$"), F.lit(False)))
    )
    start = (
        F.when(F.col("is_given"), F.col("given_start")).when(F.col("initial_start") >= 0, F.col("initial_start")).otherwise(F.col("start_pos"))
    )
    alone = (start == F.col("start_pos")) & ~F.col("is_after")
    end = F.when((start == F.col("start_pos")) & F.col("is_after"), F.col("after_end")).otherwise(F.col("end_pos"))
    people = told.select("doc_id", F.when(alone, "term").otherwise("person_name").alias("kind"), start.alias("start_pos"), end.alias("end_pos"))
    by_form = found.where("kind in ('email', 'street_address', 'person_name')").select("doc_id", "kind", "start_pos", "end_pos")
    return by_form.unionByName(numbers_told(found)).unionByName(people).unionByName(direct).distinct()


#: Placeholders.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]", "term": "[NAME]"}


def cleaned(documents: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, text, n_mentions) of every document, each mention replaced by the placeholder of its kind.

    Of overlapping mentions the one that starts first holds, of two that start
    together the longer. Documents without mentions and null texts stay as they are.
    """
    spans = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", (-F.col("end_pos")).alias("miss"), "kind"))).alias("spans"))
    return documents.select(F.col("doc_id").cast("bigint"), "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_replace, "doc_id bigint, text string, n_mentions int")


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            parts, at, n = [], 0, 0
            for span in spans or ():
                if text is not None and span["start_pos"] >= at:
                    parts += text[at : span["start_pos"]], PLACEHOLDERS[span["kind"]]
                    at, n = -span["miss"], n + 1
            texts.append("".join(parts) + text[at:] if n else text)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_mentions"])
