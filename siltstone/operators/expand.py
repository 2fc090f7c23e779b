"""Variants of a query: declarative form, synonyms, qualifiers and hypothetical answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import trimmed

#: Synonyms of terms in the order they are tried, qualifiers, question leads, answer templates.
SYNONYMS = {
    "how to": ["guide", "tutorial", "implement"],
    "best": ["top", "recommended", "optimal"],
    "fast": ["high-performance", "efficient", "optimized"],
    "example": ["sample", "demo", "use case"],
    "python": ["python3", "py"],
    "javascript": ["js", "node.js", "nodejs"],
    "database": ["db", "datastore", "storage"],
    "machine learning": ["ml", "deep learning", "neural network"],
    "api": ["rest api", "web api", "http api", "endpoint"],
    "docker": ["container", "containerized", "docker container"],
    "error": ["bug", "issue", "exception", "problem"],
    "install": ["setup", "configure", "deployment"],
    "search": ["query", "retrieval", "lookup", "find"],
    "vector": ["embedding", "dense vector", "semantic"],
    "async": ["asynchronous", "concurrent", "non-blocking"],
}
QUALIFIERS = ("implementation", "example", "tutorial", "best practices", "how to", "guide")
LEADS = r"(?i)^(what is|what are|how does|how do|why does|why is|when to|where to)\s+"
TOPIC_LEADS = (
    r"(?i)^(what\s+(?:is|are|does|do)|how\s+(?:does|do|to|can|should)|why\s+(?:is|are|does|do)|"
    r"when\s+(?:is|are|does|do|to)|where\s+(?:is|are|does|do|to)|who\s+(?:is|are))\s+"
)
ANSWERS = (
    "{topic} refers to {topic_lower}, which is described as follows.",
    "In summary, {topic} is a concept that involves {topic_lower}.",
    "The key idea behind {topic} is {topic_lower}; here is how it works.",
    "To answer the question about {topic}: {topic} is best understood as {topic_lower}.",
)


def declarative(query: Column) -> Column:
    """The query without its question lead; null if it has none or nothing follows."""
    rest = trimmed(F.regexp_replace(query, LEADS, ""))
    return F.when(query.rlike(LEADS) & (rest != ""), rest)


def synonym_variants(query: Column) -> Column:
    """One text for each of the first two synonyms of each term in the query, which is lower-cased."""
    low = F.lower(query)
    options = [
        F.when(F.contains(low, F.lit(term)) & (F.replace(low, F.lit(term), F.lit(new)) != low), F.replace(low, F.lit(term), F.lit(new)))
        for term, news in SYNONYMS.items()
        for new in news[:2]
    ]
    return F.array_compact(F.array(*options))


def hypothetical_answers(query: Column) -> Column:
    """The answer-shaped passages for the topic of a query, in order."""
    bare = lambda t: trimmed(F.regexp_replace(t, r"[?!.\s]+$", ""))
    stripped = bare(query)
    topic = F.regexp_replace(trimmed(F.regexp_replace(stripped, TOPIC_LEADS, "")), r"\s+", " ")
    topic = F.when(topic == "", trimmed(query)).otherwise(topic)
    topic = F.when(bare(topic) == "", trimmed(query)).otherwise(bare(topic))
    filled = []
    for template in ANSWERS:
        parts, rest = [], template
        while "{" in rest:
            head, _, tail = rest.partition("{")
            name, _, rest = tail.partition("}")
            parts += [F.lit(head), topic if name == "topic" else F.lower(topic)]
        filled.append(F.concat(*parts, F.lit(rest)))
    return F.array(*filled)


def keyword_variants(query: Column, n: int = 5, include_original: bool = True) -> Column:
    """Up to n distinct variants for keyword search; null for null."""
    base = F.coalesce(declarative(query), query)
    first = F.array(query) if include_original else F.array().cast("array<string>")
    head = F.array_distinct(F.concat(first, F.array_compact(F.array(declarative(query))), synonym_variants(query)))
    qualified = F.array(*[F.concat(base, F.lit(f" {q}")) for q in QUALIFIERS])
    return F.slice(F.array_distinct(F.concat(head, qualified)), 1, n)


def retrieval_variants(query: Column, n: int = 3, hypothetical: bool = True) -> Column:
    """Up to n distinct variants for dense retrieval, the query itself first; null for null."""
    if n <= 1:
        return F.array(query)
    head = F.concat(F.array(query), F.array_compact(F.array(declarative(query))))
    if hypothetical:
        room = F.greatest(F.lit(n) - F.size(F.array_distinct(head)), F.lit(0))
        head = F.concat(head, F.slice(hypothetical_answers(query), F.lit(1), room))
    return F.slice(F.array_distinct(F.concat(head, synonym_variants(query))), 1, n)
