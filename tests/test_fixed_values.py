"""The tables that the code and the SQL share, written out once more."""

from siltstone.functions import text, urls
from siltstone.operators import crawl, expand, fusion, sparse


def test_words():
    assert " ".join(text.STOP_WORDS) == "the a an and or but if of to in on for with by is are was were be been being this that these those it its as at from"
    assert text.TOKEN == "[A-Za-z0-9][A-Za-z0-9'_-]*" and text.POINT_NAMESPACE == "6ba7b8109dad11d180b400c04fd430c8"


def test_urls():
    assert " ".join(urls.TRACKING_PARAMS) == "utm_source utm_medium utm_campaign utm_term utm_content ref fbclid gclid msclkid mc_cid mc_eid _ga _gl igshid s_cid ncid"


def test_expansion():
    told = {term: "|".join(news[:2]) for term, news in expand.SYNONYMS.items()}
    assert told == {
        "how to": "guide|tutorial", "best": "top|recommended", "fast": "high-performance|efficient", "example": "sample|demo", "python": "python3|py",
        "javascript": "js|node.js", "database": "db|datastore", "machine learning": "ml|deep learning", "api": "rest api|web api", "docker": "container|containerized",
        "error": "bug|issue", "install": "setup|configure", "search": "query|retrieval", "vector": "embedding|dense vector", "async": "asynchronous|concurrent",
    }
    assert "|".join(expand.QUALIFIERS) == "implementation|example|tutorial|best practices|how to|guide"
    assert [a.replace("{topic_lower}", "x").replace("{topic}", "X") for a in expand.ANSWERS] == [
        "X refers to x, which is described as follows.", "In summary, X is a concept that involves x.",
        "The key idea behind X is x; here is how it works.", "To answer the question about X: X is best understood as x.",
    ]


def test_numbers():
    assert (sparse.K1, sparse.B, fusion.RRF_K) == (1.5, 0.75, 60)
    assert (fusion.FIRST_WEIGHT, fusion.FURTHER_WEIGHT, fusion.SPARSE_WEIGHT) == (1.0, 0.6, 0.7)
    assert (crawl.BLOCKED, crawl.LEAST_HTML, crawl.LINKS_A_PAGE, crawl.SITEMAP_URLS, crawl.SITEMAP_CHILDREN) == ((403, 406, 429), 500, 25, 500, 20)
