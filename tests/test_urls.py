import pytest
from pyspark.sql import functions as F

from siltstone.functions import urls as U

CASES = {
    " HTTP://Example.COM:80/Path/?b=2&a=1&utm_source=x#frag": "http://example.com/Path?a=1&b=2",
    "https://example.com": "https://example.com/",
    "https://example.com:8443/a//": "https://example.com:8443/a",
    "https://e.com/x?a=&b=1&B=0": "https://e.com/x?B=0&b=1",
    "https://e.com/x?q=a+b%2Fc&q=1": "https://e.com/x?q=a+b%2Fc&q=1",
    "https://e.com/p;v=1/?REF=z": "https://e.com/p;v=1",
    "example.com/x/": "example.com/x",
    "http://a.com:443/": "http://a.com:443/",
    "https://e.com/a;v=2?x=1": "https://e.com/a;v=2?x=1",
    "https://e.com/?x=%zz&y=~*": "https://e.com/?x=%25zz&y=~%2A",
    "not a url": "not a url",
}


@pytest.mark.parametrize("raw", CASES)
def test_normalize(one, raw):
    assert one(U.normalize_url(F.col("u")), u=raw) == CASES[raw]


def test_normalize_keeps_values_of_a_name_in_order(one):
    assert one(U.normalize_url(F.col("u")), u="https://e.com/?b=2&a=9&b=1") == "https://e.com/?a=9&b=2&b=1"


def test_null_url(spark):
    row = spark.sql("select cast(null as string) u").select(U.normalize_url(F.col("u")), U.is_valid_url(F.col("u")), U.domain(F.col("u"))).head()
    assert list(row) == [None, False, None]


def test_valid_and_domain(one):
    assert one(U.is_valid_url(F.col("u")), u="HTTPS://a.b/c") and not one(U.is_valid_url(F.col("u")), u="ftp://a.b/c") and not one(U.is_valid_url(F.col("u")), u="http:///c")
    assert one(U.domain(F.col("u")), u="https://User@A.B:8080/c") == "user@a.b:8080"
    assert one(U.same_domain(F.col("a"), F.col("b")), a="http://a.b/x", b="https://A.B/y") and not one(U.same_domain(F.col("a"), F.col("b")), a="http://a.b/x", b="http://a.b:81/x")
