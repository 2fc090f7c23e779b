import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.operators import crawl, expand, store
from siltstone.plans import embed, queries
from siltstone.plans import ingest as ingest_plan
from siltstone.plans.settings import Settings
from siltstone.sources import fetch
from siltstone.sources.tables import latest
from siltstone.streaming import jobs

T0 = datetime(2030, 1, 1)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", None), (None, "x", 1), (2, "d", None), (2, "d", None)], "k int, rank_in_key string, loaded_at int")
    assert rows(latest(df, "k"), "k") == [(1, "b", 2), (2, "d", None)]
    assert latest(df.limit(0), "k").count() == 0


def test_upsert_delete_replace(spark):
    schema = "point_id string, url string, n int, at int"
    old = spark.createDataFrame([("p1", "u1", 1, 0), ("p2", "u1", 1, 0), ("p3", "u2", 1, 0), ("p4", None, 1, 0)], schema)
    new = spark.createDataFrame([("p1", "u1", 2, 1), ("p1", "u1", 3, 2), (None, "u9", 9, 9)], schema)
    assert rows(store.upsert(old, new, "point_id", "at").select("point_id", "n"), "point_id") == [("p1", 3), ("p2", 1), ("p3", 1), ("p4", 1)]
    assert rows(store.replace_by_url(old, new, "at").select("point_id", "n"), "point_id") == [("p1", 3), ("p3", 1), ("p4", 1)]
    assert store.delete_by(old, new.limit(0), "url").count() == 4
    again = store.upsert(store.upsert(old, new, "point_id", "at"), new, "point_id", "at")
    assert rows(again, "point_id") == rows(store.upsert(old, new, "point_id", "at"), "point_id")


def test_payload_filter(spark):
    df = spark.createDataFrame([(1, "a", {"k": "x"}), (2, "a", {}), (3, "b", None)], "id int, c string, extra map<string,string>")
    assert [r.id for r in store.payload_filter(df, {"c": "a", "k": "x"}).collect()] == [1]
    assert store.payload_filter(df, {}).count() == 3


def test_states(spark):
    log = spark.createDataFrame(
        [("h", "U1", "pending", None, None, T0), ("h", "U2", "crawled", 200, None, T0 + timedelta(1)), ("g", "V", "skipped", None, "e", T0), (None, "W", "x", 1, None, T0)],
        "url_hash string, url string, status string, http_status int, error string, updated_at timestamp",
    )
    got = {r.url_hash: r for r in store.crawl_state(log).collect()}
    assert got["h"].url == "U1" and got["h"].status == "crawled" and got["h"].crawled_at == T0 + timedelta(1) and got["h"].created_at == T0
    assert got["g"].crawled_at is None and got["g"].error == "e" and len(got) == 2
    jobs_log = spark.createDataFrame([("j", "ingest", "queued", None, None, T0), ("j", "ingest", "completed", "{}", None, T0 + timedelta(1))], "job_id string, job_type string, status string, result string, error string, at timestamp")
    job = store.job_state(jobs_log).head()
    assert (job.status, job.result, job.created_at) == ("completed", None, T0)


def test_cache(spark):
    entries = spark.createDataFrame([("k", "v1", T0, 10), ("k", "v2", T0 + timedelta(seconds=100), 0), ("n", "x", T0, None)], "key string, value string, written_at timestamp, ttl int")
    reads = spark.createDataFrame(
        [(1, "k", T0 + timedelta(seconds=5)), (2, "k", T0 + timedelta(seconds=10)), (3, "k", T0 + timedelta(seconds=3000)), (4, "z", T0), (5, "n", T0 - timedelta(seconds=1)), (6, "k", T0)],
        "read_id int, key string, read_at timestamp",
    )
    assert rows(store.cache_lookup(reads, store.written(entries)).select("read_id", "value", "hit"), "read_id") == [
        (1, "v1", True), (2, None, False), (3, "v2", True), (4, None, False), (5, None, False), (6, "v1", True)
    ]


def test_cache_of_a_hot_key_is_cut_in_time(spark):
    # writes and reads far apart: what a slice leaves is carried over slices without any write
    import random

    rng = random.Random(4)
    writes = [("k" if i % 3 else None, f"v{i}", T0 + timedelta(seconds=rng.randrange(200_000)), rng.choice([10, 5_000, 100_000])) for i in range(60)]
    reads = [(i, "k" if i % 3 else None, T0 + timedelta(seconds=rng.randrange(300_000))) for i in range(120)] + [(500, "k", None), (501, "none", T0)]
    entries = store.written(spark.createDataFrame(writes, "key string, value string, written_at timestamp, ttl int"))
    asked = spark.createDataFrame(reads, "read_id int, key string, read_at timestamp")

    def want(key, at):
        last = max(((w[2], w[1], w[3]) for w in writes if at and w[0] == key and w[2] <= at), default=None)
        hit = last is not None and last[0] + timedelta(seconds=last[2]) > at
        return (last[1] if hit else None, hit)

    for seconds in (60, 3_600, 10**9):
        got = {r.read_id: (r.value, r.hit) for r in store.cache_lookup(asked, entries, slice_seconds=seconds).collect()}
        assert got == {i: want(key, at) for i, key, at in reads}


def test_health(spark):
    services = lambda *up: spark.createDataFrame([(str(i), u) for i, u in enumerate(up)], "service string, up boolean")
    assert [store.health(services(*u)).head().status for u in ((True, True), (False, None), (True, False))] == ["healthy", "unhealthy", "degraded"]


PAGE = "<html><head><title>Doc </title><script>x()</script></head><body><nav>menu</nav><main><article><h1>Head</h1><p>One <b>two</b></p></article></main><footer>foot</footer><a href='/a#x'>a</a><a href='mailto:x@y'>m</a><a href='http://other.org/'>o</a><a href='/a'>again</a><a href=' b '>b</a></body></html>"


def test_html(spark):
    df = spark.createDataFrame([(PAGE,), ("<p>plain",), ("",), (None,)], "html string").coalesce(1)
    got = [r.p for r in df.select(H.parsed(F.col("html")).alias("p")).collect()]
    assert got[0].title == "Doc" and got[0].text == "Head\nOne\ntwo" and got[1].text == "plain" and got[2].text == ""
    links = df.limit(1).select(H.same_site_links(H.parsed(F.col("html"))["hrefs"], F.lit("http://s.org/d/"))).head()[0]
    assert links == ["http://s.org/a", "http://s.org/d/b"]


def test_html_links_are_whole(spark, tmp_path):
    page = "".join(f"<a href='/p{i}'>{i}</a>" for i in range(40))
    spark.createDataFrame([(1, page, "http://s.org/", T0), (2, None, "http://s.org/", T0)], "crawl_id bigint, html string, final_url string, loaded_at timestamp").write.parquet(f"{tmp_path}/crawl_results.parquet")
    got = rows(queries.QUERIES["html_links"](spark, str(tmp_path)), "crawl_id", "place")
    assert got == [(1, i, f"http://s.org/p{i}") for i in range(40)]
    pages = spark.createDataFrame([("http://s.org/", "http://s.org/", page)], "url string, base string, html string")
    assert crawl.page_links(pages, most=crawl.LINKS_A_PAGE).count() == 25


def test_rejoined_documents_hold_no_whole_text(spark, tmp_path):
    chunks = [(i, (None, "http://a", "http://b")[i % 3], 50 - i // 3, f"text  {i} \u00e4", T0) for i in range(90)] + [(100, "http://a", 60, None, T0), (101, "http://c", 0, "", T0), (3, None, 49, "old", datetime(2029, 1, 1))]
    spark.createDataFrame(chunks, "chunk_id bigint, url string, chunk_index int, text string, loaded_at timestamp").repartition(3).write.parquet(f"{tmp_path}/chunk_payloads.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = queries.QUERIES["rejoined_documents"](spark, str(tmp_path))
        got = {r.url: (r.word_count, r.n_chunks, r.text_hash) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for url in (None, "http://a", "http://b"):
        texts = [c[3] for c in sorted(chunks[:90], key=lambda c: c[2]) if c[1] == url]
        want[url] = (90, 30, hashlib.sha256("\n\n".join(texts).encode()).hexdigest())
    assert got == want | {"http://c": (0, 1, hashlib.sha256(b"").hexdigest())}
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_crawl_levels_from_requests(spark, tmp_path):
    links = {"a": ["/B/?utm_source=x", "/c"], "B": ["/d", "/a/"], "c": ["/a"], "d": ["/e#x"], "e": ["/f"], "z": ["/y"]}
    pages = [(i, "".join(f"<a href='{to}'>x</a>" for to in own), f"http://s.org/{page}", T0) for i, (page, own) in enumerate(links.items())]
    spark.createDataFrame(pages, "crawl_id bigint, html string, final_url string, loaded_at timestamp").write.parquet(f"{tmp_path}/crawl_results.parquet")
    asked = [(1, ["HTTP://S.org/a/", None, "http://s.org/a"], T0), (2, None, T0)]
    spark.createDataFrame(asked, "request_id bigint, urls array<string>, loaded_at timestamp").write.parquet(f"{tmp_path}/ingest_requests.parquet")
    assert rows(queries.QUERIES["crawl_levels"](spark, str(tmp_path)), "level") == [(0, 1), (1, 2), (2, 1), (3, 1), (4, 1)]


def test_robots_and_sitemap(spark):
    rules = "User-agent: *\nDisallow: /private"
    df = spark.createDataFrame([(rules, "http://a/private/x"), (rules, "http://a/open"), (None, "http://a/private"), ("", "http://a/b")], "r string, u string")
    assert [r[0] for r in df.select(H.robots_allow(F.col("r"), F.col("u"), F.lit("*"))).collect()] == [False, True, True, True]
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    docs = spark.createDataFrame(
        [(0, f"<urlset {ns}><url><loc>http://a/1</loc></url><url><loc> http://a/2 </loc></url></urlset>"), (1, f"<sitemapindex {ns}><sitemap><loc>http://a/s</loc></sitemap></sitemapindex>"), (2, "<urlset><url><loc>http://a/3</loc></url></urlset>"), (3, "<broken"), (4, None)],
        "place int, xml string",
    )
    assert rows(crawl.sitemap_urls(docs), "url") == [("http://a/1", 0), ("http://a/2", 0)]
    assert rows(crawl.sitemap_children(docs), "child") == [(1, "http://a/s")]


def test_sitemap_discovery(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    urlset = lambda *urls: f"<urlset {ns}>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    index = lambda *maps: f"<sitemapindex {ns}>" + "".join(f"<sitemap><loc>{m}</loc></sitemap>" for m in maps) + "</sitemapindex>"
    documents = [
        ("http://a/sitemap.xml", index("http://a/m1", "http://a/m2", "http://a/sitemap.xml")), ("http://a/m1", urlset("http://a/1", "http://a/2")), ("http://a/m2", index("http://a/m3")),
        ("http://a/m3", index("http://a/m4")), ("http://a/m4", urlset("http://a/deep")), ("http://a/sitemap-index.xml", urlset("http://a/2", "http://a/3")), ("http://b/sitemap_index.xml", "<broken"), ("http://c/sitemap.xml", None),
    ]
    sites = spark.createDataFrame([("HTTP://A/x/y?z",), ("http://a",), ("http://b/",), ("http://c/",), (None,), ("no url",)], "site string")
    known = spark.createDataFrame(documents, "url string, xml string")
    assert rows(crawl.discovered_urls(sites, known), "number") == [("http://a", "http://a/1", 0), ("http://a", "http://a/2", 1), ("http://a", "http://a/3", 2)]
    assert [r.url for r in crawl.discovered_urls(sites, known, depth=3, urls=None, children=None).orderBy("number").collect()] == ["http://a/1", "http://a/2", "http://a/deep", "http://a/3"]
    assert [r.url for r in crawl.discovered_urls(sites, known, urls=1, children=1).collect()] == ["http://a/1"]
    assert crawl.discovered_urls(sites.limit(0), known).count() == 0
    many = spark.createDataFrame([(0, urlset(*[f"http://a/{i}" for i in range(600)])), (1, index(*[f"http://a/m{i}" for i in range(30)]))], "place int, xml string")
    assert crawl.sitemap_urls(many).count() == 500 and crawl.sitemap_urls(many, most=None).count() == 600
    assert crawl.sitemap_children(many).count() == 20 and crawl.sitemap_children(many, most=None).count() == 30


def test_crawl(spark):
    pages = spark.createDataFrame([("http://a.b/x", 200, PAGE, "http://a.b/x"), ("http://a.b/y", 403, "no", "http://a.b/y")], "url string, status_code int, html string, final_url string").withColumn("url_key", F.sha2("url", 256))
    urls = spark.createDataFrame([("HTTP://A.b/x/",), ("http://a.b/y",), ("http://a.b/z",), ("http://a.b/private",), ("http://a.b/x",)], "url string")
    robots = spark.createDataFrame([("a.b", "User-agent: *\nDisallow: /private")], "netloc string, robots string")
    browser = spark.createDataFrame([("http://a.b/y", 200, PAGE, "http://a.b/y")], "url string, status_code int, html string, final_url string").withColumn("url_key", F.sha2("url", 256))
    got = rows(crawl.crawl(urls, pages, robots, use_browser=True, browser_pages=browser).select("url", "status_code", "used_browser", "error"), "url")
    assert got == [("http://a.b/private", None, False, "blocked by robots.txt"), ("http://a.b/x", 200, False, None), ("http://a.b/x", 200, False, None), ("http://a.b/y", 200, True, None), ("http://a.b/z", None, False, "not found")]


def test_walk(spark):
    edges = [("a", 0, "b"), ("a", 1, "c"), ("b", 0, "d"), ("c", 0, "d"), ("d", 0, "a"), ("c", 1, "e"), ("e", 0, "f")]
    links = spark.createDataFrame(edges, "url string, place int, link string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "url string")
    walk = lambda **k: rows(crawl.walk(seeds, links, **k).select("level", "url"), "level", "url")
    assert walk(depth=2, budget=None) == [(0, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "e")]
    assert walk(depth=5, budget=100) == [(0, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "e"), (3, "f")]
    # c is found but over budget and not taken up again
    assert walk(depth=5, budget=2) == [(0, "a"), (1, "b")]
    assert walk(depth=0, budget=100) == [(0, "a")]


def test_expand(one):
    q = F.col("q")
    assert one(expand.keyword_variants(q, 6), q="What is Docker?") == ["What is Docker?", "Docker?", "what is container?", "what is containerized?", "Docker? implementation", "Docker? example"]
    assert one(expand.keyword_variants(q, 6), q="Who is the capital owner") == ["Who is the capital owner", "who is the crest apital owner", "who is the cweb apital owner", "Who is the capital owner implementation", "Who is the capital owner example", "Who is the capital owner tutorial"]
    assert one(expand.retrieval_variants(q, 3), q="What is Docker?") == ["What is Docker?", "Docker?", "Docker refers to docker, which is described as follows."]
    assert len(one(expand.retrieval_variants(q, 3), q="python api error")) == 3 and one(expand.retrieval_variants(q, 1), q="x") == ["x"]


def test_ingest_twice_is_once(spark):
    pages = spark.createDataFrame([(1, "http://a/x", 200, PAGE), (2, "http://a/y", 500, None), (3, "http://a/z", 404, "<p>gone</p>")], "page_id int, url string, status_code int, html string")
    embedder = embed.hashed(8)
    once = ingest_plan.ingest(None, pages, embedder)
    twice = ingest_plan.ingest(once, pages, embedder)
    key = lambda df: rows(df.select("point_id", "url", "chunk_index", "text", "page_id"), "point_id")
    assert key(once) == key(twice) and once.count() == 2
    assert ingest_plan.ingest(None, pages, embedder, Settings(require_ok=True)).count() == 1


def test_embedding_cache(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c d"), (4, None)], "id int, text string")
    embedder = embed.hashed(4)
    cache = spark.createDataFrame([("c d",)], "t string").select(embed.cache_key(F.col("t"), "hashed").alias("text_key"), F.array(F.lit(9.0)).alias("vector"))
    got = {r.id: r for r in embed.embedded(df, cache, embedder).collect()}
    assert got[3].vector == [9.0] and got[3].was_cached and not got[1].was_cached and got[1].vector == got[2].vector and got[4].vector is None


def test_fetch(spark):
    def answer(url):
        if "down" in url:
            raise OSError("refused")
        return 200, f"<p>{url}", url, "text/html"

    got = {r.url: r for r in fetch.fetch_pages(spark.createDataFrame([("u1",), ("down",), (None,)], "url string"), answer, 2, tries=2, wait=0.0).collect()}
    assert got["u1"].status_code == 200 and got["down"].error == "OSError: refused" and got[None].error == "no url"
    hits = fetch.search_hits(spark.createDataFrame([("q", '{"results":[{"url":"a"},{"title":"t"}]}'), ("p", "broken")], "query string, body string")).collect()
    assert [(h.query, h.rank, h.url, h.title, h.engine) for h in hits] == [("q", 1, "a", "", "unknown"), ("q", 2, "", "t", "unknown")]


def test_streams(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "url string, n int, at timestamp"
    first = spark.createDataFrame([("http://a/1", 1, T0), ("http://A/1/", 2, T0)], schema)
    first.coalesce(1).write.parquet(source)

    def merge(old, new):
        return store.last_in_order(new, "url", "n") if old is None else store.upsert(old, new, "url", "n")

    run = lambda: jobs.keep_state(jobs.folder(spark, source, first), str(tmp_path / "state"), str(tmp_path / "progress"), merge).awaitTermination()
    run()
    spark.createDataFrame([("http://a/1", 5, T0)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert rows(jobs.current(spark, str(tmp_path / "state")).select("url", "n"), "url") == [("http://A/1/", 2), ("http://a/1", 5)]
    seen = jobs.first_seen(jobs.folder(spark, source, first), "at").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    seen.awaitTermination()
    assert spark.table("seen").count() == 1


def test_state_in_batches_keeps_two_versions(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "url string, n int"
    spark.createDataFrame([(f"u{i % 7}", i) for i in range(40)], schema).repartitionByRange(8, "n").write.parquet(source)
    stream = jobs.folder(spark, source, spark.createDataFrame([], schema), files_a_batch=2)
    merge = lambda old, new: store.last_in_order(new if old is None else old.unionByName(new), "url", "n")
    query = jobs.keep_state(stream, str(tmp_path / "state"), str(tmp_path / "progress"), merge)
    query.awaitTermination()
    assert len(query.recentProgress) >= 4 and len(jobs._versions(spark, str(tmp_path / "state"))) == 2
    assert rows(jobs.current(spark, str(tmp_path / "state")), "url") == [(f"u{i}", max(n for n in range(40) if n % 7 == i)) for i in range(7)]


def test_ingest_of_arriving_pages(spark, tmp_path):
    page = lambda text: f"<html><body><main><p>{text}</p></main></body></html>"
    pages = [(i, f"http://s.org/{i % 5}", 200, page(f"Page {i} says something. " * (1 + i % 3))) for i in range(20)] + [(90, "http://s.org/0", 200, None)]
    rows_ = spark.createDataFrame(pages, "page_id bigint, url string, status_code int, html string")
    rows_.repartitionByRange(6, "page_id").write.parquet(str(tmp_path / "in"))
    jobs.keep_ingested(jobs.folder(spark, str(tmp_path / "in"), rows_, files_a_batch=2), str(tmp_path / "state"), str(tmp_path / "progress"), embed.hashed(8)).awaitTermination()
    columns = ["point_id", "url", "page_id", "text"]
    whole = rows(ingest_plan.ingest(None, rows_, embed.hashed(8)).select(*columns), "point_id")
    assert rows(jobs.current(spark, str(tmp_path / "state")).select(*columns), "point_id") == whole and len(whole) == 5


def test_checkpoints_need_a_shared_folder():
    from types import SimpleNamespace

    from siltstone.sources import tables

    def session(master):
        java = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
        made = []
        sc = SimpleNamespace(_jsc=java, getConf=lambda: SimpleNamespace(get=lambda key: None), master=master, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=sc), made

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            tables.ensure_checkpoint_dir(session(master)[0])
    spark, made = session("local[4]")
    tables.ensure_checkpoint_dir(spark)
    assert len(made) == 1


def test_services(spark):
    from siltstone.plans import services

    requests = spark.createDataFrame([(1, "q", 5, ["b", "a"], 1, T0), (2, "q", 5, ["a", "b"], 1, T0), (3, "p", 5, None, 1, T0)], "read_id int, query string, n int, engines array<string>, safe int, read_at timestamp")
    key = requests.where("read_id = 1").select(services.search_key(F.col("query"), F.col("n"), F.col("engines"), F.col("safe"))).head()[0]
    entries = spark.createDataFrame([(key, "old", T0 - timedelta(seconds=5), T0 + timedelta(seconds=5))], "key string, value string, written_at timestamp, expires_at timestamp")
    got = services.cached_search(requests, entries, lambda missing: missing.select("key", F.concat(F.lit("new "), "query").alias("value")))
    assert rows(got.select("read_id", "value", "cached"), "read_id") == [(1, "old", True), (2, "old", True), (3, "new p", False)]

    pages = spark.createDataFrame([("http://a.b/x", 200, PAGE, "http://a.b/x")], "url string, status_code int, html string, final_url string").withColumn("url_key", F.sha2("url", 256))
    asked = spark.createDataFrame([(1, "<p>inline text", None), (2, None, "HTTP://A.B/x/"), (3, None, None), (4, None, "http://a.b/z"), (5, "", None)], "request_id int, html string, url string")
    assert rows(services.extract(asked, pages).select("request_id", "text", "word_count", "error"), "request_id") == [
        (1, "inline text", 2, None), (2, "Head\nOne\ntwo", 3, None), (3, None, None, "needs html or url"), (4, None, None, "not found"), (5, None, None, "no text")
    ]
    hits = spark.createDataFrame([("http://a.b/x",), ("http://A.b/x",), ("http://a.b/z",), (None,)], "url string")
    assert services.search_and_ingest(hits, pages, None, embed.hashed(4)).count() == 1


def test_ingest_says_what_failed(spark):
    pages = spark.createDataFrame([(1, "u1", 200, "<p>text"), (2, "u2", 200, None), (3, "u3", 404, "<p>text"), (4, "u4", 200, "<p> </p>"), (5, "u5", None, "")], "page_id bigint, url string, status_code int, html string")
    assert rows(ingest_plan.failures_of(pages).select("page_id", "error"), "page_id") == [(2, "no html"), (4, "no text"), (5, "no html")]
    assert rows(ingest_plan.failures_of(pages, Settings(require_ok=True)).select("page_id", "error"), "page_id") == [(2, "no html"), (3, "status 404"), (4, "no text"), (5, "status unknown")]


def test_tables(spark):
    from siltstone.sources import schemas

    spark.sql("CREATE DATABASE IF NOT EXISTS made")
    assert set(schemas.create_tables(spark, "made")) == set(schemas.TABLES) and schemas.create_tables(spark, "made") == []
    assert schemas.collection_layout(spark, "made.chunks") == "hybrid" and schemas.collection_layout(spark, "made.none") == "missing"
