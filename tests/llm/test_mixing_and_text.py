import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.llm import boilerplate, language, mixing, privacy

T0 = datetime(2030, 1, 1)


def mix(spark, docs, targets):
    sized = mixing.sized(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), mixing.word_size())
    plan = mixing.solve(sized, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    return sized, plan


def test_mixing(spark):
    docs = [(i, (" Web", "wiki ", "BOOKS")[i % 3], "w " * (5 + i % 40)) for i in range(3000)] + [(9001, None, "a"), (9002, "other", "b c"), (9003, "web", None), (9004, "web", "")]
    sized, plan = mix(spark, docs, [("web", 0.2, 1), ("wiki", 0.7, 3), ("books", 0.05, 2), ("none", 0.05, 9)])
    rows = {r.source: r for r in plan.collect()}
    assert [s for s in sorted(rows) if not rows[s].reachable] == ["none"] and rows["web"].n_docs == 1002
    mixed = mixing.mixture(sized, plan)
    got = {r.source: r for r in mixing.shares(mixed, plan).collect()}
    total = sum(r["size"] for r in rows.values())
    for s in ("web", "wiki", "books"):
        expected = mixed.where(F.col("source") == s).agg(F.sum(F.col("rate") * F.col("size"))).head()[0]
        assert expected == pytest.approx(rows[s].target_size, rel=1e-6)
        assert got[s].mixed_size == pytest.approx(rows[s].target_share * total, rel=0.02)
    assert got["none"].reached_share == 0 and sum(r.reached_share for r in got.values()) == pytest.approx(1)
    assert mixed.where("copies < 0 or copies > 3").count() == 0
    assert mixed.select(F.max(F.when(F.col("source") == "web", F.col("copies")))).head()[0] == 1


def test_mixing_out_of_reach_takes_all_repeats(spark):
    sized, plan = mix(spark, [(1, "a", "x y"), (2, "b", "x " * 98)], [("a", 0.5, 2), ("b", 0.5, 1)])
    copies = {r.doc_id: r.copies for r in mixing.mixture(sized, plan).collect()}
    assert copies[1] == 2 and not plan.where("source = 'a'").head().reachable


def test_mixing_leaves_reachable_sources_their_shares(spark):
    # c gives 400 words of the 500 that would be its share of all, d has nothing: the total shrinks until both are made up for
    docs = [(i, "ab"[i % 2], "w " * (10 + i % 23)) for i in range(400)] + [(1000 + i, "c", "w " * 20) for i in range(10)]
    targets = [("a", 0.5, 2), ("b", 0.4, 2), ("c", 0.06, 2), ("d", 0.04, 5)]
    sized, plan = mix(spark, docs, targets)
    rows = {r.source: r for r in plan.collect()}
    assert [s for s in sorted(rows) if not rows[s].reachable] == ["c", "d"] and rows["c"].factor is None
    assert rows["a"].target_size == pytest.approx(0.5 * 400 / 0.1)
    mixed = mixing.mixture(sized, plan).cache()
    got = {r.source: r for r in mixing.shares(mixed, plan).collect()}
    assert all(got[s].reached_share == pytest.approx(t, rel=0.01) for s, t, _ in targets[:2]) and got["c"].mixed_size == 400 and got["d"].mixed_size == 0
    # rates are an exponential tilt of the size
    rates = {(r.size, r.rate) for r in mixed.where("source = 'a'").collect()}
    factor = rows["a"].factor / rows["a"].mean_size
    assert len(rates) > 5 and all(rate == pytest.approx(min(2, math.exp(factor * size))) for size, rate in rates)


def test_mixing_reach_follows_from_the_dual(spark, monkeypatch):
    # exactly all repeats is a finite multiplier's limit; a word less is out of reach, and without Newton steps nothing is told
    docs = [(1, "a", "x " * 25), (2, "b", "x " * 75), (3, "a", "")]
    assert mix(spark, docs, [("a", 0.5, 2), ("b", 0.5, 1)])[1].where("not reachable").count() == 0
    assert [r.source for r in mix(spark, docs, [("a", 0.51, 2), ("b", 0.49, 1)])[1].where("not reachable").collect()] == ["a"]
    monkeypatch.setattr(mixing, "_newton", lambda *args, **kwargs: None)
    assert mix(spark, docs, [("a", 0.51, 2), ("b", 0.49, 1)])[1].where("not reachable").count() == 0


def test_mixing_empty(spark):
    sized, plan = mix(spark, [], [("a", 1.0, 1)])
    assert plan.head().n_docs == 0 and mixing.shares(mixing.mixture(sized, plan), plan).head().reached_share == 0


def test_tokens(spark):
    counts = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",)], "t string").select(mixing.token_count()("t")).collect()
    assert [r[0] for r in counts][:3] == [2, 0, 0] and counts[3][0] > 1


ARTICLE = " ".join(["This sentence belongs to the article and says something."] * 3)
PAGE = f"""<html><head><title>T</title><style>p{{}}</style></head><body><!-- c --><div class=menu><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div>
<main><article><h1>Head &amp; line</h1><p>{ARTICLE}<p>Second <b>bold</b> part. {ARTICLE}<ul><li><a href=/x>Related page one</a></li></ul><table><tr><td>cell<td>12</table>
<div class="promo"><p>Try it free.</p></div><h2>Sub</h2><pre>code()</pre></article></main><div class=x1><button>Accept</button><p>We use cookies.</p></div><footer><p>All rights</footer><script>var x="<p>no</p>"</script></body></html>"""


def main(html):
    page = boilerplate.parse(html)
    return [line.text for line, good in zip(page.lines, boilerplate.main_lines(page)) if good]


def test_main_body():
    got = main(PAGE)
    assert got[0] == "Head & line" and got[-2:] == ["Sub", "code()"] and "cell" in got and "12" in got and len(got) == 8


def test_main_body_depends_on_ratios(monkeypatch):
    pages = [PAGE, f"<p>{ARTICLE}</p><p>More. {ARTICLE}", f"<div><h1>H</h1></div><div class=body><p>{ARTICLE}</p><p>{ARTICLE}</p></div>"]
    assert [len(main(page)) for page in pages] == [8, 2, 3]
    # a headline whose element has no text of any ratio gives way to what is around it
    assert main(f"<body><div><h1><a href=/>Site</a></h1></div><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div></body>") == ["Site", ARTICLE, ARTICLE]
    # the threshold selects the lines of a page without headline: boilerplate in a like element is left out by its ratio alone
    links = "".join(f"<p><a href=/{i}>Item {i}</a> <a href=/x{i}>more</a></p>" for i in range(6))
    page = f"<div>{links}</div><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><div>{links}</div>"
    assert main(page) == [ARTICLE, ARTICLE]
    monkeypatch.setattr(boilerplate, "smoothed", lambda ratios: [0.0] * len(ratios))
    assert [main(page) for page in pages] == [[], [], []]


def test_lists_of_links():
    linked = "<ul><li><a href=/a>One page</a></li><li><a href=/b>Other page</a></li></ul>"
    # they belong to the element of the article, and to the page itself only between content lines
    assert main(f"<nav>{linked}</nav><article><h1>H</h1><p>{ARTICLE}</p>{linked}</article><div>{linked}</div>") == ["H", ARTICLE, "One page", "Other page"]
    assert main(f"<body>{linked}<p>{ARTICLE}</p>{linked}<p>{ARTICLE}</p>{linked}</body>") == [ARTICLE, "One page", "Other page", ARTICLE]


def test_main_body_odd_pages():
    assert main("plain text without tags") == [] and boilerplate.parse("").lines == []
    assert main(f"<p>{ARTICLE}</p><p>More. {ARTICLE}") == [ARTICLE, f"More. {ARTICLE}"]
    assert main(f"<div><h1>H</h1></div><div class=body><p>{ARTICLE}</p><p>{ARTICLE}</p></div>") == ["H", ARTICLE, ARTICLE]
    deep = "<div>" * 5000 + f"<p>{ARTICLE}" + "</div>" * 5000
    assert main(deep) == [ARTICLE]
    # a headline far below the text that belongs to it
    assert main(f"<p>{ARTICLE}</p>" + "<div>" * 20_000 + "<h1><a>H</a></h1>" + "</div>" * 20_000) == [ARTICLE, "H"]


def test_main_body_of_nested_elements():
    lead, code = f"Lead. {ARTICLE}", "<div class=code><pre>x = 1</pre></div>"
    page = f"<main><h1>H</h1><p>{lead}</p><section><h2>Sub</h2><p>{ARTICLE}</p></section><div class=wrap><table><tr><td>cell<td>12</table></div>{code}<div class=x><div><p>Deep. {ARTICLE}</p></div></div><div class=y><p>Try it free.</p></div></main>"
    assert main(page) == ["H", lead, "Sub", ARTICLE, "cell", "12", "x = 1", f"Deep. {ARTICLE}"]
    cells = "".join(f"<tr><td><p>a{i}</p></td><td><p>{i}</p></td></tr>" for i in range(2))
    assert main(f"<article><h1>H</h1><p>{lead}</p><div><table>{cells}</table></div></article>") == ["H", lead, "a0", "0", "a1", "1"]
    two = "".join(f"<section><h2>S{i}</h2><p>{ARTICLE}</p></section>" for i in range(2))
    assert main(f"<article><h1>H</h1>{two}</article>") == ["H", "S0", ARTICLE, "S1", ARTICLE]
    teasers = "".join(f"<div><h4>T{i}</h4><p>{ARTICLE}</p></div>" for i in range(3))
    assert main(f"<article><h1>H</h1><p>{lead}</p><div class=x9>{teasers}</div></article>") == ["H", lead]
    assert main(f"<main><p>{lead}</p><p>{ARTICLE}</p><section><p>{ARTICLE}</p></section></main>") == [lead, ARTICLE, ARTICLE]


def test_block_numbers():
    page = boilerplate.parse("<p>a <i>b</i>c<br>d</p><!-- x --><noscript>n</noscript>&lt;e&gt;<p> </p>f")
    assert [line.text for line in page.lines] == ["a bc", "d", "<e>", "f"]


def test_pages_of(spark):
    schema = "crawl_id bigint, status_code int, content_type string, html string, loaded_at timestamp, rank_in_key int"
    crawls = spark.createDataFrame([(1, 200, "TEXT/HTML; charset=x", PAGE, T0, 0), (2, 404, "text/html", PAGE, T0, 0), (3, 200, "application/json", PAGE, T0, 0), (4, 200, None, PAGE, T0, 0), (5, 200, " ", None, T0, 0), (6, None, None, PAGE, T0, 0)], schema)
    requests = spark.createDataFrame([(1, PAGE, T0), (2, None, T0), (3, "", T0)], "request_id bigint, html string, loaded_at timestamp")
    pages = boilerplate.pages_of(crawls, requests)
    found = boilerplate.page_blocks(pages).where("is_main")
    assert {(r.src, r.row_id) for r in found.collect()} == {("crawl", 1), ("crawl", 4), ("extract", 1)}
    texts = {(r.src, r.row_id): r.text for r in boilerplate.main_text(pages).collect()}
    assert texts["extract", 3] == "" and texts["crawl", 1].startswith("Head & line\n\nThis sentence")
    assert boilerplate.page_blocks(pages.limit(0)).count() == 0


SAMPLES = {
    "en": ["The house stands on the hill and nobody knows why.", "We should think twice before we start that.", "Please look at the results of the search."],
    "de": ["Das Haus steht auf dem Berg und niemand weiß warum.", "Wir sollten zweimal überlegen, bevor wir das beginnen.", "Bitte sehen Sie sich die Ergebnisse der Suche an."],
    "ru": ["Дом стоит на горе, и никто не знает почему.", "Нам нужно подумать дважды, прежде чем начать.", "Посмотрите, пожалуйста, на результаты поиска."],
}


def test_languages(spark):
    samples = spark.createDataFrame([(lang, t) for lang, own in SAMPLES.items() for t in own] + [(None, "x"), ("en", None)], "lang string, text string")
    de, en = "Das Haus steht auf dem Berg. Wir sollten zweimal überlegen.", "We should think twice before we start that."
    rows = [
        (1, f"{de}\n\n{en}", "German", T0), (2, en, "ENGLISH", T0), (3, f"{en}\nНикто не знает почему.", "de-AT", T0), (4, "404 https://a.b/c == x=1", "en", T0), (5, "", None, T0), (6, None, None, T0),
        (7, f"{en} “Das Haus steht auf dem Berg.”", None, T0), (2, en, "en_GB", datetime(2031, 1, 1)),
    ]
    results = spark.createDataFrame(rows, "result_id bigint, text string, language string, loaded_at timestamp")
    got = {(r.result_id, r.line_no, r.lang, r.right_label) for r in language.languages(results, samples).collect()}
    assert got == {(1, -1, "de", True), (1, 2, "en", None), (2, -1, "en", True), (3, -1, "en", False), (3, 1, "ru", None), (7, -1, "en", False)}
    assert language.languages(results.limit(0), samples).count() == 0 and language.languages(results, samples.limit(0)).count() == 0
    # a span reaches from its first word to its last one, in code points of the text
    text = {r[0]: r[1] for r in rows if r[0] != 2}
    found = [(r.result_id, r.line_no, r.lang, text[r.result_id][r.start_pos : r.end_pos], r.is_whole) for r in language.segments(results.where("result_id <> 2"), samples).orderBy("result_id", "start_pos").collect()]
    assert (3, 1, "ru", "Никто не знает почему", True) in found and (1, 2, "en", "We should think twice before we start that", True) in found
    assert all(0 < r.confidence < 1 for r in language.languages(results, samples).collect())


def told(text, model=None):
    model = model or language.fit([(lang, s.words) for lang, own in SAMPLES.items() for t in own for s in language.sentences(t)])
    return [(x.lang, text[slice(*x.place())], x.whole) for x in language.spans(model, [text])[0]]


def test_languages_switch_inside_a_sentence():
    # a vote of the sentence would give one language for all of it
    text = "We should look at the house on the hill before we start, das Haus steht auf dem Berg und niemand weiß warum."
    assert told(text) == [("en", "We should look at the house on the hill before we start", False), ("de", "das Haus steht auf dem Berg und niemand weiß warum", False)]
    # the main language is that of most words, and no whole sentence is in another one
    model = language.fit([(lang, s.words) for lang, own in SAMPLES.items() for t in own for s in language.sentences(t)])
    assert [r[:4] for r in language.of_text(1, language.spans(model, [text])[0], "en")] == [(1, -1, "en", 12)]


def test_scripts_and_unknown_words_have_no_label():
    assert told("Αυτό είναι ένα ελληνικό κείμενο. 这是 一个 中文 文本") == [] and told("Xqzvk wrtpl mnbvcx qwrtzk plkjhz.") == []
    assert told("Αυτό είναι ένα. The house stands on the hill.") == [("en", "The house stands on the hill", True)]
    assert [language.script_of(w) for w in ("abc", "été", "дом", "λόγος", "中文", "한국", "かな", "שלום", "سلام", "a中")] == ["latin", "latin", "cyrillic", "greek", "han", "hangul", "kana", "hebrew", "arabic", "latin"]


def test_sentences_keep_their_places():
    text = "# Das Haus steht\n> x = 1\nSee “Dom, и” at www.a.b. The e\u0301te\u0301 ends!\n\nYes"
    got = [(s.line, [text[a:b] for a, b in s.places()], s.words) for s in language.sentences(text)]
    assert got == [(0, ["Das", "Haus", "steht"], ["das", "haus", "steht"]), (2, ["See", "at", "The", "e\u0301te\u0301", "ends"], ["see", "at", "the", "été", "ends"]), (4, ["Yes"], ["yes"])]


@pytest.mark.parametrize(("label", "code"), [("DE", "de"), ("de-AT", "de"), ("en_GB", "en"), ("Português", "pt"), ("ger", "de"), (" dut ", "nl"), ("xx", None), ("", None), (None, None), ("Polish", None)])
def test_labels(label, code, spark):
    assert language.label_code(label) == code
    row = spark.createDataFrame([(label,)], "l string").select(language._code_of("l")).head()
    assert row[0] == code


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail to mailto:ann.b+c@x-y.example?subject=1 now", "email", "ann.b+c@x-y.example"),
        ("<A_B@X.CO.TEST>", "email", "A_B@X.CO.TEST"),
        ("ann [at] site [dot] co [dot] test.", "email", "ann [at] site [dot] co [dot] test"),
        ("ann(at)site.test. Next", "email", "ann(at)site.test"),
        ("ann at site-mail dot test", "email", "ann at site-mail dot test"),
        ("x @ site.test", "email", "x @ site.test"),
        ("Call +44 1632 960488 ext. 44", "phone", "+44 1632 960488"),
        ("(503) 555-0117.", "phone", "(503) 555-0117"),
        ("tel=030/23125291 x", "phone", "030/23125291"),
        ("SSN: 987-65-4320;", "id_number", "987-65-4320"),
        ("tax 06 221 854 741, asked", "id_number", "06 221 854 741"),
        ("to 12a Mill Lane, Upper Town", "street_address", "12a Mill Lane"),
        ("at 7 Old St. and", "street_address", "7 Old St."),
        ("to 96 Ferry Ave., second floor", "street_address", "96 Ferry Ave."),
        ("lives at 9 Mill Rd. The", "street_address", "9 Mill Rd"),
        ("at 9 Mill Rd., Upper", "street_address", "9 Mill Rd."),
        ("0044-1632-960014.", "phone", "0044-1632-960014"),
        ("au 7 bis, avenue du Vieux Port.", "street_address", "7 bis, avenue du Vieux Port"),
        ("en Calle de los Sauces, 41.", "street_address", "Calle de los Sauces, 41"),
        ("Büro: Mühlgrabenweg 10.", "street_address", "Mühlgrabenweg 10"),
    ],
)
def test_structured(text, kind, found):
    assert [(k, text[a:b]) for k, a, b in privacy.structured(text)] == [(kind, found)]


@pytest.mark.parametrize(
    "text",
    ["git@code.x.test:a/b.git", "Use @this, never @that. With", "Install @x/y@7.9.5 now", "Timestamps such as 1904880949", "host 192.0.2.28 port 50258", "Ticket 458-44-51", "Build 2031-01-19-7533", "Section 18 Street View", "The Mill lane of 28", "from 225.269.273 to 4", "ssh://bob@host.test/x"],
)
def test_no_personal_data(text):
    assert privacy.structured(text) == []


def test_names(spark):
    people = [("Ann", "Brockvonk"), ("Bob", "Tillvonk"), ("Ann", "Tillmoor"), ("Cleo", "Brockmoor"), ("Bob", "Brockvonk")]
    filler = "the system keeps running and the queue holds many rows while nothing else happens here "
    rows = [(i, f"{filler * 20}{g} {f} wrote this. {filler}") for i, (g, f) in enumerate(people * 8)]
    rows += [(100, "As Zoe Tillvonk told us."), (101, "by Tillmoor, Ann today"), (102, "A. B. Brockmoor and bob tillvonk met"), (103, "The Ann Release and Cleo run"), (104, "Zoe Brockvonk, Zoe Tillmoor"), (105, None), (106, ""), (107, "user zoe_tillvonk")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    given = spark.createDataFrame([("Ann",), ("Bob",), (None,), ("Ann",)], "given_name string")
    mentions = privacy.personal_data(docs, given)
    text = dict(rows)
    got = sorted((r.doc_id, text[r.doc_id][r.start_pos : r.end_pos]) for r in mentions.where("doc_id >= 100 and kind = 'person_name'").collect())
    assert got == [(100, "Zoe Tillvonk"), (101, "Tillmoor, Ann"), (102, "A. B. Brockmoor"), (102, "bob tillvonk"), (104, "Zoe Brockvonk"), (104, "Zoe Tillmoor")]
    clean = {r.doc_id: (r.text, r.n_mentions) for r in privacy.cleaned(docs, mentions).collect()}
    assert clean[100] == ("As [NAME] told us.", 1) and clean[105] == (None, 0) and clean[106] == ("", 0) and clean[104] == ("[NAME], [NAME]", 2)
    assert privacy.personal_data(docs.limit(0), given).count() == 0


def names_in(spark, texts, listed):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    mentions = privacy.personal_data(docs, spark.createDataFrame([(g,) for g in listed], "given_name string"))
    return sorted(texts[r.doc_id][r.start_pos : r.end_pos] for r in mentions.where("kind = 'person_name'").collect())


def test_names_by_whole_words(spark):
    filler = "the young system keeps running and the queue holds many rows. The baker and the queue wait. " * 40
    texts = [f"{filler}Then {name} wrote. {filler}" for name in ("Anke Wolf", "Mei Ruiz's team", "Grace Young", "Mei van der Berg", "Anke K. de la Cruz")]
    texts += [f"{filler}The Grace Pipeline and The Mei Lattice ship. Will The queue wait? Thanks, Mei The queue. Plan B. Nobody came."]
    assert names_in(spark, texts, ["Anke", "Mei", "Grace", "Will"]) == ["Anke K. de la Cruz", "Anke Wolf", "Grace Young", "Mei Ruiz", "Mei van der Berg"]


def test_terms_before_numbers_confirm_or_reject(spark):
    texts = [f"Ticket {100000 + i} is open. Passport 987-65-43{i:02d} was pasted." for i in range(30)] + ["Ticket 987-65-4320 is open.", "Newly seen 987-65-4321 here.", "987-65-4322", f"{'9' * 50_000} 987-65-4323"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    mentions = privacy.personal_data(docs, spark.createDataFrame([("Ann",)], "given_name string"))
    got = {(r.doc_id, texts[r.doc_id][r.start_pos : r.end_pos]) for r in mentions.collect()}
    assert got == {(i, f"987-65-43{i:02d}") for i in range(30)} | {(31, "987-65-4321"), (32, "987-65-4322"), (33, "987-65-4323")}


def test_affixes_are_bounded_by_their_share(spark):
    # each affix needs a share of all neighbours, so that rare ones fall away as the corpus grows
    counts = spark.createDataFrame([("w", "x", 10**9, 10**6), (">", "rare", 3, 3), (">", "often", 40, 20), ("<", "rare", 3, 3), ("<", "ofte", 30, 20), (">", "comm", 10**7, 100)], "kind string, term string, seen bigint, beside bigint")
    assert sorted(privacy.disclosing_affixes(counts)) == ["<ofte", ">often"]
    assert sorted(privacy.disclosing_affixes(counts.where("seen < 1000").unionByName(spark.createDataFrame([("w", "x", 10**6, 100)], counts.schema)))) == ["<ofte", "<rare", ">often", ">rare"]


def test_cleaning_is_linear_and_keeps_overlaps_whole(spark):
    docs = spark.createDataFrame([(1, "a@b.cc " * 20_000), (2, "0123456789"), (3, None)], "doc_id bigint, text string")
    mentions = spark.createDataFrame([(1, "email", 7 * i, 7 * i + 6) for i in range(20_000)] + [(2, "phone", 2, 5), (2, "email", 2, 7), (2, "term", 4, 9), (2, "term", 8, 10)], "doc_id bigint, kind string, start_pos int, end_pos int")
    got = {r.doc_id: (r.text, r.n_mentions) for r in privacy.cleaned(docs, mentions).collect()}
    assert got == {1: ("[EMAIL] " * 20_000, 20_000), 2: ("01[EMAIL]7[NAME]", 2), 3: (None, 0)}


def test_names_of_a_directory(spark):
    # half of all words stand beside a given name
    people = [f"{g} {b}{e}" for g in ("Ann", "Bob") for b in ("Brock", "Till") for e in ("vonk", "moor")]
    assert names_in(spark, people, ["Ann", "Bob"]) == sorted(people)
    assert names_in(spark, [*people, "by Tillmoor, Ann today"], ["Ann", "Bob"]) == sorted([*people, "Tillmoor, Ann"])
