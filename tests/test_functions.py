"""Scalar functions on literals."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from rolecall.functions import text, urls
from rolecall.functions.html import fragment_text, page_listings
from rolecall.functions.vectors import cosine
from rolecall.operators.discovery import company_name, legacy_company_name

S = "string"


def evaluate(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def one(spark, value, function, kind=S):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    return frame.select(function(F.col("v")).alias("r")).first()["r"]


def test_url_hash(spark):
    first, second = "https://a.example.com/j?a=1", "https://a.example.com/j?a=2"
    assert one(spark, first, urls.url_hash) == hashlib.md5(first.encode()).hexdigest()
    assert one(spark, first, urls.url_hash) != one(spark, second, urls.url_hash)
    assert one(spark, "", urls.url_hash) == "" and one(spark, None, urls.url_hash) == ""


URL_PAIRS = {
    "https://EXAMPLE.com": "https://example.com/",
    "http://a.com:80/x": "http://a.com/x",
    "https://a.com/x y": "https://a.com/x%20y",
    "https://a.com/é": "https://a.com/%C3%A9",
    "https://bücher.de/": "https://xn--bcher-kva.de/",
    "https://a.com/a/../b": "https://a.com/b",
    "https://a.com/a/%2E%2e/b": "https://a.com/b",
    "  https://a.com/x \n": "https://a.com/x",
    "https:/a.com/x": "https://a.com/x",
    "http:a.com/x": "http://a.com/x",
    "https:\\\\a.com\\x": "https://a.com/x",
    "https://u:p@a.com/x?y=1#z": "https://u:p@a.com/x?y=1#z",
    "https://a.com:8443": "https://a.com:8443/",
    "https://a.com?q='1'": "https://a.com/?q=%271%27",
    "https://a.com/..": "https://a.com/",
    "https://a.com:99999/": None,
    "https://": None,
    "https://a b.com/": None,
    "https://1.2.3.999/": None,
    "ftp://a.com": None,
    "/rel/path": None,
    "//a.com/x": None,
    "https://a.com/" + "x" * 2083: None,
    "": None,
}


def test_normalise_url(spark):
    frame = spark.createDataFrame(list(URL_PAIRS.items()), "raw string, want string")
    rows = frame.select("raw", "want", urls.normalise_url(F.col("raw")).alias("got")).collect()
    assert {r.raw: r.got for r in rows} == URL_PAIRS


@pytest.mark.parametrize(
    ("url", "cleaned"),
    [
        ("https://www.comeet.com/jobs/syqe/F1.00C/back-end-developer/3B.01B", "https://www.comeet.com/jobs/syqe/F1.00C"),
        ("https://www.comeet.com/jobs/firefly/39.000?3433df04_page=8", "https://www.comeet.com/jobs/firefly/39.000?3433df04_page=8"),
        ("https://www.comeet.com/jobs/flare", "https://www.comeet.com/jobs/flare"),
        ("https://jobs.lever.co/acme/1", "https://jobs.lever.co/acme/1"),
        ("https://other.example.com/a/b/c/d/e/f", "https://other.example.com/a/b/c/d/e/f"),
    ],
)
def test_clean_company_page_url(spark, url, cleaned):
    assert one(spark, url, urls.clean_company_page_url) == cleaned


def test_clean_company_page_url_options(spark):
    query = lambda c: urls.clean_company_page_url(c, strip_query=True)
    lever = lambda c: urls.clean_company_page_url(c, fix_lever=True)
    assert one(spark, "https://www.comeet.com/jobs/f/39.000?p=8", query) == "https://www.comeet.com/jobs/f/39.000"
    assert one(spark, "https://jobs.lever.co/acme/1", lever) == "https://jobs.lever.co/acme"


def test_netloc_keeps_user_and_port(spark):
    assert one(spark, "https://u:p@a.com:8443/x?y", urls.netloc) == "u:p@a.com:8443"
    assert one(spark, "no url", urls.netloc) == ""


@pytest.mark.parametrize(
    ("title", "name"),
    [
        ("Jobs at Flare - Comeet", "Flare"),
        ("Jobs at Ask-AI - Careers - Comeet", "Ask-AI - Careers"),
        ("Jobs at Beamr - | :· ", "Beamr"),
        (" - |", None),
        ("", None),
        (None, None),
    ],
)
def test_company_name(spark, title, name):
    assert one(spark, title, lambda c: company_name(c, F.lit("comeet.com"))) == name


def test_company_name_of_other_domains_keeps_the_title(spark):
    assert one(spark, "Jobs at Acme |", lambda c: company_name(c, F.lit("lever.co"))) == "Jobs at Acme"


@pytest.mark.parametrize(
    ("title", "name"),
    [
        ("Jobs at Flare - comeet.com", "Flare"),
        ("Careers at Tesla | comeet.com", "Tesla"),
        ("Work at Google Careers", "Google"),
        ("Acme Jobs and more", "Acme"),
        ("Acme - Home | x", "Acme"),
        (" - ", None),
    ],
)
def test_legacy_company_name(spark, title, name):
    assert one(spark, title, lambda c: legacy_company_name(c, F.lit("comeet.com"))) == name


def test_strip_takes_all_white_space(spark):
    assert one(spark, "\t\xa0\u2003x y\u3000\x1c\n", text.strip) == "x y"
    assert one(spark, " \x85 ", text.blank_to_null) is None
    assert one(spark, " a \xa0\n b ", text.squeeze) == "a b"


def test_ascii_fold_leaves_other_letters(spark):
    assert one(spark, "ÉTAGE Ab", text.ascii_fold) == "ÉtAGE ab".replace("AGE", "age")


def test_script(spark):
    assert one(spark, "מפתח תוכנה Senior", text.mostly_script) is True
    assert one(spark, "Backend Engineer, Python and Go", text.mostly_script) is False
    assert one(spark, "123 !?", text.mostly_script) is False
    assert one(spark, None, text.mostly_script) is False
    assert one(spark, "123", text.script_share) is None


def test_descriptions(spark):
    row = spark.createDataFrame([({"a": "1", "b": "", "c": "2"}, None), (None, "plain")], "m map<string,string>, t string")
    got = row.select(
        text.storage_description(F.col("m"), F.col("t")).alias("s"),
        text.embedding_text(F.lit("T"), F.col("m"), F.col("t")).alias("e"),
    ).collect()
    assert [tuple(r) for r in got] == [("a:\n1\n\nc:\n2", "T\n\na: 1\nc: 2"), ("plain", "T\n\nplain")]
    empty = F.lit(None).cast("map<string,string>")
    assert evaluate(spark, text.embedding_text(F.lit(None).cast(S), empty, F.lit(None).cast(S))) == ""
    full = F.create_map(F.lit("requirements"), F.lit("r"))
    assert evaluate(spark, text.matching_text(full)) == "r"


def test_cosine(spark):
    frame = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([2.0], [2.0])],
        "a array<float>, b array<float>",
    )
    scores = [r.s for r in frame.select(cosine(F.col("a"), F.col("b")).alias("s")).collect()]
    assert scores[0] == pytest.approx(0.70710678) and scores[1:3] == [None, None] and scores[3] == pytest.approx(1.0)
    with pytest.raises(Exception, match="zero vector"):
        frame.select(cosine(F.col("a"), F.col("b"), zero_is_error=True)).collect()


def test_sanitised_record(spark):
    record = text.drop_blank_fields(
        {"a": text.non_empty(F.lit(""), "text"), "b": F.lit("x"), "c": text.non_empty(F.array().cast("array<string>"), "list"),
         "d": text.non_empty(F.create_map(F.lit("k"), F.lit(""), F.lit("l"), F.lit("v")), "map")}
    )
    assert evaluate(spark, record) == '{"b":"x","d":{"l":"v"}}'


@pytest.mark.parametrize(
    ("markup", "shown"),
    [
        ("plain  text ", "plain  text"),
        ("<p>a</p><p>b &amp; c</p>", "a\nb & c"),
        ("<p>a</p>  \n <p>b</p>", "a\n\n\nb"),
        ("x<!-- no -->y<script>no()</script><style>no</style><template>no</template>z", "x\ny\nz"),
        ("a<br>b<br/>c", "a\nb\nc"),
        ("<li>one<li>two", "one\ntwo"),
        ("1 < 2 &lt; 3", "1 < 2 < 3"),
        ("<p>cut &amp</p>&nope; &#150;&#8364;&#xe9;&#x110000;", "cut &\n&nope –€é\ufffd"),
        ("<pre>  </pre>x", "x"),
        ("", ""),
    ],
)
def test_fragment_text(markup, shown):
    assert fragment_text(markup) == shown


ANCHORS = """
<a class="x positionItem" href="/u1"><span class="positionLink"> Dev <b> Ops</b></span>
 <ul class="positionDetails"><li><i class="fa fa-map-marker"></i> Tel Aviv, IL </li><li>R&amp;D<li>Full-time</ul></a>
<a class="positionItem" ng-href="/u2"><span class="positionLink">QA</span></a>
<a class="positionItem" href="/u3"><span class="other">no title</span></a>
<div class="job-card"><h2>ignored</h2></div>"""


def test_page_anchors():
    listings = page_listings(ANCHORS)
    assert listings["cards"] == []
    assert [(a["title"], a["url"]) for a in listings["anchors"]] == [("DevOps", "/u1"), ("QA", "/u2")]
    # an unclosed line holds the ones that follow it
    assert listings["anchors"][0]["items"] == [
        {"text": "Tel Aviv, IL", "has_marker": True},
        {"text": "R&DFull-time", "has_marker": False},
        {"text": "Full-time", "has_marker": False},
    ]


def test_page_cards():
    markup = """<div class="big position-card"><a>none</a><h3>Later</h3><h2> First </h2><p class="category">C</p>
    <p class="team">T</p><a href="">empty</a><a href="/x">x</a></div><div class="job-item"><p>untitled</p></div>
    <span class="job-card"><h2>no div</h2></span>"""
    assert page_listings(markup)["cards"] == [
        {"title": "First", "department": "T", "location": None, "employment_type": None, "url": ""}
    ]
    assert page_listings("<p>nothing</p>") == {"anchors": [], "cards": []}
