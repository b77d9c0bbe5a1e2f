"""Archives, extraction and languages."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F
import zstandard

from seapoint.llm.html_text import extract_text, main_text
from seapoint.llm.language_id import identify_languages, with_known_language
from seapoint.llm.warc import DICTIONARY_MAGIC, BadArchive, archive_round_trip, parse_record, read_records, warc_record


def test_archives(spark):
    long_text = "é" * 80
    rows = [(5, "http://a/ b\r\nX: y", long_text), (3, None, long_text), (9, "u", None), (8, "u", ""), (7, "u", "short"), (6, "u", "short"), (None, "u", long_text), (3, None, long_text), (1, "v", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and page != 3 and html == long_text
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert sorted(map(tuple, archive_round_trip(pages).drop("url").collect()), key=repr) == sorted(want, key=repr)
    assert archive_round_trip(pages.limit(0)).collect() == []


def test_damaged_archives():
    record = warc_record(1, "http://a/", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    dictionary = zstandard.ZstdCompressionDict(b"WARC/1.1 Content-Length payload" * 20)
    raw = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    head = DICTIONARY_MAGIC + struct.pack("<I", len(raw)) + raw
    frame = zstandard.ZstdCompressor(dict_data=dictionary).compress(record)
    assert list(read_records(head + frame + frame)) == [record, record]
    for bad in (head[:6], head + frame[:-3], head + b"junk"):
        with pytest.raises((BadArchive, zstandard.ZstdError)):
            list(read_records(bad))
    for bad in (record[:-1], record.replace(b"payload\r\n", b"payl0ad\r\n"), record.replace(b"Content-Length: ", b"Content-Length: 9", 1), b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(BadArchive):
            parse_record(bad)


ARTICLE = "<h1>Head&amp;line</h1><p><b>First  part<br>second &lt;b&gt;<p>Short.</p><ul><li>item one<li>item two</ul>"
WANT = "Head&line\nFirst part\nsecond <b>\nShort.\nitem one\nitem two"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article>{ARTICLE}</article><footer>&copy; me</footer>", WANT),
        (f"<body><header>top</header><main>{ARTICLE}<section id=comments><p>what a long reader comment this is</section></main><aside>more</aside></body>", WANT),
        (f"<body><article>{ARTICLE}<div class='newsletter'><form>mail</form></div></article><article class='comment'>no</article></body>", WANT),
        ("<p>" + "plain text of a page without marks. " * 4 + "</p><p>End.</p><div class=footer>foot</div>", ("plain text of a page without marks. " * 4).strip() + "\nEnd."),
        ("", ""),
        (None, ""),
        ("<article><p>One</article>", "One"),
        ("no markup", "no markup"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


LONG = ("plain text of a page without marks. " * 4).strip()
MENU = "<ul><li><a href=a>one</a><li><a href=b>two</a><li><a href=c>three</a></ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<p>{LONG}</p>" + "<div class='ad'>buy this</div>" * 3 + "<p>Short end.</p>", f"{LONG}\nShort end."),
        (f"<p>{LONG}</p>{MENU}<p>Short end.</p>", f"{LONG}\none\ntwo\nthree\nShort end."),
        (f"<div>Shop</div>{MENU}<h1>Title</h1>" + "<div class='share'>share</div>" * 4 + f"<p>{LONG}</p>{MENU}", f"Title\n{LONG}"),
        (f"{MENU}<h1><a href=x>Title</a></h1><p>{LONG}</p><p><a href=y>A source</a></p>", f"Title\n{LONG}\nA source"),
        (f"<p>{LONG}</p><p><a href=x>A linked line</a></p><p>End.</p>", f"{LONG}\nA linked line\nEnd."),
        (f"<main><p>{LONG}</p><p>More.</p><article class='card'>teaser</article></main>", f"{LONG}\nMore.\nteaser"),
        (f"<main><p>Lead.</p><article><p>{LONG}</p></article></main>", LONG),
        ("<p><a href=x>only a link</a></p>", "only a link"),
    ],
)
def test_text_beside_furniture(page, want):
    """Nothing but furniture goes: not what follows an advert, not a linked line, not the body around a card."""
    assert main_text(page) == want


def test_extraction_of_a_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (None, None, None, "y"), (1, "u", "<article><p>" + "word " * 50_000 + "</article>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars) for r in extract_text(pages).collect())
    assert got == [(0, 0), (1, len(WANT)), (1, 249_999)]
    assert extract_text(pages.limit(0)).collect() == []


def test_languages(spark, corpus, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify_languages(docs).join(docs, "doc_id")
    held = found.filter("held_out").selectExpr("avg(CAST(lang_pred = lang AS INT)) AS right", "min(score) AS low", "max(score) AS high").first()
    assert held.right >= 0.97 and 0 <= held.low and held.high <= 1
    small = {(r.doc_id, r.lang_pred == "und") for r in identify_languages(corpus).collect()}
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert {d for d, und in small if und} == {d for d, t in texts.items() if not any(c.isalpha() for c in t or "")}
    assert identify_languages(nothing).collect() == []
    assert {r.lang_pred for r in identify_languages(corpus.withColumn("lang", corpus.lang.substr(9, 1)).filter("false").unionByName(nothing)).collect()} == set()
    kept = with_known_language(corpus)
    assert kept.schema == corpus.schema and kept.filter("text IS NULL OR text = '12 34 !!'").count() == 0


def test_languages_that_were_not_learned(spark):
    """Other scripts and languages go, however many were learned; every document of a learned one stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL")
    texts = ["Это обычный русский текст о погоде и о людях, которые живут в городе.", "Ez egy magyar szöveg, amely a városban élő emberekről szól.", "Η γλώσσα είναι ελληνική"]
    other = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for known in (["de", "en"], ["de", "en", "es"], ["de", "en", "es", "fr"]):
        learned = docs.filter(docs.lang.isin(known))
        kept = [r.doc_id for r in with_known_language(learned.unionByName(other, allowMissingColumns=True)).select("doc_id").collect()]
        assert sorted(kept) == sorted(r.doc_id for r in learned.collect())


def test_recognised_language_goes_on(spark):
    """What follows reads the recognised language, also of documents that declare none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("declared", F.col("lang"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 10 > 0, F.col("lang")))
    found = with_known_language(docs).filter("doc_id % 10 = 0").selectExpr("count(*) AS n", "avg(CAST(lang <=> declared AS INT)) AS right").first()
    assert found.n == docs.filter("lang IS NULL").count() and found.right >= 0.97


@pytest.mark.parametrize(
    "part, kept",
    [
        ('<h2 id="search-algorithms">Search algorithms</h2>', "Search algorithms"),
        ('<h2 id="related-work" class="comments">Related work</h2>', "Related work"),
        ('<section id="legal-basis"><p>Kept.</p></section>', "Kept."),
        ('<section id="legal"><h3>Legal</h3><p>Kept.</p></section>', "Legal\nKept."),
        ('<div class="share-price"><p>Kept 12.5</p></div>', "Kept 12.5"),
        ('<p class="menu-of-the-day">Kept soup.</p>', "Kept soup."),
        ('<h2 hidden>gone</h2>', ""),
        ('<div class="ad">gone</div>', ""),
        ('<div class="advert-box">gone</div>', ""),
        ('<div class="ad-slot-2">gone</div>', ""),
        ('<div class="comment-list"><p>gone</p></div>', ""),
        ('<section id="comments"><p>gone</p></section>', ""),
        ('<div class="newsletter-signup">gone</div>', ""),
        ('<ul class="wide share-buttons"><li>gone</li></ul>', ""),
        ('<div role="navigation">gone</div>', ""),
        ('<div class="cookie-notice">gone</div>', ""),
    ],
)
def test_names_inside_an_article(part, kept):
    """Headings and ids made of their words stay; boxes named as a whole go."""
    page = f"<body><nav>Home</nav><article><p>Body text.</p>{part}<p>The end.</p></article></body>"
    assert main_text(page) == "\n".join(x for x in ("Body text.", kept, "The end.") if x)


def test_ids_on_a_page_without_marks():
    text = "A paragraph that is long enough to be the beginning of the text of this page without marks."
    page = f'<body><div id="menu">Home</div><div><p>{text}</p><h2 id="search-basics">Search basics</h2><p id="related-work">Kept.</p></div></body>'
    assert main_text(page) == f"{text}\nSearch basics\nKept."
