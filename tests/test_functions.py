import datetime
import html
from html.entities import html5

import duckdb
from pyspark.sql import functions as F

from tidemill.functions import dates, text, urls
from tidemill.plans import catalog


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def many(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_normalise(spark):
    cases = {
        "http://www.bbc.co.uk/sport/articles/abc.amp?at_medium=RSS&at_campaign=rss#comments": "https://bbc.co.uk/sport/articles/abc",
        "http://www.m.example.com:80/a/b/?utm_source=x&b=2&a=1&a=0": "https://example.com/a/b?a=1&a=0&b=2",
        "https://EXAMPLE.com./A/%c3%a9/": "https://example.com/A/%C3%A9",
        "https://www.google.com/amp/s/www.example.com/path/?x=1": "https://example.com/path?x=1",
        "https://www-example-com.cdn.ampproject.org/c/s/www.example.com/story.amp.html": "https://example.com/story.html",
        "https://m.com/": "https://m.com/",
        "https://example.com/amp/x/amp/?ref=keep&outputType=amp&amp=1": "https://example.com/x?ref=keep",
        "https://news.kr/news/articleViewAmp.html?idxno=5": "https://news.kr/news/articleView.html?idxno=5",
        "  not a url ": "not a url",
        "ftp://x.y/z": "ftp://x.y/z",
        "https://example.com:8443/": "https://example.com:8443/",
        "https://a.com/x/./y/../z/%2e%2E/w": "https://a.com/x/w",
        "https://a.com/../..": "https://a.com/",
        "https://a.com/x..y/...": "https://a.com/x..y/...",
        "https://a.com/?q=x+y&utm%5Fid=1&p=%zz&r": "https://a.com/?p=%25zz&q=x+y&r=",
        "https://a.com/?q=x%20y&p=~*": "https://a.com/?p=%7E*&q=x+y",
        None: None,
    }
    assert many(spark, ["https://Bücher.example/x", "https://a.com/", None], lambda c: urls.normalise(c, idn=True)) == ["https://xn--bcher-kva.example/x", "https://a.com/", None]
    assert many(spark, list(cases), urls.normalise) == list(cases.values())
    assert one(spark, "http://www.a.com/x#y", urls.url_hash) == one(spark, "https://a.com/x/", urls.url_hash)
    assert len(one(spark, "http://a.com", urls.card_id)) == 12


def test_clean(spark):
    assert many(spark, ["a &amp;amp; b", "&#x27;x&#39;", "\x93q\x94", None], text.decode_entities) == ["a & b", "'x'", "“q”", None]
    assert one(spark, " A\r\n\tB\x07 &lt;i&gt; ", text.clean_title) == "A \tB <i>".replace("\t", "")
    assert many(spark, ["<p>x &lt;b&gt;y</p>", "<br>", "é" * 600], text.clean_summary) == ["x y", None, "é" * 500]
    assert one(spark, "Anna Lee, BOB and anna  lee & C|d", text.author_keys) == ["anna lee", "bob", "c", "d"]


def test_whole_texts_are_decoded_without_python_workers(spark):
    numbers = (0, 9, 13, 38, 65, 127, 0xD7FF, 0xD800, 0xFDD0, 0xFEFF, 0xFFFE, 0x10000, 0x1F600, 0x10FFFF, 0x110000, 10**8, 2**64)
    cases = [f"a&{n}b&{n.rstrip(';')}c;" for n in html5] + [f"&#{n}&#00{n};&#x{n:x};&#X{n:X}z" for n in numbers] + ["&amp;amp;amp;lt;", "&ltfoo; &unknown; &;&#;&#x;&&lt" + "q" * 40 + ";", "", None]

    def decoded(x):
        for _ in range(3):
            x = html.unescape(x)
        return x

    assert many(spark, cases, text.decode_entities) == [x and decoded(x) for x in cases]
    # mended only after the last pass, so what a dropped control leaves is no entity
    assert many(spark, ["&#128;\x80&#129;\x81", "&am\x81p;", "&#" + "9" * 5000 + ";"], text.decode_entities) == ["€€", "&amp;", "\ufffd"]
    plan = spark.createDataFrame([("x",)], "x string").select(text.clean_summary(F.col("x")), text.clean_title(F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_a_page_with_cut_names_of_entities_equals_the_sql(spark, tmp_path):
    bodies = ["token = &quot", "&quot &copy &quot; &copy;x", "a &amp b&ampc &amp;amp;amp b", "&ampquot; &amp;quot;&amp;quot &quo &am & &;", "<i>&amp;middot; &middot", "", None]
    pages = [(i, b and f"<title>{b}</title><p>{b}</p>") for i, b in enumerate(bodies)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["clean_summary"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["clean_summary"](spark, str(tmp_path)).collect())) == sorted(want)
    # numbers need their end as well, if names do
    assert many(spark, ["&#65 &#65; &#x41 &#x41; &lt &lt;"], lambda c: text.decode_entities(c, ["amp"])) == ["&#65 A &#x41 A &lt <"]


def test_keys(spark):
    assert one(spark, "Müller–O’Neil", text.fold_name) == "muller-o'neil"
    kept = "ﬁne Ångström ½ 가\u0301"
    assert len(one(spark, kept, text.fold_name)) == len(kept)
    assert many(spark, ["Münche\u0301n-ÅB ệ", "한국어", "", None], text.search_tokens) == [["munchen", "ab", "e"], ["한국어"], [], None]
    assert many(spark, ["x@y.org (Ann Bo), C", "no@mail"], text.author_keys) == [["ann bo", "c"], ["no@mail"]]
    assert one(spark, "São Paulo: 2", text.latin_key) == " sao paulo 2 "
    assert many(spark, ["가나", "힣", "éa", " z"], text.initial) == ["ㄱ", "ㅎ", "É", "Z"]
    assert many(spark, ["사과", "서울", "집", "7", "3", "x", "집!"], text.final_sound) == ["open", "rieul", "closed", "rieul", "closed", None, "closed"]


def test_titles(spark):
    titles = ["A 2-1 B", "2026-27 season", "won 1 – 3, lost 3-1", "U-21 and 16-2", "8.4-2"]
    assert many(spark, titles, text.scores) == [["1-2"], [], ["1-3"], [], []]
    assert many(spark, ["X & more", "The weekly quiz: who?", "Why this", "a, b, c, d", "No why", "Plain"], lambda c: text.is_roundup(c, text.Roundup(("& more", "weekly quiz"), ("why",)))) == [True, True, True, True, False, False]
    spoken = ["Real 2, Barca 1", "out 2-3 weeks", "won 2-1 Weeks", "Barca 1 Real 16"]
    assert many(spark, spoken, lambda c: text.scores(c, units=("weeks",), names=("Real", "Barca"))) == [["1-2"], [], [], []]


def test_names_and_tags(spark):
    table = [("Man City", "MC"), ("Man", "M"), ("city", "C")]
    assert one(spark, "man city, Man and citys", lambda c: text.substitute(c, table)) == "MC, M and citys"
    assert one(spark, "가 Son Heung 나 PSG", lambda c: text.latin_spans(c, ["PSG"])) == ["Son Heung"]
    assert one(spark, ["a|b", "50%7C", ""], lambda c: text.decode_tags(text.encode_tags(c)), "array<string>") == ["a|b", "50%7C"]
    assert one(spark, "a.jpg 1x, b.jpg 2x", text.srcset_urls) == ["a.jpg", "b.jpg"]


def test_ics_lines(spark):
    line = one(spark, "SUMMARY:" + "é" * 80, text.fold_ics)
    assert all(len(x.encode()) <= 75 for x in line.split("\r\n")) and line.replace("\r\n ", "") == "SUMMARY:" + "é" * 80


def test_feed_dates(spark):
    utc = lambda *a: datetime.datetime(*a)
    cases = [("Tue, 03 Nov 2026 10:15:00 +0900", None, utc(2026, 11, 3, 1, 15)), ("3 Nov 2026 10:15 EST", None, utc(2026, 11, 3, 15, 15)), ("2026-11-03T10:15:00Z", None, utc(2026, 11, 3, 10, 15)), ("2026-11-03T10:15:00.123+01:00", None, utc(2026, 11, 3, 9, 15)), ("2026-11-03 10:15:00", "Asia/Seoul", utc(2026, 11, 3, 1, 15)), ("2026-11-03 10:15:00", None, None), ("rubbish", "UTC", None), (None, "UTC", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, x string, z string")
    got = [r.y for r in df.select("i", dates.feed_date(F.col("x"), F.col("z")).alias("y")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_calendar_edges(spark):
    weeks = many(spark, [datetime.date(2027, 1, 1), datetime.date(2026, 12, 28), datetime.date(2024, 12, 30)], dates.iso_week, "date")
    assert weeks == ["2026-53", "2026-53", "2025-01"]
    at = [datetime.datetime(2026, 3, 29, 0, 59, 59), datetime.datetime(2026, 3, 29, 1), datetime.datetime(2026, 10, 25, 0, 59), datetime.datetime(2026, 10, 25, 1)]
    assert many(spark, at, dates.is_eu_summer, "timestamp") == [False, True, True, False]


def test_particles(spark):
    names = [("Paris", "파리"), ("Seoul", "서울"), ("Busan", "부산"), ("Rome", "Roma")]
    texts = ["Paris은 Seoul로 Busan와", "seoul으로, Paris으로 Rome을", "Parisian은", None, ""]
    assert many(spark, texts, lambda c: text.substitute(c, names, text.PARTICLES)) == ["파리는 서울로 부산과", "서울로, 파리로 Roma을", "Parisian은", None, ""]
    assert one(spark, "Paris은", lambda c: text.substitute(c, [], text.PARTICLES)) == "Paris은"


def test_local_to_utc(spark):
    from zoneinfo import ZoneInfo

    utc, zones = datetime.timezone.utc, ("Europe/London", "America/New_York", "Australia/Lord_Howe", "Asia/Seoul")
    days = [datetime.datetime(2026, m, d) for m, d in ((3, 8), (3, 29), (4, 5), (10, 4), (10, 25), (11, 1), (7, 1))]
    times = [d + datetime.timedelta(minutes=15 * k) for d in days for k in range(20)]
    for zone in zones:
        for choice in ("compatible", "earlier", "later", "reject"):

            def rule(t):
                first, second = (t.replace(tzinfo=ZoneInfo(zone), fold=f).astimezone(utc) for f in (0, 1))
                real = first.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == t
                if first == second:
                    return int(first.timestamp())
                if choice == "reject":
                    return None
                gap = {"compatible": first, "earlier": second, "later": first}
                twice = {"compatible": first, "earlier": first, "later": second}
                return int((twice if real else gap)[choice].timestamp())

            seconds = [int(t.replace(tzinfo=utc).timestamp()) for t in times]
            got = many(spark, seconds, lambda c: F.unix_timestamp(dates.to_utc(F.timestamp_seconds(c), zone, choice)), "long")
            assert got == [rule(t) for t in times]
