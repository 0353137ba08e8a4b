import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, rules, text, urls


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_numbers(spark):
    r = one(
        spark, a=numbers.percent(F.lit(1), F.lit(0)), b=numbers.percent_or_null(F.lit(1), F.lit(0)), c=numbers.unit_ratio(F.lit(3), F.lit(2)), d=numbers.coverage(F.lit(0), F.lit(0)),
        e=numbers.half_up(F.lit(0.285), 2), f=numbers.percent(F.lit(1), F.lit(3)), g=numbers.grade(F.lit(59.9)), h=numbers.clamp(F.lit(120.0), 0.0, 100.0),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (0.0, None, None, 1.0, 0.28, 33.3, "risk", 100.0)


def test_rules(spark):
    r = one(
        spark, a=rules.first_match([(F.lit(None).cast("boolean"), "x"), (F.lit(True), "y")], "z"), b=rules.rank_in(F.lit("q"), ("a", "b")),
        c=rules.worst([F.lit("safe"), F.lit(None).cast("string"), F.lit("risk")], ("safe", "caution", "risk")), d=rules.matched_names({"p": F.lit(True), "q": F.lit(False), "r": F.lit(True)}),
        e=rules.additive(50, [(F.lit(True), 40), (F.lit(None).cast("boolean"), 5)]), f=rules.any_contains(F.lit("abc"), ("x", "bc")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("y", 2, "risk", ["p", "r"], 90, True)


def test_urls(spark):
    url = F.lit(" HTTPS://User@WWW.Example.com:443/A/b/?utm_source=x&Q=1&ref=y#top")
    r = one(
        spark, a=urls.normalize_url(url), b=urls.host(url), c=urls.origin_key(F.lit("http://h.example:8080/")), d=urls.normalize_url(F.lit("no address")), e=urls.homepage_like(F.lit("http://h.example/index.html")),
        f=urls.public_address(F.lit("http://192.168.1.1/")), g=urls.extract_urls(F.lit("see http://a.example/x. or HTTP://A.example/X and http://b.example!")), h=urls.host(F.lit(None).cast("string")),
    )
    assert r.a == "https://www.example.com/A/b?Q=1" and r.b == "example.com" and r.c == "h.example:8080" and r.d is None and r.e and not r.f
    assert r.g == ["http://a.example/x", "http://b.example"] and r.h is None


def test_texts(spark):
    r = one(
        spark, a=text.sanitize_title(F.lit("  a\n\tb  ")), b=text.sanitize_title(F.lit("http://x.example/y")), c=text.sentences_with(F.lit("One. Two words! three"), ("two", "THREE")),
        d=text.name_key(F.lit("(주)Ａ나다 Co. [x]")), e=text.visible_text(F.lit("<p>a &amp; b</p><script>no</script>")), f=text.around(F.lit("abcdefgh"), "de", 1, 1),
        g=text.badges(F.array(F.lit("x1"), F.lit("y2")), {"one": "1", "three": "3", "two": "2"}),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("a b", None, ["Two words", "three"], "a나다co", "a & b", "cdef", ["one", "two"])


def test_dates(spark):
    late = F.lit("2026-01-01 16:30:00").cast("timestamp")
    r = one(
        spark, a=dates.local_date(late), b=dates.day_start(F.lit("2026-01-02").cast("date")), c=dates.iso_days(F.lit("2026.2.30 ~ 2026-13-01, 2025년 1월 5일")), d=dates.backoff_days(F.lit(3), F.lit(2)),
        e=dates.backoff_days(F.lit(7), F.lit(9)), f=dates.years_in(F.lit("1999 and 2026, 1999")), g=dates.stale(F.lit(None).cast("timestamp"), late, 60),
    )
    assert r.a == dt.date(2026, 1, 2) and r.b == dt.datetime(2026, 1, 1, 15, 0) and r.c == ["2026-02-30", "2025-01-05"] and (r.d, r.e) == (9, 14) and r.f == ["1999", "2026"] and r.g is False
