import re

import pytest
from fixtures import DATA, same_as_sql

from resemblage.llm import urls

CASES = {
    "http://www.casino.example.com/": True, "http://casinos.example.com/": False, "https://m.casino-win.example.com/en/1": True, "http://a.com/cheap/offers-online": False, "http://a.com/cheap/pills/deal": True, "http://cheap-pills.example.com/": True, "http://farm.com/cheap": False,
    "http://a.com/bet-poker": True, "http://a.com/bet/bet/bet": False, "HTTP://A.COM/XXX": True, "http://essex.com/": False, "": False, None: False, "http://a.com/?utm_source=feed": False,
    "http://xxx": True, "xxx": True, "http://a.com/sex_cams": True, "http://a.com/free_deals": False, "http://a.com/sex_adult": True, "http://a.com/" + "a" * 100_000 + "/viagra": True, "http://ü.com/xxxé": True,
}


def frame(spark, rows):
    return spark.createDataFrame([(i, u, "<p>", "no", "no") for i, u in rows], "page_id long, url string, html string, URL string, terms string")


def test_cases(spark):
    rows = list(enumerate(CASES))
    got = {r["url"]: r["is_rejected"] for r in urls.judge(frame(spark, rows)).collect()}
    assert got == CASES
    assert urls.keep(frame(spark, rows)).count() == sum(not v for v in CASES.values())
    assert urls.judge(frame(spark, [])).count() == 0 and urls.judge(frame(spark, [(None, "xxx")] * 3)).filter("is_rejected").count() == 3


def test_equals_sql(spark):
    same_as_sql(urls.judge(spark.read.parquet(f"{DATA}/pages.parquet")), urls.SQL, pages=f"{DATA}/pages.parquet")
    rows = [u for u in CASES if u is None or len(u) < 1000] * 2 + ["http://bet-bet.bet/bet", "ads-track-ads-track", "casino-win-casino"]
    own = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    same_as_sql(urls.judge(own), urls.SQL, pages=own.toPandas())


def test_equals_brute_force():
    strict, soft = urls.read_terms()
    words = tuple(sorted({*strict, *soft}))
    for u in [*filter(None, CASES), "bet-bet.bet/xbet bets", "free-bets/free_bets"]:
        want = {w: n for w in words if (n := len(re.findall(rf"(?<![a-z0-9])(?={re.escape(w)}(?![a-z0-9]))", u.lower() if u.isascii() else u)))}
        assert urls.terms(u, words) == want


def test_own_vocabulary(spark, tmp_path):
    table = spark.createDataFrame([("FOO", "strict", None, 1), ("bar", "soft", 0.5, 1), ("baz", "soft", 0.5, 1), ("", "strict", None, 1)], "term string, kind string, weight double, TERM int")
    (tmp_path / "v.tsv").write_text("term\tkind\tweight\nFOO\tstrict\t\nbar\tsoft\t0.5\nbaz\tsoft\t0.5\n")
    assert urls.terms_of(table) == urls.read_terms(tmp_path / "v.tsv")
    rows = frame(spark, [(1, "a/Foo/x"), (2, "foo"), (3, "bar/bar"), (4, "bar/baz")])
    got = {r["url"]: r for r in urls.judge(rows, urls.terms_of(table)).collect()}
    assert {u: r["is_rejected"] for u, r in got.items()} == {"a/Foo/x": True, "foo": True, "bar/bar": False, "bar/baz": True} and got["foo"]["strict_hits"] == 1
    assert urls.judge(frame(spark, [(1, "a")]), (frozenset(), {})).first()["is_rejected"] is False
    with pytest.raises(ValueError, match="more than 2"):
        urls.terms_of(table, 2)
    with pytest.raises(ValueError, match="strict or soft"):
        urls.terms_of(spark.createDataFrame([("a", "hard", 1.0)], "term string, kind string, weight double"))
