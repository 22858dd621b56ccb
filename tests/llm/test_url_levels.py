"""The template tree tells all segments of a path apart and merges inner branches."""

from tessera.llm import url_filter


def test_deep_segments_and_inner_merges(spark):
    urls = [f"http://s.com/{lang}/a/b/c/d/{x}" for lang, x in (("de", "login"), ("fr", "news")) for _ in range(10)]
    urls += ["http://t.net/q/a/b/c/d/login", "http://t.net/q/a/b/c/d/news"]
    # on one host, inner branches with equal shares of blocked urls
    rules = [f"http://example.org/{lang}/{part}/x" for part in ("p", "q") for lang in ("es", "en") for _ in range(10)]
    pages = spark.createDataFrame(list(enumerate(urls + rules)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(urls + rules)
    assert got[20].template.endswith("/d/login") and got[21].template.endswith("/d/news")
    assert (got[0].verdict, got[10].verdict) == ("block", "allow") and got[0].purity > 0.5 > got[10].purity


def test_inner_segments_merge(spark):
    rows = [("h", ["", x, y], ["", x, y], 20, 20, b) for x in ("a", "b") for y, b in (("u", 0), ("v", 20))]
    tree = spark.createDataFrame(rows, "host string, form array<string>, now array<string>, n long, m long, b long")
    got = {tuple(r.form): tuple(r.now) for r in url_filter._merge(url_filter._merge(tree, 2), 1).collect()}
    assert got == {("", x, y): ("", "*", y) for x in "ab" for y in "uv"}


def test_a_trap_of_many_segments_adds_no_levels(spark):
    import time

    urls = [f"http://s.com/{lang}/a/{x}" for lang, x in (("de", "login"), ("fr", "news")) for _ in range(10)]
    urls += [f"http://t.net/list/{chr(97 + k % 26)}{chr(97 + k // 26)}x/view" for k in range(30)]
    plain = {r.page_id: tuple(r) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert {plain[k][5] for k in range(20, 50)} == {"/list/*/view"}
    urls.append("http://trap.net/" + "/".join(f"x{chr(97 + k % 7)}" for k in range(2000)))
    began = time.time()
    got = {r.page_id: tuple(r) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert time.time() - began < 60 and all(got[k] == plain[k] for k in plain) and got[50][5].count("/") == 2000


def test_skipped_levels_change_nothing(spark):
    import random

    rng = random.Random(3)
    urls = [f"http://{rng.choice(['example.org', 'u.com', 'v.org', 'w.net'])}/" + "/".join(rng.choice(["de", "es", "en", "q" + "abcdefghijklmnopqrstuvwxyz"[rng.randrange(26)]]) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    some = sorted(map(str, url_filter.judge_urls(pages).collect()))
    depths, url_filter._depths = url_filter._depths, lambda tree, more_than, rows: list(range(1, 7))
    try:
        assert sorted(map(str, url_filter.judge_urls(pages).collect())) == some
    finally:
        url_filter._depths = depths
