from patchloom.llm import urls as U

SCHEMA = "page_id bigint, url string, html string"


def judge(spark, urls, **kw):
    pages = spark.createDataFrame([(i, u, "") for i, u in urls], SCHEMA).selectExpr(
        "*", "1 AS block", "2 AS canonical", "3 AS host")
    return {r.page_id: r for r in U.filter_urls(pages.select("page_id", "url", "block"), **kw).collect()}


def test_rules(spark):
    got = judge(spark, [
        (1, "https://A.Net/x"), (2, "http://www.example.net/en/1?q=/"), (3, "http://net?x"),
        (4, "http://example.com/de/"), (5, "http://notexample.com/de/"), (6, "x://b.org/fr/?a#b"),
        (7, None), (8, "no scheme"), (9, "http://h.org#x://y.net/"), (10, "http://ÄB.net/Ü"),
        (11, "://org/fr/"), (12, "")])
    rule = {k: (r.rule, r.verdict) for k, r in got.items()}
    assert rule[1] == ("net/", "block") and rule[2] == ("example.net/en/", "allow")
    assert rule[3] == (None, "allow") and rule[4] == ("example.com/de/", "block")
    assert rule[5] == (None, "allow") and rule[6] == ("org/fr/", "allow")
    assert rule[11] == ("org/fr/", "allow") and rule[10] == ("net/", "block")
    assert (got[7].host, got[7].path, got[8].host, got[12].path) == ("", "", "", "")
    assert (got[9].host, got[9].path, got[10].host) == ("h.org", "", "Äb.net".replace("b", "b"))


def test_listed_urls(spark):
    got = judge(spark, [
        (5, "http://www.a.com/x.html?utm_source=f"), (6, "https://a.com/x#top"),
        (7, "http://A.com/x/?ref=1"), (8, "http://a.com/x?page=2"), (9, "http://a.com/y")])
    assert [got[i].verdict for i in (5, 6, 7, 8, 9)] == ["allow", "block", "block", "allow", "allow"]
    assert [got[i].listed for i in (5, 6, 7, 8, 9)] == [True, True, True, False, False]


def test_no_false_hit_survives_a_tiny_filter(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BLOCKS", 1)
    listed = spark.createDataFrame([(f"l{i}.com/a", None) for i in range(300)],
                                   "canonical string, first_page bigint")
    listed = listed.selectExpr("canonical", "-1L AS first_page")
    got = judge(spark, [(i, f"http://{'l' if i % 3 == 0 else 'f'}{i}.com/a") for i in range(300)],
                listed=listed)
    assert all((r.verdict == "block") == (i % 3 == 0) for i, r in got.items())


def test_repeated_and_missing_rows(spark):
    assert judge(spark, []) == {}
    pages = spark.createDataFrame([(1, "http://a.com/x", ""), (1, "http://a.com/x", ""),
                                   (None, "http://a.com/x", "")], SCHEMA)
    got = [(r.page_id, r.verdict) for r in U.filter_urls(pages).collect()]
    assert sorted(got, key=repr) == [(1, "allow"), (1, "allow"), (None, "block")]


def test_a_page_that_a_rule_blocks_does_not_stand_for_its_copies(spark):
    got = judge(spark, [(1, "http://example.com/de/"), (2, "http://example.com/de"),
                        (3, "http://www.example.com/de"), (4, "http://example.com/de?" + "a=b&" * 9000)])
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["block", "allow", "block", "allow"]
    assert got[1].rule == "example.com/de/" and got[2].rule is None


def test_pages_that_rules_decide_count_among_the_copies_of_a_url(spark):
    got = judge(spark, [(1, "http://b.org/fr/"), (2, "http://b.org/fr"), (3, "http://www.b.org/fr"),
                        (4, "http://c.org/fr"), (5, "http://c.org/fr/"), (6, "http://example.com/de/"),
                        (7, "http://www.example.com/de/"), (8, "http://example.com/de"),
                        (9, "http://a.net/x"), (10, "http://a.net/x#y")])
    stays = [i for i in sorted(got) if got[i].verdict == "allow"]
    assert stays == [1, 5, 8]  # each URL once, unless a rule blocks all its pages
    assert all(r.listed for r in got.values())
