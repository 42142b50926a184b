"""The stated url rules, word for word as the contract lists them."""

from engram.llm import urlfilter

CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_rules_are_those_of_the_contract():
    assert ", ".join(f"{says} {host}{path}" for says, host, path in urlfilter.RULES) == CONTRACT


def test_verdicts_follow_the_contract(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.net/de/1"), (2, "http://www.example.net/de/8"), (3, "http://example.net/de/7"), (4, "http://x.com/en/7"), (5, "http://example.com/en/7"), (6, "http://x.org/es/")],
        "page_id long, url string",
    )
    labelled = spark.createDataFrame([("http://a.net/de/1", True)] * 9, "url string, bad boolean")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(pages, labelled).collect()}
    assert got == {
        1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("net/de/", "allow"), 4: ("com/en/", "block"), 5: ("example.com/en/7", "allow"), 6: ("org/es/", "block"),
    }
