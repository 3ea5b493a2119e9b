import random
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from folioscope.llm import urls
from folioscope.llm.common import Scratch
from folioscope.llm.queries import URL_RULES


def plain_rule(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return host, path, best[0], best[1]


URLS = ["http://A.Example.ORG/es/1?x=1", "https://example.org/en/12", "https://example.org/en/2#t", "http://x.com/fr/", "http://com/de/a", "http://x.net/de/", "no url", None, "", "ftp://org", "://org/a", "a://b://c.org/x", "http://xorg/", "http://é.org?q", "http://x.org#f/", "http://x.com/fr/\nnext"]


def test_parts_and_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "s") for k, u in enumerate(URLS)], "page_id int, url string, score string")
    for r in urls.filter_urls(pages, URL_RULES).collect():
        host, path, rule, verdict = plain_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_models_tell_kinds_apart(spark):
    rnd = random.Random(1)
    name = lambda letters: "".join(rnd.choice(letters) for _ in range(8))
    rows = [f"http://{name('abcde')}.{tld}{path}" for tld, path in (("org", "/"), ("com", "/fr/")) for _ in range(150)]
    rows += [f"http://{name('vwxyz')}.com/de/" for _ in range(300)]
    judged = [f"http://{name(s)}.net/" for s in ("abcde", "vwxyz") for _ in range(50)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(rows + judged)], "page_id int, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, URL_RULES).collect()}
    right = [got[len(rows) + k] == ("allow" if k < 50 else "block") for k in range(100)]
    assert sum(right) > 95


def plain_models(seqs):
    """p(kind, gram) of a plain Witten-Bell model of each kind, and the grams that were counted."""
    counts = {True: Counter(), False: Counter()}
    for s, kind in seqs:
        for i in range(len(s)):
            for o in range(min(urls.DEPTH, i) + 1):
                counts[kind][s[i - o : i + 1]] += 1

    def p(kind, gram):
        c = counts[kind]
        if len(gram) == 1:
            return (c[gram] + 1) / (sum(n for g, n in c.items() if len(g) == 1) + urls.ALPHABET + 1)
        own = {g: n for g, n in c.items() if len(g) == len(gram) and g[:-1] == gram[:-1]}
        lower = p(kind, gram[1:])
        return (c[gram] + len(own) * lower) / (sum(own.values()) + len(own)) if own else lower

    return p, {*counts[True], *counts[False]}


def test_smoothed_ratios_equal_brute_force(spark):
    seqs = [("\x02ab\x03", True), ("\x02abb\x03", True), ("\x02ba\x03", False)]
    found = urls.log_ratios(spark.createDataFrame(seqs, "seq string, accepted boolean"), Scratch(spark)).collect()
    p, grams = plain_models(seqs)
    got = {r["gram"]: r["v"] for r in found}
    assert got.keys() == grams | {""} and len(found) == len(got)
    for gram, v in got.items():
        assert abs(v - (log(p(True, gram or "?")) - log(p(False, gram or "?")))) < 1e-9


@pytest.mark.parametrize("most", [urls.BROADCAST, 3])
def test_scores_equal_the_plain_difference_of_log_probabilities(spark, monkeypatch, most):
    """URLs with characters, grams and contexts that only one model, or none, has seen; ratios broadcast and not."""
    monkeypatch.setattr(urls, "BROADCAST", most)
    rnd = random.Random(6)
    url = lambda letters: "\x02" + "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) + "\x03"
    seqs = [(url("abc/"), True) for _ in range(40)] + [(url("bcd."), False) for _ in range(25)]
    asked = sorted({*(url("abcd/.") for _ in range(40)), *(url("abxyé") for _ in range(20)), "zz", "?", "ab?ab?ab"})
    ratios = urls.log_ratios(spark.createDataFrame(seqs, "seq string, accepted boolean"), Scratch(spark))
    rows = spark.createDataFrame(list(enumerate(asked)), "h1 long, seq string").withColumn("h2", F.lit(0).cast("long"))
    got = {r["h1"]: r["score"] for r in urls.scores(rows, ratios).collect()}
    p, grams = plain_models(seqs)
    unseen = 0
    for k, s in enumerate(asked):
        each = [log(p(True, s[max(0, i - urls.DEPTH) : i + 1])) - log(p(False, s[max(0, i - urls.DEPTH) : i + 1])) for i in range(len(s))]
        unseen += any(s[max(0, i - urls.DEPTH) : i + 1] not in grams for i in range(len(s)))
        if k in got or any(c in grams for c in s):
            assert abs(got[k] - sum(each) / len(s)) < 1e-9, s
        else:  # no gram of it is known: no row
            assert abs(ratios.where("gram = ''").first()["v"] - sum(each) / len(s)) < 1e-9
    assert unseen > 20


def test_ties_at_the_threshold(spark):
    """Rows of one score get one verdict, on either side of the cut; the cut lies between kinds that part."""
    scored = spark.createDataFrame([(True, 0.5)] * 5 + [(False, -0.5)] * 5, "accepted boolean, score double")
    assert -0.5 < urls.threshold(scored).first()["cut"] <= 0.5
    level = spark.createDataFrame([(True, 0.25)] * 3 + [(False, 0.25)] * 3, "accepted boolean, score double")
    assert urls.threshold(level).first()["cut"] == 0.25
    assert urls.threshold(level.where("accepted")).first()["cut"] == 0.0


def test_models_tell_digits_apart(spark):
    """Of one host, /en/1... is blocked and /en/2... allowed by rule: the same paths elsewhere follow them."""
    rnd = random.Random(4)
    rows = [f"http://example.org/en/{first}{rnd.randint(100, 999)}" for first in "12" for _ in range(150)]
    judged = [f"http://example.net/en/{first}{rnd.randint(100, 999)}" for first in "12" for _ in range(50)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(rows + judged)], "page_id int, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, URL_RULES).collect()}
    right = [got[len(rows) + k] == ("block" if k < 50 else "allow") for k in range(100)]
    assert sum(right) > 95


def test_long_repeated_and_clashing_rows(spark):
    """A url of 50,000 characters, one url of a third of all rows, equal rows, columns named like the result's."""
    rows = [(1, "http://a.org/" + "x/" * 25_000, "r", "v")] + [(2, "http://b.net/same", "r", "v")] * 40 + [(3, "http://c.com/fr/x", "r", "v"), (4, "http://c.com/de/x", "r", "v"), (None, None, "r", "v")]
    pages = spark.createDataFrame(rows, "page_id int, url string, rule string, verdict string")
    got = urls.filter_urls(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], set()).add((r["rule"], r["verdict"]))
    assert by[1] == {("org/", "allow")} and by[3] == {("com/fr/", "allow")} and by[4] == {("com/de/", "block")} and len(by[2]) == 1
