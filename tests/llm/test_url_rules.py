import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordis.llm import url_rules as ur

PAGES = "page_id long, url string, html string, token string, rare string, held string, label string"
LABELS = "doc_id long, quality int, toxic int, token string, urls string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], LABELS)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [
        (len(h + p), h + p, v) for v, h, p in ur.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://EXAMPLE.org/es/1", "https://www.example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/x", "org/es/",
    "http://example.org", "http://org/", "http://a.com/fr/", "http://a.com/de/9?x=http://b.org/", "http://com/de/", "http://a.com?/de/",
    "http://a.com#/fr/", "://x.com/fr/", "http:///fr/", "http://a.example.org/ES/", "ftp://u@x.org:80/en/1", None, "", "://", "x://y://z.org/es/",
    "http://x.net/\n/de/", "mailto:a@b.org", "http://é.org/", "http://a.COM/de/#x", "http://b.net/" + "long/" * 50_000,
]


def test_given_rules_equal_plain_ones(spark):
    none = ur.mine(ur.labelled_urls(pages_of(spark, []), labels_of(spark, [])))[1]
    rows = ur.judge(pages_of(spark, [(i, u, None) for i, u in enumerate(URLS)]), none).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path = plain_parts(URLS[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), URLS[r.page_id]


def plain_tokens(url):
    plain = re.sub("[0-9]+", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in url))
    host, path = plain_parts(plain)
    scheme = plain.split("://", 1)[0] if "://" in plain else ""
    query = plain.split("#")[0].split("?", 1)[1] if "?" in plain.split("#")[0] else ""
    named = lambda k, ws: {f"{k}:{w}" for w in ws if w}
    return named("s", [scheme]) | named("h", re.split("[.:@]", host)) | named("p", re.split("[/._~-]", path)) | named("q", query.split("&"))


def plain_rules(baskets, share, confidence):
    """Every item set by counting, then the rules that no shorter one makes needless."""
    n = len(baskets)
    counts = {}
    for items, label in baskets:
        for k in range(1, len(items) + 1):
            for part in itertools.combinations(sorted(items), k):
                seen = counts.setdefault(part, {"all": 0})
                seen["all"] += 1
                seen[label] = seen.get(label, 0) + 1
    sure = {
        (part, label): (c / seen["all"], c / n)
        for part, seen in counts.items() for label, c in seen.items()
        if label != "all" and c >= share * n and c / seen["all"] >= confidence
    }
    return {
        key: v for key, v in sure.items()
        if not any(o[1] == key[1] and len(o[0]) < len(key[0]) and set(o[0]) <= set(key[0]) and sure[o][0] >= v[0] for o in sure)
    }


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    pages, labels = [], []
    for i in range(1500):
        host = rng.choice(["shop", "news", "farm", "blog"], p=[0.34, 0.3, 0.2, 0.16])
        lang, tail = rng.choice(["en", "it"]), rng.choice(["", ".html", "?ref=x", "?page=2"])
        pages.append((i, f"http://www.{host}.example.net/{lang}/{rng.integers(1000)}{tail}", "<p>"))
        bad = (host == "farm" and tail == "?ref=x") or (host == "blog" and lang == "it") or rng.random() < 0.03
        if i % 3:
            labels.append((i, int(not bad), 0))
    return pages, labels


def test_mined_rules_equal_plain_ones_and_find_the_planted(spark, corpus):
    pages, labels = corpus
    says = {d: "=allow" if q else "=block" for d, q, _ in labels}
    frame = pages_of(spark, pages)
    rules, index = ur.mine(ur.labelled_urls(frame, labels_of(spark, labels)), support=0.01, least=5, confidence=0.75)
    baskets = [(plain_tokens(u), says[i]) for i, u, _ in pages if i in says]
    held = {}  # tokens of exactly the same urls go by the least name
    for token in set().union(*(b for b, _ in baskets)):
        held.setdefault(frozenset(k for k, (b, _) in enumerate(baskets) if token in b), []).append(token)
    names = {min(ts) for rows, ts in held.items() if len(rows) >= 0.01 * len(baskets)}
    want = plain_rules([(b & names, label) for b, label in baskets], 0.01, 0.75)
    got = {(tuple(r.antecedent), "=" + r.verdict): (r.confidence, r.support) for r in rules.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)

    def judged(url):
        fits = [(-c, -s, -len(p), " ".join([*p, "=>", v]), v[1:]) for (p, v), (c, s) in want.items() if set(p) <= plain_tokens(url)]
        return min(fits)[-1] if fits else "allow"

    urls = {i: u for i, u, _ in pages}
    rows = ur.judge(frame, index).collect()
    assert [r.verdict for r in sorted(rows)] == [judged(urls[r.page_id]) for r in sorted(rows)]
    # Held out: the pages without label.
    planted = lambda u: ("farm" in u and "ref=x" in u) or (".blog." in u and "/it/" in u)
    out = [r for r in rows if r.page_id not in says]
    assert np.mean([(r.verdict == "block") == planted(urls[r.page_id]) for r in out]) > 0.99


def test_a_long_shared_path_is_one_item(spark):
    path = "/".join(f"dir{chr(97 + i)}" for i in range(24))
    pages = [(i, f"http://x.net/{path}/{i}", "") for i in range(60)] + [(i, f"http://y.net/q/{i}", "") for i in range(60, 120)]
    rules, index = ur.mine(
        ur.labelled_urls(pages_of(spark, pages), labels_of(spark, [(i, int(i >= 60), 0) for i in range(120)])), 0.01, 5
    )
    assert rules.count() < 20
    rows = ur.judge(pages_of(spark, [(1, f"http://x.net/{path}/7", ""), (2, "http://y.net/q/7", "")]), index).collect()
    assert {r.page_id: r.verdict for r in rows} == {1: "block", 2: "allow"}


def test_labels_of_odd_rows(spark):
    pages = pages_of(spark, [(1, "http://a.net/", ""), (1, "http://a.net/", ""), (2, "http://b.net/", ""), (3, "c", ""), (4, None, ""), (None, "d", "")])
    labels = labels_of(spark, [(1, 1, 0), (1, None, 1), (2, None, None), (3, None, 0), (4, 1, 0), (None, 0, 1), (9, 0, 0)])
    rows = ur.labelled_urls(pages, labels).collect()
    assert {(r.page_id, r.url, r.label) for r in rows} == {(1, "http://a.net/", "=block"), (3, "c", "=allow")} and len(rows) == 2


def test_no_python_and_empty_tables(spark):
    labels = labels_of(spark, [(1, 0, 1)])
    _, index = ur.mine(ur.labelled_urls(pages_of(spark, []), labels))
    assert ur.judge(pages_of(spark, []), index).count() == 0
    plan = ur.judge(pages_of(spark, [(1, "http://a.net/", "")]).where(F.col("page_id") > 0), index)._jdf.queryExecution().toString()
    assert not re.search("EvalPython|Pandas|InArrow", plan)
