import random
import re
import time
from collections import Counter
from itertools import combinations

from corpusloom.llm import url_rules as ur
from corpusloom.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def by_rule(url):
    host, path = split(url)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def urls(n=900):
    pick = random.Random(2)
    out = [
        f"{pick.choice(['http', 'https'])}://{pick.choice(['www.', 'm.', ''])}{pick.choice('abcde')}.example.{pick.choice(['org', 'com', 'net'])}/"
        f"{pick.choice(['en', 'es', 'fr', 'de'])}/{pick.randrange(2000)}{pick.choice(['', '/', '.html', '#top', '?page=2&ref=x'])}" for _ in range(n)
    ]
    return out + [None, "", "nothing", "HTTP://WWW.Example.ORG/es/x", "http://a.org", "http://org/", "http://xorg/", "x://y.org?/", "://", "http://A.com/FR/", "http://a.com/fr/" + "q" * 100_000, out[0], out[0]]


def test_given_rules(spark):
    rows = [(None if k == 3 else k, u, "clash") for k, u in enumerate(urls())]
    pages = spark.createDataFrame(rows, "page_id long, url string, token string")
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, rule_verdict string")
    got = ur.judge(pages, rules).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, u, _ in rows:
        r, (rule, verdict) = by_id[i], by_rule(u)
        assert (r.host, r.path, r.rule) == (*split(u), rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block") and (rule is None or r.confidence is None)
    # what is left is decided as the covered pages were: /es/ is blocked there, plain hosts are not
    rest = [by_id[i] for i, u, _ in rows if u and by_rule(u)[0] is None and ".net/es/" in u]
    assert rest and all(r.verdict == "block" and r.confidence >= 0.8 for r in rest)
    assert ur.judge(pages.limit(0), rules).count() == 0


def tokens_of_all(spark, urls):
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", ur.url_tokens("url").alias("t")).collect()
    return {r.url: set(r.t) for r in rows}


def tokens_of(spark, url):
    return tokens_of_all(spark, [url])[url]


def test_tokens(spark):
    assert tokens_of(spark, "https://u@WWW.a-b.org:80/En/12/x_y.html?p=1&q=2#t") == {
        "scheme=https", "host=www", "host=a-b", "host=org", "top=org", "path=en", "path=x_y", "path=html", "end=html", "query=p", "query=q", "mark=#"}
    assert tokens_of(spark, None) == set()


def test_mined_rules_by_counting(spark):
    pick = random.Random(5)
    labelled = [(u, "block" if "/de/" in u and pick.random() < 0.95 else "allow") for u in urls(600) if u and "://" in u and len(u) < 1000]
    df = spark.createDataFrame(labelled, "url string, verdict string")
    rules = ur.mine(df, support=0.05, confidence=0.9).rules.collect()
    tokens = tokens_of_all(spark, [u for u, _ in labelled[:150]])
    baskets = [(tokens[u], v) for u, v in labelled[:150]]
    counted = ur.mine(spark.createDataFrame(labelled[:150], df.schema), support=0.05, confidence=0.9).rules.collect()
    assert rules and counted
    for rule in counted:
        fit = [v for t, v in baskets if set(rule.tokens) <= t]
        assert abs(rule.confidence - fit.count(rule.mined) / len(fit)) < 1e-9 and rule.confidence >= 0.9 and fit.count(rule.mined) >= 0.05 * len(baskets)
    seen = {(tuple(r.tokens), r.mined): r.confidence for r in rules}
    for (tokens, mined), sure in seen.items():
        assert not any(m == mined and set(t) < set(tokens) and c >= sure for (t, m), c in seen.items())
    none = spark.createDataFrame([], "url string, verdict string")
    assert ur.mine(none).rules.count() == 0 and ur.mined_verdicts(df, ur.mine(none)).count() == 0


def plain_rules(baskets, support, confidence):
    """All rules {tokens: (confidence, support, verdict)} by counting every subset of every basket."""
    of_all, of_verdict = Counter(), Counter()
    for tokens, verdict in baskets:
        for k in range(1, len(tokens) + 1):
            for subset in combinations(sorted(tokens), k):
                of_all[subset] += 1
                of_verdict[subset, verdict] += 1
    found = {key: (n / of_all[key[0]], n / len(baskets)) for key, n in of_verdict.items() if n >= support * len(baskets) and n / of_all[key[0]] >= confidence}
    needless = {
        (tokens, v) for (tokens, v), (sure, _) in found.items()
        if any(found.get((fewer, v), (-1,))[0] >= sure for k in range(1, len(tokens)) for fewer in combinations(tokens, k))
    }
    return {key: x for key, x in found.items() if key not in needless}


def test_verdicts_by_counting_all_sets(spark):
    pick = random.Random(8)
    at = lambda: f"{pick.choice(['http', 'https'])}://{pick.choice('ab')}.org/{pick.choice(['x/y', 'x/y', 'x', 'z/w', 'z'])}/{pick.choice(['one/two', 'two', 'q.html'])}"
    labelled = [(at(), pick.choice(["block", "allow", "allow"])) for _ in range(120)]
    labelled = [(u, "block" if "/z" in u and pick.random() < 0.9 else v) for u, v in labelled] + [(u, "allow") for u in ["http://c.org/p-a/p-b/p-c"] * 9]
    asked = sorted({at() for _ in range(60)} | {"http://d.net/p-b", "http://d.net/p-c/p-a/z", "http://d.net/w", "http://nothing"})
    every = tokens_of_all(spark, {u for u, _ in labelled} | set(asked))
    found = plain_rules([(every[u], v) for u, v in labelled], 0.05, 0.8)
    expected = {}
    for u in asked:
        own = every[u]
        fit = [(sure, share, len(tokens), v) for (tokens, v), (sure, share) in found.items() if set(tokens) <= own]
        if fit:
            expected[u] = (max(fit)[3], max(fit)[0])
    mined = ur.mine(spark.createDataFrame(labelled, "url string, verdict string"), support=0.05, confidence=0.8)
    got = ur.mined_verdicts(spark.createDataFrame([(u,) for u in asked + asked + [None]], "url string"), mined).collect()
    assert {r.url: (r.mined, r.confidence) for r in got} == expected and len(got) == len(expected) and {v for v, _ in expected.values()} == {"allow", "block"}
    stands = {r.token: r.stands for r in mined.merged.collect()}
    assert stands["path=p-a"] == stands["path=p-b"] == stands["path=p-c"] != stands["path=x"]
    # each rule stands for those with any of the tokens that go together
    assert {(tuple(sorted({stands[t] for t in tokens})), v) for tokens, v in found} == {(tuple(r.tokens), r.mined) for r in mined.rules.collect()}


def test_many_shared_words(spark):
    shared = "/".join("w" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(30))
    labelled = [(f"http://a.org/{shared}/{k}" if k % 5 == 0 else f"http://a.org/plain/{k}", "block" if k % 5 == 0 else "allow") for k in range(10_000)]
    began = time.time()
    mined = ur.mine(spark.createDataFrame(labelled, "url string, verdict string"))
    found = {(tuple(r.tokens), r.mined): (r.support, r.confidence) for r in mined.rules.collect()}
    assert time.time() - began < 60
    assert found[("path=waa",), "block"] == (0.2, 1.0) and found[("path=plain",), "allow"] == (0.8, 1.0)
    assert all(sure >= 0.8 for _, sure in found.values()) and len(found) < 10
    asked = spark.createDataFrame([("http://b.net/wbc",), ("http://b.net/other",), ("ftp://b.net/other",)], "url string")
    # one shared word is as good as all; `http` alone says allow for 0.8 of the URLs
    assert {(r.url, r.mined, r.confidence) for r in ur.mined_verdicts(asked, mined).collect()} == {("http://b.net/wbc", "block", 1.0), ("http://b.net/other", "allow", 0.8)}
