from __future__ import annotations

import math

from plazametrics.llm import url_filter as U
from plazametrics.llm.queries import URL_RULES


def by_force(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "https://example.net/EN/", "http://net", "http://net/", "ftp://x.org/fr/a://b", "http://xorg/fr/", "://", "http://a.b?c/d", "http://example.com/de/#q", "http://www.casino-win.example.com/en/1", "http://\nx.net/\n/a", "http://É.NET/"]
    pages = [(i, u, "the casino win", "r") for i, u in enumerate(urls)] + [(3, urls[3], None, "s")]
    pages = spark.createDataFrame(pages + [(100 + i, f"http://casino{i}.example.com/en/{i}", None, "t") for i in range(30)], "page_id long, url string, html string, rule string")
    rows = U.judged(pages, URL_RULES).collect()
    assert len(rows) == len(urls) + 31
    for r in rows:
        if r.page_id >= 100:
            continue
        host, path, rule, verdict = by_force(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert {r.verdict for r in rows if r.page_id == 12} == {"block"}
    assert U.judged(pages.limit(0), URL_RULES).count() == 0


def test_segmentation_splits_concatenated_names(spark):
    known = {w: math.log(n / 100) for w, n in {"free": 20, "casino": 10, "news": 30, "ca": 2, "sino": 1}.items()}
    assert U.segmented("freecasinonews", known, -2.5) == ["free", "casino", "news"]
    assert U.segmented("zzqx", known, -2.5) == ["zzqx"] and U.segmented("x" * 60, known, -2.5) == ["x" * 60]
    assert U.segmented("canews", known, -2.5) == ["canews"] and U.segmented("ca", known, -2.5) == ["ca"]
    assert U.segmented("casino777", known, -2.5) == ["casino", "777"] and U.segmented("newsx", known, -2.5) == ["newsx"]
    pages = spark.createDataFrame([(i, f"http://{h}.org/", "free casino news free news") for i, h in enumerate(["freecasinonews", "x" * 70, "free"])], "page_id long, url string, html string")
    words = {r.host: r.host_words for r in U.judged(pages, URL_RULES).collect()}
    assert words["freecasinonews.org"] == ["free", "casino", "news", "org"]


def test_a_page_that_names_its_own_host(spark):
    html = """<!-- cheappills --><title>News</title><script>cheappills = "</p>";</script><a title="a > cheappills" href="http://cheappills.net/en/1">Cheap pills, pills</a>
    <p>cheap news of casinowin.org. See https://cheappills.net/en/1?x=cheappills and cheappills.net: casino win, win"""
    pages = spark.createDataFrame([(i, f"http://{h}/en/{i}", html) for i, h in enumerate(["cheappills.net", "casinowin.org"])], "page_id long, url string, html string")
    assert {r.word for r in U.word_counts(pages, "html").collect()} == {"news", "cheap", "pills", "of", "see", "and", "casino", "win"}
    rows = {r.host: r for r in U.judged(pages, [U.Rule("no.rule/", "allow")]).collect()}
    assert rows["cheappills.net"].host_words == ["cheap", "pills", "net"] and rows["casinowin.org"].host_words == ["casino", "win", "org"]


def test_scores_equal_plain_bayes_over_many_words(spark):
    import collections

    # So many words that hundreds of them would share cells of a hashed table of 2**18.
    draw = lambda i, k: "".join(chr(97 + (i * 7919 + k * 104729) // 26**j % 26) for j in range(5))
    many = [[draw(i, k) for k in range(60)] for i in range(300)]
    paths = [["casino", "win"], ["win", "news"], ["news"], [], *many]
    pages = spark.createDataFrame([(i, "://" + "/" + "/".join(p), None) for i, p in enumerate(paths)], "page_id long, url string, html string")
    got = {r.page_id: r.score for r in U.judged(pages, [U.Rule("no.rule/", "allow")]).collect()}
    n = {"block": collections.Counter(dict.fromkeys(U.SEEDS, U.SEED_WEIGHT)), "allow": collections.Counter()}
    prior = collections.Counter()
    for p in paths:
        verdict = "block" if set(p) & set(U.SEEDS) else "allow"
        prior[verdict] += 1
        n[verdict].update("/" + w for w in p)
    used = len(n["block"].keys() | n["allow"].keys()) + 1
    rate = lambda v, w: math.log((n[v]["/" + w] + 1) / (sum(n[v].values()) + used))
    for i, p in enumerate(paths):
        want = math.log((prior["block"] + 1) / (prior["allow"] + 1)) + sum(rate("block", w) - rate("allow", w) for w in p)
        assert math.isclose(got[i], want, abs_tol=1e-6), i


def test_given_pages(spark):
    """Names of the given pages and names made of their words."""
    folder = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    common = [r.word for r in U.word_counts(pages, "html").where("length(word) >= 5").orderBy("n", ascending=False).limit(14).collect()]
    made = [a + b for a, b in zip(common[:7], common[7:])]
    more = spark.createDataFrame([(10**6 + i, f"https://{h}.example.com/en/1", "") for i, h in enumerate(made + ["x" * 40])], "page_id long, url string, html string")
    rows = U.judged(pages.union(more), URL_RULES).collect()
    words = {r.host: r.host_words for r in rows}
    assert words["x" * 40 + ".example.com"] == ["x" * 40, "example", "com"]
    assert sum(words[f"{a + b}.example.com"] == [a, b, "example", "com"] for a, b in zip(common[:7], common[7:])) >= 5
    assert all("example" in w and "amp" not in w for h, w in words.items() if ".example." in h)
    # What is left are words: some texts end within an entity.
    assert all(r.n < 50 for r in U.word_counts(pages, "html").where("word = 'amp'").collect())
    unwanted = [r for r in rows if r.rule is None and any(x in r.host for x in ("casino-win", "free-bets", "spam-farm", "ads-track", "cheap-pills"))]
    assert len(unwanted) > 90 and {r.verdict for r in unwanted} == {"block"}
    wanted = [r for r in rows if r.rule is None and not set(r.host_words) & set(U.SEEDS)]
    assert sum(r.verdict == "allow" for r in wanted) >= 0.95 * len(wanted)
