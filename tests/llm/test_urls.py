from linewarden.llm import urls

PAGES = "page_id long, url string, host string"


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [
        (len(h + p), h + p, v)
        for v, h, p in urls.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits) if fits else (0, None, None)
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "http://a.org", "HTTP://A.ORG/x?y=/z#q", "http://com/x", "http://x.com",
    "http://example.com/en/1", "http://www.example.com/en/1", "http://sub.www.example.com/en/1",
    "http://notexample.com/en/1", "http://a.net/es/2", "http://a.net/es", "http://a.net/fr/x#/es/", "a://b://c/d",
    "http://ÄÖ.net/fr/", "http://a.org?x://b", "http://a.org#/en/", "http://a.org/" + "deep/" * 40,
    "http://a.org/" + "z" * 100_000,
]


def test_rules_equal_brute_force(spark):
    rows = [(i, u, "old") for i, u in enumerate(URLS + URLS)]
    none = spark.createDataFrame([], "url string, bad long")
    got = urls.judge(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS verdict", "2 AS extra"), none)
    assert "extra" in got.columns and got.columns.count("verdict") == 1
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    for i, u, _ in rows:
        host, path, rule, verdict = brute_rule(u)
        assert found[i] == (host, path, rule, verdict or "allow")
    assert urls.judge(spark.createDataFrame([], PAGES), none).count() == 0


def test_templates_merge_and_reject(spark):
    pages, marks = [], []
    for i in range(400):
        pages.append(f"http://h.org/good/{i}")
        pages.append(f"http://h.org/fine/{i}.html")
        pages.append(f"http://h.org/spam/{i}")
        pages.append(f"http://h.org/blog/name{i}/p")
    marks += [(u, int("/spam/" in u or ("/good/" in u and u.endswith("7")))) for u in pages if "/blog/" not in u]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(pages)], PAGES)
    got = urls.judge(df, spark.createDataFrame([*marks, ("http://h.org/x", None)], "url string, bad long"))
    by_url = {r.url: r for r in got.collect()}
    assert len(by_url) == len(pages)
    assert all(r.verdict == ("block" if "/spam/" in u else "allow") for u, r in by_url.items())
    # Names that are too many became one wildcard; unlike branches stay apart.
    assert len({r.template for u, r in by_url.items() if "/blog/" in u}) == 1
    assert by_url["http://h.org/spam/1"].template != by_url["http://h.org/good/1"].template
    alike = urls.judge(df, spark.createDataFrame([(u, i % 5 == 0) for i, u in enumerate(pages)], "url string, bad boolean"))
    templates = {r.template.split("/")[1] for r in alike.collect()}
    assert len(templates) == 1


def judged(spark, marks):
    df = spark.createDataFrame([(i, u, None) for i, (u, _) in enumerate(marks)], PAGES)
    got = urls.judge(df, spark.createDataFrame(marks, "url string, bad long"))
    return {r.url: r for r in got.collect()}


def test_one_bad_section_among_many(spark):
    marks = [(f"http://h.org/s{n}/{i}", int(n == 7)) for n in range(60) for i in range(20)]
    # Names with few labels are one branch, whatever their labels are.
    marks += [(f"http://h.org/rare{n}/p", 0) for n in range(100)]
    got = judged(spark, marks)
    assert all(r.verdict == ("block" if "/s7/" in u else "allow") for u, r in got.items())
    assert len({r.template for u, r in got.items() if "/rare" in u}) == 1
    marks = [(f"http://h.org/s{n}/{i}", int(n != 7)) for n in range(60) for i in range(20)]
    got = judged(spark, marks)
    assert all(r.verdict == ("allow" if "/s7/" in u else "block") for u, r in got.items())


def test_every_segment_counts(spark):
    deep = "http://h.org/" + "/".join("abcdefghij")
    marks = [(f"{deep}/{i}/{kind}/{i}", int(kind == "spam")) for i in range(30) for kind in ("spam", "good")]
    got = judged(spark, marks)
    assert all(r.verdict == ("block" if "/spam/" in u else "allow") for u, r in got.items())
    paths = spark.createDataFrame([("/a/b/c/d/e/f/1/x/2/0123456789abcdef0/3.html/",)], "path string")
    general = paths.select(urls.general_path(paths.path)).first()[0]
    assert general == "a/b/c/d/e/f/*/x/*/*/*/$"


def test_labels_count_once_on_any_level(spark):
    # Twelve labelled pages of one chain, six of them bad; the prior is 0.25.
    paths = [("h.org", "a/b/c/d/$", 12, 6), ("i.org", "a/b/$", 2, 2), ("i.org", "a/c/$", 0, 0)]
    frame = spark.createDataFrame(paths, "host string, general string, labelled long, bad long")
    got = {(r.host, r.general): r.purity for r in urls.grow(frame, 0.25).collect()}
    assert abs(got["h.org", "a/b/c/d/$"] - (6 + 2.5) / 22) < 1e-9
    assert abs(got["i.org", "a/b/$"] - 4.5 / 12) < 1e-9
    # Two bad labels of a path with three levels below a section with others do not block it.
    marks = [(f"http://h.org/en/good/{i}", 0) for i in range(30)]
    marks += [(f"http://h.org/en/{i}/x/y", 1) for i in range(2)]
    assert {r.verdict for r in judged(spark, marks).values()} == {"allow"}
