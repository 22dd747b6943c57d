import pytest
from pyspark.sql import functions as F

from gradecut.operators import links

ROOT = "https://portal.ro/"


def pages(spark, store):
    return spark.createDataFrame(list(store.items()), "url string, html string")


def test_extraction(spark):
    html = """<article><a class=x href="/2024/">Anul&nbsp; <b>2024</b></a>
      <A HREF='rel.html#part'>one</A><a href=rel.html>two</a><a href="#top">t</a><a href="JavaScript:x()">j</a>
      <a href="mailto:a@b">m</a><a href="https://static.portal.ro/x">sub</a><a href="https://other.ro/x">far</a>
      <a name="none">n</a><a href="../up?q=1#f">up</a><a href="">empty</a>"""
    found = links.extract_links(pages(spark, {"https://portal.ro/a/b.html": html})).collect()
    got = {r["url"]: (r["text"], r["position"]) for r in found}
    assert got == {
        "https://portal.ro/2024/": ("Anul 2024", 0),
        "https://portal.ro/a/rel.html": ("one", 1),
        "https://static.portal.ro/x": ("sub", 6),
        "https://portal.ro/up?q=1": ("up", 8),
    }


def site(n=40):
    store = {
        ROOT: '<a href="/2024/">Arhiva 2024</a><a href="/2023/">2023</a><a href="/about">x</a>',
        ROOT + "2024/": '<a href="sb/0.html">Sibiu</a><a href="/2024/bv/0.html">Brasov</a>',
    }
    for i in range(n):
        kids = "".join(f'<a href="{k}.html">k</a>' for k in (2 * i + 1, 2 * i + 2) if k < n)
        store[f"{ROOT}2024/sb/{i}.html"] = kids + '<a href="../bv/0.html">other</a><a href="0.html">back</a>'
    store[ROOT + "2024/bv/0.html"] = '<a href="deep/1.html">d</a>'
    store[ROOT + "2024/bv/deep/1.html"] = '<a href="../0.html">up</a><a href="/2024/bv/2.html">side</a>'
    store[ROOT + "2024/bv/2.html"] = ""
    return store


def crawls(spark):
    return spark.createDataFrame(
        [(1, ROOT, 2024, "SB"), (2, ROOT, 2024, "BV"), (3, ROOT, 1999, "SB")], "crawl int, seed string, year int, county string"
    )


def walk(store, start, cap):
    """Plain breadth-first reading order."""
    import re
    from urllib.parse import urljoin

    seen, queue = [start], [start]
    while queue and len(seen) < cap:
        parent = queue.pop(0)
        for href in re.findall(r'href="([^"]*)"', store[parent]):
            url = urljoin(parent, href)
            if len(seen) >= cap:
                break
            if url in seen or url == parent or not url.startswith(parent.rsplit("/", 1)[0] + "/") or url not in store:
                continue
            seen.append(url)
            queue.append(url)
    return seen


def test_discovery_and_descent(spark):
    store = site()
    df = pages(spark, store)
    found = links.extract_links(df).cache()
    started = links.discover(found, crawls(spark))
    assert {(r["crawl"], r["url"]) for r in started.collect()} == {
        (1, ROOT + "2024/sb/0.html"), (2, ROOT + "2024/bv/0.html"),
    }
    failed = links.discovery_failures(found, crawls(spark), started).collect()
    assert [r["crawl"] for r in failed] == [3] and len(failed[0]["links_seen"]) == 3
    starts = started.select("crawl", "url", F.col("position").alias("place"))
    for cap in (1, 2, 3, 10, 200):
        reached = links.descend(found, starts, max_pages=cap, pages=df)
        rows = sorted(reached.collect(), key=lambda r: (r["crawl"], r["depth"], r["place"]))
        for crawl, start in ((1, "sb"), (2, "bv")):
            mine = [r["url"] for r in rows if r["crawl"] == crawl]
            assert mine == walk(store, f"{ROOT}2024/{start}/0.html", cap)
            whole = walk(store, f"{ROOT}2024/{start}/0.html", 1000)
            assert {r["truncated"] for r in rows if r["crawl"] == crawl} == {len(whole) > cap}
    free = links.descend(found, starts, max_pages=None, pages=df)
    assert free.filter("crawl = 1").count() == 40 and free.filter("truncated").count() == 0
    parts = links.page_record(free, crawls(spark), F.lit("now"), per_part=7).filter("county = 'SB'").orderBy("part").collect()
    assert [len(r["pages"]) for r in parts] == [7, 7, 7, 7, 7, 5]
    assert [u for r in parts for u in r["pages"]] == walk(store, ROOT + "2024/sb/0.html", 1000)
    with pytest.raises(ValueError, match="nothing discovered for"):
        links.assert_discovered(links.discovery_failures(found, crawls(spark), started))
    records = links.page_record(free, crawls(spark), F.lit("now")).collect()
    assert {r["county"]: len(r["pages"]) for r in records} == {"SB": 40, "BV": 2}


def test_scope(spark):
    df = pages(spark, site(3))
    records = spark.createDataFrame([(2024, "SB", [ROOT])], "year int, county string, pages array<string>")
    assert links.scope_pages(df, records, 2024, "sb").count() == 1
    assert links.scope_pages(df, records, 2025, "sb").count() == df.count()


def test_staging(spark):
    rows = [("https://h.ro/a/list.html", 2024, "SB", 900, 0), ("https://h.ro/b/list.html", 2024, "SB", 800, 1),
            ("https://h.ro/c/done.html", 2024, "SB", 700, 2), ("https://h.ro/d/used.html", 2024, "SB", 600, 3)]
    picks = spark.createDataFrame(rows, "url string, year int, county string, bytes long, pick_rank int")
    staged = spark.createDataFrame(
        [("https://h.ro/c/done.html", "kept.html"), ("https://gone.ro/", "sb-2024-used.html")], "url string, file string"
    )
    files = {r["url"]: r["file"] for r in links.stage_names(picks, staged).collect()}
    assert files["https://h.ro/a/list.html"] == "sb-2024-list.html"
    assert files["https://h.ro/b/list.html"].startswith("sb-2024-list-") and len(files["https://h.ro/b/list.html"]) == 24
    assert files["https://h.ro/c/done.html"] == "kept.html"
    assert files["https://h.ro/d/used.html"].startswith("sb-2024-used-")


def test_staged_names_do_not_collide(spark):
    many = [(f"https://h.ro/{i}/", 2024, "SB", i) for i in range(20_000)]  # six digits clash about a dozen times
    picks = spark.createDataFrame(many, "url string, year int, county string, pick_rank int")
    files = [r["file"] for r in links.stage_names(picks).collect()]
    assert len(files) == len(set(files)) == 20_000
    short = {r["url"]: r["file"] for r in links.stage_names(picks.limit(50)).collect()}
    url = "https://h.ro/7/"
    staged = spark.createDataFrame([("https://gone.ro/", short[url])], "url string, file string")
    again = {r["url"]: r["file"] for r in links.stage_names(picks.limit(50), staged).collect()}
    assert again[url] != short[url] and again[url].startswith(short[url][:-5])


def test_pages_are_deduplicated_by_canonical_address(spark):
    df = spark.createDataFrame([("HTTP://h.ro",), ("http://h.ro/",), ("http://h.ro:80/",), ("http://h.ro/x",)], "url string")
    assert links.dedupe_pages(df).count() == 2


def test_summary(spark):
    rows = [(2024, 10, 3, None), (2025, None, None, "failed")]
    results = spark.createDataFrame(rows, "year int, pages int, new_files int, error string")
    summary = links.harvest_summary(results)
    links.assert_harvest(summary)
    try:
        links.assert_harvest(summary.filter("year = 2025"))
    except ValueError as error:
        assert "every year failed" in str(error)
    else:
        raise AssertionError("expected a failure")


def test_whole_summary_holds_every_page(spark):
    from gradecut.plans import workloads

    sf = "/root/testdata/sf0.01"
    row = workloads.harvest_summary_whole(spark, sf).first()
    assert (row["pages"], row["stopped"], row["crawls"]) == (workloads.descend(spark, sf).count(), 0, 5)
    assert row["pages"] > 5 * workloads.CAPPED


def test_first_fetched_page_stays(spark):
    rows = [("https://h.ro/a#x", 3, "late"), ("https://h.ro/a", 1, "first"), ("https://h.ro/a", 2, "then"), ("https://h.ro/b", None, "b")]
    df = spark.createDataFrame(rows, "url string, fetched_at int, html string").withColumn("url", F.regexp_replace("url", "#.*", ""))
    assert {r["html"] for r in links.dedupe_pages(df).collect()} == {"first", "b"}


def test_county_names_are_words(spark, one):
    from gradecut.functions import urls

    said = lambda text, code: one(urls.looks_like_county(F.lit("https://h.ro/p"), F.lit(text), F.lit(code)))
    assert said("Rezultate Brasov 2024", "BV") and said("rezultate BRAȘOV", "BV") and said("Caras Severin", "CS")
    assert not said("revolta", "OT") and said("Jud. Olt", "OT") and said("lista-ot", "OT")


def test_anchor_attributes(spark):
    html = (
        '<a data-href="/no" href="/one">1</a><a title="a > b" href=\'/two\'>2</a><a title="href=/no" HREF=/three class=x>3</a>'
        '<a name="top">none</a><abbr href="/no">x</abbr><a href="">empty</a><a href="mailto:x@y.ro">m</a><a\nhref = "/four" >4<b>!</b></a >'
    )
    df = spark.createDataFrame([("https://h.ro/", html)], "url string, html string")
    got = sorted((r["position"], r["url"], r["text"]) for r in links.extract_links(df).collect())
    assert [(u, t) for _, u, t in got] == [
        ("https://h.ro/one", "1"), ("https://h.ro/two", "2"), ("https://h.ro/three", "3"), ("https://h.ro/four", "4 !"),
    ]
