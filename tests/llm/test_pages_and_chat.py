"""Main text, url verdicts, chat examples and top-k: edge cases, brute force, reference SQL."""

import hashlib
import html
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradecut.llm import chat, mainpage, reputation, topk
from gradecut.llm.common import read_table
from gradecut.llm.queries import ODD_TEXT, ORACLES, QUERIES, op3_mainpage

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_reference_sql(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "pages", "labels", "embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = QUERIES[name](spark, SMALL)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(found.fetchall(), key=str)


# ---- main text


def plain_article(page):
    inside = page.split("<article>")[1].split("</article>")[0]
    blocks = [re.sub(r"<[^>]*(>|$)", "", re.sub("<br>", " ", b)) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def test_articles_of_all_pages(spark):
    rows = op3_mainpage(spark, SMALL).join(read_table(spark, SMALL, "pages").select("page_id", "html"), "page_id").collect()
    assert len(rows) == 250
    assert all(r["text"] == plain_article(r["html"]) and r["n_chars"] == len(r["text"]) for r in rows)


BODY = " ".join(f"word{i}" for i in range(40))
PAGE = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header>Site name</header>
<nav><a href=/a>one</a><a href=/b>two</a></nav><div id="content"><h1>A title</h1><p>{BODY} &lt;b&gt; &amp; caf&eacute;<br>next
<div class="ad">buy now</div><form><input><button>send</button></form><script>if (a < b) x("</p>")</script>
<p>{BODY}</div><div class="comments"><p>{BODY} nonsense</p></div><footer>end &copy;</footer></body></html>"""


def test_page_without_article_element():
    text = mainpage.extract(PAGE, mainpage.Weights({}, {}))
    assert text == f"A title\n\n{BODY} <b> & café next\n\n{BODY}"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- ", "<script>x", "<a href='", "</p></div>", "&am"])
def test_broken_pages(page):
    assert isinstance(mainpage.extract(page, mainpage.Weights({}, {})), str)


def test_best_region_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores = rng.integers(-5, 5, rng.integers(0, 12)).tolist()
        start, end = mainpage.best_region(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[start:end]) == max([0, *sums])


def test_page_edges(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "u", "", "x"), (3, "u", "<p>a " * 30_000, "x")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    found = mainpage.extract_pages(pages).collect()
    assert len(found) == 5 and all(len(r["text"]) == r["n_chars"] for r in found)
    assert {r["text"] for r in found if r["page_id"] in (None, 2)} == {""}
    assert mainpage.extract_pages(pages.limit(0)).count() == 0


# ---- url verdicts


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [
        r for r in reputation.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)
    return best and best.name, best and best.verdict


URLS = [
    None, "", "no scheme/here", "http://", "http://NET/", "http://net", "http://a.Example.NET/en/1?x#y", "https://example.net/de/1",
    "http://notexample.net/en/2", "x://u.example.com/de/", "x://u.example.com/de", "a://b.org/fr/://c", "http://b.org?/fr/", "http://É.org#/fr/",
    "http://a.co.uk/7", "http://b.a.co.uk/8", "http://[::1]/9", "http://a.example.net/en/1\n2",
]


def test_url_parts_rules_and_edges(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS)], "page_id int, url string, host string, rule string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, None), (8, None, None), (None, 1, 1)], "doc_id int, quality int, toxic int")
    rows = reputation.judge(pages, labels).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = parts_of((URLS + URLS)[r["page_id"]])
        name, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] == (verdict or ("allow" if r["good_bound"] >= 0.6 else "block"))
    assert reputation.judge(pages, labels.limit(0)).filter("good_rate <> 0.5").count() == 0
    assert reputation.judge(pages.limit(0), labels).count() == 0


def test_reputation_shrinks_towards_domain(spark):
    outcomes = [("a.x.org", 1)] * 90 + [("a.x.org", 0)] * 10 + [("b.x.org", 1)] + [("c.y.org", 0)] * 50
    hosts = [("a.x.org",), ("b.x.org",), ("new.x.org",), ("c.y.org",), ("new.z.org",), ("else.com",)]
    found = reputation.reputations(spark.createDataFrame(hosts, "host string"), spark.createDataFrame(outcomes, "host string, good int"))
    rate = {r["host"]: r["good_rate"] for r in found.collect()}
    bound = {r["host"]: r["good_bound"] for r in found.collect()}
    assert rate["c.y.org"] < rate["new.z.org"] < rate["new.x.org"] <= rate["b.x.org"]
    assert bound["new.x.org"] < bound["a.x.org"] < rate["a.x.org"]
    assert abs(rate["else.com"] - (91.5 / 152)) < 1e-9


# ---- chat


def plain_digest(turns):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    trained = "".join(t or "" for r, t in turns if r == "assistant")
    return (
        len(turns),
        sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)),
        len(trained),
        sha(trained),
    )


NASTY = [ODD_TEXT, "", None, "\\", "\\\\ ", " </turn>\n### user </role>\n", "a\nb # <x> \\#", "\U0001f600é" * 3, " </turn>", "#" * 5]


def test_chat_reads_back(spark):
    rows, want = [], {}
    for conv, roles in enumerate((["user", "assistant"] * 5, ["assistant"] * 4, ["user"] * 3, ["system", None, "we <ird>\n </role>\n", "assistant"])):
        turns = [(r, NASTY[(conv + i) % len(NASTY)]) for i, r in enumerate(roles)]
        rows += [(conv, i, r, t, "x") for i, (r, t) in enumerate(turns)]
        want[conv] = plain_digest(turns)
    made = chat.examples(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, formatted string"))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digest(made).collect()}
    assert got == want
    assert made.filter("conv_id = 0").count() == 5 and made.filter("conv_id = 2").count() == 1
    for r in made.collect():
        assert r["loss_start"] <= r["loss_stop"] <= len(r["formatted"])
    odd = spark.createDataFrame([(None, None, None, None), (None, None, "user", "b"), (None, 1, "assistant", "a"), (None, 1, "assistant", "a")],
                                "conv_id int, turn int, role string, text string")
    row = chat.digest(chat.examples(odd)).first()
    assert (row["n_turns"], row["loss_chars"]) == (4, 2)
    assert chat.examples(odd.limit(0)).count() == 0


def test_chat_is_native(spark):
    plan = QUERIES["op5_chat"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- top k


def brute_top(ids, rows, k, every):
    out = []
    for q in range(len(ids)):
        if ids[q] % every == 0:
            others = sorted((-int(rows[q] @ rows[j]), int(ids[j])) for j in range(len(ids)) if j != q)[:k]
            out += [(int(ids[q]), n, v, -s) for n, (s, v) in enumerate(others, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,d,hot", [(3, 4, 0), (300, 8, 0), (1000, 16, 400), (1500, 64, 500)])
def test_block_equals_brute_force(n, d, hot):
    rng = np.random.default_rng(n)
    rows = np.floor(rng.normal(0, 8, (n, d))).astype(np.int64)
    rows[:hot] = rows[0]
    ids = rng.permutation(2 * n)[:n]
    asked = ids % 7 == 0
    found = topk.best_of_block(rows[asked], ids[asked], rows, ids, 20)
    ranked = {}
    got = []
    for q, v, s in zip(*found, strict=True):
        ranked[q] = ranked.get(q, 0) + 1
        got.append((int(q), ranked[q], int(v), int(s)))
    assert sorted(got) == brute_top(ids, rows, 20, 7)


def test_lists_are_read_from_both_ends():
    rows = np.array([[3.0], [1.0], [2.0], [5.0]])
    lists = topk.SortedLists(rows)
    lists.read(1)
    assert lists.from_top[0].ravel().tolist() == [1, 1, 1, 5] and lists.from_top[1].ravel().tolist() == [5, 5, 5, 5]
    assert lists.from_bottom[0].ravel().tolist() == [1, 1, 1, 1] and lists.from_bottom[1].ravel().tolist() == [5, 1, 5, 5]
    lists.read(2)
    assert lists.from_top[1].ravel().tolist() == [3, 3, 3, 5] and lists.from_bottom[0].ravel().tolist() == [2, 1, 2, 2]


def test_top_k_through_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "MERGE", 4)
    rng = np.random.default_rng(9)
    rows = rng.normal(0, 0.2, (70, 5)).round(2)
    rows[:25] = rows[0]
    table = [(i, r.tolist(), "x") for i, r in enumerate(rows)]
    odd = [(80, None, "x"), (None, rows[1].tolist(), "x"), (81, [1.0, None], "x"), (82, [float("nan")], "x"), (83, [float("inf")], "x"), (5, rows[5].tolist(), "x")]
    df = spark.createDataFrame(table + odd, "vec_id bigint, embedding array<double>, score string")
    got = sorted(tuple(r) for r in topk.search(df, 20).collect())
    assert got == brute_top(np.arange(70), np.floor(64.0 * rows).astype(np.int64), 20, 20)
    assert topk.search(df.limit(0)).count() == 0
    uneven = spark.createDataFrame([(0, [1.0]), (1, []), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in topk.search(uneven).collect()) == [(0, 1, 2, 4096), (0, 2, 1, 0)]


def test_embeddings_take_no_part_when_null(spark):
    df = spark.createDataFrame([(1, [0.5, -0.01])], "vec_id bigint, embedding array<float>")
    assert df.select(topk.quantized(F.col("embedding"))).first()[0] == [32, -1]
