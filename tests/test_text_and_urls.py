import unicodedata

import pytest
from pyspark.sql import functions as F

from gradecut.functions import text, urls

CEDILLA, COMMA = "ŞşŢţ", "ȘșȚț"


@pytest.mark.parametrize(
    "raw, fixed",
    [
        (CEDILLA, COMMA),
        ("șţŞȚ", "șțȘȚ"),
        ("ă î", "ă î"),
        ("ăâî", "ăâî"),
        ("plain", "plain"),
    ],
)
def test_diacritics(one, raw, fixed):
    assert one(text.fix_diacritics(F.lit(raw))) == fixed
    assert one(text.fix_diacritics(F.lit(fixed))) == fixed
    assert unicodedata.is_normalized("NFC", fixed)


def test_cleanup(one):
    raw = "  Colegiul​  Şaguna­\t\n x y ﻿"
    assert one(text.normalize_text(F.lit(raw))) == "Colegiul Șaguna x y"


@pytest.mark.parametrize("haystack, needle, hit", [("Științe ale naturii", "stiinte", True), ("ŞAGUNA", "saguna", True), ("Filologie", "mate", False), ("x", "  ", True)])
def test_search(one, haystack, needle, hit):
    assert one(text.matches_search(F.lit(haystack), needle)) is hit


@pytest.mark.parametrize(
    "label, track", [("Teoretică", "teoretica"), ("TEHNOLOGICĂ ", "tehnologica"), ("Vocaţională", "vocationala"), ("vocațională", "vocationala"), ("alta", None)]
)
def test_tracks(one, label, track):
    assert one(text.track_of(F.lit(label))) == track


def test_romanian_order(spark):
    names = ["Țaga", "Sz", "Az", "Șa", "Tz", "Ăla"]
    df = spark.createDataFrame([(n,) for n in names], "name string").orderBy(text.ro_order(F.col("name")))
    assert [r["name"] for r in df.collect()] == ["Az", "Ăla", "Sz", "Șa", "Tz", "Țaga"]


BASE = "https://a.example.com/x/y/z.html?q=1"


@pytest.mark.parametrize(
    "href, url",
    [
        ("https://b.org/p", "https://b.org/p"),
        ("HTTPS://B.org", "https://b.org/"),
        ("http://b.org:80/p", "http://b.org/p"),
        ("//b.org/p?x=1#f", "https://b.org/p?x=1#f"),
        ("/root", "https://a.example.com/root"),
        ("rel.html", "https://a.example.com/x/y/rel.html"),
        ("../up.html", "https://a.example.com/x/up.html"),
        ("../../../up", "https://a.example.com/up"),
        ("./", "https://a.example.com/x/y/"),
        ("..", "https://a.example.com/x/"),
        ("?p=2", "https://a.example.com/x/y/z.html?p=2"),
        ("", "https://a.example.com/x/y/z.html?q=1"),
        ("/für all", "https://a.example.com/f%C3%BCr%20all"),
        ("a%20b", "https://a.example.com/x/y/a%20b"),
        ("https:rel", "https://a.example.com/x/y/rel"),
        ("http:other.org/p", "http://other.org/p"),
        (" \\back\\slash ", "https://a.example.com/back/slash"),
        ("mailto:x@y", None),
        ("ftp://b.org/p", None),
    ],
)
def test_resolution(one, href, url):
    assert one(urls.resolve_url(F.lit(href), F.lit(BASE))) == url


def test_directories(one):
    assert one(urls.directory_of(F.lit("https://h.ro/a/b.html?x/y"))) == "https://h.ro/a/"
    assert one(urls.directory_of(F.lit("https://h.ro/a/"))) == "https://h.ro/a/"
    assert one(urls.directory_of(F.lit("https://h.ro"))) == "https://h.ro/"
    under = lambda u, p: one(urls.under_directory(F.lit(u), F.lit(p)))
    assert under("https://h.ro/a/c.html", "https://h.ro/a/b.html")
    assert not under("https://h.ro/a/b.html", "https://h.ro/a/b.html")
    assert not under("https://h.ro/c.html", "https://h.ro/a/b.html")


@pytest.mark.parametrize(
    "a, b, same",
    [("static.edu.ro", "edu.ro", True), ("edu.ro", "static.edu.ro", True), ("www.edu.ro", "static.edu.ro", False), ("EDU.ro", "edu.ro", True), ("xedu.ro", "edu.ro", False)],
)
def test_same_site(one, a, b, same):
    assert one(urls.same_site(F.lit(a), F.lit(b))) is same


def test_link_heuristics(one):
    year = lambda u, t, y: one(urls.looks_like_year(F.lit(u), F.lit(t), F.lit(y)))
    assert year("https://h.ro/2024/", "", 2024)
    assert not year("https://h.ro/20245/", "", 2024)
    county = lambda u, t, c: one(urls.looks_like_county(F.lit(u), F.lit(t), F.lit(c)))
    assert county("https://h.ro/sb/", "", "SB")
    assert county("https://h.ro/x/", "județul SIBIU", "SB")
    assert not county("https://h.ro/sba/", "Alba", "SB")


@pytest.mark.parametrize(
    "url, name",
    [
        ("https://h.ro/", "sb-2024-index"),
        ("https://h.ro/a/Lista.HTML?p=2&q=x", "sb-2024-lista-p-2-q-x"),
        ("https://h.ro/" + "a" * 60, "sb-2024-" + "a" * 48),
    ],
)
def test_names(one, url, name):
    assert one(urls.staged_name(F.lit("SB"), F.lit(2024), F.lit(url))) == name
