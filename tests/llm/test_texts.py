"""Toxicity, language, licenses, decontamination and pieces: edge cases, brute force, accuracy."""

import itertools
import math
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradecut.llm import decontaminate, language, licenses, pieces, toxicity
from gradecut.llm.common import bounded_sample, read_table
from gradecut.llm.queries import op1_licenses, op2_toxicity, op7_language, op8_decontaminate, op9_pieces
from tests.llm import odd

SMALL, MORE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


def toy_model():
    bags = [[{"good", f"w{i % 7}"}, {"fine"}] for i in range(60)] + [[{"bad", f"w{i % 7}"}, {"fine"}] for i in range(60)]
    return toxicity.fit_bags(bags, [0] * 60 + [1] * 60)


def toy_language():
    en = ["the cat and the dog of the house", "there is that which was with them", "other things that the men thought"]
    de = ["der hund und die katze in dem haus", "das ist ein schönes kleines buch", "nicht jeder mann ging nach hause"]
    return language.fit_texts(en * 4 + de * 4, ["en"] * 12 + ["de"] * 12)


# ---- bounded sample


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(5000).withColumn("g", (F.col("id") % 10 == 0).cast("int"))
    taken = bounded_sample(df, "g", "id", 40)
    assert {r["g"]: r["count"] for r in taken.groupBy("g").count().collect()} == {0: 40, 1: 40}
    assert sorted(taken.collect()) == sorted(bounded_sample(df.repartition(7), "g", "id", 40).collect())
    assert bounded_sample(df.limit(0), "g", "id", 5).count() == 0
    assert bounded_sample(df.limit(3), "g", "id", 50).count() == 3


# ---- toxicity


def test_noisy_or_blames_the_sentence():
    model = toy_model()
    found = toxicity.sentence_scores("Fine good w1. This is bad w2! good fine", model)
    assert [f[:2] for f in found] == [(0, 13), (13, 29), (29, 39)]
    odds = [f[2] for f in found]
    assert odds[1] > 0 and max(odds[0], odds[2]) < odds[1] - 3


def test_toxicity_edges(spark):
    docs = odd.documents(spark)
    rows = toxicity.score_documents(docs, toy_model()).collect()
    assert len(rows) == len(odd.ROWS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by[i]["score"] == 0 and by[i]["spans"] == [] for i in (2, 3, 4))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_documents(docs.limit(0), toy_model()).count() == 0


def test_toxicity_without_labels(spark):
    docs = odd.documents(spark)
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, empty)
    assert model.weights == {} and toxicity.score_documents(docs, model).count() == len(odd.ROWS)
    marks = spark.createDataFrame([(1, None), (None, 1), (5, 1), (5, 0)], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, marks).weights == {}


def test_spans_point_into_the_text():
    model = toxicity.ToxicityModel({"bad": 9.0}, -5.0)
    text = "İİ good. bad İ here."
    start, stop, _ = [s for s in toxicity.sentence_scores(text, model) if s[2] > 0][0]
    assert text[start:stop] == " bad İ here."


def test_toxicity_held_out(spark):
    scored = op2_toxicity(spark, MORE).join(read_table(spark, MORE, "labels"), "doc_id").filter("held_out")
    seen = Counter((r["predicted"], r["toxic"]) for r in scored.select("predicted", "toxic").collect())
    assert seen[1, 1] / (seen[1, 1] + seen[0, 1]) > 0.8
    assert seen[1, 0] / (seen[1, 0] + seen[0, 0]) < 0.01


# ---- language


def test_language_edges(spark):
    docs = odd.documents(spark)
    rows = language.predict(docs, toy_language()).collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["en", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == len(odd.ROWS)
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.fit(docs.limit(0)) is None
    assert language.fit(docs).languages == ["en"]
    kept = language.reject(docs, toy_language())
    assert kept.columns == docs.columns and kept.filter("text is null or text = ''").count() == 0


def test_kernel_is_the_cosine_of_presence_sets():
    model = toy_language()

    def grams(text):
        framed = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in framed:
            framed = framed.replace("  ", " ")
        return {framed[i : i + n] for n in (1, 2, 3) for i in range(len(framed) - n + 1)}

    texts = ["the cat,  and 12 dogs", "nicht das haus", "there"]
    seeds = ["das ist ein schönes kleines buch", "the cat and the dog of the house"]
    rows = language.kernel_rows(texts, model, language.letter_table(model.letters), language.Presence())
    values = rows.round(5).tolist()
    for text, row in zip(texts, values, strict=True):
        for seed in seeds:
            a, b = grams(text), grams(seed)
            assert any(abs(v - len(a & b) / (len(a) * len(b)) ** 0.5) < 1e-4 for v in row)


def test_language_held_out(spark):
    pairs = op7_language(spark, SMALL).filter("held_out").join(read_table(spark, SMALL, "documents"), "doc_id")
    right = [r["lang"] == r["lang_pred"] for r in pairs.filter("lang is not null").collect()]
    assert len(right) > 100 and np.mean(right) > 0.95


# ---- licenses


def brute_licenses(text):
    words, found = licenses.words_of(text), set()
    for t in licenses.make_templates():
        every, n = licenses.shingles_of(words, t.size), t.length
        for k in range(max(0, -(-(len(every) - 2 * n) // n)) + 1):
            window = set(every[k * n : k * n + 2 * n].tolist())
            if len(window & set(t.shingles.tolist())) >= 0.8 * len(t.shingles):
                found.add(t.name)
    return found


def test_licenses_equal_brute_force():
    rng = random.Random(4)
    scanner = licenses.Scanner(licenses.make_templates()).prepare(licenses.TEMPLATES)
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            notice = licenses.words_of(rng.choice(licenses.TEMPLATES)[1])
            parts += [f"a{rng.randint(0, 50)}" for _ in range(rng.randint(0, 60))]
            parts += [w if rng.random() > 0.03 else "zz" for w in notice]
        text = " ".join(parts)
        assert {f[0] for f in scanner.scan(text)} == brute_licenses(text)


def test_licenses_on_all_documents(spark):
    texts = dict(read_table(spark, SMALL, "documents").select("doc_id", "text").collect())
    got = {r["doc_id"]: {f["license"] for f in r["findings"]} for r in op1_licenses(spark, SMALL).collect()}
    assert got == {i: brute_licenses(t) for i, t in texts.items()}


def test_licenses_edges(spark):
    rows = licenses.scan(odd.documents(spark)).collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == len(odd.ROWS) and by[8]["n_findings"] == 1 and by[2]["findings"] == []
    found = by[8]["findings"][0]
    assert (found["license"], found["containment"], found["start"], found["stop"]) == ("MIT line", 1.0, 0, 5)
    short = (("one", "hello"), ("none", "..."), ("two", "hello world"))
    docs = spark.createDataFrame([(1, "well hello"), (2, "hello world")], "doc_id int, text string")
    got = {r["doc_id"]: [f["license"] for f in r["findings"]] for r in licenses.scan(docs, short).collect()}
    assert got == {1: ["one"], 2: ["one", "two"]}


# ---- decontamination


def brute_overlaps(text, items):
    words, out = decontaminate.words_of(text), {}
    for item, other in items:
        own = decontaminate.words_of(other)
        if not own:
            continue
        window, agree = decontaminate.rule(len(own))
        for s, q in itertools.product(range(len(words) - window + 1), range(len(own) - window + 1)):
            same = sum(x == y for x, y in zip(words[s : s + window], own[q : q + window], strict=True))
            if same >= agree and (item not in out or (same, -s) > out[item]):
                out[item] = (same, -s)
    return sorted((item, -s, same) for item, (same, s) in out.items())


def test_masks_are_lossless():
    ones = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    placed = [{o + i for i in m} for m in ones for o in range(decontaminate.WINDOW - m[-1])]
    for wrong in itertools.combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.AGREE):
        assert any(p.isdisjoint(wrong) for p in placed)


def test_overlaps_equal_brute_force():
    rng = random.Random(5)
    names = [f"w{i}" for i in range(8)]
    for _ in range(30):
        items = [(i, " ".join(rng.choices(names, k=rng.choice([1, 3, 7, 8, 10, 12, 13, 14, 20, 30])))) for i in range(12)]
        texts = [None, "", "..."]
        for _ in range(6):
            words = rng.choices(names, k=rng.randint(5, 60))
            other = [rng.choice(names) if rng.random() < 0.1 else w for w in decontaminate.words_of(rng.choice(items)[1])]
            at = rng.randint(0, len(words))
            texts.append(" ".join(words[:at] + other + words[at:]))
        index = decontaminate.build_index(items)
        got = decontaminate.overlaps_of(texts, index, decontaminate.seed_filters(index))
        assert got == [brute_overlaps(t, items) for t in texts]


def test_repeated_passages():
    """A passage that a text repeats thousands of times costs about as much as once."""
    rng = random.Random(2)
    line = [f"w{i}" for i in range(13)]
    items = [(i, " ".join([f"a{i}", *line, f"b{i}"])) for i in range(200)]
    texts = [" ".join(line * 40), " ".join(line * 3 + ["x"] + line[:6] + ["y"] + line[7:] + line * 40), " ".join(rng.sample(line, 13) * 9)]
    index = decontaminate.build_index(items)
    filters = decontaminate.seed_filters(index)
    assert decontaminate.overlaps_of(texts, index, filters) == [brute_overlaps(t, items) for t in texts]
    began = time.perf_counter()
    found = decontaminate.overlaps_of([" ".join(line * 4000)], index, filters)
    assert time.perf_counter() - began < 5 and len(found[0]) == 200


def test_pieces_of_a_batch_that_ends_with_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(pieces, "CHARS_AT_ONCE", 20)
    texts = ["a", None, "several words of one text that is long", "", "the last text is over the bound as well"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for frame, many in ((docs, 5), (docs.limit(0), 0)):
        rows = pieces.tokenize(frame, pieces.load_vocabulary()).collect()
        assert len(rows) == many
    segmenter = pieces.Segmenter(pieces.load_vocabulary())
    assert segmenter.encode_batch([])[0].tolist() == [] and segmenter.decode_batch(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []


def test_toxicity_equals_plain_noisy_or(spark):
    documents, labels = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "labels")
    model = toxicity.fit_on_folds(documents, labels)
    texts = dict(documents.select("doc_id", "text").collect())
    for r in toxicity.score_documents(documents, model).collect():
        clean = 1.0
        for sentence in toxicity._SENTENCE.findall((texts[r["doc_id"]] or "").lower()):
            if words := toxicity.features(sentence):
                clean *= 1 - 1 / (1 + math.exp(-model.bias - sum(model.weights.get(w, 0.0) for w in words)))
        assert abs(r["score"] - (1 - clean)) < 1e-9 and r["predicted"] == (r["score"] >= 0.7)


def test_long_texts_only_teach_as_well(spark):
    """A class or language whose texts are all long is learned from excerpts."""
    rng = random.Random(7)
    names = {"en": "the of and to in is that it was for".split(), "de": "der die und das von zu mit ist nicht ein".split()}
    long = lambda lang: " ".join(rng.choice(names[lang]) for _ in range(8000))
    rows = [(i, long("de") if i % 2 else " ".join(rng.choice(names["en"]) for _ in range(30)), "de" if i % 2 else "en") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(len(t) > language.MAX_TRAINING_CHARS for _, t, lang in rows if lang == "de")
    found = language.predict(docs, language.fit(docs)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {i: lang for i, _, lang in rows}


def test_scripts_of_many_letters(spark):
    """Two languages of thousands of letters, none of them frequent, are told apart."""
    rng = random.Random(8)
    first, second = [chr(0x4E00 + 7 * i) for i in range(900)], [chr(0xAC00 + 5 * i) for i in range(900)]
    rows = [(i, " ".join("".join(rng.choice(second if i % 2 else first) for _ in range(3)) for _ in range(60)), str(i % 2)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.filter("doc_id < 60"))
    rest = language.predict(docs.filter("doc_id >= 60"), model).collect()
    assert sum(r["lang_pred"] == str(r["doc_id"] % 2) for r in rest) >= 18


def test_blocks_equal_one_block(spark, monkeypatch):
    docs, items = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "benchmark")
    want = sorted(map(str, decontaminate.contamination(docs, items).collect()))
    kept = sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2500)
    assert decontaminate.block_count(items) > 3
    assert sorted(map(str, decontaminate.contamination(docs, items).collect())) == want
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == kept
    assert decontaminate.clean(odd.documents(spark), items).columns == odd.documents(spark).columns


def test_decontamination_on_all_documents(spark):
    items = [tuple(r) for r in read_table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    sets = {i: set(decontaminate.words_of(t)) for i, t in items}
    texts = dict(read_table(spark, SMALL, "documents").select("doc_id", "text").collect())
    got = {r["doc_id"]: {o["item_id"] for o in r["overlaps"]} for r in op8_decontaminate(spark, SMALL).collect()}
    for doc, text in texts.items():
        joined = " ".join(decontaminate.words_of(text))
        whole = {i for i, t in items if " ".join(decontaminate.words_of(t)) in joined}
        assert whole <= got[doc]
        assert all(len(sets[i] & set(joined.split())) >= 6 for i in got[doc])
    assert any(got.values())


def test_decontamination_edges(spark, monkeypatch):
    docs = odd.documents(spark)
    items = spark.createDataFrame([(1, odd.PLAIN), (2, odd.PLAIN), (None, odd.PLAIN), (4, None), (5, "")], "item_id int, text string")
    rows = decontaminate.contamination(docs, items).collect()
    assert len(rows) == len(odd.ROWS)
    assert all([o["item_id"] for o in r["overlaps"]] == [1, 2] for r in rows if r["doc_id"] in (1, 5))
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(odd.ROWS) - 4
    assert decontaminate.clean(docs, items.limit(0)).count() == len(odd.ROWS)
    assert decontaminate.clean(docs.limit(0), items).count() == 0
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 40)  # several blocks say the same
    assert sorted(map(str, decontaminate.contamination(docs, items).collect())) == sorted(map(str, rows))


# ---- pieces


def brute_segmentations(segmenter, text, n):
    found = []

    def walk(at, score, ids):
        if at == len(text):
            found.append((score, ids))
            return
        for stop in range(at + 1, len(text) + 1):
            for s, edge, start in segmenter._incoming(text, stop):
                if start == at:
                    walk(stop, score + s, ids + edge)

    walk(0, 0.0, ())
    return sorted(found, key=lambda f: (-f[0], f[1]))[:n]


@pytest.mark.parametrize("together", [1, 24])
def test_n_best_equals_brute_force(vocabulary, monkeypatch, together):
    monkeypatch.setattr(pieces, "TOGETHER", together)
    segmenter, rng = pieces.Segmenter(vocabulary), random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice("the anod  ▁ñ\U0001f600\n.") for _ in range(rng.randint(1, 11)))
        got, want = segmenter.encode(text, 4), brute_segmentations(segmenter, " " + text, 4)
        assert len(got) == len(want) and len({tuple(ids) for _, ids in got}) == len(got)
        assert np.allclose([s for s, _ in got], [s for s, _ in want])
        assert all(segmenter.decode(ids) == text for _, ids in got)


def test_ties_keep_alternatives_apart():
    marks = pieces.Vocabulary(["", " ", "a", "b", "aa", "ab", "ba"] + [f"<{i}>" for i in range(256)],
                              [0, -1, -1, -1, -2, -2, -2] + [-9.0] * 256, list(range(7, 263)))
    marks.pieces[7:] = [""] * 256
    segmenter = pieces.Segmenter(marks)
    got = segmenter.encode("aaba", 6)
    assert len({tuple(ids) for _, ids in got}) == len(got) == len(brute_segmentations(segmenter, " aaba", 6))


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "a"])
def test_long_stretch_in_little_memory(vocabulary, alphabet):
    rng, segmenter = random.Random(7), pieces.Segmenter(vocabulary)
    word = "".join(rng.choices(alphabet, k=200_000))
    tracemalloc.start()
    try:
        got = segmenter.encode(word, 3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 700_000_000
    assert len({tuple(ids) for _, ids in got}) == 3 and all(segmenter.decode(ids) == word for _, ids in got)
    assert got[0][0] >= got[1][0] >= got[2][0]


def test_pieces_edges(spark, vocabulary):
    docs = odd.documents(spark)
    rows = pieces.tokenize(docs, vocabulary).collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == len(odd.ROWS) and by[2]["ids"] is None and by[3]["ids"] == [] and by[3]["scores"] == [0.0]
    assert all(r["round_trip"] for r in rows if r["ids"] is not None)
    segmenter = pieces.Segmenter(vocabulary)
    back = pieces.tokenize(docs, vocabulary).select("doc_id", pieces.decode(F.col("ids"), vocabulary, spark).alias("text"))
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(odd.ROWS, key=str)
    for i, text in odd.ROWS:
        if i is not None and text is not None:
            assert segmenter.decode(by[i]["ids"]) == text
    assert pieces.tokenize(docs.limit(0), vocabulary).count() == 0


def test_pieces_round_trip(spark):
    rows = op9_pieces(spark, SMALL)
    assert rows.filter("not round_trip or size(ids) = 0").count() == 0 and rows.count() == 1000
