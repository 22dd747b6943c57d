"""The pipeline against its stages' plain versions, and its stages on odd documents."""

import shutil

import corpus_pipeline
from gradecut.llm import decontaminate, language, pieces, toxicity
from gradecut.llm.common import read_table
from tests.llm import odd
from tests.llm.test_similar import plain_groups
from tests.llm.test_texts import brute_overlaps

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_version(spark):
    documents, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    tox, lang = toxicity.fit_on_folds(documents, labels), language.fit_on_folds(documents)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]

    def toxic(text):
        clean = 1.0
        for _, _, z in toxicity.sentence_scores(text, tox):
            clean *= 1 / (1 + 2.718281828459045**z)
        return 1 - clean >= 0.7

    rows = [r for r in rows if not toxic(r[1])]
    table, presence = language.letter_table(lang.letters), language.Presence()
    score = language.kernel_rows([t for _, t in rows], lang, table, presence) @ lang.coefficients[:-1] + lang.coefficients[-1]
    rows = [r for r, s in zip(rows, score.max(axis=1), strict=True) if s >= 0.25 and any(c.isalpha() for c in r[1])]
    first = plain_groups(dict(rows))
    rows = [r for r in rows if first[r[0]] == r[0]]
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
    index = decontaminate.build_index(items)
    hit = decontaminate.overlaps_of([t for _, t in rows], index, decontaminate.seed_filters(index))
    rows = [r for r, h in zip(rows, hit, strict=True) if not h]
    segmenter = pieces.Segmenter(pieces.load_vocabulary())
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    texts = dict(rows)
    assert all(segmenter.decode(r["ids"]) == texts[r["doc_id"]] for r in got)
    assert 50 < len(got) < 200


def test_stages_on_odd_documents(spark):
    docs = odd.documents(spark)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, frame, SF)
            assert kept.columns == docs.columns and kept.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()


def test_run_on_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        read_table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    shutil.rmtree(tmp_path)


def test_stage_decisions():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "simhash", "decontamination", "pieces"]
    assert brute_overlaps("", []) == []
