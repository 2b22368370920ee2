import corpus_pipeline
from sparkbars.llm.common import stage


def test_stages_do_their_work(spark, documents, prose):
    passage, word = prose(77, 60), "kalo mitu lota"
    rows = [(i, prose(i, 90), "en") for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1].replace("w", "w", 1) + " end"), (102, prose(300, 40) + " " + passage), (103, prose(301, 40) + " " + passage),
             (104, "1234 5678", None), (105, None, None)]
    docs = documents(rows)
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, ""), name)
        seen[name] = docs
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    clean = set(range(60))
    assert clean <= ids["language_id"] and not {104, 105} & ids["language_id"]
    assert clean <= ids["minhash_near_dedup"] and not {100, 101} & ids["minhash_near_dedup"]
    texts = {r.doc_id: r.text for r in seen["substring_dedup"].collect()}
    assert all(texts[i] == rows[i][1] for i in clean) and passage in texts[102] and passage not in texts[103]
    assert seen["substring_dedup"].columns == documents([]).columns
    assert ids["packing"] == set(texts)


def test_empty_tables_and_clashing_columns(spark, documents, prose):
    for docs in (documents([], "clash"), documents([(1, None, None), (None, prose(5, 30), "en"), (2, prose(5, 30), "en")], "clash")):
        before = docs.columns
        for name, step in corpus_pipeline.STAGES[:-1]:
            docs = stage(step(spark, docs, ""), name)
            assert docs.columns == before
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert {str(r.doc_id) for r in packed.collect()} == {str(r.doc_id) for r in docs.collect()}


def test_columns_named_like_ours_survive(spark, prose):
    names = ["score", "rejected", "cross_entropy", "n_symbols", "lang_pred", "gone_spans", "span_doc_id", "spans", "_0", "_1"]
    passage = prose(7, 60)
    rows = [(i, prose(i, 60) + " " + passage, "en") for i in range(1, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in names])
    out = docs
    for name, step in corpus_pipeline.STAGES[:3]:
        out = stage(step(spark, out, ""), name)
    got = out.collect()
    assert out.columns == docs.columns and len(got) == 29
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)
    assert sum(passage in r.text for r in got) == 1


def test_foreign_text_goes_and_clean_text_stays(spark, documents):
    from .test_language import text
    rows = [(i, text(lang, 40 + i % 40, i), lang) for i in range(900) for lang in [("aa", "bb")[i % 2]]]
    copies = [(5000 + i, text("aa", 60, 1), "aa") for i in range(450)]  # a third of the table is one text
    foreign = [(9000 + i, text("cc", 60, i), None) for i in range(30)]
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, documents(rows + copies + foreign), "").select("doc_id").collect()}
    assert kept == {r[0] for r in rows + copies}
