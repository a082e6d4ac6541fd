import corpus_pipeline as p
from beamframe.llm import decontaminate, jaccard, pii
from tests.llm.cases import odd_docs
from tests.llm.test_jaccard import brute as groups


def stage(spark, name, docs):
    import os

    return dict(p.STAGES)[name](spark, docs, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 80").unionByName(odd_docs(spark).where("doc_id IS NULL OR doc_id >= 100").selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars"))


def test_filters(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.collect()
    left = stage(spark, "language_crf", docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in rows if r.text and any(c.isalpha() for c in r.text)}
    left = stage(spark, "jaccard_trees", docs)
    want = groups([(r.doc_id, r.text) for r in rows if r.doc_id is not None])
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if i == c} | {None}
    left = stage(spark, "decontamination", docs)
    items = [decontaminate.normalize(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hold = {r.doc_id for r in rows if any(i in decontaminate.normalize(r.text) for i in items)}
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in rows} - hold


def test_redaction_and_packing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = stage(spark, "pii_boosting", docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    left = out.select("text").where(f"size(filter(regexp_extract_all(text, '{pii.BASE['email'].replace(chr(92), chr(92) * 2)}', 0), x -> true)) > 0")
    assert left.count() == 0
    packed = stage(spark, "best_fit_packing", out)
    total = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in total) <= 1024 and packed.select("doc_id", "piece").distinct().count() <= packed.count()


def test_run_and_empty(spark, sf_dir):
    assert [n for n, _ in p.STAGES] == ["language_crf", "jaccard_trees", "decontamination", "pii_boosting", "best_fit_packing"]
    docs = odd_docs(spark).limit(0)
    for _, f in p.STAGES[:-1]:
        docs = f(spark, docs, sf_dir)
    assert p.STAGES[-1][1](spark, docs, sf_dir).count() == 0
    assert p.jaccard is jaccard and p.run(spark, sf_dir).count() > 0


def test_language_stage_without_labels(spark, sf_dir):
    docs = documents(spark, sf_dir)
    want = sorted(repr(r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    held = "CAST(NULL AS string)", "IF(crc32(CAST(coalesce(CAST(doc_id AS string), '') AS binary)) % 4 = 2, lang, NULL)"
    for lang in held:  # no label at all, or on held-out rows only
        left = stage(spark, "language_crf", docs.selectExpr("doc_id", "text", f"{lang} AS lang", "source", "n_chars"))
        assert left.columns == docs.columns and sorted(repr(r.text) for r in left.collect()) == want and want
