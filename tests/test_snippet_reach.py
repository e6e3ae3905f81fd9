import re

from papyra.plans.text_plans import snippet_parts


def brute(text):
    hit = re.compile(r"of\s+the", re.I)
    hits = len(hit.findall(text))
    return hits, len([g for g in hit.split(text) if g]) or (0 if hits else 1)


def test_snippet_parts_reads_all_documents_and_whole_texts(spark, tmp_path):
    texts = [("en", "x" * 500 + " of the end"), ("fr", "of the a OF\nTHE"), (None, "of theof the"), ("de", "none"), ("es", "")]
    rows = [(i, text, lang) for i, (lang, text) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_match, r.n_plain) for r in snippet_parts(spark, str(tmp_path)).collect()}
    assert got == {i: brute(text) for i, text, _ in rows}
