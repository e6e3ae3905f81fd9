"""Each stage of the pipeline, on edge cases, against a plain version of what it decides."""

import random
import re
import zlib
from collections import Counter

import corpus
import pytest
from test_langid import some_documents
from test_line_dedup import plain as plain_lines
from test_mixing import targets
from test_packing import exact
from test_packing_reach import check_whole, single_token_words

import corpus_pipeline as cp
from papyra.llm import packing

STAGES = dict(cp.STAGES)


def table(spark, docs, parts=3):
    return spark.createDataFrame(corpus.rows([d[:4] for d in docs]), corpus.SCHEMA).repartition(parts)


def test_language_stage_rejects_only_what_is_in_no_language(spark):
    docs = [(*d, None) for d in corpus.edge_documents()] + some_documents(200)
    df = table(spark, docs)
    out = STAGES["language_id"](spark, df, "")
    assert out.schema == df.schema
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    for i, t, _, _, lang in docs:
        if lang:
            assert kept[i, t], (i, t)
        if not any(c.isalpha() for c in t or ""):
            assert not kept[i, t]
    assert all(r.lang for r in out.collect())


def test_language_stage_learns_from_every_labelled_text(spark):
    # no two texts share a letter: a text that is not learned from is in no known language
    docs = [(i, "".join(chr(0x4E00 + 3 * i + k) for k in range(3)), "zh", "a") for i in range(3000)]
    kept = {r.doc_id for r in STAGES["language_id"](spark, table(spark, docs), "").collect()}
    assert kept >= {i for i in range(3000) if zlib.crc32(str(i).encode()) % 5}


def test_line_stage(spark):
    docs = corpus.edge_documents()
    df = table(spark, docs)
    out = STAGES["line_dedup"](spark, df, "")
    assert out.schema == df.schema
    want = [(i, None if text is None and not n else kept) for (i, text, *_), (_, _, n, kept) in zip(docs, plain_lines(docs), strict=True)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_near_copy_stage_keeps_one_of_each_class(spark):
    rng = random.Random(2)
    docs = []
    for g in range(12):
        base = corpus.words(rng, 120)
        docs += [(10 * g + k, base if k % 2 else base + f" w{k}", "en", "a") for k in range(g % 5 + 1)]
    docs += [docs[0], docs[0], (None, docs[0][1], None, None), (900, None, None, None), (901, None, None, None), (902, "", "en", "a"), (903, "alone", None, None)]
    out = STAGES["near_dedup"](spark, table(spark, docs), "")
    assert out.schema == table(spark, docs).schema
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    first = [(None, docs[0][1])] + [min((d[0], d[1]) for d in docs if d[0] is not None and 10 * g <= d[0] < 10 * g + 10) for g in range(1, 12)]
    assert left == sorted([*first, (900, None), (901, None), (902, ""), (903, "alone")], key=str)


@pytest.mark.parametrize("edges", [False, True])
def test_mixing_stage_meets_targets_with_words_of_the_documents(spark, edges):
    rng = random.Random(4)
    docs = corpus.edge_documents() if edges else [(i, corpus.words(rng, rng.choice([1, 30, 200])), "en", rng.choices("abc", [6, 2, 1])[0]) for i in range(150)]
    df = table(spark, docs)
    out = STAGES["mixing"](spark, df, "")
    assert out.schema == df.schema
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    own = {}
    for i, t, _, s in docs:
        sizes[s] += count(t)
        own.setdefault(i, []).append(t or "")
    for r in out.collect():
        taken[r.source] += count(r.text)
        assert any((r.text or "") in t for t in own[r.doc_id])
        assert r.n_chars == (None if r.text is None else len(r.text))
    want = targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 64 for s in sizes)


def test_packing_stage(spark):
    docs = corpus.edge_documents()
    exact(STAGES["packing"](spark, table(spark, docs), "").collect(), docs, packing.Encoder(None).tokenizer, 2048)


def test_packing_stage_leads_by_every_document(spark):
    words = single_token_words(9000)
    docs = [(i, f"{words[i % 9000]} the of and to in a is that common words here", "en", "a") for i in range(18000)]
    rows = [r.asDict() for r in STAGES["packing"](spark, table(spark, docs), "").collect()]
    assert len(check_whole(rows, 2048)) == 18000
    at = {}
    for r in rows:
        at.setdefault(r["doc_id"], set()).add(r["sequence_id"])
    # of any two documents that share a word, which no others have, most lie in one sequence; a sample counts few such words twice
    together = sum(bool(at[i] & at[i + 9000]) for i in range(9000))
    assert together > 6000, together


def test_all_stages_in_turn(spark, tmp_path):
    docs = [(*d, None) for d in corpus.edge_documents()] + some_documents(150)
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = cp.run(spark, str(tmp_path)).collect()
    assert rows and {r.doc_id for r in rows} <= {d[0] for d in docs}


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, name):
    assert STAGES[name](spark, spark.createDataFrame([], corpus.SCHEMA), "").count() == 0
