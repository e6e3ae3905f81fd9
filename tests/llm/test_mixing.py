"""Mixing: sizes, targets, caps and totals against plain arithmetic, and reruns that agree."""

import random
import re

import corpus
import pytest

from papyra.llm.mixing import mix_sources


def targets(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by source of total sizes, by resharing round after round."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        level = rest / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] >= 2 * sizes[s]]
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
            open_.remove(s)
    return out


def mixed(spark, docs, parts=3, **options):
    df = spark.createDataFrame(corpus.rows(docs), corpus.SCHEMA).repartition(parts)
    rows = mix_sources(df, **options)
    if options.get("keep_rows", True):
        rows = rows.select("row.source", "doc_id", "size", "source_size", "target", "taken", "row.text", "copies", "parts")
    return rows.collect()


def check(rows, docs, near=64):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in docs:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = targets(sizes)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), count(t)) for i, t, _, _ in docs)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.copies * r.size + sum(p["to"] - p["from"] for p in r.parts)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near, (s, taken[s], want[s])


@pytest.mark.parametrize("shard_words", [2**18, 500])
def test_totals_targets_and_caps(spark, shard_words):
    rng = random.Random(4)
    docs = [(i, corpus.words(rng, rng.choice([0, 1, 3, 40, 300])), "en", rng.choices(["a", "b", "B", "é", "z", None], [30, 5, 5, 3, 1, 2])[0]) for i in range(400)]
    rows = mixed(spark, docs, shard_words=shard_words)
    check(rows, docs, 64 if shard_words > 500 else 16 * 60)


def test_edges(spark):
    docs = corpus.edge_documents()
    check(mixed(spark, docs), docs)
    assert mixed(spark, [], 1) == []
    nothing = [(1, None, None, None), (2, "", None, "a")]
    assert sorted((r.doc_id, r.taken, r.target) for r in mixed(spark, nothing)) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_reruns_agree_however_rows_are_spread(spark):
    rng = random.Random(6)
    docs = [(i, corpus.words(rng, rng.randint(0, 200)), "en", rng.choice("abc")) for i in range(300)]
    one, two = ({(r.doc_id, r.taken) for r in mixed(spark, docs, parts)} for parts in (1, 7))
    assert one == two
    bare = {(r.doc_id, r.taken) for r in mixed(spark, docs, 2, keep_rows=False)}
    assert bare == one
