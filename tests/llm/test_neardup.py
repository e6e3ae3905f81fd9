"""Near duplicates: all pairs by plain counting, recall of links, classes held together by links alone, edges."""

import random
import re
from collections import Counter

import corpus
import numpy as np
import pytest

from papyra.llm import neardup


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()


def plain_links(texts, idf_of, least=0.8):
    """All pairs (i, j) of weighted Jaccard similarity >= least, from an inverted list of shingles."""
    sets = [shingles(t) for t in texts]
    weight = lambda s: sum(idf_of(w) for w in s) / len(s)
    known, where = {}, {}
    for i, own in enumerate(sets):
        for s in own:
            known.setdefault(s, weight(s))
            where.setdefault(s, []).append(i)
    size = [sum(c * known[s] for s, c in own.items()) for own in sets]
    pairs = {(i, j) for own in where.values() for x, i in enumerate(own) for j in own[x + 1 :]}
    links = []
    for i, j in pairs:
        common = sum(min(c, sets[j][s]) * known[s] for s, c in sets[i].items() if s in sets[j])
        sim = common / (size[i] + size[j] - common)
        if sim >= least + 1e-9:
            links.append((i, j))
    return links


def classes(links, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def changed(rng, text, part):
    w = text.split(" ")
    for _ in range(int(part * len(w))):
        w[rng.randrange(len(w))] = corpus.words(rng, 1)
    return " ".join(w)


def some_texts(groups=40, seed=3):
    rng = random.Random(seed)
    out = [corpus.words(rng, rng.randint(20, 300)) for _ in range(60)]
    for _ in range(groups):
        base = corpus.words(rng, rng.randint(60, 400))
        out += [base] + [changed(rng, base, rng.choice([0.0, 0.005, 0.01, 0.02, 0.03, 0.06])) for _ in range(rng.randint(1, 6))]
    hot = corpus.words(rng, 150)
    out += [changed(rng, hot, 0.005) for _ in range(400)]
    return out


def test_recall_and_precision_of_classes(spark):
    texts = some_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    idf = neardup.idf_table(df)
    bucket = lambda w: float(idf[int(neardup.word_hashes(w)[0] >> np.uint64(64 - neardup.BUCKETS))])
    links = plain_links(texts, bucket)
    got = {r["__id"]: r.class_id for r in neardup.near_duplicates(df, tile=64).collect()}
    assert len(got) == len(texts)
    recall = sum(got[a] == got[b] for a, b in links) / len(links)
    assert len(links) > 1000 and recall >= 0.99, recall
    want = classes(links, len(texts))
    assert all(want[i] == want[got[i]] for i in got), "a class that no links hold together"
    assert all(got[i] <= i and got[got[i]] == got[i] for i in got)


def test_edges(spark):
    docs = corpus.edge_documents()
    rows = neardup.near_duplicates(spark.createDataFrame(corpus.rows(docs), corpus.SCHEMA).repartition(3)).collect()
    assert len(rows) == len(docs)
    assert sorted(r["__id"] for r in rows) == sorted(-(2**63) if d[0] is None else d[0] for d in docs)
    named = {}
    for r in rows:
        assert named.setdefault((r["__id"], r["__t1"]), (r.class_id, r.class_t1)) == (r.class_id, r.class_t1)
    assert sorted(c[0] for (i, _), c in named.items() if i == 15) == [14, 15]
    assert neardup.near_duplicates(spark.createDataFrame([], corpus.SCHEMA)).count() == 0


@pytest.mark.parametrize("length", [1, 40])
def test_components_of_long_chains(spark, length, tmp_path):
    from papyra.llm.common import Scratch

    links = [(k, k + 1) for k in range(length)] + [(100 + (7 * k) % 41, 100 + (7 * (k + 1)) % 41) for k in range(40)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {**dict.fromkeys(range(length + 1), 0), **dict.fromkeys(range(100, 141), 100)}


def test_tiles_equal_pairs():
    """A spanning forest of each tile links just what pairs link, for long texts and repeated shingles too."""
    rng = random.Random(5)
    base = corpus.words(rng, 3000)
    texts = [base, changed(rng, base, 0.005), "a b c d e " * 300, "a b c d e " * 290 + "x", corpus.words(rng, 50)]
    idf = np.full(1 << neardup.BUCKETS, 1.5)
    sent = type("S", (), {"value": idf})
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"tile": [1] * 5, "node": list(range(5)), "label": list(range(5)), "text": texts})
    found = [(a, b) for out in neardup.tile_links(sent, 0.8)(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    assert found == [(0, 1), (2, 3)]
    assert classes(plain_links(texts, lambda w: 1.5), 5) == classes(found, 5)
