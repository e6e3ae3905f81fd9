"""Packing: every id in one piece, with the tokenizer's ids, whatever the documents; other tokenizers; levels."""

import json
import random
import zlib

import corpus
import numpy as np
import pytest
from test_packing_reach import check_whole

from papyra.llm import packing


def packed(spark, docs, parts=3, **options):
    df = spark.createDataFrame(corpus.rows(docs), corpus.SCHEMA).repartition(parts)
    return packing.pack_documents(df, **options).collect()


def exact(rows, docs, tokenizer, window):
    """Whether the pieces are just the ids of the documents: by id, as a bag of (start, length, crc, tokens) that covers each text."""
    want = {}
    for i, text, *_ in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END], dtype="<u4")
        want.setdefault(i, []).append(ids)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        assert 0 < r.length and r.offset + r.length <= window
    assert got.keys() == want.keys()
    for i, texts in want.items():
        left = sorted((r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got[i])
        for ids in sorted(texts, key=len):
            at = 0
            while at < len(ids):
                fit = next(p for p in left if p[0] == len(ids) and p[1] == at and p[3] == zlib.crc32(ids[at : at + p[2]].tobytes()))
                left.remove(fit)
                at += fit[2]
            assert at == len(ids)
        assert not left


@pytest.mark.parametrize("window, local_docs", [(2048, 512), (256, 8), (64, 3)])
def test_ids_are_the_tokenizers(spark, window, local_docs):
    rng = random.Random(1)
    docs = corpus.edge_documents() + [(100 + i, "\n".join(corpus.words(rng, rng.choice([0, 1, 7, 90])) for _ in range(3)), "en", "a") for i in range(150)]
    docs += [(300, "don't we'll a1b2 <|endoftext|> x\ty\r\nz É é İstanbul ΣΑΣ  ﬁ #$%", None, None), (301, "word. word, word.. ,", "en", "a")]
    rows = packed(spark, docs, window=window, local_docs=local_docs)
    exact(rows, docs, packing.Encoder(None).tokenizer, window)
    sizes = {}
    for r in rows:
        sizes.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sizes.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0
    assert sum(sum(n for _, n in p) < window for p in sizes.values()) < window.bit_length()


def test_many_levels_lose_nothing(spark):
    docs = [(i, "one and the same short text" if i % 3 else f"text number {i}", "en", "a") for i in range(900)]
    rows = packed(spark, docs, window=64, local_docs=2)
    assert len({r.sequence_id >> 56 for r in rows}) > 2
    check_whole([r.asDict() for r in rows], 64)


def test_another_tokenizer_gives_its_own_ids(spark, tmp_path):
    import public_tokenizers

    model = json.load(open(public_tokenizers.path(packing.TOKENIZER)))
    model["normalizer"] = None
    path = str(tmp_path / "cased.json")
    json.dump(model, open(path, "w"))
    enc = packing.Encoder(path)
    assert not enc.known and packing.Encoder(None).known
    docs = [(1, "UPPER and lower", None, None), (2, "", None, None), (3, "Mixed\n\nCase. İ", None, None)]
    exact(packed(spark, docs, tokenizer=path), docs, enc.tokenizer, 2048)


def test_neighbours_are_the_best_of_the_shard():
    """pack() fills a window with the unused documents of largest BM25 score, recomputed plainly."""
    rng = np.random.default_rng(3)
    rests = [np.append(rng.integers(5, 60, rng.integers(3, 30)), 1) for _ in range(40)]
    df = np.bincount(np.concatenate([np.unique(r) for r in rests]))
    idf, mean = np.log(1 + (40 - df + 0.5) / (df + 0.5)), np.mean([len(r) for r in rests])

    def score(q, d):
        total = 0.0
        for t in np.unique(rests[q]):
            tf = (rests[d] == t).sum()
            total += np.rint(packing.UNIT * idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(rests[d]) / mean))) if tf else 0
        return total

    used = set()
    for pieces in packing.pack(rests, 128):
        order = [d for d, _, _ in pieces]
        for k, d in enumerate(order[1:], 1):
            free = [x for x in range(40) if x not in used and x not in order[:k]]
            assert score(order[0], d) == max(score(order[0], x) for x in free)
        used |= set(order)


def test_shards_keep_most_of_what_the_whole_corpus_offers(spark):
    """Documents of one topic share words; with shards of a hundredth of all, partners of a topic still meet."""
    rng = random.Random(7)
    topics = [corpus.words(rng, 12).split() for _ in range(60)]
    common = corpus.words(rng, 40).split()
    docs = [(i, " ".join(rng.choice(topics[i % 60] if rng.random() < 0.5 else common) for _ in range(30)), "en", "a") for i in range(1200)]
    rows = packed(spark, docs, window=512, local_docs=24)
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, set()).add(r.doc_id % 60)
    held = sum(len({r.doc_id for r in rows if r.sequence_id == s}) for s in list(at)[:40])
    kinds = sum(len(at[s]) for s in list(at)[:40])
    assert kinds / held < 0.75, (kinds, held)


def test_empty_table(spark):
    assert packed(spark, [], 1) == []
