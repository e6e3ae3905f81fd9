"""Packing looks for neighbours among all documents, with whole texts, and loses no token."""

from papyra.llm.packing import Encoder, pack_documents


def packed(docs, **options):
    return [r.asDict() for r in pack_documents(docs, **options).collect()]


def check_whole(rows, window):
    spans, places = {}, {}
    for r in rows:
        spans.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in spans.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total
    sizes = []
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= window
        sizes.append(at)
    assert sum(s < window for s in sizes) <= window.bit_length() - 1
    return spans


def single_token_words(n):
    vocab = Encoder(None).tokenizer.get_vocab()
    return sorted(w for w in (t.removesuffix("</w>") for t in vocab if t.endswith("</w>")) if w.isascii() and w.isalpha() and w.islower() and len(w) > 5)[:n]


def test_true_neighbours_meet_at_any_distance(spark):
    # 1,500 documents were three shards of 512; each word is in two documents, all else is common
    words = single_token_words(750)
    docs = [(i, f"{words[i % 750]} the of and to in a is that common words here") for i in range(1500)]
    rows = packed(spark.createDataFrame(docs, "doc_id long, text string"), window=64, local_docs=64)
    assert len(check_whole(rows, 64)) == 1500
    at = {}
    for r in rows:
        at.setdefault(r["doc_id"], set()).add(r["sequence_id"])
    # a window holds five documents: its seed's partner comes first unless an earlier window has it; shards of a third allow a third of that
    together = sum(bool(at[i] & at[i + 750]) for i in range(750))
    rate = together / len({r["sequence_id"] for r in rows})
    assert rate > 0.5, (together, rate)


def test_whole_texts_are_queries(spark):
    # a whole window of the group's own word, then a rest of 8 tokens that is the same in all groups; 4 rests fill a window
    words = single_token_words(4)
    docs = [(i, f"{words[i % 4]} " * 32 + "the of and to in a is") for i in range(16)]
    rows = packed(spark.createDataFrame(docs, "doc_id long, text string"), window=32)
    check_whole(rows, 32)
    groups = {}
    for r in rows:
        if r["start"] == 32:
            groups.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 4)
    assert sorted(map(len, groups.values())) == [1, 1, 1, 1]


def test_copies_nulls_and_no_rows(spark):
    docs = [(i, "one and the same text") for i in range(300)] + [(None, None), (7, "")]
    kind = "doc_id long, text string"
    rows = packed(spark.createDataFrame(docs, kind), window=32, local_docs=16)
    assert sum(r["length"] for r in rows if r["start"] == 0) > 0
    assert {r["doc_id"] for r in rows} == {*range(300), None}
    assert packed(spark.createDataFrame([], kind)) == []


def test_leads_count_every_document(spark):
    # far more documents than a sample of some thousands; a word's two documents meet only where both are counted
    words = single_token_words(9000)
    docs = [(i, f"{words[i % 9000]} the of and to in a is that common words here") for i in range(18000)]
    rows = packed(spark.createDataFrame(docs, "doc_id long, text string"), window=64, local_docs=64)
    assert len(check_whole(rows, 64)) == 18000
    at = {}
    for r in rows:
        at.setdefault(r["doc_id"], set()).add(r["sequence_id"])
    together = sum(bool(at[i] & at[i + 9000]) for i in range(9000))
    rate = together / len({r["sequence_id"] for r in rows})
    assert rate > 0.5, (together, rate)
