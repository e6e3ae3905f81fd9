"""Language ID: held-out accuracy on invented languages, what may not matter, long texts, many languages."""

import random
import zlib
from collections import Counter

import corpus
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyra.llm import langid

LETTERS = {"aa": "abcdefghi", "bb": "hijklmnop", "cc": "opqrstuvw", "dd": "aeioutrns"}


def some_documents(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(LETTERS))
        out.append((i, corpus.words(rng, rng.choice([5, 40, 200]), LETTERS[lang]), lang if rng.random() < 0.9 else None, rng.choice("xyz"), lang))
    return out


def predicted(spark, docs, parts=3):
    df = spark.createDataFrame(corpus.rows([d[:4] for d in docs]), corpus.SCHEMA).repartition(parts)
    return {(r.doc_id, r.text): r.language for r in langid.identify(df).collect()}


def test_held_out_accuracy_and_flag(spark):
    docs = some_documents()
    got = predicted(spark, docs)
    right = total = 0
    for i, text, _, _, lang in docs:
        r = got[i, text]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.held_out:
            total += 1
            right += r.lang_pred == lang
    assert total > 50 and right / total >= 0.95


def test_labels_of_held_out_rows_and_sources_do_not_matter(spark):
    docs = some_documents(200)
    other = [(i, t, ("zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang), "q", x) for i, t, lang, _, x in docs]
    one, two = predicted(spark, docs), predicted(spark, other, 5)
    assert {k: (v.lang_pred, v.score) for k, v in one.items()} == {k: (v.lang_pred, v.score) for k, v in two.items()}


def test_edges(spark):
    docs = [(*d, None) for d in corpus.edge_documents()] + some_documents(60)
    df = spark.createDataFrame(corpus.rows([d[:4] for d in docs]), corpus.SCHEMA)
    rows = langid.identify(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.language.lang_pred, r.language.score) == ("und", 0.0)
        else:
            assert r.language.lang_pred in {"en", "de", *LETTERS}
    assert langid.identify(spark.createDataFrame([], corpus.SCHEMA)).count() == 0
    bare = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (bare.language.lang_pred, bare.language.score) == ("und", 0.0)
    with pytest.raises(ValueError, match="taken|there"):
        langid.identify(df.withColumn("language", F.lit(1)))


def plain_grams(text):
    out = []
    word = ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        else:
            if word:
                shown = f"\0{word}\0"
                out += [shown[k : k + n] for n in langid.SIZES for k in range(len(shown) - n + 1)]
            word = ""
    return out


def hashed(gram):
    h = len(gram)
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + (0 if c == "\0" else ord(c))) % 2**64
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 % 2**64
    return h ^ h >> 32


def test_long_texts_lose_no_gram(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 50)
    rng = random.Random(2)
    for text in ("ab " * 60, "".join(rng.choice("abc") for _ in range(333)), corpus.words(rng, 80) + "x" * 200, "a", "é " * 99):
        found = [int(k) for _, group, cut in langid.pieces([text]) for keys, _ in langid.grams(group, cut) for k in keys]
        want = [hashed(g) for g in plain_grams(text)]
        assert set(found) == set(want)
        assert 0 <= len(found) - len(want) <= len(text) // 50 + 1


def test_more_than_256_languages():
    keys = langid.np.arange(1, 301, dtype=langid.np.uint64) * langid.np.uint64(0x9E3779B97F4A7C15)
    filters = langid.Filters([f"l{k}" for k in range(300)], [keys[k : k + 1] for k in range(300)])
    masks = filters.masks(keys[299:300])
    assert masks[299 // 64][0] >> langid.np.uint64(299 % 64) & langid.np.uint64(1)
    assert len(masks) == 5


def test_counts_of_a_task_are_whole_however_few_it_holds(monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice(list(LETTERS)), corpus.words(rng, 60, rng.choice(list(LETTERS.values()))) if i % 7 else None) for i in range(40)]
    want = Counter((lang, hashed(g)) for lang, text in rows for g in plain_grams(text or ""))
    batches = [pa.RecordBatch.from_pylist([{"lang": a, "text": b} for a, b in rows[k : k + 9]], pa.schema([("lang", pa.string()), ("text", pa.string())])) for k in range(0, 40, 9)]
    for most in (langid.HELD, 500, 1):
        monkeypatch.setattr(langid, "HELD", most)
        got = Counter()
        for batch in langid.gram_counts(iter(batches)):
            for r in batch.to_pylist():
                got[r["lang"], r["gram"] % 2**64] += r["n"]
        assert got == want


def test_most_frequent_are_those_of_a_full_ranking(spark):
    rng = random.Random(6)
    rows = [(x, rng.choice([k, k << 48]) - rng.choice([0, 1 << 62]), rng.randint(1, 3)) for x, many in (("a", 200), ("b", 30), ("c", 4)) for k in range(many)]
    rows = list({(x, g): (x, g, n) for x, g, n in rows}.values())
    df = spark.createDataFrame(rows, "lang string, gram long, n long").repartition(3)
    for most in (1, 7, 30, 61, 130, 200, 500):
        want = [r for x in "abc" for r in sorted((r for r in rows if r[0] == x), key=lambda r: (-r[2], r[1]))[:most]]
        assert sorted(map(tuple, langid.most_frequent(df, ["a", "b", "c"], most).collect())) == sorted(want)
