"""What a Python worker holds at a time does not grow with the rows that Spark sends it."""

import random

import pyarrow as pa

from papyra.operators import search


def batch(texts, slots):
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(texts, pa.string())], ["slot", "text"])


def test_slots_of_grams_come_by_bounded_tables(monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "abc", *("".join(rng.choice("abcß") for _ in range(rng.randint(0, 60))) for _ in range(997))]
    slots = [rng.randrange(3) * search.BLOCK + i for i in range(1000)]
    rng.shuffle(slots)
    monkeypatch.setattr(search, "PAIRS", 500)
    out = list(search.gram_slots(iter([batch(texts[:900], slots[:900]), batch(texts[900:], slots[900:])])))
    assert max(len(b.column(2).flatten()) for b in out) < 500 + 60 and len(out) > 10
    want = {(g, s // search.BLOCK, s) for t, s in zip(texts, slots, strict=True) for g in search.grams_of(t or "")}
    got = [(r["gram"], r["block"], s) for b in out for r in b.to_pylist() for s in r["slots"]]
    assert len(got) == len(want) and set(got) == want
    assert all(r["slots"] == sorted(r["slots"]) for b in out for r in b.to_pylist())


def test_bitmaps_leave_by_bounded_batches():
    out = list(search.bitmap_rows(iter([batch(["abc", None] * 500, range(1000))]), "slot"))
    assert max(b.num_rows for b in out) <= 256 and sum(b.num_rows for b in out) == 1000
    assert out[0].column(1)[0].as_py() == search.trigram_bitmap(["abc"])
