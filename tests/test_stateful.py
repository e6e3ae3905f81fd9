"""Caches, shared stores, hovering, chains and histories against plain simulations."""

import random

from papyra.operators import stateful


def plain_cache(events):
    kept, used, tick, budget, hits, lookups = {}, 0, 0, None, 0, 0  # item: (stale, last, cost)
    for e in events:
        budget = e["budget"] if budget is None or e["action"] == "budget" else budget
        hit, gone, tick = None, [], tick + 1

        def shrink(to):
            nonlocal used
            while used > to and kept:
                k = min(kept, key=lambda k: (not kept[k][0], kept[k][1]))
                used -= kept.pop(k)[2]
                gone.append(k)

        if e["action"] == "get":
            lookups, hit = lookups + 1, e["item"] in kept
            hits += hit
            if hit:
                kept[e["item"]] = (False, tick, kept[e["item"]][2])
        elif e["action"] == "put" and e["cost"] <= budget:
            used -= kept.pop(e["item"], (0, 0, 0))[2]
            shrink(budget - e["cost"])
            kept[e["item"]] = (False, tick, e["cost"])
            used += e["cost"]
        elif e["action"] == "stale":
            kept = {k: (True if k.startswith(e["item"]) else v[0], *v[1:]) for k, v in kept.items()}
        elif e["action"] == "drop":
            used -= sum(v[2] for k, v in kept.items() if k.startswith(e["item"]))
            kept = {k: v for k, v in kept.items() if not k.startswith(e["item"])}
        elif e["action"] == "budget":
            shrink(budget)
        yield e["seq"], hit, sorted(gone), len(kept), used, hits, lookups


def some_events(rng, n):
    out = []
    for seq in range(n):
        action = rng.choices(["get", "put", "stale", "drop", "budget"], [5, 5, 1, 1, 1])[0]
        item = f"d{rng.randrange(3)}/" + ("" if action in ("stale", "drop") else str(rng.randrange(9)))
        out.append({"owner": 1, "seq": seq, "action": action, "item": item, "cost": rng.randrange(1, 60), "budget": rng.choice([60, 100, 200]) if action == "budget" else 150})
    return out


def test_caches(spark):
    events = some_events(random.Random(1), 600)
    df = spark.createDataFrame([tuple(e.values()) for e in events], "owner long, seq long, action string, item string, cost long, budget long").repartition(3)
    got = [tuple(r)[1:] for r in stateful.cache_states(df, "owner").orderBy("seq").collect()]
    assert got == list(plain_cache(events))
    m = stateful.metrics(stateful.cache_states(df, "owner")).first()
    assert (m.hits, m.lookups, m.used) == (got[-1][5], got[-1][6], got[-1][4])


def test_shared_store_never_exceeds_its_budget_and_is_fair(spark):
    rng = random.Random(2)
    events = [(1, s, "page", rng.randrange(3), rng.randrange(20), rng.randrange(5, 30), 200) for s in range(500)] + [(1, 500, "budget", 0, 0, 0, 50)]
    df = spark.createDataFrame(events, "owner long, seq long, action string, doc long, src long, cost long, budget long")
    rows = stateful.shared_store(df, "owner").orderBy("seq").collect()
    assert all(r.used <= 200 for r in rows) and rows[-1].used <= 50 and any(r.stored is False for r in rows)
    s = stateful.Shares()
    for src in range(10):
        list(s.step({"seq": src, "action": "page", "doc": 1, "src": src, "cost": 20, "budget": 200}))
    for src in range(10):
        list(s.step({"seq": src, "action": "page", "doc": 2, "src": src, "cost": 20, "budget": 200}))
    assert s.held(1) == s.held(2) == 100 and sorted(s.pages[1]) == list(range(5)) and s.cut == {1, 2}


def phases(*events):
    h, out = stateful.Hover(), []
    for ms, action, item, load in events:
        out += list(h.step({"ms": ms, "action": action, "item": item, "load_ms": load}))
    return [(ms, phase, item) for ms, phase, item, _ in [*out, *h.finish()]]


def test_hovering():
    assert phases((0, "enter", "a", 50)) == [(0, "dwelling", "a"), (200, "loading", "a"), (250, "shown", "a")]
    assert phases((0, "enter", "a", 50), (100, "leave", "a", 0)) == [(0, "dwelling", "a"), (100, "leaving", "a"), (220, "idle", None)]
    assert phases((0, "enter", "a", 50), (300, "leave", "a", 0), (350, "popover", "a", 0))[-2:] == [(300, "leaving", "a"), (350, "shown", "a")]
    # one load at a time: b waits for a's, whose result shows nothing
    assert phases((0, "enter", "a", 900), (300, "enter", "b", 10)) == [(0, "dwelling", "a"), (200, "loading", "a"), (300, "dwelling", "b"), (500, "loading", "b"), (1100, "loading", "b"), (1110, "shown", "b")]
    # what was shown before comes at once
    assert phases((0, "enter", "a", 10), (400, "close", None, 0), (500, "enter", "a", 10))[-1] == (500, "shown", "a")


def test_indexing_takes_the_front_document_first():
    s = stateful.Indexing()
    step = lambda action, doc=None, pages=None: next(s.step({"seq": 0, "action": action, "doc": doc, "pages": pages}))
    assert step("request", 1, 2)[1:4] == (1, 1, 1)
    step("request", 2, 40)
    step("request", 3, 1)
    step("front", 3)
    assert step("page")[1] == 1
    assert step("page") == (0, 3, 2, 2, 2, True)
    assert step("page", pages=1)[1:5] == (3, 2, 2, 0)  # of an earlier chain: dropped
    assert step("page")[1] == 2
    told = [step("page")[5] for _ in range(40)]
    assert [i + 1 for i, t in enumerate(told) if t] == [32, 40]


def test_history_is_bounded_and_passes_over_others():
    h = stateful.History()
    for k in range(150):
        list(h.step({"seq": k, "action": "push", "doc": k % 2, "top": float(k)}))
    assert len(h.entries) == 100
    assert list(h.step({"seq": 0, "action": "pop", "doc": 0, "top": None}))[0][1:] == (148.0, 98)
    assert list(h.step({"seq": 0, "action": "pop", "doc": 7, "top": None}))[0][1:] == (None, 0)
