"""The edit log: each operation, its inverse, undo to the start, redo to the end, savepoints, adoption and plans."""

import copy
import json
import random

import pytest

from papyra.operators import edits

SIZES = {"sizes": [[612, 792], [100, 200], [300, 400]]}


def opened(limit=None):
    e = edits.Editing()
    e.act("open", SIZES)
    e.act("adopt", {"pages": [{"src": 1, "annots": [{"kind": "ink", "rect": [1, 2, 3, 4], "color": "#f00", "opacity": 1, "srcAnnotIndex": 4}, {"kind": "note", "rect": [0, 0, 1, 1], "color": "#0f0", "opacity": 1, "srcAnnotIndex": 7}]}]})
    return e


def state(e):
    d = e.document
    return copy.deepcopy((d.pages, {k: v for k, v in d.annotations.items() if v}, d.form))


def some_op(rng, e):
    pages = [p["id"] for p in e.document.pages] + ["pg-none"]
    page = rng.choice(pages)
    own = [a["id"] for a in e.document.annotations.get(page, [])] + ["an-none"]
    made = rng.randrange(10**6)
    return rng.choice([
        {"type": "reorder", "pageId": page, "toIndex": rng.randrange(max(1, len(pages) - 1))}, {"type": "rotate", "pageId": page, "delta": rng.choice([90, 180, 270])}, {"type": "duplicate", "pageId": page},
        {"type": "addBlank", "index": rng.randrange(len(pages)), "widthPt": 1, "heightPt": 2}, {"type": "setForm", "field": rng.choice("ab"), "value": str(made)}, {"type": "patchAnnot", "pageId": page, "id": rng.choice(own), "patch": {"color": f"#{made}", "extra": 1}},
        {"type": "deleteAnnot", "pageId": page, "id": rng.choice(own)}, *([{"type": "delete", "pageId": page}] * (len(pages) > 2)),
        *([{"type": "addAnnot", "annot": {"id": f"u{made}", "pageId": page, "kind": "rect", "rect": [made, 0, 1, 1], "color": "#000", "opacity": 1}}] * (page != "pg-none")),
    ])


@pytest.mark.parametrize("seed", range(8))
def test_undo_goes_back_and_redo_comes_again(seed):
    rng, e = random.Random(seed), opened()
    states = [state(e)]
    for _ in range(60):
        e.act("do", some_op(rng, e))
        states.append(state(e))
    loose = lambda s: (s[0], {k: [{x: y for x, y in a.items() if y is not None} for a in v] for k, v in s[1].items()}, s[2])  # noqa: E731  a field that a patch brought in comes back as null
    for want in reversed(states[:-1]):
        e.act("undo", {})
        assert loose(state(e)) == loose(want)
    assert not e.done and not e.dirty()
    for want in states[1:]:
        e.act("redo", {})
        assert loose(state(e)) == loose(want)
    assert not e.undone


def test_savepoints():
    e = opened()
    assert not e.dirty()
    rotate = {"type": "rotate", "pageId": "pg-1", "delta": 90}
    e.act("do", rotate)
    e.act("save", {})
    assert not e.dirty()
    e.act("undo", {})
    assert e.dirty()
    e.act("redo", {})
    assert not e.dirty()
    e.act("undo", {})
    e.act("do", rotate)
    assert e.dirty() and e.saved is None
    for _ in range(edits.HISTORY + 5):
        e.act("do", rotate)
    assert len(e.done) == edits.HISTORY


def test_plan_writes_only_what_changed():
    e = opened()
    assert [(p["annots"], p["drop"], p["owned"]) for p in e.document.plan()] == [([], [], []), ([], [], [4, 7]), ([], [], [])]
    first = e.document.annotations["pg-2"][0]["id"]
    e.act("do", {"type": "patchAnnot", "pageId": "pg-2", "id": first, "patch": {"color": "#00f"}})
    assert e.document.plan()[1]["annots"] == ["ink"] and e.document.plan()[1]["drop"] == [4]
    e.act("do", {"type": "patchAnnot", "pageId": "pg-2", "id": first, "patch": {"color": "#f00"}})
    assert e.document.plan()[1]["drop"] == []
    e.act("do", {"type": "deleteAnnot", "pageId": "pg-2", "id": e.document.annotations["pg-2"][1]["id"]})
    assert e.document.plan()[1]["annots"] == [] and e.document.plan()[1]["drop"] == [7]


def test_operations_that_only_undo_are_refused():
    with pytest.raises(ValueError):
        opened().act("do", {"type": "restoreForm", "field": "a", "prev": None})


def test_logs_of_many_documents(spark):
    rng, log, want = random.Random(1), [], {}
    for doc in (1, 2, None):
        e = edits.Editing()
        steps = [("open", SIZES)] + [None] * 30
        for seq, given in enumerate(steps):
            action, op = given or rng.choice([("do", some_op(rng, e)), ("do", some_op(rng, e)), ("undo", {}), ("redo", {}), ("save", {})])
            e.act(action, json.loads(json.dumps(op)))
            log.append((doc, seq, action, json.dumps(op)))
        want[doc] = ([p["id"] for p in e.document.pages], len(e.done), len(e.undone), e.dirty())
    rng.shuffle(log)
    df = spark.createDataFrame(log, "doc long, seq long, action string, op string").repartition(3)
    last = {r.doc: (r.pages, r.undo, r.redo, r.dirty) for r in edits.edit_states(df).where("seq = 30").collect()}
    assert last == want
    assert edits.edit_plans(df).count() == sum(len(w[0]) for w in want.values())
    assert edits.edit_plans(df.limit(0)).count() == 0
