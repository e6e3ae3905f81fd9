"""The edit log of a document: operations on pages, annotations and form fields, their inverses, and the plan they come to.

A log is replayed by a fold over its rows in order; what is kept between rows is the document's state and a bounded history.
Rows are (doc, seq, action, op): action is do, undo, redo, save or adopt, op a JSON object with a type.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.operators.folds import Fold, fold

HISTORY = 200
#: Kinds of annotations that a plan writes, and the fields that make an annotation what it is.
KINDS = ["highlight", "ink", "rect", "note"]
FIELDS = ["kind", "rect", "color", "opacity", "strokeWidth", "quads", "strokes", "text", "fontSizePt"]


def fingerprint(annotation: dict) -> str:
    return json.dumps([annotation.get(f) for f in FIELDS], separators=(",", ":"), ensure_ascii=False, sort_keys=True)


class Document:
    """State that operations change. Operations on pages or annotations that are not there change nothing."""

    def __init__(self):
        self.pages: list[dict] = []
        self.annotations: dict[str, list[dict]] = {}
        self.form: dict[str, str] = {}
        self.adopted: dict[str, str] = {}
        self.adopted_at: dict[str, list[int]] = {}
        self.ids = 0

    def new_id(self, prefix: str) -> str:
        self.ids += 1
        return f"{prefix}-{self.ids}"

    def at(self, page: str) -> int:
        return next((i for i, p in enumerate(self.pages) if p["id"] == page), -1)

    def place(self, page: str, annotation: str) -> int:
        return next((i for i, a in enumerate(self.annotations.get(page, [])) if a["id"] == annotation), -1)

    def filled(self, op: dict) -> dict:
        """The operation with ids for what it makes, so that doing it again makes the same."""
        if op["type"] == "duplicate":
            op = {"newId": self.new_id("pg"), **op}
            return {"annotIds": [self.new_id("an") for _ in self.annotations.get(op["pageId"], [])], **op}
        return {"newId": self.new_id("pg"), **op} if op["type"] == "addBlank" else op

    def inverse(self, op: dict) -> dict:
        kind, page = op["type"], op.get("pageId")
        if kind == "reorder":
            return {"type": kind, "pageId": page, "toIndex": self.at(page)}
        if kind == "delete":
            i = self.at(page)
            return {"type": "restorePage", "index": i, "entry": copy.deepcopy(self.pages[i]) if i >= 0 else None, "annots": copy.deepcopy(self.annotations.get(page, []))}
        if kind in ("duplicate", "addBlank"):
            return {"type": "delete", "pageId": op["newId"]}
        if kind == "rotate":
            return {"type": kind, "pageId": page, "delta": (360 - op["delta"]) % 360}
        if kind == "addAnnot":
            return {"type": "deleteAnnot", "pageId": op["annot"]["pageId"], "id": op["annot"]["id"]}
        if kind == "patchAnnot":
            i = self.place(page, op["id"])
            old = self.annotations[page][i] if i >= 0 else None
            return {"type": kind, "pageId": page, "id": op["id"], "patch": {k: copy.deepcopy(old.get(k)) for k in op["patch"]} if old else {}}
        if kind == "deleteAnnot":
            i = self.place(page, op["id"])
            return {"type": "restoreAnnot", "pageId": page, "index": i, "annot": copy.deepcopy(self.annotations[page][i]) if i >= 0 else None}
        if kind == "setForm":
            return {"type": "restoreForm", "field": op["field"], "prev": self.form.get(op["field"])}
        raise ValueError(f"an operation that only undoes: {kind}")

    def run(self, op: dict) -> None:
        getattr(self, f"_{op['type']}")(op, op.get("pageId"))

    def _reorder(self, op, page):
        if (i := self.at(page)) >= 0:
            self.pages.insert(op["toIndex"], self.pages.pop(i))

    def _delete(self, op, page):
        if (i := self.at(page)) >= 0:
            del self.pages[i]
            self.annotations.pop(page, None)

    def _duplicate(self, op, page):
        if (i := self.at(page)) >= 0:
            self.pages.insert(i + 1, {**self.pages[i], "id": op["newId"]})
            own = zip(copy.deepcopy(self.annotations.get(page, [])), op["annotIds"], strict=False)
            self.annotations[op["newId"]] = [{**a, "id": new, "pageId": op["newId"]} for a, new in own]

    def _rotate(self, op, page):
        if (i := self.at(page)) >= 0:
            self.pages[i]["rotation"] = (self.pages[i]["rotation"] + op["delta"]) % 360

    def _addBlank(self, op, page):  # noqa: N802
        self.pages.insert(op["index"], {"id": op["newId"], "src": None, "width": op["widthPt"], "height": op["heightPt"], "rotation": 0})

    def _addAnnot(self, op, page):  # noqa: N802
        self.annotations.setdefault(op["annot"]["pageId"], []).append(copy.deepcopy(op["annot"]))

    def _patchAnnot(self, op, page):  # noqa: N802
        if (i := self.place(page, op["id"])) >= 0:
            self.annotations[page][i].update(copy.deepcopy(op["patch"]))

    def _deleteAnnot(self, op, page):  # noqa: N802
        if (i := self.place(page, op["id"])) >= 0:
            del self.annotations[page][i]

    def _setForm(self, op, page):  # noqa: N802
        self.form[op["field"]] = op["value"]

    def _restorePage(self, op, page):  # noqa: N802
        if op["entry"] is not None:
            self.pages.insert(op["index"], copy.deepcopy(op["entry"]))
            self.annotations[op["entry"]["id"]] = copy.deepcopy(op["annots"])

    def _restoreAnnot(self, op, page):  # noqa: N802
        if op["annot"] is not None:
            self.annotations.setdefault(page, []).insert(op["index"], copy.deepcopy(op["annot"]))

    def _restoreForm(self, op, page):  # noqa: N802
        if op["prev"] is None:
            self.form.pop(op["field"], None)
        else:
            self.form[op["field"]] = op["prev"]

    def open(self, sizes: list) -> None:
        """Pages of a file of these sizes, (width, height) each."""
        self.pages = [{"id": self.new_id("pg"), "src": i, "width": float(w), "height": float(h), "rotation": 0} for i, (w, h) in enumerate(sizes)]

    def adopt(self, by_page: list[dict]) -> None:
        """Takes over a file's annotations, (src, annots) each: every copy of a page gets its own. No edit, so no history."""
        self.adopted, self.adopted_at = {}, {}
        for found in by_page:
            for page in [p for p in self.pages if p["src"] == found["src"]]:
                own = [{**copy.deepcopy(a), "id": self.new_id("an")} for a in found["annots"]]
                self.adopted |= {a["id"]: fingerprint(a) for a in own}
                self.adopted_at[page["id"]] = list(dict.fromkeys(a["srcAnnotIndex"] for a in own if a.get("srcAnnotIndex", -1) >= 0))
                self.annotations.setdefault(page["id"], []).extend(own)

    def plan(self) -> list[dict]:
        """What saving writes: of each page the annotations that are new or changed, and the file's own to drop for that."""
        out = []
        for page in self.pages:
            every = self.annotations.get(page["id"], [])
            same = [a for a in every if self.adopted.get(a["id"]) == fingerprint(a)]
            kept, own = {a.get("srcAnnotIndex") for a in same}, self.adopted_at.get(page["id"], [])
            new = [a for a in every if a not in same]
            out.append({
                **page, "annots": [a["kind"] for a in new if a["kind"] in KINDS], "texts": [a.get("text") or "" for a in new if a["kind"] == "textbox"],
                "images": [a.get("sourcePath") for a in new if a["kind"] == "image" and a.get("sourcePath")], "drop": [i for i in own if i not in kept], "owned": own,
            })
        return out


class Editing(Fold):
    """Replays a log with undo, redo and savepoint. The last HISTORY operations can be undone."""

    def __init__(self):
        self.document, self.done, self.undone, self.saved = Document(), [], [], 0

    def dirty(self) -> bool:
        return self.saved is None or len(self.done) != self.saved

    def act(self, action: str, op: dict) -> None:
        if action == "open":
            self.__init__()
            self.document.open(op["sizes"])
        elif action == "adopt":
            self.document.adopt(op["pages"])
        elif action == "save":
            self.saved = len(self.done)
        elif action == "undo" and self.done:
            self.undone.append(self.done.pop())
            self.document.run(self.undone[-1][1])
        elif action == "redo" and self.undone:
            self.done.append(self.undone.pop())
            self.document.run(self.done[-1][0])
        elif action == "do":
            op = self.document.filled(op)
            inverse = self.document.inverse(op)
            self.document.run(op)
            if self.undone and self.saved is not None and self.saved > len(self.done):
                self.saved = None  # the saved state can't be come back to
            self.undone = []
            self.done.append((op, inverse))
            if len(self.done) > HISTORY:
                del self.done[0]
                if self.saved is not None:
                    self.saved = self.saved - 1 if self.saved else None

    def step(self, row: dict) -> Iterator[tuple]:
        self.act(row["action"], json.loads(row["op"] or "{}"))
        return iter(())


class Planned(Editing):
    def finish(self) -> Iterator[tuple]:
        for at, p in enumerate(self.document.plan()):
            yield at, p["src"], p["width"], p["height"], p["rotation"], p["annots"], p["texts"], p["images"], p["drop"], p["owned"]


PLAN = "at int, src int, width double, height double, rotation int, annots array<string>, texts array<string>, images array<string>, drop array<int>, owned array<int>"


class Stated(Editing):
    """Gives the state after each row."""

    def step(self, row: dict) -> Iterator[tuple]:
        super().step(row)
        d = self.document
        yield row["seq"], [p["id"] for p in d.pages], sum(map(len, d.annotations.values())), len(d.form), len(self.done), len(self.undone), self.dirty()


STATE = "seq long, pages array<string>, annotations int, fields int, undo int, redo int, dirty boolean"


def edit_plans(log: DataFrame, doc: str = "doc") -> DataFrame:
    """The plan after each document's whole log: rows (doc, PLAN), a row a page."""
    return fold(log.select(doc, "seq", "action", "op"), [doc], ["seq"], Planned, PLAN)


def edit_states(log: DataFrame, doc: str = "doc") -> DataFrame:
    """Pages, counts, history and whether there is something to save, after each row of the log."""
    return fold(log.select(doc, "seq", "action", "op"), [doc], ["seq"], Stated, STATE)


def annotation_key(annotation: Column) -> Column:
    """What tells whether an annotation, a struct with FIELDS, was changed: its fields as JSON; absent ones are null."""
    return F.to_json(F.struct(*[annotation[f].alias(f) for f in FIELDS]), {"ignoreNullFields": "false"})


def without_annotations(plan: DataFrame) -> DataFrame:
    """The plan of the document without markup: nothing written, all that the file's pages own dropped."""
    none = lambda c: F.array().cast(plan.schema[c].dataType).alias(c)
    return plan.select(*[none(c) if c in ("annots", "texts", "images") else F.col("owned").alias(c) if c == "drop" else c for c in plan.columns])


def limited(plan: DataFrame, pages: Column, doc: str = "doc") -> DataFrame:
    """The pages of a plan that `pages` (an array of indices, null: all) names, numbered anew in ascending order."""
    from pyspark.sql import Window as W

    kept = plan.withColumn("__pages", pages).where(F.col("__pages").isNull() | F.array_contains("__pages", F.col("at"))).drop("__pages")
    return kept.withColumn("at", (F.row_number().over(W.partitionBy(doc).orderBy("at")) - 1).cast("int"))


def filled_form(widgets: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds new to widgets (doc, name, kind, value): the first value by `at` that the plan (doc, at, name, value) has for the name of a text field; null leaves the field."""
    first = plan.groupBy("doc", "name").agg(F.min_by("value", "at").alias("new"))
    return widgets.join(first, ["doc", "name"], "left").withColumn("new", F.when(F.col("kind") == "text", F.col("new")))


def reordered(items: Column, source: Column, target: Column) -> Column:
    """An array with the item at source moved to target, both from 0; out of range nothing moves."""
    left = F.filter(items, lambda x, i: i != source)
    moved = F.concat(F.slice(left, F.lit(1), target), F.slice(items, source + 1, F.lit(1)), F.slice(left, target + 1, F.size(items)))
    inside = (source >= 0) & (source < F.size(items)) & (target >= 0) & (target < F.size(items))
    return F.when(inside, moved).otherwise(items)


def imports(plan: DataFrame, doc: str = "doc") -> DataFrame:
    """Groups a plan's pages as a writer imports them: a run of successive source pages is one import, each blank page its own.

    Rows (doc, batch, kind, first, pages, edits): edits counts pages that need more than the import.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy(doc).orderBy("at")
    breaks = F.when(F.col("src").isNotNull() & (F.col("src") == F.lag("src").over(order) + 1), 0).otherwise(1)
    rows = plan.withColumn("__b", breaks).withColumn("batch", F.sum("__b").over(order).cast("int"))
    edited = (F.col("rotation") != 0) | (F.size("annots") + F.size("texts") + F.size("images") + F.size("drop") > 0)
    kind = F.when(F.first("src").isNull(), "blank").otherwise("import")
    return rows.groupBy(doc, "batch").agg(kind.alias("kind"), F.min("src").alias("first"), F.count("*").alias("pages"), F.count_if(edited).alias("edits"))
