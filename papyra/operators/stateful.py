"""State between events: caches with budgets, fair shares, hovering, scheduling and histories, as folds over each key's events."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.operators.folds import Fold, fold

#: Milliseconds of dwelling and leaving, results that hovering keeps, positions of a history, repeats of a cancelled job.
DWELL, LEAVE, RESULTS, POSITIONS, RETRIES = 200, 120, 50, 100, 2
#: Bytes that a cached page, run, box and link count.
PAGE_COST, BOX_COST, RUN_COST, LINK_COST = 64, 16, 48, 64


class Cache(Fold):
    """Events (seq, action, item, cost, budget): get, put, stale, drop (items that begin with item) and budget. Entries leave until
    what comes fits: stale ones first, then the least used lately. A hit makes an entry fresh again."""

    def __init__(self):
        self.kept: dict[str, list] = {}  # item: [fresh, tick, cost]
        self.order: list[tuple] = []
        self.used = self.tick = self.hits = self.lookups = 0
        self.budget = None

    def touch(self, item: str) -> None:
        heapq.heappush(self.order, (*self.kept[item][:2], item))

    def shrink(self, to: int) -> list[str]:
        gone = []
        while self.used > to and self.kept:
            fresh, tick, item = heapq.heappop(self.order)
            if self.kept.get(item, [None])[:2] == [fresh, tick]:  # else an older mark of it
                gone.append(item)
                self.used -= self.kept.pop(item)[2]
        return gone

    def step(self, e: dict) -> Iterator[tuple]:
        self.budget = e["budget"] if self.budget is None or e["action"] == "budget" else self.budget
        hit, gone, item = None, [], e["item"]
        if e["action"] == "get":
            self.lookups, self.tick, hit = self.lookups + 1, self.tick + 1, item in self.kept
            if hit:
                self.hits += 1
                self.kept[item][:2] = [1, self.tick]
                self.touch(item)
        elif e["action"] == "put" and e["cost"] <= self.budget:
            self.used -= self.kept.pop(item, [0, 0, 0])[2]
            gone = self.shrink(self.budget - e["cost"])
            self.tick += 1
            self.kept[item] = [1, self.tick, e["cost"]]
            self.used += e["cost"]
            self.touch(item)
        elif e["action"] in ("stale", "drop"):
            for k in [k for k in self.kept if k.startswith(item)]:
                if e["action"] == "drop":
                    self.used -= self.kept.pop(k)[2]
                elif self.kept[k][0]:
                    self.kept[k][0] = 0
                    self.touch(k)
        elif e["action"] == "budget":
            gone = self.shrink(self.budget)
        yield e["seq"], hit, sorted(gone), len(self.kept), self.used, self.hits, self.lookups


def cache_states(events: DataFrame, owner: str) -> DataFrame:
    """Rows (owner, seq, hit, evicted, entries, used, hits, lookups), one for each event of a cache."""
    schema = "seq long, hit boolean, evicted array<string>, entries int, used long, hits long, lookups long"
    return fold(events.select(owner, "seq", "action", "item", "cost", "budget"), [owner], ["seq"], Cache, schema)


def layout_cost(boxes: Column, runs: Column) -> Column:
    """Bytes of a cached page: its number of boxes, and its runs' texts."""
    return PAGE_COST + BOX_COST * boxes + F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + RUN_COST + F.octet_length(r))


def links_cost(uris: Column) -> Column:
    """Bytes of a page's cached links, null for those without address."""
    return PAGE_COST + F.aggregate(uris, F.lit(0).cast("long"), lambda n, u: n + LINK_COST + F.coalesce(F.octet_length(u), F.lit(0)))


class Shares(Fold):
    """Pages of documents under one budget: events (seq, action, doc, src, cost, budget). A page that doesn't fit takes room from
    the largest document, its highest pages first, until the asking one is largest; if it still doesn't fit, it stays out."""

    def __init__(self):
        self.pages: dict[int, dict[int, int]] = {}
        self.cut: set[int] = set()
        self.used, self.budget = 0, None

    def held(self, doc: int) -> int:
        return sum(self.pages.get(doc, {}).values())

    def take(self, doc: int) -> int:
        src = max(self.pages[doc])
        cost = self.pages[doc].pop(src)
        self.used -= cost
        self.cut.add(doc)
        return cost

    def reclaim(self, doc: int, need: int) -> None:
        while need > 0:
            others = [d for d in self.pages if d != doc and self.pages[d]]
            largest = max(others, key=lambda d: (self.held(d), -d), default=None)
            if largest is None or self.held(largest) <= self.held(doc):
                return
            need -= self.take(largest)

    def step(self, e: dict) -> Iterator[tuple]:
        if self.budget is None or e["action"] == "budget":
            self.budget = e["budget"]
        stored, doc = None, e["doc"]
        if e["action"] == "budget":
            while self.used > self.budget and self.used:
                self.take(max((max(p), d) for d, p in self.pages.items() if p)[1])
        elif e["action"] == "close":
            self.used -= self.held(doc)
            self.pages.pop(doc, None)
        else:
            own = self.pages.setdefault(doc, {})
            over = self.used - own.get(e["src"], 0) + e["cost"] - self.budget
            if over > 0:
                self.reclaim(doc, over)
            stored = self.used - own.get(e["src"], 0) + e["cost"] <= self.budget
            if stored:
                self.used += e["cost"] - own.get(e["src"], 0)
                own[e["src"]] = e["cost"]
            else:
                self.cut.add(doc)
        yield e["seq"], stored, self.used, sum(map(len, self.pages.values())), sorted(self.cut)


def shared_store(events: DataFrame, owner: str) -> DataFrame:
    """Rows (owner, seq, stored, used, pages, truncated), one for each event of a store that documents share."""
    schema = "seq long, stored boolean, used long, pages int, truncated array<long>"
    return fold(events.select(owner, "seq", "action", "doc", "src", "cost", "budget"), [owner], ["seq"], Shares, schema)


class Hover(Fold):
    """Events (ms, action, item, load_ms): enter, leave, popover, close. A load starts after dwelling, one at a time; the last
    one asked for waits; a result that came too late shows nothing. Gives each change of phase."""

    def __init__(self):
        self.phase, self.item, self.seq, self.back = "idle", None, 0, "shown"
        self.shown, self.flying = False, False
        self.queued: tuple | None = None
        self.timers: list[tuple] = []  # ms, order, what, seq, item, load
        self.made = 0
        self.dwell = self.leave = None
        self.known: dict[str, bool] = {}

    def after(self, ms: int, what: str, *rest) -> int:
        self.made += 1
        heapq.heappush(self.timers, (ms, self.made, what, *rest))
        return self.made

    def to(self, ms: int, phase: str) -> tuple:
        self.phase = phase
        return ms, phase, self.item, self.shown

    def load(self, ms: int, seq: int, item: str, load_ms: int) -> Iterator[tuple]:
        if seq == self.seq and self.item == item:
            self.shown = False
            yield self.to(ms, "loading")
            if self.flying:
                self.queued = (seq, item, load_ms)
            else:
                self.flying = True
                self.after(ms + load_ms, "loaded", seq, item, load_ms)

    def due(self, until: int | None) -> Iterator[tuple]:
        while self.timers and (until is None or self.timers[0][0] <= until):
            ms, made, what, seq, item, load_ms = heapq.heappop(self.timers)
            if what == "dwelt" and made == self.dwell:
                self.dwell = None
                yield from self.load(ms, seq, item, load_ms)
            elif what == "left" and made == self.leave:
                yield from self.close(ms)
            elif what == "loaded":
                self.flying = False
                if seq == self.seq and self.item == item:
                    self.known.pop(item, None)
                    self.known[item] = True
                    while len(self.known) > RESULTS:
                        del self.known[next(iter(self.known))]
                    self.shown = True
                    yield self.to(ms, "leaving" if self.phase == "leaving" else "shown")
                queued, self.queued = self.queued, None
                if queued and queued[0] == self.seq:
                    yield from self.load(ms, *queued)

    def close(self, ms: int) -> Iterator[tuple]:
        self.dwell = self.leave = self.queued = self.item = None
        self.seq, self.shown = self.seq + 1, False
        yield self.to(ms, "idle")

    def step(self, e: dict) -> Iterator[tuple]:
        ms = e["ms"]
        yield from self.due(ms)
        if e["action"] == "enter":
            self.dwell = self.leave = self.queued = None
            self.seq, self.item, self.shown = self.seq + 1, e["item"], e["item"] in self.known
            if self.shown:
                self.known[e["item"]] = self.known.pop(e["item"])
                yield self.to(ms, "shown")
            else:
                yield self.to(ms, "dwelling")
                self.dwell = self.after(ms + DWELL, "dwelt", self.seq, e["item"], e["load_ms"])
        elif e["action"] == "leave" and self.phase != "idle" and self.item is not None:
            self.dwell, self.back = None, self.phase
            yield self.to(ms, "leaving")
            self.leave = self.after(ms + LEAVE, "left", self.seq, self.item, 0)
        elif e["action"] == "popover":
            self.leave = None
            if self.phase == "leaving":
                phase = "shown" if self.shown else self.back
                yield self.to(ms, "loading" if phase == "leaving" else phase)
        elif e["action"] == "close":
            yield from self.close(ms)

    def finish(self) -> Iterator[tuple]:
        return self.due(None)


def hover_phases(events: DataFrame, owner: str) -> DataFrame:
    """Rows (owner, ms, phase, item, result), the changes that a pointer's events make."""
    return fold(events.select(owner, "ms", "action", "item", "load_ms"), [owner], ["ms", "item"], Hover, "ms long, phase string, item string, result boolean")


class Indexing(Fold):
    """Events (seq, action, doc, pages): request, front, stop, and page, which does one page of the active document. One document
    is indexed at a time: the one in front if it asks, else the one that asked first. Each start is a chain; what is left of an
    earlier one is dropped. Progress is told every `every` pages and at the end."""

    every = 32

    def __init__(self):
        self.waiting: list[int] = []
        self.todo: dict[int, int] = {}
        self.done: dict[int, int] = {}
        self.front, self.active, self.chain = None, None, 0

    def pick(self) -> None:
        if self.active is None and self.waiting:
            self.active = self.front if self.front in self.waiting else self.waiting[0]
            self.chain += 1

    def step(self, e: dict) -> Iterator[tuple]:
        doc, told = e["doc"], False
        if e["action"] == "request":
            if doc not in self.waiting:
                self.waiting.append(doc)
                self.todo.setdefault(doc, e["pages"])
        elif e["action"] == "front":
            self.front = doc
        elif e["action"] == "stop":
            self.waiting = [d for d in self.waiting if d != doc]
            self.active = None if self.active == doc else self.active
        elif self.active is not None and (e["pages"] is None or e["pages"] == self.chain):
            doc = self.active
            self.done[doc] = min(self.done.get(doc, 0) + 1, self.todo[doc])
            end = self.done[doc] >= self.todo[doc]
            told = end or self.done[doc] % self.every == 0
            if end:
                self.waiting, self.active = [d for d in self.waiting if d != doc], None
        self.pick()
        yield e["seq"], self.active, self.chain, len(self.waiting), self.done.get(doc, 0), told


def indexing_chains(events: DataFrame, owner: str) -> DataFrame:
    """Rows (owner, seq, active, chain, waiting, done, told), one for each event."""
    return fold(events.select(owner, "seq", "action", "doc", "pages"), [owner], ["seq"], Indexing, "seq long, active long, chain int, waiting int, done int, told boolean")


class History(Fold):
    """Events (seq, action, doc, top): push a position, pop the last one of a document, which drops those above it."""

    def __init__(self):
        self.entries: list[tuple] = []

    def step(self, e: dict) -> Iterator[tuple]:
        found = None
        if e["action"] == "push":
            self.entries = [*self.entries, (e["doc"], e["top"])][-POSITIONS:]
        else:
            while self.entries and found is None:
                doc, top = self.entries.pop()
                found = top if doc == e["doc"] else None
        yield e["seq"], found, len(self.entries)


def position_history(events: DataFrame, owner: str) -> DataFrame:
    """Rows (owner, seq, top, depth): where a pop goes back to, null if nowhere."""
    return fold(events.select(owner, "seq", "action", "doc", "top"), [owner], ["seq"], History, "seq long, top double, depth int")


def retried(jobs: DataFrame, bumps: DataFrame) -> DataFrame:
    """Adds tries and outcome to render jobs (doc, seq, stamp): a job that a bump (doc, at) makes stale before it runs comes again
    with the present stamp, RETRIES times; other kinds of jobs are never stale.

    The k-th try runs at `seq + k`; each bump in between cancels one try.
    """
    of = bumps.join(jobs.select("doc", "seq"), "doc").where((F.col("at") >= F.col("seq")) & (F.col("at") <= F.col("seq") + RETRIES)).groupBy("doc", "seq").agg(F.collect_set(F.col("at") - F.col("seq")).alias("hits"))
    rows = jobs.join(of, ["doc", "seq"], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<bigint>")))
    free = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(RETRIES).cast("long")), lambda k: ~F.array_contains("hits", k))
    first = F.when(F.col("render"), F.get(free, F.lit(0))).otherwise(F.lit(0))
    return rows.select("doc", "seq", F.coalesce(first + 1, F.lit(RETRIES + 1)).cast("int").alias("tries"), F.when(first.isNull(), "cancelled").otherwise("done").alias("outcome"))


def queue_order(jobs: DataFrame) -> DataFrame:
    """Adds turn to jobs (level, seq): the order of one queue over all documents, by level, then first come first served.

    Ranks of a level's jobs are counted from sorted ranges: a level's rows may be all rows, so no window holds a level.
    """
    spread = jobs.repartitionByRange("level", "seq").sortWithinPartitions("level", "seq")
    placed = spread.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33))
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__part", "before")
    return placed.join(F.broadcast(before), "__part").withColumn("turn", F.col("before") + F.col("__at") + 1).drop("__part", "__at", "before")


def metrics(states: DataFrame) -> DataFrame:
    """One row: hits, lookups and ratio over the last state of all caches (owner, seq, hits, lookups, used)."""
    last = states.groupBy("owner").agg(F.max_by(F.struct("hits", "lookups", "used"), "seq").alias("s")).select("s.*")
    return last.agg(F.sum("hits").alias("hits"), F.sum("lookups").alias("lookups"), F.sum("used").alias("used"), (F.sum("hits") / F.nullif(F.sum("lookups"), F.lit(0))).alias("ratio"))
