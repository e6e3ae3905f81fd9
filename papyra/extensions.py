"""Where callers plug in: resolvers of identifiers, progress callbacks, and the table of commands."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: A resolver takes rows (scheme, value) and gives rows (scheme, value, path), at most one each.
Resolver = Callable[[DataFrame], DataFrame]


def resolved_by(citations: DataFrame, resolvers: list[Resolver]) -> DataFrame:
    """Citations (scheme, value, ..) with the path that the first resolver that knows the identifier gives, else null.

    Each resolver is asked once for the different identifiers; one that gives an identifier twice counts by its least path.
    """
    asked = citations.select("scheme", "value").where(F.col("value").isNotNull()).distinct()
    found = None
    for place, resolve in enumerate(resolvers):
        own = resolve(asked).groupBy("scheme", "value").agg(F.min("path").alias("path")).where(F.col("path").isNotNull()).withColumn("place", F.lit(place))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return citations.withColumn("path", F.lit(None).cast("string"))
    first = found.groupBy("scheme", "value").agg(F.min_by("path", "place").alias("path"))
    return citations.join(first, ["scheme", "value"], "left").select(*citations.columns, "path")


class Progress(StreamingQueryListener):
    """Calls back with (query name, batch, rows read so far, whether it has ended) after each batch of a stream, and at its end."""

    def __init__(self, callback: Callable[[str, int, int, bool], None]):
        self.callback, self.seen = callback, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.seen[str(event.runId)] = [event.name or "", -1, 0]

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        state = self.seen.setdefault(str(p.runId), [p.name or "", -1, 0])
        state[1], state[2] = p.batchId, state[2] + p.numInputRows
        self.callback(*state, False)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        state = self.seen.pop(str(event.runId), ["", -1, 0])
        self.callback(*state, True)


@dataclass(frozen=True)
class Command:
    """A command: needs names facts that must hold for it to run, and why it can't where one doesn't."""

    id: str
    title: str
    group: str
    keywords: tuple[str, ...] = ()
    shortcut: str | None = None
    needs: tuple[str, ...] = ()


@dataclass
class Commands:
    """Commands by id, in the order they were added."""

    known: dict[str, Command] = field(default_factory=dict)

    def add(self, command: Command) -> None:
        if command.id in self.known:
            raise ValueError(f"two commands named {command.id}")
        self.known[command.id] = command

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c.id, c.title, c.group, list(c.keywords), c.shortcut, list(c.needs)) for i, c in enumerate(self.known.values())]
        return spark.createDataFrame(rows, "at int, key string, title string, group string, keywords array<string>, shortcut string, needs array<string>")

    def offered(self, contexts: DataFrame) -> DataFrame:
        """Each context (owner, facts) with every command: enabled, and the first fact that is missing. The commands are few."""
        missing = F.filter("needs", lambda n: ~F.array_contains("facts", n))
        rows = contexts.join(F.broadcast(self.table(contexts.sparkSession)))
        return rows.select("owner", "at", "key", "title", "group", "keywords", "shortcut", (F.size(missing) == 0).alias("enabled"), F.get(missing, F.lit(0)).alias("reason"))


def standard_commands() -> Commands:
    out = Commands()
    for c in (
        Command("file.open", "Open", "File", ("load",), "mod+o"), Command("file.save", "Save", "File", (), "mod+s", ("document", "unsaved")), Command("edit.undo", "Undo", "Edit", (), "mod+z", ("document", "history")),
        Command("page.delete", "Delete Page", "Page", ("remove",), None, ("document", "pages")), Command("tabs.next", "Next Tab", "Tabs", ("switch",), "ctrl+tab", ("tabs",)), Command("search.library", "Search Library", "Search", ("find",), "mod+shift+f", ("library",)),
    ):
        out.add(c)
    return out
