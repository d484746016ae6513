"""Warehouse tables as Parquet folders, with a manifest that says which folders count.

Batch loads and streams write in the same layout: every load adds a folder of its own below
`<table>/data`, facts with one folder for each month in it, and then a new manifest that names all folders
of the table. A reader takes the newest complete manifest. So a load that fails, at whatever point, leaves the
table as it was; a load that is run again under the same commit name is skipped; and a merge writes
the months it touches and leaves all other folders alone.

One writer at a time may work on a table; two that start from the same state write the same manifest
number, and the second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.periods import as_date, within

# column that gives the month a table's folders are split by
DAYS = {
    "fact_operations": "date",
    "fact_ticket": "created_date",
    "fact_market_signal": "signal_date",
    "fact_operations_record": "date",
    "fact_ticket_record": "created_at",
    "fact_signal_record": "signal_date",
    "daily_ticket": "created_date",
    "daily_operations": "date",
}
MONTH = "month"


class Entry(NamedTuple):
    """A folder of a table ('' for a load without rows), its month, and the load that wrote it."""

    folder: str
    month: str | None
    commit: str
    rows: int


@dataclass(frozen=True)
class Warehouse:
    """`retain` manifests are kept, at least the current one: a reader may go on with a state that was
    current when it started until `retain - 1` more loads replaced months of the table."""

    spark: SparkSession
    root: str
    retain: int = 2

    # --- files ---------------------------------------------------------------------
    def _path(self, relative: str):
        """The Hadoop path below the root, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _glob(self, pattern: str) -> list[str]:
        path, system = self._path(pattern)
        return sorted(f.getPath().toString() for f in system.globStatus(path) or [])

    def _delete(self, relative: str) -> None:
        path, system = self._path(relative)
        system.delete(path, True)

    def _numbers(self, table: str) -> list[int]:
        """Numbers of the manifests; a manifest gets its name when it is complete."""
        return [int(p.split("/")[-1].removesuffix(".json")) for p in self._glob(f"{table}/manifest/*.json")]

    def _entries(self, table: str, number: int) -> list[Entry]:
        """The entries of a manifest, one for each live folder and month."""
        path, system = self._path(f"{table}/manifest/{number:09d}.json")
        stream = system.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Entry(*e) for e in json.loads(text)]

    def _write_manifest(self, table: str, number: int, entries: list[Entry]) -> None:
        draft, system = self._path(f"{table}/manifest/{uuid.uuid4().hex}.draft")
        stream = system.create(draft, False)
        try:
            stream.write(json.dumps(entries).encode())
        finally:
            stream.close()
        final, _ = self._path(f"{table}/manifest/{number:09d}.json")
        if system.exists(final) or not system.rename(draft, final):
            raise RuntimeError(f"{table}: another load has written manifest {number}")

    def _state(self, table: str) -> tuple[int, list[Entry]]:
        numbers = self._numbers(table)
        return (numbers[-1], self._entries(table, numbers[-1])) if numbers else (0, [])

    def path(self, table: str) -> str:
        """The folder of the newest load."""
        _, entries = self._state(table)
        loads = sorted(e.folder.split("/")[0] for e in entries if e.folder)
        return f"{self.root}/{table}/data/{loads[-1]}" if loads else f"{self.root}/{table}/data"

    # --- reading -------------------------------------------------------------------
    def _read(self, table: str, entries: list[Entry]) -> DataFrame | None:
        base = f"{self.root}/{table}/data"
        folders = [f"{base}/{e.folder}" for e in entries if e.folder]
        if not folders:
            return None
        reader = self.spark.read.option("basePath", base)
        if table not in DAYS:  # small tables, whose columns differ between batch and stream audits
            reader = reader.option("mergeSchema", True)
        return reader.parquet(*folders).drop("load")

    def read(self, table: str) -> DataFrame | None:
        """The table, or None while it has no rows."""
        return self._read(table, self._state(table)[1])

    def loaded(self, table: str, commit: str) -> DataFrame | None:
        """The rows that one load wrote, as far as no later merge rewrote them."""
        return self._read(table, [e for e in self._state(table)[1] if e.commit == commit])

    def read_between(self, table: str, start, end) -> DataFrame:
        """Rows of a fact from start to end: months prune folders, days prune row groups."""
        rows, first = self.read(table), as_date(start).replace(day=1)
        months = F.col(MONTH).between(F.lit(first), F.lit(as_date(end)))
        return within(rows.filter(months), DAYS[table], start, end).drop(MONTH)

    # --- writing -------------------------------------------------------------------
    def _add(
        self, table: str, rows: DataFrame, number: int, commit: str,
        layout: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> list[Entry]:
        """Write a new folder; nobody reads it before a manifest names it.

        Facts go by month, in files of even size and sorted by day. The rebalance hint groups rows by
        month; AQE then splits a month that holds much of the data over several tasks and joins
        small ones, which a plain repartition by the month would not. `layout` is applied after that.
        """
        load = f"load={number:09d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/{table}/data/{load}"
        day = DAYS.get(table)
        if day is None:
            layout(rows).write.parquet(path)
            return [Entry(load, None, commit, self.spark.read.parquet(path).count())]
        rows = layout(rows.withColumn(MONTH, F.trunc(day, "month")).hint("rebalance", MONTH))
        rows = rows.withColumn(MONTH, F.trunc(day, "month"))
        rows.sortWithinPartitions(MONTH, day).write.partitionBy(MONTH).parquet(path)
        months = [p.split("/")[-1] for p in self._glob(f"{table}/data/{load}/{MONTH}=*")]
        if not months:
            return [Entry("", None, commit, 0)]
        counts = self.spark.read.parquet(path).count()  # from the files' footers
        return [Entry(f"{load}/{m}", m.removeprefix(f"{MONTH}="), commit, counts) for m in months]

    def _switch(self, table: str, number: int, entries: list[Entry]) -> None:
        """Make `entries` the table's state, then drop what no retained manifest names."""
        self._write_manifest(table, number, entries)
        numbers = self._numbers(table)
        old, kept = numbers[: -self.retain], numbers[-self.retain :]
        if not old:
            return
        named = {e.folder for n in kept for e in self._entries(table, n)}
        for n in old:
            for folder in {e.folder for e in self._entries(table, n)} - named - {""}:
                self._delete(f"{table}/data/{folder}")
            self._delete(f"{table}/manifest/{n:09d}.json")

    def append(
        self, table: str, rows: DataFrame, commit: str | None = None,
        layout: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> int:
        """Add rows; returns their number. A `commit` that the table already holds adds nothing.

        `layout` makes the table's columns of `rows` row by row, once they are dealt to months: keys and other
        columns that follow from the rest are not shuffled. A fact's day has the same name and value on both sides.
        """
        number, entries = self._state(table)
        done = [e for e in entries if commit is not None and e.commit == commit]
        if done:
            return done[0].rows
        new = self._add(table, rows, number + 1, commit or uuid.uuid4().hex, layout)
        self._switch(table, number + 1, entries + new)
        return new[0].rows

    def replace(self, table: str, rows: DataFrame) -> None:
        """Give a table a new state, which may be computed from the old one."""
        number, entries = self._state(table)
        new = self._add(table, rows, number + 1, uuid.uuid4().hex)
        self._switch(table, number + 1, [e._replace(folder="", month=None) for e in _commits(entries)] + new)

    def merge(
        self, table: str, incoming: DataFrame, key: str,
        change: Callable[[DataFrame, DataFrame], DataFrame], commit: str | None = None,
    ) -> list[str]:
        """Copy on write: `change(stored, incoming)` is the new state of the months that hold a known key.

        `incoming` should be a written table, it is read twice. Which months hold its keys is found from the key
        column alone; only those months are read whole and written anew. Rows with unknown keys are added to their
        own months, whose folders stay as they are. Tables without months are rewritten whole. Returns the months
        that were rewritten.
        """
        number, entries = self._state(table)
        if commit is not None and any(e.commit == commit for e in entries):
            return []
        commit = commit or uuid.uuid4().hex
        stored = self._read(table, entries)
        if stored is None:
            new = self._add(table, incoming, number + 1, commit)
            self._switch(table, number + 1, entries + new)
            return []
        touched: list[str] = []
        live = entries
        if table in DAYS:
            hits = stored.join(incoming.select(key), key, "left_semi").select(F.col(MONTH).cast("string")).distinct()
            touched = sorted(r[0] or "__HIVE_DEFAULT_PARTITION__" for r in hits.collect())  # a value a month
            live = [e for e in entries if e.month in touched]
        held = self._read(table, live)
        held = stored.limit(0) if held is None else held
        held = held.drop(MONTH) if table in DAYS else held
        new = self._add(table, change(held, incoming), number + 1, commit)
        gone = {e.folder for e in live}
        kept = [e for e in entries if e.folder not in gone]
        lost = [e._replace(folder="", month=None) for e in _commits(entries) if e.commit not in {k.commit for k in kept}]
        self._switch(table, number + 1, kept + lost + new)
        return touched


def _commits(entries: list[Entry]) -> list[Entry]:
    """One entry of each commit."""
    return list({e.commit: e for e in entries}.values())


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV as it stands: blanks around values are kept."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
