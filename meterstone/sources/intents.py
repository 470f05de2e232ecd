"""Several tables changed as one: staged partitions, an intent record, and its replay.

New partitions of all tables are written below ``<root>/intents/<id>``. Then the record says which
partitions they replace; its rename into place is the commit. Partitions are moved
after that, which may be done again and again. What a crash leaves behind is found at the
next start: an intent with a record is carried out to its end, one without is dropped.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

RECORD = "record.json"


class Intents:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def begin(self) -> str:
        return f"{self.root}/intents/{uuid.uuid4().hex}"

    def _names(self, folder: str) -> list[str]:
        top = self._path(folder)
        return [e.getPath().getName() for e in self._files.listStatus(top)] if self._files.exists(top) else []

    def staged(self, intent: str, table: str) -> list[str]:
        """Partitions of a table that an intent has written."""
        return sorted(n for n in self._names(f"{intent}/{table}") if "=" in n)

    def commit(self, intent: str, emptied: dict[str, list[str]]) -> None:
        """Record the intent, then carry it out. ``emptied``: partitions that end, by table."""
        tables = {t: self.staged(intent, t) for t in self._names(intent)}
        record = {t: {"moved": tables.get(t, []), "emptied": emptied.get(t, [])} for t in {*tables, *emptied}}
        draft = self._path(f"{intent}/{RECORD}.draft")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        self._rename(draft, f"{intent}/{RECORD}")
        self.carry_out(intent)

    def _rename(self, source, target: str) -> None:
        if not self._files.rename(source, self._path(target)):
            raise OSError(f"cannot rename to {target}")

    def carry_out(self, intent: str) -> None:
        lines = self.spark.read.text(f"{intent}/{RECORD}", wholetext=True).first()
        for table, parts in json.loads(lines[0]).items():
            for name in parts["emptied"]:
                self._files.delete(self._path(f"{self.root}/{table}/{name}"), True)
            for name in parts["moved"]:
                source = self._path(f"{intent}/{table}/{name}")
                if self._files.exists(source):  # else an earlier attempt has moved it
                    target = self._path(f"{self.root}/{table}/{name}")
                    self._files.delete(target, True)
                    self._files.mkdirs(target.getParent())
                    self._rename(source, f"{self.root}/{table}/{name}")
        self._files.delete(self._path(intent), True)

    def recover(self) -> list[str]:
        """Finish or drop what a crash has left; what was finished."""
        done = []
        for name in self._names(f"{self.root}/intents"):
            intent = f"{self.root}/intents/{name}"
            if RECORD in self._names(intent):
                self.carry_out(intent)
                done.append(name)
            else:
                self._files.delete(self._path(intent), True)
        return done
