"""What a folder of tables consists of, committed file by file, so that a reader never sees half a change.

Data go to folders of their own first; then one small file names them, put in place by a rename. A base names a folder
for every table; the base with the highest number counts. An append names further folders of some tables under one base;
its file is called after its batch, so a batch is there once however often it is sent. What no file names is not read:
writes that broke off leave nothing but dead folders, which ``Snapshots.sweep`` removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Snapshot:
    """A base and the appends to it that were there: the folders of every table, the appends' files, all batches so far."""

    base: int
    folders: dict[str, list[str]]
    appends: list[str]
    batches: list[str]


class Snapshots:
    """The commits of one folder, on any file system that Spark reads. Only names pass through the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        where = self._at(folder)
        found = [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(n for n in found if not n.startswith((".", "_")))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, content: dict) -> bool:
        """The file under its name, whole or not at all; False if one is there already."""
        folder, _, file = name.rpartition("/")
        draft = self._at(f"{folder}/.{file}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(content, sort_keys=True).encode())
        out.close()
        done = not self._fs.exists(self._at(name)) and self._fs.rename(draft, self._at(name))
        if not done:
            self._fs.delete(draft, False)
        return done

    def new_folder(self, table: str) -> str:
        """Where data of a table may be written; its last part looks like a partition, so folders can be read together."""
        return f"{self.table_root(table)}/batch={uuid.uuid4().hex}"

    def table_root(self, table: str) -> str:
        return f"{self.path}/data/{table}"

    def base(self) -> int | None:
        """Number of the base that counts."""
        names = [n for n in self._names("bases") if n.endswith(".json")]
        return int(names[-1].removesuffix(".json")) if names else None

    def replace(self, content: dict, base: int | None, folded: Iterable[str] = ()) -> None:
        """A new base in the place of ``base``: ``content`` is a folder per table, or names that are no folders under
        ``batches``. ``folded`` are the appends to the former base (by ``appends``) that are in it. A second writer that
        took the same number meanwhile is an error, and the first one's base counts."""
        number = (base or 0) + 1
        if not self._put(f"bases/{number:09d}.json", {**content, "folded": sorted(folded)}):
            raise FileExistsError(f"another writer has put base {number} of {self.path} in place")

    def content(self, base: int) -> dict:
        return self._read(f"bases/{base:09d}.json")

    def appends(self, base: int) -> dict[str, dict]:
        """What has been appended to a base, by the name of its file."""
        return {n: self._read(f"appends/{base:09d}/{n}") for n in self._names(f"appends/{base:09d}")}

    @staticmethod
    def _file(batch: str) -> str:
        return f"{uuid.uuid5(uuid.NAMESPACE_URL, batch).hex}.json"

    def appended(self, base: int, batch: str) -> bool:
        """Whether a batch is appended to this base, or is one of those that were folded into it from the last."""
        return self._file(batch) in self.content(base)["folded"] or self._fs.exists(self._at(f"appends/{base:09d}/{self._file(batch)}"))

    def holds(self, batch: str) -> bool:
        base = self.base()
        return base is not None and (batch in self.content(base).get("batches", []) or self.appended(base, batch))

    def append(self, batch: str, folders: dict[str, str]) -> bool:
        """More data of some tables; False, and nothing added, if the batch is there.

        Should a new base come into place meanwhile, without this batch, the batch is appended to that one.
        """
        added = False
        while True:
            base = self.base()
            if base is None:
                raise FileNotFoundError(f"{self.path} has no base to append to")
            if not self.appended(base, batch):
                added |= self._put(f"appends/{base:09d}/{self._file(batch)}", {"batch": batch, "folders": folders})
            if self.base() == base:
                return added

    def current(self) -> Snapshot | None:
        """What is committed as of now, or None where nothing is."""
        base = self.base()
        if base is None:
            return None
        content, appends = self.content(base), self.appends(base)
        folders = {name: [f"{self.path}/{f}"] for name, f in content.items() if name not in ("batches", "folded")}
        for entry in appends.values():
            for table, folder in entry["folders"].items():
                folders.setdefault(table, []).append(f"{self.path}/{folder}")
        batches = {*content.get("batches", []), *(e["batch"] for e in appends.values())}
        return Snapshot(base, folders, sorted(appends), sorted(batches))

    def relative(self, folder: str) -> str:
        return folder.removeprefix(self.path + "/")

    def sweep(self) -> list[str]:
        """Removes data folders that the current snapshot does not name; to be run while nobody reads or writes."""
        current = self.current()
        if current is None:
            return []
        named = {self.relative(f) for folders in current.folders.values() for f in folders}
        dead = [f"data/{table}/{f}" for table in self._names("data") for f in self._names(f"data/{table}") if f"data/{table}/{f}" not in named]
        for folder in dead:
            self._fs.delete(self._at(folder), True)
        return dead
