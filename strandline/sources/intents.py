"""Records of work on a store, so that what a killed writer left is known and cleared.

A writer says in root/_work/<id>.json which folders it is about to make or to delete and
on which revision of the catalog it builds, before it does either, and takes the record
away when it is done.  The catalog alone decides what is loaded: a revision is published
by a rename that fails where another writer was first, so work that builds on an older
revision than the last can never be published any more.  What such a record names and the
catalog doesn't is left over, and may go.  Work on the last revision may still be going on;
it is left alone unless the caller fences it off by a new revision of the same content.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from strandline.sources import files


@dataclass
class Intent:
    """What a writer does: kind and label of the work, the revision it builds on, folders it makes,
    folders it deletes, and folders that it takes out of the catalog and keeps."""

    kind: str
    label: str
    revision: int
    makes: list[str] = field(default_factory=list)
    deletes: list[str] = field(default_factory=list)
    keeps: list[str] = field(default_factory=list)
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    started_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat(timespec="seconds"))

    @property
    def staging(self) -> str:
        return f".staging/{self.id}"


class Journal:
    """The records of a store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, intent_id: str) -> str:
        return f"{self.root}/_work/{intent_id}.json"

    def begin(self, intent: Intent) -> Intent:
        """Writes the record, whole or not at all."""
        aside = f"{self.root}/_work/.{intent.id}"
        files.write_text(self.spark, aside, json.dumps(asdict(intent), indent=1))
        files.rename(self.spark, aside, self._path(intent.id))
        return intent

    def end(self, intent: Intent) -> None:
        files.remove(self.spark, self._path(intent.id))

    def open(self) -> list[Intent]:
        """The records that are there, the oldest first."""
        names = [n for n in files.list_names(self.spark, f"{self.root}/_work") if n.endswith(".json") and not n.startswith(".")]
        found = []
        for n in names:
            try:
                found.append(Intent(**json.loads(files.read_bytes(self.spark, f"{self.root}/_work/{n}"))))
            except Exception:
                if files.exists(self.spark, f"{self.root}/_work/{n}"):
                    raise
                # its writer has just ended
        return sorted(found, key=lambda i: (i.started_at, i.id))

    def clear_asides(self) -> None:
        """Deletes records and revisions that were written and not put in place; only after a fence."""
        for folder, start in ((f"{self.root}/_work", "."), (self.root, ".catalog-")):
            for n in files.list_names(self.spark, folder):
                if n.startswith(start) and not n.endswith(".crc"):
                    files.remove(self.spark, f"{folder}/{n}")

    def clear(self, intent: Intent, named: set[str]) -> str:
        """Deletes what is left of work that can't be published any more; says what it came to.

        ``named``: the folders that the catalog names.  Clearing twice does no harm.
        """
        published = not intent.makes or any(m in named for m in intent.makes)
        gone = published and not any(d in named for d in intent.deletes + intent.keeps)
        files.remove(self.spark, f"{self.root}/{intent.staging}")
        for folder in intent.makes + (intent.deletes if gone else []):
            if folder not in named:
                files.remove(self.spark, f"{self.root}/{folder}")
        self.end(intent)
        return "finished" if gone else "undone"
