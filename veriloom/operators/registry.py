"""Versioned models in the shared store: artefacts, a log of commits, stage pointers, scoring by version.

A model is saved first, under a folder of its own; it becomes a version by one
entry in the log. Entries are numbered files that are written whole under another
name and then claim their number, so a reader sees an entry complete or not at
all, and of two writers one goes on with the next number. Nothing is ever changed:
stages follow from the log, and a rollback is one more entry.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("Staging", "Production", "Archived")
ENTRY = "number long, action string, version int, stage string, path string, metrics string, at string"


class ModelRegistry:
    """The versions of models below ``root``, which all executors and writers share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -------------------------------------------------------------- the log

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self, name: str) -> list[dict]:
        """Entries in the order of their numbers; one per commit, whatever the models hold."""
        folder, fs = self._fs(f"{self.root}/{name}/log")
        if not fs.exists(folder):
            return []
        rows = self.spark.read.schema(ENTRY).json(f"{self.root}/{name}/log/*.json") if any(
            s.getPath().getName().endswith(".json") for s in fs.listStatus(folder)) else None
        return [] if rows is None else [r.asDict() for r in rows.orderBy("number").collect()]

    def _claim(self, name: str, number: int, entry: dict) -> bool:
        """Writes an entry under its number unless another writer has; the claim file is created by one writer only."""
        base = f"{self.root}/{name}/log/{number:010d}"
        claim, fs = self._fs(f"{base}.claim")
        try:
            fs.create(claim, False).close()
        except Exception as error:  # any store's way to say that the file exists
            if fs.exists(claim):
                return False
            raise error
        part, _ = self._fs(f"{base}.{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps({**entry, "number": number}) + "\n", "utf-8"))
        out.close()
        target, _ = self._fs(f"{base}.json")
        return fs.rename(part, target)

    def _commit(self, name: str, make) -> dict:
        """Appends what ``make`` returns for the state it finds, and looks again whenever another writer was first."""
        skipped = 0
        while True:
            known = self._entries(name)
            entry, number = make(known), (known[-1]["number"] + 1 if known else 0) + skipped
            if self._claim(name, number, entry):
                return entry
            # a number without an entry is being written, or its writer was lost: the next one is free
            skipped = skipped + 1 if len(self._entries(name)) == len(known) else 0

    # -------------------------------------------------------------- versions

    @staticmethod
    def _stages(entries: list[dict]) -> dict[int, str]:
        stages: dict[int, str] = {}
        for e in entries:
            if e["stage"] == "Production":
                stages = {v: "Archived" if s == "Production" else s for v, s in stages.items()}
            stages[e["version"]] = e["stage"]
        return stages

    def register(self, name: str, model: PipelineModel, at: str, metrics: dict[str, float] | None = None) -> int:
        """Saves a fitted pipeline as the next version, in Staging."""
        path = f"{self.root}/{name}/models/{uuid.uuid4().hex}"
        model.write().save(path)

        def entry(known: list[dict]) -> dict:
            return {"action": "register", "version": 1 + max((e["version"] for e in known), default=0), "stage": "Staging", "path": path,
                    "metrics": json.dumps(metrics or {}), "at": at}
        return self._commit(name, entry)["version"]

    def _move(self, name: str, action: str, choose, stage: str, at: str) -> int:
        def entry(known: list[dict]) -> dict:
            return {"action": action, "version": choose(known), "stage": stage, "path": None, "metrics": None, "at": at}
        return self._commit(name, entry)["version"]

    def _known(self, entries: list[dict], version: int) -> int:
        if version not in {e["version"] for e in entries}:
            raise ValueError(f"no version {version}")
        return version

    def promote(self, name: str, version: int, at: str) -> int:
        """The version becomes Production, the one in production Archived."""
        return self._move(name, "promote", lambda known: self._known(known, version), "Production", at)

    def archive(self, name: str, version: int, at: str) -> int:
        return self._move(name, "archive", lambda known: self._known(known, version), "Archived", at)

    def rollback(self, name: str, at: str) -> int:
        """Back to the version that was in production before the current one; repeated, further back."""
        def previous(known: list[dict]) -> int:
            served: list[int] = []
            for e in known:
                if e["action"] == "promote" and (not served or served[-1] != e["version"]):
                    served.append(e["version"])
                elif e["action"] == "rollback":
                    served.pop()
            if len(served) < 2:
                raise ValueError("no earlier version was in production")
            return served[-2]
        return self._move(name, "rollback", previous, "Production", at)

    def versions(self, name: str) -> DataFrame:
        """(version, stage, metrics, registered_at, path), one row per version."""
        known = self._entries(name)
        stages = self._stages(known)
        rows = [(e["version"], stages[e["version"]], e["metrics"], e["at"], e["path"]) for e in known if e["action"] == "register"]
        return self.spark.createDataFrame(rows, "version int, stage string, metrics string, registered_at string, path string")

    def history(self, name: str) -> DataFrame:
        rows = [(e["number"], e["action"], e["version"], e["stage"], e["at"]) for e in self._entries(name)]
        return self.spark.createDataFrame(rows, "number long, action string, version int, stage string, at string")

    def load(self, name: str, version: int | None = None) -> tuple[int, PipelineModel]:
        """A version, the one in production if none is given, with its number."""
        known = self._entries(name)
        if version is None:
            version = next((v for v, s in self._stages(known).items() if s == "Production"), None)
            if version is None:
                raise ValueError("no version is in production")
        self._known(known, version)
        path = next(e["path"] for e in known if e["version"] == version and e["action"] == "register")
        return version, PipelineModel.load(path)

    def score(self, name: str, df: DataFrame, version: int | None = None) -> DataFrame:
        """``df`` as the version's pipeline transforms it, with ``model_version``."""
        number, model = self.load(name, version)
        return model.transform(df).withColumn("model_version", F.lit(number))
