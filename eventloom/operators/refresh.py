"""Communities that are found again only when the graph has changed, from where they were, by one of several writers.

Runs are kept in a store (assignments and a record each); for each kind of node and domain a pointer names the valid run with the
version of the graph it saw. The version is read before the run, so a pointer never claims more than was seen; it moves forward
only, by compare and swap, whoever else runs. A lock spares others the work but nothing rests on it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..commits import Lock, Pointer, Store
from ..graph import EventGraph
from ..shared import written
from . import community as C
from . import traversal as T

ORDER = ("count", "latest")


def graph_version(g: EventGraph, domain: str | None = None) -> dict:
    """How many live events there are and when the newest was made."""
    e = g.live("events") if domain is None else g.live("events").where(F.col("domain") == domain)
    r = e.agg(F.count("*").alias("count"), F.max(F.col("created_at").cast("string")).alias("latest")).first()
    return {"count": r["count"], "latest": r["latest"] or ""}


@dataclass
class Refresher:
    """Community runs of a graph below ``root``."""

    store: Store
    root: str

    @classmethod
    def at(cls, spark, root: str) -> Refresher:
        return cls(Store(spark, f"{root}/runs"), root)

    def pointer(self, kind: str, domain: str | None) -> Pointer:
        return Pointer(self.store.spark, f"{self.root}/pointer/{kind}-{self.named(domain)}")

    @staticmethod
    def named(domain: str | None) -> str:
        return "all" if domain is None else "d" + domain.encode().hex()

    def valid(self, kind: str, domain: str | None = None) -> tuple[dict | None, DataFrame | None]:
        """The pointer's value and the assignment ``id, community`` of the run that it names."""
        value = self.pointer(kind, domain).get()[1]
        return value, None if value is None else self.store.snapshot().table(value["run_id"])

    def stale(self, g: EventGraph, kind: str, domain: str | None = None) -> bool:
        now, value = graph_version(g, domain), self.pointer(kind, domain).get()[1]
        return value is None or tuple(now[k] for k in ORDER) > tuple(value[k] for k in ORDER)

    def run(self, g: EventGraph, kind: str, domain: str | None = None, resolution: float = 1.0, theta: float = 0.4, warm: bool = True, changed: DataFrame | None = None, force: bool = False, lapse: float = 3600) -> dict:
        """Find communities if the graph is newer than the valid run, and make the new run valid unless a later one is.

        ``kind`` is ``entity`` or ``event``. A warm run starts from the valid run's communities; ``changed`` (id) are nodes whose edges
        are others since, if that is known. Returns what was done: ``ran``, ``advanced``, ``reason``, ``run_id`` and the version seen.
        """
        if kind not in ("entity", "event"):
            raise ValueError(f"kind must be entity or event, not {kind!r}")
        out = {"kind": kind, "domain": domain, "ran": False, "advanced": False}
        if not force and not self.stale(g, kind, domain):
            return {**out, "reason": "fresh"}
        lock = Lock(self.store.spark, f"{self.root}/locks/{kind}-{self.named(domain)}", lapse)
        if not lock.acquire(kind):
            return {**out, "reason": "somebody else is at it"}
        try:
            if not force and not self.stale(g, kind, domain):  # somebody was done meanwhile
                return {**out, "reason": "fresh"}
            seen = graph_version(g, domain)
            live = g.live("events") if domain is None else g.live("events").where(F.col("domain") == domain)
            edges = T.entity_graph(g, domain) if kind == "entity" else T.event_graph(g, theta, live.select("id"))
            edges = written(edges, "edges")
            before = self.valid(kind, domain)[1] if warm else None
            label = C.cluster(edges, resolution, initial=before, changed=changed if before is not None else None)
            run_id = f"run_{uuid.uuid4().hex}"
            quality = C.modularity(edges, label).first()[0]
            note = json.dumps({"run_id": run_id, "kind": kind, "domain": domain, "resolution": resolution, "warm": before is not None, "modularity": quality, **seen}, sort_keys=True)
            self.store.transact(lambda _: {run_id: label}, note=note)
            advanced = self.pointer(kind, domain).advance({"run_id": run_id, **seen}, ORDER) if not force else self.forced(kind, domain, {"run_id": run_id, **seen})
            return {**out, **seen, "ran": True, "advanced": advanced, "reason": "done" if advanced else "a later run is valid", "run_id": run_id, "modularity": quality}
        finally:
            lock.release()

    def forced(self, kind: str, domain: str | None, value: dict) -> bool:
        """A run that was asked for replaces one of the same version, but never one of a later version."""
        pointer = self.pointer(kind, domain)
        version, now = pointer.get()
        if now is not None and tuple(value[k] for k in ORDER) < tuple(now[k] for k in ORDER):
            return False
        pointer.swap(version, value)
        return True
