"""A fused map that grows batch by batch and survives being stopped.

A batch of points becomes one run: its weighted sums by voxel, as Parquet, written by the batch's own tasks; what is
stored already is not read. When a level has `fanout` runs they are added up into one of the next level, so a voxel is
written a logarithmic number of times and a map of any number of batches is the sum of few runs. Sums add up in any
order and any grouping, so batches of any size give the same map.

A small file lists runs and batches; it is replaced as a whole once a run is complete. A stopped job goes on from the
last batch that is listed: batches done before are passed over, half-written runs are overwritten."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import STASHING, delete, exists, settings
from . import voxel


class FusionStore:
    """The map below `path`, of cells of `size`; values: columns that are averaged by `weight`."""

    def __init__(self, spark: SparkSession, path: str, size: float, values=voxel.AXES, weight: str = "w", fanout: int = 8):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.made = {"size": size, "values": list(values), "weight": weight}
        self.levels: list[list[str]] = [[]]
        self.done: list[str] = []
        self.next = 0
        if exists(spark, f"{self.path}/listed.json"):
            listed = json.loads(self._files().read_text(spark, f"{self.path}/listed.json"))
            if listed["made"] != self.made:
                raise ValueError(f"{path} holds another map: {listed['made']}")
            self.levels, self.done, self.next = listed["levels"], listed["done"], listed["next"]

    @staticmethod
    def _files():
        from ..sources import files

        return files

    def _save(self) -> None:
        self._files().write_text(self.spark, f"{self.path}/listed.json", json.dumps({"made": self.made, "levels": self.levels, "done": self.done, "next": self.next}))

    def _written(self, state: DataFrame) -> str:
        name = f"run_{self.next:06d}"
        with settings(self.spark, STASHING):
            state.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.next += 1
        return name

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in names])

    def _added(self, names: list[str]) -> DataFrame:
        sums = [f"s_{v}" for v in self.made["values"]] + [self.made["weight"]]
        return self._read(names).groupBy(*voxel.KEY).agg(*[F.sum(c).alias(c) for c in sums])

    def add(self, batch: str, points: DataFrame) -> bool:
        """Add a batch of points once; whether it was new. batch: a name that says which one it is."""
        if batch in self.done:
            return False
        self.levels[0].append(self._written(voxel.sums_by_cell(points, self.made["size"], self.made["values"], self.made["weight"])))
        self.done.append(batch)
        self._save()
        self._compact()
        return True

    def _compact(self) -> None:
        depth = 0
        while depth < len(self.levels):
            names = self.levels[depth]
            if len(names) >= self.fanout:
                merged = self._written(self._added(names))
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth] = []
                self.levels[depth + 1].append(merged)
                self._save()
                # Listed no more, so nothing reads them.
                for name in names:
                    delete(self.spark, f"{self.path}/{name}")
            depth += 1

    def runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def cloud(self) -> DataFrame:
        """One point for each voxel: vx, vy, vz, the weighted means and the weight. Raises without a batch."""
        if not self.runs():
            raise ValueError(f"nothing is fused at {self.path}")
        return voxel.merge_sums(self._read(self.runs()), self.made["values"], self.made["weight"])
