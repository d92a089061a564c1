"""Count-Min Sketch as a table of cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cell_hash
from .scan import LEAST, running


@dataclass(frozen=True)
class CountMin:
    """Width e / epsilon, depth ln(1 / delta), both rounded up."""

    epsilon: float = 0.005
    delta: float = 0.001

    @property
    def width(self) -> int:
        return math.ceil(math.e / self.epsilon)

    @property
    def depth(self) -> int:
        return math.ceil(math.log(1 / self.delta))

    @property
    def memory_bytes(self) -> int:
        return self.width * self.depth * 8

    def error_bound(self, total: int) -> float:
        return self.epsilon * total

    def build(self, rows: DataFrame, key: str, count: str | None = None) -> DataFrame:
        """row, col, cnt. Keys are counted before they are hashed, so each distinct key is hashed once per row; the cells are at
        most depth x width."""
        weights = F.sum(count) if count else F.count(F.lit(1))
        keys = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(weights.alias("_n"))
        cells = self._cells(keys, key)
        return cells.groupBy("row", "col").agg(F.sum("_n").cast("bigint").alias("cnt"))

    def _cells(self, keys: DataFrame, key: str) -> DataFrame:
        each = keys.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(self.depth - 1))))
        return each.withColumn("col", cell_hash(F.col(key), F.col("row"), self.width))

    def merge(self, *sketches: DataFrame) -> DataFrame:
        out = sketches[0]
        for s in sketches[1:]:
            out = out.unionByName(s)
        return out.groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))

    def query(self, sketch: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        """key, estimate: the least of its cells; 0 for cells never counted. The sketch has a fixed size and is broadcast."""
        probes = self._cells(keys.select(key).distinct(), key)
        found = probes.join(F.broadcast(sketch), ["row", "col"], "left")
        return found.groupBy(key).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))

    def total(self, sketch: DataFrame) -> DataFrame:
        return sketch.filter("row = 0").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))

    def heavy_hitters(self, rows: DataFrame, key: str, share: float) -> DataFrame:
        """Keys whose estimate is above a share of all."""
        sketch = self.build(rows, key)
        return self.query(sketch, rows, key).crossJoin(F.broadcast(self.total(sketch))).filter(F.col("estimate") > share * F.col("total")).select(key, "estimate")

    def asof(self, rows: DataFrame, key: str, us: str = "us", tie: str = "event_id", least: int = LEAST) -> DataFrame:
        """tie, estimate: what the sketch holds for each row's key when the row has been added, rows in order of time and tie. A running
        count of each row's cells; cells that hold many rows are cut in time."""
        cells = self._cells(rows.filter(F.col(key).isNotNull()).select(key, us, tie), key)
        counted = running(cells, ["row", "col"], [us, tie], {"_seen": F.lit(1)}, least=least)
        return counted.groupBy(tie).agg(F.min("_seen").alias("estimate"))
