"""Keyed state as a snapshot and what came after it.

A fold brings the snapshot up to a time: the latest versions since the last fold replace those of their keys, and what is deleted or expired by then is
left out, for good: a version that is not there cannot come back. A read merges the snapshot with the versions written since. Snapshots lie
in buckets by key, so neither shuffles the history: only new versions move.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .claims import SharedFiles
from .state import latest, timestamp


class FoldedState:
    """One state table below ``folder``. ``schema`` is that of its version rows, see :mod:`.state`.

    Versions are appended under the name of their writer, which replaces its own rows when it writes again. Writers do not write into the past: versions
    that are not later than the last fold when they are appended are not seen. Folds are numbered by files that one writer can make; of two that
    fold at once one counts. Key columns are not null. ``buckets`` defaults to the session's shuffle partitions; with fewer Spark may shuffle a snapshot
    for the sake of parallelism.
    """

    def __init__(self, spark: SparkSession, folder: str, key: Sequence[str], schema: StructType, buckets: int | None = None):
        self.spark, self.folder, self.key, self.schema = spark, folder.rstrip("/"), list(key), schema
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folds = SharedFiles(spark, f"{self.folder}/folds")

    def append(self, versions: DataFrame, name: str) -> None:
        rows = versions.select(*self.schema.names).withColumn("written_date", F.to_date("written_at"))
        rows.write.mode("overwrite").partitionBy("written_date").parquet(f"{self.folder}/versions/name={name}")

    def _last_fold(self) -> tuple[int, dict | None]:
        names = self.folds.names("")
        return (int(names[-1]), json.loads(self.folds.read(names[-1]))) if names else (0, None)

    def _snapshot(self, fold: dict | None) -> DataFrame | None:
        """The snapshot as a bucketed table; a session that does not know it registers it by its folder."""
        if fold is None:
            return None
        name = f"folded_{fold['snapshot']}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            by = ", ".join(f"`{k}`" for k in self.key)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {fold['buckets']} BUCKETS "
                f"LOCATION '{self.folder}/snapshots/{fold['snapshot']}'")
        return self.spark.table(name)

    def _since(self, fold: dict | None, now) -> DataFrame:
        """Latest version of every key written after the fold, up to ``now``; only the days since are read."""
        dated = StructType(list(self.schema.fields)).add("name", "string").add("written_date", "date")
        rows = self.spark.read.schema(dated).parquet(f"{self.folder}/versions")
        if fold is not None:
            until = F.lit(fold["until"]).cast("timestamp")
            rows = rows.where((F.col("written_date") >= F.to_date(until)) & (F.col("written_at") > until))
        return latest(rows.select(*self.schema.names), self.key, now)

    def _merged(self, fold: dict | None, now) -> DataFrame:
        fresh, old = self._since(fold, now), self._snapshot(fold)
        rows = fresh if old is None else old.join(fresh.select(*self.key), self.key, "left_anti").select(*self.schema.names).unionByName(fresh)
        alive = ~F.coalesce(F.col("deleted"), F.lit(False)) & (F.col("expires_at").isNull() | (F.col("expires_at") > timestamp(now)))
        return rows.where(alive)

    def fold(self, until: datetime) -> bool:
        """Bring the snapshot up to ``until`` (UTC unless it says otherwise), which must not lie before the last fold; whether this call did it."""
        at = until if until.tzinfo else until.replace(tzinfo=timezone.utc)
        number, last = self._last_fold()
        if last is not None and at < datetime.fromisoformat(last["until"]):
            raise ValueError("a fold does not go back in time")
        snapshot = uuid.uuid4().hex
        rows = self._merged(last, F.lit(at.isoformat()).cast("timestamp")).select(*self.schema.names).repartition(self.buckets, *self.key)
        rows.write.bucketBy(self.buckets, *self.key).sortBy(*self.key).option("path", f"{self.folder}/snapshots/{snapshot}").saveAsTable(f"folded_{snapshot}")
        said = {"until": at.isoformat(), "snapshot": snapshot, "buckets": self.buckets}
        return self.folds.create(f"{number + 1:09d}", json.dumps(said))

    def read(self, now) -> DataFrame:
        """Live version of every key at ``now``, which must not lie before the last fold."""
        return self._merged(self._last_fold()[1], now).select(*self.schema.names)
