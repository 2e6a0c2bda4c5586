"""Account features and labels kept as Parquet, with a JSON note beside them; and the state that features are made from.

Tables are kept in order of account, each file with a range of its own and a Bloom filter on the account, so that a lookup
reads pages of one file rather than the table.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ACCOUNT = "account_id"


@dataclass
class FeatureSet:
    features: DataFrame
    labels: DataFrame
    metadata: dict = field(default_factory=dict)


class FeatureStore:
    """A folder that Spark can reach; it is written and read by Spark alone."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _keep(self, df: DataFrame, name: str) -> None:
        own = df.repartitionByRange("account_id").sortWithinPartitions("account_id").write.mode("overwrite")
        own.option(f"parquet.bloom.filter.enabled#{ACCOUNT}", "true").parquet(self._at(name))

    def _note(self, said: dict, name: str) -> None:
        note = self.spark.createDataFrame([(json.dumps(said, sort_keys=True, default=str),)], "value string")
        note.coalesce(1).write.mode("overwrite").text(self._at(name))

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def save(self, found: FeatureSet) -> None:
        """Labels and features go to separate tables; the note is written last and marks the whole."""
        self._keep(found.features, "features")
        self._keep(found.labels, "labels")
        self._note(found.metadata, "metadata")

    def exists(self) -> bool:
        return self._there("metadata")

    def save_state(self, tables: Mapping[str, DataFrame]) -> None:
        """A state's tables, as the next version; the one before stays until the note names the new one, so a failed run loses nothing."""
        version = self.state_version() + 1
        for name, df in tables.items():
            self._keep(df, f"state-{version}/{name}")
        self._note({"version": version, "tables": sorted(tables)}, "state")
        old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(f"state-{version - 1}"))
        old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def _state(self) -> dict:
        note = self.spark.read.text(self._at("state")).first() if self._there("state") else None
        return json.loads(note.value) if note else {"version": 0, "tables": []}

    def state_version(self) -> int:
        """How many times a state has been kept; 0: there is none."""
        return self._state()["version"]

    def load_state(self) -> dict[str, DataFrame]:
        note = self._state()
        return {name: self.spark.read.parquet(self._at(f"state-{note['version']}/{name}")) for name in note["tables"]}

    def load_features(self) -> DataFrame:
        return self.spark.read.parquet(self._at("features"))

    def load(self) -> FeatureSet:
        note = self.spark.read.text(self._at("metadata")).first()
        return FeatureSet(self.load_features(), self.spark.read.parquet(self._at("labels")), json.loads(note.value) if note else {})

    def lookup(self, account_id: str) -> DataFrame:
        """One account's features; the filter reaches the scan, which passes over all but the account's pages."""
        return self.load_features().where(F.col("account_id") == str(account_id))
