"""Incrementally maintained views: a folder of mergeable partials, and a catalog view that points to it.

Each batch of rows writes its partial aggregate to a partition of its own, named by the stream's query id and the batch's
number, so a batch that runs again replaces itself and writers at once don't meet. Reading is one group-by over the
partials. What views there are, their keys and definition are Spark's catalog's business."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerloom.operators.maintain import by_files

Parts = list[DataFrame]

#: Stored rows that one task merges.
MERGED = 1 << 20


def _together(parts: Parts) -> DataFrame:
    """All rows of the parts, with the place of their part in the list as __part; a stored state has its own."""
    return parts[0] if "__part" in parts[0].columns else reduce(DataFrame.unionByName, [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])


def _columns(parts: Parts) -> list[str]:
    return [c for c in parts[0].columns if c != "__part"]


def merge_summing(parts: Parts, keys: list[str]) -> DataFrame:
    """Numeric columns outside the keys add up; of others one value stays."""
    cols = [f for f in parts[0].schema.fields if f.name not in (*keys, "__part")]
    sums = [(F.sum(f.name).cast(f.dataType) if isinstance(f.dataType, NumericType) else F.any_value(f.name, True)).alias(f.name) for f in cols]
    return _together(parts).groupBy(*keys).agg(*sums).select(*_columns(parts))


def merge_aggregating(how: dict[str, str]) -> Callable[[Parts, list[str]], DataFrame]:
    """A merge of partial states: each column by sum, min, max, or sketch (a HyperLogLog sketch of distinct values)."""
    kinds = {"sum": F.sum, "min": F.min, "max": F.max, "sketch": F.hll_union_agg}

    def merge(parts: Parts, keys: list[str]) -> DataFrame:
        types = parts[0].schema
        return _together(parts).groupBy(*keys).agg(*[kinds[kind](c).cast(types[c].dataType).alias(c) for c, kind in how.items()]).select(*_columns(parts))

    return merge


def merge_replacing(parts: Parts, keys: list[str]) -> DataFrame:
    """The last row of a key stays: that of the later part; within a part, the greatest."""
    row = F.struct(*[F.col(f"`{c}`") for c in _columns(parts)])
    return _together(parts).groupBy(*keys).agg(F.max_by(row, F.struct("__part", row)).alias("__r")).select("__r.*")


def merge_append(parts: Parts, keys: list[str]) -> DataFrame:
    return _together(parts).drop("__part")


@dataclass
class View:
    """query: source rows -> partial state; finish: state -> what readers see (HAVING, text of sums, sketches)."""

    name: str
    query: Callable[[DataFrame], DataFrame]
    keys: list[str]
    merge: Callable[[Parts, list[str]], DataFrame] = merge_summing
    finish: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    definition: str = ""


class ViewStore:
    """Views under a folder, registered in a database of Spark's catalog. A batch adds a partition, so its cost goes with the
    batch and not with the state; Spark's own `_SUCCESS` says that it is whole, and what a broken job leaves isn't read.
    `fold` merges all partitions into one; it, `refresh` and `rollback` write beside the old state and then turn the catalog's
    view over to the new one. They need the view to themselves: run them between a stream's runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.db = "views_" + hashlib.md5(root.encode()).hexdigest()[:16]
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.db}")

    # ---- the catalog

    def _exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.db}.{name}")

    def _properties(self, name: str) -> dict[str, str]:
        if not self._exists(name):
            raise KeyError(name)
        return {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.db}.{name}").collect()}

    def _point(self, view: View, location: str) -> None:
        """Makes the catalog's view read the partials under a folder."""
        quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        properties = {"location": location, "keys": json.dumps(view.keys), "definition": view.definition}
        shown = ", ".join(f"{quoted(k)} = {quoted(v)}" for k, v in properties.items())
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.db}.{view.name} TBLPROPERTIES ({shown}) AS SELECT *, _metadata.file_modification_time AS __part FROM parquet.`{location}`")

    # ---- partials

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _children(self, text: str) -> list[str]:
        files, path = self._path(text)
        return [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()] if files.exists(path) else []

    def _delete(self, text: str) -> None:
        files, path = self._path(text)
        files.delete(path, True)

    def _done(self, partition: str) -> bool:
        files, path = self._path(f"{partition}/_SUCCESS")
        return files.exists(path)

    @staticmethod
    def _partition(location: str, source: str, batch: str) -> str:
        return f"{location}/source=s{source}/batch=b{batch}"  # the letters keep them text when Spark infers types

    def _new(self, view: View, state: DataFrame, source: str, batch: str, marks: list[str] = ()) -> None:
        """A new folder with one partial, and empty ones for `marks`, batches that are in it and must not come again."""
        location = f"{self.root}/{view.name}-{uuid.uuid4().hex}"
        state.write.parquet(self._partition(location, source, batch))
        for mark in marks:
            state.limit(0).write.mode("overwrite").parquet(f"{location}/{mark}")
        old = self._properties(view.name)["location"] if self._exists(view.name) else None
        self._point(view, location)
        if old is not None:
            self._delete(old)

    def _marks(self, view: View) -> list[str]:
        """The newest partition of each source: only that batch of a stream can come again."""
        location = self._properties(view.name)["location"]
        newest = lambda s: max(self._children(f"{location}/{s}"), key=lambda b: (len(b), b))
        return [f"{s}/{newest(s)}" for s in self._children(location) if s != "source=sfolded"]

    def _stored(self, view: View) -> DataFrame:
        self._properties(view.name)
        return self.spark.table(f"{self.db}.{view.name}").drop("source", "batch")

    def state(self, view: View) -> DataFrame:
        """The partials of a view, merged. Within a partial keys are unique as a rule, so nothing is won by adding up before the
        shuffle, where tables of many keys would spill: many rows are dealt by their keys first, about `MERGED` a task (files
        know their numbers of rows)."""
        stored = self._stored(view)
        tasks = -(-stored.count() // MERGED) if view.keys else 1
        return view.merge([stored.repartition(tasks, *view.keys) if tasks > 1 else stored], view.keys)

    # ---- what users call

    def create(self, view: View, source: DataFrame, batch: str = "backfill") -> int:
        """Backfills the view from the rows there are and returns the number of its rows. The batch id is the offset:
        later updates with the same id are taken as done."""
        if self._exists(view.name):
            raise ValueError(f"a view {view.name} exists")
        self._new(view, view.query(source), batch, "0")
        return self.spark.table(f"{self.db}.{view.name}").count()  # one partial as yet, so nothing is to be merged

    def update(self, view: View, rows: DataFrame, batch: str, number: int = 0) -> bool:
        """Adds the aggregate of new rows; False if the batch (of a stream: its number) was added before."""
        partition = self._partition(self._properties(view.name)["location"], batch, str(number))
        if self._done(partition):
            return False
        view.query(rows).write.mode("overwrite").parquet(partition)
        return True

    def replace(self, view: View, rows: DataFrame, source: str, by: Column, gone: list[str], files: int = 1) -> None:
        """Puts the aggregates of rows in place of the partials that `by` names (like stretches of blocks), a column of the
        query's result, about `files` of them; those in `gone` lose theirs. Running it again changes nothing."""
        location = self._properties(view.name)["location"]
        named = view.query(rows).withColumns({"source": F.lit(f"s{source}"), "batch": F.concat(F.lit("b"), by.cast("string"))})
        by_files(named, files, "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "batch").parquet(location)
        for batch in gone:
            self._delete(self._partition(location, source, batch))

    def refresh(self, view: View, source: DataFrame, batch: str) -> None:
        """Recomputes the whole view from its source."""
        self._new(view, view.query(source), batch, "0")

    def fold(self, view: View) -> None:
        """Merges all partials for good."""
        self._new(view, self.state(view), "folded", "0", self._marks(view))

    def rollback(self, view: View, source: DataFrame, n: int, size: int, block: str = "block_num") -> None:
        """Takes back all blocks from n on, in a view whose state has one partial per `bucket`, a stretch of `size`
        blocks: later buckets go, that of n is computed again from the source, the others stay as they are."""
        low = n // size
        again = view.query(source.where((F.col(block) >= low * size) & (F.col(block) < n)))
        kept = view.merge([self._stored(view).where(F.col("bucket") < low)], view.keys)
        self._new(view, kept.unionByName(again), "folded", "0", self._marks(view))

    def read(self, view: View) -> DataFrame:
        return view.finish(self.state(view))

    def follow(self, view: View, stream: DataFrame, checkpoint: str) -> None:
        """Adds all that a stream has to offer now, micro-batch by micro-batch, exactly once. Batches go by the id that
        Spark keeps in the checkpoint and their number, so several streams, or a new checkpoint, don't stand in each
        other's way."""

        def add(rows: DataFrame, i: int) -> None:
            kept = self.spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id").alias("id")).first()
            self.update(view, rows, kept.id, i)

        stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def list_views(self) -> DataFrame:
        """(name, definition, columns, keys, rows) of the views there are; rows are those of the merged state."""
        found = []
        for name in sorted(r.viewName for r in self.spark.sql(f"SHOW VIEWS IN {self.db}").where("not isTemporary").collect()):
            p, stored = self._properties(name), self.spark.table(f"{self.db}.{name}").drop("source", "batch", "__part")
            keys = json.loads(p["keys"])
            n = stored.select(*keys).distinct().count() if keys else min(1, len(stored.take(1)))
            found.append((name, p["definition"], json.dumps(stored.dtypes), p["keys"], n))
        return self.spark.createDataFrame(found, "name string, definition string, columns string, keys string, rows long")

    def describe(self, name: str) -> DataFrame:
        return self.list_views().where(F.col("name") == name)

    def drop(self, view: View) -> None:
        """The view and its partials go; the name is free again."""
        location = self._properties(view.name)["location"]
        self.spark.sql(f"DROP VIEW {self.db}.{view.name}")
        self._delete(location)
