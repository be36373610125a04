"""Stored segments of a table with a manifest: what lies where, kept across sessions.

Segments are Parquet in folders by a range of keys, below a generation; the manifest names each segment's
generation, files with their lengths, rows and keys, and is replaced in one move. Readers see the state before
or after a change. Changes touch the segments that they concern: those below a key are dropped, the one that
holds a cut is written again, the others stay as they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import take_until
from ..operators.stages import write_segments
from .files import Folder

MANIFEST = "manifest.json"


class Segments:
    """The segments below a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Folder(spark, path)

    def manifest(self) -> dict | None:
        """size, key, schema, segments: {bucket: generation, files, rows, first, last}; None if nothing is stored."""
        return self.files.read(MANIFEST)

    def stored(self) -> bool:
        """Whether there is a manifest whose generations are there; `faults` looks at every file."""
        held = self.manifest()
        return held is not None and all(self.files.exists(f"gen={g}") for g in {s["generation"] for s in held["segments"].values()})

    def build(self, df: DataFrame, size: int, key: str) -> None:
        """Rows that carry their bucket lie together by it and in order already."""
        generation = uuid.uuid4().hex
        held = {"size": size, "key": key, "schema": df.drop("bucket").schema.json(), "segments": {}}
        held["segments"] = self._written(df, generation, size, key)
        self.files.replace(MANIFEST, held)

    def _written(self, df: DataFrame, generation: str, size: int, key: str) -> dict:
        write_segments(df, f"{self.path}/gen={generation}", size, key)
        schema = T.StructType([*df.drop("bucket").schema.fields, T.StructField("bucket", T.LongType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/gen={generation}")
        file = F.struct(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("length")).alias("file")
        found = rows.groupBy("bucket", file).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last")).collect()  # a row for each file
        held: dict[str, dict] = {}
        for r in found:
            s = held.setdefault(str(r["bucket"]), {"generation": generation, "files": {}, "rows": 0, "first": r["first"], "last": r["last"]})
            s["files"][r["file"]["name"]] = r["file"]["length"]
            s |= {"rows": s["rows"] + r["rows"], "first": min(s["first"], r["first"]), "last": max(s["last"], r["last"])}
        return held

    def _lengths(self, generation: str, bucket) -> dict[str, int]:
        return {n: k for n, k in self.files.lengths(f"gen={generation}/bucket={bucket}").items() if n.endswith(".parquet")}

    def read(self) -> DataFrame:
        """All rows with their bucket, by which folders are left out."""
        held = self.manifest()
        schema = T.StructType([*T.StructType.fromJson(json.loads(held["schema"])).fields, T.StructField("bucket", T.LongType())])
        generations: dict[str, list[int]] = {}
        for bucket, s in held["segments"].items():
            generations.setdefault(s["generation"], []).append(int(bucket))
        out = None
        for generation, buckets in sorted(generations.items()):
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/gen={generation}")
            rows = rows.where(F.col("bucket").isin(buckets)) if len(generations) > 1 else rows
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    @property
    def size(self) -> int:
        return self.manifest()["size"]

    # checks and changes --------------------------------------------------------------------------

    def faults(self) -> tuple[list[str], int | None]:
        """What is missing or has another length, and the last key before the first such segment (None: none is whole)."""
        found, good, broken = [], None, False
        for bucket, s in sorted(self.manifest()["segments"].items(), key=lambda item: int(item[0])):
            there = self._lengths(s["generation"], bucket)
            mine = [f"bucket {bucket}: {name} {'is missing' if name not in there else 'has another length'}" for name, n in sorted(s["files"].items()) if there.get(name) != n]
            mine += [f"bucket {bucket}: {name} is not listed" for name in sorted(set(there) - set(s["files"]))]
            found += mine
            broken = broken or bool(mine)
            good = good if broken else s["last"]
        return found, good

    def delete_below(self, key: int) -> list[int]:
        """Drops the segments whose keys all lie below a key; the highest one always stays."""
        held = self.manifest()
        top = max((int(b) for b in held["segments"]), default=None)
        gone = {b: s for b, s in held["segments"].items() if s["last"] < key and int(b) != top}
        self._replaced(held, gone, {})
        return sorted(int(b) for b in gone)

    def truncate_above(self, key: int) -> list[int]:
        """Drops the segments above a key and writes the one that holds it again, without its later rows."""
        held = self.manifest()
        gone = {b: s for b, s in held["segments"].items() if s["last"] > key}
        cut = [int(b) for b, s in gone.items() if s["first"] <= key]
        fresh = {}
        if cut:
            rows = self.read().where(F.col("bucket").isin(cut)).where(F.col(held["key"]) <= key).drop("bucket")
            fresh = self._written(rows, uuid.uuid4().hex, held["size"], held["key"])
        self._replaced(held, gone, fresh)
        return sorted(int(b) for b in gone)

    def prune(self, target: int, limit: int, order: str) -> dict:
        """Deletes the first rows by (key, order) up to a key, so many at most; the next run goes on from there.

        Returns deleted, done, and checkpoint: key and order of the last row that is gone. Segments that go whole
        are not read; the one where the run stops, which may be within a block, is written again.
        """
        held, left, gone, fresh = self.manifest(), limit, {}, {}
        key, checkpoint, done = held["key"], held.get("pruned"), True
        for bucket, s in sorted(held["segments"].items(), key=lambda item: int(item[0])):
            if s["first"] > target:
                break
            if left <= 0:
                done = False
                break
            rows = self.read().where(F.col("bucket") == int(bucket)).drop("bucket").where(F.col(key) <= target)
            if s["last"] <= target and s["rows"] <= left:
                taken = s["rows"]
                last = rows.where(F.col(key) == s["last"]).agg(F.max(order)).first()[0]
                checkpoint = [s["last"], last]
            else:
                cut = take_until(rows.withColumn("__one", F.lit(1)), [key, order], {"__one": left})
                ends = cut.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(key, order)).alias("last")).first()
                taken, checkpoint = ends["n"], list(ends["last"])
                after = (F.col(key) > checkpoint[0]) | ((F.col(key) == checkpoint[0]) & (F.col(order) > checkpoint[1]))
                fresh |= self._written(self.read().where(F.col("bucket") == int(bucket)).drop("bucket").where(after), uuid.uuid4().hex, held["size"], key)
                done = bucket not in fresh or fresh[bucket]["first"] > target
            gone[bucket] = s
            left -= taken
        self._replaced(held | {"pruned": checkpoint}, gone, fresh)
        return {"deleted": limit - left, "done": done, "checkpoint": checkpoint}

    def _replaced(self, held: dict, gone: dict, fresh: dict) -> None:
        """The manifest first, then the folders that it doesn't name any more."""
        if gone:
            self.files.replace(MANIFEST, held | {"segments": {b: s for b, s in held["segments"].items() if b not in gone} | fresh})
            for bucket, s in gone.items():
                self.files.delete(f"gen={s['generation']}/bucket={bucket}")
