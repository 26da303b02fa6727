"""Lanes on disk: manifest, staged commits, reuse, and mixtures read through the manifest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.operators.conversation import BASE_COLUMNS
from weft.operators.mixture import MixtureError, bounded_sample, image_limit, shuffled, token_budget, union_all


class CatalogError(RuntimeError):
    """A lane that is missing, or would be overwritten; `check` names what failed."""

    def __init__(self, check: str, message: str):
        super().__init__(message)
        self.check = check


class Catalog:
    """A folder with lane=.../split=... and manifest.json, in any store that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, lane: str, split: str) -> str:
        return f"{self.root}/lane={lane}/split={split}"

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def has(self, lane: str, split: str) -> bool:
        return self._exists(f"{self.path(lane, split)}/_SUCCESS")

    def manifest(self) -> dict:
        # an interrupted swap leaves the manifest under its old name
        found = next((p for p in (f"{self.root}/manifest.json", f"{self.root}/.manifest.json.old") if self._exists(p)), None)
        if found is None:
            return {"subsets": []}
        stream = self._fs.open(self._path(found))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_manifest(self, manifest: dict) -> None:
        out = self._fs.create(self._path(f"{self.root}/.manifest.json"), True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True, indent=1).encode()))
        out.close()
        self._swap(f"{self.root}/.manifest.json", f"{self.root}/manifest.json")

    def _swap(self, staged: str, final: str) -> None:
        """Puts what is staged in its place; what stood there goes last, and comes back if the rename fails."""
        old = f"{final.rpartition('/')[0]}/.{final.rpartition('/')[2]}.old"
        self._fs.delete(self._path(old), True)
        had = self._exists(final) and self._fs.rename(self._path(final), self._path(old))
        if not self._fs.rename(self._path(staged), self._path(final)):
            if had:
                self._fs.rename(self._path(old), self._path(final))
            raise CatalogError("rename", f"{staged} could not take the place of {final}")
        if had:
            self._fs.delete(self._path(old), True)

    def commit(self, df: DataFrame, lane: str, split: str, *, source: str, training: bool, force: bool = False, rows_per_file: int = 1_000_000) -> dict:
        """Writes beside the final place and swaps, so that a write that fails leaves what was there,
        and a split can be made from itself; the manifest entry of the split is replaced, others stay."""
        final, staged = self.path(lane, split), f"{self.root}/lane={lane}/.{split}.incomplete"
        if self._exists(final) and not force:
            raise CatalogError("exists", f"{final} is there already")
        df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(staged)
        self._swap(staged, final)
        entry = {"config_name": lane, "split": split, "path": f"lane={lane}/split={split}", "rows": self.spark.read.parquet(final).count(), "source_dataset_id": source, "is_training_split": training}
        manifest = self.manifest()
        manifest["subsets"] = [e for e in manifest["subsets"] if (e["config_name"], e["split"]) != (lane, split)] + [entry]
        self._write_manifest(manifest)
        return entry

    def build(self, lane: str, split: str, make: Callable[[], DataFrame], **options) -> DataFrame:
        """The stored split, made first if it is not there."""
        if not self.has(lane, split):
            self.commit(make(), lane, split, **options)
        return self.read(lane, split)

    def read(self, lane: str, split: str) -> DataFrame:
        if not self.has(lane, split):
            raise CatalogError("missing", f"no {self.path(lane, split)}")
        return self.spark.read.parquet(self.path(lane, split))

    def lookup(self, lane: str, split: str) -> dict | None:
        return next((e for e in self.manifest()["subsets"] if (e["config_name"], e["split"]) == (lane, split)), None)

    def mixture(self, lanes: list[str] | None = None, *, splits: tuple[str, ...] = ("train",), max_images: int | None = None, max_length: int | None = None, per_image: int = 282, most_rows: int | None = None, seed: int = 42) -> DataFrame:
        """Training splits of the lanes: filtered, capped, united and put in seeded order (column position)."""
        entries = [e for e in self.manifest()["subsets"] if e["is_training_split"] and e["split"] in splits]
        if unknown := set(lanes or []) - {e["config_name"] for e in entries}:
            raise MixtureError(f"no such lanes: {sorted(unknown)}")
        parts = []
        for e in entries:
            if lanes is not None and e["config_name"] not in lanes:
                continue
            part = token_budget(image_limit(self.read(e["config_name"], e["split"]).select(*BASE_COLUMNS), max_images), max_length, per_image)
            parts.append(part if most_rows is None else bounded_sample(part, most_rows, seed, "source_dataset_id", "row_id"))
        return shuffled(union_all(*parts), seed, "source_dataset_id", "source_split", "row_id", name="position")
