"""Folders of artifacts with a manifest: staged, counted and digested, then published by one rename.

A version is a folder below the root.  Its artifacts are written to a staging folder that no
reader looks at; the manifest, with the rows and the digest of each, comes last, and the
folder is renamed.  Whatever fails before leaves the older versions as they were.  Readers
take a version only if its artifacts are those of its manifest.

The digest of an artifact is that of its lines as a set with counts, so it does not depend on
files or partitions: lines are hashed where they are read, and the hashes are folded by ever
shorter prefixes, about 256 and then 16 of them at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.canonical import canonical_text
from docloom.sources.readers import confined, stored

MANIFEST = "ready_data_manifest.json"
STAGING = ".staging-"
# Fields of a manifest that say where and when, not what; and the profiles with their artifacts.
VOLATILE = ("built_at", "output_dir", "source_db")
PROFILES = {
    "general": ("doc_catalog.jsonl", "sections.jsonl"),
    "regulation": ("doc_catalog.jsonl", "title_aliases.jsonl", "doc_summaries.jsonl", "sections_structured.jsonl", "relations_graph.json"),
    "formula": ("doc_catalog.jsonl", "title_aliases.jsonl", "doc_summaries.jsonl", "sections_structured.jsonl", "formula_cards.jsonl", "tables_structured.jsonl", "calculation_terms.jsonl", "relations_graph.json"),
}
_FOLD = 256


class Mismatch(ValueError):
    """A folder is not what its manifest says."""


@dataclass(frozen=True)
class Digest:
    rows: int
    sha256: str


# --- digests ------------------------------------------------------------------------------


def lines_digest(lines: DataFrame, levels: int | None = None) -> Digest:
    """Rows and digest of a column of texts, whatever their order and partitions; equal lines count each time.

    ``levels`` bounds the prefixes' length where a reader of the digest folds no deeper; groups are as large then
    as they get, and are hashed in the order of a sort instead of being collected.
    """
    (text,) = lines.columns
    hashed = stored(lines.groupBy(F.sha2(F.col(text), 256).alias("h")).agg(F.count("*").alias("n")), "line-hashes")
    kinds, rows = hashed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = 0
    while _FOLD * 16**width < kinds:
        width += 1
    wide = levels is not None and levels < width
    width = levels if wide else width
    items = hashed.select("h", F.concat_ws(":", "h", F.col("n").cast("string")).alias("item"))
    for k in range(width, -1, -1):
        by = items.withColumn("p", F.substring("h", 1, k))
        if wide and k == width:
            folded = by.repartition("p").sortWithinPartitions("p", "item").select("p", "item").mapInArrow(_hashed_groups, "p string, d string")
        else:
            folded = by.groupBy("p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("d"))
        items = folded.select(F.col("p").alias("h"), F.concat_ws("=", "p", "d").alias("item"), "d")
    top = items.first()
    return Digest(rows, top.d if top else hashlib.sha256(b"").hexdigest())


def _hashed_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, d) of sorted (p, item): the hash of each group's items, joined by commas."""
    done: dict[str, str] = {}
    at, whole = None, hashlib.sha256()
    for batch in batches:
        for p, item in zip(*(c.to_pylist() for c in batch.columns)):
            if p != at:
                if at is not None:
                    done[at] = whole.hexdigest()
                at, whole = p, hashlib.sha256()
            else:
                whole.update(b",")
            whole.update(item.encode())
    if at is not None:
        done[at] = whole.hexdigest()
    yield pa.RecordBatch.from_arrays([pa.array(done.keys(), pa.string()), pa.array(done.values(), pa.string())], names=["p", "d"])


def artifact_digest(spark: SparkSession, folder: str, names: Iterable[str]) -> str:
    """One digest of a folder: each artifact by name, the manifest without its volatile fields."""
    whole = hashlib.sha256()
    for name in sorted(names):
        path = confined(folder, name)
        if name == MANIFEST:
            part = canonical_text({k: v for k, v in _read_json(spark, path).items() if k not in VOLATILE})
        else:
            d = lines_digest(_lines(spark, path))
            part = f"{d.rows}:{d.sha256}"
        whole.update(f"{name}\0{part}\0".encode())
    return whole.hexdigest()


def tree_digest(spark: SparkSession, folder: str) -> tuple[str, list[str]]:
    """Digest and names of all files below a folder, byte for byte; each file is hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").load(folder)
    found = sorted((_below(folder, r.path), r.d) for r in files.select("path", F.sha2("content", 256).alias("d")).toLocalIterator())
    whole = hashlib.sha256()
    for name, d in found:
        whole.update(f"{name}\0{d}\0".encode())
    return whole.hexdigest(), [name for name, _ in found]


def _below(folder: str, path: str) -> str:
    plain = lambda x: re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", x).rstrip("/")
    return plain(path).removeprefix(plain(folder) + "/")


# --- files --------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_json(spark: SparkSession, path: str, value: dict[str, Any]) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


def _read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    """One JSON object that fills a file."""
    value = json.loads(spark.read.text(path, wholetext=True).first().value)
    if not isinstance(value, dict):
        raise Mismatch(f"{path} holds no object")
    return value


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _schema(df: DataFrame) -> list[str]:
    return [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields]


# --- publishing ---------------------------------------------------------------------------


def publish(spark: SparkSession, root: str, version: str, artifacts: dict[str, DataFrame], built_at: str, **fields: Any) -> dict[str, Any]:
    """Write all artifacts as one version and return its manifest; an existing version is never touched."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*", version):
        raise ValueError(f"{version} names no version")
    target = confined(root, version)
    fs, to = _fs(spark, target)
    if fs.exists(to):
        raise ValueError(f"version {version} is there already")
    staging = confined(root, f"{STAGING}{uuid.uuid4().hex}")
    entries = {}
    for name, df in artifacts.items():
        path = confined(staging, name)
        df.write.option("ignoreNullFields", "false").json(path)
        d = lines_digest(_lines(spark, path))
        entries[name] = {"rows": d.rows, "sha256": d.sha256, "fields": _schema(df)}
    manifest = {"version": version, "built_at": built_at, "output_dir": target, **fields, "artifact_files": [*artifacts, MANIFEST], "artifacts": entries}
    _write_json(spark, confined(staging, MANIFEST), manifest)
    if not fs.rename(_fs(spark, staging)[1], to):
        raise OSError(f"{staging} could not be renamed to {target}")
    return manifest


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions, oldest first by the time in their manifests."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    found = [(_read_json(spark, confined(root, f"{n}/{MANIFEST}")).get("built_at", ""), n) for n in names if not n.startswith(".") and fs.exists(_fs(spark, confined(root, f"{n}/{MANIFEST}"))[1])]
    return [n for _, n in sorted(found)]


def open_version(spark: SparkSession, root: str, version: str | None = None, verify: bool = True) -> tuple[dict[str, Any], dict[str, DataFrame]]:
    """The manifest and the artifacts of a version, or of the newest; refused if they disagree."""
    if version is None:
        there = versions(spark, root)
        if not there:
            raise Mismatch(f"{root} has no version")
        version = there[-1]
    folder = confined(root, version)
    manifest = _read_json(spark, confined(folder, MANIFEST))
    out = {}
    for name, entry in manifest["artifacts"].items():
        path = confined(folder, name)
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            raise Mismatch(f"{name} is lost")
        if verify:
            d = lines_digest(_lines(spark, path))
            if (d.rows, d.sha256) != (entry["rows"], entry["sha256"]):
                raise Mismatch(f"{name} has {d.rows} rows with digest {d.sha256}, the manifest says {entry['rows']} with {entry['sha256']}")
        columns = ", ".join(f"`{n}` {t}" for n, t in (f.split(":", 1) for f in entry["fields"]))
        out[name] = spark.read.schema(columns).option("mode", "FAILFAST").json(path)
    return manifest, out
