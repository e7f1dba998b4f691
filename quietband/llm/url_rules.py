"""URL filter over a sorted array of 64-bit digests.

Rules are host and path prefixes. Their xxhash64 keys are written as one sorted
array next to the rules' full strings; Spark ships the file to every executor,
tasks map it into memory, probe all candidate prefixes of a batch with one binary
search, and compare the stored string wherever a digest is met. The probed strings
are made and hashed by Spark. Lists above ``MAX_LISTED`` rules are joined by digest
instead of being shipped.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rules whose arrays are shipped to executors as a file: about 1 GB.
MAX_LISTED = 10_000_000
HASH_SEED = 42  # the seed of Spark's xxhash64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for NULL or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


class DigestList:
    """Sorted keys in ``keys.npy`` (memory-mapped) and the rules in the same order."""

    def __init__(self, rules: list[tuple[str, str]]):
        """``rules``: (``host/path``, verdict); each host ends at the first slash."""
        keyed = sorted((xxhash.xxh64_intdigest(r.encode(), HASH_SEED), r, v) for r, v in set(rules))
        self.folder = tempfile.mkdtemp(prefix="digests-")
        self.path = os.path.join(self.folder, f"keys-{os.path.basename(self.folder)}.npy")
        np.save(self.path, np.array([k for k, _, _ in keyed], dtype=np.uint64))
        self.rules = [(r, v) for _, r, v in keyed]

    def ship(self, spark) -> str:
        spark.sparkContext.addFile(self.path)
        return os.path.basename(self.path)


def match_rules(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    otherwise: str = "allow",
) -> DataFrame:
    """``(id, host, path, rule, verdict)``, one row per page.

    A rule fits its host and all subdomains where the path starts with the rule's;
    the longest fitting rule wins. Without one the rule is NULL and the verdict
    ``otherwise``. NULL, empty and malformed URLs fit no rule; repeated rows stay.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(id_col, host.alias("host"), path.alias("path"))
    depths = sorted({len(r.partition("/")[2]) for r, _ in rules})
    labels = sorted({r.partition("/")[0].count(".") + 1 for r, _ in rules})
    if len(rules) > MAX_LISTED:
        return _joined(parts, rules, id_col, depths, labels, otherwise)
    listed = DigestList(rules)
    name, stored = listed.ship(pages.sparkSession), listed.rules
    kind = pages.schema[id_col].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.load(SparkFiles.get(name), mmap_mode="r")
        for batch in batches:
            rows = batch.num_rows
            lists = batch.column(3)
            owner = np.repeat(np.arange(rows), pa.compute.list_value_length(lists).to_numpy())
            tried = lists.flatten()
            digest = tried.field("digest").to_numpy().view(np.uint64)
            text = tried.field("rule")
            at = np.searchsorted(keys, digest)
            best: list[tuple[int, int] | None] = [None] * rows
            for i in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == digest) if len(keys) else ():
                candidate, k = text[int(i)].as_py(), int(at[i])
                while k < len(keys) and keys[k] == digest[i]:  # equal digests lie side by side
                    if stored[k][0] == candidate:
                        best[owner[i]] = max(best[owner[i]] or (0, 0), (len(candidate), k))
                    k += 1
            rule = [None if b is None else stored[b[1]][0] for b in best]
            verdict = [otherwise if b is None else stored[b[1]][1] for b in best]
            columns = [batch.column(i) for i in range(3)] + [pa.array(rule, pa.string()), pa.array(verdict)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "host", "path", "rule", "verdict"])

    schema = f"{id_col} {kind}, host string, path string, rule string, verdict string"
    return parts.withColumn("tried", _candidates(depths, labels)).mapInArrow(probe, schema)


def _candidates(depths: list[int], labels: list[int]) -> Column:
    """Every host suffix and path prefix of a length that some rule has, with its digest."""
    pairs = []
    for count in labels:
        host = F.substring_index("host", ".", -count)
        enough = F.length(F.regexp_replace("host", r"[^.]", "")) >= count - 1
        for depth in depths:
            fits = enough & (F.length("path") >= depth + 1)
            pairs.append(F.when(fits, F.concat(host, F.substring("path", 1, depth + 1))))
    tried = F.array_compact(F.array(*pairs))
    return F.transform(tried, lambda r: F.struct(r.alias("rule"), F.xxhash64(r).alias("digest")))


def _joined(parts, rules, id_col, depths, labels, otherwise) -> DataFrame:
    spark = parts.sparkSession
    listed = spark.createDataFrame(rules, "rule string, verdict string").withColumn(
        "digest", F.xxhash64("rule")
    )
    rows = parts.withColumn("_row", F.monotonically_increasing_id())
    tried = rows.select("*", F.explode_outer(_candidates(depths, labels)).alias("t"))
    found = tried.select(id_col, "host", "path", "_row", "t.rule", "t.digest").join(
        listed, ["digest", "rule"], "left"
    )
    best = found.groupBy("_row", id_col, "host", "path").agg(
        F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("rule"), "rule", "verdict"))).alias("b")
    )
    return best.select(
        id_col, "host", "path", "b.rule", F.coalesce("b.verdict", F.lit(otherwise)).alias("verdict")
    )
