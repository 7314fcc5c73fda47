"""Artifacts: Parquet versions behind numbered JSON manifests.

A manifest names the files of one version; manifests have rising numbers and the highest one holds. A new one is written beside and renamed to a
number that isn't taken, the only commit point, so readers see the old or the new version, never a mixture or none, of two writers one fails, and
a failed write leaves files that no manifest names. Earlier manifests stay, for rollback() and history(). Data files are written by Spark; manifests are
small texts, written through Hadoop's file system, so a store may lie anywhere that Spark can reach and whose rename is atomic.

A publish writes its data once, by partition value, checks that no row was lost or made up on the way and that keys don't repeat, and only then
commits. Rows whose partition value is null are an error, as no reader would find them.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.relational import ContractError, duplicates, require_unique

#: The column, beside the data, whose values name the folders of a version.
PARTITION = "__partition"
MODES = ("full_replace", "partition_upsert", "snapshot_by_value")


@dataclass(frozen=True)
class Contract:
    """What an artifact promises: its key, date and availability columns, and how it is published."""

    artifact_id: str
    key: tuple[str, ...]
    required: tuple[str, ...]
    date: str | None = None
    available: str | None = None
    mode: str = "full_replace"
    partition: str | None = None

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", self.artifact_id):
            raise ContractError(f"not an artifact id: {self.artifact_id!r}")
        if self.mode not in MODES or (self.mode != "full_replace") != (self.partition is not None):
            raise ContractError("a partition goes with the partitioned modes only")


@dataclass
class Store:
    spark: SparkSession
    root: str
    contracts: dict[str, Contract] = field(default_factory=dict)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, *parts: str) -> str:
        if any(p in ("", ".", "..") or "/" in p or "\\" in p or ":" in p for p in parts):
            raise ContractError(f"a path leaves the store: {parts}")
        return "/".join([self.root.rstrip("/"), *parts])

    def _read_text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put_new(self, path: str, text: str) -> bool:
        """Write a file that must not be there yet; False if it is."""
        fs, p = self._fs(path)
        _, fresh = self._fs(f"{path}.{uuid.uuid4().hex}.new")
        stream = fs.create(fresh)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = not fs.exists(p) and fs.rename(fresh, p)
        if not done:
            fs.delete(fresh, False)
        return done

    def _listed(self, *parts: str) -> list[str]:
        fs, top = self._fs(self.path(*parts))
        return sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []

    def history(self, artifact_id: str) -> list[int]:
        """Numbers of the artifact's manifests, the last of which holds."""
        return [int(n[:8]) for n in self._listed("manifests", artifact_id) if re.fullmatch(r"\d{8}\.json", n)]

    def _text(self, artifact_id: str, number: int | None = None) -> str | None:
        numbers = self.history(artifact_id)
        if not numbers or number is not None and number not in numbers:
            return None
        return self._read_text(self.path("manifests", artifact_id, f"{number or numbers[-1]:08d}.json"))

    def manifest(self, artifact_id: str, number: int | None = None) -> dict | None:
        text = self._text(artifact_id, number)
        return None if text is None else json.loads(text)

    def names(self) -> list[str]:
        """Every artifact that has a manifest."""
        return [n for n in self._listed("manifests") if self.history(n)]

    def fingerprint(self, artifact_id: str) -> str:
        text = self._text(artifact_id)
        if text is None:
            raise ContractError(f"no manifest of {artifact_id}")
        return hashlib.sha256(text.encode()).hexdigest()

    def _next(self, artifact_id: str, m: dict, expected: str | None) -> dict:
        """Commit m, if the manifest that holds is still the expected one (its fingerprint; None: whichever it was when the publish began)."""
        numbers = self.history(artifact_id)
        if expected is not None and (expected or None) != (self.fingerprint(artifact_id) if numbers else None):
            raise ContractError(f"{artifact_id} was published again meanwhile")
        m = m | {"number": (numbers or [0])[-1] + 1}
        if not self._put_new(self.path("manifests", artifact_id, f"{m['number']:08d}.json"), json.dumps(m, sort_keys=True, indent=1)):
            raise ContractError(f"{artifact_id} was published again meanwhile")
        return m

    def _described(self, c: Contract, parts: dict[str, str], df: DataFrame) -> dict:
        spans = [F.min(c.date).cast("string").alias("low"), F.max(c.date).cast("string").alias("high")] if c.date else []
        found = df.agg(F.count("*").alias("n"), *spans).first()
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        return {"artifact_id": c.artifact_id, "status": "ready", "key": list(c.key), "date": c.date, "available": c.available, "mode": c.mode, "partition": c.partition, "partitions": parts, "columns": kinds, "rows": found.n, "date_range": [found.low, found.high] if c.date else None}

    def _version(self, c: Contract, df: DataFrame) -> dict[str, str]:
        """Write df once; the folder of each partition value, or of all rows."""
        folder = uuid.uuid4().hex
        path = self.path("data", c.artifact_id, folder)
        if c.mode == "full_replace":
            df.write.mode("errorifexists").parquet(path)
            return {"": path}
        by = df.withColumn(PARTITION, F.col(c.partition).cast("string"))
        by.hint("rebalance", F.col(PARTITION)).write.mode("errorifexists").partitionBy(PARTITION).parquet(path)
        plain = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {plain(n.partition("=")[2]): f"{path}/{n}" for n in self._listed("data", c.artifact_id, folder) if n.startswith(f"{PARTITION}=")}

    def publish(self, c: Contract, df: DataFrame, drop_absent: bool = False, expected: str | None = None) -> dict:
        """Check df against its contract and make it the artifact's version, by the contract's mode.

        partition_upsert merges touched partitions by key, incoming rows first, and keeps the rest (or, with drop_absent, drops it);
        snapshot_by_value replaces exactly one partition value. expected: the fingerprint of the manifest that df was made from ("": none yet);
        if another one holds by then, nothing is published.
        """
        missing = [x for x in (*c.required, *c.key) if x not in df.columns]
        if missing:
            raise ContractError(f"{c.artifact_id}: no columns {missing}")
        require_unique(df, c.key, c.artifact_id)
        held = self.fingerprint(c.artifact_id) if self.history(c.artifact_id) else ""
        if expected is not None and expected != held:
            raise ContractError(f"{c.artifact_id} was published again meanwhile")
        self.contracts[c.artifact_id] = c
        read = lambda paths: self.spark.read.parquet(*paths)
        if c.mode == "full_replace":
            want, parts = df.count(), self._version(c, df)
            return self._next(c.artifact_id, self._conserved(c, parts, read(parts.values()), want), held)
        counts = {r[0]: r["count"] for r in df.groupBy(F.col(c.partition).cast("string")).count().collect()}
        if None in counts:
            raise ContractError(f"{c.artifact_id}: {counts[None]} rows without a {c.partition}")
        if c.mode == "snapshot_by_value" and len(counts) != 1:
            raise ContractError(f"{c.artifact_id}: a snapshot has one value, not {sorted(counts)}")
        old = self.manifest(c.artifact_id)
        before = dict(old["partitions"]) if old else {}
        kept = {} if drop_absent else {v: p for v, p in before.items() if v not in counts}
        rows, want = df, sum(counts.values())
        touched = [p for v, p in before.items() if v in counts]
        if c.mode == "partition_upsert" and touched:
            on = list(dict.fromkeys([*c.key, c.partition]))
            stay = read(touched).join(df, on, "left_anti")
            rows, want = stay.unionByName(df, allowMissingColumns=True), want + stay.count()
        fresh = self._version(c, rows) if counts else {}
        if fresh:
            require_unique(read(fresh.values()), c.key, c.artifact_id)
        if fresh and kept:
            twice = read(kept.values()).join(df, list(c.key), "left_semi").limit(1).collect()
            if twice:
                raise ContractError(f"{c.artifact_id}: key of {twice[0]} is in another partition too")
        parts = kept | fresh
        want += read(kept.values()).count() if kept else 0
        whole = read(parts.values()) if parts else df
        return self._next(c.artifact_id, self._conserved(c, parts, whole, want), held)

    def _conserved(self, c: Contract, parts: dict[str, str], whole: DataFrame, want: int) -> dict:
        m = self._described(c, parts, whole)
        if m["rows"] != want:
            raise ContractError(f"{c.artifact_id}: {m['rows']} rows were written, not {want}")
        return m

    def rollback(self, artifact_id: str, number: int) -> dict:
        """Make an earlier version hold again, under a new number; its files must be there and hold the rows that it states."""
        m = self.manifest(artifact_id, number)
        if m is None:
            raise ContractError(f"no manifest {number} of {artifact_id}")
        held = self.fingerprint(artifact_id)
        return self._next(artifact_id, self._rebuilt(m), held)

    def reconstruct(self, c: Contract, parts: dict[str, str]) -> dict:
        """A manifest anew from data files (a folder for each partition value, "" for all rows), when manifests were lost; keys are checked."""
        held = self.fingerprint(c.artifact_id) if self.history(c.artifact_id) else ""
        whole = self.spark.read.parquet(*parts.values())
        require_unique(whole, c.key, c.artifact_id)
        self.contracts[c.artifact_id] = c
        return self._next(c.artifact_id, self._described(c, parts, whole), held)

    def _rebuilt(self, m: dict) -> dict:
        gone = [p for p in m["partitions"].values() if not self._fs(p)[0].exists(self._fs(p)[1])]
        if gone:
            raise ContractError(f"{m['artifact_id']}: files are gone: {gone[:3]}")
        rows = self.spark.read.parquet(*m["partitions"].values()).count() if m["partitions"] else 0
        if rows != m["rows"]:
            raise ContractError(f"{m['artifact_id']}: the files hold {rows} rows, not {m['rows']}")
        return m

    def read(self, artifact_id: str, columns: Sequence[str] | None = None, start: str | None = None, end: str | None = None, filters: Sequence[tuple[str, str, object]] = (), validate: str = "filtered") -> DataFrame:
        """Rows of the ready version. start and end must lie in the manifest's dates; filters are pushed to the scan.

        validate: "full" checks the row count and the key of all rows, "filtered" the key of the rows asked for, "none" nothing.
        """
        m = self.manifest(artifact_id)
        if not m or m["status"] != "ready":
            raise ContractError(f"{artifact_id} is not ready")
        before = self.fingerprint(artifact_id)
        whole = self.spark.read.parquet(*m["partitions"].values())
        if validate == "full":
            if whole.count() != m["rows"]:
                raise ContractError(f"{artifact_id}: the files don't hold {m['rows']} rows")
            require_unique(whole, m["key"], artifact_id)
        rows = whole
        if start or end:
            if not m["date"] or not m["date_range"]:
                raise ContractError(f"{artifact_id} has no date range")
            low, high = m["date_range"]
            if (start or low) < low or (end or high) > high:
                raise ContractError(f"{artifact_id} covers {low} to {high} only")
            rows = rows.where(F.col(m["date"]).between(F.lit(start or low).cast("date"), F.lit(end or high).cast("date")))
        for f in filters:
            rows = rows.where(predicate(*f))
        if validate == "filtered":
            require_unique(rows, m["key"], artifact_id)
        if self.fingerprint(artifact_id) != before:
            raise ContractError(f"{artifact_id} was published again meanwhile")
        return rows.select(*columns) if columns else rows

    def audit(self) -> DataFrame:
        """Per artifact of the store: rows, repeated keys, whether the manifest's count holds."""
        out = []
        for artifact_id in self.names():
            m = self.manifest(artifact_id)
            rows = self.spark.read.parquet(*m["partitions"].values())
            n = rows.count()
            out.append((artifact_id, n, duplicates(rows, m["key"]).count(), n == m["rows"]))
        return self.spark.createDataFrame(out, "artifact_id string, rows long, repeated_keys long, count_holds boolean")

    def archive(self, artifact_id: str, expected: str) -> int:
        """Move versions no manifest names to the archive, if the manifest is still the expected one; gives their number."""
        if self.fingerprint(artifact_id) != expected:
            raise ContractError("the manifest is another one")
        live = list(self.manifest(artifact_id)["partitions"].values())
        fs, _ = self._fs(self.path("data", artifact_id))
        versions = [(name,) for name in self._listed("data", artifact_id)]
        # Of a version that is partly superseded, the folders of partition values that are.
        partly = [v for v in versions if any(p.startswith(f"{self.path('data', artifact_id, *v)}/") for p in live)]
        dead = [v for v in versions if v not in partly and self.path("data", artifact_id, *v) not in live]
        dead += [(*v, n) for v in partly for n in self._listed("data", artifact_id, *v) if n.startswith(f"{PARTITION}=") and f"{self.path('data', artifact_id, *v)}/{n}" not in live]
        moved = 0
        for names in dead:
            to = self._fs("/".join([self.path("archive", artifact_id), *names]))[1]
            fs.mkdirs(to.getParent())
            moved += bool(fs.rename(self._fs("/".join([self.path("data", artifact_id), *names]))[1], to))
        return moved

    def write_result(self, run_id: str, tables: dict[str, DataFrame]) -> dict:
        """Write the tables of a run once, with the rows, columns and the SHA-256 of every file; a run that is there already is an error."""
        if self._listed("results", run_id):
            raise ContractError(f"the result {run_id} is there already")
        found = {}
        for name, df in tables.items():
            path = self.path("results", run_id, name)
            df.write.mode("errorifexists").parquet(path)
            found[name] = {"rows": self.spark.read.parquet(path).count(), "columns": {f.name: f.dataType.simpleString() for f in df.schema.fields}, "files": self._digests(path)}
        m = {"run_id": run_id, "tables": found}
        if not self._put_new(self.path("results", run_id, "manifest.json"), json.dumps(m, sort_keys=True, indent=1)):
            raise ContractError(f"the result {run_id} is there already")
        return m

    def read_result(self, run_id: str, verify: bool = True) -> dict[str, DataFrame]:
        """The tables of a run; with verify, only if every file has its stated SHA-256, no file is missing or new, and the counts hold."""
        text = self._read_text(self.path("results", run_id, "manifest.json"))
        if text is None:
            raise ContractError(f"no result {run_id}")
        out = {}
        for name, t in json.loads(text)["tables"].items():
            path = self.path("results", run_id, name)
            if verify and self._digests(path) != t["files"]:
                raise ContractError(f"the files of {run_id}/{name} are not those that were written")
            out[name] = self.spark.read.parquet(path)
            if verify and out[name].count() != t["rows"]:
                raise ContractError(f"{run_id}/{name} does not hold {t['rows']} rows")
        return out

    def _digests(self, path: str) -> dict[str, str]:
        """SHA-256 by file name; the files are read on the executors."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        return {r.path.rsplit("/", 1)[1]: r.digest for r in files.select("path", F.sha2("content", 256).alias("digest")).collect()}


def predicate(column: str, op: str, value: object) -> Column:
    """A pushable test of the filter grammar; strings against date columns are cast by Spark."""
    c = F.col(column)
    if op in ("in", "not in"):
        test = c.isin(list(value))
        return test if op == "in" else ~test
    tests = {"==": c.__eq__, "!=": c.__ne__, "<": c.__lt__, "<=": c.__le__, ">": c.__gt__, ">=": c.__ge__}
    if op not in tests:
        raise ContractError(f"unknown filter {op!r}")
    return tests[op](value)


def missing_sessions(calendar: DataFrame, last_ready: str, today: str) -> list[str]:
    """Sessions after last_ready up to today, which a daily run has to make; a short list."""
    rows = calendar.where((F.col("date") > F.lit(last_ready).cast("date")) & (F.col("date") <= F.lit(today).cast("date"))).select(F.col("date").cast("string")).orderBy("date")
    return [r[0] for r in rows.collect()]


TRIAL_FIELDS = frozenset({"trial_id", "family", "sharpe", "note"})


def append_trial(path: str, trial: dict) -> None:
    """Add a line to a registry of trials; its fields are fixed and ids don't repeat."""
    if set(trial) != TRIAL_FIELDS:
        raise ContractError(f"a trial has the fields {sorted(TRIAL_FIELDS)}")
    try:
        held = {json.loads(x)["trial_id"] for x in open(path, encoding="utf-8")}
    except FileNotFoundError:
        held = set()
    if trial["trial_id"] in held:
        raise ContractError("the trial is registered already")
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(trial, sort_keys=True) + "\n")
