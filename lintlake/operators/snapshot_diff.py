"""What changed between consecutive full snapshots, by a bucketed key-to-hash index.

``SnapshotStore`` keeps one index row per record of a snapshot in a table bucketed by the record's hash: which item it
belongs to, its key within the item, its state's hash and flags, no strings. Coming snapshots are loaded into the same
buckets, so that a probe of the last snapshot's index with the new rows joins bucket with bucket and shuffles neither.
What changed is written down before the pointer moves to the new index; a run that dies half-way is repeated from the
old one. Indexes before the last are dropped.

``scan_diff`` applies the runs of all targets in order: the n-th step probes every target's run n with its run n - 1.
Step by step only one row per item and bucket is shuffled, after partial aggregation, so that an item that holds a
third of all rows is a few rows. Strings are fetched from the snapshots for changed items alone.

Nulls equal nulls. Duplicate rows and snapshots delivered twice collapse in the first, map-side combined aggregation.
Rows whose run is unknown have no order and are left out.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.sources.tables import cut, ensure_checkpoint_dir

#: Rows of a snapshot in one bucket of the index, about.
BUCKET_ROWS = 1_000_000
#: Changed items whose hashes (16 bytes each) are broadcast to pick their strings; more meet them through a shuffle.
MOST_BROADCAST = 1_000_000
#: Runs whose order is broadcast; more meet the rows through a shuffle over salts.
MOST_RUNS = 200_000
SALTS = 32
#: Flags of an index row: source reachable with authentication only, without it, another snapshot of the source comes.
GATED, OPEN, MORE = 1, 2, 4
#: Stands for null inside a hash, since hash functions skip nulls.
NULL_MARK = "\u0000null"


def _hash(*cols: str | Column, seed: int = 0) -> Column:
    parts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(NULL_MARK)) for c in cols]
    return F.xxhash64(F.lit(seed), F.lit(len(parts)), *parts)


def ordered_runs(runs: DataFrame) -> DataFrame:
    """Runs numbered per target by ``started_at`` (ties by ``scan_run_id``): ``seq`` from 1, ``last_seq``; one row a run."""
    one = runs.groupBy("scan_run_id").agg(
        F.min(F.struct("target", "started_at")).alias("r"),
        F.min("auth_only_js_urls").alias("auth_only_js_urls"),
    )
    w = Window.partitionBy("target")
    return one.select("scan_run_id", "r.target", "r.started_at", "auth_only_js_urls").select(
        "scan_run_id",
        "target",
        F.row_number().over(w.orderBy("started_at", "scan_run_id")).alias("seq"),
        F.count(F.lit(1)).over(w).alias("last_seq"),
        F.transform(F.coalesce("auth_only_js_urls", F.array().cast("array<string>")), lambda u: _hash(u, seed=3)).alias("auth"),
    )




def _changed(same: Column) -> Column:
    """Whether a record that is in both snapshots has another state in one of them."""
    return F.coalesce(~same, F.lit(False))


class SnapshotStore:
    """The index of the last snapshot in a folder, bucketed by the record's hash.

    ``load`` puts the index rows of coming snapshots into the buckets, one step each; ``advance`` probes the current
    step with the next one, stores the changes of items below the step, then moves ``CURRENT``. ``apply`` does both
    for one snapshot with the given key and state columns and fetches old and new values of what changed.
    """

    INDEX = "v1 bigint, v2 bigint, k bigint, lo bigint, hi bigint, flags int"

    def __init__(self, spark: SparkSession, path: str, key: list[str] = [], state: list[str] = [], buckets: int = 64):
        self.spark, self.path, self.key, self.state, self.buckets = spark, path, key, state, buckets
        self.name = "snapshot_index_" + hashlib.md5(path.encode()).hexdigest()
        self.folder = f"{path}/index"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def current(self) -> int:
        """The step that the pointer names; 0 before the first."""
        fs, p = self._fs(f"{self.path}/CURRENT")
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT").first()[0])["step"] if fs.exists(p) else 0

    def _swap(self, step: int) -> None:
        fs, new = self._fs(f"{self.path}/CURRENT.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"step": step}).encode()))
        out.close()
        _, p = self._fs(f"{self.path}/CURRENT")
        fs.delete(p, False)
        fs.rename(new, p)

    def load(self, entries: DataFrame) -> None:
        """Writes (step, v1, v2, k, lo, hi, flags, ...) into the buckets; a step that stands there is replaced."""
        self._register()
        for r in entries.select("step").distinct().collect() if self.spark.catalog.tableExists(self.name) else []:
            self._drop(r.step)
        placed = entries.repartition(self.buckets, "v1", "v2", "k").sortWithinPartitions("step", "v1", "v2", "k")
        writer = placed.write.format("parquet").mode("append").partitionBy("step").bucketBy(self.buckets, "v1", "v2", "k").sortBy("v1", "v2", "k")
        writer.option("path", self.folder).saveAsTable(self.name)

    def _register(self) -> None:
        """Makes a table that an earlier session wrote known to this one."""
        fs, p = self._fs(self.folder)
        if fs.exists(p) and not self.spark.catalog.tableExists(self.name):
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(self.folder).schema if f.name != "step")
            self.spark.sql(
                f"create table {self.name} ({kinds}, step int) using parquet partitioned by (step) clustered by (v1, v2, k) sorted by (v1, v2, k) into {self.buckets} buckets location '{self.folder}'"
            )
            self.spark.sql(f"msck repair table {self.name}")

    def _drop(self, step: int) -> None:
        self.spark.sql(f"alter table {self.name} drop if exists partition (step = {step})")
        fs, p = self._fs(f"{self.folder}/step={step}")
        fs.delete(p, True)

    def version(self, step: int) -> DataFrame:
        return self.spark.table(self.name).where(F.col("step") == step).drop("step")

    def _probe(self, step: int, columns: list[str]) -> DataFrame:
        """The records of both steps side by side, bucket by bucket; ``in_old`` and ``in_new`` say where each stands."""
        old = self.version(step - 1).where(F.col("flags").bitwiseAND(MORE) != 0)
        o = old.select("v1", "v2", "k", F.lit(True).alias("in_old"), *[F.col(c).alias(f"old_{c}") for c in columns])
        n = self.version(step).select("v1", "v2", "k", F.lit(True).alias("in_new"), *[F.col(c).alias(f"new_{c}") for c in columns])
        return o.join(n, ["v1", "v2", "k"], "full")

    def advance(self, step: int) -> DataFrame | None:
        """Changes of items (v1, v2, diff) between the step before and this one, stored before the index is swapped."""
        if step > self.current():
            if step > 1:
                same = (F.col("old_lo") == F.col("new_hi")) & (F.col("old_hi") == F.col("new_lo")) & (F.col("old_lo") == F.col("old_hi"))
                both = F.col("in_old") & F.col("in_new")
                rows = self._probe(step, ["lo", "hi", "flags"]).groupBy("v1", "v2").agg(
                    F.max(F.coalesce("in_old", F.lit(False))).alias("was"), F.max(F.coalesce("in_new", F.lit(False))).alias("now"),
                    F.max(both & _changed(same)).alias("changed"),
                    F.max(F.coalesce(F.col("old_flags").bitwiseAND(GATED) != 0, F.lit(False))).alias("gated"), F.max(F.coalesce(F.col("new_flags").bitwiseAND(OPEN) != 0, F.lit(False))).alias("open"),
                )
                kinds = F.array_compact(F.array(
                    F.when(F.col("now") & ~F.col("was"), "added"), F.when(F.col("was") & ~F.col("now"), "removed"), F.when(F.col("changed"), "changed"), F.when(F.col("gated") & F.col("open"), "regression"),
                ))
                rows.select("v1", "v2", F.explode(kinds).alias("diff")).write.mode("overwrite").parquet(f"{self.path}/diff/step={step}")
            self._swap(step)
            if step > 2:
                self._drop(step - 2)
        return self.changes(step) if step > 1 else None

    def changes(self, step: int) -> DataFrame:
        return self.spark.read.schema("v1 bigint, v2 bigint, diff string").parquet(f"{self.path}/diff/step={step}")

    def all_changes(self) -> DataFrame | None:
        """(v1, v2, diff, step) of every step so far."""
        fs, p = self._fs(f"{self.path}/diff")
        return self.spark.read.schema("v1 bigint, v2 bigint, diff string, step int").parquet(f"{self.path}/diff") if fs.exists(p) else None

    def entries(self, snapshot: DataFrame, step: int) -> DataFrame:
        """Index rows of one snapshot with its values; several states of a key are one record with the smallest."""
        st = _hash(*self.state, seed=4)
        one = snapshot.groupBy(*self.key).agg(F.min(st).alias("_lo"), F.max(st).alias("_hi"), F.min(F.struct(*self.state)).alias("_state"))
        return one.select(
            F.lit(step).alias("step"), _hash(*self.key, seed=1).alias("v1"), _hash(*self.key, seed=2).alias("v2"), F.lit(0).cast("bigint").alias("k"),
            F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.lit(MORE).alias("flags"), F.struct(*self.key).alias("key"), F.col("_state").alias("state"),
        )

    def apply(self, snapshot: DataFrame) -> DataFrame:
        """(change, key columns, old_<state>, new_<state>) against the last snapshot; the first one is all ``added``.

        The result is stored with the step: it can be read again, and is there before the index is swapped.
        """
        step = self.current() + 1
        self.load(self.entries(snapshot, step))
        same = (F.col("old_lo") == F.col("new_lo")) & (F.col("old_hi") == F.col("new_hi"))
        change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~same, "changed")
        found = self._probe(step, ["lo", "hi"]).select("v1", "v2", "k", change.alias("change")).where("change is not null")
        at = f"{self.path}/result/step={step}"
        found.write.mode("overwrite").parquet(f"{at}/hashes")
        found = self.spark.read.parquet(f"{at}/hashes")
        for side, number, gone in (("old", step - 1, "added"), ("new", step, "removed")):
            values = self.version(number).select("v1", "v2", "k", F.col("key").alias(f"{side}_key"), F.col("state").alias(f"{side}_state"))
            found = found.join(found.where(F.col("change") != gone).select("v1", "v2", "k").join(values, ["v1", "v2", "k"]), ["v1", "v2", "k"], "left")
        key = F.coalesce("new_key", "old_key")
        found.select("change", *[key[c].alias(c) for c in self.key], *[F.col(f"{side}_state")[c].alias(f"{side}_{c}") for side in ("old", "new") for c in self.state]).write.mode("overwrite").parquet(f"{at}/values")
        self._swap(step)
        if step > 2:
            self._drop(step - 2)
        return self.spark.read.parquet(f"{at}/values")

    def close(self) -> None:
        """Drops the index; stored changes stay."""
        self.spark.sql(f"drop table if exists {self.name}")
        fs, p = self._fs(self.folder)
        fs.delete(p, True)


def placed(rows: DataFrame, order: DataFrame, runs: int) -> DataFrame:
    """``rows`` with ``_run``, the order of their run; a run that holds a third of all rows is spread over salts."""
    line = order.select(F.col("scan_run_id").alias("_id"), F.struct("target", "seq", "last_seq", "auth").alias("_run"))
    if runs <= MOST_RUNS:
        return rows.join(F.broadcast(line), F.col("scan_run_id") == F.col("_id")).drop("_id")
    many = line.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("_part", F.pmod(F.xxhash64("_item", "_k"), F.lit(SALTS)).cast("int"))
    return spread.join(many, (F.col("scan_run_id") == F.col("_id")) & (F.col("_part") == F.col("_salt"))).drop("_id", "_part", "_salt")


class Family:
    """One table of a snapshot: what names an item, its key within the item, its state, and the diff fields."""

    def __init__(self, rows: DataFrame, item: Column, key: list[str], state: list[str], names: dict[str, str]):
        self.names, self.label = names, ",".join(sorted(names.values()))
        source = _hash("source_url", seed=3) if "source_url" in rows.columns else F.lit(0).cast("bigint")
        self.rows = rows.select("scan_run_id", item.alias("_item"), _hash(*key, seed=5).alias("_k"), _hash(*state, seed=4).alias("_st"), source.alias("_s"))

    def hashed(self, order: DataFrame, runs: int) -> DataFrame:
        parts = (F.lit(self.label), F.col("_run.target"), F.col("_item"))
        return placed(self.rows, order, runs).withColumns({"v1": _hash(*parts, seed=1), "v2": _hash(*parts, seed=2)})

    def entries(self, order: DataFrame, runs: int) -> DataFrame:
        gated = F.array_contains("_run.auth", F.col("_s"))
        flags = F.when(gated, GATED).otherwise(OPEN) + F.when(F.col("_run.seq") < F.col("_run.last_seq"), MORE).otherwise(0)
        return self.hashed(order, runs).select(F.col("_run.seq").alias("step"), "v1", "v2", F.col("_k").alias("k"), F.col("_st").alias("st"), flags.alias("flags"))


def diff_families(families: list[Family], runs: DataFrame) -> DataFrame:
    """(scan_run_id, diff_field, item) for each run after the first of its target, over all ``families``."""
    spark = runs.sparkSession
    order = cut(ordered_runs(runs))
    size = order.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("seq"), F.lit(0)).alias("steps")).first()
    total = sum(f.rows.count() for f in families)
    store = SnapshotStore(spark, f"{ensure_checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}", buckets=min(4096, max(8, total // BUCKET_ROWS // max(1, size.steps))))
    entries = None
    for f in families:
        one = f.entries(order, size.n)
        entries = one if entries is None else entries.unionByName(one)
    store.load(entries.groupBy("step", "v1", "v2", "k").agg(F.min("st").alias("lo"), F.max("st").alias("hi"), F.bit_or("flags").alias("flags")))
    for step in range(1, size.steps + 1):
        store.advance(step)
    store.close()
    changes = store.all_changes()
    if changes is None:
        changes = spark.createDataFrame([], "v1 bigint, v2 bigint, diff string, step int")
    few = changes.count() <= MOST_BROADCAST
    found = None
    for f in families:
        items = f.hashed(order, size.n).select("v1", "v2", F.col("_run.target").alias("target"), F.col("_item").alias("item"))
        hit = changes.select("v1", "v2").distinct()
        if few:
            items = items.join(F.broadcast(hit), ["v1", "v2"], "left_semi")
        kinds = F.create_map(*[F.lit(x) for kv in f.names.items() for x in kv])
        one = changes.withColumn("diff_field", F.try_element_at(kinds, F.col("diff"))).where("diff_field is not null").join(items.distinct(), ["v1", "v2"]).select("target", "step", "diff_field", "item")
        found = one if found is None else found.unionByName(one)
    line = order.select("target", F.col("seq").alias("step"), "scan_run_id")
    line = F.broadcast(line) if size.n <= MOST_RUNS else line
    return found.join(line, ["target", "step"]).select("scan_run_id", "diff_field", "item")


def diff_runs(rows: DataFrame, runs: DataFrame, value: Column, key: list[str], state: list[str], names: dict[str, str]) -> DataFrame:
    """(scan_run_id, diff_field, item) for each run after the first of its target.

    ``value`` names the item; ``key`` finds the same record in the run before; ``state`` are the columns whose change
    counts. ``names`` maps added, removed, changed and regression to diff fields; a kind that it lacks is left out.
    """
    return diff_families([Family(rows, value, key, state, names)], runs)


def scan_diff(snapshot_endpoints: DataFrame, snapshot_secrets: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """All diff fields of every run after the first: (scan_run_id, diff_field, item), one row per distinct item.

    A null endpoint value is an item of its own (null); null parts of a secret's name count as empty text.
    """
    endpoints = Family(
        snapshot_endpoints, F.col("value"), ["pattern_name", "source_url"], ["tag", "environment"],
        {"added": "new_endpoints", "removed": "removed_endpoints", "changed": "changed_endpoints", "regression": "access_control_regressions"},
    )
    secret = F.concat(F.coalesce("secret_type", F.lit("")), F.lit(":"), F.coalesce("partial_hash", F.lit("")))
    secrets = Family(snapshot_secrets, secret, [], [], {"added": "new_secrets", "removed": "removed_secrets"})
    return diff_families([endpoints, secrets], scan_runs)
