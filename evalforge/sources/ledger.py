"""Ledgers, caches and manifests as Spark sources and sinks."""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import newline_normal, normal_path
from ..operators import checks
from ..operators.verify import canonical
from .outcomes import KEY, SCHEMA


class LedgerError(ValueError):
    """A table breaks a rule of its ledger."""


def require_none(df: DataFrame, what: str) -> None:
    """An error that names the first rows, if there are any."""
    found = df.limit(5).collect()
    if found:
        raise LedgerError(f"{what}: {[r.asDict() for r in found]}")


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of outcomes; a malformed line fails the read."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line number and text of lines that aren't JSON objects; blank lines are fine.

    Files are read in splits; a line's number is its place in its split and the lines of the splits before.
    """
    text = F.col("value")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), text.alias("text"))
    blank = F.btrim("text", F.lit(" \r\t")) == ""
    whole = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("text")), F.lit("OBJECT")), F.lit(False))
    marked = lines.select("file", "split", F.when(~blank & ~whole, F.col("text")).alias("text"))

    def number(batches):
        at, n = None, 0
        out: list[tuple] = []
        for b in batches:
            for file, split, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, split) != at:
                    if at:
                        out.append((*at, n, None))
                    at, n = (file, split), 0
                n += 1
                if text is not None:
                    out.append((*at, n, text))
            if out:
                yield _line_batch(out)
                out = []
        if at:
            yield _line_batch([(*at, n, None)])

    got = marked.mapInArrow(number, "file string, split long, n long, text string")
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = got.where("text is null").groupBy("file", "split").agg(F.max("n").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return got.where("text is not null").join(before, ["file", "split"]).select("file", (F.col("before") + F.col("n")).alias("line"), "text")


def _line_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "split", "n", "text"])


def append(df: DataFrame, path: str) -> None:
    """Appends rows to a JSON-lines ledger."""
    df.write.mode("append").json(path)


def replace(df: DataFrame, path: str, key: list[str] | None = None) -> None:
    """Replaces a ledger by rows with unique keys, sorted by them; the write is committed as a whole."""
    key = key or KEY
    require_none(checks.duplicates(df, key), "keys occur twice")
    df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").json(path)


class Cache:
    """Content-addressed cache: Parquet by the first two digits of the key, so that lookups prune partitions."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "cache_key"):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def read(self) -> DataFrame:
        """All entries."""
        full = T.StructType([*self.schema.fields, T.StructField("prefix", T.StringType())])
        try:
            return self.spark.read.schema(full).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], full)
            raise

    def get(self, keys: DataFrame) -> DataFrame:
        """Entries of these keys."""
        wanted = keys.select(self.key).distinct().withColumn("prefix", F.substring(self.key, 1, 2))
        return self.read().join(wanted, ["prefix", self.key]).drop("prefix")

    def put(self, df: DataFrame) -> int:
        """Adds entries that are new; an entry that differs from the stored one is an error.  Returns how many were added."""
        require_none(checks.duplicates(df.distinct(), [self.key]), "one key, several entries")
        old = self.read().drop("prefix")
        names = [f.name for f in self.schema.fields]
        same = old.join(df.select(self.key), self.key, "left_semi").select(names)
        require_none(df.select(names).join(same.select(self.key), self.key, "left_semi").exceptAll(same), "entries differ from the cache")
        new = df.select(names).distinct().join(old.select(self.key), self.key, "left_anti").withColumn("prefix", F.substring(self.key, 1, 2)).persist()
        n = new.count()
        if n:
            new.write.mode("append").partitionBy("prefix").parquet(self.path)
        new.unpersist()
        return n

    def keys(self) -> DataFrame:
        """Distinct keys."""
        return self.read().select(self.key).distinct()

    def problems(self) -> DataFrame:
        """(key, problem) of entries in the wrong folder, keys that aren't digests, and keys stored twice."""
        all_, key = self.read(), F.col(self.key)
        odd = F.array_compact(F.array(F.when(key.isNull() | ~key.rlike(r"\A[0-9a-f]{64}\z"), F.lit("no_digest")), F.when(~F.col("prefix").eqNullSafe(F.substring(key, 1, 2)), F.lit("wrong_folder"))))
        again = checks.duplicates(all_, [self.key]).select(self.key, F.lit("stored_twice").alias("problem"))
        return all_.select(self.key, F.explode(odd).alias("problem")).unionByName(again)


class GenerationCache(Cache):
    """Cache of generations in an envelope: the version of its form and the digest of the request that it answers."""

    VERSION = 1

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, T.StructType().add("cache_key", "string").add("version", "integer").add("request", "string").add("response", "string"))

    def get(self, keys: DataFrame) -> DataFrame:
        """Entries of these keys; an envelope of another form or for another request is an error."""
        got = super().get(keys)
        require_none(got.where(f"version <> {self.VERSION} or sha2(request, 256) <> cache_key").select("cache_key"), "envelopes don't fit")
        return got

    def store(self, requests: DataFrame) -> int:
        """Adds (request, response) under the request's digest."""
        return self.put(requests.select(F.sha2("request", 256).alias("cache_key"), F.lit(self.VERSION).alias("version"), "request", "response"))


def _yaml(path: str):
    import yaml  # optional: only for YAML files

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def read_collection(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(pos, item JSON) of a list: JSON lines (.jsonl), or a JSON or YAML file that is a list or holds it under one of ``keys``.

    YAML is read by the driver: it can't be split.
    """
    v = F.parse_json("value")
    items = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in keys], F.try_variant_get(v, "$", "array<variant>"))
    if path.endswith(".jsonl"):
        lines = spark.read.text(path).where(F.btrim("value", F.lit(" \r\t")) != "")
        if lines.limit(2).where(items.isNotNull()).count() != 1 or lines.limit(2).count() > 1:  # else one line that holds the list
            return lines.select(F.monotonically_increasing_id().alias("pos"), F.to_json(v).alias("item"))
    if path.endswith((".yaml", ".yml")):
        whole = spark.createDataFrame([(json.dumps(_yaml(path)),)], "value string")
    else:
        whole = spark.read.text(path, wholetext=True)
    found = whole.select(F.posexplode(items).alias("pos", "item")).select(F.col("pos").cast("long").alias("pos"), F.to_json("item").alias("item"))
    if found.isEmpty() and whole.select(items.alias("i")).where("i is not null").isEmpty():
        raise LedgerError(f"no list in {path}")
    return found


def read_task_ids(spark: SparkSession, path: str) -> DataFrame:
    """task_id of a list of strings, or of objects with task_id or id; the list may lie under task_ids or tasks."""
    v = F.parse_json("item")
    text = lambda p: F.try_variant_get(v, p, "string")
    got = read_collection(spark, path, "task_ids", "tasks").select(F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(F.coalesce(text("$.task_id"), text("$.id"))).alias("task_id"))
    require_none(got.where("task_id is null or task_id = ''"), "items without an id")
    require_none(checks.duplicates(got, ["task_id"]), "tasks occur twice")
    return got


_TASK = {"task_id": "string", "split_id": "string", "domain_id": "string", "group_id": "string", "objective_roles": "array<string>", "payload": "string", "verifier": "string"}


def read_manifest(spark: SparkSession, path: str, expected_count: int | None = None, expected_sha256: str | None = None) -> DataFrame:
    """Task manifest: one row for each task and objective role; digest, count, keys and unique ids are checked.

    ``path``: JSON lines, or a JSON object (.json) with the tasks under "tasks".
    """
    if expected_sha256:
        got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).first()
        if got is None or got.d != expected_sha256:
            raise LedgerError("the manifest's digest differs")
    items = read_collection(spark, path, "tasks")
    require_none(items.where(F.size(F.array_except(F.json_object_keys("item"), F.array(*map(F.lit, _TASK)))) > 0), "tasks with unknown keys")
    v = F.parse_json("item")
    plain = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.to_json(F.try_variant_get(v, f"$.{k}", "variant")))
    tasks = items.select(*[(F.try_variant_get(v, f"$.{k}", t) if t != "string" else plain(k)).alias(k) for k, t in _TASK.items()])
    require_none(tasks.where("task_id is null or objective_roles is null or size(objective_roles) = 0"), "tasks without id or roles")
    require_none(checks.duplicates(tasks, ["task_id"]), "tasks occur twice")
    if expected_count is not None and (n := tasks.count()) != expected_count:
        raise LedgerError(f"{n} tasks, {expected_count} declared")
    return tasks.withColumn("objective_role", F.explode("objective_roles")).drop("objective_roles")


FAILURE = {"failure_id": "string", "request_fingerprint": "string", "stage": "string", "error_type": "string", "attempt_number": "int", "retry_limit": "int", "will_retry": "boolean"}


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure events (JSON lines), each id once; other fields than FAILURE's, or an id with two contents, are an error."""
    lines = spark.read.text(path).where(F.btrim("value", F.lit(" \r\t")) != "")
    wanted = F.array(*[F.lit(k) for k in sorted(FAILURE)])
    require_none(lines.where(~F.array_sort(F.json_object_keys("value")).eqNullSafe(wanted)), "events with other fields")
    events = lines.select(F.from_json("value", ", ".join(f"{k} {t}" for k, t in FAILURE.items()), {"mode": "FAILFAST"}).alias("e")).select("e.*")
    require_none(checks.varying(events, ["failure_id"], [k for k in FAILURE if k != "failure_id"]), "one failure id, several events")
    return events.dropDuplicates(["failure_id"])


def write_failures(events: DataFrame, path: str, old: DataFrame | None = None) -> None:
    """Replaces the ledger of failure events, by ``old`` and new ones if old ones are given."""
    every = events if old is None else old.unionByName(events.select(old.columns))
    require_none(checks.varying(every, ["failure_id"], [k for k in FAILURE if k != "failure_id"]), "one failure id, several events")
    every.dropDuplicates(["failure_id"]).coalesce(1).sortWithinPartitions("failure_id").write.mode("overwrite").json(path, ignoreNullFields=False)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence table with unique ids, at least one row."""
    e = spark.read.schema("evidence_id string, task_id string, seed long, target_id string, outcome boolean, verifier_summary string, trace_uri string, tags array<string>").option("mode", "FAILFAST").json(path)
    require_none(checks.duplicates(e, ["evidence_id"]), "evidence ids occur twice")
    if e.isEmpty():
        raise LedgerError("no evidence")
    return e


def read_patches(spark: SparkSession, path: str, base_version: str, evidence: DataFrame) -> DataFrame:
    """Patch pool in order of (sequence, patch_id): $BASE is bound, parents and evidence ids must exist."""
    p = spark.read.schema("patch_id string, operation string, target_path string, parent_version_id string, evidence_ids array<string>, content string, match_text string, sequence long").option("mode", "FAILFAST").json(path)
    p = p.withColumn("parent_version_id", F.when(F.col("parent_version_id") == "$BASE", base_version).otherwise(F.col("parent_version_id")))
    require_none(checks.duplicates(p, ["patch_id"]), "patch ids occur twice")
    require_none(p.where(~F.col("parent_version_id").eqNullSafe(base_version)).select("patch_id"), "patches of another parent")
    require_none(checks.orphans(p.select("patch_id", F.explode("evidence_ids").alias("evidence_id")), "evidence_id", evidence, "evidence_id"), "unknown evidence")
    return p.orderBy("sequence", "patch_id")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all text files under a folder."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of an artifact: a JSON object {"files": {path: content}}, one file, or a folder.

    Paths are relative; bytes that aren't UTF-8 and, on a local file system, links are an error.
    """
    if path.endswith(".json"):
        files = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.files"), "map<string,string>")).alias("path", "content"))
    else:
        local = path.removeprefix("file://")
        links = [local] if os.path.islink(local) else [os.path.join(d, n) for d, ds, fs in os.walk(local) for n in [*ds, *fs] if os.path.islink(os.path.join(d, n))]
        if links:
            raise LedgerError(f"links in an artifact: {links[:5]}")
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        text = F.col("content").cast("string")
        require_none(raw.where(~F.is_valid_utf8(text)).select("path"), "files that aren't UTF-8")
        inside = F.regexp_replace("path", r"\A[a-z]+:/*", "/")
        root = local.rstrip("/") + "/" if os.path.isdir(local) else os.path.dirname(local) + "/"
        files = raw.select(F.when(F.startswith(inside, F.lit(root)), F.substr(inside, F.lit(len(root) + 1))).otherwise(inside).alias("path"), text.alias("content"))
    require_none(files.where(normal_path(F.col("path")).isNull()).select("path"), "paths that leave the artifact")
    return files.select(normal_path(F.col("path")).alias("path"), newline_normal(F.col("content")).alias("content"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def replay(requests: DataFrame, results: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests with their recorded results; a miss or a repeated key is an error, never a fallback."""
    require_none(checks.duplicates(results, [key]), "recorded keys occur twice")
    require_none(requests.join(results, key, "left_anti").select(key), "no recorded result")
    return requests.join(results, key)


def replayed_generations(requests: DataFrame, results: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests with ``output``: the first of model_output, raw_response and response_text that was recorded; ``problem`` says what is missing."""
    out = F.coalesce("model_output", "raw_response", "response_text")
    j = requests.join(results.select(key, out.alias("output"), F.lit(True).alias("found_")), key, "left")
    return j.withColumn("problem", F.when(F.col("found_").isNull(), "no_record").when(F.col("output").isNull(), "no_output")).drop("found_")


def replay_misses(requests: DataFrame, results: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests without a recorded result."""
    return requests.join(results.select(key), key, "left_anti")


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON-lines folder."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """One JSON value as one file: written beside its place and then renamed, so that readers see the old or the new one."""
    hadoop = spark._jvm.org.apache.hadoop
    to, new = hadoop.fs.Path(path), hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = hadoop.fs.FileContext.getFileContext(to.getFileSystem(conf).getUri(), conf)
    out = to.getFileSystem(conf).create(new)
    out.write(bytearray(canonical(value).encode() + b"\n"))
    out.close()
    mode = spark._jvm.java.lang.reflect.Array.newInstance(hadoop.fs.Options.Rename.OVERWRITE.getClass(), 1)
    mode[0] = hadoop.fs.Options.Rename.OVERWRITE
    files.rename(new, to, mode)


def load_config(path: str, overrides: dict[str, object] | None = None, environment: dict[str, str] | None = None, profile: str | None = None) -> dict:
    """Driver-side JSON or YAML configuration with dotted overrides and ${NAME} placeholders from ``environment``.

    A ``profile`` is a set of dotted overrides that the file has under "profiles"; ``overrides`` come after it.
    """
    text = open(path, encoding="utf-8").read()
    try:
        config = json.loads(text)
    except ValueError:
        import yaml  # optional: only for YAML files

        config = yaml.safe_load(text)
    if not isinstance(config, dict):
        raise LedgerError("a configuration is a mapping")
    profiles = config.pop("profiles", {}) if profile is not None else {}
    if profile is not None:
        if profile not in profiles:
            raise LedgerError(f"no profile {profile!r}")
        overrides = {**profiles[profile], **(overrides or {})}
    for dotted, value in (overrides or {}).items():
        at = config
        *parents, last = dotted.split(".")
        for p in parents:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise LedgerError(f"{dotted} leads through a value")
        at[last] = value

    def resolve(x):
        if isinstance(x, dict):
            return {k: resolve(v) for k, v in x.items()}
        if isinstance(x, list):
            return [resolve(v) for v in x]
        if isinstance(x, str) and x.startswith("${") and x.endswith("}"):
            name = x[2:-1]
            if name not in (environment or {}):
                raise LedgerError(f"no value for {name}")
            return environment[name]
        return x

    return resolve(config)
