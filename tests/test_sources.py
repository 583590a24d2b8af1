"""Round trips of sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalforge.operators import archive
from evalforge.sources import ledger
from evalforge.sources.outcomes import SCHEMA
from evalforge.streaming import archive as stream

ROW = dict(candidate_id="c", target_id="t", task_id="k", seed=1, is_base=True, split="id", transfer_group=None, correct=True, input_tokens=1, output_tokens=2)


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    d = spark.createDataFrame([tuple((ROW | {"seed": s}).values()) for s in (2, 1)], SCHEMA)
    ledger.replace(d, path)
    ledger.append(d.withColumn("seed", F.col("seed") + 10), path)
    assert [r.seed for r in ledger.read_outcomes(spark, path).orderBy("seed").collect()] == [1, 2, 11, 12]
    with pytest.raises(ledger.LedgerError):
        ledger.replace(d.unionByName(d), path)
    bad = tmp_path / "bad.jsonl"
    bad.write_text(json.dumps(ROW) + "\n\n{broken\n[1]\n")
    assert [(r.line, r.text) for r in ledger.bad_lines(spark, str(bad)).orderBy("line").collect()] == [(3, "{broken"), (4, "[1]")]
    with pytest.raises(Exception, match="(?i)malformed"):
        ledger.read_outcomes(spark, str(bad)).collect()


def test_cache(spark, tmp_path):
    c = ledger.Cache(spark, str(tmp_path / "cache"), T.StructType().add("cache_key", "string").add("value", "long"))
    d = spark.createDataFrame([("aa1", 1), ("ab2", 2)], "cache_key string, value long")
    assert c.put(d) == 2 and c.put(d) == 0
    assert c.get(spark.createDataFrame([("ab2",), ("zz",)], "cache_key string")).collect()[0].value == 2
    with pytest.raises(ledger.LedgerError):
        c.put(d.withColumn("value", F.lit(9).cast("long")))
    assert sorted(r.cache_key for r in c.keys().collect()) == ["aa1", "ab2"]
    ledger.replay(d.select("cache_key"), d)
    with pytest.raises(ledger.LedgerError):
        ledger.replay(spark.createDataFrame([("q",)], "cache_key string"), d)


def test_manifests(spark, tmp_path):
    f = tmp_path / "tasks.jsonl"
    f.write_text("\n".join(json.dumps(dict(task_id=f"k{i}", split_id="s", domain_id="d", group_id="g", objective_roles=["id", "transfer"])) for i in range(2)))
    digest = ledger.file_digests(spark, str(f)).first()
    assert ledger.read_manifest(spark, str(f), 2, digest.sha256).count() == 4
    with pytest.raises(ledger.LedgerError):
        ledger.read_manifest(spark, str(f), 3)
    with pytest.raises(ledger.LedgerError):
        ledger.read_manifest(spark, str(f), 2, "0" * 64)
    ids = tmp_path / "ids.jsonl"
    ids.write_text('"a"\n{"task_id": "b"}\n\n{"id": "c"}\n')
    assert sorted(r.task_id for r in ledger.read_task_ids(spark, str(ids)).collect()) == ["a", "b", "c"]
    for text in ('{"tasks": [{"x": 1}, 2]}', '[{"x": 1}, 2]'):
        ids.write_text(text)
        assert [r.item for r in ledger.read_collection(spark, str(ids), "tasks").orderBy("pos").collect()] == ['{"x":1}', "2"]


def test_patches(spark, tmp_path):
    e, p = tmp_path / "e.jsonl", tmp_path / "p.jsonl"
    e.write_text(json.dumps(dict(evidence_id="e1", task_id="k", seed=1, target_id="t", outcome=False, tags=["x"])))
    good = dict(patch_id="p", operation="add", target_path="S.md", parent_version_id="$BASE", evidence_ids=["e1"], content="c", sequence=1)
    p.write_text(json.dumps(good))
    evidence = ledger.read_evidence(spark, str(e))
    assert ledger.read_patches(spark, str(p), "v0", evidence).first().parent_version_id == "v0"
    for bad in (good | {"evidence_ids": ["nope"]}, good | {"parent_version_id": "v9"}):
        p.write_text(json.dumps(bad))
        with pytest.raises(ledger.LedgerError):
            ledger.read_patches(spark, str(p), "v0", evidence)


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"a": {"b": 1}, "k": "${NAME}"}')
    assert ledger.load_config(str(f), {"a.b": 2, "x.y": 3}, {"NAME": "v"}) == {"a": {"b": 2}, "k": "v", "x": {"y": 3}}
    with pytest.raises(ledger.LedgerError):
        ledger.load_config(str(f))


def test_stream_front(spark, tmp_path):
    schema = "run_id string, candidate_id string, reasons array<string>, v1 double, v2 double"
    rows = [("r", f"c{i}", ["bad"] if i % 5 == 0 else [], float(i * 7 % 11), float(i * 5 % 13)) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(stream.front_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.candidate_id for r in spark.read.parquet(str(tmp_path / "out/version=3")).collect()}
    want = {r.candidate_id for r in archive.scientific_front(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def test_stream_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:01:00' + make_interval(0,0,0,0,0,i) ts, 'p' provider_id, 1L input_tokens, 2L output_tokens from (select explode(sequence(0, 20)) i)").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, provider_id string, input_tokens long, output_tokens long").parquet(str(tmp_path / "in"))
    q = stream.usage_by_window(s).writeStream.format("memory").queryName("usage").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(provider_calls) n from usage").first().n == 21
