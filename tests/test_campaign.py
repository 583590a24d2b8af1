"""A campaign that is killed after any write resumes to the tables of one that wasn't; damage is refused."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from evalforge.operators import archive, campaign
from evalforge.sources import ledger


class Killed(BaseException):
    pass


def made(spark, path, identity="one", budget=40, calls=None):
    def propose(parent, direction, batch):
        if calls is not None:
            calls.append((parent, direction, batch))
        name = F.concat(F.lit(f"{parent or 'root'}-"), F.lit(f"{direction}-{batch}-"), F.col("id").cast("string"))
        return spark.range(9).select((8 - F.col("id")).alias("draw"), F.substring(F.sha2(name, 256), 1, 12).alias("candidate_id"), F.concat(F.lit("h"), F.pmod(F.xxhash64(name), F.lit(50)).cast("string")).alias("content_hash"))

    def score(asked):
        part = lambda i: F.pmod(F.xxhash64(F.concat("candidate_id", F.lit(str(i)))), F.lit(10)) / 10.0
        return asked.select("candidate_id", (F.col("draw") % 3 + 1).alias("cost"), F.when(F.col("draw") == 2, F.array(F.lit("token_budget"))).otherwise(F.array().cast("array<string>")).alias("reasons"), part(1).alias("v1"), part(2).alias("v2"))

    return campaign.Campaign(spark, path, identity, propose, score, ["accuracy", "transfer"], 4, budget, 5, 3)


def tables(c):
    return {n: sorted(map(str, c.table(n).collect())) for n in campaign.TABLES}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    c = made(spark, path)
    c.run(3)
    return path, tables(c), c.spent()


def test_a_campaign(spark, whole):
    path, want, spent = whole
    c = made(spark, path)
    assert c.batch == 3 and tables(c) == want and c.spent() == spent <= 40
    d, p = c.table("decisions"), c.table("proposals")
    assert d.count() == 15 and {r.draw for r in p.collect()} == {0, 1, 2, 3, 4}  # the first by draw
    later = p.where("batch > 0").select("parent", "batch").distinct().collect()
    accepted = {r.candidate_id for r in d.where("accepted").collect()}
    assert len(later) == 2 and all(r.parent in accepted for r in later)
    # the decisions are those of one fold over all batches
    e = c.table("evaluations").withColumns({"run_id": F.lit("campaign"), "pos": F.col("draw") + F.col("batch") * (1 << 32)})
    again = archive.decisions(e, 4, 40).collect()
    key = lambda rows: sorted((r.pos, r.candidate_id, r.accepted, r.reason, r.removed_ids, r.spent) for r in rows)
    assert key(again) == key(d.collect())


def test_killed_after_any_write(spark, whole, tmp_path, monkeypatch):
    _, want, spent = whole
    parquet, write_json = DataFrameWriter.parquet, ledger.write_json
    for at in (1, 2, 3, 4, 5, 8, 10):  # proposals, evaluations, decisions, states, journal, and later ones
        left = {"n": at}

        def counted(f, left=left):
            def g(*a, **b):
                out = f(*a, **b)
                left["n"] -= 1
                if not left["n"]:
                    raise Killed
                return out

            return g

        path = f"{tmp_path}/{at}"
        monkeypatch.setattr(DataFrameWriter, "parquet", counted(parquet))
        monkeypatch.setattr(ledger, "write_json", counted(write_json))
        with pytest.raises(Killed):
            made(spark, path).run(3)
        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
        monkeypatch.setattr(ledger, "write_json", write_json)
        calls = []
        c = made(spark, path, calls=calls)
        c.run(3)
        assert tables(c) == want and c.spent() == spent
        assert len(calls) == 3 - (at + 4) // 5  # what was proposed isn't asked for again


def test_a_table_cut_short_is_made_again(spark, whole, tmp_path):
    path, want, _ = whole
    own = f"{tmp_path}/own"
    shutil.copytree(path, own)
    os.remove(f"{own}/journal/2.json")
    os.remove(f"{own}/evaluations/batch=2/_SUCCESS")
    for f in glob.glob(f"{own}/evaluations/batch=2/part*"):
        os.remove(f)
    c = made(spark, own)
    assert c.batch == 2
    c.run(3)
    assert tables(c) == want


@pytest.mark.parametrize("harm,said", [("identity", "another"), ("gap", "gap"), ("lost", "evaluations aren't"), ("changed", "decisions aren't"), ("orphan", "doesn't know"), ("spent", "aren't what")])
def test_damage_is_refused(spark, whole, tmp_path, harm, said):
    own = f"{tmp_path}/own"
    shutil.copytree(whole[0], own)
    if harm == "gap":
        os.remove(f"{own}/journal/1.json")
    if harm == "lost":
        os.remove(f"{own}/evaluations/batch=1/_SUCCESS")
    if harm in ("changed", "spent"):
        name = "decisions" if harm == "changed" else "states"
        t = spark.read.parquet(f"{own}/{name}/batch=1")
        t = t.withColumn("accepted", ~F.col("accepted")) if harm == "changed" else t.withColumn("state", F.regexp_replace("state", '"spent": \\d+', '"spent": 1'))
        t.write.parquet(f"{own}/new")
        shutil.rmtree(f"{own}/{name}/batch=1")
        shutil.move(f"{own}/new", f"{own}/{name}/batch=1")
    if harm == "orphan":
        shutil.copytree(f"{own}/proposals/batch=1", f"{own}/proposals/batch=4")
    with pytest.raises(campaign.CampaignError, match=said):
        made(spark, own, identity="two" if harm == "identity" else "one")


def test_budget_ends_it(spark, tmp_path):
    c = made(spark, str(tmp_path), budget=12)
    c.run(50)
    assert c.spent() <= 12 and c.batch < 50
    assert "evaluation_budget_exceeded" in {r.reason for r in c.table("decisions").collect()}
