"""Hand-checked values of the small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from evalforge.functions import canonical
from evalforge.operators import accounting, archive, bootstrap, checks, dedup, inference, lineage, objectives, pareto, selection, verify

PAIR = "candidate_id string, task_id string, seed long, split string, target_id string, candidate_correct boolean, base_correct boolean, input_tokens long, output_tokens long, grp string"
#: Nine rows worked out by hand below: (candidate, task, seed, split, target, candidate right, base right, tokens in, tokens out, group).
NINE = [
    ("c", "k1", 3, "id", "home", True, False, 21, 4, None),
    ("c", "k2", 3, "id", "home", False, False, 17, 3, None),
    ("c", "k3", 3, "id", "home", True, True, 30, 5, None),
    ("c", "k4", 3, "id", "home", False, True, 12, 6, None),
    ("c", "k1", 3, "transfer", "north", True, True, 25, 1, "cold"),
    ("c", "k2", 3, "transfer", "north", True, False, 14, 2, "cold"),
    ("c", "k3", 3, "transfer", "north", False, True, 19, 1, "cold"),
    ("c", "k1", 4, "transfer", "south", False, True, 16, 4, "warm"),
    ("c", "k2", 4, "transfer", "south", True, True, 22, 8, "warm"),
]


@pytest.fixture(scope="module")
def nine(spark):
    return spark.createDataFrame(NINE, PAIR)


def test_objectives(nine):
    r = objectives.objectives(nine).first()
    # 2 of 4 id rows; groups 2/3 and 1/2; of 6 rows that the base gets right 3 are lost; 210 tokens; +1 and -1 on id rows
    assert (r.accuracy, r.transfer, r.regression, r.token_cost, r.delta) == (0.5, 0.5, 0.5, pytest.approx(210 / 9), 0.0)
    c = objectives.block_counts(nine).first()
    assert (c.blocks, c.id_blocks, c.transfer_blocks, c.base_correct_blocks) == (6, 4, 2, 5)


def test_undefined_regression(nine):
    r = objectives.objectives(nine.withColumn("base_correct", F.lit(False))).first()
    assert r.regression == 1.0 and not r.regression_defined
    assert objectives.target_statistics(nine.withColumn("base_correct", F.lit(False))).where("regression is not null").count() == 0


def test_one_block_has_the_whole_range(spark):
    rows = [("c", "a", 0, "id", "s", True, True, 10, 2, None), ("c", "a", 0, "transfer", "t", True, True, 10, 2, "g")]
    p = spark.createDataFrame(rows, PAIR)
    e = bootstrap.estimates(objectives.objectives(p), bootstrap.samples(p, 20, 1), objectives.block_counts(p), token_bound=99.0).first()
    assert (e.accuracy, e.accuracy_low, e.accuracy_high, e.delta_lcb, e.delta_ucb, e.token_cost_ucb, e.regression_high) == (1.0, 0.0, 1.0, -1.0, 1.0, 99.0, 1.0)
    with pytest.raises(Exception, match="token bound"):
        bootstrap.estimates(objectives.objectives(p), bootstrap.samples(p, 20, 1), objectives.block_counts(p)).collect()


def test_bounds_are_ordered(nine):
    for s in (bootstrap.samples(nine, 100, 3), bootstrap.twister_samples(nine, 100, 3)):
        e = bootstrap.estimates(objectives.objectives(nine), s, objectives.block_counts(nine)).first()
        for m in bootstrap.METRICS:
            assert e[f"{m}_low"] <= e[f"{m}_lcb"] <= e[f"{m}_ucb"] <= e[f"{m}_high"]
    a, b = (sorted(map(str, bootstrap.twister_samples(nine, 40, 9).collect())) for _ in range(2))
    assert a == b


def test_twister_draws(nine):
    """The draws of one generator over sorted strata, replayed by hand."""
    import random

    rnd = random.Random(5)
    by_block = {}
    for r in NINE:
        by_block.setdefault((r[1], r[2]), []).append(r)
    layout = {}
    for k in sorted(by_block):
        layout.setdefault(tuple(sorted((r[3], r[4], r[9] or "") for r in by_block[k])), []).append(k)
    want = []
    for _ in range(30):
        rows = [r for s in sorted(layout) for _ in layout[s] for r in by_block[layout[s][rnd.randrange(len(layout[s]))]]]
        ids = [r for r in rows if r[3] == "id"]
        want.append((round(sum(r[5] for r in ids) / len(ids), 9) if ids else None, round(sum(r[7] + r[8] for r in rows) / len(rows), 9)))
    got = bootstrap.twister_samples(nine, 30, 5).orderBy("replicate").collect()
    assert [(None if r.accuracy is None else round(r.accuracy, 9), round(r.token_cost, 9)) for r in got] == want


def test_feasibility():
    assert objectives.Constraints.from_base(0.7, 0.1, 50).accuracy_floor == pytest.approx(0.6)
    assert objectives.Constraints.from_base(0.05, 0.1, 50).accuracy_floor == 0
    assert objectives.Constraints.from_paired(0.02, 50).delta_floor == -0.02


def test_feasibility_rows(spark):
    d = spark.createDataFrame([("a", 0.5, 10.0, 0.0), ("b", 0.4, 30.0, None), ("c", 0.5 - 1e-13, 20.0, -0.2)], "id string, accuracy double, token_cost double, delta double")
    c = objectives.Constraints(0.5, 20.0, -0.1)
    got = {r.id: r.reasons for r in objectives.feasibility(d, c).collect()}
    assert got == {"a": [], "b": ["accuracy_floor", "accuracy_delta_unavailable", "token_budget"], "c": ["accuracy_delta_floor"]}
    assert objectives.feasibility(d, objectives.Constraints(1.0, 0.0, enabled=False)).where("feasible").count() == 3
    with pytest.raises(ValueError):
        objectives.maximised(d, ("accuracy", "accuracy"))
    with pytest.raises(ValueError):
        objectives.normalised(d, {"accuracy": (1.0, 1.0)})


def vectors(spark, rows):
    n = len(rows[0]) - 1
    return spark.createDataFrame(rows, "candidate_id string, " + ", ".join(f"v{i + 1} double" for i in range(n)))


def test_frontier(spark):
    ab = vectors(spark, [("a", 1.0, 0.5), ("b", 0.5, 1.0)])
    assert pareto.hypervolume(ab.withColumn("pool", F.lit(0)), [0.0, 0.0], ["pool"]).first().hypervolume == 0.75
    assert pareto.hypervolume_grid(ab, [0.0, 0.0]).first().hypervolume == 0.75
    assert [r.contribution for r in pareto.contributions(ab.withColumn("pool", F.lit(0)), "candidate_id", [0.0, 0.0], ["pool"]).collect()] == [0.25, 0.25]
    one = vectors(spark, [("x", 1.0, 1.0)])
    assert pareto.coverage(one, ab).first().coverage == 1.0
    assert pareto.epsilon(ab, one).first().epsilon == 0.5
    assert pareto.inverted_distance(one, one).first().igd == 0
    c = {r.candidate_id: r for r in pareto.crowding(vectors(spark, [("a", 0.5, 0.5, 1.0), ("b", 0.0, 1.0, 1.0), ("c", 1.0, 0.0, 1.0)]), "candidate_id").collect()}
    assert not c["a"].boundary and c["b"].boundary and c["c"].boundary and c["a"].crowding == 2.0


def test_front_properties(spark):
    import random

    rnd = random.Random(1)
    rows = [(f"c{i}", *(float(rnd.randrange(6)) for _ in range(3))) for i in range(150)]
    d = vectors(spark, rows)
    front = {r.candidate_id for r in pareto.front(d.repartition(5)).collect()}
    dom = lambda a, b: all(x >= y for x, y in zip(a[1:], b[1:])) and a[1:] != b[1:]
    assert front == {b[0] for b in rows if not any(dom(a, b) for a in rows)}
    rank = {r.candidate_id: r["rank"] for r in pareto.ranks(d, "candidate_id").collect()}
    assert {c for c, r in rank.items() if r == 0} == front
    assert all(rank[a[0]] < rank[b[0]] for a in rows for b in rows if dom(a, b))
    pts = {r[1:] for r in rows}
    inside = sum(any(all(p[k] > x[k] for k in range(3)) for p in pts) for x in [(i, j, k) for i in range(6) for j in range(6) for k in range(6)])
    assert pareto.hypervolume(d.withColumn("pool", F.lit(0)), [0.0] * 3, ["pool"]).first().hypervolume == inside


def entries(spark, rows):
    return spark.createDataFrame(rows, "run_id string, pos long, candidate_id string, content_hash string, cost int, reasons array<string>, v1 double, v2 double, v3 double, v4 double")


def test_archive_sequence(spark):
    v = lambda a, t, k, r: (a, t, -k, -r)
    rows = [("r", 1, "weak", "h1", 1, [], *v(0.6, 0.6, 150.0, 0.2)), ("r", 2, "strong", "h2", 1, [], *v(0.8, 0.7, 100.0, 0.1)), ("r", 3, "worse", "h3", 1, [], *v(0.7, 0.6, 120.0, 0.2)), ("r", 4, "same", "h2", 1, [], *v(0.9, 0.7, 100.0, 0.1)), ("r", 5, "strong", "h9", 1, [], *v(0.9, 0.7, 100.0, 0.1))]
    rows += [("s", 1, "bad", "b1", 1, ["accuracy_floor"], *v(0.4, 0.6, 100.0, 0.2)), ("s", 2, "dear", "b2", 2, [], *v(0.8, 0.6, 100.0, 0.2))]
    got = {(r.run_id, r.pos): r for r in archive.decisions(entries(spark, rows), 4, 20).collect()}
    assert got["r", 1].reason == "accepted" and got["r", 2].reason == "accepted_removed_dominated" and got["r", 2].removed_ids == "weak"
    assert got["r", 3].reason == "dominated_by:strong" and got["r", 4].reason == "duplicate_content_hash" and got["r", 5].reason == "duplicate_candidate_id"
    assert got["r", 5].spent == 3 and got["s", 1].reason == "infeasible:accuracy_floor"
    tight = {(r.run_id, r.pos): r for r in archive.decisions(entries(spark, rows), 4, 2).collect()}
    assert tight["s", 2].reason == "evaluation_budget_exceeded" and tight["s", 2].spent == 1


def test_archive_capacity_is_order_free(spark):
    import itertools

    three = [("accuracy", 0.95, 0.55, -150.0, -0.20), ("transfer", 0.60, 0.95, -140.0, -0.15), ("cheap", 0.55, 0.60, -50.0, -0.10)]
    rows = [(f"p{k}", i, n, n, 1, [], *v) for k, p in enumerate(itertools.permutations(three)) for i, (n, *v) in enumerate(p)]
    e = entries(spark, rows)
    left = {}
    for r in archive.working_entries(e, 2).collect():
        left.setdefault(r.run_id, set()).add(r.candidate_id)
    assert len({frozenset(s) for s in left.values()}) == 1 and all(len(s) == 2 for s in left.values()) and len(left) == 6
    last = {}
    for r in archive.decisions(e, 2, 100).orderBy("pos").collect():
        s = last.setdefault(r.run_id, set())
        if r.accepted:
            s.add(r.candidate_id)
        s -= set(r.removed_ids.split(","))
    assert last == left


def test_deployments(spark):
    rows = [("a", "a", 0.9, 0.6, 100.0, 0.1), ("b", "b", 0.8, 0.9, 120.0, 0.05), ("c", "c", 0.95, 0.5, 80.0, 0.2)]
    d = spark.createDataFrame(rows, "candidate_id string, content_hash string, accuracy double, transfer double, token_cost double, regression double")
    assert selection.min_tokens(d, 0.9).first().candidate_id == "c"
    assert selection.max_transfer(d, 110.0).first().candidate_id == "a"
    ranges = {"accuracy": (0.0, 1.0), "transfer": (0.0, 1.0), "token_cost": (-150.0, 0.0), "regression": (-1.0, 0.0)}
    best = min(rows, key=lambda r: math.dist([r[2], r[3], (-r[4] + 150) / 150, 1 - r[5]], [1] * 4))
    assert selection.knee(d, ranges).first().candidate_id == best[0]
    p = {r.policy_id: r for r in selection.deployments(d, 0.99, 110.0, ranges).collect()}
    assert not p["min_tokens"].defined and p["min_tokens"].reason and p["max_transfer"].candidate_id == "a"
    assert [r.candidate_id for r in selection.survivors(vectors(spark, [("accuracy", 1.0, 0.0), ("transfer", 0.0, 1.0), ("dominated", 0.0, 0.0)]), 2).orderBy("place").collect()] == ["accuracy", "transfer"]
    assert selection.builtin().get("accuracy") is selection.by_accuracy
    with pytest.raises(ValueError):
        selection.builtin().register("accuracy", selection.by_accuracy)


def test_contrasts(spark):
    rows = [("t", s, x) for s, x in ((1, 3.0), (2, 4.0), (3, 5.0))] + [("base-a", s, x) for s, x in ((1, 1.0), (2, 2.0), (3, 3.0))] + [("base-b", s, x) for s, x in ((1, 2.0), (2, 5.0), (3, 4.0))]
    v = spark.createDataFrame(rows, "method_id string, search_seed long, value double")
    got = {r.comparison: r for r in inference.seed_contrasts(v, "t", ["base-a", "base-b"], [1, 2, 3]).collect()}
    assert (got["base-a"].p, got["base-a"].holm) == (0.25, 0.5)
    assert (got["base-b"].differences, got["base-b"].p, got["base-b"].holm) == ([1.0, -1.0, 1.0], 1.0, 1.0)
    part = v.where("not (method_id = 'base-b' and search_seed = 2)")
    got = {r.comparison: r for r in inference.seed_contrasts(part, "t", ["base-a", "base-b"], [1, 2, 3]).collect()}
    assert got["base-a"].p == 0.25 and got["base-a"].holm is None and got["base-b"].missing == 1
    got = {r.comparison: r for r in inference.seed_contrasts(part, "t", ["base-a", "base-b"], [1, 2, 3], incomplete="drop").collect()}
    assert got["base-a"].holm == 0.25


def test_costs(spark):
    u = spark.createDataFrame([("p", 3, 1_000_000, 500_000), ("q", 1, 5, 5)], "provider_id string, provider_calls long, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("p", "USD", 2.0, 8.0)], "provider_id string, currency string, input_per_million double, output_per_million double")
    c = {r.provider_id: r for r in accounting.costs(u, prices).collect()}
    assert c["p"].monetary_cost == 6.0 and c["q"].monetary_cost is None
    t = accounting.cost_total(accounting.costs(u.where("provider_id = 'p'"), prices)).first()
    assert (t.total, t.currency) == (6.0, "USD")
    assert accounting.cost_total(accounting.costs(u, prices)).first().total is None


def test_false_admission(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "candidate_id string")
    r = accounting.validated_false_admission(ids("a", "b", "not-promoted"), ids("a", "b", "full-only"), ids("a", "full-only")).first()
    assert (r.rate, r.lost_ids) == (0.5, "b")
    assert accounting.validated_false_admission(ids("a"), ids("z"), ids("a")).first().rate is None
    assert accounting.false_admission(ids("a").limit(0), ids("a")).first().rate == 0.0


@pytest.mark.parametrize(
    "check, text, want",
    [
        (lambda c: verify.exact(c, "Yes", ignore_case=True), "yes", True),
        (lambda c: verify.json_boolean(c, "$.result.passed", True), '{"result": {"passed": true}}', True),
        (lambda c: verify.json_boolean(c, "$.result.passed", True), '{"result": {"passed": "true"}}', False),
        (lambda c: verify.json_boolean(c, "$.result.passed", True), "not-json", False),
        (lambda c: verify.exact_json_field(["answers", 0], 42)(c), '{"answers": [42]}', True),
        (lambda c: verify.exact_json_field(["answers", 0], 42)(c), '{"answers": [42.0]}', False),
        (lambda c: verify.exact_json_field(["a"], 1)(c), '{"a": 1, "a": 1}', False),
        (lambda c: verify.contains(c, "needle"), "hay needle hay", True),
        (lambda c: verify.numeric(c, 1.0, 0.01), "1.005", True),
        (lambda c: verify.numeric(c, 1.0, 0.01), "nan", False),
        (lambda c: verify.full_match(c, "a|ab"), "ab", True),
        (lambda c: verify.full_match(c, "a"), "a\n", False),
        (lambda c: verify.exact_full_match("(?P<x>a)+", True)(c), "AA", True),
        (lambda c: verify.exact_match("straße", ignore_case=True)(c), "STRASSE", True),
        (lambda c: verify.nonempty(c), " \n", False),
        (lambda c: verify.json_text(verify.fenced_json(c), "$.a"), 'x\n```json\n{"a": "b"}\n```', "b"),
    ],
)
def test_verifiers(spark, check, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(check(F.col("x")).alias("r")).first().r == want


def test_canonical(spark):
    d = spark.createDataFrame([('{"b": [1, 2.50], "a": "é"}',), ("{",), ('{"a":1,"a":2}',)], "x string")
    got = [r.c for r in d.select(canonical.canonical_json("x").alias("c")).collect()]
    assert got == ['{"a":"é","b":[1,2.5]}', None, None]
    assert d.select(canonical.stable_hash(F.col("x")).alias("h")).first().h == canonical.digest({"b": [1, 2.5], "a": "é"})
    p = spark.createDataFrame([("./a//b/",), ("/abs",), ("a/../b",), ("a\\b",)], "p string").select(canonical.normal_path(F.col("p")).alias("n"))
    assert [r.n for r in p.collect()] == ["a/b", None, None, "a/b"]


def test_patches(spark):
    files = {"S.md": "one two\n", "T.md": "x x"}
    patches = spark.createDataFrame([("p1", 1, "add", "S.md", "more text", None), ("p2", 2, "rewrite", "S.md", "2", "two"), ("p3", 3, "drop", "T.md", "", "x"), ("p4", 0, "compress", "S.md", "t", "two")], "patch_id string, sequence int, operation string, target_path string, content string, match_text string")
    picks = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p3"), ("c", "p4"), ("c", "p2")], "candidate_id string, patch_id string")
    got = {(r.candidate_id, r.path): (r.content, r.error) for r in lineage.fold_patches(picks, patches, files).collect()}
    assert got["a", "S.md"][0] == "one 2\n\nmore text\n" and got["a", "T.md"][0] == "x x"
    assert "2 times" in got["b", None][1] and "0 times" in got["c", None][1]
    h = lineage.content_hashes(lineage.fold_patches(picks, patches, files).where("error is null")).collect()
    assert [len(r.content_hash) for r in h] == [64]


def test_lineage(spark):
    rows = [("a", None, "1"), ("b", "a", "2"), ("c", "b", "3"), ("x", "y", "4"), ("y", "x", "5"), ("z", "gone", "6"), ("a", None, "7")]
    v = sorted((r.version_id, r.problem) for r in lineage.lineage_violations(spark.createDataFrame(rows, "version_id string, parent_version_id string, content_hash string")).collect())
    assert v == [("a", "content_drift"), ("x", "cycle"), ("y", "cycle"), ("z", "missing_parent")]


def test_checks(spark):
    o = spark.createDataFrame([("c", "t", "k", 1, True, "id", None, True, 1, 1), ("", "t", "k", 1, True, "odd", "", True, -1, 1)], "candidate_id string, target_id string, task_id string, seed long, is_base boolean, split string, transfer_group string, correct boolean, input_tokens long, output_tokens long")
    assert [r.broken for r in checks.bad_outcomes(o).collect()] == [["empty_id", "split", "tokens", "transfer_group"]]
    assert checks.varying(o, ["task_id"], ["split"]).first().n == 2
    assert checks.wrong_counts(spark.createDataFrame([("s", "1")], "split_id string, task_id string"), spark.createDataFrame([("s", 2), ("u", 0)], "split_id string, expected_count long")).collect()[0].split_id == "s"
    assert checks.rejoined(["task_id"], o, o.limit(1)).count() == 1
    assert checks.bad_intervals(spark.createDataFrame([(0.1, 0.2, 0.3), (0.4, 0.2, 0.3), (0.1, None, 0.2)], "l double, p double, h double"), "l", "p", "h", 0.0, 1.0).count() == 2


def test_final_overlap(spark):
    rows = [("c", "h", f"k{i % 2}", i // 2, t, "g", "id" if t == "final-id" else "diagnostic", None, True, 5, 5) for i in range(4) for t in ("final-id", "final-full-diagnostic")]
    d = spark.createDataFrame(rows, "candidate_id string, content_hash string, task_id string, seed int, target_id string, execution_group string, role string, transfer_group string, correct boolean, input_tokens int, output_tokens int")
    assert dedup.overlap_dedup(d).where("role = 'id'").count() == dedup.overlap_dedup(d).count() == 4
    assert dedup.overlap_violations(d).count() == 0
    bad = d.withColumn("correct", F.col("target_id") == "final-id")
    assert {r.problem for r in dedup.overlap_violations(bad).collect()} == {"conflicting_outcomes"}
