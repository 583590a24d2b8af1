"""Lineages without a bound on depth."""

from evalforge.operators import lineage


def test_long_chain_and_cycle(spark):
    rows = [(f"v{i}", f"v{i - 1}" if i else None, "h") for i in range(101)]
    rows += [(f"c{i}", f"c{(i + 1) % 70}", "h") for i in range(70)]
    df = spark.createDataFrame(rows, "version_id string, parent_version_id string, content_hash string")
    got = {(r.version_id, r.ancestor_id): r.distance for r in lineage.ancestors(df).collect()}
    want = {(f"v{i}", f"v{j}"): i - j for i in range(101) for j in range(i)}
    want |= {(f"c{i}", f"c{j}"): (j - i) % 70 or 70 for i in range(70) for j in range(70)}
    assert got == want
    bad = lineage.lineage_violations(df).collect()
    assert sorted(map(tuple, bad)) == sorted((f"c{i}", "cycle") for i in range(70))
