"""URL filters: rules by host and path, and link-graph propagation for what no rule decides.

Pages that a rule allows are seeds of trust for their hosts, pages that a rule blocks are
seeds of distrust.  Trust is a personalised PageRank from the trusted seeds along host
edges (a host vouches for those that it links to); distrust is one from the blocked seeds
along reversed edges (who links to bad hosts is suspect).  Mass on hosts without edges is
not passed on.  A host is blocked if its distrust exceeds its trust by more than a share of
what its pages would hold if all of them were blocked seeds; so a few blocked pages don't
condemn a large host, but a small host that mostly links to blocked ones goes.

Masses are whole numbers (``UNIT`` a page, rounded down on each edge), so results don't
depend on partitioning.  A round is an equi-join of edges and masses and a sum; state is
cut in the shared folder.  An edge counts the pages of a host that link to the other, so a
page has one vote for each host, and a busy host is one row for each host that it links to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import cut, staged, table

#: What a seed page weighs, and the share of a host's mass that its links pass on.
UNIT, DAMPING = 1 << 20, 0.85
#: Rounds of propagation at most; it ends earlier when nothing changes.
ROUNDS = 20
#: A host is blocked beyond this share of its pages' mass, distrust less trust.
THRESHOLD = 0.25
#: Hosts of over one in so many rows are joined by a broadcast of so many rows at most.
HOT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_S = r"[\x20\x09-\x0D]"
#: Comments and scripts hold no links.
UNREAD = rf"(?is)<!--.*?-->|<script(?:[\x20\x09-\x0D/][^>]*)?>.*?</script"
#: The host of an absolute link of an anchor, area or frame.
LINK = rf"(?i)<(?:a|area|i?frame){_S}(?:[^>]*?{_S})?(?:href|src){_S}*={_S}*[\x22']?{_S}*(?:https?:)?//([^/?#\x22'<>\x20\x09-\x0D]+)"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The rules of the query: verdict, host, path (fixed by the contract).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def linked_hosts(html: Column) -> Column:
    """The hosts that a page's absolute links name, each once; null html has none."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), UNREAD, ""), F.lit(LINK), F.lit(1))
    return F.array_distinct(F.transform(found, lambda h: F.translate(h, UPPER, LOWER)))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(verdict, host, path) of a list of rules."""
    one = lambda v, h, p: F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"))
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("verdict", "host", "path")])
    return spark.range(1).select(F.inline(F.array(*[one(*r) for r in rules])))


def _with_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``hosts`` (one row a host), null for hosts without a row.

    The hosts of more than a thousandth of all rows, a thousand at most, are broadcast; the others are joined.
    """
    n = rows.groupBy("host").agg(F.count("*").alias("rows_"))
    sized = cut(hosts.join(n, "host"))
    edge = rows.count() // HOT + 1
    more = [c for c in hosts.columns if c != "host"]
    often = sized.where(F.col("rows_") >= edge).select("host", *more, F.lit(True).alias("found_"))
    told = rows.join(F.broadcast(often), "host", "left")
    rare = told.where("found_ is null").select(*rows.columns).join(sized.where(F.col("rows_") < edge).select("host", *more), "host", "left")
    return told.where("found_").select(*rows.columns, *more).unionByName(rare.select(*rows.columns, *more))


def ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (with host and path) with ``rule`` (host and path in one, else null) and ``ruling`` (its verdict).

    A rule fits its host and all subdomains, and paths that start with its own; the longest wins, of equals block.
    A null host or path of a rule is empty; a rule with an empty host fits empty hosts alone.  Rules are looked up by
    the domains of the distinct hosts; a host carries the rules of its chain of domains.
    """
    r = rules.select(F.coalesce("host", F.lit("")).alias("domain"), F.coalesce("path", F.lit("")).alias("start"), "verdict").distinct()
    labels = F.split("host", r"\.", -1)
    chain = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    domains = rows.select("host").distinct().withColumn("labels", labels).select("host", F.explode(chain).alias("domain")).where("domain <> '' or host = ''")
    whole = F.concat("domain", "start")
    fit = F.struct(F.char_length(whole).alias("n"), (F.col("verdict") == "block").alias("hard"), whole.alias("rule"), "start", "verdict")
    own = domains.join(r, "domain").groupBy("host").agg(F.collect_list(fit).alias("fits"))
    best = F.array_max(F.filter("fits", lambda x: F.startswith(F.col("path"), x["start"])))
    return _with_hosts(rows, own).withColumn("best_", best).select(*rows.columns, F.col("best_.rule").alias("rule"), F.col("best_.verdict").alias("ruling"))


def edges(rows: DataFrame) -> DataFrame:
    """(src, dst, w): pages of ``src`` that link to another host ``dst``; rows have host and links."""
    out = rows.where("host <> ''").select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("src <> dst")
    return out.groupBy("src", "dst").agg(F.count("*").alias("w"))


def _shares(links: DataFrame) -> DataFrame:
    """(kind, src, dst, share): edges for trust (kind 0) and reversed ones for distrust (kind 1), with the share of a node's mass that goes that way."""
    way = links.select(F.lit(0).alias("kind"), "src", "dst", "w").unionByName(links.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    total = way.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    return way.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("w").cast("double") / F.col("total").cast("double")).alias("share"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust long) of all hosts that any mass reaches.

    ``links`` is (src, dst, w), ``seeds`` (host, allowed, blocked) counts of pages.  Each round, a host has
    (1 - damping) of its seed and what its neighbours pass on; rounds end when no mass changes.
    """
    own = lambda kind, c: seeds.where(f"{c} > 0").select(F.lit(kind).alias("kind"), "host", F.floor(F.col(c).cast("double") * float(UNIT) * (1 - damping)).cast("long").alias("x"))
    seed = cut(own(0, "allowed").unionByName(own(1, "blocked")))
    way = cut(_shares(links))
    state, before = seed, None
    for _ in range(rounds if way.head(1) else 0):
        sent = way.join(state.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.floor(F.col("x").cast("double") * damping * F.col("share")).cast("long").alias("x"))
        state = cut(seed.unionByName(sent).groupBy("kind", "host").agg(F.sum("x").alias("x")).where("x > 0"))
        after = state.agg(F.count("*"), F.sum(F.xxhash64("kind", "host", "x").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    mass = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("x"))), F.lit(0)).alias(c)
    return state.groupBy("host").agg(mass(0, "trust"), mass(1, "distrust"))


def host_verdicts(pages: DataFrame, mass: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, verdict) of the hosts of ``pages`` (host, pages) that any mass reaches."""
    edge = F.floor(F.col("pages").cast("double") * float(UNIT) * (1 - damping) * threshold).cast("long")
    return pages.join(mass, "host").select("host", "trust", "distrust", F.when(F.col("distrust") - F.col("trust") > edge, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = DAMPING, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, and the host's trust and distrust (0 if none reaches it).

    A null url, or one without ``://``, has an empty host and path; what neither a rule nor any mass reaches is
    allowed; null ids, repeated rows and ties stay as they are; empty pages or no rules are fine; other columns are
    ignored, whatever their names.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), linked_hosts(F.col(html_col).cast("string")).alias("links"))
    rows = staged(rows)
    told = staged(ruled(rows.drop("links"), rules))
    counts = cut(told.groupBy("host").agg(F.count("*").alias("pages"), *[F.count(F.when(F.col("ruling") == v, 1)).alias(c) for v, c in (("allow", "allowed"), ("block", "blocked"))]))
    mass = propagate(edges(rows), counts.where("host <> ''"), damping, rounds)
    hosts = host_verdicts(counts.select("host", "pages"), mass, damping, threshold).withColumnRenamed("verdict", "of_host")
    out = _with_hosts(told, hosts)
    some = [F.coalesce(c, F.lit(0)).alias(c) for c in ("trust", "distrust")]
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", "of_host", F.lit("allow")).alias("verdict"), *some)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all ``pages``."""
    return judge(table(spark, sf_dir, "pages"), rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    quote = lambda s: s.replace("'", "''")
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    kept = repr(1 - DAMPING) + "::DOUBLE"
    rounds = ",\n".join(
        f"x{i + 1} AS MATERIALIZED (SELECT kind, host, CAST(sum(x) AS BIGINT) AS x FROM (SELECT * FROM x0 UNION ALL SELECT s.kind, s.dst, CAST(floor(CAST(x.x AS DOUBLE) * {DAMPING!r}::DOUBLE * share) AS BIGINT) FROM s JOIN x{i} x ON x.kind = s.kind AND x.host = s.src) GROUP BY kind, host HAVING sum(x) > 0)"
        for i in range(ROUNDS)
    )
    pair = lambda i: f"regexp_extract(url, '{ADDRESS}', {i})"
    return f"""
WITH r(v, h, p) AS (VALUES {rules}),
a AS MATERIALIZED (SELECT row_number() OVER () AS id, page_id, translate(coalesce({pair(1)}, ''), '{UPPER}', '{LOWER}') AS host, coalesce({pair(2)}, '') AS path, html FROM pages),
t AS MATERIALIZED (SELECT a.id, page_id, host, path, h || p AS rule, v FROM a LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY length(h || p) DESC, v DESC) = 1),
n AS MATERIALIZED (SELECT host, count(*) AS pages, count(*) FILTER (v = 'allow') AS allowed, count(*) FILTER (v = 'block') AS blocked FROM t GROUP BY host),
l AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(regexp_replace(coalesce(html, ''), '{quote(UNREAD)}', '', 'g'), '{quote(LINK)}', 1), lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS dst FROM a WHERE host <> ''),
e AS (SELECT src, dst, count(*) AS w FROM l WHERE src <> dst GROUP BY src, dst),
b AS (SELECT 0 AS kind, src, dst, w FROM e UNION ALL SELECT 1, dst, src, w FROM e),
s AS MATERIALIZED (SELECT kind, src, dst, CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY kind, src) AS DOUBLE) AS share FROM b),
x0 AS MATERIALIZED (SELECT kind, host, CAST(floor(CAST(pages AS DOUBLE) * {float(UNIT)!r}::DOUBLE * {kept}) AS BIGINT) AS x FROM (SELECT 0 AS kind, host, allowed AS pages FROM n UNION ALL SELECT 1, host, blocked FROM n) WHERE host <> '' AND pages > 0),
{rounds},
m AS (SELECT host, coalesce(sum(x) FILTER (kind = 1), 0) - coalesce(sum(x) FILTER (kind = 0), 0) AS net FROM x{ROUNDS} GROUP BY host),
h AS (SELECT n.host, CASE WHEN net > CAST(floor(CAST(pages AS DOUBLE) * {float(UNIT)!r}::DOUBLE * {kept} * {THRESHOLD!r}::DOUBLE) AS BIGINT) THEN 'block' ELSE 'allow' END AS verdict FROM n JOIN m ON m.host = n.host)
SELECT page_id, t.host, path, rule, coalesce(v, h.verdict, 'allow') AS verdict FROM t LEFT JOIN h ON h.host = t.host"""


QUERIES = {"op13_url_linkgraph": op13}
SQL: dict[str, str] = {"op13_url_linkgraph": _sql()}
