"""URL filters: rules first, then trust and distrust propagated over the host link graph.

Rules name a host and a path prefix and hold for the host's subdomains; the longest fitting rule decides
a page. For other pages the host decides: trust flows along links from hosts that rules mostly allow
(personalised PageRank), distrust flows against links from hosts that rules mostly block, since linking
to a bad host is a sign of one. A host whose distrust exceeds its trust is blocked.

A score is the sum over walks of every length: round by round, what arrived anew is passed on along the
links, until what is still under way can't come to more than `residual` percent of all. Hosts without
links give their share back to the seeds, which is the same as scaling the sums to `mass` at the end.
Scores are whole numbers, so that sums don't depend on the order of the rows. Links to the same host
don't count, repeated links count once. Edges and scores stay distributed; sums into a hub are
pre-aggregated per task.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is
allowed unless the empty host is blocked, which has no links or seeds; null html has no links; repeated
pages are each judged, and each counts for its host; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.session import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""

#: A link with a host: absolute, or without a scheme.
ELSEWHERE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


#: Fixed rules of the contract.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Flow:
    """damping: percent that follows links; mass: units of trust, and of distrust, in all; residual: percent of
    the mass that may be left under way; ratio: percent of the trust that distrust must exceed to block."""

    damping: int = 85
    residual: int = 1
    mass: int = 10**15
    ratio: int = 100

    @property
    def settled(self) -> int:
        """Units that arrive in a round after which no more than the residual follows."""
        return self.mass * self.residual * (100 - self.damping) // (100 * self.damping)

    @property
    def rounds(self) -> int:
        """Rounds that always suffice, as a round passes on at most `damping` percent."""
        left, n = 2 * self.mass * (100 - self.damping) // 100, 0
        while left > self.settled:
            left, n = left * self.damping // 100, n + 1
        return n


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")
    return host & F.col("path").startswith(rule.path)


def ruled(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """`pages` with host, path, rule and the rule's verdict (both null if none fits)."""
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(str(r))):
        rule, verdict = F.when(_fits(r), str(r)).otherwise(rule), F.when(_fits(r), r.verdict).otherwise(verdict)
    return out.withColumns({"rule": rule, "rule_verdict": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of distinct links between hosts. pages: host and html."""
    link = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("link")
    target = F.translate(F.regexp_extract("link", ELSEWHERE, 1), UPPER, LOWER)
    return pages.select("host", link).select(F.col("host").alias("src"), target.alias("dst")).where("src <> dst AND src <> '' AND dst <> ''").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, flow: Flow = Flow()) -> DataFrame:
    """(host, trust, distrust) of every host that has any. seeds: host, good and bad (0 or 1 each)."""
    edges = cut(edges)
    totals = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    share = lambda c, n: f"cast({c} as bigint) * {flow.mass // max(n or 0, 1) * (100 - flow.damping) // 100} AS "
    new = cut(seeds.where("good + bad > 0").selectExpr("host", share("good", totals.good) + "trust", share("bad", totals.bad) + "distrust"))
    forward = cut(edges.join(edges.groupBy("src").agg(F.count("*").alias("outs")), "src"))
    backward = cut(edges.join(edges.groupBy("dst").agg(F.count("*").alias("ins")), "dst"))
    arrived = new
    while (new.agg(F.sum(F.col("trust") + F.col("distrust"))).first()[0] or 0) > flow.settled:
        ahead = forward.join(new, F.col("src") == F.col("host")).selectExpr("dst AS host", f"trust * {flow.damping} div (100 * outs) AS trust", "0L AS distrust")
        back = backward.join(new, F.col("dst") == F.col("host")).selectExpr("src AS host", "0L AS trust", f"distrust * {flow.damping} div (100 * ins) AS distrust")
        new = cut(ahead.unionByName(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
        arrived = arrived.unionByName(new)
    scores = cut(arrived.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    whole = scores.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    scaled = lambda c, n: f"cast({c} as decimal(19,0)) * {flow.mass} div {max(n or 0, 1)} AS {c}"
    return scores.selectExpr("host", scaled("trust", whole.trust), scaled("distrust", whole.distrust))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, flow: Flow = Flow()) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, of every page row."""
    marked = ruled(pages.select("page_id", "url", "html"), rules)
    hosts = marked.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("a"), F.count_if(F.col("rule_verdict") == "block").alias("b"))
    seeds = hosts.selectExpr("host", "if(2 * a > n, 1, 0) AS good", "if(2 * b > n, 1, 0) AS bad")
    scores = propagate(seeds, host_edges(marked), flow)
    blocked = F.col("distrust") * 100 > F.col("trust") * flow.ratio
    by_host = F.when(F.coalesce(blocked, F.lit(False)), "block").otherwise("allow")
    return marked.drop("url", "html").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_host).alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust")
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judge(table(spark, sf_dir, "pages"))


def _oracle(flow: Flow = Flow()) -> str:
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    rest = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END"
    steps = []
    for i in range(flow.rounds):
        steps.append(f"""s{i + 1} AS MATERIALIZED (SELECT host, sum(trust)::BIGINT AS trust, sum(distrust)::BIGINT AS distrust FROM (
  SELECT dst AS host, trust * {flow.damping} // (100 * outs) AS trust, 0 AS distrust FROM e JOIN s{i} ON src = host
  UNION ALL SELECT src, 0, distrust * {flow.damping} // (100 * ins) FROM e JOIN s{i} ON dst = host)
  WHERE (SELECT sum(trust + distrust) FROM s{i}) > {flow.settled} GROUP BY host)""")
    share = lambda c: f"(2 * {c} > n)::BIGINT * ({flow.mass} // greatest(1, sum((2 * {c} > n)::BIGINT) OVER ()) * {100 - flow.damping} // 100)::BIGINT"
    scaled = lambda c: f"(sum({c}) * {flow.mass} // greatest(1, sum(sum({c})) OVER ()))::BIGINT AS {c}"
    return rf"""
WITH rules(rh, rp, rv) AS (VALUES {rules}),
p AS MATERIALIZED (SELECT row_number() OVER () AS row_no, page_id, html,
  coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT row_no, rh || rp AS rule, rv FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY length(rh || rp) DESC) = 1),
m AS MATERIALIZED (SELECT p.*, rule, rv FROM p LEFT JOIN r USING (row_no)),
h AS (SELECT host, count(*) AS n, count(*) FILTER (rv = 'allow') AS a, count(*) FILTER (rv = 'block') AS b FROM m WHERE host <> '' GROUP BY host),
s0 AS MATERIALIZED (SELECT host, {share('a')} AS trust, {share('b')} AS distrust FROM h),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)) AS link FROM m),
d AS (SELECT DISTINCT src, translate(regexp_extract(link, '{ELSEWHERE}', 1), '{UPPER}', '{LOWER}') AS dst FROM l),
e AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY src) AS outs, count(*) OVER (PARTITION BY dst) AS ins FROM d WHERE src <> dst AND src <> '' AND dst <> ''),
{", ".join(steps)},
s AS (SELECT host, {scaled('trust')}, {scaled('distrust')} FROM ({" UNION ALL ".join(f"FROM s{i}" for i in range(flow.rounds + 1))}) GROUP BY host)
SELECT page_id, m.host, path, rule, coalesce(rv, CASE WHEN distrust * 100 > trust * {flow.ratio} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM m LEFT JOIN s USING (host)"""


QUERIES = {"op1_url_filters": op1_url_filters}
ORACLE_SQL = {"op1_url_filters": _oracle()}
