"""URL filters: rules on hosts and paths, and a tree of path templates per host for what no rule decides.

Each segment of a path is one level of its host's tree. Numbers, hexadecimal names, dates and identifiers become
wildcards at once; then, from the root down, the children of a node are compared by the labels that speak for them: their
own, or else those that their generalised paths have in the host's domain, or else those on all hosts. Children whose
shares do not differ by more than chance (chi-squared against the pooled share) become one wildcard, and children for which
no label speaks become one with them, be they two or thousands: nothing tells them apart. Where shares do differ, labelled
children stay by themselves and only the others become one. A round settles one branching of every path: what all paths
below a node have in common is taken in one step, so that long chains take no rounds of their own. (The SQL below states
the same for ``depth`` segments.)

URLs that a rule decides are the labels. A template's share of blocked ones is smoothed towards the share that its
generalised paths have in the host's domain (the last two names), and that one towards the share that they have on all
hosts, so that a template without labels of its own is judged by its like elsewhere. A template whose share reaches the
limit is rejected, and so are its other URLs.

All steps are sums by key over distinct (host, generalised path), which partial aggregation makes small before they are
shuffled; a host with a third of all rows is as small as its number of distinct paths, and a generalised path that many
hosts have is dealt by salts where hosts look it up.

Defined results: a null URL and one without :// have an empty host and path, no rule, and the template of the empty path;
a host's ties do not arise (the longest rule is unique, and equal rules are one); repeated rows count as labels each
time; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import ascii_lower, table
from fieldloom.session import stored

#: Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Patterns of variable segments, first match wins, their wildcards, and whether a digit must be in the segment.
VARIABLES = (
    (r"^[0-9]+$", "{n}", False),
    (r"^[0-9]+\.[A-Za-z]{1,5}$", "{n}.{x}", False),
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}", False),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "{id}", False),
    (r"^[0-9a-fA-F]{12,}$", "{id}", True),
    (r"^[A-Za-z0-9_-]{24,}$", "{id}", True),
    (r"^[^0-9]*[0-9]{3,}[^0-9]*$", "{name}{n}", False),
)


@dataclass(frozen=True)
class UrlRules:
    rules: tuple[tuple[str, str, str], ...] = RULES
    depth: int = 4  # levels that the SQL spells out
    strength: float = 4.0  # of the prior, in labels
    prior: float = 0.1  # share of blocked URLs where nothing is known
    limit: float = 0.5
    deviations: float = 2.0  # by which chi-squared may exceed its mean for children to be alike
    salts: int = 64
    hot_share: int = 4096  # a path that more than this part of all (host, path) have is looked up by salts


def split_url(url: Column) -> tuple[Column, Column]:
    """host, path."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later ones, which are longer, win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    def shape(s: Column) -> Column:
        out = s
        for pattern, name, digit in reversed(VARIABLES):
            out = F.when(s.rlike(pattern) & s.rlike("[0-9]") if digit else s.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, shape)


def templates(urls: DataFrame, rules: UrlRules = UrlRules()) -> DataFrame:
    """host, shape, template and blocked_share of every distinct host and shape (generalised path) of urls (host, shape, verdict or null)."""
    r = rules
    nodes = urls.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("verdict").alias("labelled"), F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("bad")
    )
    nodes = nodes.withColumn("domain", domain_of(F.col("host")))
    nodes = _looked_up(_looked_up(stored(nodes), ["domain", "shape"], "domain", r), ["shape"], "everywhere", r)
    nodes = stored(nodes.withColumns({"template": F.lit(""), "rest": F.col("shape")}))
    counts = [f"{at}{c}" for at in ("", "domain_", "everywhere_") for c in ("labelled", "bad")]
    here = (F.col("host") == F.col("h")) & (F.col("template") == F.col("t"))
    while True:
        # the least and the greatest of a node's paths share what all of them share
        ends = nodes.groupBy("host", "template").agg(F.min("rest").alias("a"), F.max("rest").alias("b")).filter("a <> b")
        both = F.least(F.size("a"), F.size("b"))
        same = F.zip_with(F.slice("a", F.lit(1), both), F.slice("b", F.lit(1), both), lambda x, y: x == y)
        first = F.array_position(same, F.lit(False)).cast("int")
        ends = stored(ends.select(F.col("host").alias("h"), F.col("template").alias("t"), F.when(first > 0, first - 1).otherwise(both).alias("common")))
        if ends.isEmpty():
            break
        at = nodes.join(ends, here, "left").drop("h", "t")
        head = F.coalesce("common", F.size("rest"))
        at = at.withColumns({"template": F.concat("template", _joined(F.slice("rest", F.lit(1), head))), "rest": F.slice("rest", head + 1, F.size("rest"))})
        at = stored(at.drop("common"))
        child = F.get("rest", 0)
        kids = at.filter(child.isNotNull()).groupBy("host", "template", child.alias("child")).agg(*[F.sum(c).alias(c) for c in counts])
        told = {f"told_{c}": F.when(F.col("labelled") > 0, F.col(c)).when(F.col("domain_labelled") > 0, F.col(f"domain_{c}")).otherwise(F.col(f"everywhere_{c}")) for c in ("labelled", "bad")}
        kids = kids.select("host", "template", "child", *[v.alias(k) for k, v in told.items()])
        known = F.col("told_labelled") > 0
        sums = kids.groupBy("host", "template").agg(
            F.count("*").alias("kids"),
            F.sum(known.cast("int")).alias("known"),
            F.sum("told_labelled").alias("all"),
            F.sum("told_bad").alias("all_bad"),
            F.sum(F.when(known, F.col("told_bad") * F.col("told_bad") / F.greatest("told_labelled", F.lit(1)))).alias("squares"),
        )
        share = F.col("all_bad") / F.greatest("all", F.lit(1))
        chi = F.coalesce(F.try_divide(F.col("squares") - F.col("all_bad") * share, share * (1 - share)), F.lit(0.0))
        free = F.col("known") - 1
        alike = (F.col("known") > 1) & (chi <= free + r.deviations * F.sqrt(2.0 * free))
        found = sums.filter("kids > 1").select(F.col("host").alias("h"), F.col("template").alias("t"), alike.alias("alike"))
        merged = kids.join(found, here).filter("alike or told_labelled = 0").select("h", "t", F.col("child").alias("c"), F.lit(True).alias("merge"))
        now = at.join(merged, here & (child == F.col("c")), "left")
        step = F.when(child.isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("merge"), F.lit("*")).otherwise(child)))
        nodes = stored(now.select(*[c for c in at.columns if c not in ("template", "rest")], step.alias("template"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest")))
    told = nodes.withColumn("template", F.concat("template", _joined(F.col("rest"))))
    sums = told.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in counts])
    share = F.lit(r.prior)
    for at in ("everywhere_", "domain_", ""):
        share = (F.col(f"{at}bad") + r.strength * share) / (F.col(f"{at}labelled") + r.strength)
    sums = sums.select(F.col("host").alias("h"), F.col("template").alias("t"), share.alias("blocked_share"))
    return told.join(sums, here).select("host", "shape", "template", "blocked_share")


def _joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda x: F.concat(F.lit("/"), x)), "")


def domain_of(host: Column) -> Column:
    """The last two names of a host, or the whole host."""
    return F.regexp_replace(host, r"^.*\.([^.]+\.[^.]+)$", "$1")


def _looked_up(nodes: DataFrame, keys: list[str], name: str, r: UrlRules) -> DataFrame:
    """The nodes with the sums of labelled and bad over all nodes with the same keys. Keys of many nodes, of which there are at most
    hot_share, are sent to every task and looked up by salts."""
    sums = nodes.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("labelled").alias(f"{name}_labelled"), F.sum("bad").alias(f"{name}_bad"))
    hot = F.col("rows") > max(r.salts, nodes.count() // r.hot_share)
    seats = sums.select(*keys, f"{name}_labelled", f"{name}_bad", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(r.salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    marked = nodes.join(F.broadcast(sums.filter(hot).select(*keys, F.lit(True).alias("hot"))), keys, "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("host"), F.lit(r.salts)).cast("int")).otherwise(0)
    return marked.withColumn("salt", salt).drop("hot").join(seats, [*keys, "salt"]).drop("salt")


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: UrlRules = UrlRules()) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, template and blocked_share."""
    host, path = split_url(pages[url].cast("string"))
    urls = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules.rules)
    urls = urls.withColumns({"rule": rule, "verdict": verdict, "shape": _segments(F.col("path"))})
    known = templates(urls, rules).select(F.col("host").alias("h"), F.col("shape").alias("s"), "template", "blocked_share")
    out = urls.join(known, (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s")), "left")
    judged = F.when(F.col("blocked_share") >= rules.limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", judged).alias("verdict"), "template", "blocked_share")


def op8_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql(r: UrlRules = UrlRules()) -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    order = sorted(r.rules, key=lambda x: -len(x[0] + x[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in order) + " END"
    shape = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}'){" AND regexp_matches(s, '[0-9]')" if d else ""} THEN '{n}'" for p, n, d in VARIABLES) + " ELSE s END"
    levels = []
    told = lambda c: f"CASE WHEN sum(labelled) > 0 THEN sum({c}) WHEN sum(dl) > 0 THEN sum(d{c[0]}) ELSE sum(e{c[0]}) END"
    for k in range(r.depth + 1):
        levels.append(f"""k{k} AS (SELECT host, template, shape[{k + 1}] AS child, {told("labelled")} AS labelled, {told("bad")} AS bad FROM n{k} WHERE len(shape) > {k} GROUP BY host, template, shape[{k + 1}]),
s{k} AS (SELECT host, template, count(*) AS kids, sum(CASE WHEN labelled > 0 THEN 1 ELSE 0 END) AS known, sum(bad) / greatest(sum(labelled), 1) AS share, sum(bad) AS bad, sum(CASE WHEN labelled > 0 THEN bad * bad / labelled END) AS squares FROM k{k} GROUP BY ALL),
m{k} AS (SELECT host, template, known > 1 AND CASE WHEN share * (1 - share) > 0 THEN (squares - bad * share) / (share * (1 - share)) ELSE 0 END <= known - 1 + {r.deviations} * sqrt(2.0 * greatest(known - 1, 0)) AS alike FROM s{k} WHERE kids > 1),
w{k} AS (SELECT host, template, child FROM k{k} JOIN m{k} USING (host, template) WHERE alike OR labelled = 0),
n{k + 1} AS (SELECT n.* EXCLUDE (template), CASE WHEN len(n.shape) > {k} THEN n.template || '/' || CASE WHEN w.host IS NOT NULL THEN '*' ELSE n.shape[{k + 1}] END ELSE n.template END AS template FROM n{k} n LEFT JOIN w{k} w ON w.host = n.host AND w.template = n.template AND w.child = n.shape[{k + 1}])""")
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {rule} AS rule, {verdict} AS given, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: {shape}) AS parts FROM b),
u AS (SELECT page_id, host, path, rule, given, CASE WHEN len(parts) > {r.depth} THEN list_append(parts[1:{r.depth}], '**') ELSE parts END AS shape FROM c),
z AS (SELECT host, shape, CAST(count(given) AS DOUBLE) AS labelled, CAST(sum(CASE WHEN given = 'block' THEN 1 ELSE 0 END) AS DOUBLE) AS bad, regexp_replace(host, '^.*\\.([^.]+\\.[^.]+)$', '\\1') AS domain FROM u GROUP BY host, shape),
n0 AS (SELECT host, shape, labelled, bad, sum(labelled) OVER (PARTITION BY domain, shape) AS dl, sum(bad) OVER (PARTITION BY domain, shape) AS db,
  sum(labelled) OVER (PARTITION BY shape) AS el, sum(bad) OVER (PARTITION BY shape) AS eb, '' AS template FROM z),
{", ".join(levels)},
t AS (SELECT host, template, (sum(bad) + {r.strength!r} * ((sum(db) + {r.strength!r} * ((sum(eb) + {r.strength * r.prior!r}) / (sum(el) + {r.strength!r}))) / (sum(dl) + {r.strength!r}))) / (sum(labelled) + {r.strength!r}) AS blocked_share FROM n{r.depth + 1} GROUP BY ALL)
SELECT page_id, u.host, path, rule, coalesce(given, CASE WHEN blocked_share >= {r.limit!r} THEN 'block' ELSE 'allow' END) AS verdict, n.template, blocked_share
FROM u LEFT JOIN n{r.depth + 1} n ON n.host = u.host AND n.shape = u.shape LEFT JOIN t ON t.host = n.host AND t.template = n.template"""


ORACLE = _sql()
