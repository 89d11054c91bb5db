"""URL filter by a path-template tree, in DataFrame operations only.

Rules give verdicts first: host and all its subdomains, path prefix, the longest rule wins. Pages under a rule are also
the labelled pages from which all others are judged:

1. digits of path segments become ``#``. Per host and level, when there are more than ``WIDE`` different segments, the rarer
   ones (under ``COMMON`` of their parent's pages) become ``*``; what is behind level ``DEPTH`` is one last segment, whole;
2. sibling branches are merged into ``*`` as well that are alike in structure (the shares of the segments below them
   are those of all siblings together, by a chi-square test at three standard deviations) and not unlike in labels (no labels, or
   a purity within two standard errors of that of all siblings together), so branches without labels share those of the others;
3. the paths of all hosts together are generalised in the same two steps into one more tree, whose templates hold for every host;
4. a template's purity is its share of allowed pages, smoothed by that of its path's template in the tree of all hosts, that by its host's, that by
   the last two labels of the host, that by the whole table's (``PULL`` pages each); templates under 0.5 are blocked.

Everything after the first count works on distinct (host, path shape) rows, so a hot host is counted
before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

DEPTH, WIDE, COMMON, PULL = 3, 8, 0.1, 2.0
EVERY = "/"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract has them; both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        cut = text.index("/")
        own, prefix = text[:cut], text[cut:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, labelled), one row for each page.

    ``labelled`` counts the pages with labels that the template has, on its host or in the tree of all hosts: with none, only host, domain and table
    decide. Null urls and urls without ``://`` have an empty host and path. Repeated and null ids stay rows of their
    own; other columns are ignored. With no labelled page at all everything without a rule is allowed.
    """
    host, path = parsed(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("own"))
    parts = F.split(F.regexp_replace(F.regexp_replace("path", "^/", ""), "[0-9]+", "#"), "/")
    for i in range(1, DEPTH + 1):
        rows = rows.withColumn(f"s{i}", F.coalesce(F.get(parts, F.lit(i - 1)), F.lit("")))
    rows = rows.withColumn(f"s{DEPTH + 1}", F.when(F.size(parts) > DEPTH, F.array_join(F.slice(parts, DEPTH + 1, 1 << 30), "/")).otherwise(""))
    segs = [f"s{i}" for i in range(1, DEPTH + 2)]
    shape = ["host", *segs]
    good, bad = F.count_if(F.col("own") == "allow"), F.count_if(F.col("own") == "block")
    tree = rows.groupBy(*shape).agg(F.count("*").alias("n"), good.alias("good"), bad.alias("bad"))
    spark = pages.sparkSession
    tree = Scratch(spark, tree, "shapes").df
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    # the tree of all hosts is one more tree, of a host that no url can have
    both = _generalised(tree.unionByName(tree.groupBy(*segs).agg(*sums).withColumn("host", F.lit(EVERY))))
    tree, common = both.filter(F.col("host") != EVERY), both.filter(F.col("host") == EVERY)
    domain = F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)
    leaf = tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("domain", domain)
    leaf = Scratch(spark, leaf, "templates").df
    nodes = common.groupBy("template").agg(F.sum("good").alias("sg"), F.sum("bad").alias("sb"))
    by_shape = common.select(*segs, "template").join(nodes, "template").drop("template")
    by_host = leaf.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("bad").alias("hb"))
    by_domain = leaf.groupBy("domain").agg(F.sum("good").alias("dg"), F.sum("bad").alias("db"))
    whole = leaf.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("wg"), F.coalesce(F.sum("bad"), F.lit(0)).alias("wb"))
    p = (F.col("wg") + 1.0) / (F.col("wg") + F.col("wb") + 1.0)
    for g, b in (("dg", "db"), ("hg", "hb"), ("sg", "sb"), ("good", "bad")):
        p = (F.col(g) + PULL * p) / (F.col(g) + F.col(b) + PULL)
    judged = leaf.join(by_host, "host").join(by_domain, "domain").join(F.broadcast(whole))  # whole has one row
    judged = tree.select(*shape, "template").join(judged, ["host", "template"]).join(by_shape, segs)
    judged = judged.select(*shape, "template", p.alias("purity"), (F.col("good") + F.col("bad") + F.col("sg") + F.col("sb")).alias("labelled"))
    method = F.when(F.col("purity") >= 0.5, "allow").otherwise("block")
    return rows.join(judged, shape).select("page_id", "host", "path", "rule", F.coalesce("own", method).alias("verdict"), "template", "labelled")


def _generalised(shapes: DataFrame) -> DataFrame:
    """``shapes(host, s1.., n, good, bad)`` with ``template``, the path of each in its host's tree."""
    spark = shapes.sparkSession
    tree = Scratch(spark, shapes.withColumn("t0", F.lit("")), "shapes").df
    for i in range(1, DEPTH + 2):  # each level is written, or the plan would hold every level many times
        tree = Scratch(spark, _level(tree, i), "shapes").df
    return tree.withColumn("template", F.col(f"t{DEPTH + 1}")).drop(*[f"t{i}" for i in range(DEPTH + 2)])


def _level(tree: DataFrame, i: int) -> DataFrame:
    """Adds t<i>, the template down to level i, by the two generalising steps."""
    up, seg = f"t{i - 1}", f"s{i}"
    below = F.col(f"s{i + 1}") if i <= DEPTH else F.lit("")
    cells = tree.groupBy("host", up, seg, below.alias("below")).agg(F.sum("n").alias("cn"), F.sum("good").alias("cg"), F.sum("bad").alias("cb"))
    kids = cells.groupBy("host", up, seg).agg(F.sum("cn").alias("kn"), F.sum("cg").alias("kg"), F.sum("cb").alias("kb"))
    pool = cells.groupBy("host", up, "below").agg(F.sum("cn").alias("bn"))
    parent = kids.groupBy("host", up).agg(F.count("*").alias("many"), F.sum("kn").alias("pn"), F.sum("kg").alias("pg"), F.sum("kb").alias("pb"))
    parent = parent.join(pool.groupBy("host", up).agg((F.count("*") - 1).alias("free")), ["host", up])
    fit = cells.join(pool, ["host", up, "below"]).groupBy("host", up, seg).agg(F.sum(F.col("cn").cast("double") * F.col("cn") / F.col("bn")).alias("fit"))
    kids = kids.join(fit, ["host", up, seg]).join(parent, ["host", up])
    rare = (F.col("many") > WIDE) & (F.col("kn") < COMMON * F.col("pn"))
    # chi-square of the segments below: sum of observed^2 / expected, less their number
    chi = F.col("fit") * F.col("pn") / F.col("kn") - F.col("kn")
    built = chi <= F.col("free") + 3.0 * F.sqrt(2.0 * F.col("free")) + 1e-9
    # (kg / kl - pg / pl)^2 <= 4 * q * (1 - q) / kl with q = pg / pl, without divisions
    kl, pl = F.col("kg") + F.col("kb"), F.col("pg") + F.col("pb")
    gap = (F.col("kg") * pl - F.col("pg") * kl).cast("double")
    alike = (F.col("many") > 1) & built & ((kl == 0) | (gap * gap <= 4.0 * F.col("pg").cast("double") * F.col("pb") * kl))
    name = F.when((F.col(seg) == "") | F.col(seg).contains("#"), F.col(seg)).when(rare | alike, "*").otherwise(F.col(seg))
    kids = kids.select("host", up, seg, F.concat(up, F.lit("/"), name).alias(f"t{i}"))
    return tree.join(kids, ["host", up, seg])


def op4_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judge(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    """The same in DuckDB's SQL."""
    rule = verdict = "NULL"
    for word, text in sorted(RULES, key=lambda r: (len(r[1]), r[1])):
        cut = text.index("/")
        fits = f"(host = '{text[:cut]}' OR ends_with(host, '.{text[:cut]}')) AND starts_with(path, '{text[cut:]}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{word}' ELSE {verdict} END"
    last = DEPTH + 1
    segs = ", ".join([*(f"coalesce(parts[{i}], '') AS s{i}" for i in range(1, last)), f"CASE WHEN len(parts) > {DEPTH} THEN array_to_string(parts[{last}:], '/') ELSE '' END AS s{last}"])
    names = ", ".join(f"s{i}" for i in range(1, last + 1))
    shape = "host, " + names
    levels = ""
    for i, at in [(i, at) for at in ("", "g") for i in range(1, last + 1)]:  # each host's tree, then that of all hosts
        if at and i == 1:
            levels += f"gtree0 AS (SELECT '' AS host, {names}, sum(n) AS n, sum(good) AS good, sum(bad) AS bad, '' AS t0 FROM tree0 GROUP BY {names}),"
        below = f"s{i + 1}" if i < last else "''"
        levels += f"""
{at}c{i} AS (SELECT host, t{i - 1}, s{i}, {below} AS below, sum(n) AS cn, sum(good) AS cg, sum(bad) AS cb FROM {at}tree{i - 1} GROUP BY ALL),
{at}k{i} AS (SELECT host, t{i - 1}, s{i}, sum(cn) AS kn, sum(cg) AS kg, sum(cb) AS kb FROM {at}c{i} GROUP BY ALL),
{at}b{i} AS (SELECT host, t{i - 1}, below, sum(cn) AS bn FROM {at}c{i} GROUP BY ALL),
{at}p{i} AS (SELECT host, t{i - 1}, count(*) AS many, sum(kn) AS pn, sum(kg) AS pg, sum(kb) AS pb FROM {at}k{i} GROUP BY ALL),
{at}f{i} AS (SELECT host, t{i - 1}, count(*) - 1 AS free FROM {at}b{i} GROUP BY ALL),
{at}x{i} AS (SELECT host, t{i - 1}, s{i}, sum(cn::double * cn / bn) AS fit FROM {at}c{i} JOIN {at}b{i} USING (host, t{i - 1}, below) GROUP BY ALL),
{at}n{i} AS (SELECT host, t{i - 1}, s{i}, t{i - 1} || '/' || CASE WHEN s{i} = '' OR contains(s{i}, '#') THEN s{i}
  WHEN (many > {WIDE} AND kn < {COMMON} * pn)
    OR (many > 1 AND fit * pn / kn - kn <= free + 3.0::DOUBLE * sqrt(2.0::DOUBLE * free) + 1e-9
      AND (kg + kb = 0 OR power(CAST(kg * (pg + pb) - pg * (kg + kb) AS DOUBLE), 2) <= 4.0::DOUBLE * CAST(pg AS DOUBLE) * pb * (kg + kb))) THEN '*'
  ELSE s{i} END AS t{i} FROM {at}k{i} JOIN {at}x{i} USING (host, t{i - 1}, s{i}) JOIN {at}p{i} USING (host, t{i - 1}) JOIN {at}f{i} USING (host, t{i - 1})),
{at}tree{i} AS (SELECT * FROM {at}tree{i - 1} JOIN {at}n{i} USING (host, t{i - 1}, s{i})),"""
    p = "((wg + 1.0::DOUBLE) / (wg + wb + 1.0::DOUBLE))"
    for g, b in (("dg", "db"), ("hg", "hb"), ("sg", "sb"), ("good", "bad")):
        p = f"(({g} + {PULL}::DOUBLE * {p}) / ({g} + {b} + {PULL}::DOUBLE))"
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rows_ AS (SELECT *, {rule} AS rule, {verdict} AS own, string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g'), '/') AS parts FROM named),
flat AS (SELECT page_id, host, path, rule, own, {segs} FROM rows_),
tree0 AS (SELECT {shape}, count(*) AS n, count(*) FILTER (WHERE own = 'allow') AS good, count(*) FILTER (WHERE own = 'block') AS bad, '' AS t0 FROM flat GROUP BY {shape}),{levels}
named_ AS (SELECT *, t{last} AS template FROM tree{last}),
leaf AS (SELECT host, template, sum(good) AS good, sum(bad) AS bad, regexp_extract(host, '([^.]*\\.?[^.]*)$', 1) AS domain FROM named_ GROUP BY host, template),
nodes AS (SELECT t{last} AS template, sum(good) AS sg, sum(bad) AS sb FROM gtree{last} GROUP BY 1),
by_shape AS (SELECT {names}, sg, sb FROM gtree{last} JOIN nodes ON t{last} = nodes.template),
by_host AS (SELECT host, sum(good) AS hg, sum(bad) AS hb FROM leaf GROUP BY host),
by_domain AS (SELECT domain, sum(good) AS dg, sum(bad) AS db FROM leaf GROUP BY domain),
whole AS (SELECT coalesce(sum(good), 0) AS wg, coalesce(sum(bad), 0) AS wb FROM leaf),
shapes AS (SELECT {shape}, template FROM named_),
judged AS (SELECT {shape}, template, {p} AS purity, (good + bad + sg + sb)::bigint AS labelled FROM shapes JOIN leaf USING (host, template) JOIN by_host USING (host) JOIN by_domain USING (domain) JOIN by_shape USING ({names}) CROSS JOIN whole)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN purity >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, template, labelled
FROM flat JOIN judged USING ({shape})
"""


ORACLE = _oracle()
