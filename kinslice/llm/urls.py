"""URL filters: explicit rules, and a tree of path templates judged by labelled purity.

Rules decide the urls that they fit. Their decisions are also the labels from which the trees learn. A tree
is built for each host and, as hosts without labels must learn from others, for each domain above it, up to
the one of all hosts. In a tree, from the top down,

* a segment that varies becomes a wildcard: it holds a digit, or less than ``RARE`` of its parent's pages;
* sibling branches are put in order of their share of blocked labels, and neighbours whose shares can't be
  told apart (a two-sided test at ``Z``) merge into one branch; branches without labels stay apart.

The tree is as deep as the paths: it's built level by level until no branch has two paths. A branch has at
most ``1 / RARE`` named children, however many pages there are.

The purity of a template is its share of blocked labels, smoothed with ``WEIGHT`` labels of the purity that
the path's template has one domain up; at the top, of the share over all labels. A template is rejected if
its purity reaches ``PURITY`` and there is any label in its chain of templates.

Awkward cases. Null urls and urls without ``://`` have an empty host and path; they are judged as a host of
their own. Of equally long rules the first fits. Null ids and repeated rows are judged as any other; repeated
rows count as often as they occur. Urls of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Segments that the SQL looks at.
DEPTH = 4
#: Share of its parent's pages from which a segment has a branch of its own.
RARE = 0.02
Z = 1.96
WEIGHT = 2.0
PURITY = 0.6
#: Pages of one path are dealt out in parts from this share of all pages on.
SHARES = 256
#: Labels of the longest domain above a host that has a tree.
DOMAIN = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both are empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, the first in order among equally long ones; else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        cut = rule.find("/")
        own, start = (rule, "") if cut < 0 else (rule[:cut], rule[cut:])
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def scopes(host: Column) -> Column:
    """The host and the domains above it, the longest first; the empty one holds all hosts."""
    labels = F.split(host, "[.]", -1)
    size = F.size(labels)
    above = F.sequence(F.greatest(size - DOMAIN, F.lit(1)), size)
    return F.array_distinct(F.concat(F.array(host), F.transform(above, lambda k: F.array_join(F.slice(labels, k + 1, size), "."))))


def _level(tree: DataFrame, k: int) -> DataFrame:
    """``scope, raw, ..., template, ends`` with the k-th segment's branch added to the template."""
    up = ["scope", "template"]
    segments = F.split("raw", "/", -1)
    level = tree.withColumn("segment", F.coalesce(F.get(segments, F.lit(k)), F.lit("")))
    own = level.groupBy(*up, "segment").agg(*(F.sum(c).alias(c) for c in ("pages", "known", "bad")), F.count("*").alias("paths"))
    whole = own.groupBy(*up).agg(F.sum("pages").alias("all_pages"))
    varies = (F.col("segment") == "*") | (F.col("pages").cast("double") < F.lit(RARE) * F.col("all_pages").cast("double"))
    own = own.join(whole, up).withColumn("to", F.when((F.col("segment") != "") & varies, "*").otherwise(F.col("segment")))
    # at most 1 / RARE + 2 rows for a branch
    few = own.groupBy(*up, "to").agg(F.sum("known").cast("double").alias("n"), F.sum("bad").cast("double").alias("b"), F.sum("paths").alias("paths"))
    few = few.withColumn("rated", (F.col("n") > 0) & (F.col("to") != ""))
    order = Window.partitionBy(*up, "rated").orderBy(F.try_divide("b", "n"), "to")
    n, b, pn, pb = F.col("n"), F.col("b"), F.lag("n").over(order), F.lag("b").over(order)
    few = few.withColumn("pn", pn).withColumn("pb", pb)
    off, total, blocked = b * F.col("pn") - F.col("pb") * n, n + F.col("pn"), b + F.col("pb")
    alike = F.col("rated") & F.col("pn").isNotNull() & (off * off * total <= F.lit(Z * Z) * blocked * (total - blocked) * n * F.col("pn"))
    few = few.withColumn("cluster", F.sum(F.when(alike, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    members = Window.partitionBy(*up, "rated", "cluster")
    few = few.withColumn("size", F.count("*").over(members)).withColumn("least", F.min("to").over(members)).withColumn("paths", F.sum("paths").over(members))
    name = F.when(F.col("size") > 1, F.concat(F.lit("{"), "least", F.lit("..}"))).otherwise(F.col("to"))
    few = few.select(*up, "to", name.alias("name"), F.col("paths").alias("branch"))
    named = own.select(*up, "segment", "to").join(few, [*up, "to"])
    # the only path of a branch is its own template
    rest = F.array_join(F.slice(segments, k + 2, F.size(segments)), "/")
    last = F.col("branch") == 1
    tail = F.when(last & (rest != ""), F.concat("name", F.lit("/"), rest)).otherwise(F.col("name"))
    longer = F.when(F.col("segment") == "", F.col("template")).otherwise(F.concat("template", F.lit("/" if k else ""), tail))
    ends = (F.col("segment") == "") | last
    return level.join(named, [*up, "segment"]).select("scope", "raw", "known", "bad", "pages", longer.alias("template"), ends.alias("ends"))


def judge(pages: DataFrame, *, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template`` of each page; the template is that of its host's tree."""
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    blocked = [r for r, v in rules if v == "block"]
    parts = F.filter(F.split("path", "/", -1), lambda s: s != "")
    rows = rows.withColumn("raw", F.array_join(F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s)), "/"))

    # one row per host and path without numbers: far fewer than urls
    by_host = rows.groupBy("host", "raw").agg(
        F.count("*").alias("pages"), F.count("rule").alias("known"), F.count(F.when(F.col("rule").isin(*blocked), 1)).alias("bad")
    )
    by_host = common.cut(by_host)
    total = by_host.agg(F.coalesce(F.sum("known"), F.lit(0)).alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    prior = total["bad"] / total["known"] if total["known"] else 0.0
    chains = by_host.select("host", "raw", "pages", "known", "bad", F.posexplode(scopes(F.col("host"))).alias("up", "scope"))
    tree = chains.groupBy("scope", "raw").agg(*(F.sum(c).alias(c) for c in ("pages", "known", "bad")))
    tree, done, k = tree.withColumn("template", F.lit("")), [], 0
    while k == 0 or not tree.isEmpty():
        # each level reads the tree three times; uncut, the plan would triple with every level
        level = common.cut(_level(tree, k))
        done.append(level.where("ends").drop("ends"))
        if len(done) > 50:
            done = [common.cut(reduce(DataFrame.union, done))]
        tree = level.where("NOT ends").drop("ends")
        k += 1
    tree = reduce(DataFrame.union, done)
    counts = tree.groupBy("scope", "template").agg(F.sum("known").cast("double").alias("n"), F.sum("bad").cast("double").alias("b"))
    judged = common.cut(tree.select("scope", "raw", "template").join(counts, ["scope", "template"]))
    # a row for each domain above a host
    chain = chains.select("host", "raw", "up", "scope").join(judged, ["scope", "raw"])
    steps = F.reverse(F.array_sort(F.collect_list(F.struct("up", "n", "b"))))
    chain = chain.groupBy("host", "raw").agg(steps.alias("steps"), F.min_by("template", "up").alias("template"))
    purity = F.aggregate("steps", F.lit(float(prior)), lambda p, x: (x["b"] + F.lit(WEIGHT) * p) / (x["n"] + F.lit(WEIGHT)))
    some = F.exists("steps", lambda x: x["n"] > 0)
    learned = F.when(some & (purity >= PURITY), "block").otherwise("allow")
    judged = chain.select("host", "raw", learned.alias("learned"), "template")
    verdict = reduce(lambda e, r: F.when(F.col("rule") == r[0], r[1]).otherwise(e), rules, F.col("learned"))
    # pages of one path that are a large share of all are dealt out; at most SHARES paths are
    most = by_host.agg(F.sum("pages")).first()[0] or 0
    hot = by_host.where(F.col("pages") * SHARES > most).select("host", "raw", F.ceil(F.col("pages") * SHARES / F.lit(max(most, 1))).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    judged = judged.join(F.broadcast(hot), ["host", "raw"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    rows = rows.join(F.broadcast(hot), ["host", "raw"], "left").withColumn("part", F.pmod(F.xxhash64("page_id", "path"), parts).cast("int"))
    return rows.join(judged, ["host", "raw", "part"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))


def _oracle() -> str:
    fits = []
    for rule, _ in sorted(RULES, key=lambda r: -len(r[0])):
        own, _, start = rule.partition("/")
        fits.append(f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{start}') THEN '{rule}'")
    blocked = ", ".join(f"'{r}'" for r, v in RULES if v == "block")
    allowed = ", ".join(f"'{r}'" for r, v in RULES if v == "allow")
    raw = ", ".join(f"s{k}" for k in range(DEPTH))
    steps = []
    for k in range(DEPTH):
        up = ", ".join(["scope", *(f"t{j}" for j in range(k))])
        steps.append(f"""o{k} AS (
  SELECT {up}, s{k}, sum(pages) AS pages, sum(known) AS known, sum(bad) AS bad FROM l{k} GROUP BY {up}, s{k}
), v{k} AS (
  SELECT *, CASE WHEN s{k} <> '' AND (s{k} = '*' OR CAST(pages AS DOUBLE) < {RARE!r}::DOUBLE * CAST(sum(pages) OVER (PARTITION BY {up}) AS DOUBLE)) THEN '*' ELSE s{k} END AS dest FROM o{k}
), f{k} AS (
  SELECT {up}, dest, CAST(sum(known) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS b, sum(known) > 0 AND dest <> '' AS rated FROM v{k} GROUP BY {up}, dest
), g{k} AS (
  SELECT *, lag(n) OVER w AS pn, lag(b) OVER w AS pb FROM f{k} WINDOW w AS (PARTITION BY {up}, rated ORDER BY b / n, dest)
), h{k} AS (
  SELECT *, sum(CASE WHEN rated AND pn IS NOT NULL AND (b * pn - pb * n) * (b * pn - pb * n) * (n + pn)
      <= {Z * Z!r}::DOUBLE * (b + pb) * ((n + pn) - (b + pb)) * n * pn THEN 0 ELSE 1 END)
    OVER (PARTITION BY {up}, rated ORDER BY b / n, dest ROWS UNBOUNDED PRECEDING) AS cluster FROM g{k}
), n{k} AS (
  SELECT {up}, dest, CASE WHEN count(*) OVER m > 1 THEN '{{' || min(dest) OVER m || '..}}' ELSE dest END AS t{k}
  FROM h{k} WINDOW m AS (PARTITION BY {up}, rated, cluster)
), l{k + 1} AS (
  SELECT l.*, t{k} FROM l{k} l JOIN v{k} USING ({up}, s{k}) JOIN n{k} USING ({up}, dest)
)""")
    names = ", ".join(f"t{k}" for k in range(DEPTH))
    return rf"""
WITH RECURSIVE u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE {" ".join(fits)} END AS rule, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM h
), s AS (
  SELECT *, {", ".join(f"coalesce(CASE WHEN regexp_matches(parts[{k + 1}], '[0-9]') THEN '*' ELSE parts[{k + 1}] END, '') AS s{k}" for k in range(DEPTH))} FROM r
), x AS (
  SELECT host, {raw}, count(*) AS pages, count(rule) AS known, count(*) FILTER (rule IN ({blocked})) AS bad, string_split(host, '.') AS ls FROM s GROUP BY ALL
), c AS (
  SELECT DISTINCT * FROM (
    SELECT host, {raw}, pages, known, bad, host AS scope FROM x
    UNION ALL
    SELECT host, {raw}, pages, known, bad, array_to_string(ls[k + 1:], '.') FROM (SELECT *, unnest(range(greatest(len(ls) - {DOMAIN}, 1), len(ls) + 1)) AS k FROM x))
), l0 AS (
  SELECT scope, {raw}, sum(pages) AS pages, sum(known) AS known, sum(bad) AS bad FROM c GROUP BY ALL
), {", ".join(steps)}, j AS (
  SELECT scope, {raw}, rtrim(concat_ws('/', {names}), '/') AS template, CAST(sum(known) OVER t AS DOUBLE) AS n, CAST(sum(bad) OVER t AS DOUBLE) AS b
  FROM l{DEPTH} WINDOW t AS (PARTITION BY scope, {names})
), y AS (
  SELECT c.host, {", ".join(f"c.s{k}" for k in range(DEPTH))}, j.n, j.b, j.template, row_number() OVER (PARTITION BY c.host, {", ".join(f"c.s{k}" for k in range(DEPTH))} ORDER BY length(c.scope)) AS i
  FROM c JOIN j USING (scope, {raw})
), z AS (
  SELECT host, {raw}, 0::BIGINT AS i, (SELECT coalesce(CAST(sum(bad) AS DOUBLE) / nullif(sum(known), 0), 0) FROM x) AS p, false AS seen, '' AS template FROM x
  UNION ALL
  SELECT z.host, {", ".join(f"z.s{k}" for k in range(DEPTH))}, y.i, (y.b + {WEIGHT!r}::DOUBLE * z.p) / (y.n + {WEIGHT!r}::DOUBLE), z.seen OR y.n > 0, y.template
  FROM z JOIN y ON y.host = z.host AND {" AND ".join(f"y.s{k} = z.s{k}" for k in range(DEPTH))} AND y.i = z.i + 1
), e AS (
  SELECT host, {raw}, arg_max(seen AND p >= {PURITY!r}::DOUBLE, i) AS bad, arg_max(template, i) AS template FROM z GROUP BY ALL
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IN ({allowed}) THEN 'allow' WHEN bad THEN 'block' ELSE 'allow' END AS verdict, template
FROM s JOIN e USING (host, {raw})
"""


ORACLE = _oracle()
