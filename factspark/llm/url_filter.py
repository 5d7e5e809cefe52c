"""URL filters: host and path rules, and a path-template tree with labelled purity, by column expressions only.

Rules first: a rule fits its host and all subdomains if the url's path starts
with the rule's; the longest fitting rule decides, of equally long ones the
last of the list.  Hosts, not urls, are joined with the rules.

The other urls are judged by a template tree.  A host's paths are split into
segments; ids, hashes and dates become wildcards by their form.  Then, level
by level under each host and template so far, similar branches merge: all
siblings begin as one class, and each whose labelled share of bad pages differs
from that of the rest of its class (two-proportion z test beyond ``Z``, labels
enough on both sides) moves to a class above or below it, until none differs.
Siblings of a class go on as one branch, with a wildcard for a segment if they
are several.  A branch is followed as deep as its pages still have labels of
both kinds to tell apart; what is deeper shares its tail.  Segments that all
pages of a branch share are passed in one step.  A template is
rejected if its smoothed purity, (bad + SMOOTH * base rate) / (labelled +
SMOOTH), reaches ``REJECT``.

The tree is built from counts by host and form of path, far fewer than the
urls.  Joins are on host and segments; their smaller side is written first, so
that adaptive execution can split hot hosts or broadcast.

A null url, or one without ``://``, has an empty host and path; it is judged
like any other host.  Repeated rows repeat.  Pages without a label only count
towards nothing; with several labels each counts.  Without labels nothing is
rejected but by rule.  Paths may have any number of segments.  Extra columns
are not passed on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

Z, SMOOTH, REJECT, LEAST = 2.58, 5.0, 0.5, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with columns host and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages (with host and path) and the columns rule, the longest fitting one as host + path, and by_rule, its verdict; null where none fits."""
    if not rules:
        return pages.withColumn("rule", F.lit(None).cast("string")).withColumn("by_rule", F.lit(None).cast("string"))
    rows = [(h, len(h + p), i, p, h + p, kind) for i, (kind, h, p) in enumerate(rules)]
    known = pages.sparkSession.createDataFrame(rows, "suffix string, size int, place int, start string, name string, kind string")
    labels = F.split("host", r"\.")
    most = max(h.count(".") + 1 for _, h, _ in rules)
    suffixes = F.transform(F.sequence(F.greatest(F.size(labels) - most + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = pages.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(known, "suffix")
    hosts = cut(hosts.groupBy("host").agg(F.collect_list(F.struct("size", "place", "start", "name", "kind")).alias("__rules")))
    best = F.array_max(F.filter("__rules", lambda r: F.col("path").startswith(r["start"])))
    return pages.join(hosts, "host", "left").withColumn("__rules", best).withColumn("rule", F.col("__rules.name")).withColumn("by_rule", F.col("__rules.kind")).drop("__rules")


def segments(path: Column) -> Column:
    """The segments of a path in general form."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    form = lambda s: (
        F.when(s.rlike(r"^\d+$"), "{n}")
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), "{date}")
        .when(s.rlike(r"^[0-9a-fA-F]{8,}(-[0-9a-fA-F]+)*$"), "{hex}")
        .when(s.rlike(r"^\d+\.[A-Za-z]+$"), F.concat(F.lit("{n}"), F.regexp_extract(s, r"\.[A-Za-z]+$", 0)))
        .when(s.rlike(r"\d{3,}"), F.regexp_replace(s, r"\d{3,}", "{n}"))
        .otherwise(s)
    )
    return F.transform(parts, form)


def _z(l: Column, b: Column, rest_l: Column, rest_b: Column) -> Column:  # noqa: E741
    """How far the share b / l lies above rest_b / rest_l, in standard errors; null where both are 0 or 1."""
    pooled = (b + rest_b) / (l + rest_l)
    return F.try_divide(b / l - rest_b / rest_l, F.sqrt(pooled * (1 - pooled) * (1 / l + 1 / rest_l)))


def _classes(child: DataFrame) -> DataFrame:
    """child (host, t, seg, l labelled, b bad) with class: siblings of a class are alike.  A class is a path of + (more bad) and - (less) from all."""
    child = child.withColumn("class", F.lit(""))
    while True:
        sums = cut(child.groupBy("host", "t", "class").agg(F.sum("l").alias("cl"), F.sum("b").alias("cb")))
        rest_l, rest_b = F.col("cl") - F.col("l"), F.col("cb") - F.col("b")
        z = F.when((F.col("l") >= LEAST) & (rest_l >= LEAST), _z(F.col("l"), F.col("b"), rest_l, rest_b))
        moved = cut(child.join(sums, ["host", "t", "class"]).select("host", "t", "seg", "l", "b", F.concat("class", F.when(z > Z, "+").when(z < -Z, "-").otherwise("")).alias("class"), (F.abs(z) > Z).alias("moves")))
        child = moved.drop("moves")
        if moved.filter("moves").isEmpty():
            return child


def template_tree(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, form (array of segments), template (string), labelled, bad, purity: one row for each host and form.

    pages: id, host, path.  labels: id, bad (boolean).
    """
    formed = pages.select("id", "host", segments(F.col("path")).alias("form"))
    marks = labels.filter("bad is not null").groupBy("id").agg(F.count("*").alias("labelled"), F.sum(F.col("bad").cast("long")).alias("bad"))
    leaves = formed.join(marks, "id", "left").groupBy("host", "form").agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    leaves = cut(leaves.withColumn("rest", F.col("form")).withColumn("t", F.lit("")))
    settled: list[DataFrame] = []
    spelled = lambda segs: F.array_join(F.transform(segs, lambda x: F.concat(F.lit("/"), x)), "")
    while True:
        node = leaves.groupBy("host", "t").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        mixed = (F.col("l") >= 2 * LEAST) & (F.col("b") > 0) & (F.col("b") < F.col("l"))
        # What the least and the greatest rest begin with, all of the node begin with: no branches there.
        shared = F.array_position(F.transform(F.sequence(F.lit(0), F.size("lo")), lambda i: F.get("lo", i).isNotNull() & F.get("lo", i).eqNullSafe(F.get("hi", i))), False) - 1
        node = cut(node.filter(mixed).select("host", "t", shared.cast("int").alias("shared"), (F.col("lo") != F.col("hi")).alias("parts")))
        ended = leaves.join(node, ["host", "t"], "left").filter("parts is null or not parts")
        tail = F.when(F.col("parts").isNotNull(), spelled(F.col("rest"))).when(F.size("rest") > 0, "/**").otherwise("")
        settled.append(ended.select("host", "form", "labelled", "bad", F.concat("t", tail).alias("t")))
        if node.filter("parts").isEmpty():
            break
        rows = leaves.join(node.filter("parts"), ["host", "t"]).withColumn("t", F.concat("t", spelled(F.slice("rest", F.lit(1), F.col("shared")))))
        rows = rows.withColumn("seg", F.coalesce(F.get("rest", F.col("shared")), F.lit(""))).withColumn("rest", F.slice("rest", F.col("shared") + 2, F.greatest(F.size("rest"), F.lit(1))))
        leaves = cut(rows.select("host", "form", "labelled", "bad", "t", "rest", "seg"))
        child = _classes(cut(leaves.groupBy("host", "t", "seg").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))))
        many = cut(child.groupBy("host", "t", "class").agg(F.count("*").alias("many")))
        token = F.when(F.col("many") > 1, F.concat(F.lit("/*"), "class")).when(F.col("seg") == "", "").otherwise(F.concat(F.lit("/"), "seg"))
        named = cut(child.join(many, ["host", "t", "class"]).select("host", "t", "seg", token.alias("token")))
        leaves = cut(leaves.join(named, ["host", "t", "seg"]).withColumn("t", F.concat("t", "token")).drop("seg", "token"))
    tree = cut(reduce(DataFrame.unionByName, settled))
    totals = tree.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    base = totals["bad"] / totals["labelled"] if totals["labelled"] else 0.0
    purity = F.when(F.sum("labelled") >= LEAST, (F.sum("bad") + SMOOTH * base) / (F.sum("labelled") + SMOOTH)).otherwise(0.0)
    pure = cut(tree.groupBy("host", "t").agg(purity.alias("purity")))
    return cut(tree.join(pure, ["host", "t"]).select("host", "form", F.col("t").alias("template"), "labelled", "bad", "purity"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """id, host, path, rule, verdict, template, purity of each row of pages (id, url)."""
    known = with_rules(with_host_path(pages).select("id", "host", "path"), rules).withColumn("form", segments(F.col("path")))
    tree = template_tree(known, labels)
    found = known.join(tree.select("host", "form", "template", "purity"), ["host", "form"], "left")
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return found.select("id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "template", "purity")
