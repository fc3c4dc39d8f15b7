"""URL filters: rules by host and path, and a tree of path templates judged by what is known of their pages."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Segments that name one page whatever their place: numbers, hashes, identifiers; a file suffix stays.
_VARIABLE = r"^(?:[0-9]+|[0-9A-Fa-f]{8,}|[0-9A-Fa-f-]{36})(\.[A-Za-z0-9]{1,5})?\z"

_SALTS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def ruled(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of ``rules`` (host, then path, such as ``net/es/``) that fits, else null."""
    fitting = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        domain, slash, rest = rule.partition("/")
        of_host = (host == domain) | F.endswith(host, F.lit(f".{domain}"))
        fitting = F.when(of_host & F.startswith(path, F.lit(slash + rest)), F.lit(rule)).otherwise(fitting)
    return fitting


def templates(paths: DataFrame, least_children: int) -> DataFrame:
    """``host, path, segments`` for distinct ``host, path, pages``: the segments with variable ones as ``*``.

    A segment is variable by its form, or where its place in the tree has at least ``least_children`` different
    children that are more than half as many as the pages below it. The tree is kept as counts: a node is the hash of
    the segments before it, so a long path costs one number a segment, and all rows of a host are added up by child
    before they meet at a node.
    """
    cut = F.filter(F.split("path", "/"), lambda s: s != "")
    shaped = F.transform(cut, lambda s: F.regexp_replace(s, _VARIABLE, "*$1"))
    chain = F.aggregate(
        "shaped", F.array(F.lit(0).cast("long")), lambda acc, s: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), s)))
    )
    nodes = paths.select("host", "path", "pages", shaped.alias("shaped")).withColumn("chain", chain)
    one = F.posexplode(F.arrays_zip("shaped", F.slice("chain", 1, F.size("shaped")).alias("chain")))
    placed = nodes.select("host", "path", "pages", one.alias("at", "s")).select(
        "host", "path", "pages", "at", F.col("s.shaped").alias("segment"), F.col("s.chain").alias("parent")
    )
    children = placed.groupBy("host", "parent", "segment").agg(F.sum("pages").alias("pages"))
    wild = children.groupBy("host", "parent").agg(F.count("*").alias("kinds"), F.sum("pages").alias("pages")).where(
        (F.col("kinds") >= least_children) & (2 * F.col("kinds") > F.col("pages"))
    ).select("host", "parent", F.lit(True).alias("wild"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    # a node may hold a third of all rows; its rows are dealt by child, and a variable node is one row per salt
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(_SALTS)).cast("int"))
    marked = salted.join(wild, ["host", "parent", "salt"], "left")
    segment = F.when(F.col("wild"), F.lit("*")).otherwise(F.col("segment"))
    grown = marked.groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct("at", segment.alias("s")))).alias("x"))
    segments = grown.select("host", "path", F.col("x.s").alias("segments"))
    none = nodes.where(F.size("shaped") == 0).select("host", "path", F.array().cast("array<string>").alias("segments"))
    return segments.unionByName(none)


def _written(segments: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def merged(branches: DataFrame, similar: float) -> DataFrame:
    """Merge sibling branches (``host, segments, labelled, bad``) that do not differ statistically; adds ``template``.

    The family of a template is what it becomes with its last fixed segment as ``*``. A branch joins its family unless
    its share of bad pages and that of the other branches differ by more than ``similar`` standard errors. Every branch
    is held against the sum of its family, so siblings never meet in pairs. A branch without siblings stays.
    """
    fixed = F.array_max(F.transform("segments", lambda s, i: F.when(s.startswith("*"), F.lit(-1)).otherwise(i)))
    last = F.coalesce(fixed, F.lit(-1))
    up = F.transform("segments", lambda s, i: F.when(i == F.col("last"), F.lit("*")).otherwise(s))
    own = branches.withColumn("last", last).select("*", _written(F.col("segments")).alias("own"), _written(up).alias("family"))
    family = own.where("last >= 0").groupBy("host", "family").agg(
        F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count("*").alias("kinds")
    )
    both = own.join(family, ["host", "family"], "left")
    n1, b1 = F.col("labelled"), F.col("bad")
    n2, b2 = F.col("all_labelled") - n1, F.col("all_bad") - b1
    p = F.col("all_bad") / F.nullif(F.col("all_labelled"), F.lit(0))
    # squared and multiplied out, so that empty branches and shares of 0 or 1 need no cases of their own
    apart = F.pow(b1 * n2 - b2 * n1, F.lit(2.0)) > F.lit(similar**2) * p * (1 - p) * (n1 + n2) * n1 * n2
    joins = (F.col("last") >= 0) & (F.col("kinds") > 1) & ~F.coalesce(apart, F.lit(False))
    return both.withColumn("template", F.when(joins, F.col("family")).otherwise(F.col("own"))).drop("last", "own", "family", "kinds", "all_labelled", "all_bad")


def url_verdicts(
    pages: DataFrame, labels: DataFrame, rules: dict[str, str], least_children: int = 8, similar: float = 1.96,
    prior_pages: float = 10.0, least_purity: float = 0.5, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """``id_col, host, path, rule, verdict, template, purity`` of every row of ``pages``.

    ``labels`` (``id_col, bad``) tells what is known of some pages; of several labels of a page any bad one counts. A
    rule decides where one fits. Elsewhere the template of the url does: its purity, the share of good pages smoothed
    by ``prior_pages`` pages of the overall share, must reach ``least_purity``. Host and path are empty for null urls
    and those without ``://``, which share a template. Repeated rows and null ids give a row each, other columns are
    not read, an empty table gives no rows, and without labels every template passes. Distinct paths are counted
    before anything else, so a host or path with a third of all rows is a few rows in the tree.
    """
    host, path = host_and_path(F.col("url"))
    slim = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    parsed = slim.select("id", host.alias("host"), path.alias("path"))
    known = labels.select(labels[id_col].alias("label_id"), labels["bad"].cast("boolean").alias("bad"))
    known = known.where("label_id is not null and bad is not null").groupBy("label_id").agg(F.max("bad").alias("bad"))
    labelled = parsed.join(known, parsed["id"] == known["label_id"], "left")
    paths = labelled.groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("bad")
    )
    shaped = paths.join(templates(paths, least_children), ["host", "path"])
    branches = shaped.groupBy("host", "segments").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    chosen = merged(branches, similar)
    overall = branches.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("p")).scalar()
    sums = chosen.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    pure = 1 - (F.col("b") + F.lit(prior_pages) * overall) / (F.col("n") + F.lit(prior_pages))
    judged = chosen.select("host", "segments", "template").join(
        sums.select("host", "template", pure.alias("purity")), ["host", "template"]
    )
    by_path = shaped.select("host", "path", "segments").join(judged, ["host", "segments"]).drop("segments")
    rule = ruled(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for name, verdict in rules.items():
        by_rule = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(by_rule)
    own = F.when(F.col("purity") >= least_purity, F.lit("allow")).otherwise(F.lit("block"))
    return parsed.join(by_path, ["host", "path"]).withColumn("rule", rule).select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(by_rule, own).alias("verdict"),
        F.concat("host", "template").alias("template"), "purity",
    )
