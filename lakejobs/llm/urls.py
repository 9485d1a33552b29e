"""URL filters: a tree of path templates per host, in DataFrame functions only.

1. Rules decide the urls that they fit; the longest rule wins.
2. The other urls are judged by the template of their path. Segments that vary by
   form (numbers, hexadecimal ids) become wildcards at once. Then, level by level,
   the branches below a node are merged into a wildcard if there are too many of
   them to be names, if they have no labels, or if their share of bad labels
   does not differ from that of the other labelled branches. Branches that differ
   stay apart.
3. A template is rejected if its smoothed share of bad labels reaches ``REJECT``.
   Labels are the verdicts of the rules, and those given for pages.

Urls are reduced to one row per host and path form before the tree is built, so a
host with any share of the rows costs no more than its distinct forms, and each
level is a grouping by node.

Defined cases: a null url, or one without ``://``, has an empty host and path; it
fits no rule and is judged with the others of that kind. Repeated rows are judged
alike. A path deeper than ``DEPTH`` ends in one wildcard for all that follows.
Empty tables give empty results. Other columns are carried along as a struct.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.common import written

DEPTH = 6
#: More branches than this below a node, most of them seen once, are a variable.
MAX_NAMES = 50
ONCE_SHARE = 0.5
#: Standard errors by which the shares of two branches must differ to be told apart.
Z = 2.0
#: A template without labels is taken to be bad with this share, as of so many labels.
PRIOR, WEIGHT = 0.1, 5
REJECT = 0.5
#: Forms of a segment that vary, tried in this order, and what stands for them.
FORMS = [(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{uuid}"), (r"[0-9a-f]*[0-9][0-9a-f]{11,}", "{hex}"), (r"[0-9]+", "{n}")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (verdict, host, path), else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def form(p: Column) -> Column:
    """The path as an array of segments, with those that vary by form generalised."""
    parts = F.filter(F.split(p, "/", -1), lambda x: x != "")

    def general(x: Column) -> Column:
        for pattern, name in FORMS:
            x = F.regexp_replace(x, f"^{pattern}(?=$|[.])", name.replace("{", r"\{"))
        return x

    parts = F.transform(parts, general)
    deep = F.concat(F.slice(parts, 1, DEPTH - 1), F.array(F.lit("**")))
    return F.when(F.size(parts) > DEPTH, deep).otherwise(parts)


def templates(forms: DataFrame) -> DataFrame:
    """Adds ``template`` to rows of host, form, n, labelled and bad."""
    table = forms.withColumn("template", F.lit(""))
    depth = forms.agg(F.max(F.size("form"))).first()[0] or 0
    for level in range(depth):
        # A path that ends above this level keeps its template.
        table = table.withColumn("seg", F.get("form", F.lit(level)))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
        child = table.filter("seg IS NOT NULL").groupBy("host", "template", "seg").agg(*sums)
        node = child.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("names"),
            F.count_if(F.col("n") == 1).alias("once"),
            F.sum("labelled").alias("all_labelled"),
            F.sum("bad").alias("all_bad"),
        )
        child = child.join(node, ["host", "template"])
        rest, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        share = F.col("all_bad") / F.col("all_labelled")
        error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / rest))
        alike = F.abs(F.col("bad") / F.col("labelled") - rest_bad / rest) <= Z * error
        variable = (F.col("names") > MAX_NAMES) & (F.col("once") > ONCE_SHARE * F.col("names"))
        merged = F.when(variable | (F.col("labelled") == 0), True).when(rest == 0, False).otherwise(alike)
        child = child.select("host", "template", "seg", F.when(merged, "*").otherwise(F.col("seg")).alias("as"))
        table = table.join(child, ["host", "template", "seg"], "left")
        table = table.withColumn("template", F.when(F.col("as").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "as")))
        table = written(table.drop("seg", "as"), "url-level")
    return table


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", bad: str | None = None) -> DataFrame:
    """All rows of ``pages`` as ``row``, with host, path, rule, template and verdict.

    ``bad`` names a boolean column with the labels of pages, null where there is none.
    """
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"))
    given = F.col("row")[bad].cast("int") if bad else F.lit(None).cast("int")
    rows = rows.withColumns({"host": host(F.col("row")[url]), "path": path(F.col("row")[url])})
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "form": form(F.col("path"))})
    label = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int")).otherwise(given)
    forms = rows.groupBy("host", "form").agg(
        F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("bad")
    )
    table = templates(written(forms, "url-forms"))
    purity = table.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    share = (F.col("bad") + PRIOR * WEIGHT) / (F.col("labelled") + WEIGHT)
    purity = purity.select("host", "template", share.alias("share"))
    table = written(table.select("host", "form", "template").join(purity, ["host", "template"]), "url-templates")
    rows = rows.join(table, ["host", "form"])
    method = F.when(F.col("share") >= REJECT, "block").otherwise("allow")
    return rows.select("row", "host", "path", "rule", "template", "share", F.coalesce("ruled", method).alias("verdict"))
