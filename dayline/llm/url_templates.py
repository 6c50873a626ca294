"""URL filter: rules decide what they name, and a tree of path templates for each host learns from them to judge the rest."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayline.llm.common import staged

#: Segments of a path that its template has at most.
DEPTH = 8
#: A segment stays as it is in a template when it has this share of its parent's pages, or of all pages at its depth, and LEAST pages.
SHARE, LEAST = 0.02, 5
#: Standard normal quantile of the tests that keep two branches apart.
APART = 1.96
#: Labelled pages that a template's wider evidence counts for, and the blocked share from which a template is rejected.
WEIGHT, REJECT = 4.0, 0.5
#: Hosts with more than 1/HOT of all pages are spread over SPREAD parts.
HOT, SPREAD = 128, 64

_DIGITS = r"^[0-9]+(?:\.[A-Za-z]{1,5})?$|^[0-9a-f]{8,}$|^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of `rules` (verdict, 'host/path') that fits, the first of equally long ones; null when none does.

    A rule fits its host and all subdomains, when the path starts with the rule's from its first '/' on.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _wildcard(segment: Column) -> Column:
    """What stands for a segment that varies: '#' for numbers and identifiers, with an ending or without, '*' for others."""
    return F.when(segment.rlike(_DIGITS), "#").otherwise("*")


def _critical(freedom: int, z: float) -> float:
    """The chi-squared value that is exceeded as seldom as `z` by a standard normal one (Wilson and Hilferty)."""
    return freedom * (1 - 2 / (9 * freedom) + z * np.sqrt(2 / (9 * freedom))) ** 3


def _alike(a: dict, b: dict, z: float) -> bool:
    """Whether two branches pass for samples of one: equal blocked shares by their labels, equal continuations by chi-squared."""
    if (a["labelled"] > 0) != (b["labelled"] > 0):
        return False
    if a["labelled"]:
        n, m = a["labelled"], b["labelled"]
        p = (a["blocked"] + b["blocked"]) / (n + m)
        if 0 < p < 1 and abs(a["blocked"] / n - b["blocked"] / m) > z * np.sqrt(p * (1 - p) * (1 / n + 1 / m)):
            return False
    kinds = sorted(set(a["next"]) | set(b["next"]))
    if len(kinds) < 2:
        return True
    x, y = (np.array([s["next"].get(k, 0) for k in kinds], float) for s in (a, b))
    both = x + y
    wanted = np.outer([x.sum(), y.sum()], both / both.sum())
    return float((((np.array([x, y]) - wanted) ** 2) / wanted).sum()) <= _critical(len(kinds) - 1, z)


def merge_branches(branches: list[dict], z: float = APART) -> dict[str, str]:
    """Name -> merged name of the branches (name, labelled, blocked, next: continuation -> pages) below one node.

    The largest first, ties by name, each joins the first cluster that it is alike; a cluster's counts are pooled and
    its name puts its branches' names together.
    """
    clusters: list[dict] = []
    for b in sorted(branches, key=lambda b: (-sum(b["next"].values()), b["name"])):
        for c in clusters:
            if _alike(b, c, z):
                c["names"].append(b["name"])
                c["labelled"] += b["labelled"]
                c["blocked"] += b["blocked"]
                for k, n in b["next"].items():
                    c["next"][k] = c["next"].get(k, 0) + n
                break
        else:
            clusters.append({**b, "next": dict(b["next"]), "names": [b["name"]]})
    return {n: "|".join(sorted(c["names"])) for c in clusters for n in c["names"]}


def _merged(z: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # at most 1 / SHARE segments of the host's, as many of all hosts' and two wildcards, each with a few continuations
        branches = [
            {"name": name, "labelled": float(g.labelled.sum()), "blocked": float(g.blocked.sum()), "next": dict(zip(g.next, g.pages, strict=True))}
            for name, g in group.sort_values(["name", "next"]).groupby("name", sort=True)
        ]
        return pd.DataFrame({"host": [group.host.iloc[0]], "template": [group.template.iloc[0]], "names": [merge_branches(branches, z)]})

    return run


def path_templates(pages: DataFrame, depth: int = DEPTH, z: float = APART) -> DataFrame:
    """`pages` (page, host, path, label: 1 blocked, 0 allowed, null unknown) with `template`, merged, and `plain`, before merging.

    The tree grows from its roots, the hosts, a level at a time. Below a node a segment stays when many of the node's
    pages have it, or many of all hosts' pages at that depth; the others vary and become wildcards, so a node has a
    bounded number of branches. Branches of one node whose labels and continuations pass for samples of one are merged.
    Only counts are grouped by node; pages meet their node's branches, which for hosts with many pages are copied to
    all of the host's parts.
    """
    total = pages.count()
    hot = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > total / HOT).select("host", F.lit(SPREAD).alias("parts"))
    hot = F.broadcast(staged(hot, "hot-hosts"))  # HOT rows at most
    parts, none = F.coalesce("parts", F.lit(1)), F.lit("")
    segments = F.slice(F.filter(F.split("path", "/"), lambda s: s != ""), 1, depth)
    rows = pages.join(hot, "host", "left").select("page", "host", "label", segments.alias("segments"), F.pmod(F.xxhash64("page", "path"), parts).alias("part"), none.alias("template"), none.alias("plain"))
    rows = staged(rows, "url-rows")
    everywhere = lambda df: df.join(hot, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(1, deepest + 1):
        at = F.col("segments")[level - 1]
        here = rows.where(F.size("segments") >= level).withColumn("segment", at)
        further = F.concat((F.size("segments") - level).cast("string"), F.when(F.size("segments") > level, _wildcard(F.col("segments")[F.least(F.lit(level), F.size("segments") - 1)])).otherwise(none))
        children = staged(here.groupBy("host", "template", "segment", further.alias("next")).agg(F.count(F.lit(1)).alias("pages"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")), "url-children")
        size = children.agg(F.sum("pages")).first()[0]
        common = [r[0] for r in children.where(_wildcard(F.col("segment")) == "*").groupBy("segment").agg(F.sum("pages").alias("n")).where((F.col("n") >= SHARE * size) & (F.col("n") >= LEAST)).collect()]  # 1 / SHARE at most
        whole = children.groupBy("host", "template").agg((F.sum("pages") * SHARE).alias("enough"))
        sums = children.groupBy("host", "template", "segment").agg(F.sum("pages").alias("n")).where((F.col("n") >= LEAST) & (_wildcard(F.col("segment")) == "*"))
        salted = sums.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("segment"), parts).cast("int")).drop("parts")
        own = salted.join(everywhere(whole), ["host", "template", "part"]).where("n >= enough").select("host", "template", "segment", F.lit(True).alias("own"))
        # many pages of one segment are one row here, so this join has as many rows as a node has different segments
        part = F.pmod(F.xxhash64("segment", "next"), parts).cast("int")
        named = children.join(hot, "host", "left").withColumn("part", part).drop("parts").join(everywhere(own), ["host", "template", "segment", "part"], "left")
        stays = F.col("own").isNotNull() | F.col("segment").isin(common)
        name = F.when(stays, F.concat(F.lit("/"), F.col("segment"))).otherwise(_wildcard(F.col("segment")))
        branches = named.groupBy("host", "template", name.alias("name"), "next").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")])
        merged = staged(branches.groupBy("host", "template").applyInPandas(_merged(z), "host string, template string, names map<string, string>"), "url-branches")
        literal, wild = F.concat(F.lit("/"), at), _wildcard(at)
        deeper = F.size("segments") >= level
        branch = F.when(F.col("names")[literal].isNotNull(), literal).otherwise(wild)
        joined = rows.withColumn("part", F.col("part").cast("int")).join(everywhere(merged), ["host", "template", "part"], "left")
        grown = joined.withColumn("_branch", F.when(deeper, branch))
        rows = staged(
            grown.select("page", "host", "label", "segments", "part", F.when(deeper, F.concat_ws(">", "template", F.col("names")[F.col("_branch")])).otherwise(F.col("template")).alias("template"), F.when(deeper, F.concat_ws(">", "plain", "_branch")).otherwise(F.col("plain")).alias("plain")),
            "url-rows",
        )
    return rows.select("page", "host", "label", "part", "template", "plain")


def template_purity(templates: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """host, template, plain, labelled, blocked, purity: the blocked share of each template's labels, smoothed.

    A template's share is drawn by `weight` labels to that of its plain form over all hosts, and that to the share of
    all labels, so a template without labels is judged by what looks like it elsewhere.
    """
    counts = staged(templates.groupBy("host", "template", "plain").agg(F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")), "url-purity")
    total = counts.agg(F.sum("blocked"), F.sum("labelled")).first()
    base = ((total[0] or 0) + 1) / ((total[1] or 0) + 2)
    alike = counts.groupBy("plain").agg(((F.sum("blocked") + weight * base) / (F.sum("labelled") + weight)).alias("wide"))
    own = counts.groupBy("host", "template").agg(F.sum("labelled").alias("all"), F.sum("blocked").alias("bad"))
    out = counts.join(alike, "plain").join(own, ["host", "template"])
    return out.select("host", "template", "plain", "labelled", "blocked", ((F.col("bad") + weight * F.col("wide")) / (F.col("all") + weight)).alias("purity"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of pages (page_id, url; others ignored).

    The longest rule that fits decides. What the rules decide is what the template trees learn from: a page without a
    rule is blocked when its template's smoothed share of blocked pages is `reject` or more. A null url, or one without
    '://', has empty host and path, and belongs to the template of nothing; repeated rows each give a row and count each;
    a null page_id is a page like others; long urls count whole but for segments past DEPTH, which no template has. An
    empty table gives an empty table.
    """
    host, path = host_of(F.col("url").cast("string")), path_of(F.col("url").cast("string"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("decided"))
    known = F.when(F.col("decided") == "block", 1).when(F.col("decided") == "allow", 0)
    templates = staged(path_templates(urls.select(F.struct("page_id", "path", "rule", "decided").alias("page"), "host", "path", known.alias("label"))), "url-templates")
    purity = template_purity(templates)
    # hot templates are spread as hot hosts are
    spread = purity.select("host", "template", "plain", "purity").join(templates.select("host", "template", "plain", "part").distinct(), ["host", "template", "plain"])
    out = templates.join(spread, ["host", "template", "plain", "part"])
    judged = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return out.select("page.page_id", "host", "page.path", "page.rule", F.coalesce("page.decided", judged).alias("verdict"), "template", "purity")
