"""Findings over curated artifacts. Nothing is changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import text as T
from ..functions.sections import body, flags, has_title
from ..sources import frontmatter
from . import neardup

REQUIRED = ("id", "status", "sources")
SKIPPED = ("README.md", "_README.md")


def findings(fm: Column, text: Column, required: Sequence[str] = REQUIRED, domains: Mapping[str, str] = v.DOMAINS, max_tokens: int = 850, max_chars: int = 3600) -> Column:
    """Array of (rule, detail) of one artifact's text and parsed header; empty if it is in order. Without a header nothing else is looked at."""
    hit = lambda rule, detail: F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))
    if_ = lambda when, rule, detail: F.when(when, hit(rule, detail))
    type_ = F.lower(F.coalesce(fm["type"], F.lit("")))
    has_sources = F.array_contains(fm["filled"], "sources")
    checked = F.lit(True) if "sources" not in required else has_sources
    own = F.array(
        *(if_(~F.array_contains(fm["filled"], f), "missing_field", F.lit(v.FINDINGS["missing_field"].format(f))) for f in required),
        if_(checked & (fm["n_linked"] == 0), "missing_sha256_linkback", F.lit(v.FINDINGS["missing_sha256_linkback"])),
        if_((type_ != "") & T.lookup(type_, domains).isNull(), "unknown_type", F.concat(F.lit(v.FINDINGS["unknown_type"][0]), type_, F.lit(v.FINDINGS["unknown_type"][1]))),
        if_(~has_title(body(text)), "missing_h1_title", F.lit(v.FINDINGS["missing_h1_title"])),
    )
    shape = F.transform(flags(text, max_tokens, max_chars), lambda x: F.struct(F.concat(F.lit("chunk:"), x["rule"]).alias("rule"), F.concat(x["section"], F.lit(": "), x["detail"]).alias("detail")))
    bad = F.array(hit("frontmatter_invalid", F.lit(v.FINDINGS["frontmatter_invalid"])))
    return F.when(~fm["ok"], bad).otherwise(F.filter(F.concat(own, shape), lambda x: x.isNotNull()))


def surface(files: DataFrame, *, oversize: int = 51_200, threshold: float = 0.6, prefixes: Sequence[str] = T.PREFIXES, generic: Sequence[str] = v.GENERIC_STEMS, **limits) -> DataFrame:
    """path, rule and detail of all findings over ``files`` (path, size, text, error): those of each artifact, files that can't be read or are too large, and near-duplicates."""
    files = files.where(~T.base_name(F.col("path")).isin(list(SKIPPED)))
    fine = files.where("error is null").withColumn("fm", frontmatter.parsed(F.col("text")))
    each = fine.select("path", F.explode(findings(F.col("fm"), F.col("text"), **limits)).alias("x")).select("path", "x.rule", "x.detail")
    unread = files.where("error is not null").select("path", F.lit("read_error"), "error")
    large = files.where(F.col("size") > oversize).select("path", F.lit("oversize"), F.concat(F.col("size").cast("string"), F.lit(f"{v.FINDINGS['oversize']}{oversize}")))
    near = neardup.clusters(fine, threshold, prefixes=prefixes, generic=generic)
    near = near.groupBy("cluster").agg(F.sort_array(F.collect_list("path")).alias("p")).select("cluster", F.lit("near_duplicate"), F.concat(F.lit(v.FINDINGS["near_duplicate"]), F.array_join("p", ", ")))
    return each.unionAll(unread).unionAll(large).unionAll(near)


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").count()


def verdict(found: DataFrame) -> str:
    return "PASS" if found.isEmpty() else "FAIL"
