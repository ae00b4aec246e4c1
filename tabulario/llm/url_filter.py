"""Block and allow decisions on URLs, carried over to their aliases.

A page may name another address of itself: by a canonical link or by a refresh
to another place. Pages that are linked in this way, directly or over others,
are one resource. A page is judged by the longest rule that fits its own
address; a page that no rule fits is blocked if some alias is blocked and none
is allowed by a rule, else allowed. Everything is DataFrame work; the
components are found by rounds of joins over the distinct edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.llm.components import components
from tabulario.llm.workspace import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Rules are part of the plan, so there may be this many; more belong into a table.
MOST_RULES = 1000
# Blocked aliases are copied this many times, so that an address with very many pages meets them in as many tasks.
SALTS = 16
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; of equally long ones the last in order of text."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    fits = []
    for verdict, domain, prefix in rules:
        fit = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        fits.append(F.when(fit, F.struct(F.lit(len(domain + prefix)).alias("n"), F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return fits[0] if len(fits) == 1 else F.greatest(*fits)


def address(url: Column) -> Column:
    """What two spellings of an address share: host, path and query, without scheme and fragment."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), query)


def alias_edges(pages: DataFrame) -> DataFrame:
    """Distinct (a, b): an address and another one that its page names as canonical or refreshes to.

    Relative targets are resolved against the host (from /) or the folder.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    head = pages.where(html.rlike(r"(?i)canonical|refresh") & (host_of(F.col("url")) != "")).select("url", html.alias("html"))
    tags = F.concat(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0)), F.regexp_extract_all("html", F.lit(_META), F.lit(0)))
    found = head.select("url", F.explode(tags).alias("tag"))
    target = F.when(F.col("tag").rlike(r"(?i)^<link"), F.regexp_extract("tag", _HREF, 1)).otherwise(F.regexp_extract("tag", _URL, 1))
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    folder = F.regexp_extract(path_of(F.col("url")), r"(?s)^(.*/)", 1)
    base = F.concat(F.lit("x://"), host_of(F.col("url")))
    whole = (
        F.when(F.col("t").contains("://"), F.col("t")).when(F.col("t").startswith("//"), F.concat(F.lit("x:"), F.col("t")))
        .when(F.col("t").startswith("/"), F.concat(base, F.col("t")))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), F.col("t")))
    )
    edges = found.withColumn("t", target).where(F.col("t") != "").select(address(F.col("url")).alias("a"), address(whole).alias("b"))
    return edges.where((F.col("a") != F.col("b")) & (F.col("b") != "/")).distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, host, path, rule, verdict.

    A url that is null or has no :// has empty host and path, fits no rule and
    is allowed. Repeated rows are judged alike; no pages give no rows.
    """
    work = Workspace(pages.sparkSession)
    url = F.col("url")
    out = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("_node"))
    out = out.withColumn("_fit", rule_for(F.col("host"), F.col("path"), rules))
    out = out.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("_own"), "_node")
    edges = work.keep(alias_edges(pages), "edges")
    if edges.isEmpty():
        return out.select("page_id", "host", "path", "rule", F.coalesce("_own", F.lit("allow")).alias("verdict"))
    nodes = work.keep(components(edges), "nodes")
    # Every address of a component counts, pages or not; its host and path are read off the address.
    as_url = F.concat(F.lit("x://"), F.col("node"))
    seeds = nodes.withColumn("_v", rule_for(host_of(as_url), path_of(as_url), rules)["verdict"]).where(F.col("_v").isNotNull())
    judged = seeds.groupBy("component").agg(F.bool_or(F.col("_v") == "allow").alias("_allowed"), F.bool_or(F.col("_v") == "block").alias("_blocked"))
    blocked = nodes.join(judged.where(F.col("_blocked") & ~F.col("_allowed")), "component").select(F.col("node").alias("_node"))
    blocked = blocked.select("_node", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit("block").alias("_alias"))
    salted = out.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    verdict = F.coalesce("_own", "_alias", F.lit("allow"))
    return salted.join(blocked, ["_node", "_salt"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
