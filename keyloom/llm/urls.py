"""URL filters with redirect equivalence.

Each url is judged by the longest rule that fits its host (or a parent domain) and its path.
Urls joined by redirect or canonical-link edges are aliases of each other: connected components
over the edges pass block decisions on. A url without a rule of its own is blocked if an alias
is blocked by a rule and none is allowed by one (an explicit allow comes first), else allowed;
a rule's own verdict is never changed.

Edges come from the pages themselves (a canonical link or a refresh redirect in the html) and
from an optional table of (src, dst). A short list of rules is held in the plan, so urls are
judged where they are read and only urls with edges are shuffled. A longer list, or a table of
(rule, verdict), is joined: distinct hosts meet rules by the ends of their names, urls meet the
rules of their host. Both give the same.

Defined cases: null url, or one without "://": empty host and path, no rule, allowed. Null html
has no edges. Repeated rows are judged each for itself. Other columns are ignored. Of rules of
equal length block comes first; null rules are none. An empty table gives no rows; urls and html
of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, written

#: (host, path prefix, verdict); the text before the first "/" is the host.
Rule = tuple[str, str]
# The rules of the registered query.
RULES: tuple[Rule, ...] = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: A list of up to so many rules stands in the plan; others are joined.
LITERAL_RULES = 1_000
FITTING = "array<struct<path:string,length:int,verdict:string,rule:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CANONICAL_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?\s*canonical\b[^>]*>"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
TARGET = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*['\"]?\s*([^\"'\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, else null. On equal length block comes before allow."""
    if not rules:
        return F.lit(None).cast("struct<length:int,verdict:string,rule:string>")
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"no such verdict: {verdict}")
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name.translate(str.maketrans(UPPER, LOWER)), []).append((slash + rest, verdict, rule))
    labels = max(name.count(".") + 1 for name in by_host)
    fits = []
    table = F.create_map(*[x for name, own in by_host.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(len(r)).alias("length"), F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for p, v, r in own]))])
    for k in range(1, labels + 1):  # the last k labels of the host
        fits.append(F.coalesce(F.try_element_at(table, F.substring_index(host, ".", -k)), F.array().cast(FITTING)))
    return longest(F.concat(*fits), path)


def longest(rules: Column, path: Column) -> Column:
    """Of a host's rules the longest that the path starts with."""
    fitting = F.filter(rules, lambda r: path.startswith(r["path"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["length"], r["verdict"], r["rule"])))


def ruled(urls: DataFrame, url: str, rules: Sequence[Rule] | DataFrame, literal: int = LITERAL_RULES) -> DataFrame:
    """``urls`` with host, path and _own, the rule that fits (see ``rule_for``)."""
    host, path = host_and_path(F.col(url))
    urls = urls.withColumns({"host": host, "path": path})
    if not isinstance(rules, DataFrame):
        if len(rules) <= literal:
            return urls.withColumn("_own", rule_for(F.col("host"), F.col("path"), rules))
        rules = urls.sparkSession.createDataFrame(list(rules), "rule string, verdict string")
    rules = rules.select("rule", "verdict").filter("rule IS NOT NULL")
    if (odd := rules.filter("verdict IS NULL OR verdict NOT IN ('allow', 'block')").first()) is not None:
        raise ValueError(f"no such verdict: {odd['verdict']}")
    name, rest = F.substring_index("rule", "/", 1), F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1)
    own = F.struct(rest.alias("path"), F.length("rule").alias("length"), "verdict", "rule")
    table = written(rules.select(F.translate(name, UPPER, LOWER).alias("end"), own.alias("own")).distinct())
    labels = table.agg(F.max(F.size(F.split("end", "[.]")))).first()[0] or 1
    ends = F.expr(f"transform(sequence(1, least({labels}, size(split(host, '[.]')))), k -> substring_index(host, '.', -k))")
    met = urls.select("host").distinct().select("host", F.explode(ends).alias("end")).join(table, "end")
    of_host = met.groupBy("host").agg(F.collect_list("own").alias("_rules"))
    return urls.join(of_host, "host", "left").withColumn("_own", longest("_rules", F.col("path"))).drop("_rules")


def resolved(to: Column, page: Column) -> Column:
    """The absolute url that ``to`` names on a page; null for a fragment, another kind of scheme, or a page without "://"."""
    root = F.regexp_extract(page, r"^[^:/?#]*://[^/?#]*", 0)
    path = F.regexp_extract(page, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^.*/", 0)
    full = F.when(to.startswith("/"), to).when(to.startswith("?"), F.concat(path, to)).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), to))
    own, rest = F.regexp_extract(full, r"^[^?#]*", 0), F.regexp_extract(full, r"(?s)^[^?#]*(.*)$", 1)
    steps = F.split(F.regexp_replace(own, "^/", ""), "/", -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(steps, none, lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))))
    kept = F.concat(kept, F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none))
    plain = F.when(own.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(own)
    beside = F.when((root != "") & (to != "") & ~to.startswith("#"), F.concat(root, plain, rest))
    scheme = F.regexp_extract(page, r"^[^:/?#]*:", 0)
    return F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(F.instr(to, "://") > 0, to)).when(to.startswith("//"), F.concat(scheme, to)).otherwise(beside)


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and each address that it names as canonical or redirects to, resolved against the url."""

    def named(tag: str, attribute: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: F.replace(F.regexp_extract(t, attribute, 1), F.lit("&amp;"), F.lit("&")))

    both = pages.filter("url IS NOT NULL AND html IS NOT NULL").select(F.col("url").alias("a"), F.concat(named(CANONICAL_TAG, HREF), named(REFRESH_TAG, TARGET)).alias("to"))
    return both.select("a", F.explode("to").alias("to")).select("a", resolved(F.col("to"), F.col("a")).alias("b")).filter("b IS NOT NULL AND a <> b")


def judge_pages(pages: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, component_blocked) for every row of ``pages``."""
    edges = page_edges(pages) if "html" in pages.columns else None
    if redirects is not None:
        given = redirects.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("src IS NOT NULL AND dst IS NOT NULL")
        edges = given if edges is None else edges.unionByName(given)
    judged = ruled(pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url")), "url", rules)
    blocked = F.lit(False)
    if edges is not None and not (edges := written(edges.distinct())).isEmpty():
        aliases = written(components(edges))
        by_component = ruled(aliases, "node", rules).select("node", "component", F.col("_own")["verdict"].alias("v")).groupBy("component").agg(F.max(F.col("v") == "block").alias("block"), F.max(F.col("v") == "allow").alias("allow"))
        bad = by_component.filter("block AND NOT coalesce(allow, false)").select("component")
        named = aliases.join(bad, "component").select(F.col("node").alias("url"), F.lit(True).alias("_bad"))
        judged = judged.join(named, "url", "left")
        blocked = F.coalesce("_bad", F.lit(False))
    by_alias = F.when(blocked, "block").otherwise("allow")
    return judged.select("page_id", "url", "host", "path", F.col("_own")["rule"].alias("rule"), F.coalesce(F.col("_own")["verdict"], by_alias).alias("verdict"), blocked.alias("component_blocked"))
