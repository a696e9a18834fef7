"""URL filters whose decisions pass along redirects and canonical links.

A page's url is judged by the longest rule that fits its host or a parent domain, and its path's start. Redirects (meta
refresh, or a given table) and canonical links join urls to classes of aliases, found by connected components over all
edges. A url without a rule of its own takes its class's decision: allow if a member is explicitly allowed, else block if a
member is blocked, else allow.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case. Path: from there up to `?`, `#` or the end. A
null url or one without `://` has both empty, fits no rule and has no alias. All canonical and refresh tags of a page count.
Their targets are resolved against the page's url, or its first base tag, as RFC 3986 says; one whose scheme is not followed
by `//` (mailto:, data:) has no alias. Urls are the same alias if they agree in host and the rest up to `#`, without dot
segments. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import lower_ascii, saved
from opsgraph.llm.components import components

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
BASE = r"(?is)<base\b[^>]*\bhref\s*=[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def undotted(path_: Column) -> Column:
    """A path that starts with / without its segments . and .., each .. taking away the one before."""
    segments = F.slice(F.split(path_, "/"), 2, F.size(F.split(path_, "/")))
    none = F.array().cast("array<string>")

    def step(held: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(s == ".", held).otherwise(F.concat(held, F.array(s)))

    last = F.when(path_.rlike(r"/\.{1,2}$"), F.array(F.lit(""))).otherwise(none)
    kept = F.concat(F.aggregate(segments, none, step), last)
    return F.when(path_.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path_)


def alias_of(url: Column) -> Column:
    """What two spellings of one url share; null without a host."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), undotted(path(url)), query))


def resolved(target: Column, base: Column) -> Column:
    """The alias that a target names on a page whose base has the alias `base`; null for none, and without a host."""
    own_host, own_path = F.regexp_extract(base, r"^[^/?#]*", 0), F.regexp_extract(base, r"^[^/?#]*([^?#]*)", 1)
    place, query = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.when(own_path == "", "/").otherwise(F.regexp_extract(own_path, r"^.*/", 0))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), alias_of(target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (target == ""), F.lit(None))
        .when(target.startswith("//"), alias_of(F.concat(F.lit("x:"), target)))
        .when(target.startswith("/"), F.concat(own_host, undotted(place), query))
        .when(target.startswith("#"), base)
        .when(target.startswith("?"), F.concat(own_host, F.when(own_path == "", "/").otherwise(own_path), query))
        .otherwise(F.concat(own_host, undotted(F.concat(folder, place)), query))
    )


def links(html: Column, tags: str, pattern: str, base: Column) -> Column:
    """The aliases that all tags of a kind point at."""
    return F.transform(F.regexp_extract_all(html, F.lit(tags), F.lit(0)), lambda tag: resolved(F.regexp_extract(tag, pattern, 1), base))


def fitting(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> Column:
    """The index of the longest rule that fits, of rules longest first; null for none."""
    out = F.lit(None).cast("int")
    for i, (_, rule) in reversed(list(enumerate(rules))):
        domain, _, start = rule.partition("/")
        fits = ((host_ == domain) | host_.endswith(f".{domain}")) & path_.startswith(f"/{start}")
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. redirects: more edges (src, dst), as urls."""
    rules = sorted(rules, key=lambda r: -len(r[1]))
    # element_at() of a null index isn't null where Spark fails on errors.
    name = lambda i, at: F.when(i.isNotNull(), F.element_at(F.array(*[F.lit(r[at]) for r in rules]), i + 1))
    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").alias("page_id"), url.alias("url"), host(url).alias("host"), path(url).alias("path"), alias_of(url).alias("alias"), html.alias("html"))
    base = F.coalesce(resolved(F.regexp_extract(F.regexp_extract("html", BASE, 0), HREF, 1), F.col("alias")), F.col("alias"))
    others = F.concat(links(F.col("html"), CANONICAL, HREF, base), links(F.col("html"), REFRESH, TARGET, base))
    rows = rows.withColumn("others", others).drop("html")
    rows = saved(rows.withColumn("fit", fitting(F.col("host"), F.col("path"), rules)), "pages")
    edges = rows.select("alias", F.explode("others").alias("other"))
    if redirects is not None:
        edges = edges.union(redirects.select(alias_of(F.col("src")), alias_of(F.col("dst"))))
    edges = saved(edges.filter("alias is not null and other is not null and alias != other").distinct(), "edges")
    own = [F.col("page_id"), F.col("host"), F.col("path"), name(F.col("fit"), 1).alias("rule")]
    if not edges.limit(1).count():
        return rows.select(*own, F.coalesce(name(F.col("fit"), 0), F.lit("allow")).alias("verdict"))
    # Every url an edge names takes part, whether it is a page or not: a rule can fit a redirect's target alone.
    ends = edges.select(F.explode(F.array("alias", "other")).alias("alias")).distinct()
    ends = ends.withColumn("id", F.xxhash64("alias")).withColumn("as_url", F.concat(F.lit("x://"), F.col("alias")))
    ends = ends.withColumn("fit", fitting(host(F.col("as_url")), path(F.col("as_url")), rules))
    label = components(edges.select(F.xxhash64("alias").alias("a"), F.xxhash64("other").alias("b")))
    ends = saved(ends.join(label, "id").select("alias", "component", name(F.col("fit"), 0).alias("decision")), "aliases")
    classes = ends.groupBy("component").agg(F.bool_or(F.col("decision") == "allow").alias("allowed"), F.bool_or(F.col("decision") == "block").alias("blocked"))
    passed = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    passed = ends.join(classes, "component").select("alias", passed.alias("passed"))
    return rows.join(passed, "alias", "left").select(*own, F.coalesce(name(F.col("fit"), 0), "passed", F.lit("allow")).alias("verdict"))
