"""URL filters: block and allow rules, with blocks carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import ascii_lower
from assayline.llm.components import connected_components

#: (action, host, path): the rule fits the host and its subdomains where the path starts so.
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first :// and the next /, ?, # or end, A-Z lower-cased; and from there to ?, # or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(size, rule, action) of the longest rule that fits, or null.

    Rules are looked up by the host's suffixes in a literal map, so a row costs
    its number of labels, however many rules there are. Of two rules that
    name the same host and path, the allowing one counts.
    """
    by_host: dict[str, list[Rule]] = {}
    for action, h, p in sorted(set(rules), key=lambda r: r[0] == "allow"):
        by_host.setdefault(h, []).append((action, h, p))

    def entry(r: Rule) -> Column:
        return F.struct(F.lit(len(r[1] + r[2])).alias("size"), F.lit(int(r[0] == "allow")).alias("allow"), F.lit(r[1] + r[2]).alias("rule"), F.lit(r[2]).alias("path"), F.lit(r[0]).alias("action"))

    if not by_host:
        return F.lit(None).cast("struct<size:int,allow:int,rule:string,path:string,action:string>")
    known = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*map(entry, rs)))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(known, s)), lambda r: r.isNotNull()))
    return F.array_max(F.filter(fitting, lambda r: F.startswith(path, r.path)))


def url_key(url: Column) -> Column:
    """The url without its fragment, with scheme and host in lower case: what equal keys name is one resource."""
    bare = F.regexp_replace(url, "(?s)#.*", "")
    head = F.regexp_extract(bare, "^[^/?]*://[^/?]*", 0)
    return F.when(head == "", bare).otherwise(F.concat(ascii_lower(head), F.substr(bare, F.length(head) + 1)))


def resolve(base: Column, target: Column) -> Column:
    """target against the page's url: absolute, //host, /path, ?query or relative to the last slash; null if it has another scheme."""
    t = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    scheme, origin = F.regexp_extract(base, "^[^:/?#]+:", 0), F.regexp_extract(base, "^[^:/?#]+://[^/?#]*", 0)
    no_query = F.regexp_extract(base, "^[^?#]*", 0)
    folder = F.when(no_query == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(no_query, "(?s)^.*/", 0))
    return (
        F.when((t == "") | t.startswith("#"), None)
        .when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.startswith("//"), F.concat(scheme, t))
        .when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(t.startswith("/"), F.concat(origin, t))
        .when(t.startswith("?"), F.concat(no_query, t))
        .otherwise(F.concat(folder, t))
    )


_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?\s*canonical\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"
_URL = r"(?is)\burl\s*=\s*['\"]?\s*([^'\"\s>;]+)"


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): the url keys that a page's canonical link or refresh redirect makes one, from pages (url, html)."""
    link, meta = F.regexp_extract("html", _LINK, 0), F.regexp_extract("html", _META, 0)
    targets = F.array(F.concat(*[F.regexp_extract(link, _HREF, i) for i in (1, 2, 3)]), F.regexp_extract(meta, _URL, 1))
    found = pages.where("url is not null and html is not null").where(F.col("html").rlike("(?i)canonical|refresh")).select("url", F.explode(targets).alias("t")).where("t != ''")
    return found.select(url_key(F.col("url")).alias("a"), url_key(resolve(F.col("url"), F.col("t"))).alias("b"))


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for each row of pages (page_id, url, html).

    A url's own longest rule decides it. Without one, it is blocked if some url
    that redirects (the table redirects (from_url, to_url), and refresh tags) or
    canonical links join it to, directly or not, is blocked by a rule of its
    own, pages or not; an explicit allow thus beats a propagated block for the
    urls it fits and no others. All else is allowed. component is the smallest
    url key of its group, null where nothing is joined. A null url, or one
    without ://, has an empty host and path, no rule and is allowed. Repeated
    rows each get a row; empty tables give empty results.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_key(F.col("from_url")).alias("a"), url_key(F.col("to_url")).alias("b")))
    groups = connected_components(edges)
    action = rule_of(*host_and_path(F.col("node")), rules)["action"]
    judged = groups.withColumn("blocked", F.coalesce(action == "block", F.lit(False)))
    per_group = judged.groupBy("component").agg(F.max("blocked").alias("blocked"))
    nodes = judged.select("node", "component").join(per_group, "component")
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), url_key(F.col("url")).alias("node"))
    own = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    # pages without a url have no links; they would all meet in one task of the join
    linked = own.where("node is not null").join(nodes, "node", "left")
    own = linked.unionByName(own.where("node is null"), allowMissingColumns=True)
    verdict = F.coalesce("r.action", F.when(F.col("blocked"), "block"), F.lit("allow"))
    return own.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "component")
