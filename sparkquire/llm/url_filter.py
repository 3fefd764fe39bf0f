"""URL rules by host suffix and path prefix, and their spread over redirect aliases.

DataFrame functions only: no UDF, no row ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..storage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``canonical`` is one of rel's words, wherever it stands among them; a longer word that begins so is another.
LINK_TAG = r"(?is)<link\b[^>]*\srel\s*=\s*(?:\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))[^>]*>"
META_TAG = r"(?is)<meta\b[^>]*\shttp-equiv\s*=\s*(?:\"\s*refresh\s*\"|'\s*refresh\s*'|refresh(?=[\s/>]))[^>]*>"
#: What a browser doesn't read as tags.
UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH = r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)"

Rule = tuple[str, str, str]  # action (allow or block), host, path


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, action) of the longest fitting rule, or null.  A rule fits its host and
    all subdomains where the path starts with the rule's; of equal lengths, allow wins, then
    the lesser text.  The work grows with the number of rules: they are literals of the plan."""
    best = F.lit(None).cast("struct<rule:string,action:string>")
    order = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", [-ord(c) for c in r[1] + r[2]]))
    chain = None
    for action, h, p in reversed(order):
        if action not in ("allow", "block"):
            raise ValueError(f"unknown action {action!r}")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return best if chain is None else chain.otherwise(best)


def node_of(url: Column) -> Column:
    """What names a url in the alias graph: scheme and host as written but lower-cased, path
    and query kept, the fragment dropped; null for a text without ``://``."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    scheme = F.lower(F.regexp_extract(bare, r"(?s)^(.*?)://", 1))
    return F.when(F.instr(bare, "://") > 0, F.concat(scheme, F.lit("://"), host_of(bare), F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)))


def absolute(target: Column, base: Column) -> Column:
    """A link target against its page's url: absolute, ``//host``, ``/path``, ``?query`` or relative to the folder."""
    t = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1))
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*((?:/[^?#]*/)|/?)", 1)
    plain = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    return (
        F.when((t == "") | t.startswith("#"), F.lit(None))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(site, t))
        .when(t.startswith("?"), F.concat(plain, t))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), t))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b) nodes that a page names equal: every canonical link and every meta refresh outside comments and scripts."""
    body = F.regexp_replace(F.col(html), UNREAD, "")
    links = F.transform(F.regexp_extract_all(body, F.lit(LINK_TAG), 0), lambda tag: F.concat(F.regexp_extract(tag, HREF, 1), F.regexp_extract(tag, HREF, 2), F.regexp_extract(tag, HREF, 3)))
    turns = F.transform(F.regexp_extract_all(body, F.lit(META_TAG), 0), lambda tag: F.regexp_extract(tag, REFRESH, 1))
    some = F.lower(F.col(html)).contains("canonical") | F.lower(F.col(html)).contains("http-equiv")  # before any pattern runs
    named = pages.where(F.col(url).isNotNull() & some).select(F.col(url).alias("base"), F.explode(F.concat(links, turns)).alias("to"))
    return named.select(node_of(F.col("base")).alias("a"), node_of(absolute(F.col("to"), F.col("base"))).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_block, alias_allow), one row a page.

    A page with a rule of its own has that rule's verdict: an explicit allow is never
    overruled.  Any other page takes the verdict of its equivalence class of urls under
    canonical links, meta refreshes and ``redirects`` (columns a and b, urls): allow if the
    class holds an explicitly allowed url, else block if it holds a blocked one, else
    allow.  Classes join both directions of a link and reach over any number of hops;
    link targets count although they may be no page here.

    Null urls and texts without ``://`` have empty host and path, no rule, and verdict
    allow.  Repeated rows and urls each give their own row; extra columns are ignored.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"))
    own = own.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), node_of(F.col("_url")).alias("_node"))
    own = own.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    edges = alias_edges(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a is not null and b is not null"))
    edges = cut(edges.distinct())
    if edges.isEmpty():
        spread = own.withColumns({"alias_block": F.lit(False), "alias_allow": F.lit(False)})
    else:
        nodes = components(edges)
        ruled = nodes.withColumn("_a", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["action"])
        classes = ruled.groupBy("component").agg(F.max(F.col("_a").eqNullSafe("block")).alias("alias_block"), F.max(F.col("_a").eqNullSafe("allow")).alias("alias_allow")).where("alias_block or alias_allow")
        marks = ruled.join(classes, "component").select(F.col("node").alias("_node"), "alias_block", "alias_allow")
        spread = own.join(marks, "_node", "left").fillna(False, ["alias_block", "alias_allow"])
    verdict = F.coalesce(F.col("_r.action"), F.when(F.col("alias_block") & ~F.col("alias_allow"), "block").otherwise("allow"))
    return spread.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "alias_block", "alias_allow")
