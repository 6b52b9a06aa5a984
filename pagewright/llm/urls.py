"""Operator 9: URL filters that follow redirects and canonical links.

A URL is judged by its own host and path rule if one fits, the longest winning. The other URLs get the decision of their
equivalence class: the connected component over redirect and canonical-link edges. A class that holds an explicitly
allowed URL is allowed, else one that holds an explicitly blocked URL is blocked, else the default holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import connected_components, materialise
from pagewright.operators.lines import let


@dataclass(frozen=True)
class Rule:
    """A verdict ('allow' or 'block') for a host with its subdomains and the paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the op9 contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: What isn't markup: comments (an open one runs to the end) and what elements of raw text hold.
_NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|title|textarea)\b.*?</\1"
#: A name with its value, quoted up to the same quote or bare up to a blank.
_ATTRIBUTE = r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+"""
#: A tag up to its end, `>` inside quotes not being one, or to the text's end, so that no text is searched twice; the latter is none.
_TAG = rf"(?i)<(?:link|meta|base)(?=[\s/>])(?:[\s/=]++|{_ATTRIBUTE})*+(?:>|\z)"
#: What a refresh names: after its seconds and a separator, with or without `url=`.
_REFRESH = r"(?is)^\s*+[0-9.][0-9.]*+(?=[;,\s])\s*+[;,]?+\s*+(?:url\s*+=\s*+)?+(.*)$"
#: A refresh's address in quotes, up to the same quote or the end.
_REFRESH_QUOTED = r"""(?s)^(["'])(.*?)(?:\1.*)?$"""
#: The named references that a URL may hold.
_REFERENCES = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "apos;": "'"}


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is no `://` or no url."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty as for the host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits. Written for rule lists of some hundreds."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    out = None
    for r in ordered:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def node_of(url: Column) -> Column:
    """What stands for a URL in the graph: without its fragment, which never reaches a server; host and scheme lower-cased."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    return F.concat(lower_ascii(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def absolute(base: Column, target: Column) -> Column:
    """`target` as an absolute URL, as RFC 3986 resolves it against `base`; null if it is relative and the base has no host.

    With a scheme as it is; else with the base's scheme (`//host`), host (`/path`), path (`?query`, `#fragment`) or folder
    (`name`). `.` and `..` segments of paths are worked off; absolute targets stay as they are.
    """
    scheme = F.regexp_extract(base, r"(?s)^(.*?):/", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path, query = path_of(base), F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)", 1)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    whole = F.when((own == "") & rest.startswith("?"), F.concat(root, path, rest)).when(own == "", F.concat(root, path, query, rest))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//") & (scheme != ""), F.concat(scheme, F.lit(":"), target))
        .when(root != "", whole.otherwise(F.concat(root, without_dots(joined), rest)))
    )


def without_dots(path: Column) -> Column:
    """A path that begins with `/`, with its `.` and `..` segments worked off."""
    parts = F.split(F.substring(path, 2, F.length(path)), "/", -1)
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    done = F.aggregate(parts, none, step)
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(done) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.concat(F.lit("/"), path, F.lit("/")).rlike(r"/\.\.?/"), F.concat(F.lit("/"), F.array_join(done, "/"), end)).otherwise(path)


def decoded(value: Column) -> Column:
    """An attribute's value with its character references replaced, each once: decimal, hexadecimal and five named ones.

    Numbers that stand for no character become U+FFFD, as in browsers; other references stay as they are.
    """

    def part(p: Column, i: Column) -> Column:
        hexadecimal = F.regexp_extract(p, r"^#[xX]0*+([0-9A-Fa-f]+);?", 1)
        decimal = F.regexp_extract(p, r"^#0*+([0-9]+);?", 1)
        code = (
            F.when(F.length(hexadecimal) > 6, F.lit(-1))
            .when(hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("int"))
            .when(F.length(decimal) > 7, F.lit(-1))
            .otherwise(decimal.try_cast("int"))
        )
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.lpad(F.hex(F.when(known, code).otherwise(F.lit(0xFFFD)).cast("long")), 8, "0")
        out = F.when(F.lit(False), p)
        for name, char in _REFERENCES.items():
            out = out.when(p.startswith(name), F.concat(F.lit(char), F.substring(p, len(name) + 1, 1 << 30)))
        numbered = F.concat(F.decode(F.unhex(number), "UTF-32"), F.regexp_replace(p, r"^#(?:[xX][0-9A-Fa-f]+|[0-9]+);?", ""))
        out = out.when(code.isNotNull(), numbered)
        return F.when(i == 0, p).otherwise(out.otherwise(F.concat(F.lit("&"), p)))

    return F.when(value.contains("&"), F.array_join(F.transform(F.split(value, "&", -1), part), "")).otherwise(value)


def _address(value: Column) -> Column:
    """A value as an address: without blanks around and line breaks inside; other blanks are written as %20."""
    return F.replace(F.trim(F.regexp_replace(value, r"[\t\n\r\f]", "")), F.lit(" "), F.lit("%20"))


def _attributes(tags: Column) -> Column:
    """Array of struct(kind, rel, href, equiv, content), one for each tag; of a repeated attribute the first counts, one that is missing is null.

    In steps, as what a step has worked out is only referred to in the next one.
    """
    names = {"rel": "rel", "href": "href", "equiv": "http-equiv", "content": "content"}

    def each(rule):
        return lambda t: F.struct(t["kind"].alias("kind"), *[rule(t[n]).alias(n) for n in names])

    def parted(tag: Column) -> Column:
        found = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1))
        return F.struct(F.transform(found, lower_ascii).alias("names"), F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2)).alias("values"))

    def picked(t: Column) -> Column:
        place = lambda name: F.array_position(t["names"], name).cast("int") - 1
        return F.struct(F.substring(F.get(t["names"], F.lit(0)), 2, 4).alias("kind"), *[F.get(t["values"], place(name)).alias(n) for n, name in names.items()])

    def bare(value: Column) -> Column:
        return F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)

    whole = F.filter(tags, lambda tag: tag.endswith(">"))
    return F.transform(F.transform(F.transform(F.transform(whole, parted), picked), each(bare)), each(decoded))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target): all canonical links and refreshes that the pages' HTML names, resolved against its first `<base href>` or the page's URL.

    Tags are read as browsers read them: comments, scripts, styles and titles hold none, quoted values end at the same quote,
    character references are decoded, `rel` is a list of words. What doesn't lead to a host (`javascript:`, `mailto:`) is no alias.
    """
    rows = pages.filter(F.col(html_col).rlike(r"(?i)canonical|http-equiv") & F.col(url_col).isNotNull())
    rows = rows.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    url, markup = F.col("url"), F.regexp_replace("html", _NO_MARKUP, " ")

    def base(tags: Column) -> Column:
        first = F.get(F.filter(tags, lambda t: (t["kind"] == "base") & t["href"].isNotNull()), F.lit(0))
        return let(_address(first["href"]), lambda b: F.coalesce(absolute(url, b), url))

    def target(t: Column) -> Column:
        canonical = (t["kind"] == "link") & F.array_contains(F.split(lower_ascii(t["rel"]), r"\s+"), "canonical")
        refresh = (t["kind"] == "meta") & (lower_ascii(F.trim(t["equiv"])) == "refresh")
        refreshed = F.regexp_replace(F.regexp_extract(t["content"], _REFRESH, 1), _REFRESH_QUOTED, "$2")
        return _address(F.when(canonical, t["href"]).when(refresh, refreshed))

    def found(tags: Column, b: Column) -> Column:
        named = F.filter(F.transform(tags, target), lambda t: t != "")
        return F.filter(F.transform(named, lambda t: absolute(b, t)), lambda t: t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"))

    tags = _attributes(F.regexp_extract_all(markup, F.lit(_TAG), F.lit(0)))
    targets = let(tags, lambda tags: let(base(tags), lambda b: found(tags, b)))
    # the outer form, as Spark would work out the others' arrays once more to see whether they are empty
    return rows.select("url", F.explode_outer(targets).alias("target")).filter("target is not null")


def judge(
    pages: DataFrame,
    redirects: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, and component (null for a URL without aliases).

    `redirects` (url, target), if given, adds edges to those that the HTML names. Null urls, and such without `://`, have
    an empty host and path, fit no rule and get the default. Repeated rows and urls are judged alike, each on its own row.
    Only urls cross the network: a URL that a third of the rows share is one node.
    """
    own = longest_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    edges = redirects.select("url", "target").dropna() if redirects is not None else None
    if html_col is not None:
        named = alias_edges(pages, url_col, html_col)
        edges = named if edges is None else edges.unionByName(named)
    found = rows.withColumn("own", own)
    if edges is not None:
        components = materialise(connected_components(edges.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))))
        judged = components.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node"))).withColumn("own", own)
        verdicts = judged.groupBy("component").agg(
            F.when(F.bool_or(F.col("own.verdict") == "allow"), "allow").when(F.bool_or(F.col("own.verdict") == "block"), "block").alias("by_alias")
        )
        found = found.join(components.join(verdicts, "component"), "node", "left")
    else:
        found = found.withColumn("component", F.lit(None).cast("string")).withColumn("by_alias", F.lit(None).cast("string"))
    verdict = F.coalesce("own.verdict", "by_alias", F.lit(default))
    return found.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "component")
