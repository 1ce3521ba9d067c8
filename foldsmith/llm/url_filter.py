"""URL rules whose block decisions reach the aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.llm.common import ascii_lower, write_table
from foldsmith.llm.graph import connected_components

PARTS = r"://([^/?#]*)([^?#]*)"
TAGS = r"(?i)<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?i)\brel\s*=\s*["']?canonical\b"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
# "&amp;" last, so that "&amp;lt;" is "&lt;"
ENTITIES = ((r"&(?i:quot|#0*34|#x0*22);", '"'), (r"&(?i:apos|#0*39|#x0*27);", "'"), (r"&(?i:lt|#0*60|#x0*3c);", "<"), (r"&(?i:gt|#0*62|#x0*3e);", ">"),
            (r"&(?i:#0*47|#x0*2f);", "/"), (r"&(?i:#0*58|#x0*3a);", ":"), (r"&(?i:#0*61|#x0*3d);", "="), (r"&(?i:#0*63|#x0*3f);", "?"),
            (r"&(?i:amp|#0*38|#x0*26);", "&"))
TRACKING = r"(^|&)(?:utm_[^=&]*|gclid|fbclid)(?:=[^&]*)?"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical_of(url: Column) -> Column:
    """The form that spellings of one address share: no scheme, ``www.``, default port, fragment, tracking parameter
    or final slash. A url without ``://`` is its own form."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(?:80|443)$", ""), r"^www\.", "")
    query = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), TRACKING, "")
    query = F.regexp_replace(query, r"^&+", "")
    whole = F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.contains("://"), whole).otherwise(url)


def _decoded(text: Column) -> Column:
    """Common HTML entities as their characters."""
    for pattern, char in ENTITIES:
        text = F.regexp_replace(text, pattern, char)
    return text


def _without_dots(path: Column) -> Column:
    """A path that begins with ``/``, its segments ``.`` and ``..`` resolved."""
    kept = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), F.array().cast("array<string>"), lambda out, part: (
        F.when(part == ".", out).when(part == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(part)))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))


def _resolved(href: Column, url: Column) -> Column:
    """The address that ``href`` in the page ``url`` means; null if it is relative and the url has no ``://``, or of another kind (``mailto:``)."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*)://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"^(.*/)", 1)
    rooted = F.when(href.startswith("/"), href).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), href))
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return (F.when(href.rlike(ABSOLUTE), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.rlike(SCHEME) | ~url.contains("://"), F.lit(None))
            .when(href.startswith("?"), F.concat(origin, path_of(url), href)).when(href.startswith("#"), F.concat(origin, path_of(url), query, href))
            .otherwise(F.concat(origin, _without_dots(F.regexp_extract(rooted, r"^([^?#]*)", 1)), F.regexp_extract(rooted, r"^[^?#]*(.*)$", 1))))


def link_edges(pages: DataFrame) -> DataFrame:
    """(source, target) addresses from canonical links and refresh redirects in ``html``.

    Entities in a reference are decoded and it is resolved against the page's url; a url without ``://`` has only its absolute references.
    """
    tags = (pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)\b(?:canonical|refresh)\b"))
            .select("url", F.explode(F.regexp_extract_all("html", F.lit(TAGS), F.lit(0))).alias("tag")))
    href = (F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1))
            .when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", TARGET, 1)))
    return tags.select("url", _decoded(href).alias("href")).where("href <> ''").select(
        F.col("url").alias("source"), _resolved(F.col("href"), F.col("url")).alias("target")).where("target IS NOT NULL")


def longest_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) for the urls that a rule fits.

    Hosts are exploded into their suffixes and equi-joined with the rules' hosts, so a block list of any size is a
    hash lookup. Longest rule wins, then the longer host, then allow.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = (urls.where("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix"))
               .join(rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), F.col("verdict").alias("said")), "suffix")
               .where(F.col("path").startswith(F.col("prefix"))))
    rule = F.concat("suffix", "prefix")
    best = F.max(F.struct(F.length(rule).alias("n"), F.length("suffix").alias("h"), (F.col("said") == "allow").alias("a"),
                          rule.alias("rule"), F.col("said").alias("said")))
    return fitting.groupBy("url").agg(best.alias("best")).select("url", "best.rule", F.col("best.said").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One verdict per row of ``pages`` (page_id, url, html): (page_id, host, path, rule, verdict, component).

    ``rules`` has (host, path, verdict); ``redirects`` may add (source, target) addresses to the canonical links and
    refresh redirects found in ``html``. Spellings of an address share one canonical form; canonical forms tied by links are one
    component. A page that a rule fits gets the rule's verdict, so an explicit allow is never overridden. Any other
    page is blocked if a rule blocks some page of its component, else allowed.

    Nulls: a null url (or one without ``://``) has empty host and path, no rule; a null url has no component and is allowed.
    Null html has no links. Repeated rows come back as often as they came in. Columns beside the three are ignored.
    """
    facts = pages.select("url").where("url IS NOT NULL").distinct().select(
        "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical_of(F.col("url")).alias("form"))
    ruled = write_table(longest_rule(facts, rules), "ruled")
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = write_table(edges.distinct(), "links")
    tied = connected_components(edges.select(canonical_of(F.col("source")).alias("a"), canonical_of(F.col("target")).alias("b")))
    tied = write_table(tied.withColumnsRenamed({"node": "form", "component": "tied"}), "tied")
    blocked = (ruled.where("verdict = 'block'").select(canonical_of(F.col("url")).alias("form")).distinct()
               .join(tied, "form", "left").select(F.coalesce("tied", "form").alias("component")).distinct()
               .withColumn("bad", F.lit(True)))
    # these tables grow with the pages, and repetitive urls take far less room in a file than in memory: never broadcast
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        canonical_of(F.col("url")).alias("form"))
    rows = rows.join(ruled.hint("merge"), "url", "left").join(tied.hint("merge"), "form", "left").withColumn("component", F.coalesce("tied", "form"))
    rows = rows.join(write_table(blocked, "blocked").hint("merge"), "component", "left")
    verdict = F.coalesce("verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")
