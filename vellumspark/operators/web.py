"""Web pages: elements, structured data, metadata, language alternates, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.operators.graph import connected_components


def meta(html: Column, name: str) -> Column:
    """Content of a meta element by name or property, attributes in either order."""
    key = rf"(?:name|property)=[\"']{name}[\"']"
    a = F.regexp_extract(html, rf"(?i)<meta[^>]*{key}[^>]*content=[\"']([^\"']*)[\"']", 1)
    b = F.regexp_extract(html, rf"(?i)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*{key}", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def faq(html: Column) -> Column:
    """Questions and answers of the first FAQPage in the page's JSON-LD."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    page = F.try_element_at(F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']") == "FAQPage"), F.lit(1))
    parsed = F.from_json(page, "mainEntity array<struct<name:string,acceptedAnswer:struct<text:string>>>")
    return F.transform(parsed["mainEntity"], lambda q: F.struct(q["name"].alias("question"), q["acceptedAnswer"]["text"].alias("answer")))


def element_by_class(html: Column, name: str) -> Column:
    """Inside of the first div with a class, by counting nested divs."""
    at = F.regexp_instr(html, F.lit(rf"(?i)<div[^>]*class=[\"'][^\"']*\b{name}\b"))
    rest = F.when(at > 0, F.substring(html, at, F.length(html)))
    pieces = F.split(rest, r"(?i)(?=<div\b)|(?<=</div>)")
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("s"))

    def step(a: Column, p: Column) -> Column:
        depth = a["depth"] + F.regexp_count(p, F.lit(r"(?i)<div\b")) - F.regexp_count(p, F.lit("(?i)</div>"))
        return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (depth <= 0).alias("done"), F.concat(a["s"], p).alias("s")))

    whole = F.aggregate(pieces, state, step)["s"]
    return F.regexp_replace(F.regexp_replace(whole, r"(?is)^<div[^>]*>", ""), r"(?is)</div>\s*$", "")


def alternate_groups(links: DataFrame) -> DataFrame:
    """page, root: connected components of alternate links (a, b); root is the smallest page. A page that only links itself is its own."""
    joined = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    pages = links.select(F.col("a").alias("page")).unionByName(links.select(F.col("b").alias("page"))).filter("page IS NOT NULL").distinct()
    return pages.join(joined, F.col("page") == F.col("node"), "left").select("page", F.coalesce("root", "page").alias("root"))


def keywords(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda k: F.lower(F.trim(k))), lambda k: k != "")


def breadcrumbs(url: Column) -> Column:
    """The path of an address as JSON: a list of name and position."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[a-z]+://[^/]*/([^?#]*)", 1), "/"), lambda p: p != "")
    return F.to_json(F.transform(parts, lambda p, i: F.struct((i + 1).alias("position"), p.alias("name"))))


def same_files(files: DataFrame) -> DataFrame:
    """Files of the same name and size once."""
    return files.groupBy("name", "size").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
