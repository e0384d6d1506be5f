"""Catalogue feeds, stored API responses and sitemaps held as text columns."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import blank_to_null, col, resolve_url, strip
from shelfspark.session import cut_lineage

TITLE_KEYS = ("name", "title", "productName", "product_name")
PRICE_KEYS = ("price", "salePrice", "sale_price", "currentPrice", "current_price")
PRICE_PARTS = ("value", "amount", "current", "price")


# -- variants ---------------------------------------------------------------

def at(node, name: str) -> Column:
    return F.try_variant_get(col(node), f"$['{name}']", "variant")


def text_of(node: Column) -> Column:
    """Text of a value; nested values give their JSON text, null and '' give null."""
    return blank_to_null(F.try_variant_get(node, "$", "string"))


def text_at(node, name: str) -> Column:
    return blank_to_null(F.try_variant_get(col(node), f"$['{name}']", "string"))


def fields_of(node) -> Column:
    """Members of an object as MAP<STRING, VARIANT>; null for anything else."""
    return F.try_variant_get(col(node), "$", "map<string,variant>")


def items_of(node) -> Column:
    """Elements of a list as ARRAY<VARIANT>; null for anything else."""
    return F.try_variant_get(col(node), "$", "array<variant>")


def scalar_type(node) -> Column:
    """STRING, BOOLEAN or a number type; meant for values known not to be nested."""
    return F.substring_index(F.schema_of_variant(col(node)), "(", 1)


def pick(fields, *names: str) -> Column:
    """First named member that is neither null nor ''; 0 and false count as values."""
    found = F.transform(F.array(*map(F.lit, names)), lambda n: F.try_element_at(col(fields), n))
    return F.try_element_at(F.filter(found, lambda v: text_of(v).isNotNull()), F.lit(1))


def pick_text(fields, *names: str) -> Column:
    return text_of(pick(fields, *names))


def unwrap(value: Column, *names: str) -> Column:
    """Text of a scalar, or of the first named part of an object."""
    parts = fields_of(value)
    return F.when(parts.isNotNull(), pick_text(parts, *names)).otherwise(text_of(value))


def walk_json(df: DataFrame, keys: Sequence[str], node: str) -> DataFrame:
    """Every object at any depth: keys, node, fields, and its position path (pre-order sort key).

    One pass over the documents: each round replaces an unopened value by itself
    and its nested children.  Rounds stop when nothing is left to open; the only
    fact that reaches the driver is "is there more".
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(node).alias("node"), F.array().cast("array<int>").alias("path"), F.lit(True).alias("open"))
    rows = rows.filter(fields_of("node").isNotNull() | items_of("node").isNotNull())

    def cell(value, path, is_open):
        return F.struct(value.alias("node"), path.alias("path"), F.lit(is_open).alias("open"))

    path = F.col("path")
    own = F.array(cell(F.col("node"), path, False))
    values = F.coalesce(items_of("node"), F.map_values(fields_of("node")))
    children = F.filter(
        F.transform(values, lambda v, i: cell(v, F.concat(path, F.array(i)), True)),
        lambda c: fields_of(c["node"]).isNotNull() | items_of(c["node"]).isNotNull())
    while True:
        rows = rows.select(*keys, F.explode(F.when(F.col("open"), F.concat(own, children)).otherwise(own)).alias("c")).select(*keys, "c.*")
        if rows.filter("open").isEmpty():
            break
    return rows.select(*keys, "node", "path", fields_of("node").alias("fields")).filter(F.col("fields").isNotNull())


def looks_like_product(fields="fields") -> Column:
    return pick(fields, *TITLE_KEYS).isNotNull() & unwrap(pick(fields, *PRICE_KEYS), *PRICE_PARTS).isNotNull()


def explode_json_objects(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Product-like objects of a JSON text column."""
    parsed = df.select(*keys, F.try_parse_json(column).alias("_doc"))
    return walk_json(parsed, keys, "_doc").filter(looks_like_product())


# -- xml and csv documents ----------------------------------------------------

_RECORDS = pa.list_(pa.map_(pa.string(), pa.string()))


# Elements that stand for one record of a product feed; fixed values.
_ROW_TAGS = ("offer", "product", "item", "entry")


class _Rows:
    """XML parser target: collects the attributes and the texts of direct children of every record element."""

    def __init__(self):
        self.rows, self.open = [], []

    def start(self, tag, attributes):
        record = None
        if tag.rpartition("}")[2].lower() in _ROW_TAGS:
            record = dict(attributes)
            self.rows.append(record)
        if self.open:
            self.open[-1]["leading"] = False
        self.open.append({"record": record, "text": [], "leading": True})

    def data(self, text):
        # An element's text ends at its first child element.
        if self.open and self.open[-1]["leading"]:
            self.open[-1]["text"].append(text)

    def end(self, tag):
        text = "".join(self.open.pop()["text"]).strip()
        if text and self.open and self.open[-1]["record"] is not None:
            self.open[-1]["record"][tag.rpartition("}")[2]] = text

    def close(self):
        return [list(r.items()) for r in self.rows]


def _xml_records(body):
    parser = ElementTree.XMLParser(target=_Rows())
    try:
        parser.feed(body)
        return parser.close()
    except (ElementTree.ParseError, ValueError):
        return []


def _csv_records(body):
    try:
        return [[(k, v) for k, v in row.items() if isinstance(k, str) and isinstance(v, (str, type(None)))]
                for row in csv.DictReader(io.StringIO(body))]
    except csv.Error:
        return []


def _records_udf(reader):
    @F.arrow_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    def records(bodies: pa.Array) -> pa.Array:
        return pa.array([None if b is None else reader(b) for b in bodies.to_pylist()], type=_RECORDS)
    return records


_xml_udf, _csv_udf = _records_udf(_xml_records), _records_udf(_csv_records)


def _explode_records(df, keys, column, reader) -> DataFrame:
    return df.select(*keys, F.posexplode(reader(F.col(column))).alias("pos", "record"))


def explode_xml_offers(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """offer / product / item / entry elements at any depth, any case, any namespace."""
    return _explode_records(df, keys, column, _xml_udf)


def explode_csv(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return _explode_records(df, keys, column, _csv_udf)


def read_xml_files(spark, path: str, tags=("offer", "product", "item", "entry")) -> DataFrame:
    """Large single feeds: split by row tag inside the scan instead of one document per row."""
    parts = [spark.read.format("xml").option("rowTag", tag).load(path).select(F.to_json(F.struct("*")).alias("json")) for tag in tags]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.select(F.from_json("json", "map<string,string>").alias("record"))


def read_csv_files(spark, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`"))]
    return rows.select(F.create_map(*names).alias("record"))


def feed_kind(body="body", content_type="content_type") -> Column:
    head = F.regexp_replace(col(body), r"^[\s\p{Z}]+", "")
    is_json = F.lower(F.coalesce(col(content_type), F.lit(""))).contains("json") | head.rlike(r"^[{\[]")
    return F.when(is_json, "json").when(head.startswith("<"), "xml").otherwise("csv")


def read_feed(df: DataFrame, keys: Sequence[str], body: str = "body", content_type: str = "content_type") -> DataFrame:
    """Records of mixed feed documents: keys, position path, record MAP<STRING, STRING>."""
    kind = df.withColumn("_kind", feed_kind(body, content_type))
    docs = kind.filter("_kind = 'json'").select(*keys, F.try_parse_json(body).alias("_doc"))
    as_map = F.map_from_entries(F.transform(
        F.map_entries("fields"),
        lambda e: F.struct(e["key"], F.try_variant_get(e["value"], "$", "string").alias("value"))))
    from_json = walk_json(docs, keys, "_doc").select(*keys, "path", as_map.alias("record"))
    flat = lambda rows: rows.select(*keys, F.array("pos").alias("path"), "record")
    from_xml = flat(explode_xml_offers(kind.filter("_kind = 'xml'"), keys, body))
    from_csv = flat(explode_csv(kind.filter("_kind = 'csv'"), keys, body))
    return from_json.unionByName(from_xml).unionByName(from_csv)


# -- sitemaps -------------------------------------------------------------------

_LOC = r"(?s)<(?:\w+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?loc>"
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#38;": "&", "&amp;": "&"}


def sitemap_kind(body) -> Column:
    """index, urls or null, by the document's root element."""
    root = F.regexp_extract(col(body), r"(?s)^[^<]*(?:<[?!][^>]*>\s*)*<(?:\w+:)?(\w+)", 1)
    return F.when(root == "sitemapindex", "index").when(root == "urlset", "urls")


def sitemap_locs(body) -> Column:
    """Addresses that a sitemap names, in document order."""
    def plain(loc: Column) -> Column:
        for entity, letter in _ENTITIES.items():
            loc = F.replace(loc, F.lit(entity), F.lit(letter))
        return strip(loc)

    uncommented = F.regexp_replace(col(body), r"(?s)<!--.*?-->", "")
    return F.filter(F.transform(F.regexp_extract_all(uncommented, F.lit(_LOC), F.lit(1)), plain), lambda x: x != "")


def explode_sitemaps(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct page urls reachable from seed sitemaps; ``docs`` holds (url, body) of stored documents."""
    parsed = docs.select("url", "body", sitemap_kind("body").alias("kind")).filter(F.col("kind").isNotNull())
    links = cut_lineage(parsed.select("url", "kind", F.explode(sitemap_locs("body")).alias("loc")))
    children = links.filter("kind = 'index'").select("url", F.col("loc").alias("child"))
    visited = cut_lineage(seeds.select("url").distinct())
    frontier = visited
    while True:
        step = children.join(frontier, "url").select(F.col("child").alias("url")).distinct()
        frontier = cut_lineage(step.join(visited, "url", "left_anti"))
        if frontier.isEmpty():
            break
        visited = cut_lineage(visited.union(frontier))
    return links.filter("kind = 'urls'").join(visited, "url", "left_semi").select(F.col("loc").alias("url")).distinct()


# -- paged API responses --------------------------------------------------------

_NEXT = ("next", "nextUrl", "next_url", "nextPage", "next_page")
_NEXT_HOLDERS = ("links", "pagination", "paging", "meta")


def with_next_page(docs: DataFrame, fields: str, name: str) -> DataFrame:
    """Add the address of the following page as a response names it (it may be relative).

    Each step is a column of its own: what a step names several times would else be computed as often.
    """
    kept, at = docs.columns, range(len(_NEXT_HOLDERS))
    holders = {f"_h{i}": fields_of(F.try_element_at(F.col(fields), F.lit(h))) for i, h in enumerate(_NEXT_HOLDERS)}
    rows = docs.withColumns({"_v": pick(F.col(fields), *_NEXT), **holders})
    rows = rows.withColumns({f"_v{i}": F.when(F.col(f"_h{i}").isNotNull(), pick(F.col(f"_h{i}"), *_NEXT)) for i in at})
    rows = rows.withColumns({f"_f{i}": fields_of(f"_v{i}") for i in at})
    links = [F.col("_v"), *[F.when(F.col(f"_f{i}").isNotNull(), pick(F.col(f"_f{i}"), "url", "href")).otherwise(F.col(f"_v{i}")) for i in at]]
    rows = rows.withColumns({f"_l{i}": link for i, link in enumerate(links)})
    rows = rows.withColumns({f"_t{i}": F.when(scalar_type(f"_l{i}") == "STRING", strip(text_of(F.col(f"_l{i}")))) for i in range(len(links))})
    return rows.select(*kept, F.coalesce(*[blank_to_null(f"_t{i}") for i in range(len(links))]).alias(name))


def follow_pages(docs: DataFrame, endpoints: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(endpoint, depth, url) of stored response chains; a page is taken once per endpoint.

    Without ``max_pages`` a chain is followed to its end; with it the rows also say, as
    ``cap_reached``, whether their chain went on.
    """
    # Parsing costs much per row: answers are dealt over all cores, however few files or ranges they come from.
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    parsed = docs.repartition(tasks).select("url", F.try_parse_json("body").alias("_doc")).filter(F.col("_doc").isNotNull())
    named = with_next_page(parsed.select("url", fields_of("_doc").alias("_fields")), "_fields", "_next")
    follows = cut_lineage(named.select("url", resolve_url("url", "_next").alias("next")))
    # jump leads ``length`` pages on; doubling it covers the whole chain in a few joins.
    jump, length = follows.filter(F.col("next").isNotNull()), 1
    seen = endpoints.select("endpoint").distinct().select("endpoint", F.lit(1).alias("depth"), F.col("endpoint").alias("url"))
    reached = seen.count()
    # Chains that end leave no jump behind; only circles go on until nothing new is seen.
    while (max_pages is None or length <= max_pages) and not jump.isEmpty():
        further = seen.join(jump, "url").select("endpoint", (F.col("depth") + length).alias("depth"), F.col("next").alias("url"))
        # A chain that runs in a circle meets its pages again; the first visit counts.
        longer = cut_lineage(seen.unionByName(further).groupBy("endpoint", "url").agg(F.min("depth").alias("depth")))
        before, reached = reached, longer.count()
        if reached == before:
            break
        seen = longer
        jump = cut_lineage(jump.join(jump.select(F.col("url").alias("next"), F.col("next").alias("_far")), "next")
                           .select("url", F.col("_far").alias("next")))
        length *= 2
    found = seen.join(follows.select("url"), "url", "left_semi").select("endpoint", "depth", "url")
    if max_pages is None:
        return found
    over = found.groupBy("endpoint").agg((F.max("depth") > max_pages).alias("cap_reached"))
    return found.filter(F.col("depth") <= max_pages).join(over, "endpoint")
