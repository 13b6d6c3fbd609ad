"""Trees for books without outlines: candidates from contents and headings, nesting, validation, and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import contents, trees
from quire.workspace import Workspace


def colon_leaders(text: Column) -> Column:
    """Dot leaders of contents lines as a colon."""
    return F.regexp_replace(text, r"\.{5,}", ": ")


def valid_items(items: DataFrame) -> DataFrame:
    """Items with a page: neither missing nor 0."""
    return items.filter(F.coalesce("physical_index", F.lit(0)) != 0)


def from_contents(pages: DataFrame) -> DataFrame:
    """(book, ord, title, start_index): the cheap way, printed contents with the book's page offset."""
    entries = contents.contents_entries(pages).join(contents.offset_by_contents(pages), "book")
    return entries.select("book", F.col("pos").alias("ord"), "title", (F.col("printed") + F.col("offset")).cast("int").alias("start_index"))


def from_headings(pages: DataFrame) -> DataFrame:
    """(book, ord, title, start_index): the second way, chapter markers in the text."""
    found = contents.chapters(pages)
    return found.select("book", F.expr("try_cast(number AS INT)").alias("ord"), "title", F.col("page_no").alias("start_index"))


def as_nodes(items: DataFrame, last: DataFrame) -> DataFrame:
    """Flat items as numbered top nodes with ends."""
    coded = items.withColumn("structure", F.col("ord").cast("string"))
    ended = trees.sibling_ends(coded, last).withColumn("path", F.array(F.col("ord").cast("int")))
    return trees.number_nodes(ended, ["path"]).withColumn("is_leaf", F.lit(True))


def choose(pages: DataFrame, cached: DataFrame | None = None, escalate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results, nodes): a tree for every book by the first way that passes validation.

    results: book, status (cached_ok, ok, failed), mode, reasons of the last way that was
    tried; nodes: the chosen trees. cached: (book, ok) of trees that are there already.
    """
    pages = Workspace(pages.sparkSession, "pages").write(pages.select("book", "page_no", "text"), "pages")  # read by every way, several times
    totals = pages.groupBy("book").agg(F.count(F.lit(1)).alias("n_pages"), F.max("page_no").cast("int").alias("last_page"))
    last = totals.select("book", "last_page")
    done = totals.select("book", F.lit(False).alias("_cached"))
    if cached is not None:
        done = totals.select("book").join(cached.filter("ok").select("book", F.lit(True).alias("_cached")), "book", "left").na.fill(False)
    ways = {"flash": from_contents} | ({"manual": from_headings} if escalate else {})
    trees_of = {mode: as_nodes(way(pages), last) for mode, way in ways.items()}
    results = done
    for mode, nodes in trees_of.items():
        checked = trees.validate(nodes, totals.select("book", "n_pages"))
        results = results.join(checked.select("book", F.col("ok").alias(f"_{mode}"), F.col("reasons").alias(f"_why_{mode}")), "book", "left")
    mode = F.when(F.col("_cached"), None)
    for name in ways:
        mode = mode.when(F.col(f"_{name}"), name)
    passed = F.col("_cached") | mode.isNotNull()
    last_why = F.col(f"_why_{list(ways)[-1]}")
    results = results.select(
        "book", F.when(F.col("_cached"), "cached_ok").when(passed, "ok").otherwise("failed").alias("status"), mode.alias("mode"), F.when(~passed, last_why).otherwise("").alias("reasons")
    )
    chosen = None
    for name, nodes in trees_of.items():
        own = nodes.join(results.filter(F.col("mode") == name).select("book"), "book", "left_semi").withColumn("toc_source", F.lit(name))
        chosen = own if chosen is None else chosen.unionByName(own, allowMissingColumns=True)
    return results, chosen


def summary(results: DataFrame) -> DataFrame:
    """(status, mode, n): how many books ended how."""
    return results.groupBy("status", "mode").agg(F.count(F.lit(1)).alias("n"))


def nested(nodes: DataFrame, source: str = "manual") -> DataFrame:
    """(doc, tree): trees as JSON, built from the deepest level up. nodes: book, structure, title, node_id, start_index, end_index; summary may be there."""
    summed = nodes.withColumn("summary", F.coalesce("summary", F.lit(""))) if "summary" in nodes.columns else nodes.withColumn("summary", F.lit(""))
    own = F.to_json(F.struct("title", "node_id", "start_index", "end_index", "summary"))
    level = summed.select("book", "structure", trees.parent_code(F.col("structure")).alias("parent"), F.size(F.split("structure", r"\.")).alias("depth"), F.transform(F.split("structure", r"\."), lambda x: x.cast("int")).alias("path"), own.alias("json"))
    depths = level.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(depths, 0, -1):
        rows = level.filter(F.col("depth") == depth)
        if below is not None:
            rows = rows.join(below, (rows["book"] == below["_b"]) & (rows["structure"] == below["_p"]), "left").drop("_b", "_p")
            inner = F.concat(F.expr("left(json, length(json) - 1)"), F.lit(',"nodes":['), F.col("children"), F.lit("]}"))
            rows = rows.withColumn("json", F.when(F.col("children").isNotNull(), inner).otherwise(F.col("json"))).drop("children")
        inside = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "json"))), lambda x: x["json"]), ",")
        below = rows.groupBy(F.col("book").alias("_b"), F.col("parent").alias("_p")).agg(inside.alias("children"))
    if below is None:
        return nodes.sparkSession.createDataFrame([], "doc string, tree string")
    head = F.to_json(F.struct(F.col("_b").alias("doc_name"), F.lit(source).alias("toc_source")))
    open_ = below.select(F.col("_b").alias("doc"), head.alias("head"), "children")
    return open_.select("doc", F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"structure":['), "children", F.lit("]}")).alias("tree"))


def first_found(*places: DataFrame) -> DataFrame:
    """(name, path, place): of each name the file in the first place that has it. places: name, path."""
    every = places[0].select("name", "path", F.lit(0).alias("place"))
    for i, p in enumerate(places[1:], 1):
        every = every.unionByName(p.select("name", "path", F.lit(i).alias("place")))
    best = every.groupBy("name").agg(F.min(F.struct("place", "path")).alias("f"))
    return best.select("name", F.col("f.path").alias("path"), F.col("f.place").alias("place"))


def totals(pages: DataFrame) -> DataFrame:
    """(book, n_pages, n_tokens) of documents."""
    return pages.groupBy("book").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_tokens").alias("n_tokens"))


def inferred_structure(pages: DataFrame, groups: DataFrame, infer) -> list[dict]:
    """Items of a book without contents: its page groups in order, each together with what was found before.

    infer(text, items so far) gives more items; as each step builds on the last, groups go one by one.
    """
    tagged = F.concat(F.lit("<physical_index_"), F.col("page_no").cast("string"), F.lit(">\n"), F.col("text"), F.lit("\n<physical_index_"), F.col("page_no").cast("string"), F.lit(">"))
    parts = F.sort_array(F.collect_list(F.struct("page_no", tagged.alias("text"))))
    each = pages.join(groups, ["book", "page_no"]).groupBy("group_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    found: list[dict] = []
    for row in each.orderBy("group_no").toLocalIterator():  # one group of bounded size at a time
        found += infer(row["text"], found)
    return found
