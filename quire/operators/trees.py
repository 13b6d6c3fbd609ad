"""Contents pages, page offsets and section trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import bare_header, is_upper_header, lines


def contents_runs(pages: DataFrame, hit: str = "hit") -> DataFrame:
    """The longest run of at least two consecutive hit pages of each book; the first on a tie."""
    order = W.partitionBy("book").orderBy("page_no")
    hits = pages.filter(F.col(hit)).withColumn("island", F.col("page_no") - F.row_number().over(order))
    runs = hits.groupBy("book", "island").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count(F.lit(1)).alias("n_pages"))
    rank = F.row_number().over(W.partitionBy("book").orderBy(F.desc("n_pages"), "first_page"))
    return runs.filter("n_pages >= 2").withColumn("rank", rank).filter("rank = 1").drop("rank", "island")


def upper_headers(pages: DataFrame) -> DataFrame:
    """Upper-case headers among the first three filled lines, at their first page."""
    filled = F.slice(F.filter(lines(F.col("text")), lambda x: F.btrim(x) != ""), 1, 3)
    each = pages.select("book", "page_no", F.posexplode(filled).alias("pos", "line")).withColumn("header", bare_header(F.col("line")))
    return each.filter(is_upper_header(F.col("header"))).groupBy("book", "header").agg(F.min("page_no").alias("page_no"))


def change_points(pages: DataFrame, value: str) -> DataFrame:
    """Pages on which a running value differs from the page before."""
    before = F.lag(value).over(W.partitionBy("book").orderBy("page_no"))
    return pages.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """The middle of the sorted values, the upper one of two, for each book."""
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("book").orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("book")))
    return ranked.filter("_r = _n div 2").select("book", F.col(value).alias("offset"))


def mode_first(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The commonest value of each book; the one met first on a tie. A book all of whose values are null gets 0."""
    counts = rows.groupBy("book", value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    rank = F.row_number().over(W.partitionBy("book").orderBy(F.desc("n"), "_first"))
    return counts.withColumn("_r", rank).filter("_r = 1").select("book", F.col(value).alias("offset"), "n")


def locate_titles(titles: DataFrame, pages: DataFrame, back: int = 5, ahead: int = 6, head: int = 25) -> DataFrame:
    """The first page near a printed number on which a title's beginning occurs: a band, turned into an equi join."""
    near = titles.withColumn("page_no", F.explode(F.sequence(F.col("page") - back, F.col("page") + ahead)))
    text = pages.select("book", "page_no", F.lower("text").alias("_text"))
    found = near.join(text, ["book", "page_no"]).filter(F.col("_text").contains(F.lower(F.substring("title", 1, head))))
    return found.groupBy("book", "ord", "page").agg(F.min("page_no").alias("found_page")).withColumn("diff", F.col("found_page") - F.col("page"))


def flat_ends(items: DataFrame, last: DataFrame) -> DataFrame:
    """End pages of a flat list: the next start, less one if the next title starts its page. Not clamped."""
    order = W.partitionBy("book").orderBy("ord")
    ends = items.withColumn("_next", F.lead("physical_index").over(order)).withColumn("_yes", F.lead("appear_start").over(order))
    end = F.when(F.col("_next").isNull(), F.col("last_page")).otherwise(F.col("_next") - F.when(F.col("_yes") == "yes", 1).otherwise(0))
    return ends.join(last, "book").withColumn("end_index", end.cast("int")).drop("_next", "_yes", "last_page")


def prefix_parents(items: DataFrame) -> DataFrame:
    """The parent by dotted code: the latest earlier item with the code one level up; none makes a root."""
    up = F.when(F.col("structure").contains("."), F.regexp_replace("structure", r"\.[^.]*$", ""))
    child = items.select("book", "ord", "structure", up.alias("up"))
    above = items.select(F.col("book").alias("_b"), F.col("ord").alias("_o"), F.col("structure").alias("_s"))
    joined = child.join(above, (F.col("book") == F.col("_b")) & (F.col("up") == F.col("_s")) & (F.col("_o") < F.col("ord")), "left")
    return joined.groupBy("book", "ord", "structure").agg(F.max("_o").alias("parent_ord"))


def parent_code(code: Column) -> Column:
    """A dotted code without its last part; empty at the top."""
    return F.when(code.contains("."), F.regexp_replace(code, r"\.[^.]*$", "")).otherwise("")


def sibling_ends(nodes: DataFrame, last: DataFrame) -> DataFrame:
    """Ends within siblings: max(start, next start - 1); the last sibling ends with its parent, at the top with the book (last: book, last_page).

    Ends are handed down depth by depth, a join each. A missing start is page 1; a missing
    next start counts as the parent's end. A node whose parent is not there ends like one at the top.
    """
    start = F.coalesce("start_index", F.lit(1)).cast("int")
    after = F.lead(F.struct("start_index")).over(W.partitionBy("book", "parent").orderBy("ord"))
    level = nodes.withColumn("parent", parent_code(F.col("structure"))).withColumn("_after", after).withColumn("start_index", start).withColumn("depth", F.size(F.split("structure", r"\.")))
    depths = nodes.agg(F.max(F.size(F.split("structure", r"\.")))).first()[0] or 0
    done, above = None, None
    for depth in range(1, depths + 1):
        own = level.filter(F.col("depth") == depth).join(last.select("book", "last_page"), "book")
        if above is None:
            own = own.withColumn("_limit", F.col("last_page"))
        else:
            given = above.select("book", F.col("structure").alias("parent"), F.col("end_index").alias("_given"))
            own = own.join(given, ["book", "parent"], "left").withColumn("_limit", F.coalesce("_given", "last_page")).drop("_given")
        following = F.when(F.col("_after").isNull(), F.col("_limit")).otherwise(F.coalesce(F.col("_after")["start_index"], F.col("_limit")) - 1)
        above = own.withColumn("end_index", F.greatest("start_index", following).cast("int")).drop("_after", "_limit", "last_page")
        done = above if done is None else done.unionByName(above)
    return done if done is not None else level.drop("_after").withColumn("end_index", F.lit(None).cast("int"))


def with_leaves(nodes: DataFrame) -> DataFrame:
    """nodes with is_leaf: no node has its code as parent."""
    parents = nodes.select(F.col("book").alias("_b"), F.col("parent").alias("_p")).distinct().withColumn("_inner", F.lit(True))
    joined = nodes.join(parents, (F.col("book") == F.col("_b")) & (F.col("structure") == F.col("_p")), "left")
    return joined.withColumn("is_leaf", F.col("_inner").isNull()).drop("_b", "_p", "_inner")


def number_nodes(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Ids of at least four digits in an order of a book's nodes (by path: depth first; by depth and path: level by level)."""
    place = F.row_number().over(W.partitionBy("book").orderBy(*order))
    return nodes.withColumn("node_id", F.format_string("%04d", place))


#: The least number of top nodes, the widest leaf in pages and as a part of a book, the least part of a book that a tree covers.
TOP_NODES, LEAF_PAGES, LEAF_SHARE, COVERAGE = 3, 150, 0.15, 0.85


def validate(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """(book, ok, reasons): nodes (book, depth, title, start_index, end_index, is_leaf), totals (book, n_pages).

    A book of either side gets a row: one without nodes has an empty structure, one without
    a page count is not checked against it. Nodes without a start or end have no span.
    """
    length = F.col("end_index") - F.col("start_index") + 1
    top = F.col("depth") == 1
    limit = F.greatest(F.lit(LEAF_PAGES), F.coalesce(F.floor(F.col("n_pages") * LEAF_SHARE), F.lit(0)))
    m = nodes.join(totals, "book", "left").groupBy("book").agg(
        F.count_if(top).alias("top"), F.count_if(F.btrim(F.coalesce("title", F.lit(""))) == "").alias("untitled"),
        F.count_if(length < 1).alias("reversed"), F.count_if(F.col("is_leaf") & (length > limit)).alias("wide"),
        (F.max(F.when(top & length.isNotNull(), F.col("end_index"))) - F.min(F.when(top & length.isNotNull(), F.col("start_index"))) + 1).alias("covered"),
    )
    joined = m.join(totals, "book", "full").withColumn("top", F.coalesce("top", F.lit(0)))
    rules = [
        ("few_top_nodes", F.col("top") < TOP_NODES), ("empty_titles", F.col("untitled") > 0), ("no_page_count", F.col("n_pages").isNull()),
        ("reversed_span", F.col("reversed") > 0), ("wide_leaf", F.col("wide") > 0), ("low_coverage", F.col("covered") / F.col("n_pages") < COVERAGE),
    ]
    found = F.concat_ws(";", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])))
    return joined.withColumn("reasons", F.when(F.col("top") == 0, "empty_structure").otherwise(found)).select("book", (F.col("reasons") == "").alias("ok"), "reasons")


def flatten_trees(spark: SparkSession, trees: DataFrame) -> DataFrame:
    """Nested JSON trees (doc, tree) to rows: breadcrumb, depth, path of positions, pages.

    The walk lifts Spark's bounds of 100 levels (MAX RECURSION LEVEL) and a million rows (LIMIT ALL);
    parse_json still bounds the nesting and size of one tree.
    """
    trees.createOrReplaceTempView("_trees")
    return spark.sql(
        """
        WITH RECURSIVE root AS (
          SELECT doc, parse_json(tree) AS v FROM _trees),
        walk MAX RECURSION LEVEL 1000000 AS (
          SELECT doc, n.value AS v, 1 AS depth, array(CAST(n.pos AS INT)) AS path, CAST(try_variant_get(n.value, '$.title', 'string') AS STRING) AS crumb
          FROM root, LATERAL variant_explode(coalesce(try_variant_get(v, '$.structure', 'variant'), try_variant_get(v, '$.nodes', 'variant'), v)) n
          UNION ALL
          SELECT w.doc, n.value, w.depth + 1, array_append(w.path, CAST(n.pos AS INT)), concat(w.crumb, ' > ', try_variant_get(n.value, '$.title', 'string'))
          FROM walk w, LATERAL variant_explode(try_variant_get(w.v, '$.nodes', 'variant')) n)
        SELECT doc, depth, path, crumb, try_variant_get(v, '$.title', 'string') AS title, try_variant_get(v, '$.node_id', 'string') AS node_id,
               try_variant_get(v, '$.start_index', 'int') AS start_index, try_variant_get(v, '$.end_index', 'int') AS end_index
        FROM walk LIMIT ALL"""
    )


def climb(nodes: DataFrame, least: int = 2) -> DataFrame:
    """For each node the nearest of itself and its ancestors that spans enough pages (nodes: doc, path, start_index, end_index)."""
    wide = nodes.filter(F.col("end_index") - F.col("start_index") + 1 >= least).select(F.col("doc").alias("_d"), F.col("path").alias("_p"))
    ups = nodes.select("doc", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("_up"))
    found = ups.join(wide, (F.col("doc") == F.col("_d")) & (F.col("_up") == F.col("_p"))).groupBy("doc", "path").agg(F.max_by("_up", F.size("_up")).alias("climbed"))
    return nodes.select("doc", "path").join(found, ["doc", "path"], "left")


def range_text(spans: DataFrame, pages: DataFrame, most: int = 4) -> DataFrame:
    """Text of the first pages of each span (span_id, book, start_index, end_index), in order."""
    each = spans.withColumn("page_no", F.explode(F.sequence("start_index", F.greatest(F.col("start_index"), F.least(F.col("end_index"), F.col("start_index") + most - 1)))))
    got = each.join(pages.select("book", "page_no", "text"), ["book", "page_no"])
    parts = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    return got.groupBy("span_id", "book").agg(F.concat_ws("\n", F.transform(parts, lambda p: p["text"])).alias("text"))
