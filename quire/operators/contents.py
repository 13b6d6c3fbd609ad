"""Printed contents: chapter markers, divisions, contents entries, page offsets, outlines, and checks of a found list.

A page is (book, page_no, text). Every operator is a projection of pages, or groups a
book's few hits; texts are only shuffled for the pages of a contents run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import heading_valid, lines, roman, squeeze, strip
from quire.operators.running import latest
from quire.operators.substrings import first_holding
from quire.operators.trees import contents_runs, upper_median
from quire.workspace import Workspace, bounded_broadcast

#: The patterns that mark chapters, divisions, contents lines and outlines, and the pages among which contents are sought.
CHAPTER = r"CHAPTER\s+(\d+)\b"
DIVISION = {"PART": (r"(?i)PART\s+(\d+|[IVX]+)\s*:?\s*([^\r\n]{1,60})", 45), "SECTION": (r"(?i)SECTION\s+([IVX]+|\d+)\s*:?\s*([^\r\n]{1,60})", 55)}
FIRST_PAGES = 45
NUMBERED = r"[\s.]+\d{1,4}\s*$"
ENTRY = r"(?imd)^(?:Chapter\s+\d+|Part\s+[IVX\d]+|\d+[\.\)]?)\s+([A-Z][^\r\n]{2,60}?)[\.\s]+(\d{1,4})\s*$"
OUTLINE_PAGE = r"(?i)\bCHAPTER\s+OUTLINE\b|\bCHAPTER\s*([0-9IVXLCDM]+)\b"
OUTLINE_LINE = r"^\s*([IVXLCDM]+|\d+(?:\.\d+)*)[\).]?\s+(.+?)[,;.]?\s+(\d{1,4})$"
TITLE_END = r"^[\x{25a0}\x{25b2}\x{25c6}\x{2022}*]|(?i:\bOUTLINE\b)|^(CHAPTER|PART|SECTION)\s+"


def filled_lines(text: Column) -> Column:
    """Lines of a text without white space at their ends; blank ones left out."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def title_after(text: Column, ahead: int = 200) -> Column:
    """The title that a chapter's marker is followed by: its first filled lines, up to a blank, a bullet, an outline or a division; else null."""
    each = F.transform(lines(F.substring(text, 1, ahead)), strip)
    first = F.array_position(F.transform(each, lambda x: x != ""), True)
    rest = F.slice(each, F.greatest(first, F.lit(1)).cast("int"), F.size(each))
    stop = F.array_position(F.transform(rest, lambda x: (x == "") | x.rlike(TITLE_END)), True)
    title = F.array_join(F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest), " ")
    return F.when((first > 0) & (F.length(title) <= 120) & title.rlike(r"^\p{Lu}"), title)


def chapters(pages: DataFrame) -> DataFrame:
    """(book, number, page_no, title): chapters by their upper-case marker; the first titled one of a number counts."""
    pieces = F.split("text", f"(?={CHAPTER})")
    before = F.transform(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)))
    cut = pages.filter(F.col("text").rlike(CHAPTER)).select("book", "page_no", "text", pieces.alias("pieces")).select("book", "page_no", "text", F.posexplode(before).alias("pos", "start"))
    tail = F.substring(F.col("text"), F.col("start") + 1, F.lit(400))
    marker = F.regexp_extract(tail, "^" + CHAPTER, 0)
    found = cut.select(
        "book", "page_no", "pos", F.regexp_extract(tail, "^" + CHAPTER, 1).alias("number"), title_after(F.substring(tail, F.length(marker) + 1, F.lit(200))).alias("title")
    ).filter("number <> '' AND title IS NOT NULL")
    first = F.min(F.struct("page_no", "pos", "title")).alias("f")
    return found.groupBy("book", "number").agg(first).select("book", "number", F.col("f.page_no").alias("page_no"), F.col("f.title").alias("title"))


def divisions(pages: DataFrame, kinds: tuple[str, ...] = ("PART", "SECTION")) -> DataFrame:
    """(book, label, page_no): parts and sections with a valid title and a short label, at their first page."""
    found = None
    for kind in kinds:
        pattern, most = DIVISION[kind]
        pairs = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(c) for g, c in ((1, "n"), (2, "t"))])
        each = pages.select("book", "page_no", F.explode(pairs).alias("d")).filter(heading_valid(strip(F.col("d.t"))))
        label = strip(F.concat(F.lit(kind + " "), F.col("d.n"), F.lit(" "), F.col("d.t")))
        part = each.select("book", "page_no", label.alias("label")).filter(F.length("label") <= most)
        found = part if found is None else found.union(part)
    return found.groupBy("book", "label").agg(F.min("page_no").alias("page_no"))


def contents_hits(pages: DataFrame, first_pages: int = FIRST_PAGES, least: int = 5) -> DataFrame:
    """Pages with hit: whether a page within the first ones has enough lines that end in a page number."""
    many = F.size(F.filter(filled_lines(F.col("text")), lambda x: x.rlike(NUMBERED))) >= least
    return pages.filter(F.col("page_no") <= first_pages).withColumn("hit", many)


def contents_text(pages: DataFrame) -> DataFrame:
    """(book, first_page, text) of the longest contents run; at most the first 45 pages of a book are grouped."""
    runs = contents_runs(contents_hits(pages)).select("book", "first_page", "last_page")
    inside = pages.filter(F.col("page_no") <= FIRST_PAGES).join(runs, "book").filter("page_no BETWEEN first_page AND last_page")  # no other page meets its book's run
    parts = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    return inside.groupBy("book", "first_page").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def contents_entries(pages: DataFrame) -> DataFrame:
    """(book, pos, title, printed): entries of the contents run in order."""
    pairs = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(ENTRY), F.lit(g)).alias(c) for g, c in ((1, "title"), (2, "printed"))])
    return contents_text(pages).select("book", F.posexplode(pairs).alias("pos", "e")).select("book", "pos", F.col("e.title").alias("title"), F.col("e.printed").cast("int").alias("printed"))


def offset_by_contents(pages: DataFrame, first_entries: int = 8) -> DataFrame:
    """(book, offset): upper median of found page less printed page, over the first entries whose title heads a page."""
    bare = lambda x: F.lower(strip(F.regexp_replace(x, r"(?U)[^\w\s]", "")))
    heads = F.array_join(F.transform(F.slice(lines(F.col("text")), 1, 4), bare), " ")
    keys = contents_entries(pages).filter(F.col("pos") < first_entries).select("book", "pos", "printed", bare(F.col("title")).alias("key")).filter("key <> ''")
    few = bounded_broadcast(Workspace(pages.sparkSession, "keys").write(keys, "keys"))  # a few a book, so that no book's pages must meet in one task
    found = pages.select("book", "page_no", heads.alias("head")).join(few, "book").filter(F.col("head").contains(F.col("key")))
    first = found.groupBy("book", "pos", "printed").agg((F.min("page_no") - F.col("printed")).alias("diff"))
    return upper_median(first, "diff")


def running_headers(pages: DataFrame) -> DataFrame:
    """(book, page_no, header): the first filled line of each page, squeezed to 70 characters."""
    return pages.select("book", "page_no", F.left(squeeze(F.get(filled_lines(F.col("text")), F.lit(0))), F.lit(70)).alias("header")).filter("header IS NOT NULL")


def offset_by_headers(pages: DataFrame) -> DataFrame:
    """(book, offset): upper median of page less the number that ends its running header, where positive."""
    printed = F.expr(r"try_cast(regexp_extract(header, '(\\d{1,4})\\s*$', 1) AS INT)")
    return upper_median(running_headers(pages).withColumn("diff", F.col("page_no") - printed).filter("diff > 0"), "diff")


def outline_items(pages: DataFrame, least: int = 5, most_items: int = 400, enough: int = 30) -> DataFrame:
    """(book, page_no, line_no, structure, title, printed): lines of outline pages; no page is begun after enough items."""
    listing = F.size(F.filter("each", lambda x: x.rlike(r"\d{1,4}$"))) >= least
    hits = pages.filter(F.col("text").rlike(OUTLINE_PAGE)).select("book", "page_no", filled_lines(F.col("text")).alias("each")).filter(listing)
    got = hits.select("book", "page_no", F.posexplode("each").alias("line_no", "line")).filter(F.col("line").rlike(OUTLINE_LINE))
    code, title, printed = (F.regexp_extract("line", OUTLINE_LINE, g) for g in (1, 2, 3))
    order = W.partitionBy("book").orderBy("page_no", "line_no")
    ranked = got.withColumn("rank", F.row_number().over(order)).withColumn("ahead", F.min("rank").over(W.partitionBy("book", "page_no")) - 1)
    return ranked.filter((F.col("rank") <= most_items + 1) & (F.col("ahead") <= enough)).select(
        "book", "page_no", "line_no", F.when(code.rlike("^[A-Z]+$"), roman(code).cast("string")).otherwise(code).alias("structure"),
        strip(F.get(F.split(strip(title), r",\s+[A-Z][a-z]+"), F.lit(0))).alias("title"), printed.cast("int").alias("printed"),
    )


def first_run(pages: DataFrame, hit: str = "hit", first_pages: int = 20) -> DataFrame:
    """(book, page_no): the run of hit pages that starts with a book's first one, within its first pages."""
    order = W.partitionBy("book").orderBy("page_no")
    hits = pages.filter((F.col("page_no") <= first_pages) & F.col(hit) & (F.length(strip(F.col("text"))) >= 5)).withColumn("island", F.col("page_no") - F.row_number().over(order))
    start = F.min("island").over(W.partitionBy("book"))
    return hits.withColumn("start", start).filter("island = start").select("book", "page_no")


def locate_anywhere(titles: DataFrame, pages: DataFrame, head: int = 20) -> DataFrame:
    """(book, ord, found_page): the first page of the book that holds a title's beginning, white space and case aside."""
    norm = lambda c: F.regexp_replace(F.lower(c), r"(?U)\s+", " ")
    asked = titles.select("book", F.col("ord").alias("query_id"), F.left(norm(strip(F.col("title"))), F.lit(head)).alias("question")).filter("question <> ''")
    texts = pages.select("book", "page_no", norm(F.col("text")).alias("text"))
    return first_holding(texts, asked).select("book", F.col("query_id").alias("ord"), F.col("page_no").alias("found_page"))


def verified(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items (book, ord, title, physical_index) with ok: whether their page holds the title, letter case aside; null if they name no page of the book."""
    texts = pages.select("book", F.col("page_no").alias("physical_index"), F.lower("text").alias("_text"))
    return items.join(texts, ["book", "physical_index"], "left").withColumn("ok", F.col("_text").contains(F.lower(strip(F.col("title"))))).drop("_text")


def accuracy(checked: DataFrame, totals: DataFrame, sample: int = 25) -> DataFrame:
    """(book, accuracy): found titles among a hash-drawn sample of a book's items; 0 if the last page named is in the first half."""
    draw = F.row_number().over(W.partitionBy("book").orderBy(F.md5(F.concat_ws(":", "book", F.col("ord").cast("string")).cast("binary"))))
    last = F.max_by("physical_index", F.when(F.col("physical_index").isNotNull(), F.col("ord")))
    n = checked.withColumn("_drawn", draw <= sample).groupBy("book").agg(
        F.count_if(F.col("_drawn") & F.coalesce("ok", F.lit(False))).alias("good"), F.count_if(F.col("_drawn") & F.col("physical_index").isNotNull()).alias("named"), last.alias("last")
    )
    short = F.coalesce(F.col("last") < F.col("n_pages") / 2, F.lit(True))
    return n.join(totals, "book").select("book", F.when(short, 0.0).otherwise(F.round(F.col("good") / F.greatest("named", F.lit(1)), 6)).alias("accuracy"))


def neighbours(checked: DataFrame, totals: DataFrame) -> DataFrame:
    """(book, ord, before, after): for items not found on their page, the pages of the nearest verified items, or 0 and the last page.

    An item not found has no page of its own here, so the latest page up to and with it is
    that of an item before, and likewise from the end backwards.
    """
    page = F.when(F.coalesce("ok", F.lit(True)), F.col("physical_index"))
    items = Workspace(checked.sparkSession, "checked").write(checked.select("book", "ord", (-F.col("ord")).alias("back"), "ok", page.alias("page")), "items")  # read once a block step
    spread = latest(latest(items, "book", "ord", {"before": F.col("page")}), "book", "back", {"after": F.col("page")}).filter("ok = false").join(totals, "book")
    return spread.select("book", "ord", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.col("n_pages")).cast("int").alias("after"))
