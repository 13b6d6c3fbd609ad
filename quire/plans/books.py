"""Queries on printed contents, typography, links and names."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import contents, layout
from quire.plans import oracles as O
from quire.plans.queries import _ordered, query
from quire.session import table
from quire.sources import views as V


@query(O.PRINTED, body=r"""SELECT book, CAST(page_no AS VARCHAR) AS number, page_no, head AS title FROM printed_v WHERE contains(text, 'CHAPTER')""")
def chapter_starts(s, d):
    return contents.chapters(V.printed(s, d))


@query(O.PRINTED, body=r"""SELECT book, label, min(page_no) AS page_no FROM (SELECT book, page_no, trim('PART ' || n || ' ' || t) AS label, trim(t) AS t FROM (SELECT book, page_no, unnest(regexp_extract_all(text, '(?i)PART\s+(\d+|[IVX]+)\s*:?\s*([^\r\n]{1,60})', 1)) AS n, unnest(regexp_extract_all(text, '(?i)PART\s+(\d+|[IVX]+)\s*:?\s*([^\r\n]{1,60})', 2)) AS t FROM printed_v) a) b
 WHERE length(label) <= 45 AND (t = '' OR (NOT regexp_matches(t, '^\d+$') AND substr(t, 1, 1) NOT IN ('.', ',', ';', ':', '(', ')') AND CASE WHEN length(regexp_replace(t, '[^\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(t, '[^\p{Ll}]', '', 'g'))::DOUBLE / length(regexp_replace(t, '[^\p{L}]', '', 'g')) ELSE 0 END <= 0.30)) GROUP BY book, label""")
def division_headers(s, d):
    """The parts among the divisions: the SQL is theirs; sections are tested on literal pages."""
    return contents.divisions(V.printed(s, d), ("PART",))


@query(O.CONTENTS, body="SELECT book, page_no FROM hit_v")
def contents_pages(s, d):
    return contents.contents_hits(V.printed(s, d)).filter("hit").select("book", "page_no")


@query(O.CONTENTS, body="SELECT book, pos, title, printed FROM raw_entries_v")
def contents_entries(s, d):
    return contents.contents_entries(V.printed(s, d))


@query(O.CONTENTS, body=O.median(r"""SELECT book, min(page_no) - printed AS diff FROM (SELECT e.book, e.pos, e.printed, p.page_no FROM raw_entries_v e JOIN (SELECT book, page_no, lower(array_to_string(list_transform(string_split(text, chr(10))[1:4], lambda x: trim(regexp_replace(x, '[^\p{L}\p{N}_\s]', '', 'g'))), ' ')) AS head FROM printed_v) p
 ON p.book = e.book AND e.pos < 8 AND contains(p.head, lower(trim(regexp_replace(e.title, '[^\p{L}\p{N}_\s]', '', 'g'))))) m GROUP BY book, pos, printed"""))
def contents_offset(s, d):
    return contents.offset_by_contents(V.printed(s, d))


@query(O.LINES, body=O.median(r"""SELECT book, page_no - CAST(n AS INT) AS diff FROM (SELECT book, page_no, regexp_extract(trim(substr(regexp_replace(each[1], '\s+', ' ', 'g'), 1, 70)), '(\d{1,4})\s*$', 1) AS n FROM lines_v WHERE len(each) > 0) h WHERE n <> '' AND page_no > CAST(n AS INT)"""))
def header_offset(s, d):
    return contents.offset_by_headers(V.printed(s, d))


@query(O.CONTENTS, body="""SELECT book, page_no FROM (SELECT *, min(island) OVER (PARTITION BY book) AS start FROM (SELECT book, page_no, page_no - row_number() OVER (PARTITION BY book ORDER BY page_no) AS island FROM hit_v WHERE page_no <= 20) x) y WHERE island = start""")
def contents_prefix_run(s, d):
    return contents.first_run(contents.contents_hits(V.printed(s, d)))


#: Contents pages also number their lines, so with a marker in front they read as outline pages.
OUTLINES = r"""listing_v AS (SELECT book, page_no, each FROM (SELECT book, page_no, list_filter(list_transform(string_split('CHAPTER OUTLINE' || chr(10) || text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS each FROM printed_v) z WHERE len(list_filter(each, lambda x: regexp_matches(x, '\d{1,4}$'))) >= 5),
 item_v AS (SELECT book, page_no, CAST(u.pos - 1 AS INT) AS line_no, u.line, row_number() OVER (PARTITION BY book ORDER BY page_no, u.pos) AS rank FROM listing_v l, unnest(l.each) WITH ORDINALITY u(line, pos) WHERE regexp_matches(u.line, '^\s*([IVXLCDM]+|\d+(?:\.\d+)*)[\).]?\s+(.+?)[,;.]?\s+(\d{1,4})$'))"""


@query(O.PRINTED, OUTLINES, body=r"""SELECT book, page_no, line_no, CASE WHEN regexp_matches(code, '^[A-Z]+$') THEN CAST(coalesce(list_position(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'], code), 1) AS VARCHAR) ELSE code END AS structure, trim(regexp_split_to_array(title, ',\s+[A-Z][a-z]+')[1]) AS title, printed FROM
 (SELECT *, regexp_extract(line, '^\s*([IVXLCDM]+|\d+(?:\.\d+)*)[\).]?\s+(.+?)[,;.]?\s+(\d{1,4})$', 1) AS code, trim(regexp_extract(line, '^\s*([IVXLCDM]+|\d+(?:\.\d+)*)[\).]?\s+(.+?)[,;.]?\s+(\d{1,4})$', 2)) AS title, CAST(regexp_extract(line, '^\s*([IVXLCDM]+|\d+(?:\.\d+)*)[\).]?\s+(.+?)[,;.]?\s+(\d{1,4})$', 3) AS INT) AS printed,
 min(rank) OVER (PARTITION BY book, page_no) - 1 AS ahead FROM item_v) x WHERE rank <= 401 AND ahead <= 30""")
def outline_items(s, d):
    return contents.outline_items(V.printed(s, d).withColumn("text", F.concat(F.lit("CHAPTER OUTLINE\n"), "text")))


@query(O.ORDERED, body=r"""SELECT t.book, t.ord, min(p.page_no) AS found_page FROM (SELECT book, ord, substr(regexp_replace(lower(trim(title, ' ' || chr(9) || chr(10) || chr(13))), '\s+', ' ', 'g'), 1, 20) AS q FROM toc_o) t
 JOIN (SELECT book, page_no, regexp_replace(lower(text), '\s+', ' ', 'g') AS text FROM pages_v) p ON p.book = t.book AND q <> '' AND contains(p.text, q) GROUP BY t.book, t.ord""")
def title_first_page(s, d):
    return contents.locate_anywhere(_ordered(s, d), V.pages(s, d))


CHECKED = """shifted AS (SELECT book, ord, title, CASE WHEN ord % 11 = 0 THEN NULL WHEN ord % 7 = 0 THEN physical_index + 1 ELSE physical_index END AS physical_index FROM toc_o),
 totals AS (SELECT book, max(page_no) AS n_pages FROM pages_v GROUP BY book),
 checked AS (SELECT s.*, contains(lower(p.text), lower(trim(s.title, ' ' || chr(9) || chr(10) || chr(13)))) AS ok FROM shifted s LEFT JOIN pages_v p ON p.book = s.book AND p.page_no = s.physical_index)"""


def _checked(s, d):
    """Contents of which some items name the next page, and some none."""
    page = F.when(F.col("ord") % 11 == 0, None).when(F.col("ord") % 7 == 0, F.col("physical_index") + 1).otherwise(F.col("physical_index"))
    pages = V.pages(s, d)
    items = _ordered(s, d).select("book", "ord", "title", page.cast("int").alias("physical_index"))
    return contents.verified(items, pages), pages.groupBy("book").agg(F.max("page_no").alias("n_pages"))


@query(O.ORDERED, CHECKED, body="""SELECT t.book, CASE WHEN coalesce(last < n_pages / 2.0, true) THEN 0.0::DOUBLE ELSE round(good::DOUBLE / greatest(named, 1), 6) END AS accuracy FROM totals t JOIN (SELECT book, count(*) FILTER (drawn AND coalesce(ok, false)) AS good, count(*) FILTER (drawn AND physical_index IS NOT NULL) AS named, arg_max(physical_index, ord) FILTER (physical_index IS NOT NULL) AS last
 FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY md5(book || ':' || ord)) <= 25 AS drawn FROM checked) c GROUP BY book) a ON a.book = t.book""")
def contents_accuracy(s, d):
    return contents.accuracy(*_checked(s, d))


@query(O.ORDERED, CHECKED, body="""SELECT w.book, ord, coalesce(before, 0) AS before, coalesce(after, n_pages) AS after FROM (SELECT book, ord, ok, last_value(CASE WHEN coalesce(ok, true) THEN physical_index END IGNORE NULLS) OVER (PARTITION BY book ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 first_value(CASE WHEN coalesce(ok, true) THEN physical_index END IGNORE NULLS) OVER (PARTITION BY book ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM checked) w JOIN totals t ON t.book = w.book WHERE ok = false""")
def verified_neighbours(s, d):
    return contents.neighbours(*_checked(s, d))


@query(O.SPANS, body="""SELECT book, size AS body_size FROM (SELECT book, size, row_number() OVER (PARTITION BY book ORDER BY sum(length(trim(text))) DESC, min(page_no * 100000 + line)) AS r FROM sized_v WHERE trim(text) <> '' GROUP BY book, size) x WHERE r = 1""")
def body_font_size(s, d):
    return layout.body_size(V.spans(s, d))


@query(O.SPANS, r"""body AS (SELECT book, size AS body_size FROM (SELECT book, size, row_number() OVER (PARTITION BY book ORDER BY sum(length(trim(text))) DESC, min(page_no * 100000 + line)) AS r FROM sized_v WHERE trim(text) <> '' GROUP BY book, size) x WHERE r = 1),
 cand AS (SELECT s.book, page_no, 0 AS block, line, trim(text) AS title, size - body_size AS above, coalesce(nullif(regexp_extract(trim(text), '^\s*(?i:chapter|part|appendix)\s+((?i:[IVXLCDM0-9]+))\b', 1), ''), nullif(regexp_extract(trim(text), '^\s*(\d+(?:\.\d+){0,3})\.?\s+[A-Z][^\n]{1,120}$', 1), ''), nullif(regexp_extract(trim(text), '^\s*([IVXLCDM]+)\s+[A-Z][^\n]{1,120}$', 1), '')) AS number
  FROM sized_v s JOIN body b ON b.book = s.book WHERE trim(text) <> '' AND length(trim(text)) <= 160 AND y0 + 12 >= 50 AND y0 <= 950)""",
 body=r"""SELECT book, page_no, block, line, title, level FROM (SELECT *, CASE WHEN number IS NOT NULL THEN CASE WHEN contains(number, '.') THEN length(number) - length(replace(number, '.', '')) + 1 ELSE 1 END
 WHEN above >= 1.5 AND len(regexp_split_to_array(title, '\s+')) <= 14 AND NOT regexp_matches(title, '(\.|;|,)$') THEN CASE WHEN above >= 6 THEN 1 WHEN above >= 3 THEN 2 ELSE 3 END END AS level FROM cand) x WHERE level IS NOT NULL""")
def typography_headings(s, d):
    return layout.headings(V.spans(s, d))


LINKS = "CASE doc_id % 3 WHEN 0 THEN 'old/work/figures/' WHEN 1 THEN 'https://example.org/figures/' ELSE 'plain/' END || 'p ' || doc_id || '.png'"


@query(body=f"SELECT doc_id, 'See ![a](' || CASE doc_id % 3 WHEN 0 THEN 'figures/p%20' || doc_id || '.png' ELSE {LINKS} END || ') and ![b](figures/c.png).' AS markdown FROM documents")
def portable_image_links(s, d):
    link = F.concat(F.when(F.col("doc_id") % 3 == 0, "old/work/figures/").when(F.col("doc_id") % 3 == 1, "https://example.org/figures/").otherwise("plain/"), F.lit("p "), F.col("doc_id").cast("string"), F.lit(".png"))
    markdown = F.concat(F.lit("See !["), F.lit("a]("), link, F.lit(") and ![b](x/figures/c.png)."))
    return table(s, d, "documents").select("doc_id", X.portable_links(markdown).alias("markdown"))


LINKED = """'{"a": {"uri": "' || CASE doc_id % 3 WHEN 0 THEN 'old/work/document_artifacts/p%20' WHEN 1 THEN 'https://example.org/document_artifacts/' ELSE 'plain/' END || doc_id || '.png"}, "list": [{"uri" : "document_artifacts/c.png"}, {"uri": "x/figures/d.png"}]}'"""


@query(body=f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(j, 'old/work/document_artifacts/p%20', 'document_artifacts/p ') ELSE j END AS document FROM (SELECT doc_id, {LINKED} AS j FROM documents) x")
def portable_uris(s, d):
    return table(s, d, "documents").select("doc_id", X.portable_uris(F.expr(LINKED)).alias("document"))


@query(body=r"""SELECT doc_id, CASE WHEN bare = '' THEN 'book' ELSE bare END || '-' || substr(sha256(file), 1, 8) AS slug FROM (SELECT doc_id, left(trim(regexp_replace(lower(regexp_replace(substr(text, 1, 90), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), 65) AS bare, source || '.pdf' AS file FROM documents) x""")
def book_slug(s, d):
    ascii_name = F.regexp_replace(F.substring("text", 1, 90), r"[^\x00-\x7F]", "")
    return table(s, d, "documents").select("doc_id", X.slug(ascii_name, F.concat("source", F.lit(".pdf"))).alias("slug"))


@query(O.RECORDS, body="""SELECT book, rec_no, merged, page_no FROM (SELECT book, rec_no, page_no, rec_no // 10 AS merged, first_value(page_no) OVER (PARTITION BY book, rec_no // 10 ORDER BY rec_no) AS f FROM records_v) x WHERE page_no <> f""")
def cross_page_items(s, d):
    """Items whose page is not that of the first item of their merged record (here ten records)."""
    items = V.records(s, d).withColumn("merged", F.expr("rec_no div 10"))
    first = F.first("page_no").over(W.partitionBy("book", "merged").orderBy("rec_no"))
    return items.withColumn("f", first).filter("page_no <> f").select("book", "rec_no", "merged", "page_no")
