"""Queries of the question loop over trees, and of building and choosing trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import dialogue, indexer, trees
from quire.plans import oracles as O
from quire.plans.queries import SIBLINGS, _ordered, _sibling_nodes, query
from quire.session import table
from quire.sources import views as V
from quire.workspace import Workspace

#: What a model might say to a question: lists of known and unknown books, no list, a broken one, an empty one.
SAID_BOOKS = """CASE query_id % 5 WHEN 0 THEN 'Try ["src3", "none", "src' || (query_id % 20) || '", "src5"] first.' WHEN 1 THEN 'no list here' WHEN 2 THEN '["src1"' WHEN 3 THEN '[]' ELSE '["src' || (query_id % 20) || '"]' END"""
SAID_NODES = """CASE query_id % 4 WHEN 0 THEN 'ids: ["0004", "9999", "0001"]' WHEN 1 THEN 'none' WHEN 2 THEN '["9999"]' ELSE '["000' || (query_id % 9 + 1) || '"]' END"""

NODES = SIBLINGS + r""", coded AS (SELECT *, list_transform(string_split(structure, '.'), lambda x: CAST(x AS INTEGER)) AS path FROM ends),
 tree AS (SELECT book AS doc, structure, depth, path, title, start_index, end_index, lpad(CAST(row_number() OVER (PARTITION BY book ORDER BY path) AS VARCHAR), 4, '0') AS node_id FROM coded)"""


def _nodes(s, d):
    nodes = _sibling_nodes(s, d).withColumn("path", F.transform(F.split("structure", r"\."), lambda x: x.cast("int")))
    numbered = trees.number_nodes(nodes, ["path"]).withColumnRenamed("book", "doc").withColumn("crumb", F.col("title"))
    return Workspace(s, "nodes").write(numbered, "nodes")  # read several times


@query(O.ORDERED, body="""SELECT book AS doc, 'Chapters include: ' || string_agg(title, '; ' ORDER BY ord) AS description FROM (SELECT book, title, row_number() OVER (PARTITION BY book ORDER BY CAST(structure AS INTEGER)) AS ord FROM toc_o WHERE depth = 1) x WHERE ord <= 5 GROUP BY book""")
def book_descriptions(s, d):
    return dialogue.registry(_nodes(s, d))


ROUTED = f"""asked AS (SELECT query_id, CASE WHEN regexp_matches(said, '(?s)\\[.*\\]') THEN try_cast(regexp_extract(said, '(?s)\\[.*\\]', 0) AS JSON) END AS list FROM (SELECT query_id, {SAID_BOOKS} AS said FROM (SELECT item_id AS query_id FROM benchmark) q) x),
 books AS (SELECT DISTINCT source AS doc FROM documents),
 named AS (SELECT query_id, e.name AS doc, e.nth FROM (SELECT query_id, from_json(list, '["VARCHAR"]') AS names FROM asked WHERE list IS NOT NULL) y, unnest(names) WITH ORDINALITY e(name, nth) WHERE e.name IN (SELECT doc FROM books))"""


@query(ROUTED, body="""SELECT query_id, doc, CAST(pos AS INTEGER) AS pos FROM (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY nth) - 1 AS pos FROM named) x WHERE pos < 2
 UNION ALL SELECT query_id, doc, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc) - 1 AS INTEGER) FROM asked, books WHERE list IS NULL""")
def routed_books(s, d):
    said = V.questions(s, d).select("query_id", F.expr(SAID_BOOKS).alias("said"))
    return dialogue.routed(said, table(s, d, "documents").select(F.col("source").alias("doc")).distinct())


def _picked(s, d):
    said = V.questions(s, d).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("doc"), F.expr(SAID_NODES).alias("said"))
    nodes = _nodes(s, d)
    return dialogue.picked(said, nodes), nodes


PICKED = NODES + f""", said AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS doc, {SAID_NODES.replace("query_id", "item_id")} AS said FROM benchmark),
 parsed AS (SELECT query_id, doc, CASE WHEN contains(said, '[') THEN from_json(regexp_extract(said, '(?s)\\[.*\\]', 0), '["VARCHAR"]') END AS ids FROM said),
 offered AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY path) - 1 AS nth FROM (SELECT *, max(CASE WHEN end_index - start_index + 1 >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc) AS anywide FROM tree) x WHERE anywide = 0 OR end_index - start_index + 1 >= 2),
 named AS (SELECT p.query_id, p.doc, e.nth - 1 AS pos, t.path FROM parsed p, unnest(p.ids) WITH ORDINALITY e(id, nth) JOIN tree t ON t.doc = p.doc AND t.node_id = e.id),
 chosen AS (SELECT * FROM named UNION ALL SELECT p.query_id, p.doc, o.nth, o.path FROM parsed p JOIN offered o ON o.doc = p.doc AND o.nth < 2 WHERE p.ids IS NULL
  UNION ALL SELECT p.query_id, p.doc, 0, o.path FROM parsed p JOIN offered o ON o.doc = p.doc AND o.nth = 0 WHERE p.ids IS NOT NULL AND NOT EXISTS (SELECT 1 FROM named n WHERE n.query_id = p.query_id)),
 climbed AS (SELECT c.query_id, c.doc, c.pos, coalesce(max(t.path) FILTER (t.end_index - t.start_index + 1 >= 2), c.path[1:1]) AS path FROM chosen c LEFT JOIN tree t ON t.doc = c.doc AND t.path = c.path[1:len(t.path)] GROUP BY c.query_id, c.doc, c.pos, c.path)"""


@query(O.ORDERED, PICKED, body="SELECT query_id, doc, CAST(pos AS INTEGER) AS pos, array_to_string(path, '.') AS structure FROM climbed")
def picked_nodes(s, d):
    return _picked(s, d)[0].select("query_id", "doc", F.col("pos").cast("int").alias("pos"), F.concat_ws(".", F.transform("path", lambda x: x.cast("string"))).alias("structure"))


@query(O.ORDERED, PICKED, body="""SELECT c.query_id, c.doc, t.title, t.start_index, t.end_index, string_agg(p.text, chr(10) ORDER BY p.page_no) AS text FROM (SELECT * FROM climbed QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY pos) = 1) c
 JOIN tree t ON t.doc = c.doc AND t.path = c.path JOIN pages_v p ON p.book = t.doc AND p.page_no BETWEEN t.start_index AND least(t.end_index, t.start_index + 3) GROUP BY c.query_id, c.doc, t.title, t.start_index, t.end_index""")
def pages_to_read(s, d):
    return dialogue.pages_to_read(*_picked(s, d), V.pages(s, d))


@query(O.PAGES, body="SELECT book, count(*) AS n_pages, CAST(sum(ceil(strlen(text) / 2.0) + 2) AS BIGINT) AS n_tokens FROM pages_v GROUP BY book")
def document_totals(s, d):
    return indexer.totals(V.pages(s, d).select("book", X.token_estimate(F.col("text")).alias("n_tokens")))


def _printed(s, d, contents: bool = True):
    """Pages without chapter markers in some books, so that headings give no tree there; without contents if asked."""
    p = V.printed(s, d)
    text = F.when(F.substring("book", -1, 1) == "7", F.replace("text", F.lit("CHAPTER"), F.lit("Section"))).otherwise(F.col("text"))
    return p.withColumn("text", text if contents else F.when(F.startswith("text", F.lit("Contents")), "none").otherwise(text))


MARKED = r"""marked AS (SELECT book, page_no AS ord, head AS title, page_no AS start_index FROM printed_v WHERE contains(text, 'CHAPTER') AND right(book, 1) <> '7'),
 last AS (SELECT book, max(page_no) AS m, count(*) AS n FROM pages_v GROUP BY book),
 flat AS (SELECT f.book, ord, title, start_index, greatest(start_index, coalesce(lead(start_index) OVER (PARTITION BY f.book ORDER BY ord) - 1, m)) AS end_index, n FROM marked f JOIN last USING (book)),
 good AS (SELECT book, count(*) >= 3 AND count(*) FILTER (end_index - start_index + 1 > greatest(150, floor(n * 0.15::DOUBLE))) = 0 AND (max(end_index) - min(start_index) + 1)::DOUBLE / max(n) >= 0.85 AS ok FROM flat GROUP BY book)"""


@query(O.PRINTED, MARKED, body="SELECT book, CASE WHEN coalesce(ok, false) THEN 'ok' ELSE 'failed' END AS status, CASE WHEN ok THEN 'manual' END AS mode, CASE WHEN coalesce(ok, false) THEN '' ELSE 'empty_structure' END AS reasons FROM last LEFT JOIN good USING (book)")
def heading_trees(s, d):
    """Trees from chapter markers alone: the printed contents are blotted out."""
    return indexer.choose(_printed(s, d, contents=False))[0]


@query()
def index_modes(s, d):
    """How the books of the printed view get their trees. Tests hold both ways, and the choice, against literal books."""
    return indexer.summary(indexer.choose(_printed(s, d))[0])


@query(O.ORDERED, NODES, body="SELECT doc, depth, node_id, title, start_index, end_index FROM tree")
def nested_tree(s, d):
    """Nodes nested to JSON and flattened again."""
    nodes = _nodes(s, d).withColumnRenamed("doc", "book")
    return trees.flatten_trees(s, indexer.nested(nodes)).select("doc", "depth", "node_id", "title", "start_index", "end_index")


@query(O.PRINTED, body=r"SELECT book, page_no, regexp_replace(text, '\.{5,}', ': ', 'g') AS text FROM printed_v WHERE page_no BETWEEN 3 AND 5")
def contents_leaders(s, d):
    return V.printed(s, d).filter("page_no BETWEEN 3 AND 5").select("book", "page_no", indexer.colon_leaders(F.col("text")).alias("text"))


@query(O.ORDERED, body="SELECT book, ord, physical_index FROM (SELECT book, ord, CASE WHEN ord % 5 = 0 THEN 0 WHEN ord % 7 = 0 THEN NULL ELSE physical_index END AS physical_index FROM toc_o) x WHERE physical_index <> 0")
def valid_toc_items(s, d):
    page = F.when(F.col("ord") % 5 == 0, 0).when(F.col("ord") % 7 == 0, None).otherwise(F.col("physical_index"))
    return indexer.valid_items(_ordered(s, d).select("book", "ord", page.cast("int").alias("physical_index")))


@query(body="SELECT item_id AS query_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')[1:16], lambda t: '\"' || t || '\"'), ' OR ') AS match, regexp_matches(lower(text), '\\b(compare|why|how|across|synthesi|versus)\\b') AS complex FROM benchmark")
def query_terms(s, d):
    asked = V.questions(s, d)
    return asked.select("query_id", X.match_terms(F.col("question")).alias("match"), X.is_complex(F.col("question")).alias("complex"))


PLACES = {"new": "doc_id % 2 = 0", "old": "doc_id % 3 = 0", "older": "doc_id % 5 = 0"}


@query(body="SELECT 'f' || doc_id AS name, CASE WHEN doc_id % 2 = 0 THEN 'new/' WHEN doc_id % 3 = 0 THEN 'old/' ELSE 'older/' END || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS place FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0")
def first_output(s, d):
    """Of output files in several folders the one in the first folder that has it."""
    own = lambda folder, rule: table(s, d, "documents").filter(rule).select(F.concat(F.lit("f"), "doc_id").alias("name"), F.concat(F.lit(f"{folder}/"), "doc_id").alias("path"))
    return indexer.first_found(*[own(f, r) for f, r in PLACES.items()])


@query(O.PAGES, body="SELECT book, page_no, '<physical_index_' || page_no || '>' || chr(10) || text || chr(10) || '<physical_index_' || page_no || '>' AS tagged FROM pages_v")
def tagged_pages(s, d):
    return V.pages(s, d).select("book", "page_no", X.page_tag(F.col("page_no"), F.col("text")).alias("tagged"))
