"""The engine's queries by name, each with SQL that computes the same rows in DuckDB where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import answers, audit, chunks, quality, retrieval, trees
from quire.plans import oracles as O
from quire.session import table
from quire.sources import views as V
from quire.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(*views: str, body: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = O.with_views(*views, body=body) if views else body
        return f

    return add


# Retrieval

TOP10 = "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits) x WHERE rank <= {k}"


@query(O.BM25, body=TOP10.format(k=10))
def bm25_topk(s, d):
    return retrieval.bm25(table(s, d, "documents"), V.questions(s, d)).select("query_id", "doc_id", "score", "rank")


COSINE = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
 hits AS (SELECT query_id, vec_id, round(list_inner_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)"""


def _asked_vectors(s, d):
    return table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(COSINE, body=TOP10.format(k=50).replace("doc_id", "vec_id"))
def dense_topk(s, d):
    return retrieval.cosine_topk(table(s, d, "embeddings").select("vec_id", "embedding"), _asked_vectors(s, d)).select("query_id", "vec_id", "score", "rank")


@query(O.BM25, body="""SELECT query_id, doc_id, rank FROM (SELECT x.*, d.source FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM hits) x JOIN documents d USING (doc_id) WHERE rank <= 50) y WHERE source = 'src1'""")
def book_post_filter(s, d):
    """Lexical hits are cut to the first 50 before the book filter."""
    hits = retrieval.bm25(table(s, d, "documents"), V.questions(s, d), k=50)
    return hits.join(table(s, d, "documents").select("doc_id", "source"), "doc_id").filter("source = 'src1'").select("query_id", "doc_id", "rank")


@query(COSINE, """few AS (SELECT h.* FROM hits h JOIN documents d ON h.vec_id = d.doc_id WHERE d.source = 'src1')""", body=TOP10.format(k=50).replace("doc_id", "vec_id").replace("FROM hits", "FROM few"))
def book_pre_filter(s, d):
    """Dense candidates are cut to the book before the first 50."""
    own = table(s, d, "documents").filter("source = 'src1'").select(F.col("doc_id").alias("vec_id"))
    vectors = table(s, d, "embeddings").select("vec_id", "embedding").join(own, "vec_id", "left_semi")
    return retrieval.cosine_topk(vectors, _asked_vectors(s, d)).select("query_id", "vec_id", "score", "rank")


FUSED = """lex AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits) x WHERE rank <= 50),
 den AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM lex WHERE doc_id % 3 = 0) x),
 every AS (SELECT *, 0 AS list_no FROM lex UNION ALL SELECT *, 1 FROM den),
 fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(list_no * 1000 + rank) AS seen FROM every GROUP BY query_id, doc_id),
 ranked AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc_id) AS INTEGER) AS rank FROM fused)"""


def _fused(s, d, keep=25):
    lex = Workspace(s, "hits").write(retrieval.bm25(table(s, d, "documents"), V.questions(s, d), k=50).select("query_id", "doc_id", "rank"), "lexical")  # both lists come of it
    order = W.partitionBy("query_id").orderBy(F.desc("doc_id"))
    other = lex.filter("doc_id % 3 = 0").select("query_id", "doc_id", F.row_number().over(order).alias("rank"))
    return retrieval.rrf([lex, other], "doc_id", keep=keep)


@query(O.BM25, FUSED, body="SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 25")
def rrf_fuse(s, d):
    return _fused(s, d)


@query(O.BM25, FUSED, body="""SELECT query_id, doc_id, final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rank) AS INTEGER) AS place
 FROM (SELECT *, round(score - CASE WHEN doc_id % 4 = 0 THEN 0.003::DOUBLE ELSE 0 END, 6) AS final FROM ranked WHERE rank <= 25) x""")
def penalised_rank(s, d):
    hits = _fused(s, d).withColumn("reference_path", F.col("doc_id") % 4 == 0).withColumn("asks", F.lit(False))
    return retrieval.penalised(hits, "doc_id")


@query(O.BM25, FUSED, """sized AS (SELECT r.query_id, r.doc_id, r.rank, CAST(ceil(strlen(d.text) / 2.0) + 2 AS BIGINT) AS n FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 25),
 walk AS (WITH RECURSIVE w AS (SELECT query_id, 0 AS at, 0::BIGINT AS used, 0 AS taken, false AS took FROM (SELECT DISTINCT query_id FROM sized) z
  UNION ALL SELECT w.query_id, w.at + 1, CASE WHEN w.taken < 8 AND w.used + s.n <= 7000 THEN w.used + s.n ELSE w.used END, CASE WHEN w.taken < 8 AND w.used + s.n <= 7000 THEN w.taken + 1 ELSE w.taken END, w.taken < 8 AND w.used + s.n <= 7000
  FROM w JOIN sized s ON s.query_id = w.query_id AND s.rank = w.at + 1) SELECT * FROM w)""", body="SELECT s.query_id, s.doc_id, s.rank FROM sized s JOIN walk w ON w.query_id = s.query_id AND w.at = s.rank WHERE w.took")
def budget_select(s, d):
    sizes = table(s, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("n_tokens"))
    return retrieval.budget(_fused(s, d).join(sizes, "doc_id"), "doc_id")


@query(O.BM25, body="""SELECT query_id, doc_id, min(pos) AS pos, CAST(arg_max(val, seq) AS DOUBLE) AS val FROM (
 SELECT query_id, doc_id, 0 AS seq, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos, score AS val FROM hits QUALIFY pos <= 5
 UNION ALL SELECT query_id, doc_id, 1, 100 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id), score * 2 FROM hits WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5) x GROUP BY query_id, doc_id""")
def union_seen(s, d):
    """Results of repeated searches: a document keeps its first place and its last value."""
    hits = retrieval.bm25(table(s, d, "documents"), V.questions(s, d), k=5, among=("true", "doc_id % 2 = 0"))
    one = hits.filter("list_no = 0").select("query_id", "doc_id", F.lit(0).alias("seq"), F.col("rank").cast("long").alias("pos"), F.col("score").alias("val"))
    two = hits.filter("list_no = 1").select("query_id", "doc_id", F.lit(1).alias("seq"), (F.col("rank") + 100).cast("long").alias("pos"), (F.col("score") * 2).alias("val"))
    return one.union(two).groupBy("query_id", "doc_id").agg(F.min("pos").alias("pos"), F.max_by("val", "seq").alias("val"))


EVAL = """ranks AS (SELECT q.item_id AS query_id, min(x.rank) AS rank FROM benchmark q JOIN documents d ON contains(d.text, q.text)
  LEFT JOIN (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits QUALIFY rank <= 10) x ON x.query_id = q.item_id AND x.doc_id = d.doc_id GROUP BY q.item_id)"""


def _anchor_ranks(s, d):
    """The best rank among a question's containing documents."""
    questions, docs = V.questions(s, d), table(s, d, "documents")
    hits = retrieval.bm25(docs, questions, k=10).select("query_id", "doc_id", "rank")
    qrels = retrieval.containing(docs, questions)
    return qrels.join(hits, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))


@query(O.BM25, EVAL, body="SELECT query_id, CAST(rank AS INTEGER) AS rank FROM ranks")
def anchor_rank(s, d):
    return _anchor_ranks(s, d)


@query(O.BM25, EVAL, body="""SELECT round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit5, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit10,
 round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, count(*) AS n_cases FROM ranks""")
def eval_hits_mrr(s, d):
    return retrieval.scores(_anchor_ranks(s, d).select(F.col("rank").alias("worst"), F.col("rank").isNull().alias("missing")))


# Text

@query(body="SELECT doc_id, CAST(ceil(strlen(text) / 2.0) + 2 AS BIGINT) AS n_tokens FROM documents")
def token_estimate(s, d):
    return table(s, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("n_tokens"))


@query(body=r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def text_normalize(s, d):
    return table(s, d, "documents").select("doc_id", X.squeeze(F.col("text")).alias("text"))


@query(O.RECORDS, body=r"""SELECT book, rec_no, text = '' OR (NOT regexp_matches(text, '^\d+$') AND substr(text, 1, 1) NOT IN ('.', ',', ';', ':', '(', ')')
 AND CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^\p{Ll}]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^\p{L}]', '', 'g')) ELSE 0 END <= 0.30) AS ok FROM records_v""")
def heading_validity(s, d):
    return V.records(s, d).select("book", "rec_no", X.heading_valid(F.col("text")).alias("ok"))


@query(O.PAGES, body=r"""SELECT book, header, min(page_no) AS page_no FROM (SELECT book, page_no, trim(regexp_replace(regexp_replace(trim(line), '^\d{1,4}\s+', ''), '\s+\d{1,4}$', '')) AS header
 FROM (SELECT book, page_no, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:3]) AS line FROM pages_v) x) y
 WHERE length(header) BETWEEN 4 AND 80 AND length(regexp_replace(header, '[^\p{L}]', '', 'g')) > 0
 AND length(regexp_replace(header, '[^\p{Lu}]', '', 'g'))::DOUBLE / length(regexp_replace(header, '[^\p{L}]', '', 'g')) >= 0.6 GROUP BY book, header""")
def uppercase_headers(s, d):
    return trees.upper_headers(V.pages(s, d))


@query(body=r"SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(my|mine|me|i|our|we)([^\p{L}\p{N}_]|$)') AS personal FROM conversations WHERE role = 'user'")
def personal_question_filter(s, d):
    asked = table(s, d, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", X.is_personal(F.col("text")).alias("personal"))


#: Headings of a few kinds, made from an id.
HEADING = """CASE doc_id % 7 WHEN 0 THEN 'Chapter ' || doc_id || ' > References' WHEN 1 THEN 'Patient preferences' WHEN 2 THEN 'SELECTED REFERENCE' WHEN 3 THEN 'Annotated bibliography, ' || lang WHEN 4 THEN 'Cross-referenced cases' ELSE 'Findings' END"""


@query(body=rf"SELECT doc_id, regexp_matches(lower({HEADING}), '\b(references?|bibliography)\b') AS is_reference FROM documents")
def reference_predicate(s, d):
    return table(s, d, "documents").select("doc_id", X.is_reference_path(F.expr(HEADING)).alias("is_reference"))


SPOILT = "text || CASE doc_id % 4 WHEN 0 THEN ' \ufffd Glyph<12> glyph<7>' WHEN 1 THEN '\ufffd\ufffd' ELSE '' END"


@query(body=f"SELECT doc_id, CAST(length(t) - length(replace(t, chr(65533), '')) + (length(t) - length(replace(lower(t), 'glyph<', ''))) / 6 AS BIGINT) AS artifacts FROM (SELECT doc_id, {SPOILT} AS t FROM documents) x")
def encoding_artifacts(s, d):
    return table(s, d, "documents").select("doc_id", quality.artifacts(F.expr(SPOILT)).alias("artifacts"))


NUMERALS = "'I', 'II', 'iii', 'IV', 'v', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'A'"


@query(O.ORDERED, body=f"SELECT book, structure, length(structure) - length(replace(structure, '.', '')) + 1 AS level, CAST(coalesce(list_position(['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'], upper([{NUMERALS}][ord % 12 + 1])), 1) AS INTEGER) AS numeral FROM toc_o")
def roman_level(s, d):
    return _ordered(s, d).select("book", "structure", X.heading_level(F.col("structure")).cast("long").alias("level"), X.roman(F.expr(f"get(array({NUMERALS}), ord % 12)")).alias("numeral"))


@query(O.HTML, body="""SELECT page_id, pos, tag, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS safe FROM blocks_v""")
def html_text_blocks(s, d):
    return V.html_blocks(s, d).select("page_id", "pos", "tag", X.html_escape(F.col("text")).alias("safe"))


@query(O.HTML, body="SELECT page_id, text AS heading FROM blocks_v WHERE tag = 'h1'")
def html_headings(s, d):
    return V.html_blocks(s, d).filter("tag = 'h1'").select("page_id", F.col("text").alias("heading"))


# Profiles and quality

@query(O.RECORDS, body="""SELECT book, count(*) AS n_records, count(*) FILTER (label = 'section_header') AS n_headers, count(*) FILTER (label IN ('section_header', 'text', 'list', 'table', 'caption', 'footnote', 'formula')) AS n_known,
 count(*) FILTER (label <> 'section_header' AND length(text) > 2000) AS oversized, count(*) FILTER (page_no IS NULL) AS missing_page, count(*) FILTER (label = 'table' AND NOT (contains(text, '|') AND contains(text, '---'))) AS tables_without_grid,
 count(*) FILTER (label = 'list' AND contains(text, chr(10))) AS merged_lists FROM records_v GROUP BY book""")
def audit_labels(s, d):
    return audit.labels(V.records(s, d))


@query(O.RECORDS, body="""SELECT book, heading, n, first_rec, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, first_rec) AS rank FROM (
 SELECT book, lower(text) AS heading, count(*) AS n, min(rec_no) AS first_rec FROM records_v WHERE label = 'section_header' GROUP BY book, lower(text)) x) y WHERE rank <= 10""")
def audit_top_headings(s, d):
    return audit.top_headings(V.records(s, d))


@query(O.RECORDS, body="""SELECT book, round_even(sum(CASE WHEN label <> 'section_header' AND doc_id % 3 = 0 THEN length(text) ELSE 0 END)::DOUBLE / greatest(sum(CASE WHEN label <> 'section_header' THEN length(text) ELSE 0 END), 1), 4) AS fraction FROM records_v GROUP BY book""")
def audit_ref_fraction(s, d):
    return audit.reference_fraction(V.records(s, d), F.col("doc_id") % 3 == 0)


@query(O.RECORDS, body="SELECT * FROM (SELECT book, rec_no, page_no, last_value(page_no IGNORE NULLS) OVER (PARTITION BY book ORDER BY rec_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM records_v) x WHERE page_no < previous")
def page_backtracks(s, d):
    return audit.page_backtracks(V.records(s, d))


@query(O.RECORDS, body="SELECT book, rec_no, CAST(rank AS INTEGER) AS rank FROM (SELECT book, rec_no, row_number() OVER (PARTITION BY book ORDER BY rec_no) AS rank FROM records_v WHERE label <> 'section_header' AND length(text) > 2000) x WHERE rank <= 25")
def first_n_samples(s, d):
    return audit.first_samples(V.records(s, d), (F.col("label") != "section_header") & (F.length("text") > 2000), 25).select("book", "rec_no", "rank")


@query(body="""SELECT batch, page, CAST(coalesce(sum(size), 0) AS BIGINT) AS text_chars FROM (SELECT DISTINCT doc_id // 10 AS batch, unnest(range(41, 51)) AS page FROM documents) g LEFT JOIN
 (SELECT DISTINCT doc_id, doc_id // 10 AS b, length(text) AS size, 41 + CAST(doc_id % 10 AS INTEGER) AS p FROM documents) i ON b = batch AND p = page GROUP BY batch, page""")
def provenance_relative(s, d):
    """Items whose pages count from 1 within a batch of pages 41 to 50."""
    items = table(s, d, "documents").select(
        F.expr("doc_id div 10").alias("batch"), F.col("doc_id").alias("item"), F.lit("texts").alias("kind"), F.length("text").cast("long").alias("size"),
        F.array((F.col("doc_id") % 10 + 1).cast("int")).alias("pages"), F.lit(41).alias("start"), F.lit(50).alias("end"),
    )
    return audit.page_counts(items).select("batch", F.col("page").cast("long").alias("page"), "text_chars")


# Contents and trees

@query(O.PAGES, body="""SELECT book, first_page, last_page, n_pages FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n_pages DESC, first_page) AS rank FROM (SELECT book, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS n_pages
 FROM (SELECT book, page_no, page_no - row_number() OVER (PARTITION BY book ORDER BY page_no) AS island FROM pages_v WHERE len(string_split(text, chr(10))) >= 5) x GROUP BY book, island) y WHERE n_pages >= 2) z WHERE rank = 1""")
def toc_runs(s, d):
    return trees.contents_runs(V.pages(s, d).withColumn("hit", F.size(F.split("text", "\n")) >= 5))


@query(O.PAGES, body="SELECT book, page_no, chapter FROM (SELECT *, lag(chapter) OVER (PARTITION BY book ORDER BY page_no) AS b FROM pages_v) x WHERE b IS DISTINCT FROM chapter")
def header_changes(s, d):
    return trees.change_points(V.pages(s, d).select("book", "page_no", "chapter"), "chapter")


OFFSETS = "o AS (SELECT book, page_no AS ord, CAST(1 + (doc_id * 7) % 9 AS INTEGER) AS diff FROM pages_v)"


def _offsets(s, d):
    return V.pages(s, d).select("book", F.col("page_no").alias("ord"), ((F.col("doc_id") * 7) % 9 + 1).cast("int").alias("diff"))


@query(O.PAGES, OFFSETS, body='SELECT book, diff AS "offset" FROM (SELECT book, diff, row_number() OVER (PARTITION BY book ORDER BY diff) - 1 AS r, count(*) OVER (PARTITION BY book) AS n FROM o) x WHERE r = n // 2')
def offset_upper_median(s, d):
    return trees.upper_median(_offsets(s, d), "diff")


@query(O.PAGES, OFFSETS, body='SELECT book, diff AS "offset", n FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, f) AS r FROM (SELECT book, diff, count(*) AS n, min(ord) AS f FROM o GROUP BY book, diff) x) y WHERE r = 1')
def offset_mode(s, d):
    return trees.mode_first(_offsets(s, d), "diff", "ord")


@query(O.ORDERED, body="""SELECT t.book, t.ord, t.page, min(p.page_no) AS found_page, min(p.page_no) - t.page AS diff FROM (SELECT book, ord, title, CAST(physical_index - 2 AS INTEGER) AS page FROM toc_o WHERE depth = 2) t
 JOIN pages_v p ON p.book = t.book AND p.page_no BETWEEN t.page - 5 AND t.page + 6 AND contains(lower(p.text), lower(substr(t.title, 1, 25))) GROUP BY t.book, t.ord, t.page""")
def title_locate(s, d):
    titles = _ordered(s, d).filter("depth = 2").select("book", "ord", "title", (F.col("physical_index") - 2).cast("int").alias("page"))
    return trees.locate_titles(titles, V.pages(s, d))


def _ordered(s, d):
    order = W.partitionBy("book").orderBy("physical_index", "depth", "structure")
    return V.toc_items(s, d).withColumn("ord", F.row_number().over(order).cast("int"))


@query(O.ORDERED, body="""SELECT t.book, ord, CAST(coalesce(lead(physical_index) OVER w - CASE WHEN lead(appear_start) OVER w = 'yes' THEN 1 ELSE 0 END, m) AS INTEGER) AS end_index
 FROM toc_o t JOIN (SELECT book, max(page_no) AS m FROM pages_v GROUP BY book) p ON p.book = t.book WINDOW w AS (PARTITION BY t.book ORDER BY ord)""")
def toc_end_index(s, d):
    last = V.pages(s, d).groupBy("book").agg(F.max("page_no").alias("last_page"))
    return trees.flat_ends(_ordered(s, d), last).select("book", "ord", "end_index")


@query(O.ORDERED, body="""SELECT c.book, c.ord, c.structure, max(p.ord) AS parent_ord FROM toc_o c LEFT JOIN toc_o p ON p.book = c.book AND contains(c.structure, '.') AND p.structure = regexp_replace(c.structure, '\\.[^.]*$', '') AND p.ord < c.ord GROUP BY ALL""".replace("\\\\", "\\"))
def tree_prefix_parent(s, d):
    return trees.prefix_parents(_ordered(s, d))


PATHS = "paths AS (SELECT *, list_transform(string_split(structure, '.'), lambda x: CAST(x AS INTEGER)) AS path FROM toc_o)"


def _paths(s, d):
    return _ordered(s, d).withColumn("path", F.transform(F.split("structure", r"\."), lambda x: x.cast("int")))


@query(O.ORDERED, PATHS, body="SELECT book, structure, lpad(CAST(row_number() OVER (PARTITION BY book ORDER BY path) AS VARCHAR), 4, '0') AS node_id FROM paths")
def tree_node_ids_dfs(s, d):
    return trees.number_nodes(_paths(s, d), ["path"]).select("book", "structure", "node_id")


@query(O.ORDERED, PATHS, body="SELECT book, structure, lpad(CAST(row_number() OVER (PARTITION BY book ORDER BY depth, path) AS VARCHAR), 4, '0') AS node_id FROM paths")
def tree_node_ids_bfs(s, d):
    return trees.number_nodes(_paths(s, d), ["depth", "path"]).select("book", "structure", "node_id")


SIBLINGS = r"""nodes AS (SELECT o.*, CASE WHEN depth = 1 THEN '' ELSE regexp_replace(structure, '\.[^.]*$', '') END AS parent FROM toc_o o),
 nexts AS (SELECT *, lead(physical_index) OVER (PARTITION BY book, parent ORDER BY ord) AS after FROM nodes),
 e1 AS (SELECT n.*, greatest(physical_index, coalesce(after - 1, m)) AS end_index FROM nexts n JOIN (SELECT book, max(page_no) AS m FROM pages_v GROUP BY book) p ON p.book = n.book WHERE depth = 1),
 e2 AS (SELECT n.*, greatest(n.physical_index, coalesce(n.after - 1, p.end_index)) AS end_index FROM nexts n JOIN e1 p ON p.book = n.book AND p.structure = n.parent WHERE n.depth = 2),
 e3 AS (SELECT n.*, greatest(n.physical_index, coalesce(n.after - 1, p.end_index)) AS end_index FROM nexts n JOIN e2 p ON p.book = n.book AND p.structure = n.parent WHERE n.depth = 3),
 ends AS (SELECT book, structure, depth, title, parent, ord, physical_index AS start_index, CAST(end_index AS INTEGER) AS end_index FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3) x)"""


def _sibling_nodes(s, d):
    last = V.pages(s, d).groupBy("book").agg(F.max("page_no").cast("int").alias("last_page"))
    ordered = Workspace(s, "nodes").write(_ordered(s, d).withColumnRenamed("physical_index", "start_index"), "ordered")  # read once a depth
    return Workspace(s, "nodes").write(trees.sibling_ends(ordered, last), "ends")


@query(O.ORDERED, SIBLINGS, body="SELECT book, structure, start_index, end_index FROM ends")
def sibling_end_index(s, d):
    return _sibling_nodes(s, d).select("book", "structure", "start_index", "end_index")


#: Faults by book, so that each rule of validation finds some: the same expressions on nodes and totals in both engines.
FAULTY = {
    "title": "CASE WHEN right(book, 1) = '2' AND ord = 4 THEN ' ' ELSE title END",
    "end_index": "CASE WHEN right(book, 1) = '6' AND ord = 3 THEN start_index - 1 WHEN right(book, 1) = '9' AND depth > 1 THEN end_index + 200 ELSE end_index END",
}
KEPT_NODES = "right(book, 1) <> '5' AND NOT (right(book, 1) = '0' AND structure >= '3')"
PAGE_TOTALS = "CASE WHEN right(book, 1) = '8' THEN n * 2 ELSE n END"


@query(O.ORDERED, SIBLINGS, f"""faulty AS (SELECT book, structure, parent, depth, ord, start_index, {FAULTY["title"]} AS title, {FAULTY["end_index"]} AS end_index FROM ends WHERE {KEPT_NODES}),
 totals AS (SELECT book, {PAGE_TOTALS} AS n FROM (SELECT book, count(*) AS n FROM pages_v GROUP BY book) x WHERE right(book, 1) <> '4'),
 marked AS (SELECT f.*, n, NOT EXISTS (SELECT 1 FROM faulty c WHERE c.book = f.book AND c.parent = f.structure) AS leaf FROM faulty f LEFT JOIN totals t ON t.book = f.book),
 m AS (SELECT book, count(*) FILTER (depth = 1) AS a, count(*) FILTER (trim(title) = '') AS b, count(*) FILTER (end_index < start_index) AS c, count(*) FILTER (leaf AND end_index - start_index + 1 > greatest(150, coalesce(floor(n * 0.15::DOUBLE), 0))) AS dd,
  max(end_index) FILTER (depth = 1) - min(start_index) FILTER (depth = 1) + 1 AS covered FROM marked GROUP BY book)""",
 body="""SELECT book, reasons = '' AS ok, reasons FROM (SELECT book, CASE WHEN coalesce(a, 0) = 0 THEN 'empty_structure' ELSE array_to_string(list_filter([CASE WHEN a < 3 THEN 'few_top_nodes' END, CASE WHEN b > 0 THEN 'empty_titles' END, CASE WHEN n IS NULL THEN 'no_page_count' END, CASE WHEN c > 0 THEN 'reversed_span' END, CASE WHEN dd > 0 THEN 'wide_leaf' END, CASE WHEN covered::DOUBLE / n < 0.85 THEN 'low_coverage' END], lambda x: x IS NOT NULL), ';') END AS reasons
 FROM m FULL JOIN totals USING (book)) y""")
def tree_validate(s, d):
    totals = V.pages(s, d).groupBy("book").agg(F.count(F.lit(1)).alias("n")).filter("right(book, 1) <> '4'").select("book", F.expr(PAGE_TOTALS).alias("n_pages"))
    nodes = _sibling_nodes(s, d).filter(KEPT_NODES).select("book", "structure", "parent", "depth", "ord", "start_index", *[F.expr(e).alias(c) for c, e in FAULTY.items()])
    return trees.validate(trees.with_leaves(nodes), totals)


@query(O.ORDERED, body=r"""SELECT t.book AS doc, t.depth, CASE t.depth WHEN 1 THEN t.title WHEN 2 THEN p.title || ' > ' || t.title ELSE g.title || ' > ' || p.title || ' > ' || t.title END AS crumb, t.physical_index AS start_index FROM toc_o t
 LEFT JOIN toc_o p ON p.book = t.book AND t.depth > 1 AND p.structure = regexp_replace(t.structure, '\.[^.]*$', '') LEFT JOIN toc_o g ON g.book = t.book AND t.depth = 3 AND g.structure = string_split(t.structure, '.')[1]""")
def tree_flatten(s, d):
    """Nested JSON trees, built from the contents and flattened again by recursion."""
    items = _paths(s, d)
    part = lambda i: F.get("path", F.lit(i))
    keep = ["title", F.col("physical_index").alias("start_index")]
    level = lambda n, *more: items.filter(f"depth = {n}").select("book", *[part(i).alias("cde"[i]) for i in range(n)], *keep, *more)
    deep = level(3).groupBy("book", "c", "d").agg(F.sort_array(F.collect_list(F.struct("e", "title", "start_index"))).alias("nodes"))
    low = level(2).join(deep, ["book", "c", "d"], "left").groupBy("book", "c").agg(F.sort_array(F.collect_list(F.struct("d", "title", "start_index", "nodes"))).alias("nodes"))
    nested = level(1).join(low, ["book", "c"]).groupBy("book").agg(F.sort_array(F.collect_list(F.struct("c", "title", "start_index", "nodes"))).alias("structure"))
    made = nested.select(F.col("book").alias("doc"), F.to_json(F.struct("structure")).alias("tree"))
    return trees.flatten_trees(s, made).select("doc", "depth", "crumb", "start_index")


@query(O.ORDERED, SIBLINGS, "wide AS (SELECT * FROM ends WHERE end_index - start_index + 1 >= 2)", body=r"""SELECT e.book AS doc, e.structure, coalesce(a.structure, b.structure, c.structure) AS climbed FROM ends e LEFT JOIN wide a ON a.book = e.book AND a.structure = e.structure
 LEFT JOIN wide b ON b.book = e.book AND e.depth > 1 AND b.structure = regexp_replace(e.structure, '\.[^.]*$', '') LEFT JOIN wide c ON c.book = e.book AND e.depth = 3 AND c.structure = string_split(e.structure, '.')[1]""")
def ancestor_climb(s, d):
    nodes = _sibling_nodes(s, d).select(F.col("book").alias("doc"), F.split("structure", r"\.").alias("path"), "start_index", "end_index")
    return trees.climb(nodes).select("doc", F.concat_ws(".", "path").alias("structure"), F.when(F.col("climbed").isNotNull(), F.concat_ws(".", "climbed")).alias("climbed"))


@query(O.ORDERED, SIBLINGS, body="""SELECT book, structure FROM (SELECT *, count(*) FILTER (end_index - start_index + 1 >= 2) OVER (PARTITION BY book) AS n FROM ends) x WHERE n = 0 OR end_index - start_index + 1 >= 2""")
def candidate_nodes(s, d):
    wide = F.col("end_index") - F.col("start_index") + 1 >= 2
    n = F.count_if(wide).over(W.partitionBy("book"))
    return _sibling_nodes(s, d).withColumn("n", n).filter((F.col("n") == 0) | wide).select("book", "structure")


@query(O.ORDERED, SIBLINGS, body="""SELECT e.structure AS span_id, e.book, string_agg(p.text, chr(10) ORDER BY p.page_no) AS text FROM ends e JOIN pages_v p ON p.book = e.book AND p.page_no BETWEEN e.start_index AND least(e.end_index, e.start_index + 3) WHERE e.depth = 1 GROUP BY e.structure, e.book""")
def page_range_text(s, d):
    spans = _sibling_nodes(s, d).filter("depth = 1").select(F.col("structure").alias("span_id"), "book", "start_index", "end_index")
    return trees.range_text(spans, V.pages(s, d))


# Sections and chunks

@query(O.RECORDS, body="""SELECT book, rec_no, CAST(sum(CASE WHEN label = 'section_header' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS section_no, last_value(CASE WHEN label = 'section_header' THEN rec_no END IGNORE NULLS) OVER w AS parent_rec
 FROM records_v WINDOW w AS (PARTITION BY book ORDER BY rec_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def sections(s, d):
    return audit.sections(V.records(s, d)).select("book", "rec_no", "section_no", "parent_rec")


def _chunks(s, d):
    return chunks.pack(V.records(s, d), F.concat("chapter", F.lit(" > "), "text"))


@query(O.CHUNKS, body="SELECT book, ordinal, label, chapter, heading, parent_id, text, page_start, page_end, n_tokens, reference_path FROM chunk_v")
def chunk_pack(s, d):
    return _chunks(s, d).select("book", "ordinal", "label", "chapter", "heading", "parent_id", "text", "page_start", "page_end", "n_tokens", "reference_path")


@query(O.CHUNKS, body="""SELECT c.chunk_id, p.id AS source_id, p.page_no AS page, CAST(p.until - length(p.part) - 2 * (nth - 1) + 2 * (nth - 1) AS INTEGER) AS start, CAST(p.until AS INTEGER) AS "end", p.part
 FROM (SELECT *, row_number() OVER w AS nth, sum(length(part)) OVER w + 2 * (row_number() OVER w - 1) AS until FROM part_v WINDOW w AS (PARTITION BY book, run, g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) p JOIN chunk_v c USING (book, run, g)""")
def chunk_spans(s, d):
    each = _chunks(s, d).select("chunk_id", "text", F.explode("spans").alias("s"))
    return each.select("chunk_id", "s.source_id", "s.page", "s.start", F.col("s.end").alias("end"), F.expr("substr(text, s.start + 1, s.`end` - s.start)").alias("part"))


@query(O.CHUNKS, body="SELECT chunk_id, CAST('0x' || substr(chunk_id, 1, 15) AS BIGINT) AS point_id, book, ordinal FROM chunk_v")
def chunk_ids(s, d):
    return _chunks(s, d).select("chunk_id", X.point_id(F.col("chunk_id")).alias("point_id"), "book", "ordinal")


GROUPED = """sized AS (SELECT book, page_no, CAST(ceil(strlen(text) / 2.0) + 2 AS BIGINT) AS n, sum(CAST(ceil(strlen(text) / 2.0) + 2 AS BIGINT)) OVER (PARTITION BY book) AS total FROM pages_v),
 aimed AS (SELECT *, CASE WHEN total <= 2000 THEN total ELSE ceil((ceil(total / ceil(total / 2000.0)) + 2000) / 2.0) END AS target FROM sized),
 walk AS (WITH RECURSIVE w AS (SELECT book, page_no, n AS used, 0 AS g FROM aimed WHERE page_no = 1 UNION ALL SELECT a.book, a.page_no, CASE WHEN w.used > 0 AND w.used + a.n > a.target THEN a.n ELSE w.used + a.n END, w.g + CASE WHEN w.used > 0 AND w.used + a.n > a.target THEN 1 ELSE 0 END FROM w JOIN aimed a ON a.book = w.book AND a.page_no = w.page_no + 1) SELECT * FROM w)"""


@query(O.PAGES, GROUPED, body="SELECT book, page_no, g AS group_no FROM walk")
def page_groups(s, d):
    return chunks.page_groups(V.pages(s, d).select("book", "page_no", X.token_estimate(F.col("text")).alias("n_tokens")))


@query(O.PAGES, body="""SELECT book, page_no, CAST(u.pos - 1 AS INTEGER) AS item_no, '- ' || trim(u.line) AS text FROM (SELECT * FROM pages_v WHERE contains(text, chr(10))) p, unnest(list_filter(string_split(p.text, chr(10)), lambda x: trim(x) <> '')) WITH ORDINALITY u(line, pos)""")
def list_explode(s, d):
    merged = V.pages(s, d).filter(F.col("text").contains("\n")).withColumn("label", F.lit("list"))
    return audit.explode_lists(merged).select("book", "page_no", "item_no", "text")


# Answers

@query(O.CLAIMS, body="SELECT claim_id, evidence_id, quote FROM claims_v JOIN documents d ON d.doc_id = evidence_id WHERE length(quote) >= 12 AND contains(d.text, quote)")
def quote_admission(s, d):
    evidence = table(s, d, "documents").select(F.col("doc_id").alias("evidence_id"), "text")
    return answers.admit(V.claims(s, d), evidence).select("claim_id", "evidence_id", "quote")


CITED = """cited AS (SELECT claim_id, CASE WHEN contains(substr(text, 1, 30), quote) THEN 1 WHEN contains(substr(text, 31), quote) THEN 2 END AS source_id FROM claims_v JOIN documents d ON d.doc_id = evidence_id)"""


def _cited(s, d):
    end = F.length("text")
    spans = F.array(F.struct(F.lit(1).alias("source_id"), F.lit(0).alias("start"), F.lit(30).alias("end")), F.struct(F.lit(2).alias("source_id"), F.lit(30).alias("start"), end.alias("end")))
    return answers.cite(V.claims(s, d).withColumnRenamed("evidence_id", "chunk_id"), table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", spans.alias("source_spans")))


@query(O.CLAIMS, CITED, body="SELECT claim_id, source_id FROM cited WHERE source_id IS NOT NULL")
def span_citation(s, d):
    return _cited(s, d).select("claim_id", F.col("span.source_id").alias("source_id"))


@query(O.CLAIMS, CITED, body="SELECT round(avg(CASE WHEN source_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS valid_rate, count(*) AS n_claims FROM cited")
def citation_validity(s, d):
    flagged = V.claims(s, d).select("claim_id").join(_cited(s, d).select("claim_id", F.lit(1.0).alias("ok")), "claim_id", "left")
    return flagged.agg(F.round(F.avg(F.coalesce("ok", F.lit(0.0))), 6).alias("valid_rate"), F.count(F.lit(1)).alias("n_claims"))


@query(O.CLAIMS, CITED, body="SELECT source, claim_id, 'E' || row_number() OVER (PARTITION BY source ORDER BY claim_id) AS citation FROM cited JOIN documents d ON d.doc_id = claim_id WHERE source_id IS NOT NULL")
def citation_renumber(s, d):
    own = table(s, d, "documents").select(F.col("doc_id").alias("claim_id"), "source")
    return answers.renumber(_cited(s, d).select("claim_id").join(own, "claim_id"), "source", "claim_id").select("source", "claim_id", "citation")


@query(body="SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'answered' ELSE 'insufficient_evidence' END AS status FROM labels")
def answer_admission(s, d):
    return table(s, d, "labels").select("doc_id", answers.answer_status(F.lit(True), F.col("quality") == 1, F.col("toxic") == 1).alias("status"))


# Ingest and health

SOURCES = "src AS (SELECT source AS book, sum(n_chars) AS source_sha FROM documents GROUP BY source)"


@query(SOURCES, body="SELECT book, CAST(source_sha AS BIGINT) AS source_sha, '1' AS settings FROM src WHERE NOT (substr(book, length(book)) IN ('1', '3'))")
def ingest_antijoin(s, d):
    sources = table(s, d, "documents").groupBy(F.col("source").alias("book")).agg(F.sum("n_chars").alias("source_sha")).withColumn("settings", F.lit("1"))
    return answers.to_ingest(sources, sources.filter(F.substring("book", -1, 1).isin("1", "3")))


@query(body="SELECT count(DISTINCT source) AS books, count(*) AS chunks, CASE WHEN count(*) = 0 THEN 'index_missing' WHEN count(DISTINCT source) >= 20 THEN 'ready' ELSE 'index_outdated' END AS status FROM documents")
def health_status(s, d):
    n = table(s, d, "documents").agg(F.count_distinct("source").alias("books"), F.count(F.lit(1)).alias("chunks"))
    return n.withColumn("status", F.when(F.col("chunks") == 0, "index_missing").when(F.col("books") >= 20, "ready").otherwise("index_outdated"))


@query(body="SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def batch_status_summary(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(O.PAGES, body="""SELECT book, CAST(start AS INTEGER) AS start, CAST(least(start + 39, m) AS INTEGER) AS "end", printf('pages-%05d-%05d', start, least(start + 39, m)) AS name FROM (SELECT book, m, unnest(range(1, m + 1, 40)) AS start FROM (SELECT book, max(page_no) AS m FROM pages_v GROUP BY book) x) y""")
def page_batches(s, d):
    return answers.page_batches(V.pages(s, d).groupBy("book").agg(F.lit(1).alias("first_page"), F.max("page_no").alias("last_page")))
