"""DuckDB SQL of the views, to be put before the SQL of a query."""

PAGES = "pages_v AS (SELECT source AS book, CAST(row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS INT) AS page_no, doc_id, lang AS chapter, text FROM documents)"
RECORDS = PAGES + """, line_v AS (SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY page_no, pos) AS INT) - 1 AS rec_no, doc_id, page_no, chapter, pos, line, doc_id * 3 + pos AS i,
 CASE WHEN pos = 0 AND n_lines > 1 THEN 'section_header' ELSE CASE (doc_id * 3 + pos) % 17 WHEN 5 THEN 'table' WHEN 6 THEN 'caption' WHEN 9 THEN 'list' WHEN 12 THEN 'footnote' WHEN 14 THEN 'formula' ELSE 'text' END END AS label
 FROM (SELECT p.*, CAST(u.pos - 1 AS INT) AS pos, u.line, len(string_split(p.text, chr(10))) AS n_lines FROM pages_v p, unnest(string_split(p.text, chr(10))) WITH ORDINALITY u(line, pos)) x),
 records_v AS (SELECT book, rec_no, book || '#' || rec_no AS id, doc_id, CAST(CASE WHEN i % 41 = 7 THEN NULL WHEN i % 53 = 8 THEN page_no - 3 ELSE page_no END AS INT) AS page_no, chapter, pos, label,
 CASE WHEN label = 'section_header' THEN CAST(1 + doc_id % 3 AS INT) END AS level,
 CASE WHEN label = 'table' AND i % 2 = 0 THEN '| ' || line || ' |' || chr(10) || '|---|' WHEN label = 'list' THEN replace(line, '. ', chr(10) || '- ') ELSE line END AS text FROM line_v)"""
TOC = PAGES + """, toc_r AS (SELECT book, chapter, page_no, doc_id, dense_rank() OVER (PARTITION BY book ORDER BY chapter) c, row_number() OVER (PARTITION BY book, chapter ORDER BY page_no) d, substr(text, 1, 60) t, substr(text, 61, 30) u FROM pages_v),
 toc_v AS (SELECT book, CAST(c AS VARCHAR) AS structure, 1 AS depth, chapter AS title, min(page_no) AS physical_index, 'yes' AS appear_start FROM toc_r GROUP BY book, c, chapter
 UNION ALL SELECT book, c || '.' || d, 2, t, page_no, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END FROM toc_r
 UNION ALL SELECT book, c || '.' || d || '.' || e, 3, u, CAST(page_no + e - 1 AS INTEGER), CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END FROM toc_r, unnest([1, 2]) AS x(e) WHERE doc_id % 3 = 0)"""
ORDERED = TOC + """, toc_o AS (SELECT *, CAST(row_number() OVER (PARTITION BY book ORDER BY physical_index, depth, structure) AS INT) AS ord FROM toc_v)"""
CLAIMS = "claims_v AS (SELECT doc_id AS claim_id, doc_id AS evidence_id, CASE WHEN doc_id % 5 = 0 THEN reverse(substr(text, 1, 40)) ELSE substr(text, CAST(1 + doc_id % 17 AS INT), 40) END AS quote FROM documents)"
HTML = """blocks_v AS (SELECT page_id, CAST(u.pos - 1 AS INT) AS pos, t.tags[u.pos] AS tag, u.block AS text FROM (SELECT page_id, regexp_extract_all(html, '<(h1|p|li)>(?:<[a-z][^>]*>)*([^<]*)', 1) AS tags, regexp_extract_all(html, '<(h1|p|li)>(?:<[a-z][^>]*>)*([^<]*)', 2) AS blocks FROM pages) t, unnest(t.blocks) WITH ORDINALITY u(block, pos))"""
BM25 = r"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
 sizes AS (SELECT count(*) AS n, avg(CAST(len(t) AS DOUBLE)) AS avgdl FROM d),
 asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark),
 tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) x WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 hits AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term) CROSS JOIN sizes GROUP BY query_id, doc_id)"""


def with_views(*views: str, body: str) -> str:
    return "WITH " + ", ".join(views) + " " + body
PRINTED = PAGES + """, heads_v AS (SELECT p.*, CASE WHEN letters = '' THEN 'UNTITLED' ELSE upper(letters) END AS head FROM (SELECT *, trim(regexp_replace(substr(text, 1, 30), '[^A-Za-z ]', '', 'g'), ' ') AS letters FROM pages_v) p),
 entries_v AS (SELECT book, 3 + ((page_no - 6) // 8) AS page_no, string_agg(page_no || '. ' || head || ' ..... ' || (page_no - 3), chr(10) ORDER BY page_no) AS entries FROM heads_v WHERE page_no BETWEEN 6 AND 29 GROUP BY 1, 2),
 printed_v AS (SELECT h.book, h.page_no, h.doc_id, h.chapter, h.head, CASE WHEN entries IS NOT NULL THEN 'Contents' || chr(10) || entries ELSE head || ' ' || (h.page_no - 3) || chr(10) || 'CHAPTER ' || h.page_no || chr(10) || chr(10) || head || chr(10) || 'OUTLINE' || chr(10)
  || CASE WHEN h.page_no % 4 = 0 THEN 'PART ' || (h.page_no % 5 + 1) || ': ' || substr(head, 1, 12) || chr(10) ELSE '' END || text END AS text FROM heads_v h LEFT JOIN entries_v e ON e.book = h.book AND e.page_no = h.page_no)"""
LINES = PRINTED + """, lines_v AS (SELECT book, page_no, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS each, text FROM printed_v)"""
CONTENTS = LINES + r""", hit_v AS (SELECT book, page_no, text FROM lines_v WHERE page_no <= 45 AND len(list_filter(each, lambda x: regexp_matches(x, '[\s.]+\d{1,4}\s*$'))) >= 5),
 runs_v AS (SELECT book, min(page_no) AS first_page, string_agg(text, chr(10) ORDER BY page_no) AS text, count(*) AS n FROM (SELECT *, page_no - row_number() OVER (PARTITION BY book ORDER BY page_no) AS island FROM hit_v) x GROUP BY book, island HAVING count(*) >= 2),
 contents_v AS (SELECT * FROM runs_v QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC, first_page) = 1),
 raw_entries_v AS (SELECT book, CAST(u.pos - 1 AS INT) AS pos, u.title, CAST(t.numbers[u.pos] AS INT) AS printed FROM (SELECT book, regexp_extract_all(text, '(?im)^(?:Chapter\s+\d+|Part\s+[IVX\d]+|\d+[\.\)]?)\s+([A-Z][^\r\n]{2,60}?)[\.\s]+(\d{1,4})\s*$', 1) AS titles,
  regexp_extract_all(text, '(?im)^(?:Chapter\s+\d+|Part\s+[IVX\d]+|\d+[\.\)]?)\s+([A-Z][^\r\n]{2,60}?)[\.\s]+(\d{1,4})\s*$', 2) AS numbers FROM contents_v) t, unnest(t.titles) WITH ORDINALITY u(title, pos))"""
SPANS = PAGES + """, spans_v AS (SELECT book, page_no, CAST(u.pos - 1 AS INT) AS line, p.doc_id + u.pos - 1 AS i, u.raw FROM pages_v p, unnest(string_split(p.text, chr(10))) WITH ORDINALITY u(raw, pos)),
 sized_v AS (SELECT book, page_no, line, CASE WHEN i % 9 = 0 THEN i || '. ' ELSE '' END || upper(substr(raw, 1, 1)) || substr(raw, 2) AS text, CASE WHEN i % 11 = 0 THEN 17.0 WHEN i % 5 = 0 THEN 12.5 ELSE 10.0 END::DOUBLE AS size, (i % 50) * 20.0 AS y0 FROM spans_v)"""


def median(diffs: str) -> str:
    """SQL of the upper median of (book, diff) rows."""
    return f'SELECT book, diff AS "offset" FROM (SELECT book, diff, row_number() OVER (PARTITION BY book ORDER BY diff) - 1 AS r, count(*) OVER (PARTITION BY book) AS n FROM ({diffs}) d) x WHERE r = n // 2'


def _tokens(n: str) -> str:
    return f"(ceil(({n}) / 2.0) + 2)"


#: Chunks by recursion over words and over pieces, where words fit the budget: chunk_v (book, ordinal, chunk_id, ...) and part_v (a row a piece of a chunk).
CHUNKS = RECORDS + rf""", headed_v AS (SELECT *, coalesce(last_value(CASE WHEN label = 'section_header' THEN chapter || ' > ' || text END IGNORE NULLS) OVER w, '') AS heading, last_value(CASE WHEN label = 'section_header' THEN id END IGNORE NULLS) OVER w AS parent_id,
  lag(struct_pack(p := page_no)) OVER (PARTITION BY book ORDER BY rec_no) AS before FROM records_v WINDOW w AS (PARTITION BY book ORDER BY rec_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 run_v AS (SELECT *, sum(CASE WHEN label = 'section_header' OR before IS NULL OR before.p IS DISTINCT FROM page_no THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY rec_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM headed_v),
 room_v AS (SELECT *, 2 * (510 - {_tokens("strlen(allowed) + 1")}) AS room FROM (SELECT *, CASE WHEN 512 - {_tokens("strlen(heading) + 1")} >= 64 THEN heading ELSE right(heading, 100) END AS allowed FROM run_v WHERE label <> 'section_header') x),
 unit_v AS (SELECT book, rec_no, room, u.unit, u.spot FROM room_v, unnest(string_split(replace(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1))) WITH ORDINALITY u(unit, spot) WHERE u.unit <> ''),
 word_v AS (SELECT book, rec_no, room, spot, 1 AS nth, unit AS part FROM unit_v WHERE strlen(unit) <= room UNION ALL SELECT book, rec_no, room, spot, w.nth, w.part FROM unit_v, unnest(regexp_extract_all(unit, '\S+\s*')) WITH ORDINALITY w(part, nth) WHERE strlen(unit) > room),
 atom_v AS (SELECT book, rec_no, room, part, strlen(part) AS n, row_number() OVER (PARTITION BY book, rec_no ORDER BY spot, nth) AS k FROM word_v),
 dealt_v AS (WITH RECURSIVE w AS (SELECT book, rec_no, k, n AS used, 0 AS g FROM atom_v WHERE k = 1 UNION ALL SELECT w.book, w.rec_no, a.k, CASE WHEN w.used + a.n > a.room THEN a.n ELSE w.used + a.n END, w.g + CASE WHEN w.used + a.n > a.room THEN 1 ELSE 0 END FROM w JOIN atom_v a ON a.book = w.book AND a.rec_no = w.rec_no AND a.k = w.k + 1) SELECT * FROM w),
 text_v AS (SELECT book, rec_no, g, regexp_replace(string_agg(part, '' ORDER BY k), '^\s+|\s+$', '', 'g') AS piece FROM dealt_v JOIN atom_v USING (book, rec_no, k) GROUP BY book, rec_no, g),
 piece_v AS (SELECT r.book, r.run, r.rec_no, r.id, r.label, r.page_no, r.chapter, r.parent_id, r.heading, r.allowed, r.text AS raw, coalesce(t.piece, '') AS piece, t.n IS NOT NULL AND t.n = 1 AS alone, r.label IN ('table', 'caption') AS apart,
  row_number() OVER (PARTITION BY r.book, r.run ORDER BY r.rec_no, t.g) AS k FROM room_v r LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY book, rec_no) AS n FROM text_v WHERE piece <> '') t ON t.book = r.book AND t.rec_no = r.rec_no),
 fold_v AS (WITH RECURSIVE f AS (SELECT book, run, k, 1 AS g, CASE WHEN piece = '' THEN 0 ELSE 1 END AS held, strlen(piece) AS used, heading AS first_heading, label AS first_label, alone AS first_alone, allowed AS last_allowed, apart FROM piece_v WHERE k = 1
  UNION ALL SELECT book, run, k, CASE WHEN quiet OR joins THEN g ELSE g + 1 END, CASE WHEN quiet THEN held WHEN piece = '' THEN 0 WHEN joins THEN held + 1 ELSE 1 END, CASE WHEN quiet THEN used WHEN joins THEN used + 2 + CASE WHEN p_apart THEN strlen(raw) ELSE strlen(piece) END ELSE strlen(piece) END,
   CASE WHEN quiet OR joins THEN first_heading ELSE heading END, CASE WHEN quiet OR joins THEN first_label ELSE label END, CASE WHEN quiet OR joins THEN first_alone ELSE alone END, CASE WHEN quiet THEN last_allowed ELSE allowed END, CASE WHEN quiet THEN apart ELSE p_apart END
   FROM (SELECT f.book, f.run, p.k, f.g, f.held, f.used, f.first_heading, f.first_label, f.first_alone, f.last_allowed, f.apart, p.heading, p.label, p.alone, p.allowed, p.apart AS p_apart, p.piece, p.raw, p.piece = '' AND (f.held = 0 OR NOT (f.apart OR p.apart)) AS quiet,
    p.piece <> '' AND f.held > 0 AND f.apart = p.apart AND CASE WHEN p.apart THEN f.first_alone AND p.alone AND f.first_label <> p.label AND f.held = 1 AND {_tokens("strlen(p.allowed) + 1 + f.used + 2 + strlen(p.raw)")} <= 512
     ELSE {_tokens("strlen(f.last_allowed) + 1 + f.used")} < 400 AND f.first_heading = p.allowed AND {_tokens("strlen(p.allowed) + 1 + f.used + 2 + strlen(p.piece)")} <= 400 END AS joins
    FROM f JOIN piece_v p ON p.book = f.book AND p.run = f.run AND p.k = f.k + 1) x) SELECT * FROM f),
 part_v AS (SELECT p.*, f.g, CASE WHEN p.apart AND f.held > 1 THEN p.raw ELSE p.piece END AS part FROM piece_v p JOIN fold_v f USING (book, run, k) WHERE p.piece <> ''),
 body_v AS (SELECT book, run, g, min(rec_no) AS rec_no, min(k) AS k, arg_min(label, k) AS label, arg_min(id, k) AS first_id, arg_min(chapter, k) AS chapter, arg_min(heading, k) AS heading, arg_min(parent_id, k) AS parent_id, string_agg(part, chr(10) || chr(10) ORDER BY k) AS text, min(page_no) AS page_start, max(page_no) AS page_end FROM part_v GROUP BY book, run, g),
 chunk_v AS (SELECT *, substr(sha1('1|' || book || '|' || first_id || '|' || ordinal), 1, 20) AS chunk_id, CAST({_tokens("strlen(heading) + 1 + strlen(text)")} AS BIGINT) AS n_tokens, regexp_matches(lower(heading), '\b(references?|bibliography)\b') AS reference_path FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY run, k) AS ordinal FROM body_v) x)"""


LAYOUT = PAGES + """, item_v AS (SELECT book AS batch, page_no, i, CASE WHEN i % 13 = 4 THEN 'tables' WHEN i % 13 = 7 THEN 'pictures' ELSE 'texts' END AS kind, CASE WHEN i % 19 = 3 THEN 'formula' ELSE 'text' END AS label, line,
  CASE WHEN i % 29 = 6 THEN []::INTEGER[] WHEN i % 31 = 8 THEN [page_no, page_no + 1] ELSE [page_no] END AS pages FROM (SELECT p.book, p.page_no, p.doc_id * 3 + u.pos - 1 AS i, u.line FROM pages_v p, unnest(string_split(p.text, chr(10))) WITH ORDINALITY u(line, pos)) x),
 content_v AS (SELECT *, CASE kind WHEN 'tables' THEN substr(line, 1, 40) WHEN 'pictures' THEN '' ELSE CASE WHEN i % 19 = 3 AND i % 2 = 0 THEN '' WHEN i % 23 = 5 THEN line || chr(65533) || ' GLYPH<1>' ELSE line END END AS content FROM item_v),
 batch_v AS (SELECT book AS batch, CASE WHEN right(book, 1) = '1' THEN 41 ELSE 1 END AS first, max(page_no) AS n FROM pages_v GROUP BY book),
 seen_v AS (SELECT b.batch, first, n, CASE WHEN first > 1 AND lo = 1 AND hi <= n THEN first - 1 ELSE 0 END AS shift FROM batch_v b JOIN (SELECT batch, min(p) AS lo, max(p) AS hi FROM (SELECT batch, unnest(pages) AS p FROM item_v) x GROUP BY batch) s USING (batch)),
 placed_v AS (SELECT c.*, first, n, shift, list_transform(c.pages, lambda p: p + shift) AS moved, len(c.pages) = 0 OR len(list_filter(c.pages, lambda p: p + shift < first OR p + shift >= first + n)) > 0 AS unmapped FROM content_v c JOIN seen_v USING (batch)),
 spread_v AS (SELECT batch, kind, label, content, unnest(list_distinct(moved)) AS page FROM placed_v WHERE NOT unmapped),
 grid_v AS (SELECT batch, unnest(range(first, first + n)) AS page FROM batch_v),
 counts_v AS (SELECT g.batch, g.page, CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS text_chars, count(*) FILTER (kind = 'texts') AS texts, count(*) FILTER (kind = 'tables') AS tables, count(*) FILTER (kind = 'pictures') AS pictures,
  CAST(coalesce(sum(length(content) - length(replace(content, chr(65533), '')) + (length(content) - length(replace(lower(content), 'glyph<', ''))) // 6), 0) AS BIGINT) AS encoding_artifacts, count(*) FILTER (kind = 'texts' AND label = 'formula' AND trim(content) = '') AS empty_formulas
  FROM grid_v g LEFT JOIN spread_v s ON s.batch = g.batch AND s.page = g.page GROUP BY g.batch, g.page),
 source_v AS (SELECT book AS batch, page_no + CASE WHEN right(book, 1) = '1' THEN 40 ELSE 0 END AS page, CASE WHEN doc_id % 10 = 3 THEN 5 ELSE CAST(length(text) * (doc_id % 4 + 1) AS INTEGER) END AS chars FROM pages_v WHERE right(book, 1) <> '7'),
 reason_v AS (SELECT *, list_filter([CASE WHEN empty_formulas > 0 THEN 'empty_formula_text' END, CASE WHEN tables > 0 THEN 'table_manual_review_required' END, CASE WHEN known AND coalesce(chars, 0) >= 300 AND text_chars < coalesce(chars, 0) * 0.45::DOUBLE THEN 'low_text_retention' END,
  CASE WHEN known AND coalesce(chars, 0) < 30 AND text_chars < 30 AND pictures > 0 THEN 'image_text_review' END, CASE WHEN encoding_artifacts > 0 THEN 'encoding_artifact' END, CASE WHEN texts + tables + pictures = 0 THEN 'no_mapped_elements' END], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT c.*, s.chars, c.batch IN (SELECT batch FROM source_v) AS known FROM counts_v c LEFT JOIN source_v s ON s.batch = c.batch AND s.page = c.page) x),
 report_v AS (SELECT b.batch, first, n, shift, unmapped, flagged, texts, tables, pictures, list_filter([CASE WHEN right(b.batch, 1) = '3' THEN 'page_count_mismatch' END, CASE WHEN right(b.batch, 1) = '7' THEN 'source_text_comparison_unavailable' END], lambda x: x IS NOT NULL) AS reasons FROM seen_v b
  JOIN (SELECT batch, count(*) FILTER (unmapped) AS unmapped FROM placed_v GROUP BY batch) u USING (batch) JOIN (SELECT batch, count(*) FILTER (len(reasons) > 0) AS flagged, CAST(sum(texts) AS BIGINT) AS texts, CAST(sum(tables) AS BIGINT) AS tables, CAST(sum(pictures) AS BIGINT) AS pictures FROM reason_v GROUP BY batch) r USING (batch))"""
