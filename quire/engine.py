"""A corpus on disk: ingest, index, retrieval, questions, audit and evaluation over its tables."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import asks_for_sources
from quire.operators import answers, audit, chunks, retrieval
from quire.providers import Provider, ask, structurally_valid
from quire.sources.files import append_rows, read_list_items, read_records, replace_books, write_report

#: Hits of each list, hits after fusion, chunks of an answer.
CANDIDATES, KEPT, LIMIT = 50, 25, 8
CASE = "array<struct<id:string,question:string,audience:string,refusal:boolean,book:string,pdf_page:int,source_id:string,anchors:array<struct<book:string,pdf_page:int,source_id:string>>>>"


class Corpus:
    """The tables of one corpus, below a folder.

    chunks (by book), registry (book, source_sha, settings, chunks), index/postings, terms
    and sizes, vectors (by book, if there is an encoder), traces and reports.
    """

    def __init__(self, spark: SparkSession, folder: str, models: dict | None = None):
        """models: names that go into the settings hash, and the functions `encode` (texts to unit vectors, as a pandas UDF) and `rerank` (Column of a question and of a text to a score)."""
        self.spark, self.folder = spark, folder.rstrip("/")
        models = models or {}
        self.encode, self.rerank = models.get("encode"), models.get("rerank")
        self.names = {k: v for k, v in models.items() if isinstance(v, str)}

    def settings(self, dense: bool | None = None) -> str:
        """16 hex digits that name everything an index depends on."""
        dense = bool(self.encode) if dense is None else dense
        named = json.dumps({"chunk": chunks.VERSION, "dense": dense, **self.names}, sort_keys=True)
        return hashlib.sha256(named.encode()).hexdigest()[:16]

    def _table(self, name: str) -> DataFrame | None:
        """A table, or none if it was never written."""
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except Exception as error:  # noqa: BLE001  Spark wraps a missing folder in its own class
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            return None

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/chunks")

    # Ingest

    def pending(self, records: str, books: list[str] | None = None, force: bool = False) -> DataFrame:
        """(book, source_sha, settings) of record files whose content and settings are not registered yet."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(records)
        name = F.regexp_extract(F.url_decode("path"), r"([^/]+)\.jsonl$", 1)
        found = found.select(name.alias("book"), F.sha2("content", 256).alias("source_sha"), F.lit(self.settings()).alias("settings"))
        if books:
            wanted = self.spark.createDataFrame([(b.lower(),) for b in books], "name string")
            missing = [r["name"] for r in wanted.join(found, F.lower("book") == F.col("name"), "left_anti").collect()]  # a row a name asked for
            if missing:
                raise ValueError(f"no records of {sorted(missing)}")
            found = found.join(F.broadcast(wanted), F.lower("book") == F.col("name"), "left_semi")
        registry = self._table("registry")
        return found if force or registry is None else answers.to_ingest(found, registry)

    def ingest(self, records: str, books: list[str] | None = None, dense: bool = True, force: bool = False, raw: str | None = None, min_page: dict[str, int] | None = None) -> int:
        """Take in record files that are new or changed, replacing their books; the registry comes last. Returns the number of books taken in.

        raw: folder of layout files, from which merged list items get pages of their own;
        min_page: first pages of books whose front matter is not marked.
        """
        due = self.pending(records, books, force)
        due = self.spark.createDataFrame(due.collect(), due.schema)  # a row a book file
        n = due.count()
        if not n:
            return 0
        self._unregister(due)
        rows = read_records(self.spark, records).join(F.broadcast(due.select("book")), "book", "left_semi")
        limits = self.spark.createDataFrame(list((min_page or {}).items()), "book string, min_page int")
        rows = audit.minimum_page(rows, limits).withColumn("page_end", F.col("page_no"))
        rows = self._listed(rows, raw)
        packed = chunks.pack(rows.withColumnRenamed("heading_path_str", "heading"))
        replace_books(packed, f"{self.folder}/chunks")
        own = self.chunks().join(F.broadcast(due.select("book")), "book", "left_semi")
        if self.encode and dense:
            vectors = own.select("book", "chunk_id", self.encode(F.concat_ws("\n", "heading", "text")).alias("vector"))
            replace_books(vectors, f"{self.folder}/vectors")
        done = due.join(own.groupBy("book").agg(F.count(F.lit(1)).alias("chunks")), "book", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
        replace_books(done.withColumn("settings", F.lit(self.settings(bool(self.encode) and dense))), f"{self.folder}/registry")
        self.index()
        return n

    def _unregister(self, due: DataFrame) -> None:
        """Take books off the registry first, so that an ingest that breaks off is taken up again."""
        registry = self._table("registry")
        if registry is not None:
            stale = registry.join(F.broadcast(due.select("book")), "book", "left_semi").withColumn("settings", F.lit("")).withColumn("source_sha", F.lit(""))
            rows = self.spark.createDataFrame(stale.collect(), stale.schema)  # a row a book
            if not rows.isEmpty():
                replace_books(rows, f"{self.folder}/registry")

    def _listed(self, rows: DataFrame, raw: str | None) -> DataFrame:
        """Records whose merged lists are an item each, with an id and, if raw items are there, a page of its own."""
        each = audit.explode_lists(rows).withColumn("rec_no", F.col("rec_no") + F.col("item_no"))
        merged = (F.col("label") == "list") & F.col("merged")
        each = each.withColumn("id", F.when(merged, F.concat(F.col("book"), F.lit("#"), F.col("rec_no").cast("string"))).otherwise(F.col("id")))
        if raw is None:
            return each.drop("item_no", "merged")
        asked = each.filter(merged).select("book", "rec_no", "item_no", F.substring("text", 3, 1 << 30).alias("line"), "page_no")
        pages = chunks.line_pages(asked, read_list_items(self.spark, raw)).select("book", "rec_no", F.col("page_no").alias("_page"), F.lit(True).alias("_found"))
        joined = each.join(pages, ["book", "rec_no"], "left")
        page = F.when(F.col("_found"), F.col("_page")).otherwise(F.col("page_no"))
        return joined.withColumn("page_no", page).withColumn("page_end", F.when(F.col("_found"), page).otherwise(F.col("page_end"))).drop("_page", "_found", "item_no", "merged")

    def index(self) -> None:
        """Postings, document frequencies and sizes of all chunks; derived, so it is written anew after every ingest."""
        texts = self.chunks().select("chunk_id", F.concat_ws(" ", "heading", "text").alias("body"))
        postings = retrieval.postings(texts, "chunk_id", "body", stop=True)
        postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.folder}/index/postings")
        written = self.spark.read.parquet(f"{self.folder}/index/postings")
        written.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{self.folder}/index/terms")
        retrieval.sizes_of(texts, "body", stop=True).write.mode("overwrite").parquet(f"{self.folder}/index/sizes")

    # Retrieval

    def lexical(self, asked: DataFrame, k: int = CANDIDATES) -> DataFrame:
        tables = {name: self.spark.read.parquet(f"{self.folder}/index/{name}") for name in ("postings", "terms", "sizes")}
        return retrieval.bm25_indexed(tables, asked, "chunk_id", k, stop=True)

    def dense_ready(self) -> bool:
        """Whether there is an encoder and every book was taken in with it."""
        registry = self._table("registry")
        if not self.encode or registry is None or self._table("vectors") is None:
            return False
        return bool(registry.agg(F.bool_and(F.col("settings") == self.settings(True))).first()[0])

    def search(self, asked: DataFrame, book: str | None = None, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
        """(chosen, reranked) for questions (query_id, question): the chunks that fit the context, and all after the penalty, best first.

        Lexical hits are cut before the book filter, dense ones after it.
        """
        every = self.chunks()
        lexical = self.lexical(asked).select("query_id", "chunk_id", "rank")
        if book is not None:
            own = every.filter(F.lower("book") == book.lower()).select("chunk_id")
            place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
            lexical = lexical.join(own, "chunk_id", "left_semi").withColumn("rank", place)
        lists = [lexical.select("query_id", "chunk_id", "rank")]
        if self.dense_ready():
            vectors = self.spark.read.parquet(f"{self.folder}/vectors")
            vectors = vectors if book is None else vectors.filter(F.lower("book") == book.lower())
            wanted = asked.select("query_id", self.encode(F.col("question")).alias("q"))
            numbered = vectors.select("chunk_id", F.conv(F.substring("chunk_id", 1, 15), 16, 10).cast("long").alias("vec_id"), F.col("vector").alias("embedding"))
            near = retrieval.cosine_topk(numbered.select("vec_id", "embedding"), wanted, k=CANDIDATES)
            lists.append(near.join(numbered.select("vec_id", "chunk_id"), "vec_id").select("query_id", "chunk_id", "rank"))
        fused = retrieval.rrf(lists, "chunk_id", keep=KEPT)
        hits = fused.join(every, "chunk_id").join(asked.select("query_id", "question"), "query_id")
        penalty = retrieval.PENALTY
        if self.rerank:
            hits = retrieval.reranked(hits, "chunk_id", self.rerank(F.col("question"), F.concat_ws("\n", "heading", "text")))
            penalty = retrieval.RERANKED_PENALTY
        final = F.col("score") - F.when(F.col("reference_path") & ~asks_for_sources(F.col("question")), penalty).otherwise(0.0)
        order = W.partitionBy("query_id").orderBy(F.desc(final), "rank")
        placed = hits.withColumn("place", F.row_number().over(order)).drop("rank").withColumnRenamed("place", "rank")
        chosen = placed.join(retrieval.budget(placed, "chunk_id", limit=limit), ["query_id", "chunk_id", "rank"], "left_semi")
        return chosen, placed

    def retrieve(self, question: str, book: str | None = None) -> list[dict]:
        """The chunks that fit the context, best first."""
        asked = self.spark.createDataFrame([(0, question)], "query_id long, question string")
        return [r.asDict(recursive=True) for r in self.search(asked, book)[0].drop("query_id", "question").orderBy("rank").collect()]

    def ask(self, question: str, audience: str = "clinician", provider: Provider | None = None) -> dict:
        """An answer's status, text and citations; the default provider only quotes. A trace without the question is kept."""
        def search(query: str) -> list[dict]:
            return [c | {"source_spans": c["spans"], "pdf_page": c["page_start"]} for c in self.retrieve(query)]

        found = asdict(ask(question, search, provider, audience))
        trace = [(found["trace_id"], audience, "", found["status"], "", json.dumps([c["chunk_id"] for c in found["citations"]]), json.dumps(found.pop("stages")))]
        names = "trace_id string, audience string, question string, status string, answer string, chunk_ids string, stages string"
        try:
            append_rows(self.spark.createDataFrame(trace, names).withColumn("at", F.current_timestamp()), f"{self.folder}/traces")
        except Exception:  # noqa: BLE001  an answer does not fail for want of its trace
            pass
        return found

    def source(self, chunk_id: str) -> dict | None:
        row = self.chunks().filter(F.col("chunk_id") == chunk_id).first()
        return row.asDict(recursive=True) if row else None

    def health(self) -> dict:
        """ready, index_outdated or index_missing, with the numbers of books and chunks."""
        books = self._table("registry")
        if books is None:
            return {"status": "index_missing", "books": 0, "chunks": 0}
        known = [self.settings(True), self.settings(False)]
        n, current, total = books.agg(F.count(F.lit(1)), F.count_if(F.col("settings").isin(known)), F.sum("chunks")).first()
        return {"status": "index_missing" if not n else "ready" if n == current else "index_outdated", "books": n, "chunks": total or 0}

    # Reports

    def evaluate(self, cases: str, provider: Provider | None = None) -> dict:
        """hit@5, hit@10 and MRR of the cases in a JSON file; with a provider also citations and refusals. Report files go to reports."""
        each = self.spark.read.text(cases, wholetext=True).select(F.explode(F.from_json("value", CASE)).alias("c")).select("c.*")
        own = F.array(F.struct("book", "pdf_page", "source_id"))
        keyed = each.select(F.xxhash64("id").alias("query_id"), "*").withColumn("anchors", F.when(F.size("anchors") > 0, F.col("anchors")).otherwise(own))
        scored = keyed.filter(~F.coalesce("refusal", F.lit(False)))
        hits = self.search(scored.select("query_id", "question"))[1].filter("rank <= 10").select("query_id", "rank", "book", "page_start", "page_end", "source_ids")
        anchors = scored.select("query_id", F.posexplode("anchors").alias("n", "a")).select("query_id", "n", "a.*")
        ranks = retrieval.anchor_ranks(anchors, hits)
        found = retrieval.scores(ranks).first().asDict()
        worst = ranks.join(scored.select("query_id", "id"), "query_id").select("id", F.when(~F.col("missing"), F.col("worst")).alias("rank"))
        rows = {r["id"]: {"id": r["id"], "rank": r["rank"]} for r in worst.collect()}  # a row a case
        if provider is not None:
            found |= self._generated(keyed, rows, provider)
        lines = ["| Case | Rank | Status |", "|---|---:|---|"] + [f"| {r['id']} | {r.get('rank') or '-'} | {r.get('status', 'not_run')} |" for r in rows.values()]
        write_report(self.spark, f"{self.folder}/reports/evaluation.json", json.dumps(found | {"rows": list(rows.values())}, indent=2))
        write_report(self.spark, f"{self.folder}/reports/evaluation.md", "\n".join([f"hit@5 {found['hit5']}, hit@10 {found['hit10']}, MRR {found['mrr']}", "", *lines]))
        return found

    def _generated(self, keyed: DataFrame, rows: dict, provider: Provider) -> dict:
        """Structural validity of answers' citations, and refusals as x/y; a question is one model run, so cases go one by one."""
        valid, refused, probes = [], 0, 0
        for case in keyed.select("id", "question", "audience", F.coalesce("refusal", F.lit(False)).alias("refusal")).collect():
            said = self.ask(case["question"], case["audience"] or "clinician", provider)
            rows.setdefault(case["id"], {"id": case["id"]})["status"] = said["status"]
            if case["refusal"]:
                probes += 1
                refused += said["status"] in ("personal_question", "insufficient_evidence")
            elif said["status"] == "answered":
                own = {c["chunk_id"]: c | {"source_spans": c["spans"]} for c in (self.source(x["chunk_id"]) for x in said["citations"]) if c}
                valid.append(structurally_valid(said["citations"], own))
        return {"citation_validity": sum(valid) / len(valid) if valid else None, "refusals": f"{refused}/{probes}" if probes else None}

    def audit(self, records: str) -> list[str]:
        """One line of JSON a book; also written to reports/audit."""
        rows = read_records(self.spark, records)
        found = audit.labels(rows).join(audit.label_histogram(rows), "book").orderBy("book")
        found.write.mode("overwrite").json(f"{self.folder}/reports/audit")
        return [json.dumps(json.loads(r), ensure_ascii=False) for r in found.toJSON().collect()]  # a row a book


def hashed_encoder(dimensions: int = 256):
    """An encoder that needs no model: unit vectors of hashed words, as a column function."""
    def encode(text: Column) -> Column:
        spots = F.transform(retrieval.terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(spots, lambda x: x == i)).cast("double"))
        return retrieval.normalised(counts)

    return encode


def read_settings(path: str = ".env") -> None:
    """Settings of a file of NAME=value lines, for names that are not set; quotes around a value go."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, sign, value = line.strip().partition("=")
                if sign and not name.startswith("#") and name.strip() not in os.environ:
                    value = value.strip()
                    os.environ[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
