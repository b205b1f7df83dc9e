"""The registered queries of the document engine, each beside the SQL that states its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as t
from textloom.operators import answers, chunk_store, chunking, corpus, embedding, evaluate, extract, pdf, quality, reports, search, sections
from textloom.session import own_folder, spread, stored
from textloom.sources import files, http

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *further: str) -> DataFrame:
    """doc_id, text and further columns of the documents, dealt out for work that is heavy a row."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *further))


# --- search ---------------------------------------------------------------------------------

SQL_INDEX = """
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents),
dl AS (SELECT d.doc_id, coalesce(n, 0) AS dl FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM toks GROUP BY 1) USING (doc_id)),
corp AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT term, doc_id, count(*) AS tf FROM toks GROUP BY 1, 2),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM corp) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post GROUP BY 1),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
SQL_BM25 = (
    SQL_INDEX
    + """,
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT item_id, doc_id, sum(qtf * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM corp)))) AS score
       FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id) GROUP BY 1, 2),
alls AS (SELECT item_id, doc_id, coalesce(score, 0) AS score FROM (SELECT item_id, doc_id FROM benchmark, documents) LEFT JOIN sc USING (item_id, doc_id)),
sparse AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM alls QUALIFY rank <= 20)"""
)
SQL_DENSE = """
dsc AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings c WHERE {0}),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dsc QUALIFY rank <= 20)"""
SQL_HYBRID = (
    "WITH "
    + SQL_BM25.strip()
    + ","
    + SQL_DENSE.format("q.vec_id IN (SELECT item_id FROM benchmark)")
    + """,
uni AS (SELECT query_id, doc_id, rank, 0 AS l FROM dense UNION ALL SELECT item_id, doc_id, rank, 1 FROM sparse),
fus AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l * 1000 + rank) AS seen FROM uni GROUP BY 1, 2),
hyb AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS rank FROM fus QUALIFY rank <= 20)"""
)
SQL_GOLD = """
gold AS (SELECT item_id, doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)),
gs AS (SELECT item_id, count(*) AS g FROM gold GROUP BY 1)"""
SQL_PER_QUERY = """
per AS (SELECT m.mode, b.item_id, sum(CASE WHEN rank <= 5 AND g.doc_id IS NOT NULL THEN 1 ELSE 0 END) / count(*) FILTER (rank <= 5) AS p,
        max(CASE WHEN rank <= 5 AND g.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit,
        coalesce(1.0 / min(CASE WHEN g.doc_id IS NOT NULL THEN rank END), 0)::DOUBLE AS rr, least(coalesce(max(gs.g), 0), 5) / 5.0::DOUBLE AS ceil
        FROM hits m JOIN benchmark b ON b.item_id = m.item_id LEFT JOIN gold g ON g.item_id = m.item_id AND g.doc_id = m.doc_id LEFT JOIN gs ON gs.item_id = b.item_id GROUP BY 1, 2)"""
SQL_SUMMARY = """count(*)::BIGINT AS questions, round(avg(p), 6) AS mean_precision_at_k, round(avg(hit), 6) AS mean_recall_at_k, round(avg(ceil), 6) AS mean_max_precision_at_k,
round(coalesce(sum(p) / nullif(sum(ceil), 0), 0), 6) AS precision_attainment, round(avg(rr), 6) AS mrr"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions; an item's query vector is the one of its number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return asked.join(vectors, "query_id", "left")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold an item word for word. The items are the stated query set.

    A document that holds an item holds its inner tokens, so candidates come from a join on
    the longest of them, beside their texts where the items can be broadcast, else of ids and tokens alone before the texts.
    Items of fewer than three tokens have no inner one: each text is searched for all of them in one narrow pass."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"), t.search_tokens(F.col("text")).alias("tokens"))
    inner = F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 2, F.lit(0)))
    keyed = items.select("query_id", "item", F.element_at(F.array_sort(F.transform(inner, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("token")))), 1)["token"].alias("token"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    broadcast = items.count() <= search.BROADCAST_ROWS
    long = keyed.where("token IS NOT NULL")
    held = docs.select("doc_id", *(["text"] if broadcast else []), F.explode(F.array_distinct(t.search_tokens(F.col("text")))).alias("token")).join(F.broadcast(long) if broadcast else long, "token")
    beside = held if broadcast else held.select("doc_id", "query_id", "item").join(docs, "doc_id")
    found = beside.where(F.contains("text", "item")).select("query_id", "doc_id").distinct()
    few = keyed.where("token IS NULL AND item IS NOT NULL").agg(F.collect_list(F.struct("query_id", "item")).alias("few")).select("few").scalar()
    short = docs.withColumn("few", few).select("doc_id", F.explode(F.filter("few", lambda x: F.contains(F.col("text"), x["item"]))).alias("x")).select("x.query_id", "doc_id")
    return stored(found.unionByName(short), "gold")


#: Indexes built so far, by application, folder and files; they are tables in the shared folder until the driver ends.
INDEXES: dict[tuple, search.SparseIndex] = {}


def sparse_index(spark: SparkSession, sf_dir: str) -> search.SparseIndex:
    """The index of the documents, built once for an application and the files that it finds there."""
    docs = table(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(docs.inputFiles()))
    if key not in INDEXES:
        INDEXES[key] = search.build_sparse_index(docs)
    return INDEXES[key]


def retrieval(spark: SparkSession, sf_dir: str) -> search.Retrieval:
    return search.Retrieval(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), index=sparse_index(spark, sf_dir))


@query(f"WITH {SQL_INDEX.strip()} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM idf")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {SQL_BM25.strip()} SELECT item_id AS query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM sparse WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval(spark, sf_dir).hits(questions(spark, sf_dir), 5, "bm25").withColumn("score", F.round("score", 6))


@query(
    "WITH "
    + SQL_BM25.strip().replace("unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark", "unnest(regexp_extract_all(lower(text), '[a-z0-9]+')[3:6]) AS term FROM benchmark")
    + " SELECT item_id AS query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM sparse WHERE rank <= 5"
)
def bm25_pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third to sixth word of every item as a search of few words, scored with block bounds."""
    few = F.array_join(F.slice(t.search_tokens(F.col("query")), 3, 4), " ")
    asked = questions(spark, sf_dir).withColumn("query", few)
    found = search.bm25_topk(sparse_index(spark, sf_dir), asked, table(spark, sf_dir, "documents"), 5, pruned=True)
    return found.withColumn("score", F.round("score", 6))


@query(
    "WITH " + SQL_DENSE.strip().format("q.vec_id % 20 = 0") + " SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM dense WHERE rank <= 5"
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.dense_topk(vectors, asked, 5).withColumn("score", F.round("score", 6))


@query(SQL_HYBRID + " SELECT query_id, doc_id, rank::INTEGER AS rank, round(score, 9) AS score FROM hyb WHERE rank <= 5")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval(spark, sf_dir).hits(questions(spark, sf_dir), 5, "hybrid").withColumn("score", F.round("score", 9))


@query(
    SQL_HYBRID
    + """ SELECT b.item_id AS query_id, count(h.doc_id)::BIGINT AS overlap FROM benchmark b LEFT JOIN
    (SELECT d.query_id, d.doc_id FROM dense d JOIN hyb y ON y.query_id = d.query_id AND y.doc_id = d.doc_id WHERE d.rank <= 3 AND y.rank <= 3) h ON h.query_id = b.item_id GROUP BY 1"""
)
def mode_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, asked = retrieval(spark, sf_dir), questions(spark, sf_dir)
    hits = r.hits_by_mode(asked, 3)
    return search.overlap(hits["dense"], hits["hybrid"], 3)


@query(
    f"WITH {SQL_BM25.strip()}, hits AS (SELECT 'bm25' AS mode, * FROM sparse), {SQL_GOLD.strip()}, {SQL_PER_QUERY.strip()} SELECT mode, {SQL_SUMMARY} FROM per GROUP BY 1"
)
def bm25_known_item_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    hits = retrieval(spark, sf_dir).hits(asked, evaluate.MRR_DEPTH, "bm25")
    return rounded(evaluate.mode_summary(evaluate.compare_modes(asked, {"bm25": hits}, gold(spark, sf_dir)), ["mode"]))


@query(
    SQL_HYBRID
    + f""", hits AS (SELECT 'bm25' AS mode, item_id, doc_id, rank FROM sparse UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dense UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hyb),
    {SQL_GOLD.strip()}, {SQL_PER_QUERY.strip()} SELECT mode, {SQL_SUMMARY} FROM per GROUP BY 1"""
)
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, asked = retrieval(spark, sf_dir), questions(spark, sf_dir)
    hits = r.hits_by_mode(asked, evaluate.MRR_DEPTH)
    return rounded(evaluate.mode_summary(evaluate.compare_modes(asked, hits, gold(spark, sf_dir)), ["mode"]))


@query(
    f"""WITH {SQL_BM25.strip()}, {SQL_GOLD.strip()},
    per AS (SELECT b.item_id, (CASE WHEN b.item_id % 2 = 0 THEN 3 ELSE 10 END) AS k,
            sum(CASE WHEN rank <= (CASE WHEN b.item_id % 2 = 0 THEN 3 ELSE 10 END) AND g.doc_id IS NOT NULL THEN 1 ELSE 0 END) / (CASE WHEN b.item_id % 2 = 0 THEN 3 ELSE 10 END) AS p,
            max(CASE WHEN rank <= (CASE WHEN b.item_id % 2 = 0 THEN 3 ELSE 10 END) AND g.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit,
            coalesce(1.0 / min(CASE WHEN g.doc_id IS NOT NULL THEN rank END), 0)::DOUBLE AS rr, least(coalesce(max(gs.g), 0), max(CASE WHEN b.item_id % 2 = 0 THEN 3 ELSE 10 END)) / max(CASE WHEN b.item_id % 2 = 0 THEN 3 ELSE 10 END)::DOUBLE AS ceil
            FROM sparse m JOIN benchmark b ON b.item_id = m.item_id LEFT JOIN gold g ON g.item_id = m.item_id AND g.doc_id = m.doc_id LEFT JOIN gs ON gs.item_id = b.item_id GROUP BY 1, 2)
    SELECT k::INTEGER AS k, {SQL_SUMMARY} FROM per GROUP BY 1"""
)
def tier_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).withColumn("eval_k", F.when(F.col("query_id") % 2 == 0, 3).otherwise(10))
    hits = retrieval(spark, sf_dir).hits(asked, evaluate.MRR_DEPTH, "bm25")
    return rounded(evaluate.mode_summary(evaluate.per_query_metrics(asked, hits, gold(spark, sf_dir)), ["k"]))


#: Files of a source, sections of a language: an item's gold is the section in which it first stands, its k one of five.
SQL_SECTION_EVAL = """
sizes AS (SELECT source, lang, count(*) AS size FROM documents GROUP BY ALL),
first AS (SELECT item_id, min(doc_id) AS doc_id FROM gold GROUP BY 1),
ask AS (SELECT b.item_id, [1, 3, 5, 10, 20][(b.item_id % 5 + 1)::INTEGER] AS k, d.source, d.lang FROM benchmark b LEFT JOIN first USING (item_id) LEFT JOIN documents d USING (doc_id)),
sec AS (SELECT h.mode, a.item_id, a.k, count(*) FILTER (h.rank <= a.k AND d.source = a.source AND d.lang = a.lang) / count(*) FILTER (h.rank <= a.k) AS p,
        coalesce(1.0 / min(CASE WHEN d.source = a.source AND d.lang = a.lang THEN h.rank END), 0)::DOUBLE AS rr, least(coalesce(any_value(s.size), 0), a.k) / a.k AS ceil
        FROM hits h JOIN ask a USING (item_id) JOIN documents d USING (doc_id) LEFT JOIN sizes s ON s.source = a.source AND s.lang = a.lang GROUP BY h.mode, a.item_id, a.k)"""


def section_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with the source and language of the first document that holds them as gold document and section."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("gold_source"), F.col("lang").alias("gold_lang"))
    first = gold(spark, sf_dir).groupBy("query_id").agg(F.min("doc_id").alias("doc_id")).join(docs, "doc_id").drop("doc_id")
    tier = F.get(F.array(*(F.lit(k) for k in (1, 3, 5, 10, 20))), F.pmod("query_id", F.lit(5)).cast("int"))
    return questions(spark, sf_dir).withColumn("eval_k", tier).join(first, "query_id", "left")


def section_hits(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    return found.join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")


@query(
    f"""WITH {SQL_BM25.strip()}, hits AS (SELECT 'bm25' AS mode, * FROM sparse), {SQL_GOLD.strip()}, {SQL_SECTION_EVAL.strip()}
    SELECT item_id AS query_id, k::INTEGER AS k, 'known-item' AS question_type, round(p, 6) AS precision_at_k, (p > 0)::INTEGER::DOUBLE AS hit_at_k, round(ceil, 6) AS max_precision_at_k,
           round(coalesce(p / nullif(ceil, 0), 0), 6) AS precision_attainment, round(rr, 6) AS reciprocal_rank FROM sec"""
)
def section_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits judged by the section they lie in, question by question, each at its own k."""
    asked = section_questions(spark, sf_dir)
    hits = section_hits(spark, sf_dir, retrieval(spark, sf_dir).hits(asked, evaluate.MRR_DEPTH, "bm25"))
    sizes = evaluate.section_sizes(table(spark, sf_dir, "documents"), ["source", "lang"])
    return rounded(evaluate.section_metrics(asked, hits, sizes, ["source", "lang"]))


@query(
    SQL_HYBRID
    + f""", hits AS (SELECT 'bm25' AS mode, item_id, doc_id, rank FROM sparse UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dense UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hyb),
    {SQL_GOLD.strip()}, {SQL_SECTION_EVAL.strip()}, per AS (SELECT mode, k, p, (p > 0)::INTEGER::DOUBLE AS hit, ceil, rr FROM sec)
    SELECT mode, k::INTEGER AS k, {SQL_SUMMARY} FROM per GROUP BY 1, 2"""
)
def section_mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the section metrics by mode and k."""
    r, asked = retrieval(spark, sf_dir), section_questions(spark, sf_dir)
    sizes = evaluate.section_sizes(table(spark, sf_dir, "documents"), ["source", "lang"])
    hits = r.hits_by_mode(asked, evaluate.MRR_DEPTH)
    parts = [evaluate.section_metrics(asked, section_hits(spark, sf_dir, hits[m]), sizes, ["source", "lang"]).withColumn("mode", F.lit(m)) for m in search.MODES]
    return rounded(evaluate.mode_summary(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["mode", "k"]))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})


# --- text -----------------------------------------------------------------------------------

SQL_TRANSLATED = """translate(text, '‘’‚‛“”„‟‐‑‒–—―−' || chr(160) || chr(8199) || chr(8239) || chr(8203) || chr(65279) || chr(173), '''''''''""\"""-------' || '   ')"""
SQL_CLEAN = rf"""
c AS (SELECT doc_id, regexp_replace(regexp_replace({SQL_TRANSLATED}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '([A-Za-z]{{2,}})-\n([a-z]{{2,}})', '\1\2', 'g') AS text FROM documents),
l AS (SELECT doc_id, i, regexp_replace(trim(line), '[ \t]{{2,}}', ' ', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM c)),
n AS (SELECT *, regexp_replace(line, '\d+', '#', 'g') AS tmpl, (NOT starts_with(line, '|') AND length(line) BETWEEN 15 AND 80 AND len(string_split_regex(line, '\s+')) <= 10) AS cand FROM l WHERE line <> ''),
f AS (SELECT doc_id, tmpl FROM n WHERE cand GROUP BY 1, 2 HAVING count(*) >= 5),
k AS (SELECT n.* FROM n LEFT JOIN f ON f.doc_id = n.doc_id AND f.tmpl = n.tmpl WHERE starts_with(line, '|') OR NOT ((cand AND f.tmpl IS NOT NULL) OR regexp_matches(line, '\.{{4,}}\s*\d*\s*$') OR regexp_full_match(line, '(?i)(page\s*)?\d{{1,4}}'))),
norm AS (SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS text FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1)"""


@query(f"WITH {SQL_CLEAN.strip()} SELECT doc_id, sha256(text) AS text_sha256, length(text)::BIGINT AS n_chars FROM norm")
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = texts(spark, sf_dir).select("doc_id", t.normalise_text(F.col("text")).alias("text"))
    return cleaned.select("doc_id", t.content_key(F.col("text")).alias("text_sha256"), F.length("text").cast("bigint").alias("n_chars"))


@query(f"WITH {SQL_CLEAN.strip()} SELECT d.doc_id, count(n.i)::BIGINT AS lines_before, (SELECT count(*) FROM k WHERE k.doc_id = d.doc_id)::BIGINT AS lines_after FROM documents d LEFT JOIN n USING (doc_id) GROUP BY 1")
def strip_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = texts(spark, sf_dir).select("doc_id", t.lines_of(t.clean_characters(F.col("text"))).alias("lines"))
    return lines.select("doc_id", F.size("lines").cast("bigint").alias("lines_before"), F.size(t.kept_lines(F.col("lines"))).cast("bigint").alias("lines_after"))


@query("SELECT doc_id, sha256(text) AS key FROM documents")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.content_key(F.col("text")).alias("key"))


SQL_SENTENCES = r"""s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]["'')\]]?)\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM documents)"""


@query(f"WITH {SQL_SENTENCES} SELECT doc_id, count(*)::BIGINT AS n_sentences, sum(length(s))::BIGINT AS n_chars FROM s WHERE trim(s) <> '' GROUP BY 1")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = texts(spark, sf_dir).select("doc_id", F.explode(t.sentences(F.col("text"))).alias("s"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).cast("bigint").alias("n_chars"))


@query(r"SELECT doc_id, (floor(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) * 1.6::DOUBLE) + 1)::INTEGER AS n_tokens FROM documents")
def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.token_count(F.col("text")).alias("n_tokens"))


@query(
    """SELECT doc_id, CASE WHEN h = '' THEN text ELSE h || chr(10) || text END AS embed_text FROM
    (SELECT doc_id, text, concat_ws(' | ', nullif(source, ''), nullif(lang, ''), CASE WHEN doc_id % 3 <> 0 THEN 'Section ' || (doc_id % 3) END) AS h FROM documents)"""
)
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("doc_id") % 3 == 0, sections.WHOLE).otherwise(F.concat(F.lit("Section "), (F.col("doc_id") % 3).cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", chunking.embed_text(F.col("source"), F.col("lang"), section, F.col("text")).alias("embed_text"))


#: Chunks of `documents`, packed by a recursive step: a chunk reaches from s over x, which it must hold, to e.
SQL_WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
SQL_TOKENS = f"(floor(len({SQL_WORDS}) * 1.6::DOUBLE)::BIGINT + 1)"
SQL_LINE_END = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
SQL_BLOCKS = rf"""
ln AS (SELECT doc_id, i, line, starts_with(line, '|') AS tab FROM (SELECT doc_id, unnest(string_split_regex(text, {SQL_LINE_END})) AS line,
       generate_subscripts(string_split_regex(text, {SQL_LINE_END}), 1) AS i FROM documents WHERE text IS NOT NULL)),
blk AS (SELECT doc_id, b, any_value(tab) AS tab, string_agg(line, chr(10) ORDER BY i) AS body FROM (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM
        (SELECT *, (tab IS DISTINCT FROM lag(tab) OVER (PARTITION BY doc_id ORDER BY i))::INTEGER AS turn FROM ln)) GROUP BY 1, 2 HAVING regexp_replace(string_agg(line, ''), '\s', '', 'g') <> '')"""
SQL_CHUNKS = (
    SQL_BLOCKS
    + rf""",
sen AS (SELECT doc_id, b, ' ' AS sep, '' AS head, 360 AS budget, 60 AS overlap, i AS ord, s AS piece FROM (SELECT doc_id, b, unnest(string_split(t, chr(1))) AS s, generate_subscripts(string_split(t, chr(1)), 1) AS i
        FROM (SELECT doc_id, b, regexp_replace(regexp_replace(body, '^\s+|\s+$', '', 'g'), '([.!?]["'')\]]?)\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g') AS t FROM blk WHERE NOT tab)) WHERE trim(s) <> ''),
hd AS (SELECT doc_id, b, l, CASE WHEN len(l) > 1 AND regexp_full_match(l[2], '[-| ]*') THEN 2 ELSE 1 END AS h FROM (SELECT doc_id, b, string_split(body, chr(10)) AS l FROM blk WHERE tab AND {SQL_TOKENS.format("body")} > 360)),
tab AS (SELECT doc_id, b, chr(10) AS sep, head || chr(10) AS head, 360 - {SQL_TOKENS.format("head")} AS budget, -1 AS overlap, i AS ord, row_ AS piece FROM
        (SELECT doc_id, b, array_to_string(l[1:h], chr(10)) AS head, unnest(l[h + 1:]) AS row_, generate_subscripts(l[h + 1:], 1) AS i FROM hd)),
un AS (SELECT *, {SQL_WORDS.format("piece")} AS w, {SQL_TOKENS.format("piece")} AS n FROM (SELECT * FROM sen UNION ALL SELECT * FROM tab)),
cut AS (SELECT doc_id, b, sep, head, budget, overlap, ord, 0 AS j, piece FROM un WHERE n <= budget OR len(w) <= 1 UNION ALL
        SELECT doc_id, b, sep, head, budget, overlap, ord, j, array_to_string(w[j * step + 1 : (j + 1) * step], ' ') FROM
        (SELECT *, unnest(generate_series(0, (len(w) - 1) // step)) AS j FROM (SELECT *, greatest(1, floor(budget / (n / len(w)::DOUBLE)))::BIGINT AS step FROM un WHERE n > budget AND len(w) > 1))),
u AS MATERIALIZED (SELECT *, sum(n) OVER o AS upto, sum(n) OVER o - n AS before, row_number() OVER o AS i FROM (SELECT *, {SQL_TOKENS.format("piece")} AS n FROM cut) WINDOW o AS (PARTITION BY doc_id, b ORDER BY ord, j)),
far AS MATERIALIZED (SELECT a.doc_id, a.b, a.i, max(z.i) FILTER (z.upto - a.before <= a.budget) AS e FROM u a JOIN u z ON z.doc_id = a.doc_id AND z.b = a.b AND z.i BETWEEN a.i AND a.i + 360 GROUP BY ALL),
carry AS MATERIALIZED (SELECT a.doc_id, a.b, a.i, coalesce(min(z.i) FILTER (a.upto - z.before <= a.overlap), a.i + 1) AS s FROM u a JOIN u z ON z.doc_id = a.doc_id AND z.b = a.b AND z.i BETWEEN a.i - 60 AND a.i GROUP BY a.doc_id, a.b, a.i),
ch AS (SELECT doc_id, b, 1 AS k, i AS s, i AS x, greatest(i, coalesce(e, 0)) AS e FROM far WHERE i = 1 UNION ALL
       SELECT ch.doc_id, ch.b, ch.k + 1, f.i, ch.e + 1, greatest(ch.e + 1, coalesce(f.e, 0)) FROM ch JOIN far nxt ON nxt.doc_id = ch.doc_id AND nxt.b = ch.b AND nxt.i = ch.e + 1
       JOIN carry c ON c.doc_id = ch.doc_id AND c.b = ch.b AND c.i = ch.e JOIN far f ON f.doc_id = ch.doc_id AND f.b = ch.b AND f.i = greatest(c.s, ch.s)),
packed AS (SELECT ch.doc_id, ch.b, ch.k, any_value(u.head) || CASE WHEN any_value(u.sep) = ' ' THEN string_agg(u.piece, ' ' ORDER BY u.i) ELSE string_agg(u.piece, chr(10) ORDER BY u.i) END AS text FROM ch JOIN u ON u.doc_id = ch.doc_id AND u.b = ch.b AND u.i BETWEEN ch.s AND ch.e GROUP BY 1, 2, 3
           UNION ALL SELECT doc_id, b, 0, body FROM blk WHERE tab AND {SQL_TOKENS.format("body")} <= 360),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b, k) - 1)::INTEGER AS chunk_index, text FROM packed)"""
)


@query(
    f"WITH RECURSIVE {SQL_CHUNKS.strip()} SELECT doc_id || '::' || chunk_index AS chunk_id, doc_id, 'Full Document' AS section, chunk_index, len({SQL_WORDS.format('text')})::INTEGER AS word_count, sha256(text) AS text_sha256 FROM chunks"
)
def prose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", F.lit(0).alias("sec_pos"), F.lit(sections.WHOLE).alias("section"), F.col("text").alias("body"))
    chunks = chunking.chunk_documents(docs)
    return chunks.select("chunk_id", "doc_id", "section", "chunk_index", "word_count", t.content_key(F.col("text")).alias("text_sha256"))


#: Documents under synthetic headings: every second line of a text becomes the body of the next heading.
SQL_HEADED = r"""h AS (SELECT doc_id, 'Item 1. Opening Words' || chr(10) || text || chr(10) || 'Item 2. Middle Words' || chr(10) || text || chr(10) || 'Item ' || CASE WHEN doc_id % 4 = 0 THEN '2' ELSE '3' END || '. Closing Words' || chr(10) || text AS text FROM documents WHERE text IS NOT NULL)"""


def headed(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """Each text three times under three headings; every fourth document repeats the second item's number."""
    last = F.when(F.col("doc_id") % 4 == 0, "2").otherwise("3")
    kind = "" if numbered else "Item "
    return texts(spark, sf_dir, "source", "lang").where("text IS NOT NULL").select(
        "doc_id", F.concat(F.lit(f"{kind}1. Opening Words\n"), "text", F.lit(f"\n{kind}2. Middle Words\n"), "text", F.lit(f"\n{kind}"), last, F.lit(". Closing Words\n"), "text").alias("text")
    )


@query(
    r"""WITH b AS (SELECT doc_id, doc_id % 4 = 0 AS two, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, text FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, 0 AS sec_pos, CASE WHEN two THEN 'Full Document' ELSE 'Item 1. Opening Words' END AS section,
           CASE WHEN two THEN length('Item 1. Opening Words' || chr(10) || text || chr(10) || 'Item 2. Middle Words' || chr(10) || text || chr(10) || 'Item 2. Closing Words' || chr(10) || text) ELSE length(t) END::BIGINT AS n_chars FROM b WHERE two OR t <> ''
    UNION ALL SELECT doc_id, 1, 'Item 2. Middle Words', length(t)::BIGINT FROM b WHERE NOT two AND t <> ''
    UNION ALL SELECT doc_id, 2, 'Item 3. Closing Words', length(t)::BIGINT FROM b WHERE NOT two AND t <> ''"""
)
def item_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.split_sections(headed(spark, sf_dir))
    return out.select("doc_id", "sec_pos", "section", F.length("body").cast("bigint").alias("n_chars"))


@query(
    r"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '2' ELSE '3' END AS k, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, p::INTEGER AS sec_pos, CASE p WHEN 0 THEN '1. Opening Words' WHEN 1 THEN '2. Middle Words' ELSE k || '. Closing Words' END AS section, length(t)::BIGINT AS n_chars
    FROM b, range(3) r(p) WHERE t <> ''"""
)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.split_sections(headed(spark, sf_dir, numbered=True))
    return out.select("doc_id", "sec_pos", "section", F.length("body").cast("bigint").alias("n_chars"))


#: The lines of every page's text, as html_text_lines states them.
SQL_PAGES = r"""
hb AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!doctype[^>]*>', '', 'g') AS h FROM pages),
hx AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', chr(10), 'g'), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;', '&') AS t FROM hb),
hl AS (SELECT page_id, i, trim(line, ' ' || chr(9) || chr(13) || chr(160)) AS line FROM (SELECT page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM hx)),
page AS (SELECT page_id, string_agg(line, chr(10) ORDER BY i) AS text FROM hl WHERE line <> '' GROUP BY 1)"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of a corpus; the number of a page stands for its name."""
    page = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(page.alias("doc_id"), F.col("url").alias("path"), F.col("html").cast("binary").alias("content"), F.lit("html").alias("format"), "page_id")


@query(
    rf"""WITH RECURSIVE documents AS (WITH {SQL_PAGES.strip()}, documents AS (SELECT p.page_id AS doc_id, coalesce(text, '') AS text FROM pages p LEFT JOIN page USING (page_id)), {SQL_CLEAN.strip()} SELECT doc_id, text FROM norm WHERE doc_id % 10 <> 1),
    {SQL_CHUNKS.strip()} SELECT doc_id || '::' || chunk_index AS chunk_id, doc_id::VARCHAR AS doc_id, (CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <> 0 THEN 1 ELSE 2 END)::INTEGER AS run, chunk_index, sha256('Pages' || chr(10) || text) AS embed_sha256 FROM chunks"""
)
def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all pages after two runs: the first sees most pages, odd ones cut in half; the second adds, changes and removes."""
    all_files = page_files(spark, sf_dir).withColumn("company", F.lit("Pages"))
    store = chunk_store.ChunkStore(spark, own_folder(spark, "chunks"))
    html = F.col("content").cast("string")
    half = F.substring(html, F.lit(1), F.floor(F.length(html) / 2).cast("int")).cast("binary")
    store.update(all_files.where("page_id % 10 <> 0").withColumn("content", F.when(F.col("page_id") % 2 == 1, half).otherwise(F.col("content"))))
    store.update(all_files.where("page_id % 10 <> 1"))
    return store.chunks().select("chunk_id", "doc_id", "run", "chunk_index", t.content_key(F.col("embed_text")).alias("embed_sha256"))


@query(
    r"""SELECT page_id, file_name, exhibit_type, kind FROM (SELECT page_id, 'exhibit-' || page_id || CASE page_id % 3 WHEN 0 THEN '.htm' WHEN 1 THEN '.TXT' ELSE '.pdf' END AS file_name,
    ['EX-10.1', 'ex-19', 'EX-97', 'EX-21', '10-K'][(page_id % 5 + 1)::INTEGER] AS exhibit_type, ['contract', 'policy', 'policy', NULL, NULL][(page_id % 5 + 1)::INTEGER] AS kind FROM pages)
    WHERE kind IS NOT NULL AND page_id % 3 <> 2"""
)
def exhibit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exhibits listed on index pages: each page behind an index row that describes it."""
    suffix = F.get(F.array(*(F.lit(x) for x in (".htm", ".TXT iXBRL", ".pdf"))), (F.col("page_id") % 3).cast("int"))
    kind = F.get(F.array(*(F.lit(x) for x in ("EX-10.1", "ex-19", "EX-97", "EX-21", "10-K"))), (F.col("page_id") % 5).cast("int"))
    row = F.concat(F.lit("<table><tr><td>1</td><td>An exhibit</td><td><a>exhibit-"), F.col("page_id").cast("string"), suffix, F.lit("</a></td><td>"), kind, F.lit("</td></tr></table>"), "html")
    return http.exhibits(table(spark, sf_dir, "pages").select("page_id", row.alias("html"))).select("page_id", "file_name", "exhibit_type", "kind")


@query(
    r"""WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)),
    p AS (SELECT doc_id, word, i // 100 AS page, i % 100 // 10 AS r, i % 10 AS c FROM w),
    l AS (SELECT doc_id, page, 0 AS late, r, string_agg(word, ' ' ORDER BY c) AS line FROM p
          WHERE NOT ((doc_id + page) % 3 = 0 AND c * 50 + 20 BETWEEN 95 AND 305 AND r * 12 + c % 2 + 5 BETWEEN 20 AND 60) GROUP BY ALL),
    t AS (SELECT DISTINCT doc_id, page, 1 AS late, 0 AS r, '| page | document |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page || ' | $' || doc_id || ' |' AS line FROM p WHERE (doc_id + page) % 3 = 0)
    SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY page, late, r)) AS text_sha256 FROM (SELECT * FROM l UNION ALL SELECT * FROM t) GROUP BY 1"""
)
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's words set on pages of ten by ten words, every third page with a table over some of them."""
    i = F.col("i")
    column, row = i % 10, F.floor(i % 100 / 10)
    placed = texts(spark, sf_dir).select("doc_id", F.posexplode(t.words(F.col("text"))).alias("i", "text"))
    words = placed.select("doc_id", F.floor(i / 100).cast("bigint").alias("page"), (column * 50.0).alias("x0"), (column * 50.0 + 40).alias("x1"), (row * 12.0 + column % 2).alias("top"), (row * 12.0 + column % 2 + 10).alias("bottom"), "text")
    pages = placed.where("i % 100 = 0").select("doc_id", F.floor(i / 100).cast("bigint").alias("page")).where("(doc_id + page) % 3 = 0")
    cells = F.array(F.array(F.lit("page"), F.lit(""), F.lit("document")), F.array(F.col("page").cast("string"), F.lit(""), F.lit("$"), F.col("doc_id").cast("string")))
    tables = pages.select("doc_id", "page", F.lit(0).alias("table_no"), F.lit(95.0).alias("x0"), F.lit(305.0).alias("x1"), F.lit(20.0).alias("top"), F.lit(60.0).alias("bottom"), cells.alias("rows"))
    return pdf.page_texts(words, tables).select("doc_id", t.content_key(F.col("text")).alias("text_sha256"))


@query(
    r"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!doctype[^>]*>', '', 'g') AS h FROM pages),
    x AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', chr(10), 'g'), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;', '&') AS t FROM b),
    l AS (SELECT page_id, i, trim(line, ' ' || chr(9) || chr(13) || chr(160)) AS line FROM (SELECT page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM x))
    SELECT page_id, count(*)::BIGINT AS n_lines, sha256(string_agg(line, chr(10) ORDER BY i)) AS text_sha256 FROM l WHERE line <> '' GROUP BY 1"""
)
def html_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "pages").select("page_id", extract.html_text(F.col("html")).alias("text"))
    return out.where("text <> ''").select("page_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), t.content_key(F.col("text")).alias("text_sha256"))


@query(
    r"""WITH l AS (SELECT conv_id, turn, role, i, trim(line) AS line FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations)),
    b AS (SELECT conv_id, turn, any_value(role) AS role, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line <> ''), '') AS body FROM l GROUP BY 1, 2)
    SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN 'Subject: About ' || role || chr(10) || body ELSE body END) AS text_sha256 FROM b"""
)
def email_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("\n\n@subject\nAbout "), "role", F.lit("\n\n@ann0\nnote\n"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.content_key(extract.email_text(raw)).alias("text_sha256"))


# --- quality --------------------------------------------------------------------------------

SQL_QUALITY = r"""
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''),
r AS (SELECT doc_id, sum(c) FILTER (c > 1) AS rep FROM (SELECT doc_id, line, count(*) AS c FROM l GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT doc_id, count(*) AS lines, sum(CASE WHEN starts_with(line, '|') THEN 1 ELSE 0 END) AS rows, sum(len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> ''))) AS words FROM l GROUP BY 1),
q AS (SELECT d.doc_id, d.source, length(text)::BIGINT AS chars, coalesce(lines, 0)::BIGINT AS lines,
      CASE WHEN lines > 0 THEN length(text) / nullif(strlen(text) * 2, 0) ELSE 0 END::DOUBLE AS yield_ratio,
      CASE WHEN lines > 0 THEN length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / length(text) ELSE 0 END::DOUBLE AS alpha_ratio,
      coalesce(coalesce(rep, 0) / lines, 0)::DOUBLE AS boilerplate_ratio, coalesce(rows / lines, 0)::DOUBLE AS table_row_ratio, coalesce(words / lines, 0)::DOUBLE AS mean_words_per_line
      FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN r USING (doc_id)),
g AS (SELECT *, CASE WHEN chars < (CASE WHEN source = 'email' THEN 40 ELSE 500 END) OR yield_ratio < 0.005 THEN 'fail' WHEN alpha_ratio < 0.6 OR boilerplate_ratio > 0.3 OR mean_words_per_line < 3 THEN 'warn' ELSE 'ok' END AS status,
      (chars < (CASE WHEN source = 'email' THEN 40 ELSE 500 END))::INTEGER + (yield_ratio < 0.005)::INTEGER + (alpha_ratio < 0.6)::INTEGER + (boilerplate_ratio > 0.3)::INTEGER + (mean_words_per_line < 3)::INTEGER AS n_issues FROM q)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with metrics and grades; the source stands in for the type, twice the bytes for the file's size."""
    docs = texts(spark, sf_dir, "source").withColumn("source_bytes", F.octet_length("text") * 2)
    measured = quality.measure_documents(docs, "text", "source_bytes").drop("text")
    return quality.check_documents(measured, "source")


@query(
    f"WITH {SQL_QUALITY.strip()} SELECT doc_id, chars, lines, round(yield_ratio, 9) AS yield_ratio, round(alpha_ratio, 9) AS alpha_ratio, round(boilerplate_ratio, 9) AS boilerplate_ratio, round(table_row_ratio, 9) AS table_row_ratio, round(mean_words_per_line, 9) AS mean_words_per_line FROM q"
)
def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graded(spark, sf_dir).select("doc_id", *quality.METRICS), 9)


@query(f"WITH {SQL_QUALITY.strip()} SELECT doc_id, status, n_issues FROM g")
def doc_quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("doc_id", "status", F.size("issues").alias("n_issues"))


@query(
    f"""WITH {SQL_QUALITY.strip()} SELECT count(*)::BIGINT AS documents, count(*) FILTER (status = 'ok')::BIGINT AS n_ok, count(*) FILTER (status = 'warn')::BIGINT AS n_warn, count(*) FILTER (status = 'fail')::BIGINT AS n_fail,
    round(avg(yield_ratio), 6) AS mean_yield_ratio, round(avg(alpha_ratio), 6) AS mean_alpha_ratio, round(avg(boilerplate_ratio), 6) AS mean_boilerplate_ratio, round(avg(table_row_ratio), 6) AS mean_table_row_ratio FROM g"""
)
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.summarise(graded(spark, sf_dir)))


@query(f"WITH {SQL_QUALITY.strip()} SELECT source, count(*) FILTER (status = 'ok')::BIGINT AS ok, count(*) FILTER (status = 'warn')::BIGINT AS warn, count(*) FILTER (status = 'fail')::BIGINT AS fail FROM g GROUP BY 1")
def quality_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summarise_by_type(graded(spark, sf_dir), "source")


@query(
    f"""WITH {SQL_QUALITY.strip()} SELECT source, status, CASE WHEN grouping(source) = 1 THEN CASE WHEN grouping(status) = 1 THEN 'all' ELSE 'by status' END WHEN grouping(status) = 1 THEN 'by type' ELSE 'by type and status' END AS level,
    count(*)::BIGINT AS documents, round(avg(yield_ratio), 6) AS mean_yield_ratio, round(avg(alpha_ratio), 6) AS mean_alpha_ratio, round(avg(boilerplate_ratio), 6) AS mean_boilerplate_ratio, round(avg(table_row_ratio), 6) AS mean_table_row_ratio
    FROM g GROUP BY GROUPING SETS ((), (status), (source), (source, status))"""
)
def quality_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary over all, by status, by source and by both, in one pass."""
    return rounded(quality.summary_sets(graded(spark, sf_dir), "source"))


@query(
    rf"""WITH documents AS (WITH {SQL_PAGES.strip()}, documents AS (SELECT p.page_id AS doc_id, coalesce(text, '') AS text FROM pages p LEFT JOIN page USING (page_id)), {SQL_CLEAN.strip()}
    SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 3) THEN '' ELSE norm.text END AS text, CASE WHEN doc_id % 2 = 0 THEN 'email' ELSE 'page' END AS source, CASE WHEN doc_id % 7 IN (0, 3) THEN 0 ELSE strlen(html) END AS bytes FROM norm JOIN pages ON page_id = doc_id),
    {SQL_QUALITY.strip().replace("strlen(text) * 2", "bytes").replace("d.source, length(text)", "d.source, d.bytes, length(text)")}
    SELECT doc_id::VARCHAR AS doc_id, source AS doc_type, CASE WHEN doc_id % 7 IN (0, 3) THEN 'fail' ELSE status END AS status, (CASE WHEN doc_id % 7 IN (0, 3) THEN 1 ELSE n_issues END)::INTEGER AS n_issues,
           CASE doc_id % 7 WHEN 0 THEN 'RuntimeError' WHEN 3 THEN 'ValueError' ELSE '' END AS raised, chars, round(yield_ratio, 9) AS yield_ratio FROM g"""
)
def validation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on all pages as files, every seventh a PDF that nothing here reads, another seventh of an unknown format."""
    form = F.when(F.col("page_id") % 7 == 0, "pdf").when(F.col("page_id") % 7 == 3, "xyz").otherwise("html")
    kind = F.when(F.col("page_id") % 2 == 0, "email").otherwise("page")
    read = files.extract_texts(page_files(spark, sf_dir).select("doc_id", "path", "content", form.alias("format"), kind.alias("doc_type"), F.octet_length("content").alias("length")))
    checked = quality.validate(t.normalise_documents(read.drop("content", "path")))
    raised = F.regexp_extract(F.array_join("issues", " "), "extraction raised (\\w+)", 1)
    return rounded(checked.select("doc_id", "doc_type", "status", F.size("issues").alias("n_issues"), raised.alias("raised"), "chars", "yield_ratio"), 9)


@query(f"WITH {SQL_QUALITY.strip()} SELECT doc_id FROM g WHERE status = 'fail'")
def failed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flagged(graded(spark, sf_dir), "fail")


# --- embedding cache ------------------------------------------------------------------------


def half_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that holds the texts of even ids."""
    even = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    return even.select(F.lit("m").alias("model"), t.content_key(F.col("text")).alias("key")).distinct().withColumn("embedding", F.array().cast("array<float>"))


@query("SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.misses(table(spark, sf_dir, "documents"), half_cache(spark, sf_dir), "m").select("key")


@query(
    """WITH k AS (SELECT sha256(text) AS key, count(*) AS n, max((doc_id % 2 = 0)::INTEGER) AS c FROM documents GROUP BY 1)
    SELECT sum(n)::BIGINT AS total, count(*)::BIGINT AS unique_texts, sum(c)::BIGINT AS cached, (count(*) - sum(c))::BIGINT AS to_embed, round(sum(c) / count(*), 9) AS hit_rate FROM k"""
)
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(embedding.cache_stats(table(spark, sf_dir, "documents"), half_cache(spark, sf_dir), "m"), 9)


# --- answers --------------------------------------------------------------------------------

SQL_STOP = ", ".join(f"'{w}'" for w in answers.ANSWER_STOPWORDS)
SQL_REMAP_STOP = ", ".join(f"'{w}'" for w in answers.REMAP_STOPWORDS)
SQL_TERMS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9,.$%-]*')), lambda x: length(x) > 2 AND x NOT IN ({1}))"
SQL_QA = f"""
qa AS (SELECT a.conv_id, a.turn, a.text AS gen, u.text AS ref FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
sc AS (SELECT conv_id, turn, turn % 4 = 3 AS refused, coalesce(len(list_intersect(r, g)) / nullif(len(r), 0), 0)::DOUBLE AS recall
       FROM (SELECT conv_id, turn, {SQL_TERMS.format("ref", SQL_STOP)} AS r, {SQL_TERMS.format("gen || CASE WHEN turn % 4 = 3 THEN ' I cannot answer this from the provided documents.' ELSE '' END", SQL_STOP)} AS g FROM qa))"""


def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers to the user turn before; every fourth turn refuses."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference_answer"))
    refusal = F.when(F.col("turn") % 4 == 3, f" {answers.REFUSAL}").otherwise("")
    return turns.where("role = 'assistant'").select("conv_id", "turn", F.concat("text", refusal).alias("generated_answer")).join(asked, ["conv_id", "turn"])


@query(f"SELECT conv_id, turn, len({SQL_TERMS.format('text', SQL_STOP)})::BIGINT AS n_terms, len({SQL_TERMS.format('text', SQL_REMAP_STOP)})::BIGINT AS n_salient FROM conversations")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.size(answers.key_terms(F.col("text"))).cast("bigint").alias("n_terms"), F.size(answers.key_terms(F.col("text"), answers.REMAP_STOPWORDS)).cast("bigint").alias("n_salient")
    )


@query(f"WITH {SQL_QA.strip()} SELECT conv_id, turn, refused, round(recall, 9) AS key_fact_recall, (NOT refused AND recall >= 0.6) AS lexical_correct FROM sc")
def key_fact_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(answers.score_answers(question_answers(spark, sf_dir)).drop("generated_answer", "reference_answer"), 9)


@query(
    f"""WITH {SQL_QA.strip()} SELECT count(*)::BIGINT AS questions, count(*) FILTER (refused)::BIGINT AS refused, count(*) FILTER (NOT refused)::BIGINT AS answered,
    round(coalesce(avg(recall) FILTER (NOT refused), 0), 6) AS mean_key_fact_recall, round(coalesce(avg((recall >= 0.6)::INTEGER) FILTER (NOT refused), 0), 6) AS lexical_accuracy FROM sc"""
)
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(answers.answer_summary(answers.score_answers(question_answers(spark, sf_dir))))


@query(
    f"""WITH {SQL_QA.strip()}, v AS (SELECT conv_id, turn, upper(text) AS r FROM conversations WHERE role = 'assistant'),
    j AS (SELECT sc.*, CASE WHEN refused THEN NULL WHEN contains(r, 'CORRECT') THEN 'CORRECT' WHEN contains(r, 'PARTIAL') OR turn % 3 = 0 THEN 'PARTIAL' WHEN contains(r, 'WRONG') OR turn % 3 = 1 THEN 'WRONG' WHEN contains(r, 'REFUSED') THEN 'REFUSED' ELSE 'UNPARSED' END AS judge FROM sc JOIN v USING (conv_id, turn))
    SELECT count(*)::BIGINT AS questions, count(*) FILTER (refused)::BIGINT AS refused, count(*) FILTER (NOT refused)::BIGINT AS answered,
    round(coalesce(avg(recall) FILTER (NOT refused), 0), 6) AS mean_key_fact_recall, round(coalesce(avg((recall >= 0.6)::INTEGER) FILTER (NOT refused), 0), 6) AS lexical_accuracy,
    count(*) FILTER (judge = 'CORRECT')::BIGINT AS judge_correct, count(*) FILTER (judge = 'PARTIAL')::BIGINT AS judge_partial, count(*) FILTER (judge = 'WRONG')::BIGINT AS judge_wrong,
    count(*) FILTER (judge = 'REFUSED')::BIGINT AS judge_refused, count(*) FILTER (judge = 'UNPARSED')::BIGINT AS judge_unparsed, count(judge)::BIGINT AS judged,
    round(coalesce(count(*) FILTER (judge = 'CORRECT') / nullif(count(judge), 0), 0), 6) AS correct_share, round(coalesce(count(*) FILTER (judge IN ('CORRECT', 'PARTIAL')) / nullif(count(judge), 0), 0), 6) AS at_least_partial_share FROM j"""
)
def answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored answers beside the verdicts on them; a judge stands in who adds a word by the turn's number."""
    scored = answers.score_answers(question_answers(spark, sf_dir))
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    word = F.when(F.col("turn") % 3 == 0, " partial").when(F.col("turn") % 3 == 1, " wrong").otherwise("")
    judged = scored.join(said, ["conv_id", "turn"]).withColumn("judge", F.when(~F.col("refused"), answers.parse_verdict(F.concat("text", word))))
    return rounded(reports.answer_report(judged))


SQL_CITED = """
x AS (SELECT conv_id, turn, text || CASE turn % 5 WHEN 0 THEN ' [1] and [' || turn || ']' WHEN 1 THEN ' 【2†L1-L4】【9】' WHEN 2 THEN ' I CANNOT answer this from the provided documents.' WHEN 3 THEN ' [12345678901234567890123]' ELSE '' END AS answer FROM conversations),
y AS (SELECT conv_id, turn, contains(lower(answer), 'i cannot answer this from the provided documents.') AS refused,
      list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '[\\[【](\\d+)[^\\]】\\[【]{0,20}[\\]】]', 1), lambda v: try_cast(v AS BIGINT)), lambda v: v BETWEEN 1 AND 3))) AS c FROM x)""".replace("\\\\", "\\")


@query(f"WITH {SQL_CITED.strip()} SELECT conv_id, turn, array_to_string(c, ',') AS citations, len(c) > 0 AS has_citation, refused AS refused_unsupported, CASE WHEN refused THEN 'refused' WHEN len(c) > 0 THEN 'cited' ELSE 'UNGROUNDED' END AS faithfulness_flag FROM y")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(spark, sf_dir).select("conv_id", "turn", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"), "has_citation", "refused_unsupported", "faithfulness_flag")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with synthetic citations, judged against three sources."""
    k = F.col("turn") % 5
    tail = (
        F.when(k == 0, F.concat(F.lit(" [1] and ["), F.col("turn").cast("string"), F.lit("]")))
        .when(k == 1, " 【2†L1-L4】【9】")
        .when(k == 2, " I CANNOT answer this from the provided documents.")
        .when(k == 3, " [12345678901234567890123]")
        .otherwise("")
    )
    return table(spark, sf_dir, "conversations").withColumns(answers.faithfulness(F.concat("text", tail), F.lit(3)))


@query(f"WITH {SQL_CITED.strip()} SELECT f.flag AS faithfulness_flag, count(y.conv_id)::BIGINT AS n FROM (VALUES ('cited'), ('refused'), ('UNGROUNDED')) f(flag) LEFT JOIN y ON f.flag = CASE WHEN refused THEN 'refused' WHEN len(c) > 0 THEN 'cited' ELSE 'UNGROUNDED' END GROUP BY 1")
def flag_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.flag_distribution(annotated(spark, sf_dir))


@query(
    f"""WITH {SQL_BM25.strip()} SELECT b.item_id AS query_id, sha256('SOURCES:' || chr(10) || string_agg('[' || rank || '] (' || source || ' ' || lang || ', ' || d.doc_id || ', section: ' || n_chars || ')' || chr(10) || d.text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'QUESTION: ' || any_value(b.text) || chr(10) || chr(10) || 'ANSWER:') AS prompt_sha256
    FROM sparse s JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 5 GROUP BY 1"""
)
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    hits = retrieval(spark, sf_dir).search(asked, 5, "bm25").select("query_id", "rank", F.col("source").alias("ticker"), F.col("lang").alias("form"), F.col("doc_id").cast("string").alias("filing_date"), F.col("n_chars").cast("string").alias("section"), "text")
    return answers.prompts(asked, hits).select("query_id", t.content_key(F.col("prompt")).alias("prompt_sha256"))


@query(
    """SELECT conv_id, turn, CASE WHEN contains(r, 'CORRECT') THEN 'CORRECT' WHEN contains(r, 'PARTIAL') THEN 'PARTIAL' WHEN contains(r, 'WRONG') THEN 'WRONG' WHEN contains(r, 'REFUSED') THEN 'REFUSED' ELSE 'UNPARSED' END AS verdict
    FROM (SELECT conv_id, turn, upper(coalesce(text, '') || ' ' || ['It is incorrect', 'partial.', 'wrong', 'Refused', 'maybe?'][(turn % 5 + 1)::INTEGER]) AS r FROM conversations)"""
)
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a judge's reasoning, with a verdict behind."""
    replies = F.array(*(F.lit(x) for x in ("It is incorrect", "partial.", "wrong", "Refused", "maybe?")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.parse_verdict(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.get(replies, (F.col("turn") % 5).cast("int")))).alias("verdict"))


# --- remapping ------------------------------------------------------------------------------

#: Benchmark items as questions about the documents of the same source number; languages as sections.
SQL_REMAP = f"""
q AS (SELECT item_id AS id, 'src' || (item_id % 22) AS gold_doc_id, (['en', 'fr', 'xx'])[(item_id % 3 + 1)::INTEGER] AS gold_section, 'none' AS gold_chunk_id, {SQL_TERMS.format("text", SQL_REMAP_STOP)} AS a, {SQL_TERMS.format("text", SQL_REMAP_STOP)} AS qt FROM benchmark),
c AS (SELECT source AS gold_doc_id, doc_id::VARCHAR AS chunk_id, lang AS section, doc_id AS pos, {SQL_TERMS.format("text", SQL_REMAP_STOP)} AS ct FROM documents),
s AS (SELECT id, gold_section, chunk_id, section, pos, len(list_intersect(a, ct)) / len(a) + 0.25 * coalesce(len(list_intersect(qt, ct)) / nullif(len(qt), 0), 0) AS score FROM q JOIN c USING (gold_doc_id) WHERE len(a) > 0),
any_ AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, pos) = 1),
own AS (SELECT * FROM s WHERE score > 0 AND section = gold_section QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, pos) = 1)"""


def remap_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "benchmark")
    section = F.get(F.array(*(F.lit(x) for x in ("en", "fr", "xx"))), (F.col("item_id") % 3).cast("int"))
    asked = items.select(F.col("item_id").alias("id"), F.col("text").alias("query"), F.col("text").alias("reference_answer"), F.concat(F.lit("src"), (F.col("item_id") % 22).cast("string")).alias("gold_doc_id"), section.alias("gold_section"), F.lit("none").alias("gold_chunk_id"))
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("section"), F.col("doc_id").alias("pos"), "text")
    return asked, chunks


@query(f"WITH {SQL_REMAP.strip()} SELECT id, chunk_id, section, round(score, 6) AS score FROM any_")
def best_matching_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.best_matches(answers.matching_scores(*remap_inputs(spark, sf_dir))).select("id", "chunk_id", "section", F.round("score", 6).alias("score"))


@query(
    f"""WITH {SQL_REMAP.strip()},
    j AS (SELECT q.id, q.gold_section, q.gold_doc_id IN (SELECT gold_doc_id FROM c) AS has_doc, (q.gold_doc_id, q.gold_section) IN (SELECT (gold_doc_id, section) FROM c) AS has_sec,
          own.chunk_id AS oc, own.score AS os, any_.chunk_id AS ac, any_.section AS asec, any_.score AS asc_ FROM q LEFT JOIN own USING (id) LEFT JOIN any_ USING (id)),
    u AS (SELECT *, NOT has_doc OR (NOT has_sec AND (coalesce(asc_, 0) < 0.3 OR (asec <> gold_section AND asc_ < 0.75))) AS bad FROM j),
    v AS (SELECT id, gold_section, bad, CASE WHEN bad THEN 'none' WHEN has_sec THEN CASE WHEN os >= 0.3 THEN oc ELSE 'none' END ELSE ac END AS chunk_id, CASE WHEN bad OR has_sec THEN gold_section ELSE asec END AS section FROM u)
    SELECT id, chunk_id, section, CASE WHEN bad THEN 'unresolved' WHEN chunk_id <> 'none' OR section <> gold_section THEN 'changed' ELSE 'unchanged' END AS outcome FROM v"""
)
def guarded_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.guarded_remap(*remap_inputs(spark, sf_dir)).drop("reason")


# --- corpus management ----------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.cap_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 20)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 2")
def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return corpus.cap_per_group(rows, "o_custkey", [F.col("o_orderdate").desc(), "o_orderkey"], 2).drop("o_orderdate")


@query(
    """SELECT o_custkey AS cik, (row_number() OVER w - 1)::INTEGER AS pos, o_orderdate AS filing_date, o_orderkey AS accession FROM orders WHERE o_orderstatus = 'F'
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) QUALIFY row_number() OVER w <= 2"""
)
def latest_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings of their customer in parallel arrays, newest first; the status is the form."""
    rows = F.array_sort(F.collect_list(F.struct((-F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))).alias("newest"), "o_orderkey", "o_orderdate", "o_orderstatus")))
    each = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cik")).agg(rows.alias("x"))
    arrays = each.select("cik", F.col("x.o_orderstatus").alias("form"), F.col("x.o_orderdate").alias("filingDate"), F.col("x.o_orderkey").alias("accessionNumber"), F.col("x.o_orderkey").alias("primaryDocument"))
    return corpus.latest_filings(arrays, "F", 2).select("cik", "pos", F.col("filingDate").alias("filing_date"), F.col("accessionNumber").alias("accession"))


@query(
    """WITH g AS (SELECT DISTINCT source FROM documents WHERE doc_id % 97 = 0), k AS (SELECT doc_id FROM documents WHERE source IN (SELECT source FROM g)),
    o AS (SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM g) ORDER BY sha256('42|' || doc_id) LIMIT (SELECT greatest(0, 800 - count(*)) FROM k)) SELECT doc_id FROM k UNION ALL SELECT doc_id FROM o"""
)
def gold_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return corpus.gold_subset(docs, docs.where("doc_id % 97 = 0"), ["source"], 800, 42, "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY sha256('42|' || doc_id) LIMIT 25")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), 25, 42, "doc_id")


@query("SELECT source, lang, count(*)::BIGINT AS size FROM documents GROUP BY ALL")
def section_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.section_sizes(table(spark, sf_dir, "documents"), ["source", "lang"])


@query("SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.manifest_counts(table(spark, sf_dir, "documents"), "lang")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS key FROM documents GROUP BY 2")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.distinct_first(table(spark, sf_dir, "documents").select("doc_id", t.content_key(F.col("text")).alias("key")), "key", "doc_id")


@query(
    """SELECT event_type, count(*)::BIGINT AS n, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(list_sort(list(value))[greatest(1, floor(count(*) * 0.95::DOUBLE))::BIGINT], 6) AS p95_ms, round(avg(value), 6) AS mean_ms,
    round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms, round(coalesce(1000.0 / nullif(quantile_cont(value, 0.5), 0), 0), 6) AS qps FROM events WHERE value IS NOT NULL GROUP BY 1"""
)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.latency_summary(table(spark, sf_dir, "events"), "event_type"))


@query(
    f"""WITH {SQL_BM25.strip()} SELECT item_id AS query_id, string_agg(rank || '. [' || printf('%.3f', round(score, 3)) || '] ' || source || ' / ' || lang || ': ' || translate(left(d.text, 140), chr(10), ' '), chr(10) ORDER BY rank) AS report
    FROM sparse JOIN documents d USING (doc_id) WHERE rank <= 3 GROUP BY 1"""
)
def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of every benchmark item, as a report to read."""
    found = retrieval(spark, sf_dir).search(questions(spark, sf_dir), 3, "bm25").withColumn("score", F.round("score", 3))
    return reports.smoke_report(found, ["source", "lang"])


@query("SELECT conv_id, turn, translate(left(text, 140), chr(10), ' ') AS snippet FROM conversations")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.snippet(F.col("text")).alias("snippet"))


# --- chunk statistics and reports -----------------------------------------------------------


@query(
    r"""WITH c AS (SELECT source, lang, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL)
    SELECT count(DISTINCT source)::BIGINT AS documents, count(DISTINCT (source, lang))::BIGINT AS sections, count(*)::BIGINT AS chunks, min(w)::BIGINT AS min_words, max(w)::BIGINT AS max_words, round(avg(w), 6) AS mean_words FROM c"""
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = texts(spark, sf_dir, "source", "lang").where("text IS NOT NULL").select(F.col("source").alias("doc_id"), F.col("lang").alias("section"), t.n_words(F.col("text")).cast("bigint").alias("word_count"))
    return rounded(chunking.corpus_stats(chunks))


@query(
    f"""WITH documents AS (SELECT doc_id, text || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |' || chr(10) || text AS text FROM documents), {SQL_BLOCKS.strip()}
    SELECT doc_id, count(*)::INTEGER AS n_blocks, string_agg(CASE WHEN tab THEN 'table' ELSE 'prose' END, ',' ORDER BY b) AS kinds, sha256(string_agg(body, chr(1) ORDER BY b)) AS bodies_sha256 FROM blk GROUP BY 1"""
)
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text before and after a table."""
    blocks = texts(spark, sf_dir).where("text IS NOT NULL").select("doc_id", chunking.split_blocks(F.concat("text", F.lit("\n| a | b |\n| 1 | 2 |\n"), "text")).alias("b"))
    return blocks.select("doc_id", F.size("b").alias("n_blocks"), F.array_join("b.kind", ",").alias("kinds"), t.content_key(F.array_join("b.body", "\x01")).alias("bodies_sha256"))


@query(
    f"""WITH documents AS (SELECT doc_id, 'fine print: ' || doc_id || ' 2 km HIJ' || chr(10) || text AS text FROM documents WHERE text IS NOT NULL), {SQL_CLEAN.strip()}
    SELECT doc_id, sha256(text) AS text_sha256 FROM norm"""
)
def nfkc_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts behind a line of ligatures, wide and circled characters, through the whole cleaning, NFKC included."""
    line = F.concat(F.lit("ﬁne print： "), F.col("doc_id").cast("string"), F.lit(" ② ㎞ ＨＩＪ\n"))
    docs = texts(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.concat(line, "text").alias("text"))
    return t.normalise_documents(docs).select("doc_id", t.content_key(F.col("text")).alias("text_sha256"))


@query(
    f"""WITH {SQL_CITED.strip()} SELECT CASE WHEN refused THEN 'refused' WHEN len(c) > 0 THEN 'cited' ELSE 'UNGROUNDED' END AS faithfulness_flag, count(*)::BIGINT AS n, round(avg((turn % 3 = 0)::INTEGER), 6) AS hit_at_k FROM y GROUP BY 1"""
)
def generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as generated answers; every third counts as a retrieval hit."""
    return rounded(reports.generation_report(annotated(spark, sf_dir).withColumn("retrieval_hit_at_k", F.col("turn") % 3 == 0)))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
