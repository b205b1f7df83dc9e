"""Chunks of a corpus of files, kept up to date: only files that are new or have changed are read again.

A run compares each file's content and metadata, by hash, with what the store has seen. Files that match keep their
chunks; the others go through extraction, cleaning, sections and chunking, and their chunks are appended.
The list of documents says in which run each was chunked, which retires older chunks and those of files that
are gone. Both tables become visible in one step, so a reader sees the corpus before a run or after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import content_key, normalise_documents, token_count
from textloom.operators.chunking import chunk_documents, embed_text
from textloom.operators.extract import no_pdf
from textloom.operators.sections import split_sections
from textloom.session import stored
from textloom.sources.files import extract_texts
from textloom.sources.versions import Versions

META = ("ticker", "company", "form", "doc_type", "format", "filing_date", "source_url")
DOCUMENTS = "doc_id string, key string, run int, error string"
CHUNKS = f"chunk_id string, doc_id string, {', '.join(f'{c} string' for c in META)}, section string, chunk_index int, word_count int, text string, embed_text string, run int"


class ChunkStore:
    """files: (doc_id, content, path, and META, as far as there). doc_id is unique; rows without it are left out."""

    def __init__(self, spark: SparkSession, path: str, pdf: Callable[[bytes], str] = no_pdf, count: Callable[[Column], Column] = token_count):
        self.spark, self.pdf, self.count = spark, pdf, count
        self.versions = Versions(spark, path)

    def documents(self) -> DataFrame:
        """(doc_id, key, run, error) of the corpus; error says why a file has no chunks."""
        return self.versions.read("documents", DOCUMENTS)

    def chunks(self) -> DataFrame:
        """The chunks of the documents as they are now."""
        return self.versions.read("chunks", CHUNKS).join(self.documents().select("doc_id", "run"), ["doc_id", "run"], "left_semi")

    def update(self, files: DataFrame) -> DataFrame:
        """Brings the store to exactly these files; one row: run, unchanged, written, removed, failed."""
        known, segments = self.documents(), self.versions.segments()
        run = (self.versions.numbers() or [0])[-1] + 1
        meta = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in files.columns else F.lit("").alias(c) for c in META]
        rows = files.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "path", "content", *meta)
        keyed = rows.withColumn("key", content_key(F.concat_ws("\x01", F.sha2(F.coalesce("content", F.lit(b"")), 256), *META)))
        read = extract_texts(keyed.join(known.select("doc_id", "key"), ["doc_id", "key"], "left_anti"), self.pdf)
        changed = stored(read.drop("content", "path"), "changed")
        cleaned = normalise_documents(changed.where("error IS NULL").drop("error", "key"))
        parts = chunk_documents(split_sections(cleaned), count=self.count)
        context = embed_text(F.col("company"), F.col("form"), F.col("section"), F.col("text"))
        made = parts.withColumn("embed_text", context).withColumn("run", F.lit(run))
        chunks = self.versions.write("chunks", made.select("chunk_id", "doc_id", *META, "section", "chunk_index", "word_count", "text", "embed_text", "run"))
        same = known.join(keyed.select("doc_id", "key"), ["doc_id", "key"], "left_semi").select("doc_id", "key", "run", "error")
        documents = self.versions.write("documents", same.unionByName(changed.select("doc_id", "key", F.lit(run).alias("run"), "error")))
        self.versions.commit({"chunks": [*segments.get("chunks", []), chunks], "documents": [documents]})
        fresh, failed = F.col("run") == run, F.col("error").isNotNull()
        now = self.documents()
        state = F.when(~fresh, "unchanged").when(failed, "failed").otherwise("written").alias("state")
        states = now.select(state).unionByName(known.join(now, "doc_id", "left_anti").select(F.lit("removed").alias("state")))
        count = lambda *names: F.count_if(F.col("state").isin(*names))
        return states.agg(F.lit(run).alias("run"), count("unchanged").alias("unchanged"), count("written", "failed").alias("written"), count("failed").alias("failed"), count("removed").alias("removed"))

    def compact(self, parts: int = 1) -> None:
        """Rewrites the chunks without retired ones; readers keep what they have opened until forget() of the versions."""
        self.versions.replace("chunks", self.chunks().select(*[c.split()[0] for c in CHUNKS.split(", ")]).repartition(parts, "doc_id"))
