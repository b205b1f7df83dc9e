"""Answers from language models behind a plain callable, with fallback and retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.answers import REFUSAL, faithfulness, is_refusal, parse_verdict, prompts

# Instructions to the model, the judge's question, rounds and pauses.
SYSTEM_PROMPT = (
    "You are a financial-filings assistant. Answer the user's question using ONLY the numbered source excerpts provided below -- never use outside knowledge, "
    "even if you are confident it is correct.\n\nRules:\n- Every factual claim in your answer must end with a citation to the source number it came from, like [1] or [2][3].\n"
    f'- If the sources do not contain enough information to answer, respond with exactly: "{REFUSAL}" -- do not guess or fill gaps from general knowledge.\n'
    "- Be concise. Do not repeat the question."
)
JUDGE_PROMPT = (
    "Compare a CANDIDATE answer against a REFERENCE answer.\n\nReply with exactly one word:\nCORRECT   - the candidate conveys the same facts as the reference\n"
    "PARTIAL   - some facts right, but incomplete or partly wrong\nWRONG     - contradicts the reference or answers a different question\nREFUSED   - the candidate declines to answer\n\n"
    "Ignore wording, length and style. Judge only whether the facts match.\n\nREFERENCE: {reference}\n\nCANDIDATE: {candidate}\n\nVERDICT:"
)
MAX_ANSWER_TOKENS = 1024
ROUNDS, BACKOFF_S = 4, 4.0

#: A provider's name, and a callable from a prompt to its reply (or None where it has no key).
Provider = tuple[str, Callable[[str], str] | None]


@lru_cache(16)
def client(factory: Callable[[], object]) -> object:
    """One client per factory and worker."""
    return factory()


def ask(prompt: str, providers: list[Provider], rounds: int = ROUNDS, pause: Callable[[float], None] = time.sleep) -> tuple[str, str]:
    """(provider, reply) of the first provider that answers; all are tried again after growing pauses."""
    errors: list[str] = []
    for turn in range(rounds):
        if turn:
            pause(BACKOFF_S * 2 ** (turn - 1))
        errors = []
        for name, call in providers:
            if call is None:
                errors.append(f"{name}: not configured")
                continue
            try:
                return name, call(prompt)
            except Exception as e:
                errors.append(f"{name}: {e}")
    raise RuntimeError(f"no provider answered: {errors}")


def answer_all(prompted: DataFrame, providers: list[Provider], prompt_col: str = "prompt") -> DataFrame:
    """Adds provider, generated_answer and error per prompt, in Arrow batches; one failure spares the others."""
    at = prompted.columns.index(prompt_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for prompt in b.column(at).to_pylist():
                try:
                    rows.append((*ask(prompt or "", providers), None))
                except RuntimeError as e:
                    rows.append((None, None, str(e)))
            names, replies, errors = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.string()) for x in (names, replies, errors))], names=[*b.schema.names, "provider", "generated_answer", "error"])

    none = F.lit(None).cast("string")
    return prompted.mapInArrow(run, prompted.withColumns({"provider": none, "generated_answer": none, "error": none}).schema)


def generate_answers(queries: DataFrame, hits: DataFrame, providers: list[Provider]) -> DataFrame:
    """Prompt, answer and faithfulness for each query; hits as for prompts()."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n_sources"))
    answered = answer_all(prompts(queries, hits), providers).join(n, "query_id", "left")
    return answered.withColumns(faithfulness(F.col("generated_answer"), F.coalesce("n_sources", F.lit(0))))


def judge_answers(answers: DataFrame, providers: list[Provider]) -> DataFrame:
    """Adds judge: the verdict on each answer that is not a refusal, null on those."""
    template = JUDGE_PROMPT.split("{reference}")
    between, after = template[1].split("{candidate}")
    asked = answers.where(~is_refusal(F.col("generated_answer"))).withColumn("judge_prompt", F.concat(F.lit(template[0]), "reference_answer", F.lit(between), "generated_answer", F.lit(after)))
    replies = answer_all(asked.select("id", "judge_prompt"), providers, "judge_prompt").select("id", parse_verdict(F.col("generated_answer")).alias("judge"))
    return answers.join(replies, "id", "left")


def with_retrieval(answered: DataFrame, metrics: DataFrame) -> DataFrame:
    """Adds retrieval_hit_at_k to the answers of a run: whether the question's gold was among its first k, from the metrics per query."""
    hit = metrics.select("query_id", (F.col("hit_at_k") > 0).alias("retrieval_hit_at_k"))
    return answered.join(hit, "query_id", "left").withColumn("retrieval_hit_at_k", F.coalesce("retrieval_hit_at_k", F.lit(False)))


def traces(queries: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """One nested row per query: the answer and the context it was given."""
    context = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ticker", "form", "section", "score", "text"))).alias("retrieved_context"))
    return queries.join(answers.drop("query", "prompt"), "query_id", "left").join(context, "query_id", "left")
