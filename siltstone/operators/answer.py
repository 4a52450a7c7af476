"""From hits to prompts, answers and query metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import GenerateConfig

#: Parts of a prompt (fixed values).
CONTEXT, QUESTION, ANSWER, SOURCE = "--- KONTEKST ---", "--- PITANJE ---", "--- ODGOVOR ---", "izvor"
#: The answer without any hit (a fixed value).
NO_ANSWER = "Nisam pronašao relevantne informacije za ovo pitanje."

Generator = Callable[[str], dict]


def build_prompt(query: Column, hits: Column, system_prompt: str) -> Column:
    """A prompt from an array of (rank, source, text), which is put in order of rank."""
    lines = F.transform(F.array_sort(hits), lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit(f"] ({SOURCE}: "), h["source"], F.lit(") "), h["text"]))
    return F.concat(F.lit(f"{system_prompt}\n\n{CONTEXT}\n"), F.array_join(lines, "\n\n"), F.lit(f"\n\n{QUESTION}\n"), query, F.lit(f"\n\n{ANSWER}\n"))


def stub_generator(config: GenerateConfig = GenerateConfig()) -> Generator:
    """Answers with the prompt's last question; for tests and dry runs."""

    def generate(prompt: str) -> dict:
        words = prompt.split()
        return {"answer": prompt.rsplit(QUESTION, 1)[-1].split(ANSWER)[0].strip(), "prompt_tokens": len(words), "response_tokens": min(len(words), config.max_tokens), "latency_ms": 0}

    return generate


def http_generator(base_url: str, config: GenerateConfig = GenerateConfig(), timeout: float = 120.0) -> Generator:
    """A model server that takes a prompt at /api/generate and answers in one piece; path and keys are its protocol (fixed values)."""

    def generate(prompt: str) -> dict:
        import json
        from urllib.request import Request, urlopen

        body = {"model": config.model, "prompt": prompt, "stream": False, "options": {"num_predict": config.max_tokens, "temperature": config.temperature}}
        with urlopen(Request(f"{base_url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=timeout) as response:
            got = json.load(response)
        return {"answer": got.get("response", "").strip(), "prompt_tokens": got.get("prompt_eval_count", 0), "response_tokens": got.get("eval_count", 0), "latency_ms": round(got.get("total_duration", 0) / 1e6)}

    return generate


def summarise(queries: DataFrame, hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Per query: num_chunks, top_score, avg_top3_score, sources, fallback; queries without hits too."""
    scores = hits.withColumn("score4", F.round("score", 4))
    per = scores.groupBy(query_id).agg(
        F.count(F.lit(1)).cast("int").alias("num_chunks"), F.max("score4").alias("top_score"), F.avg(F.when(F.col("rank") <= 3, F.col("score4"))).alias("avg_top3_score"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    joined = queries.join(per, query_id, "left")
    return joined.select(
        *queries.columns, F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"), zero("top_score"), zero("avg_top3_score"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.col("num_chunks").isNull().alias("fallback"),
    )


def ask(queries: DataFrame, hits: DataFrame, make_generator: Callable[[], Generator], config: GenerateConfig = GenerateConfig(), query_id: str = "query_id", text_col: str = "query") -> DataFrame:
    """Answers of a batch of queries; the generator runs for queries with hits only."""

    @F.pandas_udf("struct<answer:string,prompt_tokens:int,response_tokens:int,latency_ms:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        generate = make_generator()
        for batch in batches:
            yield pd.DataFrame([generate(p) for p in batch], columns=["answer", "prompt_tokens", "response_tokens", "latency_ms"])

    context = hits.groupBy(query_id).agg(F.collect_list(F.struct("rank", "source", "text")).alias("_hits"))
    prompts = queries.join(context, query_id).select(query_id, build_prompt(F.col(text_col), F.col("_hits"), config.system_prompt).alias("prompt"))
    answers = prompts.withColumn("_g", run("prompt")).select(query_id, "prompt", "_g.*")
    return summarise(queries, hits, query_id).join(answers, query_id, "left").withColumn("answer", F.coalesce("answer", F.lit(NO_ANSWER)))
