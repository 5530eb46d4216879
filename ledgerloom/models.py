"""The boundary to models that aren't part of the engine: recognition, embedding, scoring, generation.

A runner is given to an operator and called on Arrow batches by an iterator pandas UDF; a failed item gives its error
and keeps its input. The stub is deterministic, for tests and for runs without a model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelRunner(Protocol):
    def ocr(self, image: bytes) -> list[dict]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...

    def generate(self, prompts: list[str]) -> list[str]: ...


class StubRunner:
    """Vectors from hashed words, scores from shared words, answers that repeat the prompt's last line."""

    def __init__(self, size: int = 16):
        self.size = size

    def ocr(self, image: bytes) -> list[dict]:
        words = image.decode("utf-8", "ignore").split()
        return [{"text": w, "conf": 100.0, "left": 10 * i, "top": 0, "width": 9, "height": 10, "block_num": 1, "par_num": 1, "line_num": 1} for i, w in enumerate(words)]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            for w in text.lower().split():
                v[hashlib.sha1(w.encode()).digest()[0] % self.size] += 1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        sets = [(set(q.lower().split()), set(t.lower().split())) for q, t in pairs]
        return [len(a & b) / max(1, len(a)) for a, b in sets]

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.strip().rsplit("\n", 1)[-1] for p in prompts]


def embedded(df: DataFrame, text: str, runner: ModelRunner, batch: int = 16) -> DataFrame:
    """df with embedding, texts sent to the model `batch` at a time."""

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in runner.embed(texts[i : i + batch])])

    return df.withColumn("embedding", embed(text))


def scored(df: DataFrame, query: str, text: str, runner: ModelRunner) -> DataFrame:
    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            yield pd.Series(runner.score(list(zip(q.fillna(""), t.fillna(""), strict=True))), dtype="float64")

    return df.withColumn("rerank_score", score(query, text))


def generated(df: DataFrame, prompt: str, runner: ModelRunner, fallback: str | None = None) -> DataFrame:
    """df with answer and error; where the model fails, the answer is the fallback column's, if one is named."""

    @F.pandas_udf("answer string, error string")
    def generate(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p in part.fillna(""):
                try:
                    rows.append((runner.generate([p])[0], None))
                except Exception as e:
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["answer", "error"])

    out = df.withColumn("__made", generate(prompt))
    answer = F.coalesce("__made.answer", fallback) if fallback else F.col("__made.answer")
    return out.withColumn("answer", answer).withColumn("error", F.col("__made.error")).drop("__made")


def recognised(images: DataFrame, runner: ModelRunner) -> DataFrame:
    """Tokens of images (path, content): the token table that the line operators take, and errors."""
    columns = ["text", "conf", "left", "top", "width", "height", "block_num", "par_num", "line_num"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [{"path": path, **token, "error": None} for token in runner.ocr(bytes(content))]
                except Exception as e:
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", *columns, "error"])

    return images.select("path", "content").mapInPandas(read, "path string, text string, conf double, left double, top double, width double, height double, block_num double, par_num double, line_num double, error string")


def polled(status, timeout: float = 60.0, pause: float = 1.0, clock=None, sleep=None) -> tuple[str, str | None]:
    """Asks until a run is completed, failed, cancelled or expired, or the time is over: its state, "timeout" at the end, and its result.

    status() gives (state, result); a driver-side helper for models that answer later.
    """
    import time

    clock, sleep = clock or time.monotonic, sleep or time.sleep
    end = clock() + timeout
    while clock() < end:
        state, result = status()
        if state in ("completed", "failed", "cancelled", "expired"):
            return state, result if state == "completed" else None
        sleep(pause)
    return "timeout", None


def runner_of(mode: str, runners: dict[str, ModelRunner], default: str = "stub") -> ModelRunner:
    """The runner that a mode names, else the default one; the stub needs no entry."""
    known = {"stub": StubRunner(), **runners}
    return known.get(mode, known[default])


def rewritten(df: DataFrame, text: str, instruction: str, runner: ModelRunner, column: str = "rewritten") -> DataFrame:
    """df with each text rewritten by a model after an instruction; the text itself where the model fails or says nothing."""
    asked = df.withColumn("__prompt", F.concat(F.lit(f"{instruction}\n"), F.coalesce(F.col(text), F.lit(""))))
    done = generated(asked, "__prompt", runner).withColumnRenamed("answer", "__answer")
    return done.withColumn(column, F.when(F.trim(F.coalesce("__answer", F.lit(""))) == "", F.col(text)).otherwise(F.col("__answer"))).select(*df.columns, column)


def recognised_pages(images: DataFrame, runner: ModelRunner) -> DataFrame:
    """path, line_no, line of page images (path, content): tokens from the runner, then visual lines from left to right.

    The per-page driver: recognition, grouping by gaps and reading order in one plan; pages that fail give no line.
    """
    from ledgerloom.operators.lines import joined_in_order, visual_lines

    found = recognised(images, runner).where("error is null and text is not null")
    return visual_lines(found, ["path"]).groupBy("path", "line_no").agg(joined_in_order("left", "text").alias("line"))
