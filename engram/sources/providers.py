"""Seams to the outside: chat models, embedders, search tools. Their answers enter plans as tables."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ChatProvider(Protocol):
    def chat(self, prompt: str) -> str: ...


class EmbedProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class SearchTool(Protocol):
    name: str

    def search(self, query: str, limit: int) -> str: ...


class Transient(Exception):
    """A failure that may pass: server errors and lost connections."""


def with_retries(call: Callable[[], str], attempts: int = 4, pause: float = 0.2, sleep: Callable[[float], None] = time.sleep) -> str:
    """Up to `attempts` tries, waiting pause * 2**i after transient failures; all other failures are final."""
    for i in range(attempts):
        try:
            return call()
        except Transient:
            if i == attempts - 1:
                raise
            sleep(pause * 2**i)
    raise ValueError("attempts has to be positive")


def ask(prompts: DataFrame, make: Callable[[], ChatProvider]) -> DataFrame:
    """prompts (any keys, prompt) with answer; null where the provider failed. Equal prompts are asked once each."""
    distinct = prompts.select("prompt").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for frame in frames:
            answers = []
            for p in frame["prompt"]:
                try:
                    answers.append(with_retries(lambda p=p: provider.chat(p)))
                except Exception:  # noqa: BLE001  a failed answer voids its unit, not the job
                    answers.append(None)
            yield frame.assign(answer=answers)

    return prompts.join(distinct.mapInPandas(run, "prompt string, answer string"), "prompt", "left")


def embed(texts: DataFrame, make: Callable[[], EmbedProvider], batch: int = 64) -> DataFrame:
    """texts (any keys, text) with v (array<float>). Each different text is embedded once."""
    return texts.join(embed_distinct(texts.select("text").distinct(), make, batch).drop("error"), "text", "left")


def embed_distinct(texts: DataFrame, make: Callable[[], EmbedProvider], batch: int = 64, strict: bool = True) -> DataFrame:
    """texts (text) with v and error (null). strict=False: where a batch fails, its texts are tried one by one, and those that fail get a null vector and the reason."""

    def one(provider: EmbedProvider, text: str) -> tuple[list[float] | None, str | None]:
        try:
            return provider.embed([text])[0], None
        except Exception as e:  # noqa: BLE001  a failed text voids its agent, not the job
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                asked = part["text"].tolist()
                try:
                    yield part.assign(v=provider.embed(asked), error=None)
                except Exception:
                    if strict:
                        raise
                    v, errors = zip(*(one(provider, t) for t in asked), strict=True)
                    yield part.assign(v=list(v), error=list(errors))

    return texts.select("text").mapInPandas(run, "text string, v array<float>, error string")


#: Vectors that a worker keeps.
KEPT_VECTORS = 4096


def remembering(make: Callable[[], EmbedProvider], size: int = KEPT_VECTORS) -> Callable[[], EmbedProvider]:
    """A factory whose providers keep the vectors of the texts they were asked for last (by content hash): only unknown texts are sent on, in order. A factory stands for one
    model and dimension, so its vectors never mix with another's."""

    class Remembering:
        def __init__(self) -> None:
            self.inner, self.kept = make(), OrderedDict()

        def embed(self, texts: list[str]) -> list[list[float]]:
            keys = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            missing = {k: t for k, t in zip(keys, texts, strict=True) if k not in self.kept}
            new = dict(zip(missing, self.inner.embed(list(missing.values())), strict=True)) if missing else {}
            out = [new[k] if k in new else self.kept[k] for k in keys]
            for k, v in zip(keys, out, strict=True):
                self.kept[k] = v
                self.kept.move_to_end(k)
            while len(self.kept) > size:
                self.kept.popitem(last=False)
            return out

    return Remembering


class TableChat:
    """A provider whose answers are given, for tests and replays."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def chat(self, prompt: str) -> str:
        return self.answers[prompt]


class SearchRegistry:
    """Named tools; the first one registered is the default."""

    def __init__(self) -> None:
        self.tools: dict[str, SearchTool] = {}

    def register(self, tool: SearchTool) -> None:
        self.tools[tool.name] = tool

    def search(self, query: str, limit: int, name: str = "") -> str:
        if not self.tools:
            return ""
        if name and name not in self.tools:
            raise KeyError(f"no search tool {name}")
        return self.tools[name or next(iter(self.tools))].search(query, limit)


def parse_answer(answer: str, schema: str):
    """A column of a JSON answer, its code fence taken off; null if it isn't JSON of that form."""
    from engram.functions.text import strip_fence

    return F.from_json(strip_fence(answer), schema)
