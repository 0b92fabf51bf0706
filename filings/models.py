"""Calls of models. Whatever is called, a client is built once for each task, an answer that doesn't parse is asked for again, and a failure is a column, not an exception."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from filings.operators.chunking import bag

ATTEMPTS = 3
_FENCE = re.compile(r"^\s*```(?:json)?[ \t]*|\s*```\s*$", re.M)
_FIXES = [(re.compile("[“”]"), '"'), (re.compile(r",\s*([}\]])"), r"\1"), (re.compile(r":\s*True\b"), ": true"), (re.compile(r":\s*False\b"), ": false"), (re.compile(r":\s*None\b"), ": null"), (re.compile(r"(\d)_(\d)"), r"\1\2")]


class ModelClient(Protocol):
    name: str

    def complete(self, prompt: str) -> str: ...


class Rules:
    """The offline stand-in: it names itself, so that no result is taken for a model's."""

    name = "rules"

    def complete(self, prompt: str) -> str:
        words = bag(prompt)
        return json.dumps({"answer": prompt.strip().split("\n")[0][:200], "words": sum(words.values())})


def parse(raw: str) -> dict:
    """The outermost object of raw, read leniently; raises if there is none."""
    m = re.search(r"\{.*\}", _FENCE.sub("", raw), re.S)
    text = m[0] if m else raw
    try:
        out = json.loads(text)
    except ValueError:
        for p, to in _FIXES:
            text = p.sub(to, text)
        out = json.loads(text)
    if not isinstance(out, dict) or {"properties", "type"} <= out.keys():
        raise ValueError("not an object, or a schema sent back")
    return out


def healed(client: ModelClient, prompt: str, attempts: int = ATTEMPTS) -> dict:
    """The parsed answer; after a failure the error is told and the model asked again. The last error is raised."""
    said = prompt
    for k in range(attempts):
        try:
            return parse(client.complete(said))
        except ValueError as e:
            if k == attempts - 1:
                raise
            said = f"{prompt}\n\nYour last answer could not be read ({e}). Answer with one JSON object."
    raise AssertionError


def answered(prompts: DataFrame, make: Callable[[], ModelClient] = Rules) -> DataFrame:
    """(id, model, answer, error) of prompts (id, prompt); null prompts have neither answer nor error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for b in batches:
            ids, texts, answers, errors = b.column(0), b.column(1).to_pylist(), [], []
            for t in texts:
                try:
                    answers.append(None if t is None else json.dumps(healed(client, t)))
                    errors.append(None)
                except Exception as e:  # a client may raise anything
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([ids, pa.array([client.name] * len(texts)), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["id", "model", "answer", "error"])

    return prompts.select(prompts.columns[0], prompts.columns[1]).toDF("id", "prompt").mapInArrow(run, f"id {prompts.dtypes[0][1]}, model string, answer string, error string")
