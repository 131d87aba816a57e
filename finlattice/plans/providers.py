"""Calls to models, behind one function that answers a batch of prompts."""

from __future__ import annotations

import base64
import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (prompts, images or Nones) -> an answer for each. It runs in the workers, so it must be picklable.
Ask = Callable[[list, list], list]


@dataclass(frozen=True)
class ChatEndpoint:
    """A model behind a chat endpoint: JSON with model, messages and stream=false is posted, message.content is the answer.

    Images go along as base64. One call per prompt; a status other than 2xx or an answer of another shape is an error.
    """

    url: str
    model: str
    patience: float = 600.0

    def __call__(self, prompts: list, images: list) -> list:
        return [self.one(p, i) for p, i in zip(prompts, images, strict=True)]

    def one(self, prompt: str, image) -> str:
        said = {"role": "user", "content": prompt} | ({"images": [base64.b64encode(bytes(image)).decode()]} if image is not None else {})
        body = json.dumps({"model": self.model, "messages": [said], "stream": False}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.patience) as reply:
            return json.load(reply)["message"]["content"]


def answers(requests: DataFrame, ask: Ask, batch: int = 8, pause: float = 0.0) -> DataFrame:
    """Requests (prompt, perhaps image, and other columns) with answer, error and ms instead of prompt and image.

    A batch that fails is asked once more, after `pause` seconds; if it fails again, its rows have an error and no
    answer. Rows without a prompt aren't asked. The result should be written (tables.kept) before it is used twice.
    """
    out = [c for c in requests.columns if c not in ("prompt", "image")]
    schema = requests.select(*out).schema.add("answer", "string").add("error", "string").add("ms", "double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            prompts, images = list(whole["prompt"]), list(whole["image"]) if "image" in whole else [None] * len(whole)
            said, errors, ms = [], [], []
            for i in range(0, len(whole), batch):
                n = len(prompts[i : i + batch])
                began, got, error = time.monotonic(), None, None
                for again in range(2):
                    try:
                        got, error = list(ask(prompts[i : i + batch], images[i : i + batch])), None
                        if len(got) != n:
                            raise ValueError(f"{len(got)} answers to {n} prompts")
                        break
                    except Exception as e:  # a provider may raise anything
                        got, error = None, f"{type(e).__name__}: {e}"
                        if not again:
                            time.sleep(pause)
                said += got if got is not None else [None] * n
                errors += [error] * n
                ms += [1000 * (time.monotonic() - began) / n] * n
            yield whole[out].assign(answer=said, error=errors, ms=ms)  # one frame, however small the model's batches are

    return requests.where("prompt is not null").mapInPandas(run, schema)


def call_log(answered: DataFrame, node: str) -> DataFrame:
    """One event per call: node, ms, token estimate of the answer, success."""
    return answered.select(F.lit(node).alias("node"), "ms", F.floor(F.length(F.coalesce("answer", F.lit(""))) / 4).alias("response_tokens"), F.col("error").isNull().alias("success"))


def safe_name(model: str) -> str:
    """A model's name as part of a path."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", model)


def says_yes(answer):
    return F.startswith(F.upper(F.trim(answer)), F.lit("YES"))
