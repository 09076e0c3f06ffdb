"""Calls of models through injected providers: translation, image description and image class.

A provider is a picklable callable from a list of requests to a list of answers of the same length. Calls are made in batches on the executors; a batch that fails is
answered by what it asked (graceful fallback) and flagged. No provider is built in but `Echo`; `ChatEndpoint` speaks to a compatible server.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import enhance as E

Provider = Callable[[list[str]], list[str]]
#: The classes that an image may be given.
IMAGE_CLASSES = ("CODE_SCREENSHOT", "TABLE_IMAGE", "TEXT_SCREENSHOT", "DIAGRAM", "CHART", "OTHER")


class Echo:
    """A provider without a model: each answer is a mark and the request."""

    def __init__(self, mark: str = "[zh] "):
        self.mark = mark

    def __call__(self, requests: list[str]) -> list[str]:
        return [self.mark + x for x in requests]


class ChatEndpoint:
    """A server with a chat completions interface: one call for each request."""

    def __init__(self, base_url: str, model: str, key: str = "", prompt: str = "", timeout: float = 60.0):
        self.base_url, self.model, self.key, self.prompt, self.timeout = base_url.rstrip("/"), model, key, prompt, timeout

    def __call__(self, requests: list[str]) -> list[str]:
        return [self._one(x) for x in requests]

    def _one(self, text: str) -> str:
        # an image travels as the server's interface wants it, beside what is asked of it
        image = text.startswith("data:image/")
        content = [{"type": "image_url", "image_url": {"url": text}}] if image else text
        body = {"model": self.model, "messages": [{"role": "system", "content": self.prompt}, {"role": "user", "content": content}]}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        call = urllib.request.Request(f"{self.base_url}/chat/completions", json.dumps(body).encode(), head)
        with urllib.request.urlopen(call, timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]


def ask(rows: DataFrame, request: str, provider: Provider, answer: str = "answer", batch: int = 16) -> DataFrame:
    """rows with the provider's answer to the column request, and whether the call succeeded; null requests are not sent."""
    schema = rows.withColumns({answer: F.lit(None).cast("string"), "answered": F.lit(None).cast("boolean")}).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(0, len(part), batch):
                some = part.iloc[k : k + batch].copy()
                asked = [x for x in some[request] if x is not None]
                try:
                    got = list(provider(asked)) if asked else []
                    fine = len(got) == len(asked)
                except Exception:  # a model that fails costs its batch, not the job
                    fine = False
                given = iter(got if fine else asked)
                some[answer] = [None if x is None else next(given) for x in some[request]]
                some["answered"] = [x is not None and fine for x in some[request]]
                yield some

    return rows.mapInPandas(run, schema)


def translate(paragraphs: DataFrame, provider: Provider, route: Column, terms: list[str], enabled: bool = True) -> DataFrame:
    """paragraphs (text and any columns) with translated: what route sends is masked, translated and unmasked, the rest stays; nothing is sent if not enabled.

    Masked are the terms, code in fences or backticks and `Item <n>:`; all are restored.
    """
    send = route.startswith("translate") & F.lit(enabled)
    held = F.regexp_extract_all("text", F.lit(r"```[\s\S]*?```|`[^`\n]*`|Item [0-9]+:"), F.lit(0))
    rows = paragraphs.withColumn("__held", F.coalesce(held, F.array().cast("array<string>")))
    masked = F.aggregate(F.sequence(F.lit(0), F.size("__held")), F.col("text"), lambda a, i: F.when(i < F.size("__held"), F.replace(a, F.get("__held", i), F.concat(F.lit("⟦H"), i.cast("string"), F.lit("⟧")))).otherwise(a))
    rows = ask(rows.withColumn("__asked", F.when(send, E.mask_terms(masked, terms))), "__asked", provider, "__got")
    back = F.aggregate(F.sequence(F.lit(0), F.size("__held")), E.unmask_terms(F.col("__got"), terms), lambda a, i: F.when(i < F.size("__held"), F.replace(a, F.concat(F.lit("⟦H"), i.cast("string"), F.lit("⟧")), F.get("__held", i))).otherwise(a))
    return rows.select(*paragraphs.columns, F.coalesce(back, F.col("text")).alias("translated"))


def image_request(images: DataFrame) -> Column:
    """What is sent of an image: its bytes as a data address if there is a column data that is not empty, else its name."""
    if "data" not in images.columns:
        return F.col("name")
    kind = F.lower(F.regexp_extract("name", r"[.]([A-Za-z0-9]+)$", 1))
    kind = F.when(kind.isin("", "jpg"), "jpeg").otherwise(kind)
    return F.when(F.length("data") > 0, F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64("data"))).otherwise(F.col("name"))


def classify_images(images: DataFrame, provider: Provider) -> DataFrame:
    """images (name, data if the provider is to see them, and any columns) with image_class; an answer that is no class counts as OTHER."""
    rows = ask(images.withColumn("__asked", image_request(images)), "__asked", provider, "__got")
    answer = F.upper(F.trim("__got"))
    return rows.select(*images.columns, F.when(F.col("answered") & answer.isin(*IMAGE_CLASSES), answer).otherwise("OTHER").alias("image_class"))


#: What a provider says of an image, as JSON.
DESCRIPTION = "kind string, conclusion string, elements string, points array<string>"


def describe_images(images: DataFrame, provider: Provider) -> DataFrame:
    """images with note, the description by its template (see image_description); null where the provider failed or its answer is no such JSON.

    Columns of images that are named as a part of the description or as the note are left out.
    """
    rows = ask(images.withColumn("__asked", image_request(images)), "__asked", provider, "__got")
    said = F.from_json("__got", DESCRIPTION)
    rows = rows.withColumn("__said", F.when(F.col("answered"), said))
    parts = rows.withColumns({c: F.coalesce(F.col(f"__said.{c}"), F.lit("")) for c in ("kind", "conclusion", "elements")})
    # points go to the template between semicolons
    parts = parts.withColumn("points", F.array_join(F.transform("__said.points", lambda x: F.replace(x, F.lit(";"), F.lit("；"))), ";"))
    whole = F.col("__said.kind").isNotNull() & F.col("__said.points").isNotNull()
    note = F.when(whole, E.image_description()).alias("note")
    return parts.select(*(c for c in images.columns if c not in ("note", "kind", "conclusion", "elements", "points")), note)
