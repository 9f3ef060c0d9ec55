"""Delegation of uncertain pages to an external classifier: requests, batches, validated answers, fallbacks."""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import lru_cache
from typing import Annotated, Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.masking import masked
from ..plans.materialise import materialised
from ..plans.rulepack import RulePack
from ..schema import EVIDENCE_CHARS, LABELS

logger = logging.getLogger(__name__)

PROMPT_VERSION = "v1"

#: ``(system prompt, user prompt, settings) -> answer``; raises on any failure.
Client = Callable[[str, str, "Settings"], Any]


@dataclass(frozen=True)
class Settings:
    """Resolved settings of the external classifier; the key itself is never part of them."""

    provider: str = "openai"
    model: str = "gpt-5-mini"
    temperature: float = 0.0
    timeout_seconds: int = 30
    max_retries: int = 2
    batch_size: int = 10
    max_excerpt_chars: int = 1200
    prompt_version: str = PROMPT_VERSION
    enabled: bool = False

    def __post_init__(self) -> None:
        for name, least in (("timeout_seconds", 1), ("max_retries", 0), ("batch_size", 1), ("max_excerpt_chars", 100)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


_MEANINGS = {
    "URLA_1003": "the borrower's residential loan application",
    "INCOME_DOC": "proof of income: pay stubs, wage or tax forms, profit and loss, employment checks",
    "CREDIT_REPORT": "a consumer credit report",
    "TITLE_REPORT": "a preliminary title report or title commitment",
    "OTHER": "anything else, or not to be told",
}


def system_prompt(labels: tuple[str, ...] = LABELS) -> str:
    """What the classifier is asked to do; change ``PROMPT_VERSION`` with it."""
    listed = "\n".join(f"* {label}: {_MEANINGS.get(label, label)}" for label in labels)
    return (
        "You label single pages taken out of a shuffled package of loan papers. A page can come from anywhere in its document.\n"
        f"Labels:\n{listed}\n"
        "Answer with exactly one decision per page_id: page_id, doc_type (one of the labels), confidence from 0 to 1, and a short evidence "
        "text in general words that repeats no names or numbers. Where you can't tell, choose OTHER with a low confidence."
    )


def with_excerpts(pages: DataFrame, rules: RulePack, settings: Settings) -> DataFrame:
    """``excerpt`` in the place of ``text``: masked first, cut afterwards; of a null text it is null."""
    rows = pages.withColumn("text", masked("text", rules.mask))
    return rows.withColumn("excerpt", t.truncated(F.col("text"), settings.max_excerpt_chars)).drop("text")


def requested(pages: DataFrame) -> DataFrame:
    """``(package_id, page_number, excerpt, marker_style, marker_hint)`` of pages with excerpts."""
    return pages.select("package_id", "page_number", "excerpt", "marker_style", t.marker_hint("marker_page", "marker_total").alias("marker_hint"))


def requests(pages: DataFrame, rules: RulePack, settings: Settings) -> DataFrame:
    """What :func:`requested` gives, from pages with texts."""
    columns = ("package_id", "page_number", "text", "marker_style", "marker_page", "marker_total")
    return requested(with_excerpts(pages.select(*columns), rules, settings))


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Adds ``batch_index``: pages of a package in order, ``size`` at a time, from 0."""
    order = Window.partitionBy("package_id").orderBy("page_number")
    return rows.withColumn("batch_index", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def user_prompt(pages: list[dict[str, Any]]) -> str:
    """The pages of one batch as text."""
    parts = ["Classify each of the following pages:"]
    for page in pages:
        parts.append(f"\npage_id: {page['page_number']}\nmarker_hint: {page['marker_hint'] or 'none'}\nexcerpt: {page['excerpt']}")
    return "\n".join(parts)


@lru_cache(maxsize=16)
def _decision_model(labels: tuple[str, ...]):
    from typing import Literal

    from pydantic import BaseModel, ConfigDict, Field

    class Decision(BaseModel):
        model_config = ConfigDict(extra="forbid")
        page_id: Annotated[int, Field(ge=1)]
        doc_type: Literal[labels]  # type: ignore[valid-type]
        confidence: Annotated[float, Field(ge=0.0, le=1.0)]
        evidence: Annotated[str, Field(max_length=EVIDENCE_CHARS)] = ""

    return Decision


def response_schema(labels: tuple[str, ...] = LABELS) -> dict[str, Any]:
    """JSON schema of an answer."""
    item = _decision_model(labels).model_json_schema()
    return {"type": "object", "properties": {"decisions": {"type": "array", "items": item}}, "required": ["decisions"], "additionalProperties": False}


def read_answer(answer: Any, asked: list[int], labels: tuple[str, ...] = LABELS) -> tuple[dict[int, dict[str, Any]], list[str]]:
    """Valid decisions by page, the last of several counting, and the warnings in order.

    Takes a dict, JSON text, or an object with ``decisions``. Items that don't validate are dropped with a warning each, pages that weren't
    asked for without one; a set of pages other than the one asked for adds a warning.
    """
    from pydantic import ValidationError

    if isinstance(answer, (str, bytes)):
        try:
            answer = json.loads(answer)
        except ValueError:
            return {}, ["LLM_PARSE_FAILED"]
    items = answer.get("decisions") if isinstance(answer, dict) else getattr(answer, "decisions", None)
    if not isinstance(items, list):
        return {}, ["LLM_PARSE_FAILED"]
    model, found, warnings = _decision_model(labels), {}, []
    for item in items:
        payload = item.model_dump() if hasattr(item, "model_dump") else item
        try:
            decision = model.model_validate(payload) if isinstance(payload, dict) else None
        except ValidationError:
            decision = None
        if decision is None:
            warnings.append("LLM_LABEL_INVALID")
        elif decision.page_id in asked:
            found[decision.page_id] = {"doc_type": decision.doc_type, "confidence": decision.confidence}
    if set(found) != set(asked):
        warnings.append("LLM_COUNT_MISMATCH")
    return found, warnings


ANSWERS = (
    "package_id string, batch_index int, page_number int, answered boolean, llm_doc_type string, llm_confidence double, page_warnings array<string>, "
    "attempt_count int, succeeded boolean, batch_warnings array<string>, latency_ms long"
)


def answers(asked: DataFrame, client: Client, settings: Settings, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row per requested page, with what its batch went through. Written once: a call is never replayed by a later action.

    A batch is tried ``max_retries + 1`` times. One whose call keeps failing marks all its pages; one that was answered badly marks
    the pages that got no valid decision.
    """
    prompt = system_prompt(labels)

    def call(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pages = pdf.sort_values("page_number").to_dict("records")
        ids = [int(p["page_number"]) for p in pages]
        start, answer, ok, attempt = time.perf_counter(), None, False, 0
        while not ok and attempt <= settings.max_retries:
            attempt += 1
            try:
                answer, ok = client(prompt, user_prompt(pages), settings), True
            except Exception:
                logger.warning("batch %s of package %s: attempt %d failed", key[1], key[0], attempt)
        took = int(1000 * (time.perf_counter() - start))
        found, warnings = read_answer(answer, ids, labels) if ok else ({}, ["LLM_CALL_FAILED"])
        rows = [(key[0], key[1], i, i in found, found.get(i, {}).get("doc_type"), found.get(i, {}).get("confidence"), [] if i in found else warnings, attempt, ok, warnings, took) for i in ids]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return materialised(asked.groupBy("package_id", "batch_index").applyInPandas(call, ANSWERS), "answers")


def call_records(answered: DataFrame) -> DataFrame:
    """One row per call: what was asked, what came back, attempts and time."""
    ids = lambda keep=None: F.array_sort(F.collect_list("page_number" if keep is None else F.when(keep, F.col("page_number"))))
    return answered.groupBy("package_id", "batch_index").agg(
        ids().alias("requested_page_ids"), ids(F.col("answered")).alias("returned_page_ids"), F.max("attempt_count").alias("attempt_count"), F.bool_and("succeeded").alias("succeeded"), F.first("batch_warnings").alias("warnings"), F.max("latency_ms").alias("latency_ms")
    )


def resolved(delegated: DataFrame, answered: DataFrame) -> DataFrame:
    """Delegated pages with their answers: decided ones change label, the others fall back to their rule decision."""
    found = answered.select("package_id", "page_number", F.col("answered").alias("_ok"), F.col("llm_doc_type").alias("_label"), F.col("llm_confidence").alias("_sure"), F.col("page_warnings").alias("_more"))
    rows = delegated.join(found, ["package_id", "page_number"], "left")
    return rows.withColumns({
        "decision_source": F.when(F.col("_ok"), F.lit("LLM")).otherwise(F.lit("RULE_FALLBACK")),
        "doc_type": F.when(F.col("_ok"), F.col("_label")).otherwise(F.col("doc_type")),
        "llm_called": F.lit(True),
        "llm_failed": ~F.coalesce("_ok", F.lit(False)),
        "llm_doc_type": F.when(F.col("_ok"), F.col("_label")),
        "llm_confidence": F.when(F.col("_ok"), F.col("_sure")),
        "warnings": F.concat("warnings", F.coalesce("_more", F.array().cast("array<string>"))),
    }).drop("_ok", "_label", "_sure", "_more")


def emit_order(results: DataFrame, routed: bool) -> DataFrame:
    """Adds ``emit_order``: page order, but delegated pages after the others where pages were ``routed``."""
    keys = [F.col("delegate").cast("int"), F.col("page_number")] if routed else [F.col("page_number")]
    return results.withColumn("emit_order", F.row_number().over(Window.partitionBy("package_id").orderBy(*keys)))


def disabled(classified: DataFrame) -> DataFrame:
    """What routing leaves when no classifier is there: delegated pages keep their decision and get a warning."""
    return classified.withColumn("warnings", F.when(F.col("delegate"), F.array_append("warnings", F.lit("LLM_DISABLED"))).otherwise(F.col("warnings")))


def openai_client(prompt: str, user: str, settings: Settings) -> Any:
    """A client for services that speak the OpenAI protocol; needs that library, and ``LLM_API_KEY`` (``LLM_BASE_URL`` for other services)."""
    key = os.environ.get("LLM_API_KEY", "").strip()
    if not key:
        raise RuntimeError("LLM_API_KEY is not set")
    from openai import OpenAI

    service = OpenAI(api_key=key, base_url=os.environ.get("LLM_BASE_URL") or None)
    done = service.chat.completions.create(
        model=settings.model, temperature=settings.temperature, timeout=settings.timeout_seconds,
        messages=[{"role": "system", "content": prompt}, {"role": "user", "content": user}],
        response_format={"type": "json_schema", "json_schema": {"name": "decisions", "schema": response_schema(), "strict": True}},
    )
    message = done.choices[0].message
    if getattr(message, "refusal", None):
        raise RuntimeError("the request was refused")
    return message.content
