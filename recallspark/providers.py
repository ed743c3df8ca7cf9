"""Model providers: extraction, intent, summary, reading, embedding. Deterministic offline ones stand in by default.

A provider is a plain function over one request; it runs on the executors, one Arrow batch at a time, and is retried when its
answer breaks the contract.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import EmbeddingError, ExtractionError
from .functions import identity
from .shipping import ship

MEMORY_FIELDS = frozenset({"memory_type", "memory_text", "subject_type", "subject_name", "predicate", "value", "confidence", "importance"})
INTENT_FIELDS = frozenset({"predicate", "value", "temporal_scope"})
UNKNOWN = "UNKNOWN"
ABSTAINED = "I don't have enough stored information to answer that."
DIMENSIONS = 64

_FACTS = ((re.compile(r"\bI live in ([A-Z]\w+)"), "location"), (re.compile(r"\bI (?:use|code in|write) ([A-Z][\w+#]*)"), "programming_language"), (re.compile(r"\bmy name is ([A-Z]\w+)", re.IGNORECASE), "name"))


def _unfenced(answer: str) -> str:
    """The lines between a first line of three backticks, with json or nothing after them, and a last one of three backticks."""
    lines = answer.strip().split("\n")
    if len(lines) > 2 and lines[0].rstrip().lower() in ("```", "```json") and lines[-1] == "```":
        return "\n".join(lines[1:-1])
    return answer


def content_of(response: object) -> str | None:
    """The text of a chat completion, as an object or a dict; None if it has none."""

    def get(x: object, name: str) -> object:
        return x.get(name) if isinstance(x, dict) else getattr(x, name, None)

    choices = get(response, "choices")
    first = choices[0] if isinstance(choices, (list, tuple)) and choices else None
    text = get(get(first, "message"), "content")
    return text if isinstance(text, str) else None


def _object(answer: str | None) -> dict:
    try:
        found = json.loads(_unfenced(answer or ""))
    except ValueError as e:
        raise ExtractionError(f"not JSON: {e}", "invalid_json") from None
    if not isinstance(found, dict):
        raise ExtractionError("not an object", "schema_validation")
    return found


def _blank_to_none(x: object, path: str) -> str | None:
    if x is not None and not isinstance(x, str):
        raise ExtractionError(f"{path}: not a text", "schema_validation")
    return x.strip() or None if x is not None else None


def parse_extraction(answer: str) -> list[dict]:
    """The memories of an answer: one JSON object, nothing around it, no unknown keys, no sources of the provider's own. Blank fields are null. What is wrong is named by its path."""
    found = _object(answer)
    if set(found) != {"memories"} or not isinstance(found["memories"], list):
        raise ExtractionError("memories: missing, no list, or not the only field", "schema_validation")
    out = []
    for i, m in enumerate(found["memories"]):
        at = f"memories[{i}]"
        if not isinstance(m, dict):
            raise ExtractionError(f"{at}: not an object", "schema_validation")
        if set(m) - MEMORY_FIELDS:
            raise ExtractionError(f"{at}.{min(set(m) - MEMORY_FIELDS)}: unknown field", "schema_validation")
        clean = {k: _blank_to_none(m.get(k), f"{at}.{k}") for k in MEMORY_FIELDS - {"confidence", "importance"}}
        if clean["memory_text"] is None:
            raise ExtractionError(f"{at}.memory_text: blank", "schema_validation")
        if clean["memory_type"] not in ("semantic", "episodic"):
            raise ExtractionError(f"{at}.memory_type: neither semantic nor episodic", "schema_validation")
        for k in ("confidence", "importance"):
            x = m.get(k, 0.5)
            if isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 <= x <= 1:
                raise ExtractionError(f"{at}.{k}: not a number from 0 to 1", "schema_validation")
            clean[k] = float(x)
        out.append(clean)
    return out


def parse_intent(answer: str) -> dict:
    found = _object(answer)
    if set(found) - INTENT_FIELDS:
        raise ExtractionError(f"{min(set(found) - INTENT_FIELDS)}: unknown field", "schema_validation")
    if found.get("temporal_scope") not in ("current", "historical", "any"):
        raise ExtractionError("temporal_scope: none of current, historical, any", "schema_validation")
    return {"predicate": _blank_to_none(found.get("predicate"), "predicate"), "temporal_scope": found["temporal_scope"], "value": _blank_to_none(found.get("value"), "value")}


def error_category(error: BaseException) -> str:
    """What kind of failure an error is, by its own type and those it came from, never by its text."""
    seen: BaseException | None = error
    while seen is not None:
        name = type(seen).__name__.lower()
        if isinstance(seen, ExtractionError) and seen.category != "other":
            return seen.category
        if isinstance(seen, TimeoutError) or "timeout" in name:
            return "timeout"
        if "ratelimit" in name:
            return "rate_limit"
        if isinstance(seen, ConnectionError) or "connection" in name:
            return "connection"
        seen = seen.__cause__
    return "other"


def is_transient(category: str) -> bool:
    return category in ("timeout", "rate_limit", "connection")


def predicate_guidance() -> str:
    """The known predicates, one a line, with how many values each holds and its other names, as a prompt tells them."""
    other: dict[str, list[str]] = {}
    for name, known in identity.ALIASES.items():
        other.setdefault(known, []).append(name)
    kind = {**dict.fromkeys(identity.SINGLE, "one value"), **dict.fromkeys(identity.MULTI, "any number of values")}
    return "\n".join(f"{p}: {k}" + (f"; also called {', '.join(other[p])}" if p in other else "") for p, k in kind.items())


def intent_prompt() -> str:
    return f"""Say what a question asks of a person's stored facts. Answer with one JSON object with predicate, value and temporal_scope.
predicate is one of those below or null, value is a text that the fact must have or null, temporal_scope is current, historical or any.
{predicate_guidance()}"""


def with_attempts(call: Callable[[str, str], str], request: str, parse: Callable[[str], object], attempts: int = 3) -> object:
    """parse(call(request, note)); a broken answer is asked for again with a note of what was wrong. Errors of the provider itself are not retried."""
    note = ""
    for k in range(attempts):
        try:
            return parse(call(request, note))
        except ExtractionError as e:
            note = f"The last answer was rejected ({e.category}): {e}. Answer with the JSON object alone."
            if k == attempts - 1:
                raise
    raise AssertionError


def offline_extractor(request: str, note: str = "") -> str:
    """Facts of a few fixed sentence forms, and the rest as one episodic memory."""
    text = json.loads(request)["text"]
    found = [{"memory_type": "semantic", "memory_text": m[0], "subject_type": "user", "predicate": p, "value": m[1], "confidence": 0.9, "importance": 0.6} for r, p in _FACTS for m in r.finditer(text)]
    if not found and text.strip():
        found = [{"memory_type": "episodic", "memory_text": text.strip(), "confidence": 0.5, "importance": 0.3}]
    return json.dumps({"memories": found})


def offline_embedding(text: str) -> list[float]:
    """A unit vector of hashed tokens; the same for the same tokens."""
    v = np.zeros(DIMENSIONS)
    for t in re.findall(r"[a-z0-9]+", text.lower()) or [""]:
        h = hashlib.md5(t.encode()).digest()
        v[h[0] % DIMENSIONS] += 1 if h[1] & 1 else -1
        v[h[2] % DIMENSIONS] += 0.5
    n = np.linalg.norm(v)
    return (v / n if n else np.eye(DIMENSIONS)[0]).tolist()


def offline_reader(request: str) -> str:
    """The text of the first memory that shares a word of four letters or more with the question, or UNKNOWN."""
    r = json.loads(request)
    words = set(re.findall(r"\w{4,}", r["query"].lower()))
    return next((m["text"] for m in r["memories"] if words & set(re.findall(r"\w{4,}", m["text"].lower()))), UNKNOWN)


_EXTRACTED = "conv_id long, interaction long, memory_no int, memory_type string, memory_text string, subject_type string, subject_name string, predicate string, value string, confidence double, importance double, sources array<long>, error string, error_category string"


def extract(interactions: DataFrame, extractor: Callable[[str, str], str] = offline_extractor, attempts: int = 3) -> DataFrame:
    """Candidates of interactions(conv_id, interaction, text, sources). A failed interaction gives one row with its error and no memory."""
    ship(interactions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    found = with_attempts(extractor, json.dumps({"text": r.text}), parse_extraction, attempts)
                except Exception as e:  # whatever a provider raises fails its interaction alone
                    out.append((r.conv_id, r.interaction, None, *[None] * 8, list(r.sources), str(e), error_category(e)))
                    continue
                out += [(r.conv_id, r.interaction, i, m["memory_type"], m["memory_text"], m.get("subject_type"), m.get("subject_name"), m.get("predicate"), m.get("value"), float(m.get("confidence", 0.5)), float(m.get("importance", 0.5)), list(r.sources), None, None) for i, m in enumerate(found)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _EXTRACTED.split(", ")]).astype({"memory_no": "Int32"})

    return interactions.select("conv_id", "interaction", "text", "sources").mapInPandas(run, _EXTRACTED)


def offline_intent(request: str, note: str = "") -> str:
    """The intent of a few forms of questions; others ask for nothing in particular."""
    words = set(re.findall(r"[a-z]+", json.loads(request)["query"].lower()))
    predicate = next((p for p, telling in _ASKED if words & telling), None)
    scope = "historical" if words & {"formerly", "previously", "before", "once"} else "current" if predicate else "any"
    return json.dumps({"predicate": predicate, "value": None, "temporal_scope": scope})


def offline_summary(request: str) -> str:
    """The previous summary and the first sentence of each new message."""
    r = json.loads(request)
    return " ".join([*([r["previous_summary"]] if r["previous_summary"] else []), *(re.split(r"(?<=[.!?])\s", m["content"].strip())[0] for m in r["messages"])])


#: Words by which the offline intent knows a predicate.
_ASKED = (("location", {"live", "lives", "city", "home"}), ("timezone", {"timezone"}), ("programming_language", {"language", "languages"}), ("name", {"name", "called"}))

_INTENT = "scope string, qid long, predicate string, value string, temporal_scope string, attempted boolean, ok boolean, error_category string"


def infer_intents(queries: DataFrame, intent: Callable[[str, str], str] | None = offline_intent, attempts: int = 3) -> DataFrame:
    """The intent of each of queries(scope, qid, text), with attempted, ok and error_category. A failed or absent provider gives a row without an intent, so the search
    goes on without one."""
    ship(queries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                row = {"predicate": None, "value": None, "temporal_scope": None}
                error = None
                if intent is not None:
                    try:
                        row = with_attempts(intent, json.dumps({"query": r.text}), parse_intent, attempts)
                    except Exception as e:  # whatever a provider raises must not stop the search
                        error = error_category(e)
                out.append((r.scope, r.qid, row["predicate"], row["value"], row["temporal_scope"], intent is not None, intent is not None and error is None, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _INTENT.split(", ")])

    return queries.select(F.col("scope").cast("string").alias("scope"), F.col("qid").cast("long").alias("qid"), "text").mapInPandas(run, _INTENT)


def embed(rows: DataFrame, column: str = "text", embedding: Callable[[str], list[float]] = offline_embedding) -> DataFrame:
    """rows with v, one call for each distinct text of a batch."""
    return embed_batches(rows, lambda: lambda texts: [embedding(t) for t in texts], column)


def embed_batches(rows: DataFrame, factory: Callable[[], Callable[[list[str]], list[list[float]]]], column: str = "text") -> DataFrame:
    """rows with v. factory makes one client for each task; it is asked once a batch for the batch's distinct texts. An answer of another
    length than the request, or with vectors of different lengths, is an EmbeddingError; null texts have none."""
    ship(rows)

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = factory()
        for texts in batches:
            asked = list(texts.dropna().unique())
            got = client(asked) if asked else []
            if len(got) != len(asked) or len({len(v) for v in got}) > 1:
                raise EmbeddingError("the provider's vectors are not one for each text, of one dimension")
            yield texts.map(dict(zip(asked, got, strict=True)).get)

    return rows.withColumn("v", vectors(F.col(column)))


def answer(found: DataFrame, reader: Callable[[str], str] = offline_reader) -> DataFrame:
    """(scope, qid, answer, abstained) for found(scope, qid, query, memories); memories is an array<struct<ref, text, status>> in the order of rank. Without memories the reader is not asked."""
    ship(found)
    request = F.to_json(F.struct("query", "memories"))

    @F.pandas_udf("string")
    def read(requests: pd.Series) -> pd.Series:
        return requests.map(lambda r: UNKNOWN if not json.loads(r)["memories"] else reader(r).strip())

    out = found.withColumn("raw", read(request)).withColumn("abstained", F.col("raw") == UNKNOWN)
    return out.select("scope", "qid", F.when(F.col("abstained"), ABSTAINED).otherwise(F.col("raw")).alias("answer"), "abstained")
