"""What stands outside the engine: language models, embedders, symbol extractors and rerankers, with offline defaults."""

from __future__ import annotations

import ast
import hashlib
import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codelode.functions import fixed


class LanguageModel(Protocol):
    def complete(self, system: str, user: str, schema: dict | None = None, max_tokens: int = 2048) -> str: ...


class Offline:
    """Deterministic stand-in: an empty object where a schema is asked for, else the first lines of the context."""

    def complete(self, system: str, user: str, schema: dict | None = None, max_tokens: int = 2048) -> str:
        if schema is not None:
            return json.dumps({k: [] if v == "array" else "" for k, v in schema.items()})
        return "\n".join(user.split("\n")[:20])[:max_tokens]


def with_retry(call: Callable[[], str], retries: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """Again after 5, 10, 20 seconds where the service says that there are too many calls; None when it keeps saying so."""
    for k in range(retries):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if not re.search(r"429|rate", str(e), re.I):
                raise
            sleep(wait * 2**k)
    return None


def json_from_text(text: str):
    """The text as JSON, else its first fenced block, else its first balanced object; None if none of them is."""
    for found in (text, *re.findall(r"```(?:json)?\s*\n?(.*?)\n?```", text or "", re.S)[:1]):
        try:
            return json.loads(found)
        except (TypeError, ValueError):
            pass
    start = (text or "").find("{")
    depth = 0
    for at in range(start, len(text)) if start >= 0 else ():
        depth += (text[at] == "{") - (text[at] == "}")
        if depth == 0:
            try:
                return json.loads(text[start : at + 1])
            except ValueError:
                return None
    return None


#: what a model is asked for, by field
MODULE_SCHEMA = {"purpose": "string", "key_patterns": "array", "domain_concepts": "array", "key_abstractions": "array"}
PROJECT_SCHEMA = {"purpose": "string", "architecture": "string", "key_patterns": "array", "domain": "string", "data_flow": "string", "tech_decisions": "string"}
ANSWER_SCHEMA = {"answer": "string", "citations": "array", "relevant_files": "array", "confidence": "string", "follow_up": "array", "needs_more_context": "boolean", "additional_files": "array"}


def structured(model: LanguageModel, system: str, user: str, schema: dict, max_tokens: int) -> dict:
    """The fields of a schema as the model fills them, of their kinds; where it gives no object, its plain text is the first field."""
    said = with_retry(lambda: model.complete(system, user, schema, max_tokens)) or ""
    got = json_from_text(said)
    if not isinstance(got, dict):
        got = {next(iter(schema)): said}
    if not any(got.get(k) for k in schema):
        got = {next(iter(schema)): with_retry(lambda: model.complete(system, user, None, max_tokens)) or ""}
    listed = lambda v: [str(x) for x in v] if isinstance(v, list) else []
    return {k: listed(got.get(k)) if kind == "array" else str(got.get(k) or "") for k, kind in schema.items()}


@dataclass
class Answer:
    """A model's answer with the places it cites; anything that isn't of this form is plain text."""

    answer: str
    citations: list[dict] = field(default_factory=list)
    relevant_files: list[str] = field(default_factory=list)
    confidence: str = "medium"
    follow_up: list[str] = field(default_factory=list)
    needs_more_context: bool = False
    additional_files: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, text: str | None, confidence: str = "medium") -> Answer:
        got = json_from_text(text or "")
        if not isinstance(got, dict) or "answer" not in got:
            return cls(text or "", confidence=confidence)
        texts = lambda k: [str(x) for x in got.get(k) or [] if isinstance(x, str)]
        sure = got.get("confidence") if got.get("confidence") in ("high", "medium", "low") else confidence
        cited = [c for c in map(citation, got.get("citations") or []) if c]
        return cls(str(got["answer"] or ""), cited, texts("relevant_files"), sure, texts("follow_up"), bool(got.get("needs_more_context")), texts("additional_files"))


def citation(given) -> dict | None:
    """file and start_line are needed; end_line may be missing, symbol and snippet are empty where they are."""
    if not isinstance(given, dict) or not isinstance(given.get("file"), str) or not isinstance(given.get("start_line"), int):
        return None
    end = given.get("end_line")
    return {"file": given["file"], "start_line": given["start_line"], "end_line": end if isinstance(end, int) else None, "symbol": str(given.get("symbol") or ""), "snippet": str(given.get("snippet") or "")}


@dataclass
class StreamEvent:
    """R06."""

    type: str
    content: str
    chunk_index: int = 0
    metadata: dict = field(default_factory=dict)


def streamed(parts: Iterable[str], on_chunk: Callable[[str], None] | None = None) -> Iterator[StreamEvent]:
    """Chunks as they come, then a done event with counts, or an error event."""
    said, began, first = [], time.monotonic(), None
    try:
        for k, part in enumerate(parts):
            first = time.monotonic() - began if first is None else first
            said.append(part)
            if on_chunk:
                on_chunk(part)
            yield StreamEvent("chunk", part, k)
    except Exception as e:  # noqa: BLE001
        yield StreamEvent("error", str(e), len(said))
        return
    yield StreamEvent("done", "".join(said), len(said), {"first_token_seconds": first or 0.0, "chunks": len(said)})


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Words hashed to signed places of a unit vector; needs no model."""

    def __init__(self, dims: int = 384):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for i, text in enumerate(texts):
            for w in re.findall(r"[a-z]{3,}", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dims] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-12)


def embedded(rows: DataFrame, embedder: Embedder, keys: list[str], text: str) -> DataFrame:
    """(keys, vector); one call of the embedder for each Arrow batch."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys)
            vectors = embedder.embed([t or "" for t in batch.column(n).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(list(vectors), pa.list_(pa.float32()))], names=[*keys, "vector"])

    return rows.select(*keys, text).mapInArrow(run, f"{kinds}, vector array<float>")


def rerank(model: LanguageModel, question: str, chunks: list[dict], most: int = 15, chars: int = 800) -> list[int]:
    """Positions of the chunks as the model orders them; those it leaves out follow in their order."""
    shown = chunks[:most]
    prompt = "\n\n".join(f"[{i}] {c.get('rel_path', '')}\n{(c.get('content') or '')[:chars]}" for i, c in enumerate(shown))
    said = with_retry(lambda: model.complete("Order the chunks by relevance.", f"{question}\n\n{prompt}", {"order": "array"}))
    answer = json_from_text(said or "")
    order = answer.get("order", []) if isinstance(answer, dict) else []
    valid = list(dict.fromkeys(i for i in order if isinstance(i, int) and 0 <= i < len(shown)))
    return valid + [i for i in range(len(chunks)) if i not in set(valid)]


class PythonSymbols:
    """Symbols of Python files by their syntax tree; a file that doesn't parse has none."""

    suffixes = (".py",)

    def symbols(self, texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for project, path, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    try:
                        tree = ast.parse(text or "")
                    except (SyntaxError, ValueError, RecursionError):
                        continue
                    for node in ast.walk(tree):
                        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                            rows.append((project, path, node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.string()] * 4 + [pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["project_id", "rel_path", "name", "type", "line"])

        return texts.select("project_id", "rel_path", "text").mapInArrow(run, "project_id string, rel_path string, name string, type string, line int")


FILE_LIMIT, FOLDER_LIMIT = 8, 3


@dataclass
class Navigation:
    """Where to look for an answer."""

    needs_code: bool
    target_files: list[str] = field(default_factory=list)
    target_folders: list[str] = field(default_factory=list)
    reasoning: str = ""
    search_terms: list[str] = field(default_factory=list)


def ask_where(model: LanguageModel, question: str, project_map: str) -> Navigation | None:
    """P40 in part: the model's decision, lists cut to their limits; None if it gives no usable one."""
    schema = {"needs_code": "boolean", "target_files": "array", "target_folders": "array", "reasoning": "string"}
    answer = json_from_text(with_retry(lambda: model.complete("Which files answer the question?", f"{question}\n\n{project_map}", schema, 500)) or "")
    if not isinstance(answer, dict) or not (answer.get("target_files") or answer.get("target_folders") or answer.get("needs_code") is False):
        return None
    return Navigation(
        bool(answer.get("needs_code", True)), [str(x) for x in answer.get("target_files", [])][:FILE_LIMIT], [str(x) for x in answer.get("target_folders", [])][:FOLDER_LIMIT], str(answer.get("reasoning", ""))
    )


CONTEXT = fixed.CONTEXT_CHARS
