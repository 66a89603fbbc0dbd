"""Model services behind small interfaces, with deterministic local stand-ins.

A backend is any picklable object with the named methods; it is sent to the workers once a task and fed in batches.
"""

from __future__ import annotations

import concurrent.futures
import hashlib
import importlib.metadata
import warnings
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from larkspur.functions.validate import cast_value, check_value


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class HashEmbedder:
    """Counts of words in hashed places, at length 1."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in t.lower().split():
                v[int.from_bytes(hashlib.sha1(w.encode()).digest()[:4], "big") % self.dimension] += 1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out


class OverlapReranker:
    """The share of the query's words in the text."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(t.lower().split())) / len(words) if words else 0.0 for t in texts]


def embed(rows: DataFrame, key: str, text: str, backend: Embedder, batch: int = 10, key_type: str = "long") -> DataFrame:
    """(key, v) of every row with a key and a text, in requests of at most ``batch`` texts. A reply of another count or
    dimension is an error."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column("t").to_pylist(), []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                reply = backend.embed(part)
                if len(reply) != len(part) or any(len(v) != backend.dimension for v in reply):
                    raise ValueError("the reply doesn't fit the request")
                out += reply
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out, pa.list_(pa.float32()))], ["k", "v"])

    d = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast(key_type).alias("k"), F.col(text).alias("t"))
    return d.mapInArrow(of, f"k {key_type}, v array<float>").withColumnRenamed("k", key)


def rerank(pairs: DataFrame, backend: Reranker) -> DataFrame:
    """(query_id, key, rerank_score) of pairs (query_id, query, key, text). Each query makes one call with all its texts,
    which are the pool of a search, a bounded list. A reply of another length is an error."""

    def of(key: tuple, table: pa.Table) -> pa.Table:
        keys, texts = table.column("key").to_pylist(), table.column("text").to_pylist()
        scores = [float(s) for s in backend.score(table.column("query")[0].as_py(), texts)]
        if len(scores) != len(texts):
            raise ValueError("the reply doesn't fit the request")
        return pa.table([pa.array([key[0].as_py()] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "key", "rerank_score"])

    d = pairs.where("query is not null and text is not null").select(F.col("query_id").cast("long").alias("query_id"), "query", F.col("key").cast("long").alias("key"), "text")
    return d.groupBy("query_id").applyInArrow(of, "query_id long, key long, rerank_score double")


def verdict(n_evidence: Column, covered: Column, needed: float = 0.5) -> Column:
    """The default assessor: no_evidence, sufficient or insufficient by the share of the query's terms covered."""
    return F.when(F.coalesce(n_evidence, F.lit(0)) == 0, "no_evidence").when(covered >= needed, "sufficient").otherwise("insufficient")


STATUSES = ("sufficient", "insufficient", "no_evidence", "assessment_error")


def assess(evidence: DataFrame, assessor: Callable[[str, list[str]], dict], seconds: float = 30.0) -> DataFrame:
    """(query_id, status, reason) of evidence (query_id, query, texts): what an injected assessor says of each query's
    texts. No texts are no_evidence without a call. A reply must be a mapping with a status of sufficient or insufficient
    and a text as reason; any other reply, an exception, or more than ``seconds`` is assessment_error with its reason."""

    def one(query: str, texts: list[str]) -> tuple[str, str]:
        if not texts:
            return "no_evidence", "nothing was found"
        pool = concurrent.futures.ThreadPoolExecutor(1)
        try:
            reply = pool.submit(assessor, query, texts).result(seconds)
        except concurrent.futures.TimeoutError:
            return "assessment_error", "timeout"
        except Exception as e:
            return "assessment_error", f"{type(e).__name__}: {e}"
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        if not isinstance(reply, dict) or reply.get("status") not in STATUSES[:2] or not isinstance(reply.get("reason", ""), str):
            return "assessment_error", "invalid reply"
        return reply["status"], reply.get("reason", "")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(q or "", t or []) for q, t in zip(b.column("query").to_pylist(), b.column("texts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["query_id", "status", "reason"])

    d = evidence.select(F.col("query_id").cast("long").alias("query_id"), "query", "texts")
    return d.mapInArrow(of, "query_id long, status string, reason string")


class Tools:
    """Named functions with a JSON schema of their arguments, which are cast and checked before the call."""

    def __init__(self):
        self._tools: dict[str, tuple[Callable, dict]] = {}

    def add(self, name: str, call: Callable, schema: dict) -> None:
        if name in self._tools:
            raise ValueError(f"{name} is there already")
        if schema.get("type", "object") != "object":
            raise ValueError("arguments are an object")
        self._tools[name] = (call, {"type": "object"} | schema)

    def names(self) -> list[str]:
        return sorted(self._tools)

    def run(self, name: str, **arguments):
        if name not in self._tools:
            raise KeyError(name)
        call, schema = self._tools[name]
        cast = cast_value(arguments, schema)
        errors = check_value(cast, schema)
        if errors:
            raise ValueError(f"arguments of {name}: {'; '.join(errors)}")
        return call(**cast)


def plug_ins(group: str, base: type | None = None) -> dict[str, object]:
    """What installed packages offer under an entry-point group, by name; what doesn't load, or isn't a ``base``, is left
    out and told as a warning."""
    found = {}
    for point in importlib.metadata.entry_points(group=group):
        try:
            thing = point.load()
            if base is not None and not (isinstance(thing, type) and issubclass(thing, base)):
                raise TypeError(f"no {base.__name__}")
            found[point.name] = thing
        except Exception as e:
            warnings.warn(f"{point.name} of {group} is left out: {e}", stacklevel=2)
    return found


class Progress(StreamingQueryListener):
    """Hands progress to observers; one that fails is counted and does no harm to the others."""

    def __init__(self, *observers: Callable):
        self.observers, self.failures = observers, 0

    def _tell(self, event) -> None:
        for o in self.observers:
            try:
                o(event)
            except Exception:
                self.failures += 1

    def onQueryStarted(self, event) -> None:
        self._tell(event)

    def onQueryProgress(self, event) -> None:
        self._tell(event)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._tell(event)
