"""Model services over tables: embedding, gating and reranking by a model that the caller plugs in.

A service is a callable on a list of texts.  It is made by a factory inside each task, once, so it may hold a client or a loaded model;
the factory must be picklable.  Rows pass in batches of ``batch`` texts.  A call is tried ``attempts`` times; an answer of another
length than its batch, or a vector of another length than ``dims`` or with a component that is no finite number, counts as a failed call.  A batch that keeps
failing is halved until the rows that cannot be served stand alone; these are set aside with the error, all others are served.

``sync_embeddings`` keeps a stored table of vectors by the hash of their text: only hashes that it lacks are embedded, hashes that no chunk
has any more are hidden, and each wave of the work is published on its own, so a run that broke off is taken up where its last wave ended.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorequarry.operators.vectors import sanitised
from lorequarry.sources import versions

Service = Callable[[list[str]], Sequence[Any]]
BATCH = 64


class BadAnswer(ValueError):
    """An answer that does not fit its batch."""


def checked_vectors(answer: Sequence[Any], n: int, dims: int) -> list[list[float]]:
    """The vectors of an answer for n texts."""
    if len(answer) != n:
        raise BadAnswer(f"{len(answer)} vectors for {n} texts")
    out = [[float(x) for x in v] for v in answer]
    for v in out:
        if len(v) != dims:
            raise BadAnswer(f"a vector of {len(v)} components instead of {dims}")
        if not all(map(math.isfinite, v)):
            raise BadAnswer("a component that is no finite number")
    return out


def checked_scores(answer: Sequence[Any], n: int) -> list[float]:
    """The scores of an answer for n texts."""
    if len(answer) != n:
        raise BadAnswer(f"{len(answer)} scores for {n} texts")
    return [float(x) for x in answer]


def served(service: Service, texts: list[str], check: Callable, attempts: int, wait: float) -> list[tuple[Any, str | None]]:
    """(answer, error) of each text; a batch that fails is halved until the rows at fault stand alone."""
    error = ""
    for turn in range(attempts):
        if turn:
            time.sleep(wait * 2 ** (turn - 1))
        try:
            return [(a, None) for a in check(service(texts), len(texts))]
        except Exception as e:  # noqa: BLE001 - whatever a service raises is kept as the row's error
            error = f"{type(e).__name__}: {e}"[:500]
    if len(texts) == 1:
        return [(None, error)]
    half = len(texts) // 2
    return [r for part in (texts[:half], texts[half:]) for r in served(service, part, check, attempts, wait)]


def answered(rows: DataFrame, text_col: str, factory: Callable[[], Service], kind: str, check: Callable, batch: int = BATCH, attempts: int = 3, wait: float = 0.1) -> DataFrame:
    """rows with answer (of that SQL type) and error; columns of these names are replaced.  A null text has a null answer and is not sent."""
    kept = [f for f in rows.schema.fields if f.name not in ("answer", "error")]
    at_text = [f.name for f in kept].index(text_col)
    schema = T.StructType([*kept, T.StructField("answer", T._parse_datatype_string(kind)), T.StructField("error", T.StringType())])
    arrow_kind = pa.list_(pa.float64()) if kind.startswith("array") else pa.float64()

    def serve(batches):
        service = factory()
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                texts = part.column(at_text).to_pylist()
                some = [i for i, t in enumerate(texts) if t is not None]
                out: list[tuple[Any, str | None]] = [(None, None)] * len(texts)
                for i, r in zip(some, served(service, [texts[i] for i in some], check, attempts, wait) if some else [], strict=True):
                    out[i] = r
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r[0] for r in out], arrow_kind), pa.array([r[1] for r in out], pa.string())], names=[*part.schema.names, "answer", "error"])

    return rows.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(serve, schema)


def embedded(rows: DataFrame, text_col: str, factory: Callable[[], Service], dims: int, **how) -> DataFrame:
    """rows with embedding (tiny components cleared, unit length) and error."""

    def check(answer, n):
        return checked_vectors(answer, n, dims)

    out = answered(rows.drop("embedding"), text_col, factory, "array<double>", check, **how)
    return out.withColumn("embedding", sanitised(F.col("answer"))).drop("answer")


def yes_probability(candidates: Column) -> Column:
    """exp of the log-probability of YES among a model's likeliest tokens (a map of token to log-probability); 0 where it is not among them."""
    keys = F.transform(F.map_keys(candidates), lambda k: F.upper(F.trim(k)))
    place = F.array_position(keys, "YES")
    return F.when(place > 0, F.exp(F.get(F.map_values(candidates), place.cast("int") - 1))).otherwise(F.lit(0.0))


def gated(rows: DataFrame, text_col: str, factory: Callable[[], Service], threshold: float, **how) -> DataFrame:
    """The rows that a gating service gives at least the threshold of probability; a row that cannot be served does not pass."""
    return answered(rows, text_col, factory, "double", checked_scores, **how).where(F.col("answer") >= threshold).drop("answer", "error")


def reranked(rows: DataFrame, text_col: str, id_col: str, factory: Callable[[], Service], n: int, **how) -> DataFrame:
    """The n rows of the highest relevance, with it; ties by id.  Rows that cannot be served come last."""
    out = answered(rows, text_col, factory, "double", checked_scores, **how).withColumnRenamed("answer", "relevance")
    return out.orderBy(F.desc_nulls_last("relevance"), id_col).limit(n)


class PreparedQuery:
    """A query that is embedded once; asking for its vector before that, or preparing it twice, is an error."""

    def __init__(self, text: str):
        self.text = text
        self._vector: list[float] | None = None

    def prepare(self, service: Service, dims: int) -> PreparedQuery:
        if self._vector is not None:
            raise RuntimeError("the query is prepared already")
        raw = [x if abs(x) >= 1e-10 else 0.0 for x in checked_vectors(service([self.text]), 1, dims)[0]]
        norm = math.sqrt(sum(x * x for x in raw))
        self._vector = [x / norm for x in raw] if norm > 0 else raw
        return self

    @property
    def vector(self) -> list[float]:
        if self._vector is None:
            raise RuntimeError("the query is not prepared")
        return self._vector


@dataclass(frozen=True)
class EmbeddingStore:
    """Stored vectors by hash: parts of immutable files, named by a versioned manifest."""

    spark: SparkSession
    folder: str
    version: int
    parts: tuple[dict, ...]  # name, place, rows, failed, hidden: numbers of rows

    def _read(self, kind: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema + ", place int")
        for p in self.parts:
            if p[kind]:
                out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/parts/{p['name']}/{kind}").withColumn("place", F.lit(p["place"])))
        return out

    def vectors(self) -> DataFrame:
        """(hash, embedding) of what is stored and not hidden."""
        rows = self._read("rows", "hash string, embedding array<double>")
        last = self._read("hidden", "hash string").groupBy(F.col("hash").alias("__hash")).agg(F.max("place").alias("__place"))
        return rows.join(last, (F.col("hash") == F.col("__hash")) & (F.col("__place") > F.col("place")), "left_anti").select("hash", "embedding")

    def quarantined(self) -> DataFrame:
        """(hash, error) of what could not be embedded, and was not since."""
        return self._read("failed", "hash string, error string").groupBy("hash").agg(F.max_by("error", "place").alias("error")).join(self.vectors().select("hash"), "hash", "left_anti")


def open_store(spark: SparkSession, folder: str) -> EmbeddingStore:
    number, content = versions.latest(spark, folder) or (0, {"parts": []})
    return EmbeddingStore(spark, folder, number, tuple(content["parts"]))


def _publish(store: EmbeddingStore, part: dict) -> EmbeddingStore:
    parts = [*store.parts, part]
    versions.publish(store.spark, store.folder, store.version + 1, {"parts": parts})
    return EmbeddingStore(store.spark, store.folder, store.version + 1, tuple(parts))


def sync_embeddings(store: EmbeddingStore, chunks: DataFrame, factory: Callable[[], Service], dims: int, waves: int = 1, **how) -> EmbeddingStore:
    """The version whose vectors are those of the chunks (hash, text): equal hashes are one text and are embedded once.

    A wave takes one in ``waves`` of the missing hashes and is published before the next begins.  Quarantined hashes are tried again at each call.
    """
    spark = store.spark
    wanted = chunks.where("hash is not null").groupBy("hash").agg(F.min("text").alias("text"))
    gone = store.vectors().select("hash").join(wanted.select("hash"), "hash", "left_anti")
    for wave in range(waves):
        missing = wanted.where(F.pmod(F.xxhash64("hash"), F.lit(waves)) == wave).join(store.vectors().select("hash"), "hash", "left_anti")
        name = uuid.uuid4().hex
        at = f"{store.folder}/parts/{name}"
        part = {"name": name, "place": store.parts[-1]["place"] + 1 if store.parts else 0}
        embedded(missing, "text", factory, dims, **how).select("hash", "embedding", "error").write.parquet(f"{at}/work")
        work = spark.read.schema("hash string, embedding array<double>, error string").parquet(f"{at}/work")
        work.where("error is null and embedding is not null").select("hash", "embedding").write.parquet(f"{at}/rows")
        work.where("error is not null").select("hash", "error").write.parquet(f"{at}/failed")
        (gone if wave == 0 else gone.limit(0)).write.parquet(f"{at}/hidden")
        for kind, schema in (("rows", "hash string"), ("failed", "hash string"), ("hidden", "hash string")):
            part[kind] = spark.read.schema(schema).parquet(f"{at}/{kind}").count()
        path, files = versions._files(spark, f"{at}/work")
        files.delete(path, True)
        if part["rows"] or part["failed"] or part["hidden"]:
            store = _publish(store, part)
    return store
