"""Queries on model services, with a service that counts letters, so that SQL can say what it answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorequarry.operators import services as S
from lorequarry.session import shared_folder, table

LETTERS = "aeinrst"


def letters():
    """A service that answers with the counts of some letters, and one that is never 0."""

    def service(texts: list[str]) -> list[list[float]]:
        return [[1.0, *[float(t.count(c)) for c in LETTERS]] for t in texts]

    return service


def share_of_e():
    """A service that answers with the share of the letter e."""

    def service(texts: list[str]) -> list[float]:
        return [t.count("e") / max(len(t), 1) for t in texts]

    return service


def _texts(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


def _synced(s, d):
    """A store that took the documents of all languages but one first, and all of them then, in waves."""
    store = S.open_store(s, f"{shared_folder(s)}/vectors-{uuid.uuid4().hex}")
    store = S.sync_embeddings(store, _texts(s, d).where(F.coalesce("lang", F.lit("")) != "fr"), letters, len(LETTERS) + 1)
    return S.sync_embeddings(store, _texts(s, d), letters, len(LETTERS) + 1, waves=2)


COUNT = "(length(text) - length(replace(text, '{c}', '')))"
NORM = "sqrt(1.0e0 + " + " + ".join(f"pow({COUNT.format(c=c)}, 2)" for c in LETTERS) + ")"
T_SQL = "t AS (SELECT sha256(coalesce(text, '')) AS hash, min(text) AS text FROM documents GROUP BY 1)"

QUERIES = {
    "ck8_embedding_sync": (
        lambda s, d: _synced(s, d).vectors().select("hash", *[F.round(F.get("embedding", F.lit(i)), 6).alias(f"x{i}") for i in range(len(LETTERS) + 1)]),
        f"WITH {T_SQL} SELECT hash, round(1.0e0 / {NORM}, 6) AS x0, " + ", ".join(f"round({COUNT.format(c=c)} / {NORM}, 6) AS x{i + 1}" for i, c in enumerate(LETTERS)) + " FROM t WHERE text IS NOT NULL",
    ),
    "ud4_gated": (
        lambda s, d: S.gated(_texts(s, d).select("doc_id", "text"), "text", share_of_e, 0.1).select("doc_id"),
        f"SELECT doc_id FROM documents WHERE {COUNT.format(c='e')} / greatest(length(text), 1)::DOUBLE >= 0.1e0",
    ),
    "ud4_reranked": (
        lambda s, d: S.reranked(_texts(s, d).where("text is not null").select("doc_id", "text"), "text", "doc_id", share_of_e, 25).select("doc_id", F.round("relevance", 9).alias("relevance")),
        f"SELECT doc_id, round({COUNT.format(c='e')} / greatest(length(text), 1)::DOUBLE, 9) AS relevance FROM documents WHERE text IS NOT NULL ORDER BY {COUNT.format(c='e')} / greatest(length(text), 1)::DOUBLE DESC, doc_id LIMIT 25",
    ),
}
