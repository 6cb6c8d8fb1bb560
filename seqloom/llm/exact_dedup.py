"""Exact dedup by a Golomb-coded exchange of fingerprints.

Each chunk of the table sends the owners of hash ranges its sorted, compressed
text hashes; owners answer which of them occur twice or more; only rows so
suspected are shuffled, with their whole texts, and compared byte by byte.
A wrong suspicion costs a shuffled row, never a wrong result, and a row whose
hash its chunk didn't send (nothing assures that a row is read twice from the
same chunk but the chunk's name) counts as suspected.

Defined results: rows with a null text are never duplicates and all stay; empty
texts are equal to each other; of equal texts the row of least doc_id stays
(null ids last), and of rows that agree in that too, one of them; other columns
are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import store


def packed(docs: DataFrame) -> dict[str, Column]:
    """The row in one struct, so that no name of its columns clashes with ours, and what the operators use of it."""
    return {"row": F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]), "doc_id": docs["doc_id"], "text": docs["text"]}


def _marked(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, its place (_sender, _number) and whether the text may occur elsewhere."""
    rows = store.chunked(docs, packed(docs), numbered="_number")
    hashed = F.xxhash64("text")
    n = docs.count()
    bits, owners = max(48, X.bits_for(n)), X.owners_for(docs, n)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch:
            h = table["h"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            values, counts = np.unique(h, return_counts=True)
            return X.messages(sender, values, owners, bits, counts)

        return X.sender_batches(batches, one)

    prints = rows.where("text is not null").select("_sender", hashed.alias("h"))
    path, shards = X.exchange(prints.mapInArrow(sent, X.MESSAGE), owners, "exact")

    @F.arrow_udf("boolean")
    def suspected(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[int, X.Answers] = {}
        for senders, hashes in it:
            ids = senders.to_numpy()
            h = hashes.to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            out = np.zeros(len(ids), bool)
            for s in np.unique(ids).tolist():
                if s not in known:
                    if len(known) > 4:
                        known.pop(next(iter(known)))
                    known[s] = X.Answers(path, shards, s)
                at = ids == s
                out[at] = known[s].find(h[at])[0]
            yield pa.array(out)
        known.clear()
        store.trim()

    return rows.withColumn("twice", F.col("text").isNotNull() & suspected("_sender", hashed))


def _order() -> Column:
    """What decides which of equal texts stays: the least doc_id, null last, then the place in the table."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_sender").alias("chunk"), F.col("_number").alias("at"))


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id) of each row that equals another that stays; equality is that of the whole text."""
    rows = _marked(docs).where("twice").select("doc_id", "text", "_sender", "_number")
    # each task reduces its copies of a text first, so a text that a third of all rows have is a row a task
    first = rows.groupBy("text").agg(F.min(_order()).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = rows.join(first, "text").where((F.col("_sender") != F.col("keep.chunk")) | (F.col("_number") != F.col("keep.at")))
    return gone.select("doc_id", F.col("keep.id").alias("keep_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns."""
    marked = _marked(docs)
    first = marked.where("twice").groupBy("text").agg(F.min_by("row", _order()).alias("row"))
    return marked.where("not twice").select("row.*").unionByName(first.select("row.*"))


SQL = """
SELECT doc_id, keep_id FROM (
  SELECT doc_id,
         first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS keep_id,
         row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS place
  FROM documents WHERE text IS NOT NULL) WHERE place > 1
"""
