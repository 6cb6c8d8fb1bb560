"""Tables of documents, conversations, events and orders as tokens and item sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[^\p{L}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that a task of a join has, about.
TASK_BYTES = 8_000_000


def tasks(table: DataFrame) -> int | None:
    """How many partitions keep a task of a join of the table as small as it is for small tables; None if Spark's own number does."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = -(-size // TASK_BYTES)
    return n if n > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def pos_class(form: Column) -> Column:
    """A surrogate part of speech, of a form's length: no tagger is at hand."""
    n = F.length(form)
    return F.when(n <= 2, "SHORT").when(n <= 5, "MID").when(n <= 9, "LONG").otherwise("XLONG")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, sent_id (from 1, only sentences with words) and words (lower case) in order."""
    parts = F.split("text", r"[.!?\n]+")
    words = F.transform(parts, lambda s: F.filter(F.split(F.lower(s), WORD_GAP), lambda x: x != ""))
    rows = docs.select("doc_id", "lang", "source", F.posexplode(F.filter(words, lambda x: F.size(x) > 0)).alias("s", "words"))
    return rows.select("doc_id", "lang", "source", (F.col("s") + 1).cast("long").alias("sent_id"), "words")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, sent_id, pos (from 1), lemma and upos of every word."""
    rows = sentences(docs).select("doc_id", "lang", "source", "sent_id", F.posexplode("words").alias("p", "lemma"))
    return rows.select("doc_id", "lang", "source", "sent_id", (F.col("p") + 1).cast("long").alias("pos"), "lemma", pos_class(F.col("lemma")).alias("upos"))


#: Kinds of items of a token, and the columns they come from.
KINDS = {"form": "form", "lemma": "lemma", "pos": "upos", "dep": "deprel"}


def token_items(tokens: DataFrame, kinds: list[str], seq: list[str]) -> DataFrame:
    """(*seq, pos, item) of tokens, an itemset a token: form_"x", lemma_"x", pos_"X", dep_"x" and, of the map ``feats``, feats_K=V; any other kind is a column of that name. Null and empty values make no item."""
    quoted = lambda k, c: F.when(F.col(c) != "", F.concat(F.lit(f'{k}_"'), F.col(c), F.lit('"')))
    one = F.array(*[quoted(k, KINDS.get(k, k)) for k in kinds if k != "feats"]).cast("array<string>")
    items = F.filter(one, lambda x: x.isNotNull())
    if "feats" in kinds:
        feats = F.transform(F.map_entries(F.col("feats")), lambda e: F.concat(F.lit("feats_"), e["key"], F.lit("="), e["value"]))
        items = F.concat(items, F.filter(F.coalesce(feats, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return tokens.select(*seq, "pos", F.explode(F.array_distinct(items)).alias("item"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, item): customers' orders in time, items of each order's lines."""
    return order_lines(spark, sf_dir).distinct()


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_items() with a row for each line that has an item; orders are only put in order if pos is asked for."""
    o, l, p = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    n = tasks(l)
    by = lambda df, key: df.repartition(n, key) if n else df
    placed = by(o.select("o_orderkey", F.col("o_custkey").alias("seq_id"), F.row_number().over(w).cast("long").alias("pos")), "o_orderkey")
    lines = by(l.select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus"), "l_partkey").join(by(p.select("p_partkey", "p_brand"), "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    lines = by(lines.drop("l_partkey", "p_partkey"), "l_orderkey")
    items = F.array(F.concat(F.lit("brand_"), "p_brand"), F.concat(F.lit("rf_"), "l_returnflag"), F.concat(F.lit("ls_"), "l_linestatus"))
    return placed.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("seq_id", "pos", F.explode(items).alias("item"))


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, item): users' events in time, of one item each."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id"), F.row_number().over(w).cast("long").alias("pos"), F.concat(F.lit("type_"), "event_type").alias("item"))
