"""Interchange formats: token files of ten columns, item sequences, metadata, patterns, settings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, text), a row a file; the id is the name without its extension."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).where(~F.col("_metadata.file_name").startswith(".")).select(name.alias("text_id"), F.col("value").alias("text"))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """Tokens (text_id, sent_id, pos, form, ..., extra) of CoNLL-U files.

    A line is a comment only if it starts with "#"; multi-word and empty nodes
    are left out; "_" and features that are bare numbers are null; empty cells
    stay empty. A sentence starts at token 1.
    """
    text_id = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    files = spark.read.text(path, wholetext=True).select(text_id.alias("text_id"), F.col("value"))
    lines = files.select("text_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    cells = lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).select("text_id", "line_no", F.split("value", "\t").alias("c"))
    cells = cells.where(F.get("c", F.lit(0)).rlike("^[0-9]+$"))
    null = lambda i: F.when(F.get("c", F.lit(i)) != "_", F.get("c", F.lit(i)))
    kv = lambda c: F.when(~c.rlike("^[0-9]+$"), F.str_to_map(c, F.lit(r"\|"), F.lit("=")))
    w = Window.partitionBy("text_id").orderBy("line_no")
    return cells.select(
        "text_id",
        F.sum((F.get("c", F.lit(0)) == "1").cast("long")).over(w).alias("sent_id"),
        F.get("c", F.lit(0)).cast("int").alias("pos"),
        *[null(i).alias(FIELDS[i]) for i in (1, 2, 3, 4)],
        kv(null(5)).alias("feats"),
        null(6).cast("int").alias("head"),
        null(7).alias("deprel"),
        null(8).alias("deps"),
        kv(null(9)).alias("misc"),
        F.when(F.size("c") > 10, F.slice("c", 11, 1000)).otherwise(F.array().cast("array<string>")).alias("extra"),
    )


def renumbered(tokens: DataFrame) -> DataFrame:
    """Tokens whose sentences are numbered from 1 through all texts, in the order of (text_id, sent_id); only a count a text is ordered as a whole."""
    sent = tokens.select("text_id", "sent_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("text_id").orderBy("sent_id")))
    size = sent.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))
    before = size.select("text_id", F.coalesce(F.sum("n").over(Window.orderBy("text_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = sent.join(before, "text_id").select("text_id", "sent_id", (F.col("before") + F.col("r")).alias("number"))
    return tokens.join(number, ["text_id", "sent_id"]).withColumn("sent_id", F.col("number")).drop("number")


def write_conllu(tokens: DataFrame, path: str) -> None:
    """CoNLL-U text of conllu()'s tokens, an empty line after each sentence and a text a file row; null is "_"."""
    kv = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(F.col(c))), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    cells = ["pos", "form", "lemma", "upos", "xpos", kv("feats"), "head", "deprel", "deps", kv("misc")]
    line = F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("_")) for c in cells])
    sents = tokens.groupBy("text_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("t"))
    body = F.concat(F.array_join(F.col("t.l"), "\n"), F.lit("\n"))
    sents.select(F.col("text_id"), "sent_id", body.alias("value")).repartition("text_id").sortWithinPartitions("text_id", "sent_id").select("text_id", "value").write.partitionBy("text_id").mode("overwrite").text(path)


def write_vrt(tokens: DataFrame, path: str) -> None:
    """Vertical text: <text>, <s> and a line of tab-separated cells a token; spaces in cells become "_"."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("_")), " ", "_")
    line = F.concat_ws("\t", *[cell(c) for c in ("pos", "form", "lemma", "upos", "xpos")])
    sents = tokens.groupBy("text_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("t"))
    body = F.concat(F.lit('<s id="'), F.col("sent_id").cast("string"), F.lit('">\n'), F.array_join(F.col("t.l"), "\n"), F.lit("\n</s>"))
    texts = sents.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", body.alias("b")))).alias("s"))
    texts.select(F.concat(F.lit('<text id="'), F.col("text_id").cast("string"), F.lit('">\n'), F.array_join(F.col("s.b"), "\n"), F.lit("\n</text>")).alias("value")).write.mode("overwrite").text(path)


def write_sequences(seq_items: DataFrame, path: str) -> None:
    """Interchange text of (seq_id, pos, item_id): "seqId n", then "pos item" lines in order."""
    s = seq_items.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("x"))
    body = F.array_join(F.transform("x", lambda t: F.concat_ws(" ", t["pos"].cast("string"), t["item_id"].cast("string"))), "\n")
    s.select(F.concat(F.lit("seqId "), F.col("seq_id").cast("string"), F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, pos, item_id) of such text; files are independent of each other."""
    files = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"seqId [0-9]+[^s]*"), F.lit(0))).alias("v"))
    rows = files.select(F.regexp_extract("v", r"seqId ([0-9]+)", 1).cast("long").alias("seq_id"), F.explode(F.regexp_extract_all("v", F.lit(r"(?m)^([0-9]+ [0-9]+)\s*$"), F.lit(1))).alias("l"))
    return rows.select("seq_id", F.split("l", " ")[0].cast("int").alias("pos"), F.split("l", " ")[1].cast("int").alias("item_id"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, support) of lines "{1,2} {3} : 7"; of a pattern that repeats, the greatest support."""
    rows = spark.read.text(path).where(F.col("value").contains(":"))
    sets = F.regexp_extract_all("value", F.lit(r"\{([^}]*)\}"), F.lit(1))
    pattern = F.transform(sets, lambda s: F.transform(F.split(s, ","), lambda x: F.trim(x).cast("int")))
    return rows.select(pattern.alias("pattern"), F.trim(F.element_at(F.split("value", ":"), -1)).cast("long").alias("support")).groupBy("pattern").agg(F.max("support").alias("support"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """All-string metadata, tab-separated, with a header."""
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)


def contingency(spark: SparkSession, path: str) -> DataFrame:
    """(feature, part, k) of a wide tab-separated table whose first column names the feature."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    first, *parts = wide.columns
    return wide.unpivot([first], parts, "part", "k").select(F.col(first).alias("feature"), "part", F.coalesce(F.col("k").cast("long"), F.lit(0).cast("long")).alias("k"))


@dataclass(frozen=True)
class MiningParams:
    """Settings of the miner; ``or_items`` of several lines add up."""

    minsup: int = 1
    gap_min: int = 0
    gap_max: int | None = 0
    min_itemsets: int = 1
    max_itemsets: int | None = None
    in_items: list[int] = field(default_factory=list)
    or_items: list[int] = field(default_factory=list)
    begin_with: bool = False

    @staticmethod
    def parse(text: str) -> MiningParams:
        """From KEY=VALUE lines; ";" at a line's start marks a comment, repeated "=" count as one."""
        got: dict[str, list[str]] = {}
        for line in text.splitlines():
            if line.strip() and not line.startswith(";") and "=" in line:
                key, value = re.split(r"=+", line.strip(), maxsplit=1)
                got.setdefault(key.strip().upper(), []).append(value.strip())
        one = lambda k, d: int(got[k][-1]) if k in got else d
        many = lambda k: [int(x) for v in got.get(k, []) for x in re.findall(r"\d+", v)]
        begin = got.get("BEGINWITH", ["0"])[-1].lower() in ("1", "true", "yes")
        return MiningParams(one("MINSUP", 1), one("GAPMIN", 0), one("GAPMAX", 0), one("NB_ITEMSET_MIN", 1), one("NB_ITEMSET_MAX", None), many("IN"), many("OR"), begin)
