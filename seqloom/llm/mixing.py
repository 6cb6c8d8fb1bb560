"""Mixing sources to target weights by a hierarchical token budget.

The tree is domain, language, source. A node's budget goes to its children in
proportion to their weights; a child that has too few tokens (its tokens times
the epochs allowed) takes all it has and its shortage goes to its siblings in
proportion; only what they can't take either returns to the parent, and so to
the parent's siblings. As a node's capacity is that of all leaves below it, one
pass from the root does this exactly. A leaf then takes its budget from seeded
epochs: whole epochs, then of the next one the documents in keyed-hash order up
to the last that still fits the budget.

Tokens are counted in one scan, into a table without texts. No window spans a
leaf's documents: hash order is cut into ranges, and the one in which the budget
ends into ranges again; token sums tell what lies before the end, and only the
documents of that last range (a leaf's number by RANGES squared) are sorted.

Defined results: null and empty texts have no tokens and are not selected; a
null language or source is a leaf of its own, named "?"; a name without a
weight has the weight ``other``; what has the weight 0, at any level, gives
nothing and counts for no capacity; ties of hash go by doc_id, then text; equal
rows count each and may be selected each; other columns, also of clashing names,
are carried along; an empty table gives an empty one. doc_id may be of any type.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .exact_dedup import packed


@dataclass(frozen=True)
class Mix:
    """Weights are whole numbers, by name at each level; ``domains`` maps a source to its domain."""

    domains: dict[str, str] = field(default_factory=lambda: {f"src{i}": ("web", "books", "news", "forum")[i % 4] for i in range(20)})
    domain_weights: dict[str, int] = field(default_factory=lambda: {"web": 5, "books": 3, "news": 2, "forum": 1})
    lang_weights: dict[str, int] = field(default_factory=lambda: {"en": 4, "fr": 2, "de": 2, "es": 2})
    source_weights: dict[str, int] = field(default_factory=dict)
    other: int = 1
    #: Tokens wanted, as parts per thousand of all there are.
    budget: int = 1000
    epochs: int = 4
    seed: int = 17


#: Ranges of hash order in a leaf, and again in each of them.
RANGES = 4096
#: Leaves whose plan is broadcast at most; beyond it, it is joined by a shuffle.
BROADCAST_LEAVES = 1 << 16
TOKEN = r"[^ \t\n\r]+"


def share(budget: int, children: list[tuple[int, int]]) -> list[int]:
    """What each of (weight, capacity) gets: full ones their capacity, the others parts by weight."""
    order = sorted((i for i, (w, _) in enumerate(children) if w), key=lambda i: children[i][1] / children[i][0])
    got, left, weight = [0] * len(children), budget, sum(w for w, _ in children)
    for k, i in enumerate(order):
        w, cap = children[i]
        if cap * weight <= w * left:
            got[i], left, weight = cap, left - cap, weight - w
        else:
            for j in order[k:]:
                got[j] = left * children[j][0] // weight
            break
    return got


def budgets(leaves: dict[tuple[str, str, str], int], mix: Mix) -> dict[tuple[str, str, str], int]:
    """Tokens each leaf is to give, of leaf -> tokens it has."""
    total = sum(leaves.values()) * mix.budget // 1000
    weights = (mix.domain_weights, mix.lang_weights, mix.source_weights)

    # a leaf below a weight of 0 has no capacity
    open_ = {k: n * mix.epochs if all(w.get(x, mix.other) for w, x in zip(weights, k)) else 0 for k, n in leaves.items()}

    def down(level: int, budget: int, below: dict) -> dict:
        if level == 3:
            return dict.fromkeys(below, budget)
        groups = {k: dict(v) for k, v in itertools.groupby(sorted(below.items()), key=lambda x: x[0][level])}
        caps = [(weights[level].get(k, mix.other), sum(v.values())) for k, v in groups.items()]
        out = {}
        for part, v in zip(share(budget, caps), groups.values()):
            out |= down(level + 1, part, v)
        return out

    return down(0, total, open_) if leaves else {}


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def keyed(epoch: Column, doc_id: Column, seed: int) -> Column:
    """60 bits of a keyed hash that gives an epoch its order."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("?")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


LEAF = ["domain", "lang", "source"]


def _placed(rows: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """Rows with their leaf's plan, their keyed hash and its ranges of both levels."""
    bits = RANGES.bit_length() - 1
    out = rows.join(plan, LEAF).withColumn("u", keyed(F.col("whole"), F.col("doc_id"), mix.seed))
    return out.withColumn("range", F.shiftright("u", 60 - 2 * bits))


def _selected(docs: DataFrame, mix: Mix, rows_too: bool) -> DataFrame:
    """Leaf and epoch of each selected document; with row, or with doc_id and n_tokens."""
    spark = docs.sparkSession
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit("?"))
    domains = F.create_map(*[F.lit(x) for kv in mix.domains.items() for x in kv]) if mix.domains else None
    rows = docs.select(*[c.alias(n) for n, c in packed(docs).items()], name("lang").alias("lang"), name("source").alias("source"))
    domain = F.coalesce(domains[F.col("source")], F.lit("?")) if domains is not None else F.lit("?")
    rows = rows.where(F.col("text").rlike(TOKEN)).withColumn("domain", domain)
    counted = store.stored(rows.select("doc_id", *LEAF, tokens(F.col("text")).alias("n_tokens")), "tokens")
    # a row a leaf goes to the driver: as many as there are sources
    have = {(r["domain"], r["lang"], r["source"]): r["n"] for r in counted.groupBy(*LEAF).agg(F.sum("n_tokens").alias("n")).collect()}
    want = budgets(have, mix)
    small = F.broadcast if len(have) <= BROADCAST_LEAVES else lambda df: df
    plan = small(
        spark.createDataFrame(
            [(*k, want[k] // n, want[k] % n) for k, n in have.items() if want[k] > 0],
            "domain string, lang string, source string, whole int, rest long",
        )
    )
    slim = _placed(counted, plan, mix)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*LEAF).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the one range of a leaf in which its budget ends, then the one in that: ranges before it are taken whole
    high = F.floor(F.col("range") / RANGES)
    sums = slim.groupBy(*LEAF, "rest", high.alias("part")).agg(F.sum("n_tokens").alias("n"))
    ends = sums.withColumn("before", before).where("before <= rest and before + n > rest").select(*LEAF, F.col("part").alias("high"), F.col("before").alias("base"))
    ends = spark.createDataFrame(ends.collect(), ends.schema)  # one row a leaf
    inner = slim.join(small(ends), LEAF).where(high == F.col("high")).groupBy(*LEAF, "rest", "base", F.col("range").alias("part")).agg(F.sum("n_tokens").alias("n"))
    ends = inner.withColumn("before", F.col("base") + before).where("before <= rest and before + n > rest").select(*LEAF, F.col("part").alias("end_range"), "before")
    ends = small(spark.createDataFrame(ends.collect(), ends.schema))
    every = (_placed(rows, plan, mix) if rows_too else slim).join(ends, LEAF, "left")
    kept = ["row"] if rows_too else ["doc_id", "n_tokens"]
    first = every.where("range < end_range").select(*kept, *LEAF, F.col("whole").alias("epoch"))
    full = every.where("whole > 0").select(*kept, *LEAF, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"))
    inside = Window.partitionBy(*LEAF).orderBy("u", F.col("doc_id").asc_nulls_last(), "text").rowsBetween(Window.unboundedPreceding, 0)
    last = _placed(rows, plan, mix).join(ends, LEAF).where("range = end_range").withColumn("n_tokens", tokens(F.col("text")))
    last = last.withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside)).where("upto <= rest").select(*kept, *LEAF, F.col("whole").alias("epoch"))
    return full.unionByName(first).unionByName(last)


def selection(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens), a row for each time that a document is used."""
    return _selected(docs, mix, False).select("doc_id", *LEAF, "epoch", "n_tokens")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The selected documents with their columns; one that several epochs use is repeated."""
    return _selected(docs, mix, True).select("row.*")


def _cases(names: dict[str, int], column: str, other: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.items()) + f" ELSE {other} END" if names else str(other)


def _share_sql(source: str, name: str, above: list[str], key: str, weight: str) -> str:
    """SQL of share() for each parent: full ones are a prefix in order of capacity by weight."""
    part = f"PARTITION BY {', '.join(above)} " if above else ""
    keys = ", ".join([*above, key])
    return f"""
{name}_o AS (SELECT *, coalesce(sum(cap) OVER ({part}ORDER BY cap / w, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
        sum(w) OVER ({part}ORDER BY cap / w, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS wleft
   FROM (SELECT {keys}, any_value(b)::HUGEINT AS b, {weight}::HUGEINT AS w, sum(cap)::HUGEINT AS cap FROM {source} GROUP BY {keys}) WHERE w > 0),
{name}_f AS (SELECT *, cap * wleft <= w * (b - before) AS isfull FROM {name}_o),
{name}_t AS (SELECT *, coalesce(sum(CASE WHEN isfull THEN cap END) OVER ({part.strip()}), 0)::HUGEINT AS took,
        coalesce(sum(CASE WHEN NOT isfull THEN w END) OVER ({part.strip()}), 1)::HUGEINT AS open FROM {name}_f),
{name} AS (SELECT {keys}, CASE WHEN isfull THEN cap ELSE (b - took) * w // open END AS b FROM {name}_t)"""


def sql(mix: Mix = Mix()) -> str:
    """The selection in DuckDB's SQL."""
    domains = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mix.domains.items()) + " ELSE '?' END" if mix.domains else "'?'"
    open_ = " AND ".join(f"({_cases(w, c, mix.other)}) > 0" for w, c in ((mix.domain_weights, "domain"), (mix.lang_weights, "lang"), (mix.source_weights, "source")))
    return f"""
WITH d AS (SELECT doc_id, text, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
        len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS n_tokens FROM documents),
docs AS (SELECT *, {domains} AS domain FROM d WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS n, sum(n_tokens)::HUGEINT * {mix.epochs} * CASE WHEN {open_} THEN 1 ELSE 0 END AS cap FROM docs GROUP BY domain, lang, source),
l0 AS (SELECT *, (SELECT sum(n) FROM leaf) * {mix.budget} // 1000 AS b FROM leaf),{_share_sql("l0", "s1", [], "domain", _cases(mix.domain_weights, "domain", mix.other))},
l1 AS (SELECT leaf.*, s1.b FROM leaf JOIN s1 USING (domain)),{_share_sql("l1", "s2", ["domain"], "lang", _cases(mix.lang_weights, "lang", mix.other))},
l2 AS (SELECT leaf.*, s2.b FROM leaf JOIN s2 USING (domain, lang)),{_share_sql("l2", "s3", ["domain", "lang"], "source", _cases(mix.source_weights, "source", mix.other))},
plan AS (SELECT domain, lang, source, (s3.b // leaf.n)::INT AS whole, (s3.b % leaf.n)::BIGINT AS rest FROM leaf JOIN s3 USING (domain, lang, source)),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ('0x' || substr(md5('{mix.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '?')), 1, 15))::BIGINT, doc_id NULLS LAST, text
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM docs JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, whole AS epoch, n_tokens FROM o WHERE upto <= rest
UNION ALL SELECT doc_id, domain, lang, source, e::INT AS epoch, n_tokens FROM o, range(0, whole) t(e)
"""
