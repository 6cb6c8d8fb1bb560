"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seqloom.llm import countmin, euclid, exact_dedup, exchange, fuzzylines, golomb, interpolation, jaccard, langid, mixing, pieces, store, suffixes, textops
from seqloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _sender string, row int, h double, _metadata string"
VOCAB = [f"w{i}" for i in range(60)]


def words(seed, n):
    r = random.Random(seed)
    return [r.choice(VOCAB) for _ in range(n)]


def texts():
    base = words(1, 70)
    near = list(base)
    near[10] = "other"
    other = words(2, 90)
    return [
        (1, " ".join(base)), (2, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (None, " ".join(base)),
        (4, None), (5, None), (6, ""), (7, ""), (8, "!!"), (9, "one"), (10, "one"), (11, "One."), (12, " ".join(other[:50] + base[5:60])),
        (13, " ".join(other)), (14, " ".join(words(3, 4000))), (15, "ünï çödé 日本 🎉"), (16, "line a b c\nline a b c\n\nline a b c d"),
    ]


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    r = [(i, t, ["en", "fr", None][k % 3], [None, "src0", "src1", "src9"][k % 4], 1, "x", k, 0.5, "m") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(r, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(t):
    return [x for x in re.split(textops.SEPARATOR, (t or "").lower()) if x]


def test_golomb():
    r = np.random.default_rng(0)
    for n, bits in itertools.product((0, 1, 2, 300), (9, 33, 62)):
        x = np.unique(r.integers(0, 1 << bits, n, dtype=np.uint64))
        assert (golomb.decode(golomb.encode(x)) == x).all()


def test_exchange_keeps_totals_beyond_32_bits(tmp_path):
    most = 2**32 - 1
    sent = [exchange.messages(k, np.array([0, 7, 9 + k], np.uint64), 1, 36, np.array([most, 3, 1])) for k in range(3)]
    answers = exchange._answer(1)(pa.Table.from_batches(sent))
    (tmp_path / "shard=0").mkdir()
    pq.write_table(answers.drop_columns("shard"), tmp_path / "shard=0" / "x.parquet")
    got = exchange.Answers(str(tmp_path), 1, 1)
    assert got.totals(np.array([0, 7, 10], np.uint64)).tolist() == [3 * most, 9, 1]
    # the estimate of a word and the floor take the number of all words from value 0
    g = interpolation.grams(pa.array(["a b a", "c"]), 36)
    totals = np.full(len(g.values), 10)
    totals[0] = got.totals(np.array([0], np.uint64))[0]
    ml, _, words = interpolation.estimates(g, totals)
    assert words[0] == 3 * most and ml[3][0] == 1 / (3 * most + 1) and ml[2][0] == 8 / (3 * most - 3)


def test_words_are_those_of_the_expression():
    t = [t for _, t in texts()]
    w = textops.words(pa.array(t, pa.string()))
    assert np.diff(w.bounds).tolist() == [len([y for y in re.split(textops.SEPARATOR, x or "") if y]) for x in t]
    low = textops.words(pa.array([x and x.lower() for x in t], pa.string()))
    flat = [y for x in t for y in tokens(x)]
    assert len(flat) == len(low.hash) and len(set(zip(flat, low.hash.tolist()))) == len(set(flat)) == len(set(low.hash.tolist()))


def test_exact_dedup(docs, empty):
    groups = {}
    for i, t in texts():
        if t is not None:
            groups.setdefault(t, []).append(i)
    want = []
    for g in groups.values():
        g = sorted(g, key=lambda i: (i is None, i or 0))
        want += [(i, g[0]) for i in g[1:]]
    assert sorted(map(str, map(tuple, exact_dedup.duplicates(docs).collect()))) == sorted(map(str, want))
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts()) - len(want)
    assert exact_dedup.duplicates(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


def grams(t, n=3):
    w = tokens(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_groups(sets, t=jaccard.THRESHOLD):
    """For each of the sets that has a partner, the members of its group and the number of its partners."""
    links, root = {}, list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        x, y = sets[i], sets[j]
        if x and y and len(x & y) / len(x | y) >= t:
            links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
    return {i: ([k for k in range(len(sets)) if root[k] == root[i]], n) for i, n in links.items()}


def wanted_links(rows):
    return sorted((str(rows[i][0]), min((rows[k][0] for k in group if rows[k][0] is not None), default=None), n) for i, (group, n) in near_groups([grams(t) for _, t in rows]).items())


def test_jaccard(docs, empty):
    got = sorted((str(a), b, c) for a, b, c in jaccard.links(docs).collect())
    assert got == wanted_links(texts()) and got
    kept = jaccard.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 9, 12, 13, 14, 15, 16]
    assert jaccard.links(empty).count() == 0 and jaccard.dedup(empty).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_jaccard_of_crowded_homes(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(11)
    bases, rows = [words(70 + k, 40) for k in range(3)], []
    for k in range(60):
        w = list(bases[k % 3])
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        rows.append((k, " ".join(w[: r.randint(25, 40)])))
    rows += [(100 + k, rows[0][1]) for k in range(5)]
    got = sorted((str(a), b, c) for a, b, c in jaccard.links(table(spark, rows)).collect())
    assert got == wanted_links(rows) and len(got) > 40
    keep = {min(group) for group, _ in near_groups([grams(t) for _, t in rows]).values()}
    linked = set(near_groups([grams(t) for _, t in rows]))
    assert {x["doc_id"] for x in jaccard.dedup(table(spark, rows)).select("doc_id").collect()} == {rows[i][0] for i in range(len(rows)) if i in keep or i not in linked}


def test_block_skipping_loses_no_pair():
    r = np.random.default_rng(3)
    gram = np.sort(r.integers(0, 12, 60))
    size, pos = r.integers(5, 30, 60), r.integers(0, 9, 60)
    o = np.lexsort((pos, size, gram))
    gram, size, pos = gram[o], size[o], pos[o]
    got = jaccard.reachable(gram, size, pos, 0.5)
    want = np.zeros(60, bool)
    for i, j in itertools.combinations(range(60), 2):
        if gram[i] == gram[j] and size[i] >= 0.5 * size[j] and 1 + min(size[i] - pos[i] - 1, size[j] - pos[j] - 1) >= math.ceil((size[i] + size[j]) / 3 - 1e-9):
            want[i] = want[j] = True
    assert not (want & ~got).any() and (got != want).sum() <= 6 and not got.all()


def test_overlaps_follow_from_those_with_the_leader():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 40, r.integers(1, 30))).astype(np.uint64) for _ in range(20)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    for leader in (0, 7):
        got = jaccard.overlaps(np.concatenate(sets), bounds, leader)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: m for n, m in root.items() if any(n in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("passages", [countmin.passages, suffixes.passages])
def test_passages(docs, empty, passages):
    size, seen, rows = countmin.WINDOW, {}, []
    for k, (i, t) in enumerate(texts()):
        w = tokens(t)
        for p in range(len(w) - size + 1):
            seen.setdefault(tuple(w[p : p + size]), []).append((countmin._LAST if i is None else i, k, p))
    for where in seen.values():
        if len(where) > 1:
            least = min(x[0] for x in where)
            for i, k, p in where:
                low = min(x[2] for x in where if x[1] == k)
                rows.append((k, p, not (i == least and p == low)))
    want = []
    for k, p, red in sorted(rows):
        if want and want[-1][0] == k and want[-1][2] == p - 1 + size and want[-1][3] == red:
            want[-1][2] = p + size
        else:
            want.append([k, p, p + size, red])
    ids = [i for i, _ in texts()]
    got = sorted(map(str, map(tuple, passages(docs).collect())))
    assert got == sorted(str((ids[k], a, b, red)) for k, a, b, red in want) and got
    assert passages(empty).count() == 0


def test_mixing(docs, empty):
    mix = mixing.Mix(epochs=3)
    rows = [(i, t, ["en", "fr", "?"][k % 3], ["?", "src0", "src1", "src9"][k % 4], len(re.findall(r"[^ \t\n\r]+", t or ""))) for k, (i, t) in enumerate(texts())]
    have = {}
    for _, _, lang, source, n in rows:
        if n:
            leaf = (mix.domains.get(source, "?"), lang, source)
            have[leaf] = have.get(leaf, 0) + n
    want = mixing.budgets(have, mix)
    assert sum(want.values()) <= sum(have.values()) and all(want[x] <= 3 * have[x] for x in have)
    got = {}
    for r in mixing.selection(docs, mix).collect():
        got.setdefault((r["domain"], r["lang"], r["source"]), []).append(r["n_tokens"])
    for leaf, n in have.items():
        longest = max(x[4] for x in rows if (x[2], x[3]) == leaf[1:])
        assert want[leaf] - longest < sum(got.get(leaf, [])) <= want[leaf]
    whole = mixing.mixed(docs, mix)
    assert whole.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in whole.collect()) == sorted(str(r["doc_id"]) for r in mixing.selection(docs, mix).collect())
    assert mixing.selection(empty).count() == 0 and mixing.mixed(empty).count() == 0


def chosen(rows, mix):
    """Brute force of the selection: rows (doc_id, text, lang, source), all sorted."""
    have, leaves = {}, {}
    for i, t, lang, source in rows:
        n = len(re.findall(mixing.TOKEN, t or ""))
        if n:
            leaves.setdefault((mix.domains.get(source, "?"), lang or "?", source or "?"), []).append((i, t, n))
    have = {k: sum(x[2] for x in v) for k, v in leaves.items()}
    out = []
    for leaf, budget in mixing.budgets(have, mix).items():
        whole, rest = divmod(budget, have[leaf])
        out += [(str(i), leaf, e, n) for i, _, n in leaves[leaf] for e in range(whole)]
        key = lambda x: (int(hashlib.md5(f"{mix.seed}:{whole}:{'?' if x[0] is None else x[0]}".encode()).hexdigest()[:15], 16), x[0] is None, x[0] or 0, x[1])  # noqa: B023, E731
        upto = 0
        for i, _, n in sorted(leaves[leaf], key=key):
            upto += n
            if upto > rest:
                break
            out.append((str(i), leaf, whole, n))
    return sorted(out)


@pytest.mark.parametrize("ranges", [2, 4096])
def test_mixing_against_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGES", ranges)
    r = random.Random(9)
    rows = [(r.choice([k, k, None, 3]), " ".join(words(k, r.randint(0, 30))), r.choice(["en", "fr", None]), r.choice(["src0", "src1", "src2", "src9", None])) for k in range(120)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for mix in (mixing.Mix(), mixing.Mix(epochs=2, source_weights={"src0": 0, "src1": 3}, lang_weights={"fr": 0, "en": 2}), mixing.Mix(domain_weights={"web": 0, "news": 0, "books": 0, "forum": 0, "?": 0})):
        got = sorted((str(x["doc_id"]), (x["domain"], x["lang"], x["source"]), x["epoch"], x["n_tokens"]) for x in mixing.selection(t, mix).collect())
        assert got == chosen(rows, mix)
        assert sorted(str(x["doc_id"]) for x in mixing.mixed(t, mix).collect()) == [x[0] for x in got]
    assert not got


def test_weight_0_gives_nothing_and_takes_no_share():
    mix = mixing.Mix(domains={"a": "x", "b": "x", "c": "y"}, domain_weights={"x": 1, "y": 1}, lang_weights={}, source_weights={"a": 0}, epochs=1, budget=1000)
    got = mixing.budgets({("x", "en", "a"): 400, ("x", "en", "b"): 100, ("y", "en", "c"): 500}, mix)
    assert got == {("x", "en", "a"): 0, ("x", "en", "b"): 100, ("y", "en", "c"): 500}


def test_shortage_goes_to_siblings_first():
    mix = mixing.Mix(domains={"a": "x", "b": "x", "c": "y"}, domain_weights={"x": 1, "y": 1}, lang_weights={}, epochs=1, budget=500)
    got = mixing.budgets({("x", "en", "a"): 10, ("x", "en", "b"): 490, ("y", "en", "c"): 500}, mix)
    assert got == {("x", "en", "a"): 10, ("x", "en", "b"): 240, ("y", "en", "c"): 250}
    got = mixing.budgets({("x", "en", "a"): 10, ("x", "en", "b"): 90, ("y", "en", "c"): 900}, mix)
    assert got == {("x", "en", "a"): 10, ("x", "en", "b"): 90, ("y", "en", "c"): 400}


def test_pieces(docs, empty):
    m = pieces.model(pieces.MODEL)
    odd = [t or "" for _, t in texts()[:4] + texts()[5:]] + [" ", "  a  b ", "▁x▁ y", "x" * 300 + " " + "ab" * 80, "\u0000é\n", " " * 200]
    keys = np.arange(len(odd)).astype(np.uint64) + np.uint64(5)
    import sentencepiece

    plain, b = pieces.encode(m, odd, keys, 0.0)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert [plain[b[i] : b[i + 1]].tolist() for i in range(len(odd)) if "▁" not in odd[i]] == [sp.encode(t) for t in odd if "▁" not in t]
    for seed in (0, 1):
        k = keys * np.uint64(seed + 3)
        ids, b = pieces.encode(m, odd, k, 0.2)
        assert pieces.decode(m, ids, b).to_pylist() == odd
        for i, t in enumerate(odd[-6:] + odd[:3]):
            at = (list(range(len(odd) - 6, len(odd))) + [0, 1, 2])[i]
            assert ids[b[at] : b[at + 1]].tolist() == agenda_ids(m, t, int(k[at]), 0.2)
    assert len(ids) > len(plain)
    got = pieces.tokenized(docs)
    assert got.where("not lossless").count() == 0 and got.where("ids is null").count() == 2
    back = pieces.detokenized(got)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, texts()))
    assert pieces.tokenized(empty).count() == 0


def agenda_ids(m, text, key, dropout):
    """One text, word by word, with a heap each."""
    if not text:
        return []
    text = " " + text
    starts = [i for i, c in enumerate(text) if i == 0 or (c == " " and text[i - 1] != " ")]
    out = []
    for s, e in zip(starts, [*starts[1:], len(text)]):
        for i, p in pieces.agenda(m, [int(m.char[ord(c)]) for c in text[s:e]], s, key, int(dropout * 2.0**64)):
            out += [p] if p >= 0 else [int(m.byte[x]) for x in text[s + i].encode()]
    return out


def test_language_gradients():
    r = np.random.default_rng(1)
    net = langid.start(["a", "b", "c"], 1)
    w, y = r.integers(0, 256, (7, 5)), r.integers(0, 3, 5)
    mask = np.ones((7, 5), np.float32)
    mask[5:, 2] = 0
    _, grads = langid._gradients(net, w, mask, y)
    for p, g in zip((net.x, net.u, net.v, net.c), grads):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[k]
        p[k] = old + 1e-2
        up = langid._gradients(net, w, mask, y)[0]
        p[k] = old - 1e-2
        down = langid._gradients(net, w, mask, y)[0]
        p[k] = old
        assert g[k] == pytest.approx((up - down) / 2e-2, rel=0.02)


def test_language_accuracy_held_out(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("f", F.pmod(F.xxhash64("text"), F.lit(2)))
    net = langid.fit(d.where("f = 0"))
    got = langid.identify(d.where("f = 1"), net).join(d.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("language") == F.col("lang")).cast("int")), F.avg(F.col("accepted").cast("int"))).first()
    assert got[0] > 0.95 and got[1] > 0.995
    untaught = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.identify(untaught).where("language is null and not accepted and probability = 0").count() == len(texts()) and langid.accepted(untaught).count() == 0
    named = langid.accepted(untaught, net)
    assert named.columns == docs.columns and named.count() > 5 and named.where("lang is null").count() == 0
    odd = langid.identify(docs, net)
    assert odd.where("language is null and not accepted").count() == 4 and odd.count() == len(texts())
    assert langid.accepted(docs, net).columns == docs.columns
    assert langid.identify(empty).count() == 0


def test_interpolation(docs, empty):
    got = {}
    for r in interpolation.scores(docs).collect():
        got.setdefault(r["doc_id"], []).append(r["log_prob"])
    assert got[4] == [None] and got[6] == [None] and got[8] == [None] and got[14][0] < 0
    seqs = [["<", "<", *tokens(t)] if tokens(t) else [] for _, t in texts()]
    count = lambda s, g: sum(tuple(s[i : i + len(g)]) == g for i in range(len(s) - len(g) + 1))
    g = interpolation.grams(pa.array([t and t.lower() for _, t in texts()], pa.string()), 50)
    ml, bucket, n = interpolation.estimates(g, g.counts)
    at = 0
    for k, s in enumerate(seqs[:4] + seqs[5:13]):
        k = k if k < 4 else k + 1
        start = int(np.flatnonzero(g.doc == k)[0]) if s else None
        for i in range(2, min(len(s), 12)):
            others = [x for j, x in enumerate(seqs) if j != k]
            c = lambda *w: sum(count(x, w) for x in others)  # noqa: E731, B023
            ctx, one = c(*s[i - 2 : i]), c(s[i - 1])
            want = [c(*s[i - 2 : i + 1]) / ctx if ctx else 0, c(*s[i - 1 : i + 1]) / one if one else 0, c(s[i]) / sum(max(len(x) - 2, 0) for x in others)]
            assert np.allclose(ml[:3, start + i - 2], want), (k, i)
            at += 1
    assert at > 30
    assert interpolation.scores(empty).count() == 0


def test_language_of_long_texts_carries_state():
    """A text of several spans gets what one run over all of it gives, but for what lies beyond the context."""
    r = np.random.default_rng(3)
    net = langid.start(["a", "b"], 2)
    text = bytes(r.integers(97, 123, 5000).astype(np.uint8))
    short = text[: langid.SPAN - 7]
    got = langid.label_texts(net, pa.array([text.decode(), short.decode(), "ab", ""]))
    for k, t in enumerate((text, short, b"ab")):
        p = langid.probabilities(net, np.frombuffer(t, np.uint8)[:, None])[:, :, 0]
        assert np.allclose(got[0][k], p.mean(axis=0), atol=1e-4 if k == 0 else 1e-6)
        assert np.allclose(got[1][k], [(p.argmax(axis=1) == c).mean() for c in (0, 1)], atol=1e-3)
    assert not got[0][3].any()


def test_scores_end_to_end(spark):
    """Totals, learned weights and scores against a computation of all of it in one place."""
    rows = [(k, " ".join(words(k % 7, 30) + words(k, 10)) if k != 5 else "unseen words only") for k in range(60)]
    t = table(spark, rows)
    got = {r["doc_id"]: r for r in interpolation.scores(t).collect()}
    g = interpolation.grams(pa.array([x for _, x in rows]), 50)
    ml, bucket, n = interpolation.estimates(g, g.counts)
    held = {r["doc_id"] for r in t.where(F.pmod(F.xxhash64(F.lit("held out"), "doc_id", "text"), F.lit(interpolation.HELD_OUT)) == 0).collect()}
    at = np.isin(g.doc, [k for k in range(60) if k in held])
    steps = np.where(ml[:3] > 0, 2.0 ** (np.clip(np.rint(4 * np.log2(np.maximum(ml[:3], 1e-300))), 1 - interpolation.STEPS, 0) / 4), 0)
    lam = np.full((interpolation.BUCKETS, 4), 0.25)
    for _ in range(interpolation.ROUNDS):
        new = np.zeros_like(lam)
        for w in np.flatnonzero(at):
            part = lam[bucket[w]] * np.append(steps[:, w], ml[3, w])
            new[bucket[w]] += part / part.sum()
        lam = np.where(new.sum(1, keepdims=True) > 0, new / np.maximum(new.sum(1, keepdims=True), 1e-300), lam)
    lam = interpolation.floored(lam)
    assert np.allclose(lam.sum(axis=1), 1) and lam.min() >= interpolation.LEAST_WEIGHT
    log = np.log((lam[bucket].T * ml).sum(axis=0))
    for k in range(60):
        assert got[k]["log_prob"] == pytest.approx(log[g.doc == k].mean(), abs=1e-5) and got[k]["n_words"] == (g.doc == k).sum()
        assert got[k]["perplexity"] == pytest.approx(math.exp(-got[k]["log_prob"]), rel=1e-4)
    assert got[5]["perplexity"] < 1e8


def test_em_raises_likelihood():
    r = np.random.default_rng(2)
    ml, bucket, n = r.random((4, 200)), r.integers(0, interpolation.BUCKETS, 200), r.integers(1, 5, 200)
    like = [float((n * np.log((interpolation.em(bucket, ml, n, k)[bucket].T * ml).sum(0))).sum()) for k in (0, 1, 5, 40)]
    assert like == sorted(like) and like[-1] > like[0]


@pytest.mark.parametrize("block", [16, 1024])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(euclid, "BLOCK", block)
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 32))
    near = x[:100] / np.linalg.norm(x[:100], axis=1, keepdims=True) + 0.05 * r.normal(size=(100, 32))
    close = x[150] / np.linalg.norm(x[150]) + 0.02 * r.normal(size=(40, 32))  # a group of its own
    v = [(i, row.tolist()) for i, row in enumerate(np.concatenate([x, near, close, x[:2] * 4]))]
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (905, [4.0, 8.0]), (None, x[0].tolist()), (906, [None] * 32)]
    t = spark.createDataFrame([(*row, "b", 1) for row in v + odd], "vec_id long, embedding array<double>, bucket string, n int")
    ids = [i for i, _ in v] + [None]
    u = np.array([a for _, a in v] + [x[0].tolist()])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ok = u @ u.T >= euclid.THRESHOLD - 1e-12
    np.fill_diagonal(ok, False)
    root = euclid.roots(len(ids), *np.nonzero(ok))
    want = {(ids[i], min(ids[k] for k in range(len(ids) - 1) if root[k] == root[i]), int(ok[i].sum())) for i in range(len(ids)) if ok[i].any()}
    got = [tuple(z) for z in euclid.links(t).collect()]
    small = [z for z in got if (z[0] or 0) >= 900]
    assert sorted(small) == [(904, 904, 2), (905, 904, 2), (905, 904, 2)]
    found = {z for z in got if z not in small}
    assert len(want) > 200 and {z[0] for z in found} <= {z[0] for z in want} and len(found) + 3 == len(got)
    assert len(found & want) >= 0.95 * len(want) and sum(z[2] for z in found) >= 0.97 * sum(z[2] for z in want)
    assert euclid.links(t.limit(0)).count() == 0
    floats = t.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert len({tuple(z) for z in euclid.links(floats).collect()} & want) >= 0.95 * len(want)


def test_line_parts():
    r = random.Random(1)

    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in "ab")
        most = r.randint(0, 12)
        assert fuzzylines.distance(a, b, most) == min(plain(a, b), most + 1)
    got = fuzzylines.normalised(pa.array(["  Ab, c\n\n--\nD e  ", "", None, "x", "\n", "y \n z"]))
    assert (got[0].to_pylist(), got[1].tolist(), got[2].tolist()) == (["ab c", "d e", "x", "y", "z"], [0, 0, 3, 5, 5], [0, 3, 0, 0, 1])
    x = np.array([r.getrandbits(64)], np.uint64)
    for _ in range(40):
        flip = sum(1 << i for i in r.sample(range(64), fuzzylines.BLOCKS - fuzzylines.AGREE))
        assert (fuzzylines.keys(x) == fuzzylines.keys(x ^ np.uint64(flip))).any()


def edited(r, kind, words):
    """A line of so many words and an edit of it that is similar."""
    while True:
        w = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 9))) for _ in range(words)]
        a, i = " ".join(w), r.randrange(words)
        c = list(a)
        if kind == "inserted":
            b = " ".join(w[:i] + [r.choice(["a", "of", "the"])] + w[i:])
        elif kind == "split":
            c.insert(r.choice([k for k in range(1, len(a)) if " " not in a[k - 1 : k + 1]]), " ")
            b = "".join(c)
        elif kind == "joined":
            b = " ".join(w[:i] + ["".join(w[i : i + 2])] + w[i + 2 :])
        else:
            for k in range(3):
                c[r.randrange(len(c) * k // 3, len(c) * (k + 1) // 3)] = "z"
            b = "".join(c)
        if a != b and fuzzylines.similar(a, b, fuzzylines.SIMILARITY):
            return a, b


@pytest.mark.parametrize("kind", ["inserted", "split", "joined", "typos"])
def test_fuzzy_candidates_by_kind_of_edit(kind):
    t = fuzzylines.SIMILARITY
    for words in (5, 6, 8, 10, 14, 20):
        r = random.Random(words)
        sides = []
        for side in zip(*(edited(r, kind, words) for _ in range(100))):
            w, (data, off) = textops.words(pa.array(side)), textops.buffers(pa.array(side))
            size = np.array([len(x) for x in side])
            k, line = fuzzylines.gram_keys(*fuzzylines.gram_hashes(data, off, size, t), size, t)
            grams = [set(k[line == i].tolist()) for i in range(len(side))]
            sides.append((fuzzylines.keys(fuzzylines.simhash(w.hash, w.bounds)), grams))
        (x, g), (y, h) = sides
        met = [(x[i] == y[i]).any() or bool(g[i] & h[i]) for i in range(len(g))]
        assert np.mean(met) >= 0.95, (words, np.mean(met))


def test_fuzzy_lines_of_other_word_counts_and_scattered_typos(spark):
    r = random.Random(3)
    pairs = [edited(r, kind, words) for kind in ("inserted", "split", "joined", "typos") for words in (6, 8, 12, 20)]
    got = fuzzylines.repeats(table(spark, [(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)])).collect()
    assert {tuple(x) for x in got} == {(2 * i + 1, 0, 2 * i, 0) for i in range(len(pairs))}


def test_fuzzy_lines(spark, docs, empty):
    r = random.Random(7)
    rows, line = [], 0
    for k in range(25):
        base = words(100 + k, 60)
        edit = list(base)
        edit[r.randrange(60)] = "zz"
        rows.append((2 * k, "Title %d of all\n%s" % (k // 5, " ".join(base))))
        rows.append((2 * k + 1, "%s\n%s" % (" ".join(edit), " ".join(words(500 + k, 60)))))
    rows += [(90, rows[0][1].upper()), (91, None), (92, ""), (None, rows[2][1])]
    lines = [(i, n, " ".join(tokens(x))) for i, t in rows for n, x in enumerate((t or "").split("\n")) if tokens(x)]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if fuzzylines.similar(lines[a][2], lines[b][2], fuzzylines.SIMILARITY)]
    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = set()
    for k in range(len(lines)):
        members = [lines[x][:2] for x in range(len(lines)) if find(x) == find(k)]
        keep = min(members, key=lambda m: (m[0] is None, m[0] or 0, m[1]))
        if lines[k][:2] != keep:
            want.add((*lines[k][:2], *keep))
    got = {tuple(x) for x in fuzzylines.repeats(table(spark, rows)).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(want) > 25 and len(got - want) <= 0.1 * len(want)
    assert fuzzylines.repeats(empty).count() == 0
    assert fuzzylines.repeats(docs).where("doc_id = 16").count() >= 1


def test_pipeline_against_single_steps(spark, tmp_path):
    import corpus_pipeline

    r = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    rows = [x.asDict() for x in r.collect()]
    ok = {x["doc_id"] for x in langid.identify(r).where("accepted").collect()}
    rows = [x for x in rows if x["doc_id"] in ok]
    first = {}
    for x in sorted(rows, key=lambda x: x["doc_id"]):
        first.setdefault(x["text"], x)
    rows = list(first.values())
    near = near_groups([grams(x["text"]) for x in rows])
    rows = [x for k, x in enumerate(rows) if k not in near or k == min(near[k][0])]
    left = spark.createDataFrame(rows, r.schema)
    want = mixing.selection(left).groupBy("doc_id").count().toPandas()
    assert got.groupby("doc_id").size().to_dict() == dict(zip(want["doc_id"], want["count"]))
    assert got["lossless"].all()


def test_distances_of_many_pairs_and_what_they_are_at_least():
    r = random.Random(3)
    lines = []
    for _ in range(400):
        a = [r.choice("abcdeé日 ") for _ in range(r.choice([1, 5, 30, 63, 64, 65, 100, 200, 500]))]
        b = list(a)
        for _ in range(r.randint(0, max(1, len(a) // 7))):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randint(0, 1)] = r.choice(["", "x", "é"])
        lines += ["".join(a), "".join(b)]
    code, off = fuzzylines.codes(*textops.buffers(pa.array(lines)))
    assert np.diff(off).tolist() == [len(x) for x in lines]
    i, size = np.arange(0, len(lines), 2), np.diff(off)
    for share in (0.05, 0.1, 0.2):
        most = np.floor(share * np.maximum(size[i], size[i + 1])).astype(np.int64)
        want = [fuzzylines.distance(lines[x], lines[x + 1], int(m)) <= m for x, m in zip(i, most)]
        assert fuzzylines.within(code, off, i, i + 1, most).tolist() == want and 0 < sum(want) < len(want)
        for kinds, q in ((fuzzylines.LETTERS, 1), *fuzzylines.SIEVES):
            p = fuzzylines.profiles(code, off, kinds, q)
            assert not (np.array(want) & (fuzzylines.apart(p[i], p[i + 1], q) > most)).any()


def test_fuzzy_lines_long_lists_meet_by_parities():
    t, r = fuzzylines.SIMILARITY, random.Random(23)
    long = ["".join(r.choice("etaoinshrdlu ") for _ in range(400)) for _ in range(6)]
    mixed = ["".join(r.sample(x, len(x))) for x in long]  # the same letters, other grams
    near = [x[:50] + "zq" + x[52:300] + x[303:] for x in long]
    lines = pa.array([x for p in zip(long, near, mixed) for x in p])
    code, off = fuzzylines.codes(*textops.buffers(lines))
    size, odd, p = np.diff(off), fuzzylines.parities(code, off), fuzzylines.profiles(code, off, fuzzylines.LETTERS).view(np.int64)
    assert odd.shape == (18, fuzzylines.SIEVES[-1][0] // 64)
    for i in range(0, 18, 3):
        d = fuzzylines.distance(lines[i].as_py(), lines[i + 1].as_py(), 40)
        assert fuzzylines.odds(odd[i : i + 1], odd[i + 1 : i + 2])[0] <= d <= 40 < fuzzylines.odds(odd[i : i + 1], odd[i + 2 : i + 3])[0]
    order = np.argsort(size, kind="stable")
    bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * odd.shape[1]), 18, [None, pa.py_buffer(odd[order])]).cast(pa.binary())
    cols = [np.zeros(18, np.int64), np.arange(18)[order], size[order].astype(np.int32), p[order, 0], p[order, 1], np.arange(18)[order]]
    rows = pa.RecordBatch.from_arrays([*map(pa.array, cols), bits], names=["key", "h", "size", "p0", "p1", "g", "odd"])
    for batches in ([rows], [rows.slice(0, 5), rows.slice(5)]):
        got = pa.Table.from_batches(list(fuzzylines._meeting(t, False)(iter(batches))))
        assert {*zip(got["a"].to_pylist(), got["b"].to_pylist())} == {(i, i + 1) for i in range(0, 18, 3)}


def test_fuzzy_lines_have_grams_of_least_hash():
    t, r = fuzzylines.SIMILARITY, random.Random(5)
    passage = "".join(r.choice("etaoinshrdlu é") for _ in range(60))
    lines = ["".join(r.choice("etaoinshrdlu é") for _ in range(n)) for n in (5, 9, 29, 70, 130, 170, 400, 5000)]
    lines += [lines[6][:k] + passage + lines[7][k : k + 300] for k in (20, 90)] + ["ab" * 3000, "a" * 400 + lines[6][:30]]
    data, off = textops.buffers(pa.array(lines))
    size = np.array([len(x) for x in lines])
    least, at = fuzzylines.gram_hashes(data, off, size, t)
    low, high = fuzzylines.gram_classes(size, t)
    seen = {}
    for i, x in enumerate(lines):
        raw, want = x.encode(), 0
        for _, q, most in (fuzzylines.GRAMS[c].tolist() for c in {low[i], high[i]} if len(x) >= fuzzylines.SHORTEST):
            want += min(most, len({raw[k : k + q] for k in range(len(raw) - q + 1)}))
        assert at[i + 1] - at[i] == want  # all of a line's grams if it has few, though many are the same
        for h, place in least[at[i] : at[i + 1]].tolist():
            q = int(fuzzylines.GRAMS[(h >> fuzzylines.HASHED) - 1, 1])
            if place < 1 << 32:
                gram = x[place:].encode()[:q]
                assert raw.count(gram) == 1 and seen.setdefault(h, gram) == gram
    assert (least[at[10] : at[11], 1] == 1 << 32).all()
    w = textops.words(pa.array(["a b a a", "", "b", "c c"]))
    kinds, bounds = fuzzylines.kinds_of_words(w)
    assert bounds.tolist() == [0, 2, 2, 3, 4] and len(set(kinds.tolist())) == 3 and kinds[2] in kinds[:2]


def test_fuzzy_lines_that_share_a_gram_meet_where_its_places_allow_it():
    n = 5
    places = [0, 30, 45, 399, -1]
    cols = [np.zeros(n, np.int64), np.arange(n), np.full(n, 400, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64), np.array(places, np.int32)]
    packed = lambda use: exchange.squeeze(np.concatenate([c[use].view(np.uint8) for c in cols]))
    batch = pa.RecordBatch.from_pydict({"part": pa.array([0, 0], pa.int32()), "rows": pa.array([packed([4, 1]), packed([0, 3, 2])], pa.binary())})
    rows = list(fuzzylines._unpacked(iter([batch])))
    assert pa.Table.from_batches(rows)["h"].to_pylist() == [0, 1, 2, 3, 4]
    got = pa.Table.from_batches(list(fuzzylines._meeting(fuzzylines.SIMILARITY, True)(iter(rows))))
    assert {*zip(got["a"].to_pylist(), got["b"].to_pylist())} == {(1, 2)} | {(i, 4) for i in range(4)}
    # the rests of two lines that a text is longer by count as well
    x = np.array([10, 10, 10]), np.array([30, 30, 10]), np.array([380, 360, 360]), np.array([400, 400, 400])
    assert fuzzylines.placed(*x, fuzzylines.SIMILARITY).tolist() == [True, True, True]
    assert not fuzzylines.placed(np.array([30]), np.array([10]), np.array([379]), np.array([400]), fuzzylines.SIMILARITY)[0]


def test_fuzzy_lines_groups_in_one_task_or_many(spark, monkeypatch):
    r = random.Random(31)
    edges = spark.createDataFrame([(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(7, 7)], "a long, b long").where("a <> b")
    one = {tuple(x) for x in fuzzylines._grouped(edges).collect()}
    monkeypatch.setattr(fuzzylines, "FEW", 0)
    assert one == {tuple(x) for x in fuzzylines._grouped(edges).collect()} and len(one) > 100
    assert fuzzylines._grouped(edges.limit(0)).count() == 0


def test_fuzzy_lines_leave_no_tables_of_candidates(spark):
    r = random.Random(29)
    base = words(900, 30)
    rows = [(i, " ".join(base[:10] + [r.choice(base) for _ in range(12)] + base[10:] if i % 2 else words(1000 + i, 20))) for i in range(60)]
    left = lambda: {x.name for x in Path(store.shared_dir(spark).removeprefix("file://"), "seqloom").glob("*")}
    before = left() if Path(store.shared_dir(spark).removeprefix("file://"), "seqloom").exists() else set()
    fuzzylines.repeats(table(spark, rows)).collect()
    assert not {x.split("-")[0] for x in left() - before} & {"met", "pairs", "places", "wanted", "placed", "again", "sieved", "more"}


def test_workers_give_memory_back_at_the_end_of_a_task():
    code = """if True:
        import numpy as np, pyarrow as pa
        from seqloom.llm import store
        rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
        batch = pa.RecordBatch.from_pydict({"_sender": pa.array([1, 1, 2], pa.int64())})
        chunks = store.by_sender(iter([batch]))
        got = [next(chunks)[0], next(chunks)[0]]
        many = [np.ones(1000) for _ in range(10000)]
        many = many[-1:]  # what is free lies below it
        before = rss()
        assert [*got, *chunks] == [1, 2]
        print(before - rss())
    """
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    assert int(out.stdout) > 40e6
