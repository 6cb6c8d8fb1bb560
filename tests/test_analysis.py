from math import comb, log10

import numpy as np
import pytest

from seqloom.functions.similarity import similarity
from seqloom.operators import clustering, contingency, factors, matching
from seqloom.sources import files


@pytest.mark.parametrize("k,f,t,T", [(0, 5, 10, 100), (5, 5, 10, 100), (1, 7, 30, 60), (4, 7, 30, 60), (3, 3, 3, 3)])
def test_specificity(k, f, t, T):
    pmf = lambda x: comb(f, x) * comb(T - f, t - x) / comb(T, t) if 0 <= t - x <= T - f else 0.0
    up = k >= (f + 1) * (t + 1) // (T + 2)
    want = -log10(min(1, sum(pmf(x) for x in range(k, min(f, t) + 1)))) if up else log10(sum(pmf(x) for x in range(k + 1)))
    assert contingency.specificity([k], [f], [t], [T])[0] == pytest.approx(round(want, 4), abs=2e-4)


def test_similarity_by_hand():
    assert similarity([[1], [2]], [[1], [2]]) == 1
    assert similarity([[1]], [[2]]) == 0
    assert similarity([[1, 2]], [[1], [2]]) == pytest.approx(2 / 3 * 0.5)
    assert similarity([[5], [1]], [[1], [2]]) == 0  # the first itemset has no partner


def test_conflicts_of_similarity_by_hand():
    from seqloom.functions.similarity import _pairing

    # rows 0 and 1 both prefer column 0; only what lies after it is free
    assert _pairing([[1.0, 0.2, 0.0], [0.9, 0.1, 0.6]], False) == {0: 0, 1: 2}  # (1 + 0.6) / 2 = 0.8 against (0.9 + 0.2) / 4
    # the later row keeps its column at half of the whole score: (0.8 + 0.8) / 4 = 0.4, not (0.4 + 0.8) / 2 = 0.6
    assert _pairing([[0.9, 0.8], [0.8 + 0.1, 0.2]], False) == {0: 0, 1: 1}  # (0.9 + 0.2) / 2 = 0.55 against (0.9 + 0.8) / 4 = 0.425
    # and wins where the whole of it is greater: (1 + 0.9) / 4 = 0.475 against (0.9 + 0) / 2 = 0.45
    assert _pairing([[0.9, 0.9], [1.0, 0.0]], False) == {0: 1, 1: 0}
    # to the left, with the historical offset: the place of the mover counts from the rival
    assert _pairing([[0.0, 0.9], [0.5, 0.8]], False) == {0: 1, 1: 0} and _pairing([[0.0, 0.9], [0.5, 0.8]], True) == {0: 1, 1: 2}


def test_leaders_and_medoids(spark):
    p = clustering.ordered(spark.createDataFrame([([[1], [2]], 9), ([[1], [2], [3]], 8), ([[7], [8]], 7), ([[7], [8], [9]], 6)], "pattern array<array<int>>, support long"))
    sims = clustering.similarities(p)
    got = {r["pattern_id"]: r["leader"] for r in clustering.leaders(p, sims).collect()}
    s = {(r["p"], r["q"]): r["sim"] for r in sims.collect()}
    want, free = {}, [1, 2, 3, 4]
    while free:
        lead = free.pop(0)
        want[lead] = lead
        for x in [y for y in free if s.get((lead, y), 0) > 0.5]:
            want[x] = lead
            free.remove(x)
    assert got == want
    members, center = clustering.clustered(p)
    assert members.count() == 4 and center.count() == len({r["cluster"] for r in members.collect()})


def test_medoids_of_a_large_cluster(spark):
    """The mean is over all 601 members: 7 is near those that others know nothing of."""
    pairs = [(7, q, 0.9) for q in range(501, 602)] + [(3, q, 0.5) for q in range(1, 120) if q != 3] + [(550, q, 0.8) for q in range(502, 549)] + [(9, 9, 1.0)]
    sims = spark.createDataFrame(pairs, "p long, q long, sim double")
    clusters = spark.createDataFrame([(1, i) for i in range(1, 602)] + [(2, 900), (2, 901)], "cluster long, pattern_id long")
    got = {r["cluster"]: (r["pattern_id"], r["score"]) for r in clustering.medoids(clusters, sims).collect()}
    assert got == {1: (7, pytest.approx((600 - 101 * 0.9) / 601, abs=1e-9)), 2: (900, 0.5)}


def test_correspondence_analysis(spark):
    n = np.array([[10, 2, 3], [4, 20, 1], [5, 6, 30], [1, 1, 2]])
    freq = spark.createDataFrame([(f"f{i}", f"p{j}", int(n[i, j])) for i in range(4) for j in range(3)], "feature string, part string, k long")
    got = factors.analysis(freq)
    p = n / n.sum()
    r, c = p.sum(1), p.sum(0)
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    want = np.linalg.svd(s)[1][:2] ** 2
    assert np.allclose([x["eigenvalue"] for x in got["eig"].orderBy("axis").collect()], want, atol=1e-6)
    u, d, _ = np.linalg.svd(s)
    rows = {(x["label"], x["axis"]): x["coord"] for x in got["rows"].collect()}
    for a in range(2):
        assert np.allclose([abs(rows[f"f{i}", a + 1]) for i in range(4)], np.abs(u[:, a] * d[a] / np.sqrt(r)), atol=1e-5)
    assert sum(x["contrib"] for x in got["rows"].where("axis = 1").collect()) == pytest.approx(100, abs=1e-3)


def test_hierarchical_clusters():
    x = np.array([[0, 0], [0, 1], [10, 0], [10, 1], [0, 20], [1, 20]], float)
    got = factors.hierarchical(x, np.ones(6))
    assert len(set(got)) == 3 and got[0] == got[1] and got[2] == got[3] and got[4] == got[5]
    assert factors.v_test(9, 10, 10, 100) > 2 > -2 > factors.v_test(0, 50, 20, 100)


def test_v_test_takes_few_terms_however_large_the_table(monkeypatch):
    from statistics import NormalDist

    def whole(k, f, t, T):
        p = {x: comb(f, x) * comb(T - f, t - x) / comb(T, t) for x in range(max(0, f + t - T), min(f, t) + 1)}
        low, high = (sum(v for x, v in p.items() if (x - k) * s > 0) + p[k] / 2 for s in (-1, 1))
        return -NormalDist().inv_cdf(min(max(min(low, high), 1e-300), 0.5)) * (1 if high < low else -1)

    for f, t, T in [(5, 10, 100), (7, 30, 60), (40, 70, 90), (3, 3, 3), (200, 300, 900), (1, 1, 2)]:
        for k in range(max(0, f + t - T), min(f, t) + 1):
            assert abs(factors.v_test(k, f, t, T)) == pytest.approx(abs(whole(k, f, t, T)), abs=2e-6)
            assert factors.v_test(k, f, t, T) * whole(k, f, t, T) > -1e-6
    asked, pmf = [], factors.log_pmf
    monkeypatch.setattr(factors, "log_pmf", lambda k, *x: asked.append(len(k)) or pmf(k, *x))
    n = 10**9  # the normal law is near enough
    sd = (n / 20 * (19 / 20) * (19 / 20) / 20) ** 0.5
    for z in (-3, 0, 2, 5):
        assert factors.v_test(n // 400 + round(z * sd), n // 20, n // 20, n) == pytest.approx(z, abs=5e-3)
    assert sum(asked) <= 4


def test_token_queries(spark):
    assert matching.parse('[lemma="a" & pos="N"][]') == [[("lemma", "a"), ("pos", "N")], []]
    assert matching.to_query('{lemma_"of",pos_"IN"} {feats_Number=Sing}') == '[lemma="of" & pos="IN"][feats_Number="Sing"]'
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "."), (1, 3, "b"), (2, 1, None)], "doc int, pos int, lemma string")
    assert matching.matches(t, '[lemma="."]', ["doc"], ["pos"]).count() == 1
    assert matching.matches(t, '[lemma="."]', ["doc"], ["pos"], regex=True).count() == 3
    assert [r["pos"] for r in matching.matches(t, '[lemma="a"][lemma="."]', ["doc"], ["pos"]).collect()] == [1]


@pytest.mark.parametrize("low,high", [(0, 0), (0, 2), (1, 2)])
def test_patterns_with_gaps(spark, low, high):
    import random

    r = random.Random(low + high)
    items = [(1, s, p, i) for s in range(12) for p in range(8) for i in r.sample("abcd", r.randint(0, 2))]
    patterns = [[["a"]], [["a", "b"]], [["a"], ["b"]], [["a"], ["c", "d"], ["a"]], [["b"], ["b"], ["b"]]]
    at = {}
    for _, s, p, i in items:
        at.setdefault((s, p), set()).add(i)
    want = set()
    for k, pattern in enumerate(patterns):
        for s, p in at:
            ends = [p] if set(pattern[0]) <= at[s, p] else []
            for step in pattern[1:]:
                ends = [e + 1 + g for e in ends for g in range(low, high + 1) if set(step) <= at.get((s, e + 1 + g), set())]
            if ends:
                want.add((k, s, p))
    t = spark.createDataFrame(items + items[:3], "text_id int, seq_id int, pos int, item_id string")
    got = matching.match_patterns(spark.createDataFrame(list(enumerate(patterns)), "pattern_id int, pattern array<array<string>>"), t, low, high)
    assert sorted((x["pattern_id"], x["seq_id"], x["start"]) for x in got.collect()) == sorted(want) and len(want) > 10


def test_words_of_whole_sentences(spark):
    """Motifs and bigrams come from sentences as they are: the same as by tokens, without a shuffle."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [(d, s, [r.choice("abc") for _ in range(r.randint(1, 9))]) for d in range(6) for s in range(1, 5)] + [(9, 1, ["a"] * 4), (9, 2, [])]
    motifs = [["a"], ["a", "a"], ["b", "c", "a"], ["z"]]
    sents = spark.createDataFrame(rows, "doc_id int, sent_id int, words array<string>")
    hits = matching.match_words(sents, motifs)
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    tokens = sents.select(F.col("doc_id").alias("text_id"), F.col("sent_id").alias("seq_id"), F.posexplode("words").alias("pos", "item_id"))
    p = spark.createDataFrame([(i, [[w] for w in m]) for i, m in enumerate(motifs)], "pattern_id int, pattern array<array<string>>")
    want = matching.match_patterns(p, tokens).groupBy("text_id", "seq_id", "pattern_id").count()
    assert sorted(map(tuple, hits.select("doc_id", "sent_id", "pattern_id", "k").collect())) == sorted(map(tuple, want.collect()))
    assert (9, 1, 1, 3) in set(map(tuple, hits.select("doc_id", "sent_id", "pattern_id", "k").collect()))  # they overlap
    got = {(x["doc_id"], x["sent_id"]): x["b"] for x in sents.select("*", matching.sentence_bigrams(F.col("words")).alias("b")).collect()}
    assert got == {(d, s): [f"{x} {y}" for x, y in zip(w, w[1:])] for d, s, w in rows}


@pytest.mark.parametrize("name", ["motif_by_doc", "pattern_coverage", "bigram_by_source", "frequent_bigrams_by_source"])
def test_no_query_of_documents_shuffles_tokens(spark, name):
    from seqloom.plans import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "sent_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x) and "SortMergeJoin" not in plan


def test_cells_of_whole_parts(spark):
    freq = spark.createDataFrame([("x", "a", 3), ("x", "b", 1), ("y", "a", 2)], "feature string, part string, k long")
    sizes = spark.createDataFrame([("a", 50), ("b", 30)], "part string, t long")
    cells = contingency.kftt(freq, sizes, others=True)
    assert sorted(map(tuple, cells.collect())) == [("others", "a", 50, 80, 50, 80), ("others", "b", 30, 80, 30, 80), ("x", "a", 3, 4, 50, 80), ("x", "b", 1, 4, 30, 80), ("y", "a", 2, 2, 50, 80), ("y", "b", 0, 2, 30, 80)]
    assert {r["score"] for r in contingency.specificities(cells).where("feature = 'others'").collect()} == {0.0}


def test_items_of_token_files(spark, tmp_path):
    from seqloom.sources import adapters

    text = "1\tA\ta\tDET\tDT\tDefinite=Ind|PronType=Art\t2\tdet\t_\tner=O\n2\tcat\t_\tNOUN\t_\t57\t0\troot\t_\t_\n1\tOk\tok\tX\t_\t_\t0\troot\t_\t_\n"
    for name in ("t1", "t2"):
        (tmp_path / f"{name}.conllu").write_text(text)
    tok = files.renumbered(files.conllu(spark, str(tmp_path)))
    assert sorted({(r["text_id"], r["sent_id"]) for r in tok.collect()}) == [("t1", 1), ("t1", 2), ("t2", 3), ("t2", 4)]
    got = adapters.token_items(tok, ["form", "lemma", "pos", "dep", "feats"], ["sent_id"]).where("sent_id = 3").orderBy("pos", "item").collect()
    assert [(r["pos"], r["item"]) for r in got] == [(1, x) for x in ('dep_"det"', "feats_Definite=Ind", "feats_PronType=Art", 'form_"A"', 'lemma_"a"', 'pos_"DET"')] + [(2, x) for x in ('dep_"root"', 'form_"cat"', 'pos_"NOUN"')]
    files.write_conllu(files.conllu(spark, str(tmp_path)), str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out" / "text_id=t1"), wholetext=True).first()["value"]
    assert back.replace("\n\n", "\n") == text.replace("\t57\t", "\t_\t") + ("" if back.endswith("\n") else "")


def test_files(spark, tmp_path):
    (tmp_path / "t1.conllu").write_text("# c\n1\tA\ta\tDET\tDT\tDefinite=Ind|PronType=Art\t3\tdet\t7\tner=O\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n2\t#tag\t\tNOUN\t_\t57\t0\troot\t_\t_\n\n1\tnull\tnone\tX\t_\t_\t0\troot\t_\t_\n")
    got = [r.asDict() for r in files.conllu(spark, str(tmp_path)).orderBy("sent_id", "pos").collect()]
    assert [(g["sent_id"], g["pos"], g["form"], g["lemma"]) for g in got] == [(1, 1, "A", "a"), (1, 2, "#tag", ""), (2, 1, "null", "none")]
    assert got[0]["feats"]["PronType"] == "Art" and got[1]["feats"] is None
    seq = spark.createDataFrame([(1, 1, 12), (1, 1, 57), (1, 2, 13), (2, 1, 5)], "seq_id long, pos int, item_id int")
    files.write_sequences(seq, str(tmp_path / "s"))
    assert sorted(map(tuple, files.read_sequences(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, seq.collect()))
    (tmp_path / "p.txt").write_text("{1,2} {3} : 7\n")
    assert files.read_patterns(spark, str(tmp_path / "p.txt")).first().asDict() == {"pattern": [[1, 2], [3]], "support": 7}
    p = files.MiningParams.parse("MINSUP=5\n;x=1\nNB_ITEMSET_MIN==3\nOR=1,2\nOR=4\n")
    assert (p.minsup, p.min_itemsets, p.or_items) == (5, 3, [1, 2, 4])


def test_stream_of_sessions(spark, tmp_path):
    from seqloom.streaming.sessions import sessions

    rows = spark.sql("SELECT 1L AS user_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,10*id) AS ts, id AS event_id, 'e' AS event_type FROM range(3) UNION ALL SELECT 1L, timestamp'2024-01-02 00:00:00', 9L, 'f'")
    rows.write.parquet(str(tmp_path / "e"))
    q = sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("sess").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n_events"], r["items"]) for r in spark.sql("SELECT * FROM sess").collect()] == [(3, ["e"] * 3)]
