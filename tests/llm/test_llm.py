import math
import random
import string

import numpy as np
import pytest
import regex

from loomgraph.llm import consensus, mixing, neardup, pairs, ranking, repetition, splitting, tokenizing

WORD = regex.compile(r"[\p{L}\p{N}]+")


# ---------------------------------------------------------------- p2


def models(spark):
    en = "The river covers the harbour wall and the market feeds the older mill because the winter was long. "
    fr = "La rivière recouvre le mur du port et le marché nourrit le vieux moulin parce que l'hiver était long. "
    de = "Der Fluss bedeckt die Hafenmauer und der Markt speist die alte Mühle, weil der Winter lang gewesen ist. "
    docs = spark.createDataFrame([(i, t and t * 3, lang, "x") for i, (t, lang) in enumerate([(en, "en"), (fr, "fr-FR"), (de, " DE"), (en, "fr"), (en, "EN"), (fr, "fr"), (None, "en"), (fr, None)] * 4)], "doc_id bigint, text string, lang string, answer string")
    ok = "The mill grinds the grain, and the river turns the wheel.\n\nIn spring the market opens again."
    rows = [
        (1, "What does the mill do?", ok), (2, "What does the mill do?", None), (3, None, " ​\n<br/>**…"), (4, "What does the mill do?", "Question: What does the the mill do?"),
        (5, "What does the mill do?", "I'm sorry, but I can't help with this question. Please try a different question."), (6, "What does the mill do?", fr_answer := "Le moulin écrase le grain et la rivière fait tourner la roue. Au printemps, le marché ouvre."),
        (7, "What does the mill do?", "The mill grinds the grain, and the river turns the"), (8, "Que fait le vieux moulin près de la rivière ?", fr_answer), (9, "What does the mill do?", "Growers decline to use the mill. The river turns the wheel of the market."), (10, None, fr_answer),
        (11, "What does the mill do?", "The mill grinds the grain.\n\n```\ngrain = load(8\nfor"), (12, "", "No."),
    ] + [(100 + i, "q", ok if i % 2 else ok + "\n\n```\ngrain = load(8)\nfor x in grain:\n    turn(x)\n```") for i in range(60)]
    return docs, spark.createDataFrame(rows, "answer_id bigint, query string, answer string")


def test_pairs(spark):
    docs, answers = models(spark)
    got = {r.answer_id: r.defect for r in pairs.found(answers, docs).collect()}
    assert got == {2: "empty", 3: "empty", 4: "copied_question", 5: "refusal", 6: "other_language", 7: "truncated", 11: "truncated"}
    assert pairs.found(answers.limit(0), docs).count() == 0


def test_refusals_in_other_words(spark):
    """The phrases only label; all words of a response decide."""
    sorry = ["I'm sorry, but I can't help with this question. Please try a different question.", "I am unable to answer this question. Please ask a specialist."]
    sound = ["The mill grinds the grain and the river turns the wheel in spring.", "Growers keep the grain dry; the market opens in the morning."]
    rows = [(i, "q", (sorry if i % 5 == 0 else sound)[i % 2]) for i in range(200)] + [(900, "q", "I'm sorry, but with this question I can't. Please try a different specialist."), (901, "q", sound[0] + " I can't help with this question. " + sound[1])]
    got = {r.answer_id: r.defect for r in pairs.found(spark.createDataFrame(rows, "answer_id bigint, query string, answer string"), models(spark)[0]).collect()}
    assert got[900] == "refusal" and 901 not in got and sum(v == "refusal" for v in got.values()) == 41


@pytest.mark.parametrize("text", ["Auf eine Antwort für diese Frage muss ich verzichten.", "SORRY, IT IS NOT POSSIBLE FOR ME TO ADDRESS THAT REQUEST.", "Lamentablemente, no puedo responder a esta pregunta.", "Désolé, je ne peux pas répondre à cette question."])
def test_refusals(text):
    assert pairs.looks_refused(text)


@pytest.mark.parametrize("text", ["Leider können die Felder hier nicht helfen.", "I can't confirm the year, yet the mill stood by 1900.", "No answer fits every field. The mill stands.", "The author was unable to explain the mill."])
def test_no_refusals(text):
    assert not pairs.looks_refused(text)


# ---------------------------------------------------------------- p4


def votes(spark, rows):
    return spark.createDataFrame(rows, "packet_id bigint, baseline_variant string, other_variant string, human_preferred_variant string, human_outcome string, llm_strict_outcome string")


def test_ranking(spark):
    cat = spark.createDataFrame([("hi", 1), ("a_b", 1), ("c", 1), ("lone", 1)], "variant string, item int")
    tot = spark.createDataFrame([("A-B", "hi ", 30, 10, 2), ("c", "hi", None, None, None)], "variant string, baseline string, raw_wins_vs_hi int, raw_losses_vs_hi int, raw_ties int")
    p = votes(spark, [(1, "hi", "c", "HI", "baseline_win", "disagree"), (1, "hi", "c", "HI", "baseline_win", "disagree"), (2, "hi", "A b", None, None, "other_win"), (3, "c", "c ", "c", "other_win", "tie"), (None, "hi", "c", "hi", "baseline_win", "baseline_win"), (5, "hi", None, "hi", None, None), (6, "hi", "unknown", "hi", "baseline_win", None)])
    r = {x.variant: x for x in ranking.rank(p, tot, cat).collect()}
    assert [v for v, _ in sorted(r.items(), key=lambda kv: kv[1].rank_pos)] == ["a_b", "lone", "hi", "c"] or r["a_b"].rank_pos == 1 and r["c"].rank_pos == 4
    assert r["c"].n_votes == 3 and r["lone"].n_votes == 0
    none = ranking.rank(p.limit(0), tot.limit(0), cat).orderBy("rank_pos").collect()
    assert [x.variant for x in none] == ["a_b", "c", "hi", "lone"]
    assert ranking.inconsistency(p, tot, cat).count() == 2


def test_both_solvers_agree(spark):
    rng = random.Random(1)
    e = spark.createDataFrame([(f"i{a}", f"i{b}", rng.gauss(0, 1), rng.random() + 0.1, 1.0) for a in range(8) for b in range(a + 1, 8) if (a + b) % 3], "a string, b string, y double, weight double, n double")
    items = spark.createDataFrame([(f"i{a}",) for a in range(8)], "item string")
    one = {r.item: r.strength for r in ranking.strengths(e, items).collect()}
    two = {r.item: r.strength for r in ranking.strengths(e, items, small=0).collect()}
    assert all(math.isclose(one[k], two[k], abs_tol=1e-7) for k in one)
    assert all(ranking.strengths(e, items, small=k).agg({"residual": "max"}).first()[0] <= ranking.TOLERANCE for k in (0, 100))


# ---------------------------------------------------------------- p5


def test_consensus(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    for p in range(150):
        truth[p] = rng.choice(["hi", "naive", "tie"])
        for a, good in (("ann-1", 0.95), ("Ann 2", 0.9), ("ann_3", 0.9), ("liar", 0.0), ("lazy", None)):
            flip = rng.random() < 0.5
            shown = {"Answer A": "naive" if flip else "hi", "Answer B": "hi" if flip else "naive"}
            if good is None:
                lab = "Answer A."
            else:
                v = truth[p] if rng.random() < good else rng.choice([x for x in ("hi", "naive", "tie") if x != truth[p]])
                lab = "both" if v == "tie" else next(k for k, x in shown.items() if x == v).lower()
            for k, v in shown.items():
                rows.append((p, "hi vs naive", v, k, 150.0 if p % 9 else None, lab, None, None, None, a, 1.0))
    rows += rows[:7]
    rows.append((999, "hi vs naive", "hi", "Answer A", -1.0, None, None, None, None, None, 0.0))
    df = spark.createDataFrame(rows, "packet_id bigint, comparison_pair string, variant string, label string, answers_question_score double, preferred_label string, preferred_variant string, is_preferred_win double, raw_preferred_answer string, annotator_id string, r double")
    got = {r.packet_id: r for r in consensus.packets(df).collect()}
    assert got[999].consensus_choice == "tie" and got[999].n_votes == 0
    assert np.mean([got[p].consensus_choice == t for p, t in truth.items()]) > 0.93
    rel = {r.annotator: r.reliability for r in consensus.annotators(df).collect()}
    assert rel["ann_1"] > 0.7 and rel["liar"] < -0.2 and abs(rel["lazy"]) < 0.3
    assert consensus.found(df.limit(0)).count() == 0


# ---------------------------------------------------------------- p6


def brute_pairs(texts):
    s = {}
    for i, t in texts:
        w = WORD.findall((t or "").lower())
        if len(w) >= 30:
            s[i] = set(zip(w, w[1:], w[2:], strict=False))
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b]) - 1e-9}


def test_neardup(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    texts, n = [], 0
    notice = [rng.choice(vocab) for _ in range(45)]
    for g in range(25):
        base = notice if g % 3 == 0 else [rng.choice(vocab) for _ in range(rng.randint(28, 70))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            n += 1
            texts.append((n, " ".join(w)))
    texts += [(500, None), (501, ""), (502, "short text"), (503, texts[0][1]), (504, texts[0][1].upper()), (505, "Ä" * 50_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "context_id bigint, context string, rep string, n int")
    want = brute_pairs(texts)
    got = [tuple(r) for r in neardup.found(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    links = {i: 0 for i, _ in texts}
    for a, b in want:
        links[a] += 1
        links[b] += 1
    assert {r.id: r.n_links for r in neardup.classes(df).collect()} == links
    assert neardup.found(df.limit(0)).count() == 0


# ---------------------------------------------------------------- p7


@pytest.mark.parametrize("seed", range(6))
def test_split_text(seed):
    rng = random.Random(seed)
    bits = ["word ", "Sentence ends. ", "\n\n", "\r\n", "## Head\n", "x" * 300, "长" * 80, "。", "é́ ", "\t", "\n# T\n"]
    text = "".join(rng.choice(bits) for _ in range(400)) + "y" * 3000
    p = splitting.split_text(text)
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(0 < e - s <= 1200 for s, e in p)
    for (_s1, e1), (s2, e2) in zip(p, p[1:], strict=False):
        assert 60 <= e1 - s2 <= 140 and e2 > e1
        assert text[s2 - 1 : s2 + 1] != "\r\n" and text[e1 - 1 : e1 + 1] != "\r\n"
    back = text[: p[0][1]] + "".join(text[e1:e2] for (_, e1), (_, e2) in zip(p, p[1:], strict=False))
    assert back == text


def test_pieces_end_at_the_highest_level():
    para = lambda n: ("Sheep graze on the hill. " * 60)[:n].rstrip() + "."
    three = "\n\n".join(para(1120) for _ in range(3))
    got = list(splitting.Splitter(three, 1200, 100, 30).pieces())
    assert got[0][1] == three.index("\n\n") + 2 and got[0][2] == 1
    sections = "".join(f"# Part {i}\n\n" + "\n\n".join(para(200 + 40 * j) for j in range(4)) + "\n" for i in range(6))
    ends = [k for *_, k in splitting.Splitter(sections, 1200, 100, 30).pieces()][:-1]
    assert all(k in (0, 1) for k in ends) and ends.count(0) >= 4
    assert [k for *_, k in splitting.Splitter("x" * 3000, 1200, 100, 30).pieces()] == [4, 4, -1]
    assert {k for *_, k in splitting.Splitter("word " * 900, 1200, 100, 30).pieces()} == {3, -1}


def test_pieces(spark):
    rows = [("a", 1, None, "z " * 900), ("b", None, 2, "short"), ("c", 1, 3, None), ("d", 1, 4, ""), ("e", 1, 5, "q" * 1200), ("f", 1, 6, "q" * 1201)]
    df = spark.createDataFrame(rows, "chunk_id string, document_id bigint, chunk_order int, text string").selectExpr("*", "1 AS piece", "'x' AS k")
    assert {r.chunk_id for r in splitting.found(df).collect()} == {"a", "f"}
    assert [r.piece for r in splitting.pieces(df).filter("chunk_id = 'a'").orderBy("piece").collect()] == [0, 1]
    assert splitting.pieces(df.limit(0)).count() == 0


# ---------------------------------------------------------------- p8


def test_lexicon_is_a_map():
    rng = random.Random(4)
    words = {"".join(rng.choice("abcé ") for _ in range(rng.randint(1, 6))).encode() for _ in range(800)}
    entries = {w: [rng.randrange(50_000) for _ in range(rng.randint(1, 4))] for w in words}
    lex = tokenizing.Lexicon.open(None, tokenizing.compile_lexicon(entries.items()))
    assert all(lex.get(w) == ids for w, ids in entries.items())
    assert all(lex.get(w + b"zz") is None for w in entries) and lex.get(b"") is None
    assert len(lex.finals) < sum(map(len, words))  # suffixes are shared


def test_encode(spark):
    import tiktoken

    ranks = tokenizing.load_ranks(tokenizing.vocabulary())
    enc = tiktoken.Encoding("own", pat_str=tokenizing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["", None, "Hello world<|endoftext|> it's", "aaaa" * 5000, " \n\t  x", "你好, мир 👩‍👩‍👧 é", "the the the the"] + ["".join(rng.choice(string.printable + "éß日") for _ in range(200)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(None, "a", [1])], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in tokenizing.encode(df).collect()}
    assert {k: v for k, v in got.items() if k is not None} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tokenizing.encode(df.limit(0)).count() == 0


# ---------------------------------------------------------------- p9


def test_tree_redistributes_to_siblings_first():
    leaves = [dict(source=s, weight=w, room=r, tokens=r, domain=d, language=lg) for s, w, r, d, lg in [("a", 0.25, 10, "x", "en"), ("b", 0.25, 100, "x", "en"), ("c", 0.25, 100, "x", "fr"), ("d", 0.25, 100, "y", "en")]]
    g = {k[0]: v for k, v in mixing.budgets(leaves, 200).items()}
    assert g["a"] == 10 and g["b"] == pytest.approx(90) and g["c"] == pytest.approx(50) and g["d"] == pytest.approx(50)
    assert mixing.exact_total(leaves) == pytest.approx(40)
    assert all(v == pytest.approx(10) for v in mixing.budgets(leaves, mixing.exact_total(leaves)).values())
    assert sum(mixing.budgets(leaves).values()) == sum(mixing.budgets(leaves, 1e9).values()) == pytest.approx(310)


def test_mix(spark):
    docs = spark.createDataFrame([(i, "word and more " * (i % 7), ["en", "fr"][i % 2], s, "d", 0) for i, s in enumerate(["A ", "b", "b", "b", "c", None] * 40)] + [(None, "word " * 9, None, "a", None, 0)], "doc_id bigint, text string, lang string, source string, dataset string, n_tokens int")
    t = spark.createDataFrame([("a", 0.4, 3), ("B", 0.4, 2), ("gone", 0.2, 2), ("c", None, 1)], "source string, target_share double, max_repeats int")
    taken, rep = mixing.mix(docs, t)
    r = {x.source: x for x in rep.collect()}
    assert r["gone"].tokens == 0 and r["c"].tokens == 0 and sum(x.actual_share for x in r.values()) == pytest.approx(1)
    assert abs(sum(x.tokens for x in r.values()) - r["a"].own_tokens - r["b"].own_tokens) < 60 and r["a"].epochs > 1
    assert all(x["count"] <= {"a": 3, "b": 2}[x.source] for x in taken.groupBy("source", "doc_id").count().collect())
    e = {x.source: x.actual_share for x in mixing.mix(docs, t, exact=True)[1].collect()}
    assert abs(e["a"] - 0.5) < 0.05 and abs(e["b"] - 0.5) < 0.05
    assert mixing.mix(docs.limit(0), t)[1].agg({"tokens": "sum"}).first()[0] == 0


# ---------------------------------------------------------------- p10


def test_repetition(spark):
    rng = random.Random(8)
    docs = []
    for i in range(120):
        s = [" ".join(rng.choice(string.ascii_lowercase) * 3 for _ in range(rng.randint(4, 12))) + "." for _ in range(rng.randint(1, 12))]
        for _ in range(rng.randint(0, 8)):
            s.insert(rng.randrange(len(s) + 1), rng.choice(s))
        docs.append((i, rng.choice(["\n", " "]).join(s)))
    docs += [(900, None), (901, ""), (902, "a b c d"), (903, "spam eggs ham jam tea " * 4000), (904, "\n \n")]
    want = set()
    for i, t in docs:
        w = WORD.findall((t or "").lower())
        runs = list(zip(*(w[k:] for k in range(5)), strict=False))
        if runs and 1 - len(set(runs)) / len(runs) >= 0.3:
            want.add(i)
    df = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id bigint, text string, content_share double")
    assert {r.doc_id for r in repetition.found(df).collect()} == want and 903 in want
    m = {r.doc_id: r for r in repetition.retention(df).collect()}
    assert m[900].content_share == 1.0 and m[900].retained and m[902].n_runs == 0 and not m[903].retained
    assert repetition.found(df.limit(0)).count() == 0
