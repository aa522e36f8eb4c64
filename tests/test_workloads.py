"""Operators on small cases with results worked out by hand or by plain versions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpusjobs.functions import tagset, text
from corpusjobs.operators import alignment, association, edit_trees, evaluation, features, lexicon, models, sentences, treebank, trees


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_scalars(spark):
    tags = lambda *t: one(spark, text.multiword_pos(F.array(*map(F.lit, t))))
    assert [tags("NOUN", "VERB"), tags("NOUN", "INTJ"), tags("what"), tags("X", "what")] == ["VERB", "NOUN", "", "X"]
    assert one(spark, text.feature_key(F.col("a"), F.col("b")), a="x", b=None) == "x" and one(spark, text.feature_key(F.col("a"), F.col("b")), a="x", b="y") == "x_y"
    layers = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(5.0)))
    assert one(spark, text.mean_of(layers)) == [2.0, 3.5] and one(spark, text.sum_of(layers)) == [4.0, 7.0] and one(spark, text.concat_of(layers)) == [1.0, 2.0, 3.0, 5.0]
    assert one(spark, text.rounded(F.array(F.lit(1.23456), F.lit(-0.5)), 3)) == [1.235, -0.5]
    assert one(spark, text.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8] and one(spark, text.unit(F.array(F.lit(0.0)))) == [0.0]
    assert [round(x, 4) for x in one(spark, text.softmax(F.array(F.lit(0.0), F.lit(math.log(3.0)))))] == [0.25, 0.75]
    assert one(spark, text.full_rule(F.lit("a--b:a\u0300"))) == "a\u2014b\u0387a\u0301" and one(spark, text.vector_key(F.lit("Λόγος"))) == "λογοσ"
    assert [one(spark, text.is_punct(F.lit(c))) for c in (".", "", "a", "·")] == [True, True, False, True]
    forms = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, text.sentence_text(forms)) == "a b" and one(spark, text.sentence_text(forms, F.lit(2))) == "a [b]"
    record = one(spark, tagset.ud_record(F.lit("NOUN"), F.create_map(F.lit("Case"), F.lit("Nom"))))
    assert record.pos == "NOUN" and record.case == "Nom" and record.person == "_"
    label = lambda relation, **k: one(spark, text.context_label(F.lit("x"), F.lit(relation), F.lit("H"), **k))
    assert [label("OBJ"), label("CO"), label("OBJ", relations=True), label("OBJ", direction=False)] == ["H_x", "Cd_x", "H_OBJ_x", "x"]


def test_contexts_of_conjuncts(spark):
    rows = [(1, 0, "and", "c", "PRED"), (2, 1, "to", "r", "AuxP"), (3, 2, "eat", "v", "ADV"), (4, 3, "drink", "v", "CO"), (5, 4, "sip", "v", "CO"), (6, 1, ".", "PUNCT", "AuxK")]
    own = spark.createDataFrame(rows, "tok_idx long, head_id long, lemma string, upos string, relation string").selectExpr("1L as sent_id", "*")
    got = {(r.word, r.context) for r in treebank.contexts(own).collect()}
    assert {("drink", "Cd_eat"), ("drink", "H_to"), ("drink", "H_and"), ("sip", "Cd_drink"), ("sip", "H_to"), ("sip", "H_and"), ("eat", "H_to"), ("eat", "H_and"), ("and", "C_to"), ("and", "C_eat"), ("to", "H_and")} <= got
    assert not any("." in c for _, c in got) and {w for w, _ in got} == {"and", "to", "eat", "drink", "sip", "."}
    assert {r.word for r in treebank.contexts(own, wordclass="v", prefix="g").collect()} == {"g_eat", "g_drink", "g_sip"}
    assert {r.context for r in treebank.contexts(own, relations=True).filter("word = 'sip'").collect()} == {"Cd_CO_drink", "H_AuxP_to", "H_ADV_and"}
    gone = own.withColumn("artificial", F.col("tok_idx") == 3)
    assert "eat" not in {w for r in treebank.contexts(gone).collect() for w in (r.word, r.context.split("_")[-1])}
    double = own.unionByName(own.filter("tok_idx = 1").withColumn("lemma", F.lit("zzz")))
    assert treebank.resolved(double).count() == 7 and "zzz" not in {r.head_lemma for r in treebank.resolved(double).collect()}


def test_coordination(spark):
    # apples and pears (both conjuncts of 2, which hangs on 5), with a shared modifier 4, a particle 6 and padding 7
    rows = [(1, 2, "apple", "OBJ_CO"), (2, 5, "καί", "COORD"), (3, 2, "pear", "OBJ_CO"), (4, 2, "red", "ATR"), (5, 0, "eat", "PRED"), (6, 2, "τε", "AuxY"), (7, 5, "x", "UNLINKED"), (8, 7, "y", "UNLINKED")]
    own = spark.createDataFrame([(1, *r, r[0] > 6) for r in rows], "sent_id long, tok_idx long, head_id long, lemma string, relation string, artificial boolean")
    got = {r.tok_idx: (r.head_id, r.relation) for r in trees.apply(own, ["remove_padded_ellipsis", ("chain_coordination", {})]).collect()}
    assert got == {1: (5, "OBJ"), 2: (3, "AuxY"), 3: (1, "CO"), 4: (6, "ATR"), 5: (0, "PRED"), 6: (3, "AuxY")}
    without = {r.tok_idx: r.head_id for r in trees.apply(own.filter("tok_idx <> 6"), ["chain_coordination"]).collect()}
    assert without[4] == 2 and len(without) == 7  # shared modifiers move only where there is a particle

    def lift(forest, to):
        forest.head = np.where(forest.head < 0, -1, to)

    assert {r.head_id for r in trees.apply(own, [("lift", {"to": 0})], registry={"lift": lift}).collect()} == {0, 1}
    forms = trees.apply(own.withColumn("form", F.lit("\u00e9")), [], "NFD").first()
    assert forms.form == "e\u0301"
    chain = [(1, 2, "a", "ATR_CO"), (2, 3, "and", "COORD"), (3, 4, "of", "AuxP"), (4, 0, "eat", "PRED"), (5, 2, "the", "ATR")]
    node = {r.tok_idx: r for r in trees.resolve_nodes(spark.createDataFrame([(1, *r) for r in chain], "sent_id long, tok_idx long, head_id long, lemma string, relation string")).collect()}
    assert (node[3].real_id, node[3].real_relation, node[3].is_conjunct) == (2, "COORD", True)
    assert (node[2].real_relation, node[1].content_head, node[5].content_head, node[2].content_head, node[4].content_head) == ("ATR_CO", 3, 1, 3, None)


def test_sentences(spark):
    rows = spark.createDataFrame([(i, i * i % 5 + 1) for i in range(40)], "sent_id long, n long")
    got = {r.sent_id: r.first_id for r in sentences.running_ids(rows, "sent_id", "n").collect()}
    assert got == {i: sum(j * j % 5 + 1 for j in range(i)) for i in range(40)}
    runs = spark.createDataFrame([("u", i, k) for i, k in enumerate("aabba")], "unit string, at long, key string")
    assert [r.run for r in sentences.breaks_of(runs, "unit", "key", "at").orderBy("at").collect()] == [1, 1, 2, 2, 3]
    texts = spark.createDataFrame([(1, ["a", ".", "b"]), (2, ["c", "!"]), (3, [])], "doc_id long, forms array<string>")
    assert sorted((r.doc_id, r.sent_no, r.tok_idx, r.form) for r in sentences.break_sentences(texts).collect()) == [(1, 0, 1, "a"), (1, 0, 2, "."), (1, 1, 1, "b"), (2, 0, 1, "c"), (2, 0, 2, "!")]


def test_phrases_with_connectors(spark):
    said = ["cup of tea", "cup of tea", "tea cup", "of the tea", "cup of the tea"]
    rows = [(i, k, w) for i, t in enumerate(said) for k, w in enumerate(t.split())]
    own = spark.createDataFrame(rows, "sent_id long, tok_idx long, lemma string")
    got = {(r.a, r.b): r.n for r in association.phrases(own, -9, 1, ("of", "the")).collect()}
    assert got == {("cup", "of_tea"): 2, ("tea", "cup"): 1, ("cup", "of_the_tea"): 1}
    assert ("cup", "of") in {(r.a, r.b) for r in association.phrases(own, -9, 1).collect()}


def test_alignment(spark):
    words, tgt = spark.createDataFrame([("ab_cd",), ("x",)], "word string"), spark.createDataFrame([("a b c",), ("y",)], "tgt string")
    assert sorted(r.parts for r in alignment.multi_words(words, tgt).collect()) == [["a", "b", "c"], ["ab", "cd"]]
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate("z a b c a b".split())], "sent long, idx long, lemma string")
    items = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), (["b", "c"],)], "parts array<string>")
    spans = alignment.spans_of(tokens, items)
    assert sorted((r.start, r.n) for r in spans.collect()) == [(1, 2), (1, 3), (2, 2), (4, 2)]
    assert sorted((r.start, r.n) for r in alignment.greedy_longest(spans).collect()) == [(1, 3), (4, 2)]
    assert alignment.lemma_sets(tokens, alignment.greedy_longest(spans)).first().lemmas == ["a", "a_b", "a_b_c", "b", "c", "z"]
    marks = spark.createDataFrame([(1, i, w) for i, w in enumerate("a,b.")], "sent long, idx long, form string")
    assert [(r.position, r.length) for r in alignment.content_positions(marks).orderBy("idx").collect()] == [(0, 2), (0, 2), (1, 2), (1, 2)]
    scored = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.1), (2, 0, 0.2)], "g long, c long, score double")
    assert sorted((r.g, r.c) for r in alignment.best_candidates(scored, ["g"], "score", "c").collect()) == [(1, 0), (2, 0)]
    results = spark.createDataFrame([(0.9, False, 1), (0.5, True, 0), (0.4, False, 1), (0.2, True, 0)], "score double, unaligned boolean, correct int")
    assert alignment.accuracy(results, 0.45).first().accuracy == 0.5 and [r.correct for r in alignment.relabelled(results, 0.45).orderBy("score").collect()] == [1, 0, 0, 1]


def test_static_and_lexicon_cosines(spark):
    source = spark.createDataFrame([(1, 0, "Λόγος", "Λόγος"), (1, 1, ".", ".")], "sent long, idx long, form string, lemma string")
    target = spark.createDataFrame([(1, 0, "word", "word", "NOUN", "nsubj", 0), (1, 1, "none", "none", "NOUN", "obj", 0)], "sent long, idx long, form string, lemma string, pos string, dep string, head_idx long")
    scores = spark.createDataFrame([("Λόγος", "word", 1.0, 0.5, 2.0, 0.25)], "src string, tgt string, pmi double, dice double, odds_ratio double, rel_freq double")
    lex = spark.createDataFrame([("Λόγος", "speech")], "src string, tgt string")
    left = spark.createDataFrame([("λογοσ", [1.0, 0.0])], "key string, vector array<double>")
    right = spark.createDataFrame([("word", [3.0, 4.0]), ("speech", [4.0, 3.0])], "key string, vector array<double>")
    cands = alignment.candidates(target, spark.createDataFrame([], "expr string"))
    rows = {r.tgt: r for r in alignment.feature_table(source, target, cands, scores, lex, (left, right)).collect()}
    assert len(rows) == 2 and round(rows["word"].cosine_static, 6) == 0.6 and round(rows["word"].cosine_lexicon, 6) == 0.96 and not rows["word"].in_lexicon
    assert rows["none"].cosine_static is None and rows["none"].cosine_lexicon == 0 and rows["none"].rel_freq == 0 and rows["none"].pmi is None
    vector = lambda d: spark.createDataFrame([(1, i, v) for i, v in d.items()], "sent long, idx long, vector array<double>")
    pair = cands.unionByName(spark.createDataFrame([(1, [0, 1])], "sent long, indices array<long>"))
    got = {tuple(r.indices): round(r.cosine, 4) for r in alignment.contextual_cosines(vector({0: [1.0, 0.0]}), vector({0: [1.0, 0.0], 1: [0.0, 1.0]}), pair).collect()}
    assert got == {(0,): 1.0, (1,): 0.0, (0, 1): 0.7071}
    assert len(alignment.contextual_cosines(vector({0: [1.0, 0.0]}), vector({0: [1.0, 0.0]}), pair).collect()) == 1


def test_reduced_spans(spark):
    def reduced(words, span, pos=None, items=()):
        target = spark.createDataFrame([(1, i, f, le, p, d, h) for i, (f, le, p, d, h) in enumerate(words)], "sent long, idx long, form string, lemma string, pos string, dep string, head_idx long")
        spans = spark.createDataFrame([(1, 0, span, pos)], "sent long, idx long, indices array<long>, source_pos string")
        expressions = spark.createDataFrame([(e, m) for e, m in items], "expr string, multi boolean")
        return alignment.reduce_spans(target, spans, expressions).first().indices

    the_man = [("the", "the", "DET", "det", 1), ("man", "man", "NOUN", "nsubj", 2), ("spoke", "speak", "VERB", "ROOT", 2)]
    assert reduced(the_man, [0, 1]) == [1]  # determiners go
    he_was_going = [("he", "he", "PRON", "nsubj", 2), ("was", "be", "AUX", "aux", 2), ("going", "go", "VERB", "ROOT", 2)]
    assert reduced(he_was_going, [0, 1, 2]) == [2]  # subjects and auxiliaries of verbs go
    of_jesus = [("of", "of", "ADP", "prep", 0), ("Jesus", "Jesus", "PROPN", "compound", 2), ("Christ", "Christ", "PROPN", "pobj", 0)]
    assert reduced(of_jesus, [0, 1, 2]) == [1, 2]
    righteous = [("righteous", "righteous", "ADJ", "amod", 1), ("man", "man", "NOUN", "ROOT", 1)]
    assert reduced(righteous, [0, 1], "adjective") == [0] and reduced(righteous, [0, 1], "noun") == [0, 1]
    lets_go = [("let", "let", "VERB", "ROOT", 0), ("us", "we", "PRON", "nsubj", 0), ("go", "go", "VERB", "ccomp", 0)]
    assert reduced(lets_go, [0, 1, 2]) == [2]
    is_good = [("is", "be", "AUX", "ROOT", 0), ("good", "good", "ADJ", "acomp", 0)]
    assert reduced(is_good, [0, 1]) == [1] and reduced(is_good, [0, 1], items=[("is_good", False)]) == [0, 1]
    look_at = [("look", "look", "VERB", "ROOT", 0), ("at", "at", "ADP", "prep", 0), ("it", "it", "PRON", "pobj", 1)]
    assert reduced(look_at, [0, 1]) == [0]
    assert reduced(look_at, [0, 1, 2]) == [0, 1, 2] and reduced([("x", "x", "X", "dep", 0)], [0]) == [0]


def test_features(spark):
    rows = spark.createDataFrame([("1", "Rome", "a"), ("x", "up", "b"), (None, None, "zz")], "id string, form string, k string")
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [9.0, 9.0]), ("b", [0.0, 0.0])], "key string, vector array<double>")
    got = features.static_vectors(rows, vectors, F.col("k"), fill=2, normalized=True).orderBy("k").collect()
    assert [r.vector for r in got] == [[0.6, 0.8], [0.0, 0.0], [0.0, 0.0]]
    ids = spark.createDataFrame([("1", [1.0])], "key string, vector array<double>")
    assert [r.contextual for r in features.contextual_vectors(rows, ids).orderBy("k").collect()] == [[1.0], None, None]
    names = spark.createDataFrame([("Rome",)], "key string")
    assert [r.g for r in features.gazetteer(rows, names, F.col("form"), "g").orderBy("k").collect()] == [True, False, False]
    hot = features.one_hot(rows, "form")
    assert hot.columns == ["id", "k", "form_Rome", "form_up"] and [tuple(r)[2:] for r in hot.orderBy("k").collect()] == [(1, 0), (0, 1), (0, 0)]
    piece = spark.createDataFrame([(1, 0, None, [9.0]), (1, 1, 0, [1.0]), (1, 2, 0, [3.0]), (1, 3, 1, [5.0])], "sent_id long, piece_idx long, word_no long, vector array<double>")
    assert [[r.vector for r in features.word_vectors(piece, how).orderBy("word_no").collect()] for how in ("mean", "first", "last")] == [[[2.0], [5.0]], [[1.0], [5.0]], [[3.0], [5.0]]]
    some = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (-1, "x"), (None, "x")], "word_id long, label string")
    told = lambda **k: sorted(r.word_id for r in features.limit_vectors(some, **k).collect())
    assert [told(), told(ids=some.filter("word_id = 2"), labels=["x"]), told(labels=["x"], without=["y"]), told(without=["x"])] == [[1, 2, 3], [2], [1], [2, 3]]
    block, names = features.merged_blocks(spark.createDataFrame([([1.0, 2.0, 4.0],)], "v array<double>"), "v", ["e1", "a", "e2"], "e")
    assert block.first().v == [5.0, 2.0] and names == ["e", "a"]
    assert [r.id for r in features.distinct_last(rows.withColumn("g", F.lit(1)), ["g"], "k").collect()] == [None]


def test_lexicon(spark):
    cand = spark.createDataFrame([(1, 1, "noun", "nom", {"upos=noun": 0.6, "case=nom": 0.7}), (1, 1, "verb", "_", {"upos=verb": 0.4, "case=_": 0.3}), (1, 2, "noun", "dat", {"upos=noun": 0.6})], "sent_id long, tok_idx long, upos string, case string, probs map<string,double>")
    assert [(r.upos, round(r.p, 4), r.num_poss) for r in lexicon.choose_tags(cand, ["upos", "case"]).orderBy("tok_idx").collect()] == [("noun", 0.42, 2), ("noun", 0.0, 1)]
    probs = spark.createDataFrame([(1, 1, "upos", "noun", 0.6), (1, 1, "upos", "verb", 0.4), (1, 1, "case", "nom", 0.7), (1, 1, "case", "_", 0.3)], "sent_id long, tok_idx long, feat string, value string, prob double")
    r = lexicon.independent_tags(probs).first()
    assert r.tag == {"upos": "noun", "case": "nom"} and round(r.p, 4) == 0.42
    tokens = spark.createDataFrame([("f", "p", 1), ("f", "q", 2), ("g", "q", 3), ("g", "q", 4), ("u", "z", 5)], "form string, lemma string, seq long")
    counts = lexicon.lemma_counts(tokens, ["form"])
    lex = spark.createDataFrame([("f", "p"), ("f", "q"), ("g", "r")], "form string, lemma string")
    own = tokens.select("form").distinct().withColumn("fallback", F.lit("?"))
    got = {r.form: (r.lemma, r.possibilities) for r in lexicon.lemmas_by_lexicon(own, lex, counts, ["form"]).collect()}
    assert got == {"f": ("q", ["p", "q"]), "g": ("r", ["r"]), "u": ("?", None)}
    tagged = spark.createDataFrame([("f", "n", "b", 1), ("f", "n", "a", 2), ("f", "v", "c", 3)], "form string, tag string, lemma string, seq long")
    asked = spark.createDataFrame([("f", "n"), ("f", "v"), ("f", "x")], "form string, tag string")
    assert {r.tag: r.lemma for r in lexicon.lemmatize(asked, lexicon.form_tag_lemmas(tagged)).collect()} == {"n": "b", "v": "c", "x": "f"}


def test_folds_and_accuracies(spark):
    pick = random.Random(3)
    classes = [pick.choice("aabc") for _ in range(53)]
    rows = spark.createDataFrame(list(enumerate(classes)), "id long, y string")
    got = {r.id: r.fold for r in evaluation.stratified_folds(rows, 5, "y", "id").collect()}
    order = sorted(range(53), key=lambda i: (classes.index(classes[i]), i))
    for c in set(classes):
        allocation = [sum(classes[order[j]] == c and j % 5 == f for j in range(53)) for f in range(5)]
        want = [f for f in range(5) for _ in range(allocation[f])]
        assert [got[i] for i in range(53) if classes[i] == c] == want
    assert evaluation.without_fold(evaluation.stratified_folds(rows, 5, "y", "id"), 2).filter("fold = 2").count() == 0
    words = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, -100, 3)], "sent_id long, gold long, pred long")
    assert tuple(evaluation.word_accuracies(words).first()) == (200 / 3, 50.0)
    split = evaluation.group_split(spark.range(4000).withColumn("g", F.expr("id % 500")), "g", 0.9, 1)
    assert split.groupBy("g").agg(F.countDistinct("train").alias("n")).filter("n > 1").count() == 0 and 400 < split.filter("train").select("g").distinct().count() < 490
    assert evaluation.shuffled(rows, 1).count() == 53 and 5 < evaluation.sampled(spark.range(1000), 0.05, 1).count() < 150
    values = spark.createDataFrame([(pick.random(), k, 1) for k in range(200)], "score double, u long, c long")
    sums = evaluation.running_sums(values, "score", "u").orderBy("score").collect()
    assert all(b.u_before == a.u_before + a.u for a, b in zip(sums, sums[1:])) and sums[0].u_before == 0


def test_models(spark):
    rng = np.random.default_rng(0)
    dense = np.round(rng.random((12, 6)) * (rng.random((12, 6)) < 0.6), 3)
    cells = spark.createDataFrame([(i, j, f"w{i}", float(dense[i, j])) for i in range(12) for j in range(6) if dense[i, j]], "row_id long, col_id long, word string, ppmi double")
    u, s, _ = np.linalg.svd(dense)
    got = {r.word: np.array(r.vector) for r in models.type_vectors(cells, 3).collect()}
    mine = np.array([got[f"w{i}"] for i in range(12)])
    want = u[:, :3] * np.sqrt(s[:3])
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-6) and np.allclose(mine @ mine.T, want @ want.T, atol=1e-6)
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "word string, w long")
    assert {r.word: r.id for r in models.by_frequency(counts, "word", "w").collect()} == {"c": 0, "a": 1, "b": 2}
    points = [(i, "xy"[i % 2], [float(i % 2) + rng.normal(0, 0.1), rng.normal()]) for i in range(60)]
    rows = spark.createDataFrame(points, "id long, y string, features array<double>")
    for kind in ("forest", "perceptron"):
        out = models.out_of_fold(rows, 2, "y", "id", kind=kind).collect()
        assert len(out) == 60 and sum(r.pred == r.y for r in out) > 55
    pairs = spark.createDataFrame([(i // 3, int(i % 3 == 0), 1.0 * (i % 3 == 0) + rng.normal(0, 0.1), None) for i in range(60)], "g long, label int, a double, b double")
    best = alignment.best_candidates(models.rank(models.ranker(pairs, ["a", "b"], trees=5), pairs), ["g"], "score", "a").collect()
    assert sum(r.label for r in best) >= 19


def plain_tree(form, lemma, depth=-1):
    """The cheapest tree by trying all longest common substrings, and its cost."""
    best = None
    longest = max((n for n in range(1, len(form) + 1) if any(form[i : i + n] in lemma for i in range(len(form) - n + 1))), default=0) if depth else 0
    for i in range(len(form)) if longest else ():
        for j in range(len(lemma)):
            if i + longest <= len(form) and form[i : i + longest] == lemma[j : j + longest]:
                sides = [plain_tree(a, b, depth - 1) if a or b else (0, "", 0) for a, b in ((form[:i], lemma[:j]), (form[i + longest :], lemma[j + longest :]))]
                right = len(form) - i - longest
                cost, said = sides[0][0] + sides[1][0], "(" + (f"{i}{sides[0][1]} " if form[:i] or lemma[:j] else "") + (f" {right}{sides[1][1]}" if form[i + longest :] or lemma[j + longest :] else "") + ")"
                if best is None or cost < best[0]:
                    best = (cost, said, 0)
    return best or (len(form) + len(lemma), f"r({form}, {lemma})", 0)


def test_edit_trees_equal_plain_ones(spark):
    pick = random.Random(5)
    pairs = sorted({("".join(pick.choices("abc", k=pick.randint(1, 7))), "".join(pick.choices("abd", k=pick.randint(1, 7)))) for _ in range(150)})
    own = spark.createDataFrame(pairs, "form string, lemma string")
    for depth in (-1, 1, 0):
        assert {(r.form, r.lemma): r.tree for r in edit_trees.trees(own, depth).collect()} == {(f, le): plain_tree(f, le, depth)[1] for f, le in pairs}
    assert "\t" in edit_trees.tree_lines(edit_trees.trees(own)).first().line
    built = edit_trees.trees(own)
    got = {(r.form, r.tree): r.lemma for r in edit_trees.apply(own.select("form").distinct(), edit_trees.frequent(built, 1)).collect()}
    assert all(got[f, plain_tree(f, le)[1]] == le for f, le in pairs)
