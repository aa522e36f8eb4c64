"""Small cases with results worked out by hand."""

from pyspark.sql import functions as F

from corpusjobs.functions import tagset, text
from corpusjobs.operators import association, edit_trees, evaluation, pieces, treebank
from corpusjobs.sources import readers


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_folding_and_tokens(spark):
    assert one(spark, text.fold_punctuation(F.col("t")), t="a:b") == "a·b"
    assert one(spark, text.fold_punctuation(F.col("t")), t="a--b") == "a—b"
    for before, after in (("kài", "kái"), ("ábó", "ábo"), ("a͂bó", "a͂bo"), ("àbó", "ábó")):
        assert one(spark, text.fold_accents(F.col("t")), t=before) == after
    assert one(spark, text.tokens(F.col("t")), t="a, b.") == ["a", ",", "b", "."]
    assert one(spark, text.tokens(F.col("t")), t="a--b") == ["a", "b"]


def test_tags(spark):
    record = tagset.tag_record(F.col("t"))
    assert tuple(one(spark, record, t="v3saia---")) == ("verb", "3", "sg", "aor", "ind", "act", "_", "_", "_")
    assert tuple(one(spark, record, t="v-sppamn-")) == ("participle", "_", "sg", "pres", "_", "act", "masc", "nom", "_")
    assert tuple(one(spark, record, t="a-s---fa-")) == ("adjective", "_", "sg", "_", "_", "_", "fem", "acc", "pos")
    assert one(spark, tagset.record_tag(record), t="-") == "z--------"
    assert one(spark, tagset.record_tag(record), t="v-sppamn-") == "v-sppamn-"


def test_feats(spark):
    assert one(spark, text.feats_map(F.col("t")), t="A=b|C=d|A=x") == {"A": "b", "C": "d"}
    assert one(spark, text.feats_string(text.feats_map(F.col("t"))), t="_") == "_"


def test_contexts_and_ppmi(spark):
    rows = [(1, 1, 2, "dog", "noun", "SBJ"), (1, 2, 0, "run", "verb", "PRED"), (1, 3, 2, "to", "preposition", "AuxP"), (1, 4, 3, "house", "noun", "ADV")]
    own = spark.createDataFrame(rows, "sent_id long, tok_idx long, head_id long, lemma string, upos string, relation string")
    found = treebank.contexts(own)
    got = {(r.word, r.context) for r in found.collect()}
    assert got == {("dog", "H_run"), ("run", "C_dog"), ("run", "C_to"), ("run", "C_house"), ("to", "C_house"), ("to", "H_run"), ("house", "H_to"), ("house", "H_run")}
    parts = treebank.counts(found, own.select(F.col("lemma").alias("word")))
    value = {(r.word, r.context): round(r.ppmi, 4) for r in treebank.ppmi(*parts).collect()}
    assert value["dog", "H_run"] == 0.415 and value["run", "C_house"] == 1 and value["run", "C_dog"] == 2


def test_association(spark):
    own = spark.createDataFrame([(1, ["a", "b"], ["x", "y"]), (2, ["a"], ["x"]), (3, ["b"], ["y"])], "sent_no long, src array<string>, tgt array<string>")
    s = {(r.src, r.tgt): r for r in association.scores(association.pair_counts(own)).collect()}
    assert s["a", "x"].dice == 1 and s["a", "y"].rel_freq == 0.5
    assert round(s["a", "x"].pmi, 4) == 0.4387 and round(s["a", "x"].odds_ratio, 4) == 2.7081


def test_metrics_and_threshold(spark):
    pairs = lambda x: spark.createDataFrame([(0, a, b) for a, b in x], "sent long, src long, tgt long")
    r = evaluation.pair_metrics(pairs([(0, 0), (1, 2)]), pairs([(0, 0), (1, 1), (2, 3)])).first()
    assert (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4), round(r.aer, 4)) == (0.5, 0.3333, 0.4, 0.6)
    rows = spark.createDataFrame([(0.9, False, 1), (0.5, True, 0), (0.4, False, 1), (0.2, True, 0)], "score double, unaligned boolean, correct int")
    r = evaluation.threshold(rows).first()
    assert (r.threshold, r.accuracy) == (0.2, 0.5)


def test_folds(spark):
    own = spark.range(7)
    count = lambda df: [r["count"] for r in df.groupBy("fold").count().orderBy("fold").collect()]
    assert count(evaluation.contiguous_folds(own, 3, "id")) == [2, 2, 3]
    assert count(evaluation.plain_folds(own, 3, "id")) == [3, 2, 2]


def test_conllu_round_trip(spark, tmp_path):
    rows = [(1, 1, "A", "a", "noun", {"case": "nom"}), (1, 2, "b", "b", "verb", {}), (2, 1, "c", "c", "noun", {"number": "sg", "case": "gen"})]
    own = spark.createDataFrame(rows, "sent_id long, tok_idx long, form string, lemma string, upos string, feats map<string,string>")
    readers.write_conllu(own, str(tmp_path / "c"))
    back = readers.read_conll(spark, str(tmp_path / "c")).orderBy("sent_id", "tok_idx").collect()
    assert [(r.form, r.lemma, r.upos, r.feats) for r in back] == [(f, le, u, m) for _, _, f, le, u, m in rows]


def test_edit_trees(spark):
    pairs = [("ἔδοξεν", "δοκέω"), ("λύεις", "λύω"), ("ἄγεις", "ἄγω"), ("$a1b", "1b$"), ("x", "y"), ("dog", "dog"), ("abcxdef", "abcydef")]
    own = spark.createDataFrame(pairs, "form string, lemma string")
    built = edit_trees.trees(own)
    tree = {r.form: r.tree for r in built.collect()}
    assert tree["ἔδοξεν"] == "(1r(ἔ, )  3r(ξεν, κέω))" and tree["dog"] == "()" and tree["x"] == "r(x, y)" and tree["λύεις"] == tree["ἄγεις"]
    rules = edit_trees.frequent(built, 1)
    found = {(r.form, r.tree): r.lemma for r in edit_trees.apply(own.select("form"), rules).collect()}
    assert all(found[f, tree[f]] == le for f, le in pairs)
    assert ("λύεις", tree["ἔδοξεν"]) not in found
    new = spark.createDataFrame([("γράφεις",), ("εις",)], "form string")
    known = spark.createDataFrame([("γράφω", 2), ("γράφεις", 1), ("ω", 9)], "lemma string, n long")
    assert [tuple(r) for r in edit_trees.unknown_lemmas(new, rules, known).collect()] == [("γράφεις", "γράφω")]


def test_pieces_and_labels(spark):
    rows = [(1, i, w) for i, w in enumerate([None, 0, 1, 2, 2, None])]
    marked = pieces.mark(spark.createDataFrame(rows, "sent_id long, piece_idx long, word_idx long"))
    labels = spark.createDataFrame([(1, 0, "a"), (1, 1, "p"), (1, 2, "new")], "sent_id long, word_no long, label string")
    got = pieces.label(marked, labels, {"a": 1}, ignored="p").orderBy("piece_idx").collect()
    assert [r.word_no for r in got] == [None, 0, 1, 2, 2, None]
    assert [r.last_piece for r in got] == [False, True, True, False, True, False]
    assert [r.first_piece for r in got] == [False, True, True, True, False, False]
    assert [r.label_id for r in got] == [-100, 1, -100, -100, 0, -100]


def test_phrases_and_conjuncts(spark):
    own = spark.createDataFrame([(1, i, x) for i, x in enumerate("abab", 1)] + [(2, 1, "b"), (2, 2, "a")], "sent_id long, tok_idx long, lemma string")
    phrases = spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string")
    assert sorted(tuple(r) for r in pieces.join_phrases(own, phrases).collect()) == [(1, 1, "a_b"), (1, 3, "a_b"), (2, 1, "b_a")]
    tree = spark.createDataFrame([(1, 0, "PRED"), (2, 1, "OBJ"), (3, 2, "CO"), (4, 3, "CO"), (5, 4, "ATR")], "tok_idx long, head_id long, relation string").selectExpr("1L as sent_id", "*")
    got = {r.tok_idx: (r.first_conjunct, r.coordination_head) for r in pieces.conjunct_heads(tree).collect()}
    assert got == {1: (None, None), 2: (1, None), 3: (2, 1), 4: (2, 1), 5: (2, 1)}


def test_neighbours_in_blocks(spark):
    from corpusjobs.operators import neighbours

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0]), (6, None), (7, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (2, 1000):
        got = {(r.vec_id, r.rank): r.neighbour for r in neighbours.nearest(vectors, 3, block).collect()}
        assert got == {(1, 1): 2, (1, 2): 3, (1, 3): 7, (5, 1): 2, (5, 2): 3, (5, 3): 7, (2, 1): 1, (2, 2): 3, (2, 3): 7, (3, 1): 2, (3, 2): 1, (3, 3): 7, (7, 1): 3, (7, 2): 2, (7, 3): 1}


def test_halves_and_windows(spark):
    from corpusjobs.plans import registry

    sf = "/root/testdata/sf0.001"
    q = registry.queries()
    assert {r.half for r in q["unknown_words_crossfit"](spark, sf).select("half").distinct().collect()} == {0, 1}
    got = {(r.sent_id, r.tok_idx): r.context.split(" ") for r in q["token_windows"](spark, sf).collect()}
    assert max(map(len, got.values())) == 13 and all(len(c) - 2 <= 11 for c in got.values())


def test_feats_are_parsed_once_a_value(spark):
    cases = {"A=b|C=d|A=x": ({"A": "b", "C": "d"}, "A=b|C=d", "d"), "C=d=e|x|A=_": ({"C": "d=e", "A": "_"}, "C=d=e", "d=e"), "_": ({}, "_", "_"), "": ({}, "_", "_"), "C=|B=z": ({"C": "", "B": "z"}, "B=z|C=", ""), None: ({}, "_", "_")}
    rows = spark.createDataFrame([(k,) for k in cases] * 3, "t string")
    out = rows.select("t", text.feats_map(F.col("t")), text.feats_ordered(F.col("t")), text.feature(F.col("t"), "C"), text.feats_string(text.feats_map(F.col("t"))).alias("s"))
    assert all(tuple(r)[1:4] == cases[r["t"]] and r["s"] == cases[r["t"]][1] for r in out.collect())
    assert "transform" not in rows.select(text.feats_ordered(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_substrings_and_rules_by_brief_ways(spark):
    assert edit_trees._common("abab", "ab") == [(0, 0, 2), (2, 0, 2)] and edit_trees._common("Aab", "aab") == [(1, 1, 2)] and edit_trees._common("x", "y") == [] == edit_trees._common("", "")
    assert edit_trees._rule("abc", "abc", -1) == edit_trees._rule("x", "x", 1) != edit_trees._rule("abc", "abc", 0)
    assert edit_trees._rule("", "", -1)[0] == "r(, )"
    rules = spark.createDataFrame([edit_trees._rule(*p, -1) for p in (("x", "x"), ("runs", "run"))], edit_trees.TREE)
    out = edit_trees.apply(spark.createDataFrame([("cats",), ("s",)], "form string"), rules)
    assert sorted((r["form"], r["lemma"]) for r in out.collect()) == [("cats", "cat"), ("cats", "cats"), ("s", "s")]
    assert "BroadcastExchange" in out._jdf.queryExecution().executedPlan().toString()
