"""Readers and writers, round trips and small files."""

import pytest
from pyspark.sql import functions as F

from corpusjobs.functions import betacode, rules
from corpusjobs.sources import analyser, readers, writers


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def said(path):
    return sorted(line for f in __import__("pathlib").Path(path).glob("part-*") for line in f.read_text().splitlines())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_conll(spark, tmp_path, end):
    text = end.join(["# id = 1", "1\tA\ta\tNOUN\tn\tCase=Nom,Acc|Number=Sg\t2\tSBJ\t_\t_", "2\tb\tb\tVERB\tv\t_\t0\tPRED\t_\t_", "", "# id = 2", "1\tc\tc\tX\tx\tA=b|A=c\t0\tPRED\t_\t_", " ", "1\td\td\tX\tx\t_\t0\tPRED\t_\t_", ""])
    path = put(tmp_path, "c.conllu", text)
    rows = readers.read_conll(spark, path).orderBy("sent_id", "tok_idx").collect()
    assert [(r.tok_idx, r.form, r.misc) for r in rows] == [(1, "A", "_"), (2, "b", "_"), (1, "c", "_"), (1, "d", "_")]
    assert rows[0].feats == {"Case": "Acc,Nom", "Number": "Sg"} and rows[2].feats == {"A": "b"}
    assert len({r.sent_id for r in rows}) == 3
    simple = put(tmp_path, "s", end.join(["# x\ty\tz", "1\tA\tm"]))
    assert [r.form for r in readers.read_conll(spark, simple, "simple").collect()] == ["y", "A"]
    assert [r.w for r in readers.read_conll(spark, simple, {"W": 2}).collect()] == ["z", "m"]


def test_treebanks(spark, tmp_path):
    text = "# a = 1\n# a = 2\n# text = no\n1\tE\tE\t_\tx\tCase=Nom\t2\tSBJ\t_\t_\n2\tb\tb\tVERB\t_\t_\t0\tPRED\t_\t_\n"
    rows = readers.read_treebank(spark, put(tmp_path, "t", text)).orderBy("tok_idx").collect()
    assert rows[0].attributes == {"a": "2"} and [r.artificial for r in rows] == [True, False] and [r.pos for r in rows] == ["x", "VERB"]
    xml = '<treebank><sentence id="s1"><word id="1" form="a" lemma="a" postag="n" head="0" relation="PRED" artificial="x"/><word id="2" form="no"/></sentence></treebank>'
    rows = readers.read_treebank_xml(spark, put(tmp_path, "t.xml", xml)).collect()
    assert [(r.sentence_id, r.form, r.artificial) for r in rows] == [("s1", "a", True)]


def test_lexicons_and_tables(spark, tmp_path):
    path = put(tmp_path, "l", "form\tXPOS\tcase\nà\tn\tnom\nà\tn\tnom\nb\tv\t\n")
    assert {tuple(r) for r in readers.read_tag_lexicon(spark, path, "NFD").collect()} == {("à", "n", "nom"), ("b", "v", "_")}
    assert {tuple(r) for r in readers.read_tag_lexicon(spark, path, "greek").select("form").collect()} == {("á",), ("b",)}
    assert {tuple(r) for r in readers.read_possible_tags(spark, path, ["case", "XPOS", "voice"]).collect()} == {("nom", "n", "_"), ("_", "v", "_")}
    path = put(tmp_path, "m", "form\tlemma\tXPOS\na\tx\tn\na\ty\tn\n")
    assert [tuple(r) for r in readers.read_lemma_lexicon(spark, path).select("form", "lemmas").collect()] == [("a", ["x", "y"])]
    assert [r.form for r in readers.read_class_table(spark, path, ["form"], "NFC").collect()] == ["a", "a"]
    assert [(r.key, r.vector) for r in readers.read_vectors(spark, put(tmp_path, "v", "2\tx\na\t1.0\t2.0\n"), True).collect()] == [("a", [1.0, 2.0])]
    assert {tuple(r) for r in readers.read_gazetteer(spark, put(tmp_path, "g", "a\tx\nb\ty\n"), "class").collect()} == {("a", "x"), ("b", "y")}


def test_parallel_and_raw(spark, tmp_path):
    path = put(tmp_path, "p", "a b\tx y\t{0: [1], 1:[0, 1]}\nc\tz\nd\tw v\t{0:[0]}\n")
    side = put(tmp_path, "q", "A B\nC\nD\nE\n")
    rows = readers.read_parallel(spark, path, lemmas=side).orderBy("sent_no").collect()
    assert [(r.sent_no, r.src, r.tgt, r.gold, r.lemmas) for r in rows] == [(0, ["a", "b"], ["x", "y"], {0: [1], 1: [0, 1]}, ["A", "B"]), (2, ["d"], ["w", "v"], {0: [0]}, ["D"])]
    assert {tuple(r) for r in readers.read_translations(spark, put(tmp_path, "t", "é\tA b|c\n")).collect()} == {("é", "a_b"), ("é", "c")}
    assert {tuple(r) for r in readers.read_translations(spark, put(tmp_path, "w", "é\tA=3|b=1\n"), True).collect()} == {("é", "A"), ("é", "b")}
    rows = readers.read_raw(spark, put(tmp_path, "r", "One two. Three? Four\n\nFive!\n")).orderBy("doc_id", "sent_no", "tok_idx").collect()
    assert [(r.doc_id, r.sent_no, r.tok_idx, r.form) for r in rows] == [(0, 0, 1, "One"), (0, 0, 2, "two"), (0, 0, 3, "."), (0, 1, 1, "Three?"), (0, 1, 2, "Four"), (2, 0, 1, "Five!")]
    assert [r.form for r in readers.read_raw(spark, put(tmp_path, "r2", "α; β"), True).filter("sent_no = 1").collect()] == ["β"]


def test_writers(spark, tmp_path):
    tag = lambda a, b: (a, b)
    rows = spark.createDataFrame([(1, 1, "A", 0.5, 2, True, tag("n", "nom"), tag("v", "_")), (1, 2, "b", 1.0, None, False, tag("v", "_"), tag("v", "_"))], "sent_id long, tok_idx long, form string, p double, num_poss long, in_lexicon boolean, tag struct<XPOS: string, case: string>, gold struct<XPOS: string, case: string>")
    lines = writers.tagged_lines(rows, ["XPOS", "case"], True, True)
    assert [r.line for r in lines.orderBy("tok_idx").collect()] == ["1\tA\t0.50000\t2\ttrue\tn\tnom\tv\t_\t[A] b", "2\tb\t1.00000\tNA\tfalse\tv\t_\tv\t_\tA [b]"]
    writers.write_lines(lines, f"{tmp_path}/t", "sent_id", "tok_idx", header="id\ttoken\tp\tn\tin\tXPOS\tcase\tgold\tgold_case\tsentence")
    assert [r.token for r in readers.read_tsv(spark, f"{tmp_path}/t").collect()] == ["A", "b"]
    writers.write_sentences(lines, f"{tmp_path}/s")
    assert len(said(f"{tmp_path}/s")) == 3
    writers.write_tagged_conllu(rows, ["XPOS", "case"], f"{tmp_path}/c")
    assert [r.feats for r in readers.read_conll(spark, f"{tmp_path}/c").orderBy("tok_idx").collect()] == [{"XPOS": "n", "case": "nom"}, {"XPOS": "v"}]
    classes = spark.createDataFrame([(1, 1, "A", "x", {"x": 0.9, "y": 0.1}), (1, 2, "b", "O", {"x": 0.2, "y": 0.8})], "sent_id long, tok_idx long, form string, label string, probs map<string,double>")
    told = lambda style: [r.line for r in writers.class_lines(classes, style, "O").orderBy("tok_idx").collect()]
    assert told("table") == ["1\tA\tx\tx\t0.90000"] and told("simple") == ["1\tA\tx", "2\tb\t_"] and told("CONLLU")[0].count("\t") == 9
    lemmas = spark.createDataFrame([(1, 1, "A", "a", ["b", "a"]), (1, 2, "c", None, None)], "sent_id long, tok_idx long, form string, lemma string, possibilities array<string>")
    assert [r.line for r in writers.lemma_lines(lemmas).orderBy("tok_idx").collect()] == ["1\tA\ta\t2\ta|b", "2\tc\t_\t0\t"]
    entries = spark.createDataFrame([("A", "a", "n", "nom"), ("A", "a", "n", "nom")], "form string, lemma string, XPOS string, case string")
    assert [r.line for r in writers.lexicon_lines(entries, ["case"]).collect()] == ["A\ta\tn\tnom"]
    assert [r.line for r in writers.lexicon_lines(entries, ["case"], True).collect()] == ["1\tA\ta\t_\tn\tcase=nom\t_\t_\t_\t_"]
    vectors = spark.createDataFrame([(7, "A", "x", [0.5, -0.25])], "vec_id long, form string, label string, vector array<double>")
    writers.write_lines(writers.vector_lines(vectors, 3), f"{tmp_path}/v")
    assert said(f"{tmp_path}/v") == ["7\tA\tx\t0.500\t-0.250"]
    writers.write_word_list(rows, f"{tmp_path}/w")
    assert said(f"{tmp_path}/w") == ["A", "b"]
    counts = spark.createDataFrame([("a", "x", 2, 3, 2, 9), ("a", "y", 1, 3, 4, 9)], "src string, tgt string, n long, s long, t long, total long")
    writers.write_counts(counts, f"{tmp_path}/n")
    assert sorted(map(tuple, writers.read_counts(spark, f"{tmp_path}/n").select(*counts.columns).collect())) == sorted(map(tuple, counts.collect()))
    tags = spark.createDataFrame([(1, 1, "A", 0.5, [("case", "nom"), ("upos", "n")])], "sent_id long, tok_idx long, form string, p double, tag array<struct<feat: string, val: string>>")
    assert tuple(writers.tag_table(tags, ["upos", "voice", "case"]).first())[4:] == ("n", "_", "nom")


def test_beta_code(spark):
    words = ["Ἀθηναῖος", "ᾧ", "ΐ", "λόγος", "Ἕλλην", "σῶς", "ἀλλ’"]
    own = spark.createDataFrame([(w,) for w in words], "w string").select("w", betacode.to_beta(F.col("w")).alias("b")).collect()
    assert [r.b for r in own] == ["*)aqhnai=os", "w(=|", "i+/", "lo/gos", "*(/ellhn", "sw=s", "a)ll’"]
    back = spark.createDataFrame([(r.b,) for r in own] + [("i/+",)], "b string").select(betacode.from_beta(F.col("b")).alias("g")).collect()
    import unicodedata

    assert [unicodedata.normalize("NFC", r.g) for r in back] == [*words, "ΐ"]
    forms = spark.createDataFrame([("",), ("...",), ("λό-",), ("·",), ("ἄνθρωπός",), ("κἀώ",), ("⏑α",)], "form string")
    assert sorted(r.beta for r in betacode.word_list(forms).collect())[0] == "a)/nqrwpos"


def test_rules(spark):
    lemmas = {"sun,a)na-ba/llw": "sunanaba/llw", "kata-i(/sthmi": "kaqi/sthmi", "e)n-ba/llw": "e)mba/llw", "sun-le/gw": "sulle/gw", "a)po-ai)te/w": "a)paite/w", "lu/w": "lu/w", "peri-ri/ptw": "perirri/ptw", "e)k-a)/gw": "e)ca/gw", "dia-kei=mai": "dia/keimai"}
    own = spark.createDataFrame([(k,) for k in lemmas], "l string").select("l", rules.assemble(F.col("l")).alias("x"))
    assert {r.l: r.x for r in own.collect()} == lemmas
    table = [{"lemma": "a", "form_like": "^x", "to": "b"}, {"lemma_like": ("c$", "d$"), "to": "e"}, {"lemma": "a", "to": "f"}]
    rows = spark.createDataFrame([("a1", "xy"), ("a-pl", "y"), ("bc", ""), ("z", "")], "l string, f string")
    assert [r.x for r in rows.select(rules.rewrite(F.col("l"), F.col("f"), table).alias("x")).collect()] == ["b", "f", "e", "z"]
    assert [r.x for r in rows.select(rules.last_rule(table, {"lemma": F.col("l"), "form": F.col("f")}, F.lit("-")).alias("x")).collect()] == ["-", "-", "e", "-"]


def test_analyser(spark, tmp_path):
    text = """:raw lo/gos

:workw lo/gos
:lem lo/gos
:prvb 
:aug1 
:stem log\tmasc\tos_ou
:end os\t masc nom sg\tattic\tos_ou

:raw kala/
:lem kalo/s
:stem kal\t\tos_h_on
:end a/\t neut nom/voc/acc pl\t\tos_h_on,adj
:lem kalo/s
:stem kal\tdoric\tos_h_on
:end a/\t fem nom/voc sg\tdoric\tos_h_on

:raw lu/ein
:lem lu/w
:stem lu_\t\tw_stem
:end ein\t pres inf act\tattic epic\tverb

:raw w(s
:lem w(s
:stem w(s\t\tindecl
:end \t indeclform\tlate\tconj
"""
    found = analyser.read_analyses(spark, put(tmp_path, "m", text))
    rows = found.orderBy("word_no", "analysis_no").collect()
    assert [(r.form, r.lemma, r.stem, r.infl, r.dialects) for r in rows] == [("lo/gos", "lo/gos", "log", "os_ou", "attic"), ("kala/", "kalo/s", "kal", "os_h_on,adj", ""), ("kala/", "kalo/s", "kal", "os_h_on", "doric"), ("lu/ein", "lu/w", "lu_", "verb", "attic,epic"), ("w(s", "w(s", "w(s", "conj", "late")]
    assert analyser.kept(found).count() == 4 and analyser.kept(found, poetic=True).count() == 5
    types = analyser.read_stem_types(spark, put(tmp_path, "s", "os_ou x noun_decl2\nos_h_on x adj1\nos_h_on x adj2\nzz x pp4\nbad line\n"))
    accents = analyser.read_accents(spark, put(tmp_path, "a", "lo/gos\tlog\trecessive\nshort\tline\n"))
    lexicon = {tuple(r) for r in analyser.lexicon(analyser.tagged(analyser.kept(found), types), accents).select("form", "XPOS", "number", "tense", "voice", "gender", "case", "degree", "accent").collect()}
    import unicodedata

    nfd = lambda w: unicodedata.normalize("NFD", w)
    assert lexicon == {
        (nfd("λόγος"), "noun", "sg", "_", "_", "masc", "nom", "_", "recessive"),
        *((nfd("καλά"), "adjective", "pl", "_", "_", "neut", c, "pos", "NA") for c in ("nom", "voc", "acc")),
        (nfd("λύειν"), "infinitive", "_", "pres", "act", "_", "_", "_", "NA"),
        *((nfd("ὡς"), p, "_", "_", "_", "_", "_", "pos" if p == "adverb" else "_", "NA") for p in ("conjunction", "preposition", "adverb")),
    }
