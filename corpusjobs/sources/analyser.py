"""Output of a morphological analyser: blocks of lines to analyses, and analyses to a lexicon of tags."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.functions.betacode import from_beta, regular
from corpusjobs.functions.rules import assemble, condition, first_rule, last_rule, rewrite

# Dialects that are told, and those that only poetry has.
DIALECTS = ("aeolic", "attic", "boeotia", "doric", "epic", "ionic", "laconia", "late", "poetic")
POETIC, COMMON = "(doric|aeolic|homeric|poetic)", "(ionic|attic)"
# Classes of words and lemmas (in beta code) that make a part of speech, the first rule that holds.
POS_RULES = [
    {"any": ({"morphology": ("adverbial", "comp")}, {"lemma": ("pote/", "ma/", "o(/mws", "dio/per")}), "lemma_not": ("i(/na", "o(/ti", "i)dou/", "h(ni/ka", "eu)=ge", "nai/", "ou(=", "kaqo/ti"), "to": "adverb"},
    {"any": ({"wordclass": "indef"}, {"lemma": ("dei=na", "ou)dei/s", "mhdei/s", "poio/s", "poso/s", "e(/kastos", "e(ka/teros", "pa=s", "a(/pas", "e(/teros", "ou)de/teros", "mhde/teros", "a)/llos", "ou)/tis", "a)/mfw")}), "to": "indefinite"},
    {"lemma": "mh/tis", "wordclass": "pron_adj3", "to": "indefinite"},
    {"any": ({"wordclass": ("pron1", "pron3")}, {"lemma": ("a)llh/lwn", "e(autou=")}), "to": "personal"},
    {"any": ({"wordclass": ("art_adj", "demonstr")}, {"lemma": ("ou(=tos", "thliko/sde", "thlikou=tos", "toi=os", "to/sos", "thli/kos", "tau)to/s")}), "to": "demonstrative"},
    {"any": ({"wordclass": "relative"}, {"lemma": ("o(/sos", "oi(=os", "o(poi=os", "h(li/kos", "o(po/sos", "o(po/teros", "o(phli/kos")}), "to": "relative"},
    {"lemma": ("ti/s", "phli/kos", "poi=os", "po/sos", "po/teros"), "to": "interrogative"},
    {"any": ({"wordclass": "numeral"}, {"lemma": ("ei(=s", "te/ssares")}, {"lemma_like": ("ko/sioi$", "xi/lioi$", "mu/rioi$")}), "to": "numeral"},
    {"any": ({"wordclass": ("exclam", "expletive")}, {"lemma": ("i)de/", "nai/", "i)dou/", "eu)=ge")}), "to": "interjection"},
    {"lemma": ("kai/", "de/", "te", "a)lla/", "ou)de/", "mhde/", "mh/te", "ou)/te"), "to": "coordinator"},
    {"any": ({"wordclass": ("conj", "connect")}, {"lemma": ("i(/na", "o(/ti", "h(ni/ka", "ou(=", "kaqo/ti")}), "to": "conjunction"},
    {"any": ({"wordclass": "particle"}, {"lemma": ("a)=ra", "dh=ta", "h)=")}), "to": "particle"},
    {"wordclass": ("adverb", "interrog"), "to": "adverb"},
    {"wordclass": ("noun", "alphabetic", "irreg_decl3", "indecl", "indecl_noun"), "to": "noun"},
    {"wordclass": ("adj", "irreg_adj1", "irreg_adj3"), "to": "adjective"},
    {"wordclass": "verb", "morphology_like": "part", "to": "participle"},
    {"wordclass": "verb", "morphology_like": "inf", "to": "infinitive"},
    {"wordclass": "verb", "to": "verb"},
    {"wordclass": "article", "to": "article"},
    {"wordclass": "prep", "to": "preposition"},
]
NOMINAL = ("noun", "adjective", "article", "personal", "demonstrative", "relative", "indefinite", "interrogative", "numeral")
# Features by patterns of the morphology; of those of one feature the last that holds counts.
NUMBER = [{"morphology_like": "sg", "to": "sg"}, {"morphology_like": "pl$| pl\\s", "to": "pl"}, {"morphology_like": "dual", "to": "dual"}]
NON_FINITE_TENSE = [{"morphology_like": p, "to": t} for p, t in (("aor", "aor"), ("pres", "pres"), ("fut", "fut"), ("perf", "pf"))]
FINITE_TENSE = [{"morphology_like": p, "to": t} for p, t in (("^aor", "aor"), ("^pres", "pres"), ("^fut ", "fut"), ("^perf ", "pf"), ("^imperf", "impf"), ("^plup", "plupf"), ("^futperf", "futpf"))]
VOICE = [{"morphology_like": p, "to": t} for p, t in (("act", "act"), (" (mid|mp)", "mid"), ("pass", "pass"))]
MOOD = [{"morphology_like": p, "to": t} for p, t in (("ind", "ind"), ("subj", "subj"), ("opt", "opt"), ("imperat", "imp"))]
PERSON = [{"morphology_like": p, "to": p} for p in "123"]
GENDERS, CASES = ("masc", "fem", "neut"), ("nom", "voc", "acc", "gen", "dat")
BOTH_GENDERS = "(wn_on)|(hn_enos)|(ws_wn)|(is_idos)"
COMMON_GENDER = [
    {"pos": "personal", "lemma": ("e)gw/", "su/", "h(mei=s", "u(mei=s", "e(/", "sfei=s"), "to": "comm"},
    {"pos": "indefinite", "lemma": ("dei=na", "mh/tis", "ou/tis"), "to": "comm"},
    {"pos": "indefinite", "lemma": "tis", "neuter": "no", "to": "comm"},
    {"pos": "interrogative", "lemma": "ti/s", "neuter": "no", "to": "comm"},
]
# Further parts of speech of some forms and lemmas.
MORE_POS = [
    {"form": ("w(/sper", "w(/ste"), "to": "conjunction"}, {"form_like": ("^a\\)/nw$", "a/nw$", "^a\\(/ma$"), "to": "preposition"}, {"form": "mh/", "to": "adverb"},
    {"form": "w(s", "to": "preposition,adverb"}, {"lemma": ("h)/", "h)de/"), "to": "coordinator"},
]
ANALYSIS = "form string, lemma string, prefix string, augment string, stem string, stem_line string, ending string, end_line string, morphology string, infl string, dialects string"


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    """A row per analysis, in order (word_no, analysis_no), of files in which each word's block begins with :raw.

    What a line tells holds for the analyses of its word until another tells it anew.
    """

    @F.pandas_udf(f"array<struct<{ANALYSIS.replace(' string', ': string')}>>")
    def parse(blocks: pd.Series) -> pd.Series:
        return blocks.map(_analyses)

    rows = spark.read.option("lineSep", ":raw").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("word_no"), "value")
    return rows.filter(F.trim("value") != "").select("file", "word_no", F.posexplode(parse("value")).alias("analysis_no", "a")).select("file", "word_no", "analysis_no", "a.*")


def _analyses(block: str) -> list[dict]:
    lines = block.split("\n")
    now = dict.fromkeys(("lemma", "prefix", "augment", "stem", "stem_line"), "")
    now["form"] = lines[0].strip()
    out, told = [], set()
    for line in lines[1:]:
        told |= {d for d in DIALECTS if d in line}
        name, _, rest = line.partition(" ")
        value = rest.split("\t")[0]
        if name == ":lem":
            now["lemma"] = rest.strip()
        elif name in (":prvb", ":aug1"):
            now["prefix" if name == ":prvb" else "augment"] = value
        elif name == ":stem":
            now["stem"], now["stem_line"] = value.strip(), line
        elif name == ":end":
            cells = line.split("\t")
            out.append({**now, "ending": value, "end_line": line, "morphology": re.sub("^ +", "", cells[1]) if len(cells) > 1 else "", "infl": cells[-1], "dialects": ",".join(sorted(told))})
            told = set()
    return out


def read_accents(spark: SparkSession, path: str) -> DataFrame:
    """lemma, stem, accent of the lines with three columns."""
    cells = spark.read.text(path).select(F.split(F.trim("value"), "\t").alias("c")).filter(F.size("c") == 3)
    return cells.select(*(F.col("c")[k].alias(n) for k, n in enumerate(("lemma", "stem", "accent"))))


def read_stem_types(spark: SparkSession, path: str) -> DataFrame:
    """word, wordclass: the class of stem types, by the last line of each that tells one."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.split("value", " ").alias("c")).filter(F.size("c") == 3)
    word, kind = F.col("c")[0], F.col("c")[2]
    told = F.when(kind.startswith("noun"), "noun").when(kind.startswith("adj") & ~word.rlike("^irreg_adj[13]$") & (word != "art_adj"), "adj").when(kind.startswith("pp"), "verb")
    return rows.select(word.alias("word"), told.alias("wordclass"), "line_no").filter("wordclass is not null").groupBy("word").agg(F.max_by("wordclass", "line_no").alias("wordclass"))


def kept(analyses: DataFrame, poetic: bool = False) -> DataFrame:
    """Analyses that aren't left out: dialects of poetry alone (unless poetic), some forms without augment or degree.

    An ending of a common dialect counts though its stem is poetic; some stems in e, i and r keep theirs.
    """
    stem, end = F.col("stem_line"), F.col("end_line")
    rare = lambda c: c.rlike(POETIC) & ~c.rlike(COMMON)
    dialect = F.lit(False) if poetic else (rare(stem) | rare(end)) & ~(~rare(end) & end.rlike(COMMON))
    wrong = end.rlike("futperf.*(nom|voc|acc|gen|dat)") | end.rlike("adverbial (comp|superl)") | end.rlike("unaugmented")
    spared = F.col("stem").rlike("[ier]_?$") & (end.rlike("fem .* sg") | end.rlike("masc .* sg.*hs_ou$"))
    return analyses.filter(~(dialect | wrong) | spared)


def tagged(analyses: DataFrame, stem_types: DataFrame | None = None, lemma_rules: list[dict] = (), pos_rules: list[dict] = POS_RULES) -> DataFrame:
    """Analyses with beta forms made regular, lemma (by rule table, prefixes joined) and pos (by ordered rules)."""
    form = regular(F.col("form"))
    rows = analyses.withColumn("form", form).withColumn("lemma_told", F.regexp_replace("lemma", "-pl", ""))
    rows = rows.withColumn("lemma", assemble(rewrite(F.col("lemma"), F.col("form"), list(lemma_rules))))
    kind = F.substring_index("infl", ",", 1)
    rows = rows.withColumn("_w", kind)
    if stem_types is not None:
        rows = rows.join(F.broadcast(stem_types.withColumnRenamed("word", "_w")) if stem_types.count() < 100_000 else stem_types.withColumnRenamed("word", "_w"), "_w", "left")
        rows = rows.withColumn("wordclass", F.coalesce("wordclass", "_w"))
    else:
        rows = rows.withColumn("wordclass", F.col("_w"))
    columns = {c: F.col(c) for c in ("lemma", "morphology", "wordclass")}
    return rows.withColumn("pos", first_rule(list(pos_rules), columns, F.lit("unknown"))).drop("_w")


def _found(values: tuple[str, ...], column: str = "morphology") -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(column, F.lit(v)), F.lit(v)) for v in values)))


def lexicon(rows: DataFrame, accents: DataFrame | None = None) -> DataFrame:
    """form, XPOS, person, number, tense, mood, voice, gender, case, degree, lemma, dialects and, with accents, accent.

    Of tagged() analyses: nominals and participles stand for each of their genders and cases, particles for each of
    their parts of speech; different rows only, in Greek.
    """
    pos, morphology = F.col("pos"), F.col("morphology")
    names = {"morphology": morphology, "pos": pos, "lemma": F.col("lemma"), "form": F.col("form"), "neuter": F.when(morphology.rlike("neut"), "yes").otherwise("no")}
    nominal, participle, infinitive, verb = pos.isin(*NOMINAL), pos == "participle", pos == "infinitive", pos == "verb"
    inflected, verbal = nominal | participle, participle | infinitive | verb
    of = lambda rules, default: last_rule(rules, names, F.lit(default))
    common = F.lit(False)
    for rule in COMMON_GENDER:
        common = common | condition(rule, names)
    bare_numeral = (pos == "numeral") & (F.col("lemma") != "ei(=s") & ~F.col("lemma").rlike("(ko/sioi|xi/lioi|mu/rioi)$")
    none = lambda values, instead: F.when(F.size(values) == 0, instead).otherwise(values)
    both = F.array(*map(F.lit, ("fem", "masc", "neut")))
    several = F.when(F.col("end_line").rlike(BOTH_GENDERS) & nominal, both).when(F.col("lemma").isin("mhdei/s", "ou)dei/s"), F.array(F.lit("masc"), F.lit("neut"))).otherwise(F.array(F.lit("none")))
    genders = F.when(common, F.array(F.lit("comm"))).when(bare_numeral, F.array(F.lit("none"))).otherwise(none(_found(GENDERS), several))
    cases = none(_found(CASES), F.array(F.lit("none")))
    degree = last_rule([{"morphology_like": "superl", "to": "sup"}, {"morphology_like": "comp", "to": "comp"}], names, F.lit("pos"))
    degree = F.when(F.col("stem_line").contains("irreg_comp"), "comp").when(F.col("stem_line").contains("irreg_superl"), "sup").otherwise(degree)
    more = F.when(inflected | verbal, F.array(pos)).otherwise(F.array_distinct(F.concat(F.array(pos), F.filter(F.split(first_rule(MORE_POS, names, F.lit("")), ","), lambda x: x != ""))))
    rows = rows.withColumn("_degree", F.when((pos == "adjective") | (pos == "adverb"), degree)).withColumn("XPOS", F.explode(more))
    empty = F.array(F.lit("_"))
    rows = rows.withColumn("gender", F.explode(F.when(inflected, genders).otherwise(empty))).withColumn("case", F.explode(F.when(inflected, cases).otherwise(empty)))
    if accents is not None:
        own = accents.groupBy(F.col("lemma").alias("_l"), F.col("stem").alias("_s")).agg(F.max("accent").alias("_a"))
        rows = rows.withColumn("_k", F.translate("stem", "|", "i")).join(own, F.expr("lemma_told = _l and _k = _s"), "left").withColumn("accent", F.when(nominal, F.coalesce("_a", F.lit("NA"))).otherwise("NA"))
    number = F.when(nominal, last_rule([{"morphology_like": p, "to": p} for p in ("sg", "pl", "dual")], names, F.when(pos == "numeral", "none").otherwise("sg")))
    number = number.when(participle | verb, of(NUMBER, "none")).otherwise("_")
    tense = F.when(verb, of(FINITE_TENSE, "pres")).when(verbal, of(NON_FINITE_TENSE, "pres")).otherwise("_")
    greek = lambda c: F.replace(from_beta(c), F.lit("'"), F.lit("’"))
    return rows.select(
        greek(F.col("form")).alias("form"), "XPOS", F.when(verb, of(PERSON, "_")).otherwise("_").alias("person"), number.alias("number"), tense.alias("tense"),
        F.when(verb, of(MOOD, "ind")).otherwise("_").alias("mood"), F.when(verbal, of(VOICE, "act")).otherwise("_").alias("voice"), "gender", "case",
        F.when(F.col("XPOS").isin("adjective", "adverb"), F.coalesce("_degree", F.lit("pos"))).otherwise("_").alias("degree"),
        greek(F.col("lemma")).alias("lemma"), "dialects", *(["accent"] if accents is not None else []),
    ).distinct()
