"""Joins, n-grams, grammar, evidence, row parsing and logs on small tables."""

import itertools

from conftest import SF
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import articles, check, evidence, grammar, ngrams, rows, similarity, suffixes
from textloom.plans import corpus, words
from textloom.streaming import choices


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[j - 1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def test_near_words_equal_brute_force(spark):
    words = sorted({"".join(w) for k in (2, 3, 4) for w in itertools.islice(itertools.product("aħbg", repeat=k), 0, 60, 3)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    expected = {(a, b, lev(a, b)) for a in words for b in words if lev(a, b) <= 2}
    assert {(r["query"], r["word"], r["distance"]) for r in similarity.near(df, df, 2).collect()} == expected


def test_near_words_query_reaches_two_edits(spark):
    df = words.QUERIES["join7_near_words_two_edits"](spark, SF)
    fit = lambda rows: {r.word for r in rows.collect() if len(r.word) <= 32 and any(c.isalpha() for c in r.word) and not set(r.word) & set("-' ")}
    expected = {(a, b, lev(a, b)) for a in fit(words.missing(spark, SF)) for b in fit(words.forms(spark, SF)) if lev(a, b) <= 2}
    got = [tuple(r) for r in df.select("query", "word", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == expected and any(d == 2 for _, _, d in got)


def test_near_anchors(spark):
    q, w = spark.createDataFrame([("mort",), ("xzq",)], "word string"), spark.createDataFrame([("mrot",), ("mrr",), ("mort",), ("xzqt",)], "word string")
    assert {(r["query"], r["anchor"]) for r in similarity.near_anchors(q, w).collect()} == {("mrt", "mrt"), ("xzq", "xzqt")}


LINES = ["Ħobż | NOUN | ħobż | ħobż", "</s>", "ta' | PRP | ta' | ta'", "il- | PRP | il- | il-", "</s>", "jien | PRON | jien | jien", "12 | NOUN | x | ", "nixtri | VERB | nixtri | nixtri", "ħobż | NOUN | ħobż | ħobż"]


def plain_tokens(lines):
    out, p1, p2 = [], None, None
    for n, line in enumerate(lines):
        t = (line or "").strip()
        if not t or t[0] in "#<":
            p1 = p2 = None
            continue
        s = t.split("|")[0].strip()
        if not s or any(c.isdigit() for c in s) or all(not c.isalnum() and c != "_" and not c.isspace() for c in s) or len(s) > 80:
            continue
        out.append((n, s, s.lower(), p1, p2))
        p2, p1 = p1, s.lower()
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from([*LINES, "", "# x", "?!", "a|X|a|"]), max_size=25), st.integers(1, 4))
def test_tokens_over_blocks_equal_a_plain_pass(spark, lines, block):
    df = spark.createDataFrame([("f", n, line) for n, line in enumerate(lines)] + [("f", n, line) for n, line in enumerate(lines) if n % 3 == 0], "file string, line_no long, line string")
    found = sorted((r.line_no, r.token, r.norm, r.p1, r.p2) for r in ngrams.tokens(df, block_lines=block).collect())
    assert found == plain_tokens(lines)


def test_scores(spark):
    uni = spark.createDataFrame([("ħobż", 10.0), ("dar", 9.0)], "w1 string, log_freq double")
    bi = spark.createDataFrame([("nixtri", "ħobż", 8.5)], "w1 string, w2 string, log_freq double")
    c = spark.createDataFrame([("ħobż", None, None, None), ("ħobż", "nixtri", None, None), ("xejn", None, None, None)], "word string, prev string, next string, prev_prev string")
    assert [r.bonus for r in ngrams.score(c, uni, bi).orderBy(F.desc("word"), "prev").collect()] == [0.0, 0.1, 0.1744] or {(r.word, r.prev): r.bonus for r in ngrams.score(c, uni, bi).collect()} == {("ħobż", None): 0.1, ("ħobż", "nixtri"): 0.1744, ("xejn", None): 0.0}
    assert {r.bonus for r in ngrams.score(c, uni, bi, shadow=True).collect()} == {0.0}


def test_index_round_trip(spark, tmp_path):
    toks = ngrams.tokens(spark.createDataFrame([("f", n, line) for n, line in enumerate(LINES)], "file string, line_no long, line string"))
    ngrams.export(ngrams.unigrams(toks, 1), ngrams.bigrams(toks, 1), ngrams.trigrams(toks, 1), str(tmp_path / "i"))
    status, uni, bi, tri = ngrams.load(spark, str(tmp_path / "i"))
    assert status == "READY" and uni.count() == 6 - 1 and bi.count() == 3 and tri.count() == 1
    assert ngrams.load(spark, str(tmp_path / "none"))[0] == "MISSING_INDEXES"


def test_evidence(spark):
    e = spark.createDataFrame([("mort", "anchor", "candidate", "medium", None, "", 0), ("Mort", "edit", "candidate", None, 0.9, "x", 1), ("mrot", "anchor", "candidate", "odd", None, None, 2), ("", "x", "", "exact", None, "", 3)], "word string, source string, candidate_type string, level string, confidence double, reason string, ord int")
    p = {r.word: r for r in evidence.pool(e).collect()}
    assert set(p) == {"mort", "mrot"} and p["mort"].confidence == 0.9 and p["mort"].sources == ["anchor", "edit"] and p["mrot"].confidence == 0.62
    c = {r.word: r for r in evidence.with_corpus(evidence.pool(e), spark.createDataFrame([("mort", 0.2)], "word string, bonus double")).collect()}
    assert c["mort"].confidence == 1.0 and "corpus" in c["mort"].sources and c["mrot"].corpus_score == 0.0


def test_grammar_rules(spark):
    texts = spark.createDataFrame([(1, "Rajna ħamra karozza."), (2, "Jien min Malta."), (3, "karozza aħmar tinsab barra."), (4, "ma nixtrix"), (5, None), (6, "ħames bozza"), (7, "")], "id long, t string")
    f = spark.createDataFrame([("karozza", True, False, False, "F", None), ("ħamra", False, True, False, None, "F"), ("aħmar", False, True, False, None, "M"), ("ħames", False, False, True, None, None), ("bozza", True, False, False, "F", None)], "word string, is_noun boolean, is_adjective boolean, is_numeral boolean, noun_gender string, adjective_gender string")
    anchors = spark.createDataFrame([("ħamra", "ħmr"), ("aħmar", "ħmr")], "word string, anchor string")
    found = grammar.analyze(grammar.tokenize(texts, "id", "t"), f, by_gender=grammar.adjective_variants(f.withColumn("adjective_number", F.lit(None).cast("string")), anchors))
    got = {(r.doc_id, r.rule_id): r for r in found.collect()}
    assert got[1, "AMOD_ORDER_NOUN_BEFORE_ADJ"].suggestion == "karozza ħamra"
    assert got[2, "MIN_MINN_CONTEXT"].suggestion == "minn"
    assert got[3, "AMOD_GENDER_AGREEMENT"].surface == "karozza aħmar" and got[3, "AMOD_GENDER_AGREEMENT"].suggestion == "karozza ħamra"
    assert (got[4, "NEGATION_MA_X"].start, got[4, "NEGATION_MA_X"].end) == (0, 2)
    assert got[6, "NUMERAL_NOUN_NUMBER"].suggestion == "plural_or_paucal"


def test_verb_rules_and_rewrite(spark):
    tokens = grammar.tokenize(spark.createDataFrame([(1, "hu mar nixtri u mar")], "id long, t string"), "id", "t")
    f = spark.createDataFrame([("mar", True, ["3SM"], True, False, None), ("nixtri", True, ["1S"], False, True, None)], "word string, is_verb boolean, persons array<string>, perf boolean, mperf boolean, person string")
    v = spark.createDataFrame([("nixtri", "3SM", "jixtri")], "word string, person string, variant string")
    found = grammar.analyze(tokens, f, v)
    assert {r.suggestion for r in found.where("rule_id = 'VERB_VERB_PERSON_NUMBER'").collect()} == {"mar jixtri"}
    assert [r.word for r in grammar.rewrite(tokens, found).orderBy("pos").collect()] == ["hu", "mar", "jixtri", "u", "mar"]


def test_grammar_queries_have_all_features(spark, tmp_path):
    verbs = [("marret", "T-mur-F1-PERF-3SF", "mur", "F1", "PERF", "3SF"), ("nixtri", "T-xtr-F8-MPERF-1S", "xtr", "F8", "MPERF", "1S"), ("jixtri", "T-xtr-F8-MPERF-3SM", "xtr", "F8", "MPERF", "3SM"), ("tixtri", "T-xtr-F8-MPERF-3SF", "xtr", "F8", "MPERF", "3SF"), ("dam", "T-dwm-F1-PERF-3SM", "dwm", "F1", "PERF", "3SM")]
    tables = {
        "verb_forms": spark.createDataFrame([(i, i, w, t, t[0], r, f, x, p, None) for i, (w, t, r, f, x, p) in enumerate(verbs)], "row_id long, line_number long, word string, raw_tag string, tag_prefix string, root string, form_class string, tense string, person string, stem_kind string"),
        "name_list": spark.createDataFrame([("karozza", "SINGNOUNF-car"), ("aħmar", "SINGADJM-red"), ("ħamra", "SINGADJF-red"), ("kotba", "PLUNOUN-books")], "surface string, payload string"),
        "corpus_lines": spark.createDataFrame([(1, "f", 1, "kbir | ADJ | kbir | kbr"), (2, "f", 2, "itwal | ADJ | itwal | twl")], "row_id long, file string, line_no long, line string"),
        "create_log": spark.createDataFrame([(1, "hu nixtri"), (2, "marret nixtri"), (3, "karozza aħmar"), (4, "tlieta kotba"), (5, "marret kbir"), (6, "nixtri kbir"), (7, "dam itwal"), (8, "dam kbir"), (9, None)], "row_id long, input string"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = {(r.doc_id, r.rule_id): r.suggestion for r in corpus.QUERIES["win_findings"](spark, str(tmp_path)).collect()}
    assert found == {
        (1, "SUBJECT_VERB_PERSON_NUMBER"): "hu jixtri",
        (1, "HU_U_HU_CONFUSABLE"): "hu",
        (2, "VERB_VERB_PERSON_NUMBER"): "marret tixtri",
        (3, "AMOD_GENDER_AGREEMENT"): "karozza ħamra",
        (4, "NUMERAL_NOUN_NUMBER"): "plural_or_paucal",
        (6, "VERB_ADJECTIVE_COMPATIBILITY"): "nixtri u jsir kbir",
        (8, "VERB_ADJECTIVE_COMPATIBILITY"): "dam u jsir kbir",
    }
    texts = {(r.doc_id, r.pos): r.word for r in corpus.QUERIES["win13_rewritten"](spark, str(tmp_path)).collect()}
    assert texts[2, 1] == "tixtri" and texts[1, 1] == "nixtri" and texts[3, 1] == "aħmar"


def test_spans_that_overlap_only_a_dropped_one_count(spark):
    tokens = spark.createDataFrame([(d, i, w) for d in (1, 2) for i, w in enumerate("abcde")], "doc_id long, pos int, word string")
    found = spark.createDataFrame([(1, "VERB_VERB_PERSON_NUMBER", 0, 2, "B A"), (1, "VERB_VERB_PERSON_NUMBER", 1, 3, "C B"), (1, "VERB_VERB_PERSON_NUMBER", 2, 4, "D C")], "doc_id long, rule_id string, start int, end int, suggestion string")
    got = {d: [r.word for r in grammar.rewrite(tokens, found).where(f"doc_id = {d}").orderBy("pos").collect()] for d in (1, 2)}
    assert got == {1: ["B", "A", "D", "C", "e"], 2: list("abcde")}
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate(["ta", "l", "fil", "dar"])], "doc_id long, pos int, word string")
    targets = spark.createDataFrame([("fil",), ("dar",)], "word string")
    assert [(r.pos, r.used) for r in articles.phrases(words, targets).orderBy("pos").collect()] == [(0, 3)]
    assert grammar.rewrite(tokens, found.limit(0)).count() == 10


def test_suffix_conditions(spark):
    from textloom.operators import suffixes

    assert len(suffixes.SUFFIXES) == 40 and len({r[0] for r in suffixes.SUFFIXES}) == 40
    rows = [("kiteb", "PERF", "3SM", "ktb", "F1_NORMAL", "", False, False), ("nisraq", "MPERF", "1S", "srq", "F1_MEDIAL_LIQUID_OR_GUTTURAL", "", False, False), ("ħalla", "PERF", "3SM", "ħlj", "FINAL_WEAK", "", True, False), ("nesejna", "PERF", "1P", "nsj", "FINAL_WEAK", "", True, False), ("ħa", "PERF", "3SM", "'ħd", "OTHER", "", False, False), ("nkiteb", "PERF", "3SM", "ktb", "OTHER", "", False, True), ("insa", "IMP", "2S", "nsj", "FINAL_WEAK", "", True, False)]
    records = spark.createDataFrame([(w, w, *r) for w, *r in rows], "word string, raw_tag string, tense string, person string, root string, root_class string, stem_kind string, final_weak boolean, object_blocked boolean")
    made = {}
    for r in suffixes.generate(records).collect():
        made.setdefault((r.word, r.label), set()).add(r.surface)
    assert made["kiteb", "DO_1S"] == {"kitebni", "kitibni"} and made["kiteb", "DO_3SM"] == {"kitebu", "kitbu"} and "kitbilhom" in made["kiteb", "IDO_3P"] and "kitbilhom" not in made["kiteb", "DO_3P"]
    assert "nisirqu" in made["nisraq", "DO_3SM"] and "nisirqilhom" in made["nisraq", "IDO_3P"] and "nisirqlu" in made["nisraq", "IDO_3SM"]
    assert "ħalliek" in made["ħalla", "DO_2S"] and made["nesejna", "DO_3P"] == {"nesejniehom"} and made["ħa", "DO_3P"] == {"ħadhom"}
    assert ("nkiteb", "DO_1S") not in made and made["nkiteb", "IDO_1S"] and made["insa", "DO_3P"] >= {"insihom", "nsihom", "insgħuhom"}
    assert suffixes.generate(records.limit(0)).count() == 0


def test_records_by_anchors_of_guesses_and_near_ones(spark):
    records = spark.createDataFrame([("kiteb", "T-ktb", False, "ktb"), ("qata", "T-qt", False, "qt")], "word string, raw_tag string, object_blocked boolean, anchor string")
    typed = spark.createDataFrame([("kidibhom",), ("qatagħhom",), ("kitibhom",)], "word string")
    got = {(r.word, r.r_word, r.via) for r in suffixes.records_for(suffixes.parses(typed), records).where("ending = 'hom'").collect()}
    assert got == {("kidibhom", "kiteb", 3), ("qatagħhom", "qata", 2), ("kitibhom", "kiteb", 1)}
    best = {(r.word, r.surface) for r in suffixes.suggestions(suffixes.parses(typed), records).collect()}
    assert {("kidibhom", "kitibhom"), ("qatagħhom", "qatahom")} <= best


def test_every_person_is_asked_for(spark):
    got = words.QUERIES["join5_all_persons"](spark, SF)
    one = words.QUERIES["join5_person_variants"](spark, SF)
    assert {r.person for r in got.collect()} == set(words.PERSONS) and one.exceptAll(got).count() == 0
    assert got.groupBy("word", "person").count().where("count > 1").count() == 0


def test_rows_are_split_with_their_reason(spark):
    v = [('1,a,T-ktb-F1-PERF-3SM,"to ""x"""', None), ("", "columns"), ("   ", "columns"), (None, "columns"), ('1,a"b,c,d', "quoting"), ("0,a,T-ktb-F1-PERF-3SM,", "value"), ("1,,T-ktb-F1-PERF-3SM,x", "value"), (",,,", "value"), ("1,a,AS-ktb-PERF-3SM-N,", None), ("1,a,AS-k1b-PERF-3SM,", "value"), ('1,"a",T-ktb-F11-PERF-3SM,', "value"), ("1234567890,a,T-ktb-F1-PERF-3SM,x", "value")]
    df = spark.createDataFrame([(i, x, "own") for i, (x, _) in enumerate(v)], "row_id long, line string, word string")
    good, bad = rows.load_verb_raw(df)
    assert {r.row_id: r.reason for r in bad.collect()} == {i: w for i, (_, w) in enumerate(v) if w}
    assert {r.row_id: (r.gloss, r.word) for r in good.collect()} == {0: ('to "x"', "a"), 8: ("", "a")}
    c = [("a | NOUN | b | ", None), ("# x", None), ("<s>", None), (" ", None), (None, None), ("a|b", "columns"), ("a1 | NOUN | a | ", "value"), ("... | NOUN | a |", "value"), ("a | noun | a | r", "value"), ("a | NOUN |  | r", "value"), ("WWW.a.b | X_ENG | a | ", "value")]
    good, bad = rows.load_corpus_lines(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(c)], "row_id long, line string"))
    assert {r.row_id: r.reason for r in bad.collect()} == {i: w for i, (_, w) in enumerate(c) if w}
    assert [(r.row_id, r.surface, r.root) for r in good.collect()] == [(0, "a", None)]
    m = [('{"stats": {"malformed_rows": 3}}', None), ('{"stats": {"malformed_rows": 3,}}', "quoting"), ("{'stats': 1}", "quoting"), (None, "quoting"), ('{"stats": []}', "columns"), ("[1]", "columns"), ('{"stats": {}}', "columns"), ('{"stats": {"malformed_rows": null}}', "value"), ('{"stats": {"malformed_rows": true}}', "value"), ('{"stats": {"malformed_rows": 3.0}}', "value"), ('{"stats": {"malformed_rows": -1}}', "value"), ('{"stats": {"malformed_rows": NaN}}', "quoting"), ("[" * 100_000, "quoting"), ('{"stats": {"malformed_rows": ' + "9" * 30 + "}}", None)]
    good, bad = rows.load_corpus_meta(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(m)], "row_id long, meta_json string"))
    assert {r.row_id: r.reason for r in bad.collect()} == {i: w for i, (_, w) in enumerate(m) if w}
    assert {r.row_id: r.malformed_rows for r in good.collect()} == {0: 3, 13: None}
    empty = rows.found(df.limit(0), spark.createDataFrame([], "row_id long, line string"), spark.createDataFrame([], "row_id long, meta_json string"))
    assert empty.count() == 0


LOG = "row_id long, log_id string, received_at timestamp, input string, final_output string"
EVENT = "row_id long, log_id string, event_id string, received_at timestamp, token string, chosen string, final_output string"


def test_logs_fold_in_any_order(spark):
    logs = spark.createDataFrame([(1, "a", "t", "o")], "row_id long, log_id string, input string, final_output string").withColumn("received_at", F.timestamp_seconds(F.lit(50)))
    logs = logs.unionByName(logs.withColumn("row_id", F.lit(2).cast("long")).withColumn("input", F.lit("later")).withColumn("received_at", F.timestamp_seconds(F.lit(60))))
    events = spark.createDataFrame([(1, "a", "e1", 10, "x", "y", "first"), (2, "a", "e1", 11, "x", "z", "again"), (3, "a", "e2", 30, "w", "v", None), (4, "b", "e3", 5, None, None, "lone")], "row_id long, log_id string, event_id string, s long, token string, chosen string, final_output string").withColumn("received_at", F.timestamp_seconds("s"))
    got = {r.log_id: r for r in choices.folded(logs, events).collect()}
    assert (got["a"].input, got["a"].final_output, got["a"].chosen_notes, got["a"].n_events, got["a"].placeholder) == ("t", "first", "x -> y\nw -> v", 2, False)
    assert (got["b"].final_output, got["b"].placeholder) == ("lone", True)
    assert choices.folded(logs.limit(0), events.limit(0)).count() == 0
    assert choices.created(logs.where("row_id = 1"), logs).count() == 0


def test_stream_drops_repeated_events(spark, tmp_path):
    src = tmp_path / "in"
    rows_ = [(1, "a", "e1", "x"), (2, "a", "e1", "x"), (3, "a", "e2", "=y")]
    df = spark.createDataFrame(rows_, "row_id long, log_id string, event_id string, token string").withColumn("received_at", F.timestamp_seconds(F.lit(100)))
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    query = choices.stream_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.event_id, r.token) for r in out.collect()) == [("e1", "x"), ("e2", "'=y")]


def test_feedback(spark):
    base = dict(email="a@b.c", subject="s", message="m", screenshot_data_url="")
    cases = [({}, None), ({"email": "x"}, "email"), ({"email": None}, "email"), ({"subject": " "}, "subject"), ({"message": "m" * 10_001}, "message"), ({"screenshot_data_url": "data:text/x"}, "screenshot"), ({"screenshot_data_url": "data:image/png;base64," + "A" * 2_900_000}, "screenshot_too_large")]
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], "email string, subject string, message string, screenshot_data_url string")
    assert [r.error for r in choices.checked_feedback(df).collect()] == [e for _, e in cases]


def test_check_corrects_texts(spark):
    docs = spark.createDataFrame([(1, "Laham, il-gobon!"), (2, None), (3, "laħam")], "id long, t string")
    lexicon = spark.createDataFrame([("laħam",), ("il-ġobon",)], "word string")
    got = {r.id: r for r in check.check(docs, lexicon, "id", "t").collect()}
    assert got[1].corrected_text == "Laħam, il-ġobon!" and got[1].changed and got[2].corrected_text == "" and not got[3].changed
    assert [r.word for r in check.suggest(spark.createDataFrame([("laham",)], "word string"), lexicon).collect()] == ["laħam"]
