"""Operators of the subpackage against brute force, exact round trips, held-out accuracy and stated cases."""

import datetime
import random
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.session import table
from textloom.llm import canonical, encoding, language, packing, personal, queries, spans, tokens, truncation

DOC = "doc_id long, text string"


# 7. Tokens


def test_stitched_chunks_give_the_ids_of_the_whole(spark):
    random.seed(2)
    pieces = ["hello world ", "  \n\n x", "don't ", "ħobż ", "x" * 90, " 12345 ", "   ", "…", "日本語", "\t"]
    texts = ["".join(random.choice(pieces) for _ in range(n)) for n in (0, 1, 5, 40, 200, 700)] + [None, "", " ", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("ids", F.lit("clash"))
    e = tokens.encoder(tokens.default_vocabulary())
    got = {r.doc_id: r.ids for r in tokens.token_ids(df, chunk=100, overlap=20).collect()}
    assert got == {i: e.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df, chunk=100, overlap=20).collect()} == {i: len(x) for i, x in got.items()}
    assert all(tokens.decode(tokens.default_vocabulary(), got[i]) == (t or "") for i, t in enumerate(texts))
    assert tokens.token_ids(df.limit(0)).count() == 0


# 8. Packing


def best_fit_decreasing(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, left in enumerate(bins) if left >= s]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 30))
def test_plan_equals_item_by_item(sizes, capacity):
    sizes = [s for s in sizes if s <= capacity]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    ranges, n = packing.plan(histogram, capacity)
    left = [capacity] * n
    taken = set()
    by_size = {s: sorted(r for r in ranges if r[0] == s) for s in histogram}
    for s, rs in by_size.items():
        for rank in range(histogram[s]):
            size, low, first, each, items = max(r for r in rs if r[1] <= rank)
            bin_, position = first + (rank - low) // each, items + (rank - low) % each
            assert (bin_, position) not in taken
            taken.add((bin_, position))
            left[bin_] -= s
    assert min(left, default=0) >= 0
    assert sorted(left) == best_fit_decreasing(sizes, capacity)


def test_pack_places_every_piece_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 7)
    random.seed(1)
    sizes = [(i, random.choice([0, None, 3, 3, 3, 9, 10, 25])) for i in range(200)]
    caps = spark.createDataFrame([("a", 10), ("b", 7), ("c", None), ("d", 0)], "capacity_name string, capacity_tokens int")
    out = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), caps).collect()
    for name, capacity in (("a", 10), ("b", 7)):
        rows = [r for r in out if r.capacity_name == name]
        assert len({(r.container, r.position) for r in rows}) == len(rows)
        per, total = {}, {}
        for r in rows:
            per[r.container] = per.get(r.container, 0) + r.n_tokens
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert max(per.values()) <= capacity and total == {i: n or 0 for i, n in sizes}
        pieces = [p for _, n in sizes for p in ([capacity] * ((n or 0) // capacity) + ([(n or 0) % capacity] if (n or 0) % capacity or not n else []))]
        assert len(per) == len(best_fit_decreasing(pieces, capacity))
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), caps).count() == 0


# 9. Shared spans


def brute_pairs(texts, k):
    at = {}
    for i, t in texts.items():
        for j in range(len(t or "") - k + 1):
            at.setdefault(t[j : j + k], set()).add(i)
    cover = {i: np.zeros(len(t or ""), bool) for i, t in texts.items()}
    for i, t in texts.items():
        for j in range(len(t or "") - k + 1):
            if len(at[t[j : j + k]]) > 1:
                cover[i][j : j + k] = True
    return {(a, b) for g in at.values() for a in g for b in g if a < b}, {i: int(c.sum()) for i, c in cover.items()}


@pytest.mark.parametrize("hot", [1, 1000])
def test_spans_equal_brute_force(spark, hot):
    random.seed(hot)
    base = ["".join(random.choice("abcdeħ ") for _ in range(120)) for _ in range(6)]
    texts = {i: "".join(random.choice(base)[random.randint(0, 60) :][: random.randint(1, 80)] for _ in range(random.randint(0, 5))) for i in range(40)}
    texts |= {40: None, 41: "", 42: "." * 90, 43: "." * 75, 44: base[0], 45: base[0], 46: base[0] + "x", 47: "日" * 40}
    df = spark.createDataFrame(list(texts.items()), DOC).withColumn("doc", F.lit("clash"))
    pairs, cover = brute_pairs(texts, 30)
    for broadcast_rows, very_hot in ((0, 1000), (100_000, 1)):
        assert {tuple(r) for r in spans.shared_pairs(df, length=30, seed=12, hot=hot, very_hot=very_hot, broadcast_rows=broadcast_rows).collect()} == pairs
        assert {r.doc_id: r.shared_chars for r in spans.shared_cover(df, length=30, seed=12, hot=hot, very_hot=very_hot).collect()} == cover
    assert spans.shared_pairs(df.limit(0)).count() == 0


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(spans, "rolling", lambda codes, k: np.zeros(max(0, len(codes) - k + 1), np.uint64))
    w = spans.Windows(["abcd", "xabcdy", "wxyz"], 4)
    assert sorted(w.members()) == [([0, 1], [(0, 0, 4), (1, 1, 5)])]


def test_one_passage_in_very_many_records(spark):
    random.seed(4)
    noise = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage = noise(60)
    n = 20_000
    df = spark.createDataFrame([(i, noise(8) + (passage if i % 100 else noise(60)) + noise(8)) for i in range(n)], DOC)
    members = spans._members(spans._records(df, "doc_id", "text"), spans.copies(spans._records(df, "doc_id", "text"), 40), 40, 15, 50, 500, 100_000)
    top = members.groupBy("gid").agg(F.count_distinct("doc").alias("k")).agg(F.max("k")).first()[0]
    assert top == n - n // 100
    cover = spans.shared_cover(df, length=40, seed=15, hot=50, very_hot=500)
    assert cover.where("doc_id % 100 > 0 and shared_chars < 60 or doc_id % 100 = 0 and shared_chars > 0").count() == 0


# 6. Canonical form


@pytest.mark.parametrize(
    "text, form",
    [
        ("ｄａｒｂａ", "darba"), ("a​ħna", "aħna"), ("iż-żejt", "iż-żejt"), ("gh̵ax", "għax"), ("Meta hu", "Meta hu"), ("qata’", "qata'"), ("l‑omm", "l-omm"), ("tаħt", "taħt"), ("ιl-baħar", "il-baħar"),
        ("\uf900", "\u8c48"), ("\u1112\u1161\u11ab", "\ud55c"), ("\u0958", "\u0915\u093c"), ("\u0627\u0653", "\u0622"), ("\u304b\u3099", "\u304c"), ("\ufb1d", "\u05d9\u05b4"), ("\uff76\uff9e", "\u30ac"), ("\u2f80", "\u807f"), ("\ufe50", ","), ("\u0133", "ij"), ("\u01c6", "d\u017e"), ("№ ℃ ² ½ µ ™", "№ ℃ ² ½ µ ™"),
        ("ПЕКАРНА", "ПЕКАРНА"), ("α u β", "α u β"), ("2°C ±3 § … é", "2°C ±3 § … é"), ("", ""), ("﻿The", "The"), ("coﬀ", "coff"), ("perché", "perché"),
    ],
)
def test_canonical_form(text, form):
    assert canonical.canonical_text(text) == form and canonical.canonical_text(form) == form


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aħ̇cz ｆа​ ’-…1", max_size=30))
def test_form_of_the_form_is_the_form(text):
    once = canonical.canonical_text(text)
    assert canonical.canonical_text(once) == once


def test_quick_check_agrees_and_columns_keep_nulls(spark):
    rows = [(1, "ｆ"), (2, None), (3, ""), (4, "ok"), (5, "a­b" * 5000)]
    df = spark.createDataFrame(rows, "row_id long, text string")
    assert {r.row_id: r.text for r in canonical.canonical(df, "text").collect()} == {1: "f", 2: None, 3: "", 4: "ok", 5: "ab" * 5000}
    assert {r.row_id for r in canonical.changed(df).collect()} == {1, 5}


def test_forms_of_all_fields(spark, tmp_path):
    for name, columns in (("create_log", "input"), ("verb_forms", "word"), ("unified_match", "group0 inner_text")):
        kinds = ", ".join(f"{c} string" for c in columns.split())
        texts = ["c\u0307ar", "għax", None]
        rows = [(i, *[t] * len(columns.split())) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, f"row_id long, {kinds}").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.table_name, r.field_name, r.row_id): r.form for r in queries.p6_forms(spark, str(tmp_path)).collect()}
    fields = (("create_log", "input"), ("verb_forms", "word"), ("unified_match", "group0"), ("unified_match", "inner_text"))
    assert got == {(*f, i): form for f in fields for i, form in enumerate(("ċar", "għax", None))}


# 1. Encodings


def test_learns_and_restores(spark):
    clean = ["għax", "ħobż", "iżda", "ċirku", "żejt", "ġobon", "ħajt", "żarbun", "ġar", "aħna", "ċar", "perché", "più"]
    bad = [w.encode().decode("cp1252", "replace").replace("�", "\x8b") for w in clean[:8] + ["ċar"]]
    rows = clean + bad + ["g��ax", "a?na", "São", "2°C ±3", "Ångström", None, "", "xejn?", "Ä§aġa", "Malta? xejn"]
    df = spark.createDataFrame([("t", "f", i, x) for i, x in enumerate(rows)], "table_name string, field_name string, row_id long, text string")
    mapping = encoding.learned(df)
    assert mapping.letters["Ä§"] == "ħ"
    got = {r.row_id for r in encoding.garbled(df, mapping).collect()}
    expected = {i for i, x in enumerate(rows) if x in bad or x in ("g��ax", "a?na", "Ä§aġa")} - {i for i, x in enumerate(rows) if x in clean}
    assert got == expected
    back = {r.row_id: r.repaired for r in encoding.restored(df).collect()}
    assert back[rows.index("g��ax")] == "għax" and back[rows.index("a?na")] == "aħna" and all(back[len(clean) + i] == w for i, w in enumerate(clean[:8]) if bad[i] != w)
    assert encoding.garbled(df.limit(0), mapping).count() == 0


CLEAN = ["għax", "ħobż", "iżda", "ċirku", "żejt", "ġobon", "ħajt", "żarbun", "ġar", "aħna", "għada", "żgħir", "ċar", "ġdid", "ħadd", "ħelu", "ġenb", "ċavetta", "żiemel", "għarus", "ħabib", "ġnien", "ċoff", "żunżana", "ħolm", "ġurnata"]
CLEAN = ["ċint", "ċomb", "ċpar", "ċimi", *CLEAN]


@pytest.mark.parametrize("read", ["cp1251", "koi8_r", "cp775"])
def test_learns_a_held_out_encoding(spark, read):
    bad = ["".join(encoding.read_as(c, "utf-8", read) if ord(c) > 127 else c for c in w) for w in CLEAN]
    rows = CLEAN * 3 + bad[:24]
    df = spark.createDataFrame([("t", "f", i, x) for i, x in enumerate(rows)], "table_name string, field_name string, row_id long, text string")
    counted = encoding.words(df)
    alphabet, signs = encoding.alphabet_of(counted)
    assert alphabet == "ĊċĠġĦħŻż"
    units = [tuple(r) for r in encoding.units(encoding.twins(counted, alphabet)).collect()]
    others = [c for c in encoding.charmaps() if not c.startswith(("koi8", "kz1048", "ptcp154", "mac-cyr", read.replace("_", "-")))]
    alone = encoding.learn(units, alphabet, signs, read=others)  # from the pairs alone
    repair = encoding.Repair(alone)
    assert [repair.text(w)[1] for w in bad[24:]] == CLEAN[24:]
    assert encoding.learn(units, alphabet, signs, read=[read]).letters[encoding.read_as("Ħ", "utf-8", read)] == "Ħ"  # extended to what no pair shows


def test_very_long_words_and_runs(spark):
    long = "x" * 150 + "għax" + "y" * 40_000
    rows = CLEAN + [w.encode().decode("cp1252", "replace") for w in CLEAN] + [long, "Ä§" * 30, "ħ" * 30 + "ab", "Ä§" * 30 + "ab"]
    df = spark.createDataFrame([("t", "f", i, x) for i, x in enumerate(rows)], "table_name string, field_name string, row_id long, text string")
    back = {rows[r.row_id]: r.repaired for r in encoding.restored(df).collect()}
    assert back["Ä§" * 30] == "ħ" * 30 and back["Ä§" * 30 + "ab"] == "ħ" * 30 + "ab" and long not in back


# 3. Truncation


def test_truncation(spark):
    whole = [f"The {a} was near the {n} at noon." for a in ("quiet", "small", "empty", "narrow") for n in ("window", "garden", "bridge", "kitchen", "station")] * 2
    texts = whole + ["The quiet was near the win...", "The quiet was near the window at noon…", "The quiet was near the", "blue window", "The small was…", None, "", "  ", "The small was near the garden at noon. ", "The empty was near the bridge at noo\\u01"]
    now = datetime.datetime(2025, 1, 1)
    logs = spark.createDataFrame([(i, f"l{i}", "web" if i % 2 else None, t, "x - suggestions: y." if i % 3 else "x - sugg", None, now) for i, t in enumerate(texts)], "row_id long, log_id string, client string, input string, notes string, final_output string, received_at timestamp")
    events = spark.createDataFrame([(1, "l1", "The quiet was near the"), (2, "none", None)], "row_id long, log_id string, final_output string")
    values = truncation.values(logs, events)
    rows = truncation.judged(values, truncation.corpus(logs))
    got = {(r.table_name, r.field_name, r.row_id) for r in rows.where("is_cut").collect()}
    n = len(whole)
    assert {k[2] for k in got if k[1] == "input"} == {n, n + 2, n + 4, n + 9}
    assert {k[2] for k in got if k[1] == "notes"} == {i for i in range(len(texts)) if i % 3 == 0}
    assert ("update_choice", "final_output", 1) in got
    share = {(r.client, r.table_name, r.field_name): r.share_cut for r in truncation.rates(values, rows).collect()}
    assert share["web", "update_choice", "final_output"] == 1.0
    assert truncation.judged(truncation.values(logs.limit(0), events.limit(0)), truncation.corpus(logs.limit(0))).count() == 0


def test_truncation_counts_inputs_and_outputs(spark):
    logs = spark.createDataFrame([("one two three", "four five six"), ("seven eight nine", ""), ("ten eleven twelve", None), (None, "  "), (None, None)], "input string, final_output string").withColumn("notes", F.lit("thirteen fourteen fifteen"))
    counted = {r.key: r.n for r in truncation.counts(truncation.corpus(logs)).where("key like 'w %'").collect()}
    assert counted == {f"w {w}": 1 for w in ("one", "two", "four", "five", "seven", "eight", "ten", "eleven")} | {"w thirteen": 5, "w fourteen": 5}


def test_truncation_looks_at_whole_texts(spark):
    end = truncation._end
    open_text = "The quiet was near the win"
    assert end(open_text + " " * 61, False)[:2] == end(open_text, False)[:2] == (True, False) and end(open_text + "." + " " * 100, False) is True
    assert end("The small was near the \u200b…" + "\u200b" * 70, False)[1] and end("Two words", False) is None and end(" \u200b ", False) is None
    long = "x" * 61 + "yz"
    known = {r.node: (r.known, r.inner) for r in truncation.trie(spark.createDataFrame([(long, 3), ("ab", 1)], "word string, n long"), [62]).collect()}
    assert known[long[:62]] == (False, True) and known["ab"] == (True, False) and known["a"] == (False, True) and long not in known
    assert truncation.parts("One two. Three fo")[0] == "One two. Three" and truncation.body("So it was…\"") == "So it was" and truncation.body("So it was...") == "So it was"


def test_missing_full_stop_alone_decides_nothing(spark):
    logs = spark.createDataFrame([(i, f"l{i}", "a", "They went home by the river", None, None) for i in range(3)] + [(9, "l9", "a", "They went home by the riv", None, None)], "row_id long, log_id string, client string, input string, notes string, final_output string")
    rows = truncation.judged(truncation.values(logs, logs.select("row_id", "log_id", "final_output")), truncation.corpus(logs.where("row_id < 9").unionByName(logs.limit(1).withColumn("input", F.lit("The river and the house.")))))
    assert {r.row_id: (r.is_cut, r.evidence) for r in rows.collect()} == {0: (False, None), 1: (False, None), 2: (False, None), 9: (True, "trie")}


# 2. Personal data


def test_personal_data(spark):
    names = [("Anna", "NAME"), ("Marku", "NAME"), ("Borg", "SNAME"), ("Vella", "SNAME"), ("Camill", "SNAME")]
    seen = [f"Jisimni {a} {b} u nixtieq tweġiba." for a in ("Anna", "Marku") for b in ("Borg", "Vella", "Camill")]
    phones = [f"In-numru tat-telefon hu +356 5{i}48 2019 u nwieġeb dejjem." for i in range(6)]
    codes = [f"Il-kodiċi tal-ktieb hu 5763451{i} u mhux ieħor." for i in range(4)]
    cases = {
        "Jisimni Zoroastru Pampalun u nixtieq tweġiba.": {"name"}, "Il-ktieb ta' BORG, ANNA hawn.": {"name"}, "In-numru tat-telefon hu 57634516 u nwieġeb dejjem.": {"phone"}, "Il-kodiċi tal-ktieb hu 57634516 u mhux ieħor.": set(),
        "Ikteb lil a.borg (at) kitba dot invalid illum.": {"email"}, "Segwi lil @kitba_61 hawn.": set(), "Noqgħod 23, Triq il-Mogħża u tajjeb.": {"address"}, "Triq is-Serp hija twila.": set(), "Il-karta hi 0012345M kif mitlub.": {"id_number"},
        "Il-ħanut Borg u Wliedu.": set(), "I live at 106 Carob Lane now.": {"address"}, "Anna": set(), "L-ordni nru 1101455 waslet.": set(), "Ikteb lil ａnna@kitba.invalid illum.": {"email"},
    }
    mails = [f"Ikteb lil x{i}@kitba.invalid illum." for i in range(4)] + [f"I live at 10{i} Thistle Street now." for i in range(4)]
    texts = seen + phones + codes + mails + list(cases) + [None, "", "x" * 20_000]
    df = spark.createDataFrame([("t", "f", i, t) for i, t in enumerate(texts)], "table_name string, field_name string, row_id long, text string")
    nl = spark.createDataFrame(names + [(None, None)], "surface string, payload string")
    found = personal.items(df, nl)
    got = {}
    for r in found.collect():
        got.setdefault(texts[r.row_id], set()).add(r.kind)
    assert {t: got.get(t, set()) for t in cases} == cases
    assert all(got[t] == {"name"} for t in seen) and all(got[t] == {"phone"} for t in phones)
    out = {texts[r.row_id]: r.redacted for r in personal.redacted(df, found).collect()}
    assert out["Noqgħod 23, Triq il-Mogħża u tajjeb."] == "Noqgħod [ADDRESS] u tajjeb." and out[seen[0]] == "Jisimni [NAME] u nixtieq tweġiba." and "@" not in out["Ikteb lil ａnna@kitba.invalid illum."]
    assert personal.items(df.limit(0), nl).count() == 0


HELD = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(HELD).exists(), reason="the tables aren't there")
def test_hidden_seeds_are_discovered(spark):
    values = queries._p2_values(spark, HELD).where("text is not null")
    found = personal.extract(values, {}).cache()
    hide = F.pmod(F.xxhash64("row_id", "start"), F.lit(2)) == 0
    hidden = found.where(F.col("seed").isNotNull() & ~F.col("at_end") & hide).select("kind", "seed", "table_name", "field_name", "row_id", "start")
    got = personal.shaped(found.withColumn("seed", F.when(~hide, F.col("seed")))).withColumn("hit", F.lit(1)).select("table_name", "field_name", "row_id", "start", F.col("kind").alias("seed"), "hit").distinct()
    recall = {r.seed: (r.n, r.hits / r.n) for r in hidden.join(got, ["table_name", "field_name", "row_id", "start", "seed"], "left").groupBy("seed").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits")).collect()}
    assert set(recall) == {"email", "phone", "id_number", "address"} and all(share >= 0.9 for _, share in recall.values()), recall
    values, names = queries._p2_values(spark, "/root/testdata/sf0.1").where("text is not null"), table(spark, HELD, "name_list")
    pairs = lambda df: {(r.table_name, r.field_name, r.row_id) for r in df.where("kind = 'name'").collect()}
    every, half = (pairs(personal.items(values, n)) for n in (names, names.where(F.pmod(F.xxhash64("surface"), F.lit(3)) > 0)))
    assert len(every & half) >= 0.9 * len(every) and len(half - every) <= 0.02 * len(every), (len(every), len(half), len(every & half))


def test_contexts_and_names_without_windows(spark):
    names = [("Anna", "NAME"), ("Marku", "NAME"), ("Borg", "SNAME"), ("Vella", "SNAME"), ("Camill", "SNAME")]
    seen = [f"Jisimni {a} {b} u nixtieq tweġiba." for a in ("Anna", "Marku") for b in ("Borg", "Vella", "Camill")]
    cases = ["Jisimni Jo Borg u nixtieq tweġiba.", "İ hawn. Jisimni Zoroastru Pampalun u nixtieq tweġiba.", "Borg kiteb ittra.", "Jisimni " + "x" * 100 + " u nixtieq."]
    texts = seen + cases
    df = spark.createDataFrame([("t", "f", i, t) for i, t in enumerate(texts)], "table_name string, field_name string, row_id long, text string")
    found = personal.items(df, spark.createDataFrame(names, "surface string, payload string"))
    assert {texts[r.row_id] for r in found.where("kind = 'name'").collect()} == {*seen, *cases[:2]}
    assert {r.kind: (r.seeded, r.discovered) for r in personal.evidence(found).collect()} == {"name": (6, 2)}
    long = "word " + "y" * 200 + " 12345 " + "z" * 200 + " next. End"
    assert personal.Contexts(long).around(206, 211) == ("L2 word " + "y" * 200, "L1 " + "y" * 200, "R1 " + "z" * 200, "R2 " + "z" * 200 + " next")
    assert personal.Contexts("One two. 123 four").around(9, 12) == ("L2 ^ ^", "L1 ^", "R1 four", "R2 four $")


# 5. Languages


EN = "the cat sat near the old window and she was reading a letter from her brother when somebody knocked on the door".split()
IT = "il gatto era vicino alla finestra e la nonna ha scritto una lettera perché il fratello non voleva aprire la porta".split()
MT = "il-qattus kien ħdejn it-tieqa u n-nanna kitbet ittra għax ħuha ma riedx jiftaħ il-bieb meta ġew in-nies kollha".split()


def phrase(words):
    return " ".join(random.sample(words, 8)).capitalize() + "."


def test_languages_held_out_and_mixed():
    random.seed(5)
    rows = [(" ".join(phrase(w) for _ in range(3)), label) for w, label in ((EN, "en"), (IT, "it"), (MT, "mt")) for _ in range(60)]
    rows += [(" ".join(phrase(EN) for _ in range(3)), "it") for _ in range(8)]  # wrong labels
    model = language.train(rows, ("mt", "en", "it"))
    held = [(phrase(w), label) for w, label in ((EN, "en"), (IT, "it"), (MT, "mt")) for _ in range(40)]
    p = model.probabilities([t for t, _ in held])
    assert np.mean([model.languages[i] == label for i, (_, label) in zip(p.argmax(1), held)]) >= 0.97
    mixed = f"{phrase(MT)} {phrase(EN)} {phrase(MT)}"
    quoted = f'{phrase(MT)[:-1]} "{phrase(EN)}" {phrase(MT)}'
    got = language.judge(model, [mixed, quoted, None, "", "  ", "one two three", "12 34 56 78 90", phrase(EN) + " ."])
    assert got[0][0] == "mt" and {s["lang"] for s in got[0][2]} == {"mt", "en"} and got[0][2][0]["start"] == 0 and got[0][2][-1]["end"] == len(mixed)
    assert got[1][0] == "mt" and got[1][2] == [] and [g[0] for g in got[2:7]] == [None] * 5 and got[7][0] == "en"


def test_languages_have_no_size_switches():
    random.seed(9)
    model = language.train([(" ".join(phrase(w) for _ in range(3)), label) for w, label in ((EN, "en"), (IT, "it"), (MT, "mt")) for _ in range(40)], ("mt", "en", "it"))
    numbers = " ".join(str(i) for i in range(200))
    long_quote = f'{phrase(MT)[:-1]} “{" ".join(phrase(EN) for _ in range(60))}” {phrase(MT)}'
    late = phrase(MT) + " " + " ".join(f"{i}" for i in range(300)) + " " + phrase(MT) + " " + phrase(EN)
    got = language.judge(model, ["two words 12345", "two words " + numbers, long_quote, late, '"' + phrase(MT) + "\n" + phrase(EN), phrase(EN) + "\n\n<maths num=\"1\">F &#x3D; l<sup>2</sup></maths>\n\n" + phrase(EN)])
    assert len(long_quote) > 2400 and [g[0] for g in got] == [None, None, "mt", "mt", "en", "en"] or [g[0] for g in got] == [None, None, "mt", "mt", "mt", "en"]
    assert got[2][2] == [] and {s["lang"] for s in got[3][2]} == {"mt", "en"} and got[5][2] == []
    assert language.blank_quotes('a "b" c') == "a     c" and language.blank_quotes("a “b\nc") == "a   \nc" and language.blank_quotes("x „" + "y" * 3000 + "“ z") == "x " + " " * 3002 + " z"


def test_labels(spark):
    random.seed(6)
    texts = [(i, phrase((EN, IT, MT)[i % 3]) + " " + phrase((EN, IT, MT)[i % 3]), ("en", "it", "mt")[i % 3]) for i in range(90)]
    texts += [(100, phrase(EN), None), (101, phrase(EN), "und"), (102, phrase(EN), "mt"), (103, None, None), (104, "", "en"), (105, phrase(MT) + " " + phrase(IT), "mt")]
    df = spark.createDataFrame(texts, "row_id long, text string, label string")
    model = language.fit(df, "row_id", "text", "label", ("mt", "en", "it"))
    judged = language.languages_of(df.withColumn("table_name", F.lit("t")).select("table_name", "row_id", "label", "text"), model)
    assert {(r.row_id, r.lang) for r in language.mislabelled(judged).collect()} == {(100, "en"), (101, "en"), (102, "en"), (105, "mt"), (105, "it")}
    assert language.languages_of(df.limit(0).select("row_id", "label", "text"), model).count() == 0


def test_sentences_cover_the_text():
    text = "One two. Three four!\n\nFive (six) seven."
    parts = language.sentences(text)
    assert "".join(text[a:b] for a, b in parts) == text and len(parts) == 3 and re.match("Three", text[parts[1][0] :])
