from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chunk_encode as ce
from corpusloom.llm import language_ppm as lp
from corpusloom.llm import leak_scan as ls
from corpusloom.llm import page_spam as ps
from corpusloom.llm import personal_data as pd_
from corpusloom.llm import residue as rs
from corpusloom.llm import sentence_bounds as sb
from corpusloom.llm import unicode_form as uf

TEXT = st.text(st.characters(codec="utf-8"), max_size=40)
MARKS = st.text(st.sampled_from(list("aeöé́̀̂̄ọ̣ŝ가각각ㅏ ਼क़Αа")), max_size=14)


def frame(spark, rows, extra=True):
    """(k, text) rows, with further columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "k bigint, text string")
    return df.selectExpr("k", "text", "1 AS id", "'x' AS kind", "2 AS form", "'y' AS t", "0 AS n") if extra else df


# --- 1: one form -----------------------------------------------------------------------------------


def slow_form(text):
    return unicodedata.normalize("NFC", "".join(map(uf._expand, text)))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT | MARKS, max_size=6))
def test_form_equals_slow(texts):
    assert uf.form_of_array(pa.array(texts, pa.string())).to_pylist() == [slow_form(t) for t in texts]


def test_form_cases():
    given = [None, "", "Ｋｉｌａ　ｋ", "so​ng", "ſоng", "ﬁ", "ẹ́", "ẹ́", "A a Á", "‘x’", "x²", "لا"]
    out = uf.form_of_array(pa.array(given)).to_pylist()
    assert out[:3] == [None, "", "Kila k"] and out[3] == "song" and out[5] == "fi"
    assert out[6] == out[7] and out[8] == "A a Á" and out[9] == "‘x’" and out[10] == "x²" and out[11] == "لا"
    assert uf.form_of_array(pa.array(["a" * 3_000_000, "ｂ"])).to_pylist()[1] == "b"
    sliced = pa.array(["zz", "Ａ", None, "q"]).slice(1, 2)
    assert uf.form_of_array(sliced).to_pylist() == ["A", None]


def test_look_alike_pairs(spark):
    rows = [(1, "road"), (2, "rоad"), (3, "road"), (4, "Road"), (5, "róad"), (6, None), (7, " "), (8, "\t"), (9, "ro​ad"), (10, "​")]
    got = {tuple(r) for r in uf.look_alike_pairs(frame(spark, rows), "k", "text").collect()}
    assert got == {(1, 2), (2, 3), (1, 9), (2, 9), (3, 9)}
    assert uf.look_alike_pairs(frame(spark, []), "k", "text").count() == 0


def test_letters_that_look_alike_in_this_corpus():
    pairs = [("ε", "ɛ"), ("Ԑ", "Ɛ"), ("Ͻ", "Ɔ"), ("ʼ", "’"), ("Ꭺ", "A"), ("ꓮ", "A"), ("یک", "يک"), ("مکتب", "مكتب"), ("علی", "على")]
    for a, b in pairs:
        one, other = uf.form_of_array(pa.array([a, b])).to_pylist()
        assert one == other, (a, b)
    one, other = uf.form_of_array(pa.array(["علی", "علي"])).to_pylist()
    assert one != other  # dots at the end are visible


def test_look_alike_classes(spark):
    """Also the salted way: a string with a third of the rows has look-alikes."""
    rows = [(i, "road") for i in range(500)] + [(1000 + i, "rоad") for i in range(5)] + [(2000, "rоаd"), (2001, "roаd")] + [(3000 + i, f"plain {i}") for i in range(1000)]
    got = {r["id"]: tuple(r)[1:] for r in uf.look_alikes(frame(spark, rows), "k", "text").collect()}
    assert len(got) == 507 and {v[0] for v in got.values()} == {0}
    assert got[7] == (0, 0, 7) and got[1003] == (0, 1000, 502) and got[2000] == (0, 2000, 506)
    pairs = {tuple(r) for r in uf.look_alike_pairs(frame(spark, rows), "k", "text").collect()}
    strings = dict(rows)
    ids = sorted(got)
    assert pairs == {(a, b) for a in ids for b in ids if a < b and strings[a] != strings[b]}


BAD = [(1, b"good text of some words, here and there"), (2, b"a \xff\xfe bad \xc3"), (3, b"\xe1\x88 Mr Kiwish. And more text"), (4, None)]


def test_bytes_that_are_no_text(spark, samples):
    """No operator fails on them, and rows beside them come out as without them."""
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in BAD], "k bigint, b binary").select("k", F.col("b").cast("string").alias("text"))
    assert df.select(uf.consistent_form("text").alias("f")).first()["f"] == BAD[0][1].decode()
    assert {r["id"] for r in pd_.personal_data(df, "k", "text").collect()} == {1, 2, 3, 4}
    assert {r["id"] for r in sb.sentences(df, "k", "text", PLAIN).collect()} == {1, 2, 3}
    assert rs.residue(df, "k", "text").where("is_residue").count() == 0
    assert {r["id"] for r in ps.judged(ps.profiles(df, samples, "k")).collect()} == {1, 2, 3, 4}
    assert {r["id"] for r in lp.segments(df, lp.fit(samples), "k").collect()} == {1, 2, 3}
    got = {r["doc_id"]: list(r["ids"]) for r in ce.encoded(df, "k").collect()}
    t, _, _ = tokenizer()
    assert got[1] == t.encode(BAD[0][1].decode(), add_special_tokens=False).ids and got[2] and got[3] and got[4] == []
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id bigint, text string")
    assert ls.leaks(df, items, "k").count() == 0 and uf.look_alike_pairs(df, "k", "text").count() == 0


# --- 2: personal data ------------------------------------------------------------------------------

FINDER = pd_.Finder({"Kiwish", "Rajom"}, {"Wavul", "Dagom"})


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Write to raza.tise @ fofushop.org.example now", ["email"]),
        ("x SARE-WEBO＠BIVIFARM.EXAMPLE.", ["email"]),
        ("bude+dawu [at] sufishop [dot] test. Next one", ["email"]),
        ("gofi-keje63 at wotushop dot test", ["email"]),
        ("look at www.site.test/a@b and @choir22", []),
        ("meet at noon. dot", []),
        ("call +999 7137 920 950 or (0999) 925 1351", ["phone"]),
        ("call ٠٩٤٣٤-٦٠٨٦٢٩ now", ["phone"]),
        ("price 4,837,290 in 1990, lot 045-4461-4506, shelf 978-0-636-9851, v. 2.1", []),
        ("Namba ya NIDA ni 2949-1338-4570-2785.", ["national_id"]),
        ("Passeport : 03275437214.", ["national_id"]),
        ("Lambar NIN ɗina ita ce XA3029304.", ["national_id"]),
        ("رقم الهوية 2276-7349-5266-2776 مفقود", ["national_id"]),
        ("Tunaishi S.L.P. 205, Kiwado, Wuwevo, nyuma", ["address"]),
        ("Bring it to No. 184, Nejere Road, Witude.", ["address"]),
        ("he walked 3 small road signs", []),
        ("Je m'appelle Mme Kiwish Wavul et", ["name"]),
        ("Daraja la Wavul; A ponte Wavul; Gadar Wavul kusa; The Wavul bridge", []),
        ("Rajom Z. Dagom; +9997865798472; dave_jofu@hukafarm.invalid.", ["email", "name", "phone"]),
        ("اسمي السيد سايشي فافاوهي وأسكن", ["name"]),
        ("ስሜ አቶ ፒቪ ቩሆኔ ይባላል።", ["name"]),
        ("Mzee mrefu karibu na mto", []),
        ("", []),
    ],
)
def test_kinds(text, kinds):
    assert sorted({k for _, _, k in FINDER.spans(text)}) == kinds


OWN = pd_.Finder({"Amina", "Li"}, {"Diallo", "Ba"})
FAR = "word " * 60


@pytest.mark.parametrize(
    ("text", "redacted"),
    [
        (f"Passport number, {FAR}in the office: A1234567 ok", f"Passport number, {FAR}in the office: [NATIONAL_ID] ok"),
        (f"Passport lost, {FAR}phone: 712 345 678 now", f"Passport lost, {FAR}phone: [PHONE] now"),
        ("Passport lost in 1990-1995 only", "Passport lost in 1990-1995 only"),
        (f"Go to 15 {'X' + 'y' * 90} Road, now", "Go to [ADDRESS], now"),
        ("It is at 15 Independence Square now", "It is at [ADDRESS] now"),
        (f"Write {'n' * 90}.x@mail.example!", "Write [EMAIL]!"),
        ("write jöhn.doe@mail.example now", "write [EMAIL] now"),
        ("ወደamina@mail.example ጻፍ", "ወደ[EMAIL] ጻፍ"),
        ("Call 202-555-0182. ok", "Call [PHONE]. ok"),
        ("at 202-555-0182 ok", "at [PHONE] ok"),
        ("Phone: 712 345 678", "Phone: [PHONE]"),
        ("SSN 123-45-6789", "SSN [NATIONAL_ID]"),
        ("isbn 978-316-1484 and lot 202-555-0182", "isbn 978-316-1484 and lot 202-555-0182"),
        ("she was born as Zawadi Okoro in May", "she was born as [NAME] in May"),
        ("we saw Li Ba there", "we saw [NAME] there"),
        (f"we saw {'Q' + 'r' * 80} B. Diallo there", "we saw [NAME] there"),
        ("a li ba at noon, the Ba bridge", "a li ba at noon, the Ba bridge"),
    ],
)
def test_parsers_are_bounded_by_words_not_characters(text, redacted):
    assert pd_.redacted(text, OWN.spans(text)) == redacted


def test_many_finds_take_linear_time():
    import time

    began = time.process_time()
    text = "x@mail.example 712-555-0182 passport lost " * 10_000
    assert len(OWN.spans(text)) == 20_000 and time.process_time() - began < 20


def test_long_name_lists_give_the_same(spark, sf_dir):
    rows, names = spark.read.parquet(f"{sf_dir}/clean_raw_dataset_text.parquet"), spark.read.parquet(f"{sf_dir}/person_names.parquet")
    held = sorted(map(tuple, pd_.personal_data(rows, "line_id", "text", names).selectExpr("id", "redacted").collect()), key=str)
    joined = sorted(map(tuple, pd_.personal_data(rows, "line_id", "text", names, most_names=3).selectExpr("id", "redacted").collect()), key=str)
    assert held == joined and any("[NAME]" in (t or "") for _, t in held)


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "Ask Mr Kiwish Wavul, bob.x@mail.example!"), (2, None), (3, ""), (4, "x" * 200_000 + " bob.x@mail.example"), (5, "plain")]
    names = spark.createDataFrame([("Kiwish", "given"), ("Wavul", "family"), (None, None)], "name string, kind string")
    got = {r["id"]: (r["kinds"], r["redacted"]) for r in pd_.personal_data(frame(spark, rows), "k", "text", names).collect()}
    assert got[1] == (["email", "name"], "Ask [NAME], [EMAIL]!")
    assert got[2] == ([], None) and got[3] == ([], "") and got[5] == ([], "plain")
    assert got[4] == (["email"], "x" * 200_000 + " [EMAIL]")
    assert pd_.personal_data(frame(spark, []), "k", "text", names.limit(0)).count() == 0


# --- 4: sentences ----------------------------------------------------------------------------------

PLAIN = sb.BoundaryModel(dict(sb.PRIOR), {}, {})


@pytest.mark.parametrize(
    ("text", "sentences"),
    [
        ("One here. Two there! Three?", ["One here.", "Two there!", "Three?"]),
        ("Weighs 8.00 kg. net, i.e. much. Next", ["Weighs 8.00 kg. net, i.e. much.", "Next"]),
        ('He said "Come and see!" and left. Then', ['He said "Come and see!" and left.', "Then"]),
        ("«All of it.» More", ["«All of it.»", "More"]),
        ("ሰላም ነው። እንዴት ነህ፧ ደህና፡፡ አዎ", ["ሰላም ነው።", "እንዴት ነህ፧", "ደህና፡፡", "አዎ"]),
        ("a line\r\nanother\n\n third ", ["a line", "another", "third"]),
        ("Seen at www.a.test/p?id=3 by Mr. Zezi Howul. Yes", ["Seen at www.a.test/p?id=3 by Mr. Zezi Howul.", "Yes"]),
        ("ክብደት 70,40 ነው።260 ዓመት ሆነ", ["ክብደት 70,40 ነው።", "260 ዓመት ሆነ"]),
        ("OPENING ZUSEWEB.EXAMPLE. WAIT", ["OPENING ZUSEWEB.EXAMPLE.", "WAIT"]),
        ("End.Start without space", ["End.", "Start without space"]),
        ("", []),
        (" \n ", []),
        ("<h1>Gone.</h1> Home", ["<h1>Gone.</h1>", "Home"]),
        (f"See https://example.org/{'x' * 60}/Part.Html now. Yes", [f"See https://example.org/{'x' * 60}/Part.Html now.", "Yes"]),
        (f"See https://example.org/{'x.y/' * 60}Part.Html now. Yes", [f"See https://example.org/{'x.y/' * 60}Part.Html now.", "Yes"]),
        (f"Mail {'n' * 90}.Last@mail.example now. Yes", [f"Mail {'n' * 90}.Last@mail.example now.", "Yes"]),
        (f"One.{' ' * 90}Two", ["One.", "Two"]),
        (f'One. <a href="{"u" * 40}">two</a> goes on.', [f'One. <a href="{"u" * 40}">two</a> goes on.']),
    ],
)
def test_split(text, sentences):
    assert [text[a:b] for a, b in PLAIN.split(text)] == sentences


def test_split_covers_all_text_in_order():
    text = 'Aa bb. "Cc dd?" Ee… ff! (Gg.) Hh\nIi ' * 50
    spans = PLAIN.split(text)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert "".join(text[a:b] for a, b in spans).replace(" ", "") == text.replace(" ", "").replace("\n", "")


@pytest.mark.parametrize("text", ["a.b." * 30_000, "! " * 60_000, "x" * 120_000 + ". Y", 'a.") ' * 30_000, "One two. " * 15_000, "( " * 60_000 + "a."])
def test_long_lines_take_linear_time(text):
    import time

    began = time.process_time()
    PLAIN.split(text)
    assert time.process_time() - began < 10


def test_boundaries_are_learned_from_line_ends():
    c = sb.joined_end("He came. They left. ", " Then all")
    assert c.token == "left" and c.next == "upper" and c.gap == "one" and c.next_word == "then"
    assert sb.joined_end("no mark", "Then") is None and sb.joined_end('"All."', "Then").close == '"'


def test_training_learns_an_abbreviation(spark):
    lines = [f"The cost is zq. {i} for all. We go home." for i in range(60)] + ["We go home for all."] * 30
    model = sb.train(lines)
    text = "They pay zq. Nine for all. We go home."
    assert [text[a:b] for a, b in model.split(text)] == ["They pay zq. Nine for all.", "We go home."]
    rows = [(1, "One. Two"), (2, None), (3, " "), (4, "x" * 100_000 + ". Y z")]
    got = sorted((r["id"], r["sent_no"], r["end_char"]) for r in sb.sentences(frame(spark, rows), "k", "text", model).collect())
    assert got == [(1, 0, 4), (1, 1, 8), (4, 0, 100_001), (4, 1, 100_005)]
    assert sb.sentences(frame(spark, []), "k", "text").count() == 0


def test_held_out_boundaries(spark, sf_dir):
    """Joined labelled samples: the joins must come out as boundaries."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/language_samples.parquet").orderBy("sample_id").collect()]
    model = sb.train([r["text"] for r in spark.read.parquet(f"{sf_dir}/clean_raw_dataset_text.parquet").where("text IS NOT NULL").collect()])
    found = total = 0
    for a, b in zip(texts[::2], texts[1::2]):
        found += len(a) in {e for _, e in model.split(f"{a} {b}")}
        total += 1
    assert found / total > 0.98


# --- 5: residue ------------------------------------------------------------------------------------


def test_residue(spark):
    bad = ["Please enable JavaScript to view this page.", "Lorem amet dolor magna. Culpa sit elit.", "[mysite] 404 Not Found\nThe page you asked for is not on this server.", "Dear {{ name }}, come.", "Hi $user$", "x [INSERT SENTENCE HERE] y", "asdf asdf qwer asdf"]
    good = ["She saw error 404 on the screen and laughed at the harvest.", "At school we learn JavaScript beside the kitchen.", "The word [U+1ECD LATIN SMALL LETTER O WITH DOT BELOW] is common.", "La page 112 du cahier est introuvable depuis l'orage.", "It cost $60.13 in all.", "mail a [at] b [dot] c", None, "", "...", "word " * 50_000]
    rows = [(i, t) for i, t in enumerate(bad + good)]
    got = {r["id"] for r in rs.residue(frame(spark, rows), "k", "text").where("is_residue").collect()}
    assert got == set(range(len(bad)))
    assert rs.residue(frame(spark, []), "k", "text").count() == 0


def test_residue_depends_on_shares_not_on_rows(spark):
    """The same lines many times over get the same verdicts; real frequencies count outside the exemplars too."""
    few = ["please enable javascript to view this page amid early harvest songs"] * 2 + ["please enable javascript to view this page of the old mill"] * 2
    few += ["of the old mill"] * 40 + [f"plain words number {'abcdefghij'[i % 10]} again" for i in range(156)]

    def cover(times):
        rows = [(i, t) for i, t in enumerate(few * times)]
        got = {r["id"]: round(r["coverage"], 1) for r in rs.residue(frame(spark, rows), "k", "text").collect()}
        return got.get(0, 0), got.get(2, 0), len(got)

    one, many = cover(1), cover(40)
    assert one[:2] == many[:2] and many[2] == 40 * one[2]

    index = rs.ResidueIndex(rs.exemplars(), {f: 20 for f in rs.features_of(few[0])}, 4000)
    h, _, sent = rs.words_of(rs.prepared(pa.array(few[:1])))
    c = [index.verdict(h, sent, {f: n for f in rs.features_of(few[0]) if f not in index.weight})[0] for n in (20, 4000)]
    assert c == [0.0, 1.0]


# Written apart from the tables and after the exemplars.
RESIDUE_CASES = [
    "This site is currently undergoing maintenance. Please come back later.", "Die angeforderte Seite wurde nicht gefunden.", "Sorry, an unexpected problem occurred. Please try again later.", "Please allow scripts to run in your browser.",
    "Error 500: the server is temporarily unable to service your request.", "You must enable JavaScript to view this content.", "Your session has expired. Please log in.", "Hello {{ user.first_name }}, welcome!", "Dear %(name)s, your order is ready",
    "Welcome back, ${customer}!", "[Insert headline here] The goat ran.", "Contact: [enter your name here]", "Checking your browser before opening shop.example. This takes about 9 seconds.", "Lorem ipsum dolor sit amet, sed do magna",
    "Page not found. Error 404", "This is placeholder text. Replace this text later.", "Une erreur est survenue. Veuillez réessayer.", "Internal Server Error", "Access denied. You are not authorized to view this page.", "{% include header %} The market was full.",
    "Hello {{ " + "x" * 200 + " }}!", "Hi ${" + "long_name." * 20 + "end}", "[Insert " + " " * 90 + "text here] ok",
]
TEXT_CASES = [
    "The variable {name} is written in braces.", "In the formula $x$ stands for the length of the field.", "The method __init__ is called when an object is made.", "[CHAPTER ONE] The river was wide and the goat slept.",
    "She saw error 404 on the screen and laughed at the harvest.", "Our teacher showed us how to enable JavaScript before the lesson about rivers.", "The shop was closed for maintenance, so we went to the market by the river.", 'He wrote "{name}" on the board.',
    "The server at the restaurant brought the wrong plate to our table.", "They could not find the page in the old book and searched until evening.", "Access to the well was denied to the strangers by the elder.",
    "The session of the council expired before the vote on the new bridge.", "[Editor's note: the letter was never sent.]", "Please come back later, said the nurse, the doctor is busy with a patient.", "We had to wait ten seconds before the browser opened the picture of the lake.",
    "[U+00E9 LATIN SMALL LETTER E WITH ACUTE] is a letter.", "<b>The</b> market <i>of the town</i> was full.", "See https://a.example/404 for the story of the bridge.",
]


def test_residue_of_held_out_cases(spark, sf_dir):
    """Recall and precision with the frequencies of a real table beside the cases."""
    table = spark.read.parquet(f"{sf_dir}/clean_raw_dataset_text.parquet").select(F.col("line_id").alias("k"), "text")
    cases = RESIDUE_CASES + TEXT_CASES
    rows = table.unionByName(spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(cases)], "k bigint, text string"))
    found = {r["id"] - 10**9 for r in rs.residue(rows, "k", "text").where("is_residue AND id >= 1000000000").collect()}
    right = len(found & set(range(len(RESIDUE_CASES))))
    assert right / len(RESIDUE_CASES) >= 0.9 and right / len(found) >= 0.9


def test_words_of_masked_text():
    h, row, sent = rs.words_of(pa.array(["Don’t stop. 12 3x", None, "", "DON'T\nstop"]))
    assert row.tolist() == [0, 0, 0, 0, 3, 3] and h[0] == h[4] and h[1] == h[5] and h[2] == rs.NUMBER != h[3]
    assert sent[0] == sent[1] != sent[2] and sent[4] != sent[5]
    a, b = rs.windows_of(np.array([1] * 30 + [2] * 5 + [3] * 12))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 12), (6, 18), (12, 24), (18, 30), (30, 35), (35, 47)]


# --- 6 and 10: language and spam -------------------------------------------------------------------


@pytest.fixture(scope="module")
def samples(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/language_samples.parquet")


def slow_bits(text, lang_text, order):
    """PPM with escape method C, by dictionaries."""
    import math
    from collections import Counter, defaultdict

    seen: dict[bytes, Counter] = defaultdict(Counter)
    for i in range(len(lang_text)):
        for k in range(min(order, i) + 1):
            seen[lang_text[i - k : i]][lang_text[i]] += 1
    total = 0.0
    for i in range(len(text)):
        cost = 0.0
        for k in range(min(order, i), -1, -1):
            c = seen.get(text[i - k : i])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if text[i] in c:
                cost += math.log2((n + d) / c[text[i]])
                break
            cost += math.log2((n + d) / d)
        else:
            cost += 8
        total += cost
    return total


def test_code_lengths_equal_slow():
    data = {"a": ["the cat sat on the mat", "a hat"], "b": ["le chat est là", "où"]}
    m = lp.PPM(data, order=4)
    for text in ("the chat", "zz", "là où le mat"):
        enc = lp.plain(text).encode()
        for k, lang in enumerate(m.langs):
            known = "".join(dict.fromkeys(v for s in data[lang] for v in (lp.plain(s), lp.bare(lp.plain(s))))).encode()
            assert m.score([text])[0][k] == pytest.approx(slow_bits(enc, known, 4), rel=1e-4)


def test_ethiopic_sentences_of_three_words_count(spark, samples):
    eng, amh = "The quiet field near the river was painted by the farmer. Two days ago, the bridge described the farmer.", "ገበሬው ወንዙን አየ። ልጁ መጽሐፍ አነበበ።"
    got = {r["id"]: {x["lang"]: x["sentences"] for x in r["found"]} for r in ps.profiles(frame(spark, [(1, f"{eng} {amh}"), (2, f"{eng} ሰላም።")]), samples, "k").collect()}
    assert got[1] == {"eng": 2, "amh": 2} and got[2].get("amh", 0) == 0


def test_samples_are_bounded_by_whole_texts(spark):
    df = spark.createDataFrame([("a", "x " * 300), ("a", "y " * 300), ("A ", "z " * 300), ("a", "w " * 5000), ("b", "ok then"), (None, "q"), ("b", None)], "lang string, text string")
    by = lp.labelled(df, chars=1300)
    assert len(by["a"]) == 2 and all(len(t) == 600 for t in by["a"]) and by["b"] == ["ok then"]
    assert len(lp.labelled(df, most=1)["a"]) == 1
    old, lp.MODEL_BYTES = lp.MODEL_BYTES, 60_000
    try:
        model, kept = lp.fitted(df)
        assert model.bytes <= 60_000 and kept
    finally:
        lp.MODEL_BYTES = old


def test_places():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    p = lp.Places(keys)
    assert (p.find(keys) == np.arange(len(keys))).all()
    assert (p.find(keys + np.uint64(1)) == np.where(np.isin(keys + np.uint64(1), keys), np.searchsorted(keys, keys + np.uint64(1)), -1)).all()
    assert lp.Places(keys[:0]).find(keys[:3]).tolist() == [-1] * 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aéB '’1#@./:-_ው́ <>\"")), max_size=30), max_size=8))
def test_plain_all_equals_plain(texts):
    assert lp.plain_all(texts) == [lp.plain(t) for t in texts]


def test_held_out_languages(samples):
    by = lp.labelled(samples)
    m = lp.PPM({k: v[:18] for k, v in by.items()})
    tests = [(k, t) for k, v in by.items() for t in v[18:]]
    bits = m.score([t for _, t in tests])
    assert np.mean([m.langs[b.argmin()] == k for b, (k, _) in zip(bits, tests)]) > 0.98
    upper = m.score([lp.bare(t).upper() for _, t in tests])
    assert np.mean([m.langs[b.argmin()] == k for b, (k, _) in zip(upper, tests)]) > 0.95


def test_segments(spark, samples):
    eng, fra = "The quiet field near the river was painted by the farmer. Two days ago, the bridge described the farmer.", "Nous savons que la récolte a visité le tambour à cause d'un orage. Près de la route, le puits a décrit la chèvre."
    rows = [(1, eng), (2, f"{eng}\n{fra}"), (3, None), (4, ""), (5, "123 !!!"), (6, eng + " " + fra.split(". ")[0] + ".")]
    segs = lp.segments(frame(spark, rows), lp.fit(samples), "k").collect()
    got = {k: [(r["lang"], r["sentences"]) for r in sorted(segs, key=lambda r: r["segment"]) if r["id"] == k] for k in range(1, 7)}
    assert got[1] == [("eng", 2)] and got[2] == [("eng", 2), ("fra", 2)] and not got[3] and not got[4] and not got[5]
    assert all(0 <= r["confidence"] <= 1 for r in segs)
    langs = {r["id"]: r["langs"] for r in lp.languages_of(lp.segments(frame(spark, rows), lp.fit(samples), "k")).collect()}
    assert sorted(langs[2]) == ["eng", "fra"] and langs[6] == ["eng"]
    assert lp.segments(frame(spark, rows), lp.fit(samples.limit(0)), "k").count() == 0


def test_spam(spark, samples, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("k"), "text")
    eng = "The quiet field near Sosaki was painted by the river. Two days ago, the bridge described the quiet farmer. "
    more = [
        (10**6, "used tractor | cheap bag | cheap bag | used tractor | " * 20), (10**6 + 1, "\n".join(f"https://a{i}.test/x" for i in range(30))), (10**6 + 2, " ".join(f"#tag{i}" for i in range(40))),
        (10**6 + 3, eng * 3 + "#a #b #c"), (10**6 + 4, (eng + "About 390 people came to see the narrow goat before sunset. ") * 6), (10**6 + 5, None), (10**6 + 6, ""), (10**6 + 7, "12 ... !"),
    ]
    rows = docs.unionByName(frame(spark, more, False))
    got = {r["id"] for r in ps.judged(ps.profiles(rows, samples, "k")).where("spam AND id >= 1000000").collect()}
    assert got == {10**6, 10**6 + 1, 10**6 + 2}
    assert ps.judged(ps.profiles(frame(spark, []), samples, "k")).count() == 0
    alone = ps.judged(ps.profiles(frame(spark, [(1, "only one"), (2, None)]), samples, "k"))
    assert alone.count() == 2


# --- 8: encoding -----------------------------------------------------------------------------------


def tokenizer():
    t, size = ce._load(ce.tokenizer_path())

    def encode(b):
        e = t.encode(b.decode(), add_special_tokens=False)
        return np.array(e.ids, np.int32), np.flatnonzero(np.diff(np.array(e.word_ids, np.int64), prepend=-1))

    return t, size, encode


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", " ", "\n", "'", "re", "ll", "1", "é", "ው", "!", "\t", "😀", "<|endoftext|>"]), max_size=9).map("".join), max_size=9))
def test_joins_are_exact(parts):
    t, size, encode = tokenizer()
    parts = [p for p in parts if p]
    got = ce.joined_ids([(p.encode(), *encode(p.encode())) for p in parts], encode, size)
    assert list(got) == t.encode("".join(parts), add_special_tokens=False).ids


def test_encoded_column(spark):
    t, _, _ = tokenizer()
    texts = ["", None, "a " * 30_000, "x" * 20_000, "same text here", "same text here", " ", "<|endoftext|>", "Kò sí ẹnikẹ́ni\n\n ዴሩፑ ውስጥ  "]
    got = {r["doc_id"]: list(r["ids"]) for r in ce.encoded(frame(spark, list(enumerate(texts))), "k").collect()}
    assert got == {i: (t.encode(x, add_special_tokens=False).ids if x else []) for i, x in enumerate(texts)}
    assert ce.encoded(frame(spark, []), "k").count() == 0


def test_shared_chunks_and_texts(spark):
    """Passages shared by many texts, one text with a third of the rows, and joins between shared and own chunks."""
    t, _, _ = tokenizer()
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    shared = word(900)
    texts = [f"{word(30)} {shared} {word(30)}" for _ in range(6)] + [shared] * 6 + [word(400) for _ in range(6)] + [shared + shared]
    got = {r["doc_id"]: list(r["ids"]) for r in ce.encoded(frame(spark, list(enumerate(texts))), "k").collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}


def test_unbroken_text_is_linear():
    t, size, encode = tokenizer()
    rng = np.random.default_rng(2)
    work = []
    for n in (40_000, 160_000):
        text = "".join(map(chr, rng.integers(97, 123, n)))
        chunks, seen = [text[i : i + 512] for i in range(0, n, 512)], []
        got = ce.joined_ids([(c.encode(), *encode(c.encode())) for c in chunks], lambda b: seen.append(len(b)) or encode(b), size)
        assert list(got) == t.encode(text, add_special_tokens=False).ids
        work.append(sum(seen) / n)
    assert work[1] < 1.5 * work[0] + 1 and work[1] < 8


def test_cuts_depend_on_content():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 60_000)
    one = set(ce.cut_points(body, np.array([0, len(body)])))
    other = {c - 777 for c in ce.cut_points(np.concatenate([rng.integers(97, 123, 777), body]), np.array([0, len(body) + 777]))}
    assert len(one & other) > 0.9 * len(one)


# --- 9: leaks --------------------------------------------------------------------------------------


def test_leaks(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words[:20])), (3, "few words only"), (4, None), (5, "")], "item_id bigint, text string")
    rows = [
        (1, "Xx yy " + ", ".join(w.upper() for w in words[3:15]) + "! zz"), (2, " ".join(words[3:14])), (3, None), (4, ""), (5, " ".join(reversed(words[:20]))), (6, "q " * 40_000 + "\n".join(words[8:20])), (7, " ".join(words[25:40])),
    ]
    got = {(r["item_id"], r["doc_id"]) for r in ls.leaks(frame(spark, rows), items, "k").collect()}
    assert got == {(1, 1), (2, 1), (1, 6), (2, 6)}
    assert ls.leaks(frame(spark, []), items, "k").count() == 0
    assert ls.leaks(frame(spark, rows), items.limit(0), "k").count() == 0


def test_item_blocks_give_the_same(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark_items.parquet")
    whole = {tuple(r) for r in ls.leaks(docs, items).collect()}
    assert len(ls.item_blocks(items, "item_id", "text", 500)) > 3
    old, ls.ITEM_WORDS = ls.ITEM_WORDS, 500
    try:
        defaults = ls.item_blocks.__defaults__
        ls.item_blocks.__defaults__ = (500,)
        assert {tuple(r) for r in ls.leaks(docs, items).collect()} == whole
    finally:
        ls.ITEM_WORDS, ls.item_blocks.__defaults__ = old, defaults


@pytest.mark.parametrize("size", [12, 40, 130])
def test_fingerprints_are_majorities_of_bits(size):
    rng = np.random.default_rng(size)
    words, doc = rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(3), np.repeat(np.arange(2), 200)
    start, prints = ls.window_prints(words, doc, size)
    assert len(start) == 2 * (201 - size)
    for s, p in zip(start[::17], prints[::17]):
        votes = [2 * int(((words[s : s + size] >> np.uint64(b)) & np.uint64(1)).sum()) > size for b in range(64)]
        assert int(p) == sum(1 << b for b in range(64) if votes[b])


def test_fingerprints_within_radius_are_all_found():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    index = ls.ItemIndex(np.arange(1), items, np.zeros(300, np.int64))
    probe = index.prints.copy()
    for i in range(len(probe)):
        for b in rng.choice(64, 3, replace=False):
            probe[i] ^= np.uint64(1) << np.uint64(b)
    d, i = index.candidates(probe)
    assert {(k, k) for k in range(len(probe))} <= set(zip(d.tolist(), i.tolist()))


def test_shingle_similarity():
    a = np.array([[1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]], np.uint64)
    b = np.array([[1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 7]], np.uint64)
    assert ls.shingle_similarity(a, b).tolist() == [1.0, 1 / 3]


def test_near_copies_of_whole_items(spark):
    words = [f"w{i}" for i in range(67)]
    changed, inserted = words[:30] + ["other"] + words[31:], words[:30] + ["more"] + words[30:]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "few words only")], "item_id bigint, text string")
    rows = [(1, "a b c " + " ".join(changed) + " d e"), (2, "a " + " ".join(words[:30] + words[31:]) + " d"), (3, " ".join(inserted)), (4, " ".join(words[1:])), (5, " ".join(words[:40])), (6, "few words only"), (7, " ".join(w if i % 9 else "x" for i, w in enumerate(words))), (8, None)]
    got = {(r["item_id"], r["doc_id"]): r["similarity"] for r in ls.leaks(frame(spark, rows), items, "k", exact=False).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (1, 4)}
    assert got[1, 1] == pytest.approx(58 / 68)


@pytest.mark.parametrize("seed", range(4))
def test_near_copies_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    items = [rng.integers(0, 2**62, 3 + int(rng.integers(10, 40))).astype(np.uint64) for _ in range(12)]
    items += [np.tile(items[0][:3], 8), np.concatenate([items[1], items[1]])]
    docs = []
    for x in items:
        for _ in range(12):
            y = list(x)
            for _ in range(int(rng.integers(0, 4))):
                k = int(rng.integers(0, len(y)))
                y = [y[:k] + y[k + 1 :], y[:k] + [np.uint64(7)] + y[k:], y[:k] + [np.uint64(7)] + y[k + 1 :]][int(rng.integers(0, 3))]
            docs.append(np.array([np.uint64(1)] * int(rng.integers(0, 3)) + y + [np.uint64(2)] * int(rng.integers(0, 3)), np.uint64))

    def flat(x):
        return np.concatenate(x), np.repeat(np.arange(len(x)), [len(r) for r in x])

    index = ls.NearIndex(np.arange(len(items)), *flat(items), 0.8)
    shingles, doc = ls.shingled(*flat(docs))
    got = {(d, i) for d, i in index.candidates(shingles, doc) if len(index.similar(i, shingles[doc == d]))}
    wanted = set()
    for d, y in enumerate(docs):
        for i, x in enumerate(items):
            a = [tuple(x[k : k + 5]) for k in range(len(x) - 4)]
            b = [tuple(y[k : k + 5]) for k in range(len(y) - 4)]
            size = min(len(a), len(b))
            for s in range(len(b) - size + 1):
                ca, cb = Counter(a), Counter(b[s : s + size])
                if (ca & cb).total() / (ca | cb).total() >= 0.8:
                    wanted.add((d, i))
    assert got == wanted and len(wanted) > len(items)
