from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.operators import bpe, classify, codec, counts, evaluate, sampling
from corpusloom.operators import sentences as sn


def column(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["o"] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_sentence_goldens(spark):
    given = ['Hi there. "Ok!" yes? tail', "ሰላም። እንዴት ነህ፧", "... hello.", 'say "hi"', "a\nb.\r\nc", "!!!", "", None]
    wanted = [["Hi there.", '"Ok!"', "yes?", "tail."], ["ሰላም።", "እንዴት ነህ፧"], ["hello."], ['say "hi"'], ["a.", "b.", "c."], [], [], None]
    assert column(spark, sn.sentence_array, given) == wanted


def test_numbers_are_digits_of_any_kind(spark):
    df = spark.createDataFrame([("a ² ①② ١٢ x² ፩ 7",)], "text string")
    assert {r["surface"] for r in counts.word_counts(df).collect()} == {w if i == 0 else " " + w for i, w in enumerate("a ² ①② ١٢ x² ፩ 7".split()) if not w.isdigit()}


def test_clauses_and_surfaces(spark):
    df = spark.createDataFrame([("a, b: c",), ("the cat 12 sat",), (None,), ("",)], "text string")
    assert {(r["surface"], r["n"]) for r in counts.word_counts(df).collect()} == {("a,", 1), (" b", 1), ("c", 1), ("the", 1), (" cat", 1), (" sat", 1)}
    assert column(spark, lambda c: counts.clauses(c), ["a, b: c"]) == [["a, b", " c"]]
    assert counts.clause_counts(spark.createDataFrame([(" foo",), (" foo",), ("a b",), ("a b",), ("c d",)], "text string")).count() == 1


def test_pairs(spark):
    df = spark.createDataFrame([(["a", "a", "a"], 5), (["x"], 3)], "units array<string>, n bigint")
    assert [tuple(r) for r in counts.pair_counts(df).collect()] == [("a", "a", 10)]


def test_family_of_files(spark):
    aliases = classify.alias_table(spark, {"bantou": "xhosa isixhosa sw", "maghrebi": "arabic egypt", "kwa": "akan"})
    files = spark.createDataFrame([("isiXhosa_dataset.txt",), ("egypt_Arabic.txt",), ("akan_1.txt",), ("bantu.txt",), ("answers.txt",)], "file string")
    got = {r["file"]: r["family"] for r in classify.file_families(files, aliases).collect()}
    assert got == {"isiXhosa_dataset.txt": "bantou", "egypt_Arabic.txt": "maghrebi", "akan_1.txt": "kwa", "bantu.txt": None, "answers.txt": None}


def test_typologies(spark):
    assert column(spark, classify.name_typology, ["agglutination_1.txt", "yoruba-news.txt", "misc.txt"]) == ["agglutination", "analytic", "fusional"]
    assert column(spark, classify.line_typology, ["the dog", "awon omo", "umuntu ngumuntu", "__U_1234__", "[U+1EB9 X] a", ""]) == ["fusional", "analytic", "agglutination", "fusional", "analytic", "agglutination"]


def test_routing_falls_back_to_all_lines(spark):
    df = spark.createDataFrame([("swahili.txt", "a"), ("zulu.txt", "b")], "file string, text string")
    got = Counter(r["typology"] for r in classify.routed(df).collect())
    assert got == {"agglutination": 2, "fusional": 2, "analytic": 2}
    assert classify.routed(df.limit(0)).count() == 0


def test_balanced_sample(spark):
    rows = [("big.txt", i, "s") for i in range(500)] + [("small.txt", i, "t") for i in range(7)] + [(None, 1, "u")] * 0
    df = spark.createDataFrame(rows, "file string, k int, text string")
    one = sampling.balanced(df, ("file", "k"))
    assert Counter(r["file"] for r in one.collect()) == {"big.txt": 7, "small.txt": 7}
    assert {r["k"] for r in one.collect()} == {r["k"] for r in sampling.balanced(df.repartition(7), ("file", "k")).collect()}
    order = df.withColumn("d", sampling.draw_key(rules.SEED, "file", "k")).orderBy("d").where("file = 'big.txt'").limit(7)
    assert {r["k"] for r in order.collect()} == {r["k"] for r in one.where("file = 'big.txt'").collect()}
    assert sampling.balanced(df.limit(0), ("file", "k")).count() == 0
    assert sampling.subsample(df, ("file", "k"), 0.001).count() == 1
    third = {(r["file"], r["k"]) for r in sampling.subsample(df, ("file", "k"), 0.34).collect()}
    order = df.withColumn("d", sampling.draw_key(rules.SEED, "file", "k")).orderBy("d").limit(int(507 * 0.34))
    assert third == {(r["file"], r["k"]) for r in order.collect()} and len(third) == 172
    assert sampling.subsample(df, ("file", "k"), 1.0).count() == 507 and sampling.subsample(df.limit(0), ("file", "k"), 0.5).count() == 0
    assert sampling.shuffled(df, ("file", "k")).count() == 507


def slow_bpe(words, merges, vocabulary, phrases=False, most_words=3):
    """The merge loop, recounting everything each time."""
    seqs = [(list(u), n) for u, n in words]
    guard, out, refused = bpe.Guard(vocabulary, phrases, most_words), [], set()
    while len(out) < merges:
        c = Counter()
        for u, n in seqs:
            for p in zip(u, u[1:]):
                c[p] += n
        live = [(-n, p) for p, n in c.items() if p not in refused and n >= 2]
        if not live:
            break
        _, (a, b) = min(live)
        if not guard.accepts(a + b):
            refused.add((a, b))
            continue
        out.append((a, b, c[(a, b)]))
        new = []
        for u, n in seqs:
            v, i = [], 0
            while i < len(u):
                if i + 1 < len(u) and (u[i], u[i + 1]) == (a, b):
                    v.append(a + b)
                    i += 2
                else:
                    v.append(u[i])
                    i += 1
            new.append((v, n))
        seqs = new
    return out


def test_training_goldens():
    words = [(list("aab"), 3), (list(" aab"), 2), (list("ab"), 4)]
    ascii_ = {chr(c) for c in rules.ASCII}
    assert [a + b for a, b, _ in bpe.merge_loop(words, 9, bpe.Guard(set(ascii_)))] == ["ab", "aab", " aab"]
    assert [a + b for a, b, _ in bpe.merge_loop(words, 9, bpe.Guard(ascii_ | {"ab"}))] == ["aa", "aab", " aab"]
    assert bpe.merge_loop([(list("xy"), 1)], 9, bpe.Guard(set(ascii_))) == []
    assert bpe.merge_loop([(list("12"), 9)], 9, bpe.Guard(set(ascii_))) == []
    clauses = [(["the", " cat", " sat"], 3), (["The", " cat"], 2), ([" big", " cat", " sat"], 2)]
    two = bpe.merge_loop(clauses, 9, bpe.Guard(set(), True, 2))
    assert [a + b for a, b, _ in two] == [" cat sat", "The cat"]
    three = bpe.merge_loop(clauses, 9, bpe.Guard(set(), True, 3))
    assert [a + b for a, b, _ in three] == [" cat sat", "the cat sat", " big cat sat", "The cat"]


@pytest.mark.parametrize("seed", range(12))
def test_merge_loop_equals_recount(seed):
    r = random.Random(seed)
    words = list({"".join(r.choice("abc ") for _ in range(r.randint(2, 9))) for _ in range(25)})
    words = [(list(w), r.randint(1, 6)) for w in words]
    assert bpe.merge_loop(words, 30, bpe.Guard(set("abc "))) == slow_bpe(words, 30, set("abc "))


def test_distributed_rounds_equal_loop(spark):
    r = random.Random(5)
    words = sorted({"".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(60)})
    words = [(list(w), r.randint(1, 40)) for w in words]
    df = spark.createDataFrame(words, "units array<string>, n bigint")
    base = set("abcdefgh")
    assert bpe.merge_rounds(df, 12, bpe.Guard(set(base))) == bpe.merge_loop(words, 12, bpe.Guard(set(base)))


def test_distributed_rounds_after_refusals_equal_loop(spark):
    """Refused pairs still make new ones, and a round of refusals alone isn't the end."""
    words = [(list("ab"), 210), (list("abc"), 90), (list("de"), 80), (list("xy"), 200), (list("yz"), 150)]
    df = spark.createDataFrame(words, "units array<string>, n bigint")
    known = {*"abcdexyz", "ab"}  # refused in the first round, which ends at yz
    wanted = bpe.merge_loop(words, 4, bpe.Guard(set(known)))
    assert [a + b for a, b, _ in wanted] == ["xy", "yz", "bc", "abc"]
    assert bpe.merge_rounds(df, 4, bpe.Guard(set(known))) == wanted
    words = [([f"l{i}", f"r{i}"], 100 - i) for i in range(20)]
    df = spark.createDataFrame(words, "units array<string>, n bigint")
    known = {x for u, _ in words for x in u} | {f"l{i}r{i}" for i in range(18)}
    wanted = bpe.merge_loop(words, 5, bpe.Guard(set(known)))
    assert len(wanted) == 2 and bpe.merge_rounds(df, 5, bpe.Guard(set(known)), most=1) == wanted
    words = [(list("aaa"), 50), (list("bc"), 45)]
    df = spark.createDataFrame(words, "units array<string>, n bigint")
    assert bpe.merge_rounds(df, 2, bpe.Guard(set("abc"))) == bpe.merge_loop(words, 2, bpe.Guard(set("abc")))


def test_budgets():
    assert bpe.budgets(20_000, 300) == {"agglutination": (5516, 1379), "fusional": (4482, 2413), "analytic": (2364, 3546)}
    assert sum(a + b for a, b in bpe.budgets(50, 95).values()) <= 0


def test_train_small(spark):
    lines = [("agglutination_1.txt", "the cat sat on the mat"), ("fusional_1.txt", "the cat sat é é é"), ("analytic.txt", "the cat ran"), ("analytic.txt", None), ("analytic.txt", "  ")] * 3
    got = bpe.train(spark.createDataFrame(lines, "file string, text string"), 140).collect()
    ids = {r["token"]: r["token_id"] for r in got}
    assert sorted(ids.values()) == list(range(len(ids))) and len(ids) <= 140
    assert "[U+00E9 LATIN SMALL LETTER E WITH ACUTE]" in ids and ids["~"] == max(ids.values())
    tokens = [r["token"] for r in sorted(got, key=lambda r: r["token_id"])]
    learned = tokens[: len(ids) - 96]
    assert learned == sorted(learned, key=lambda t: (-bpe.unit_length(t), -len(t), t))
    assert bpe.train(spark.createDataFrame([], "file string, text string"), 120).count() == 95


def slow_encode(text, ids):
    """Fewest tokens by dynamic programming, shortest next token on ties; written without a trie."""
    n = len(text)
    best: list[tuple[int, list[int]]] = [(0, [])] * (n + 1)
    for i in range(n - 1, -1, -1):
        options = [(best[i + 1][0] + 1, i + 1, ids.get(text[i], 0))]
        options += [(best[j][0] + 1, j, ids[text[i:j]]) for j in range(i + 2, n + 1) if text[i:j] in ids]
        c, j, t = min(options, key=lambda o: (o[0], o[1]))
        best[i] = (c, [t, *best[j][1]])
    return best[0][1]


def test_encoder_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        vocabulary = {t: i for i, t in enumerate(sorted({*"abc", *("".join(r.choice("abc") for _ in range(r.randint(2, 4))) for _ in range(8))}))}
        text = "".join(r.choice("abcd") for _ in range(r.randint(0, 14)))
        assert codec.MinTokenEncoder(vocabulary).encode(text) == slow_encode(text, vocabulary)


def test_codec_columns(spark):
    vocabulary = {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4}
    df = spark.createDataFrame([("abc",), ("",), (None,), ("axb",)], "text string").select("text", codec.encoder(vocabulary)("text").alias("ids"))
    back = codec.decoded(df, vocabulary, to="back").collect()
    assert [(r["ids"], r["back"]) for r in back] == [([0, 4], "abc"), ([], ""), ([], ""), ([0, 0, 1], "aab")]
    odd = spark.createDataFrame([([-1, 0, 10**9, 1],), (None,), ([],)], "ids array<int>")
    assert [r["t"] for r in codec.decoded(odd, vocabulary, to="t").collect()][0] == "ab"
    with pytest.raises(TypeError):
        codec.encoder(vocabulary)(["abc"])


def test_segmentation():
    assert codec.segment(["abc"], {"ab", "bc"}) == ["ab", "c"]
    assert codec.segment(["abc"], {"ab", "bc", "abc"}) == ["abc"]
    r = random.Random(3)
    for _ in range(300):
        known = {"".join(r.choice("abc") for _ in range(r.randint(2, 4))) for _ in range(6)}
        w = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        cur, again = list(w), True
        while again:
            again = False
            for i in range(len(cur) - 1):
                if cur[i] + cur[i + 1] in known:
                    cur[i : i + 2] = [cur[i] + cur[i + 1]]
                    again = True
                    break
        assert codec.segment([w], known) == cur


def test_report(spark):
    vocabulary = {chr(c): i for i, c in enumerate(rules.ASCII)} | {"the ": 200}
    df = spark.createDataFrame([("a.txt", "the the x"), ("a.txt", ""), ("b.txt", "ab"), ("c.txt", None)], "file string, text string")
    got = {r["file"]: r for r in evaluate.report(df, vocabulary).collect()}
    assert set(got) == {None, "a.txt", "b.txt"}
    assert got[None]["tokens"] == 5 and got[None]["passed"] and got["a.txt"]["chars_per_token"] == 3.0
    assert re.match("true", str(got["b.txt"]["passed"]).lower())


@pytest.mark.parametrize("seed", range(10))
def test_distributed_merges_equal_the_loop(spark, seed):
    """Random vocabularies, both stages; pairs that are refused still make others."""
    r = random.Random(seed)
    if seed % 2:
        words = [([r.choice(["the", " cat", " sat", " big", "The", " on"]) for _ in range(r.randint(2, 5))], r.randint(2, 9)) for _ in range(14)]
        guard = lambda: bpe.Guard({"the cat", " cat sat"}, True, 3)
    else:
        words = [([r.choice("abxl") for _ in range(r.randint(2, 6))], r.randint(2, 20)) for _ in range(14)]
        guard = lambda: bpe.Guard({"ab", "xl", "ba"})
    table = spark.createDataFrame(words, "units array<string>, n bigint")
    assert bpe.learn(table, 12, guard(), most=0) == bpe.learn(table, 12, guard())


def test_refused_pairs_bound_a_round(spark):
    words = [(list(w), n) for w, n in (("xlr", 20), ("xl", 4), ("abc", 21), ("ab", 1), ("pq", 8))]
    table = spark.createDataFrame(words, "units array<string>, n bigint")
    assert bpe.learn(table, 6, bpe.Guard({"xl"}), most=0) == bpe.merge_loop(sorted(words), 6, bpe.Guard({"xl"}))


def test_alias_table_from_a_file(spark, tmp_path):
    (tmp_path / "aliases.json").write_text('{"one": ["abc", "x-yz"], "two": "defg hij"}', encoding="utf-8")
    rows = {(r["family"], r["family_rank"], r["alias"], r["bare"]) for r in classify.alias_table(spark, f"file://{tmp_path}/aliases.json").collect()}
    assert rows == {("one", 0, "abc", "abc"), ("one", 0, "x-yz", "xyz"), ("two", 1, "defg", "defg"), ("two", 1, "hij", "hij")}
    with pytest.raises(ValueError, match="aliases"):
        classify.alias_table(spark, {"a": [f"n{i}" for i in range(classify.MOST_ALIASES + 1)]})


def test_families_of_the_project_files(spark, sf_dir):
    """Files of the project's families; of others, parts of the name may be an alias."""
    files = spark.read.parquet(f"{sf_dir}/dataset_files.parquet")
    got = {r["file"]: r["family"] for r in classify.file_families(files.select("file"), classify.alias_table(spark)).collect()}
    assert all(got[r["file"]] == r["family"] for r in files.where("family IS NOT NULL").collect())


def test_parts_encode_as_the_whole():
    """Tokens across spaces, with a space at their end or start, and several spaces."""
    r = random.Random(3)
    vocabulary = {t: i for i, t in enumerate(["a", "b", " ", "ab", " a", "a ", "b a", " ab a", "  ", "a b ", "ba", " b"])}
    coder = codec.MinTokenEncoder(vocabulary)
    for _ in range(3000):
        text = "".join(r.choice("ab  c") for _ in range(r.randint(0, 30)))
        assert coder.encode(text) == coder._shortest(text)
    coder.PARTS = 2
    assert coder.encode("a b ab ba") == coder._shortest("a b ab ba") and len(coder.known) <= 2


@pytest.mark.parametrize("phrases", [False, True])
def test_large_tables_are_cut_at_rare_pairs(spark, monkeypatch, phrases):
    """A table above the limit is trained in pieces, several times over, with the merges of the whole and without a job for every few of them."""
    r = random.Random(11)
    units = [" " + c for c in "abcdefghijklm"] if phrases else list("aaabbcdefghijklmno ")
    words = sorted({tuple(r.choice(units) for _ in range(r.randint(2, 12))) for _ in range(1200)})
    words = [(list(w), r.randint(1, 60)) for w in words]
    df = spark.createDataFrame(words, "units array<string>, n bigint")
    guard = lambda: bpe.Guard({*units, "ab", "bc"}, phrases, 3)
    wanted = bpe.merge_loop(words, 120, guard())
    assert wanted[:20] == slow_bpe(words, 20, {*units, "ab", "bc"}, phrases)
    seen, cut = [], bpe.cut_at_rare_pairs
    monkeypatch.setattr(bpe, "cut_at_rare_pairs", lambda *a: seen.append(1) or cut(*a))
    monkeypatch.setattr(bpe, "merge_rounds", lambda *a, **k: pytest.fail("a job for every few merges"))
    assert bpe.learn(df, 120, guard(), most=4000) == wanted and len(seen) > 1


@pytest.mark.parametrize("seed", range(6))
def test_merge_loop_with_units_that_are_learned_again(seed):
    r = random.Random(seed)
    words = [([r.choice(["a", "b", "ab", "ba", "aa", "abb"]) for _ in range(r.randint(1, 9))], r.choice([1, 2, 40, 700])) for _ in range(20)]
    assert bpe.merge_loop(words, 30, bpe.Guard(set())) == slow_bpe(words, 30, set())


def test_words_of_markers_are_remembered():
    """A word of a few characters beyond ASCII is long as stored, but still a word."""
    marks = ["U+1230 ETHIOPIC SYLLABLE SA", "U+120B ETHIOPIC SYLLABLE LAA", "U+121D ETHIOPIC SYLLABLE ME"]
    word = "".join(f"[{m}]" for m in marks).replace(" ", "_")
    coder = codec.MinTokenEncoder({chr(c): i for i, c in enumerate(rules.ASCII)} | {" a": 300})
    assert coder.encode(word + " a") == coder._shortest(word + " a")
    assert len(word) > 64 and word in coder.known
    marked = "".join(f"[{m}]" for m in marks)
    coder = codec.MinTokenEncoder({chr(c): i for i, c in enumerate(rules.ASCII)} | {f"[{m}]": 200 + i for i, m in enumerate(marks)} | {" a": 300})
    assert coder.encode(marked + " a") == [200, 201, 202, 300] and marked in coder.known


def test_a_text_is_normalised_and_encoded_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "  "), (5, "é")], "k int, text string")
    back = evaluate.encoded_corpus(df, {chr(c): i for i, c in enumerate(rules.ASCII)}, keep=("k",))
    plan = back.where("back <> ''").select("k", F.size("ids"), F.col("text") == F.col("back"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("MapInArrow") == 1 and "ArrowEvalPython [run" not in plan
    assert back.columns == ["k", "text", "ids", "back"]
    got = {r["k"]: (r["text"] == r["back"], len(r["ids"])) for r in back.collect()}
    assert got[1] == (True, 3) and got[5][0] and set(got) == {1, 5}


def test_report_measures_each_text_once(spark):
    """Above the rollup's repeated rows no text is left; a text that doesn't come back has its own length."""
    df = spark.createDataFrame([("a.txt", "a x"), ("a.txt", "aa"), ("b.txt", "x")], "file string, text string")
    made = evaluate.report(df, {"ab": 0, "a": 1, " ": 2})
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan[: plan.index("Expand")] and "text" not in plan[plan.index("Expand") :].split("\n")[0]
    got = {r["file"]: (r["sentences"], r["words"], r["chars_in"], r["chars_out"], r["tokens"], r["exact"], r["passed"]) for r in made.collect()}
    assert got == {"a.txt": (2, 3, 5, 6, 5, 1, False), "b.txt": (1, 1, 1, 2, 1, 0, False), None: (3, 4, 6, 8, 6, 1, False)}
