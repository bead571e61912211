"""The plans for columns agree with one another and with the kernel; rows and lists of edges agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiweave import api
from lexiweave.functions import edges as E
from lexiweave.operators import alignments, columns
from lexiweave.operators.lexicon import lexicon_frame
from lexiweave.operators.provenance import transduce
from lexiweave.operators.transducers import Transducer
from lexiweave.plans.mapping import Mapping
from lexiweave.sources import files

TEXTS = ["banana bread", "", None, "abcabc aabb", "ÀÉ é naïve", "a.b(c)$1\\2 {x}", "xyz_zyx 12", "tab\tnew\nline"]
RULES = [
    ([("a", "b"), ("b", "c")], {}), ([("an", "x"), ("x", "an")], {"prevent_feeding": True}), ([("a", "$1\\"), (r"\.", "dot")], {}), ([("a", "A", r"\b", ""), ("b", "B", "", r"\b")], {}),
    ([("é", "E", "", "")], {"case_sensitive": False}), ([("[ab]+", "v", "", "c|$")], {}), ([("b", ""), ("c", "")], {}), ([("a|n", "o", "b", "")], {"out_delimiter": "-"}), ([("(?i)A", "q")], {}), ([("a{1}b{2}", "b{2}a{1}")], {}),
]


@pytest.mark.parametrize("rules, options", RULES)
def test_plans_agree(spark, rules, options):
    m = Mapping([dict(zip(("in", "out", "context_before", "context_after"), r)) for r in rules], norm_form="none", **options)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    want = [None if t is None else transduce(m, t).output for t in TEXTS]
    made = Transducer(m)
    assert [r[0] for r in df.select(columns.convert(made, F.col("text"))).collect()] == want
    assert [r[0] for r in df.select(columns.arrow_column(made, F.col("text"))).collect()] == want
    native = columns.regex_column(m, F.col("text"))
    if native is not None:
        assert [r[0] for r in df.select(native).collect()] == want
    assert [None if r[0] is None else r[0].output for r in df.select(columns.align(made, F.col("text"))).collect()] == want


def test_choice_of_plans():
    assert columns.translate_table(Mapping([{"in": "a", "out": "b"}, {"in": "c", "out": ""}])) == ("ac", "b")
    assert columns.translate_table(Mapping([{"in": "a", "out": "b"}, {"in": "b", "out": "c"}])) is None
    assert columns.translate_table(Mapping([{"in": "a", "out": "bc"}])) is None and columns.java_pattern(Mapping([{"in": "a", "out": "b"}]), r"\d") is None


def test_edges_over_rows(spark):
    rng = np.random.default_rng(0)
    graphs = []
    for _ in range(30):
        n, m = int(rng.integers(1, 9)), int(rng.integers(1, 9))
        graphs.append((n, m, [(int(a), None if rng.random() < 0.2 else int(b)) for a, b in zip(rng.integers(0, n, 12), rng.integers(0, m, 12))]))
    rows = [(g, a, b, k) for g, (_, _, e) in enumerate(graphs) for k, (a, b) in enumerate(e)]
    df = spark.createDataFrame(rows, "g int, i int, o int, ord int")
    texts = spark.createDataFrame([(g, "abcdefghi"[:n], "ABCDEFGHI"[:m]) for g, (n, m, _) in enumerate(graphs)], "g int, input string, output string")
    fixed = alignments.repair(df, ["g"])
    got: dict = {}
    for r in fixed.orderBy("g", "i", "ord").collect():
        got.setdefault(r.g, []).append((r.i, r.o))
    pieces: dict = {}
    for r in alignments.segments(fixed, texts, ["g"]).orderBy("g", "pos").collect():
        pieces.setdefault(r.g, []).append((r.in_sub, r.out_sub))
    for g, (n, m, e) in enumerate(graphs):
        want = E.repair(e)
        assert sorted(got[g], key=str) == sorted(want, key=str)
        assert pieces[g] == E.segments("abcdefghi"[:n], "ABCDEFGHI"[:m], want)
    both = alignments.compose(fixed, fixed, ["g"]).collect()
    assert {(r.g, r.i, r.o) for r in both} == {(g, a, b) for g, (_, _, e) in enumerate(graphs) for a, b in E.compose(E.repair(e), [x for x in E.repair(e)]) if b is not None or True} - {(g, a, None) for g in range(30) for a in range(9)} | {(r.g, r.i, r.o) for r in both if r.o is None}


def test_appending_is_associative_and_equal_over_rows(spark):
    made = Transducer(Mapping([{"in": "a", "out": ""}, {"in": "b", "out": "xx"}], norm_form="none"))
    words = ["ab", "a", "ba", "aab", "cc"]
    whole = made(words[0])
    for w in words[1:]:
        whole += made(w)
    rest = made(words[1])
    for w in words[2:]:
        rest += made(w)
    assert (made(words[0]).append(rest)).output_string == whole.output_string
    parts = spark.createDataFrame([(1, k, w, made(w).output_string) for k, w in enumerate(words)], "g int, pos int, input string, output string")
    edges = spark.createDataFrame([(1, k, j, a, b) for k, w in enumerate(words) for j, (a, b) in enumerate(made(w).edges)], "g int, pos int, ord int, i int, o int")
    texts, moved = alignments.appended(parts, edges, ["g"])
    assert texts.collect()[0][1:] == (whole.input_string, whole.output_string)
    assert {(r.i, r.o) for r in moved.collect()} == set(whole.edges)


def test_files_in_spark(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("h}HH e}EH l|l}L o}OW\n\nb}_ o}_\n")
    assert {r.word: [tuple(u) for u in r.units] for r in lexicon_frame(spark, str(tmp_path / "lex.txt")).collect()} == {"hello": [(1, "HH"), (1, "EH"), (2, "L"), (1, "OW")], "bo": [(1, ""), (1, "")]}
    (tmp_path / "g.psv").write_text("# note\nund|und-ipa|yes|jes\nx|y|short\n")
    assert [tuple(r) for r in files.golden_rows(spark, str(tmp_path / "g.psv")).collect()] == [("und", "und-ipa", "yes", "jes")]
    (tmp_path / "r.csv").write_text("in,out\na,b\nc,d,e\n")
    assert [(r.ord, r["in"], r.context_before) for r in files.read_rules(spark, str(tmp_path / "r.csv")).orderBy("ord").collect()] == [(0, "a", ""), (1, "c", "e")]
    api.registry().write(spark, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/mappings")).count() == 4 and spark.read.parquet(str(tmp_path / "db/edges")).count() == 4


@pytest.mark.parametrize("inventory, case_sensitive", [(["'", "'s", "ts"], True), (["TS", "-a", "\\\\Q", "é|.."], False), (["x"], True)])
def test_tokens_as_expressions(spark, inventory, case_sensitive):
    from lexiweave.operators.tokenizers import InventoryTokenizer, LexiconTokenizer, Tokenizer, tokens
    from lexiweave.operators.lexicon import parse_alignment

    texts = ["ts'nj! - 's", "", None, "a-a -A tS..é .É", "\\Q \\E x\ny", "a" * 20000 + "-" * 20000, "日本 ½½ \U0001f642\U0001f642a"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for tok in (InventoryTokenizer([Mapping([{"in": i, "out": "x"} for i in inventory], case_sensitive=case_sensitive)]), Tokenizer(), Tokenizer(dot_is_letter=True), LexiconTokenizer(Mapping(type="lexicon", alignments=[parse_alignment("a-a}x")]))):
        got = {r.k: r.tokens for r in tokens(df, "text", tok).collect()}
        for k, t in enumerate(texts):
            assert (got[k] is None) == (t is None)
            if t is not None:
                assert [(x.text, x.is_word) for x in got[k]] == [(x.text, x.is_word) for x in tok.tokenize_text(t)]


def test_pronouncing_dictionary(spark, tmp_path):
    from lexiweave.sources.cmudict import read_dictionary

    (tmp_path / "d").write_text(";;; note\nhello HH AH0 L OW1 # common\nhello(2) HH EH0 L OW1\n\nodd XX\n")
    got = read_dictionary(spark, str(tmp_path / "d"), {"HH": "h", "AH": "ʌ", "L": "l", "OW": "oʊ"}).collect()
    assert [tuple(r) for r in got] == [("hello", "hʌloʊ"), ("odd", None)]


def test_frames(spark):
    df = spark.createDataFrame([("nunavut",), (None,)], "text string")
    rows = api.convert_frame(df, "text", "und", "eng-arpabet", alignments=True).collect()
    assert rows[0].converted.output == "N UW N AA V UW T " and len(rows[0].converted.tiers) == 4 and rows[1].converted is None or rows[1].converted.output is None
    assert [r[0] for r in df.select(api.convert_column(F.col("text"), "und", "und-ipa")).collect()] == ["nunavut", None]


def test_alignments_of_corpora_are_the_kernel_s_and_take_little_memory(spark, monkeypatch):
    import tracemalloc

    from lexiweave.operators.transducers import CompositeTransducer, Graph

    monkeypatch.setattr(columns, "ALIGNED_CHARS", 16)
    texts = [*TEXTS, "bb", "banab nab \u0130", "a" * 50]
    chains = [[("a", "")], [("b", "xyz"), ("n", "")], [("an", "x"), ("x", "")], [("a{1}b{2}", "b{2}a{1}")]]
    for one, options in zip(chains, ({"out_delimiter": "-"}, {"case_sensitive": False, "preserve_case": True}, {"prevent_feeding": True}, {})):
        chain = CompositeTransducer([Transducer(Mapping([{"in": a, "out": b} for a, b in one], norm_form="none", **options)), Transducer(Mapping([{"in": "b", "out": "vv"}]))])
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1)
        for r in columns.aligned(df, "text", chain, ["output", "edges", "segments"]).collect():
            g = None if r.text is None else Graph(chain.outcomes(r.text))
            got = r.output, r.edges and [tuple(e) for e in r.edges], r.segments and [tuple(x) for x in r.segments]
            assert got == ((None,) * 3 if g is None else (g.output_string, g.alignments(), g.substring_alignments()))
    chain = CompositeTransducer([Transducer(Mapping([{"in": a, "out": a + a}], norm_form="none")) for a in "no"])
    tracemalloc.start()
    columns._aligned(chain, ["no one knows " * 100] * 100, ["output", "edges"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130_000 * 150  # lists of dictionaries take over 700 bytes a character


def test_appended_lists_are_the_object_s_and_keep_groups_without_edges(spark):
    """Edges stay in the rows of their parts; deletions reach over parts; groups of null or empty texts and without a key stay."""
    rules = Transducer(Mapping([{"in": "a", "out": ""}, {"in": "b", "out": "xx"}], norm_form="none"))
    groups = {0: ["a", "aab", "", None, "a", "cc"], 1: ["a", "aa"], 2: [None, None], 3: [""], None: ["b", "a"], 5: ["a", "a", "b"]}
    df = spark.createDataFrame([(g, k, t) for g, ts in groups.items() for k, t in enumerate(ts)], "g int, pos int, input string")
    parts = alignments.appended_lists(columns.aligned(df, "input", rules, ["output", "edges"]), ["g"])
    assert parts.count() == df.count()
    got = {g: [e for r in parts.orderBy("pos").collect() if r.g == g for e in r.edges or ()] for g in groups}
    whole = {r.g: tuple(r)[1:] for r in alignments.joined_lists(parts, ["g"]).collect()}
    for g, texts in groups.items():
        want = None
        for t in texts:
            if t is not None:
                want = rules(t) if want is None else want.append(rules(t))
        assert [tuple(e) for e in got[g]] == (want.edges if want else [])
        assert whole[g] == ((want.input_string, want.output_string, len({a for a, _ in want.edges})) if want else (None, None, None))


def test_lexicon_tokens_leave_the_worker_in_bounded_batches(spark, monkeypatch):
    """Many tokens of one long text without white space, too: batches are small, and what cannot be a word is not looked up."""
    import time

    from lexiweave.operators import tokenizers
    from lexiweave.operators.lexicon import parse_alignment

    tok = tokenizers.LexiconTokenizer(Mapping(type="lexicon", alignments=[parse_alignment("a-a}x"), parse_alignment("it's}y")]))
    monkeypatch.setattr(tokenizers, "CUT_ROWS", 7)
    texts = [None, "", "IT'S a-a it'sx -a-a- b", "a-" * 30, "it's it's"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1)
    want = [(k, n, x.text, x.is_word) for k, t in enumerate(texts) if t for n, x in enumerate(tok.tokenize_text(t))]
    assert sorted(tuple(r) for r in tokenizers.token_rows(df, ["k"], "text", tok).collect()) == want
    assert [x.text for x in tok.tokenize_text("a-a'a-a")] == ["a-a", "'", "a-a"]
    began = time.perf_counter()
    assert len(tok.tokenize_text("x." * 20_000)) == 40_000
    assert time.perf_counter() - began < 10  # every beginning with every end would take hours


def test_literal_rules_without_case_read_what_patterns_do():
    """Literal rules replace strings, but for texts with other characters that a pattern without case matches."""
    from lexiweave.operators.provenance import rewrite

    m = Mapping([{"in": "s", "out": "z"}, {"in": "k", "out": "c"}, {"in": r"\?", "out": "i"}, {"in": "ia", "out": ""}], norm_form="none", case_sensitive=False)
    assert [r.plain for r in m.compiled] == ["s", "k", "?", "ia"]
    for text in ("Sk?a Ska", "\u017fS?A", "\u212ak", "\u0130a \u0131a IA", "?" * 9 + "aaa", ""):
        assert rewrite(m, text) == transduce(m, text).output


def test_case_of_long_texts_comes_back_as_that_of_short_ones():
    from lexiweave.operators.transducers import LONG

    made = Transducer(Mapping([{"in": "a", "out": "oo"}, {"in": "nn", "out": "u"}, {"in": "x", "out": ""}], norm_form="none", case_sensitive=False, preserve_case=True, case_equivalencies={"u": "#"}))
    text = "Anna XaNNa \u0130x \n# xX " * LONG
    assert made.text(text) == made.outcomes(text)[0].output
    single = Transducer(Mapping([{"in": "a", "out": "ο"}, {"in": "n", "out": "µ"}, {"in": "s", "out": "X"}], norm_form="none", case_sensitive=False, preserve_case=True, case_equivalencies={"µ": "#"}))
    for t in ("Anna aNNA # sS µ ſ x", "\u0130a A", "\\u0041A", ""):
        assert single.text(t) == single.outcomes(t)[0].output


def test_words_kept_are_bounded_in_characters(monkeypatch):
    from lexiweave.operators.transducers import TokenizingTransducer

    monkeypatch.setattr(columns, "CACHE_CHARS", 1000)
    words = columns._Words(TokenizingTransducer(Transducer(Mapping([{"in": "a", "out": "b"}])), columns.Tokenizer()))
    text = " ".join([f"a{k}" for k in range(2000)] + ["a" * 5000])
    assert words.text(text) == text.replace("a", "b")
    assert sum(len(k) + len(v) for k, v in words.cache.items()) < 1100


def test_pieces_of_one_character_join_the_class_of_word_characters():
    from lexiweave.operators.tokenizers import InventoryTokenizer, inventory_tokens

    plan = lambda pieces: str(inventory_tokens(F.col("t"), InventoryTokenizer([Mapping([{"in": p, "out": "x"} for p in pieces])])))
    assert "(?!" not in plan(["~", "'", "th", "t'"]) and "(?!" in plan(["-a"])


def test_checks_of_conversions_are_those_of_their_graphs():
    from lexiweave.operators import checks
    from lexiweave.queries import ARPABET

    made = api.make_g2p("und", "eng-arpabet", tokenize=False)
    for text in ("nunavut", "", "\u65e5\u672c", "d'\u00e9t\u00e9", "9\u00bd", "x:y", "Stra\u00dfe"):
        assert checks.check_text(made, text, arpabet=set(ARPABET)) == checks.check_outcome(made, made(text), arpabet=set(ARPABET))
