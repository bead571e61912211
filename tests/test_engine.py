"""Networks, tokenizers, lexicons, conversions, inventories, checks and files, in plain Python."""

import warnings
from unicodedata import normalize

import pytest

import lexiweave
from lexiweave import api, cli, service
from lexiweave.errors import IncorrectFileType, InvalidLanguageCode, MalformedMapping, MappingMissing, NeuralDependencyError, NoPath
from lexiweave.operators import checks, inventories
from lexiweave.operators.lexicon import apply_lexicon, parse_alignment
from lexiweave.operators.tokenizers import InventoryTokenizer, LexiconTokenizer, Tokenizer, split_gaps, Token
from lexiweave.operators.transducers import CompositeTransducer, TokenizingTransducer, Transducer
from lexiweave.plans.mapping import Mapping
from lexiweave.plans.network import LanguageNetwork, echart_nodes, node_link_data, node_link_graph
from lexiweave.sources import files
from lexiweave.sources.registry import Registry

LEXICON = ["m}M o|o}UW n}N", "w}W e}IH '}_ l|l}L", "h}_ u}_ s}_ h}_", "to-do}T", "e.g.}F"]


def lexicon(**options):
    return Mapping(type="lexicon", alignments=[parse_alignment(x) for x in LEXICON], in_lang="x", out_lang="y", case_sensitive=False, **options)


def test_network():
    import random

    g = LanguageNetwork([("p", "q"), ("q", "p"), ("p", "r"), ("q", "s"), ("r", "s"), ("s", "t"), ("p", "q")])
    g.add_node("alone")
    assert g.nodes == ["p", "q", "r", "s", "t", "alone"] and g.edges == [("p", "q"), ("p", "r"), ("q", "p"), ("q", "s"), ("r", "s"), ("s", "t")]
    assert g.shortest_path("p", "t") == ["p", "q", "s", "t"] and g.shortest_path("q", "q") == ["q"] and list(g.successors("p")) == ["q", "r"]
    rng = random.Random(3)
    for _ in range(60):  # against the closure of a relation
        edges = [(rng.randrange(7), rng.randrange(7)) for _ in range(9)]
        h, reach = LanguageNetwork(edges), set(edges)
        while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
            reach |= more
        for u in h.nodes:
            assert h.descendants(u) == {b for a, b in reach if a == u} - {u} and h.ancestors(u) == {a for a, b in reach if b == u} - {u}
            for v in h.nodes:
                assert h.has_path(u, v) == (u == v or (u, v) in reach)
    for bad, kind in ((("p", "no"), KeyError), (("t", "p"), ValueError), (("no", "p"), KeyError)):
        with pytest.raises(kind):
            g.shortest_path(*bad)
    assert node_link_graph(node_link_data(g)).edges == g.edges and len(node_link_graph(node_link_data(g))) == 6
    for bad in ({"directed": False}, {"multigraph": True}, {"nodes": []}, {"links": []}):
        with pytest.raises(ValueError):
            node_link_graph(bad)
    assert echart_nodes(g)[0] == {"name": "p", "symbolSize": 5, "id": "p"}
    g.clear()
    assert len(g) == 0


def test_tokenizers():
    words = lambda t, s: [x.text for x in t.tokenize_text(s)]
    assert words(Tokenizer(), "où sont 'les' clés?") == ["où", " ", "sont", " '", "les", "' ", "clés", "?"]
    assert len(words(Tokenizer(), "k'ā")) == 3 and len(words(InventoryTokenizer([Mapping([{"in": "'", "out": "x"}])]), "k'ā")) == 1
    two = InventoryTokenizer([Mapping([{"in": "KW|Z", "out": "x"}], case_sensitive=False), Mapping([{"in": "'{1}m{2}", "out": "m{2}'{1}"}])])
    assert words(two, "kw'mo?-") == ["kw'mo", "?-"] and words(Tokenizer(dot_is_letter=True), "x.y z. w") == ["x.y", " ", "z", ". ", "w"]
    t = LexiconTokenizer(lexicon())
    assert words(t, "We'll (e.g.;) to-do to-be: y") == ["We'll", " (", "e.g.", ";) ", "to-do", " ", "to", "-", "be", ": ", "y"]
    assert [x.text for x in split_gaps([Token("-+*/=#", False), Token("cd", True)])] == ["-", "+", "*/", "=", "#", "cd"]
    for t, s in ((Tokenizer(), "a b-c"), (two, "kw'mo?-"), (Tokenizer(dot_is_letter=True), "x.y z.")):
        assert [(w or g, bool(w)) for w, g in t.pairs(s)] == [(x.text, x.is_word) for x in t.tokenize_text(s)]


def test_runs_are_what_units_give():
    import random

    rng = random.Random(0)
    for pieces, sensitive in ((["'", "'s", "ts", "-a"], True), (["TS", ".é", "\\|"], False)):
        tok = InventoryTokenizer([Mapping([{"in": p, "out": "x"} for p in pieces], case_sensitive=sensitive)])
        for t in (tok, Tokenizer()):
            for _ in range(400):
                text = "".join(rng.choices("aAtTsS'-.|é\u0301 \n1½日\ue000\U0001f642\U000f0001", k=rng.randrange(15)))
                assert t.tokenize_text(text) == t.by_units(text), text


def test_lexicon():
    m = lexicon(out_delimiter=" ")
    assert (apply_lexicon(m, "moon").output, apply_lexicon(m, "Moon").edges) == ("M UW N ", [(0, 0), (1, 2), (1, 3), (2, 2), (2, 3), (3, 5)])
    assert apply_lexicon(m, "we'll").output == "W IH L "
    hush = Transducer(m)("hush")
    assert hush.output_string == "" and hush.edges == [(k, None) for k in range(4)] and hush.substring_alignments() == [("hush", "")]
    hush += Transducer(m)("moon")
    assert (hush.input_string, hush.output_string, hush.edges[:3]) == ("hushmoon", "M UW N ", [(0, 0), (1, 0), (2, 0)])
    assert (apply_lexicon(m, "absent").output, apply_lexicon(m, "absent").edges) == ("", [])
    with pytest.raises(MalformedMapping):
        parse_alignment("xyz")


def test_graphs_and_chains():
    ab, ba = Mapping([{"in": "a", "out": "b"}], in_lang="x", out_lang="y"), Mapping([{"in": "b", "out": "a"}], in_lang="y", out_lang="z")
    g = Transducer(ab)("abab")
    assert (g.input_nodes, g.output_string, g.pretty_edges(), len(g.debugger[0]), len(g.tiers)) == ([(0, "a"), (1, "b"), (2, "a"), (3, "b")], "bbbb", [("a", "b"), ("b", "b")] * 2, 2, 1)
    c = CompositeTransducer([Transducer(ab), Transducer(ba)])
    both = c("aba")
    assert (c.in_lang, c.out_lang, both.output_string, both.edges, both.alignments()) == ("x", "z", "aaa", [[(0, 0), (1, 1), (2, 2)]] * 2, [(0, 0), (1, 1), (2, 2)])
    both += c("aba")
    assert both.input_string == "abaaba" and both.output_string == "aaaaaa" and str(both) == "aaaaaa" and len(both.as_dict()["edges"]) == 2
    with pytest.raises(ValueError):
        both.append(g)
    eau = Mapping([{"in": "eau", "out": "o"}])
    t = TokenizingTransducer(Transducer(eau), Tokenizer())
    assert t("eau eau").edges == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (6, 2)] and t("eau eau").substring_alignments() == [("eau", "o"), (" ", " "), ("eau", "o")]
    assert t.text("eau. ëeau") == t("eau. ëeau").output_string


def test_registry_and_conversion():
    r = Registry.default().overlay([Mapping([{"in": "q", "out": "k"}], in_lang="und-ascii", out_lang="und-ipa", id="mine")])
    assert r.find_mapping("und-ascii", "und-ipa").id == "mine" and r.find_mapping_by_id("mine").id == "mine" and len(Registry.default().entries) == 4
    with pytest.raises(MappingMissing):
        r.find_mapping("a", "b")
    made = lexiweave.make_g2p("und", "eng-arpabet")
    assert made is lexiweave.make_g2p("und", "eng-arpabet") is not lexiweave.make_g2p("und", "eng-arpabet", tokenize=False)
    assert made("Île Tonga").output_string == "IY L EY  T OW N G AA " and made.text("Île Tonga") == "IY L EY  T OW N G AA "
    assert lexiweave.make_g2p("und", "und-ascii", tokenize=False)(normalize("NFD", "ñöû")).edges == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 2)]
    assert lexiweave.make_g2p("und", "und-ascii", tokenize=False)("͡").edges == [] and lexiweave.make_g2p("und", "und-ascii", tokenize=False).text("Жук, ß ∞") == "Zhuk, ss "
    for args, kind in ((("und", "none"), InvalidLanguageCode), (("und", "und"), NoPath), (("eng-arpabet", "und"), NoPath)):
        with pytest.raises(kind):
            lexiweave.make_g2p(*args)
    with pytest.raises(NeuralDependencyError):
        lexiweave.make_g2p("und", "und-ipa", neural=True)
    assert lexiweave.get_arpabet_langs() == (["und"], {"und": "Undetermined"})
    assert lexiweave.tokenize_and_map(lexiweave.make_tokenizer(), lexiweave.make_g2p("und-ascii", "und-ipa", tokenize=False), "yes, ye") == "jes, je"
    assert lexiweave.make_tokenizer("nowhere") is lexiweave.make_tokenizer() and lexiweave.make_tokenizer("und-ascii") is not lexiweave.make_tokenizer()
    with pytest.raises(ValueError):
        lexiweave.make_tokenizer("und", tok_path=["x", "y"])


def test_files(tmp_path):
    (tmp_path / "r.csv").write_text("﻿in,out\na,b\n\nc,d,x,y,more\n", "utf-8")
    (tmp_path / "r.json").write_text('[{"in": "a", "out": "b"}, {"in": "c", "out": "d", "context_before": "x", "context_after": "y"}]')
    (tmp_path / "r.psv").write_text("a|b\nc|d|x|y\n")
    (tmp_path / "one.csv").write_text("a\n")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "abb.tsv").write_text("VOWEL\ta\te\t\nX\n")
    (tmp_path / "lex.txt").write_text("\n".join(LEXICON) + "\n\n")
    want = [{"in": "a", "out": "b"}, {"in": "c", "out": "d", "context_before": "x", "context_after": "y"}]
    for name in ("r.csv", "r.json", "r.psv"):
        assert Mapping(files.load_rules(tmp_path / name)).plain_mapping() == want
    for name, kind in (("one.csv", MalformedMapping), ("none.json", MalformedMapping), ("x.txt", IncorrectFileType)):
        with pytest.raises(kind):
            files.load_rules(tmp_path / name)
    assert files.load_abbreviations(tmp_path / "abb.tsv") == {"VOWEL": ["a", "e"], "X": []}
    with pytest.raises(IncorrectFileType):
        files.load_abbreviations(tmp_path / "abb.json")
    (tmp_path / "xx").mkdir()
    (tmp_path / "xx/config-g2p.yaml").write_text("s: &s\n  language_name: Xx\nmappings:\n  - in_lang: xx\n    out_lang: xx-ipa\n    rules_path: ../r.csv\n    norm: NFD\n    <<: *s\n  - in_lang: xx\n    out_lang: xx-lex\n    type: lexicon\n    alignments_path: ../lex.txt\n")
    r = Registry.from_folder(tmp_path)
    assert r.available_languages() == ["Xx", "xx"] and r.make_g2p("xx", "xx-ipa").text("a") == "b" and r.make_g2p("xx", "xx-lex").text("moon") == "MUWN"
    with pytest.raises(FileNotFoundError):
        Registry.from_folder(tmp_path / "xx")
    with pytest.raises(MalformedMapping):
        (tmp_path / "bad.yaml").write_text("a: 1")
        files.load_config(tmp_path / "bad.yaml")
    m = Mapping([{"in": "a", "out": "b"}], in_lang="t", out_lang="u", rule_ordering="apply-longest-first", authors=["me"])
    files.mapping_to_file(m, tmp_path)
    files.config_to_file(m, tmp_path / "c.yaml")
    m.authors = ["you"]
    files.config_to_file(m, tmp_path / "c.yaml")
    back = files.load_config(tmp_path / "c.yaml")
    assert len(back) == 1 and back[0].plain_mapping() == m.plain_mapping() and (back[0].authors, back[0].rule_ordering) == (["you"], "apply-longest-first")
    assert Mapping(files.load_rules(files.mapping_to_file(m, tmp_path, "csv"))).plain_mapping() == m.plain_mapping()
    with pytest.raises(IncorrectFileType):
        files.mapping_to_text(m, "doc")
    r.write_network(tmp_path / "n.gz")
    first = (tmp_path / "n.gz").read_bytes()
    r.write_network(tmp_path / "n.gz")
    assert first == (tmp_path / "n.gz").read_bytes()


TARGET = Mapping([{"in": i, "out": o} for i, o in (("ɑ", "AA"), ("eː", "EY"), ("i", "IY"), ("u", "UW"), ("tʃ", "CH"), ("p", "P"), ("t", "T"), ("k", "K"), ("w", "W"), ("ɡ", "G"), ("ʒ", "ZH"))], in_lang="eng-ipa", out_lang="eng-arpabet", out_delimiter=" ")


@pytest.mark.parametrize("source, target", [("a", "ɑ"), ("i", "i"), ("u", "u"), ("pi", "pi"), ("ti", "ti"), ("t͡ʃi", "tʃi"), ("t͡ʃa", "tʃɑ"), ("pʷeː", "pweː"), ("kʷeː", "kweː")])
def test_inventories(source, target):
    m = inventories.create_mapping(Mapping([{"in": "x", "out": source}], in_lang="c", out_lang="c-ipa"), TARGET)
    assert Transducer(m)(source).output_string == target and m.prevent_feeding


def test_distances_and_fallback():
    for name in inventories.METHODS:
        far = inventories.distance(name)
        assert far("ta", "ta") == 0 and far("ta", "da") >= 0 and far("ta", "") > 0
    assert inventories.distance("weighted_feature_edit_distance")("t", "d") < inventories.distance("weighted_feature_edit_distance")("t", "a")
    with pytest.raises(ValueError):
        inventories.create_mapping(TARGET, TARGET, distance_name="none")
    m = Mapping([{"in": "ᐅ", "out": "u"}, {"in": "ᐊ", "out": "aː"}, {"in": "ᐱ", "out": "pi"}], in_lang="c", out_lang="c-ipa")
    assert [r.rule_output for r in inventories.align_to_dummy_fallback(m, "out").rules] == ["u", "ɑ", "ti"]
    assert [r.rule_output for r in inventories.align_to_dummy_fallback(Mapping([{"in": "a", "out": "b"}, {"in": "☃", "out": "b"}]), und_to_ipa=lexiweave.make_g2p("und", "und-ipa", tokenize=False).text).rules] == ["ɑ", "t"]
    assert inventories.xsampa_to_ipa("tSA") == "tʃɑ" and inventories.align_inventories(["a"], ["☃"]) == [{"in": "a", "out": ""}]


def test_checks():
    arpabet = set(api.registry().find_mapping("eng-ipa", "eng-arpabet").inventory("out"))
    assert checks.is_arpabet("HH AH  L OW ", arpabet) and not checks.is_arpabet("hello", arpabet) and checks.is_arpabet("", arpabet)
    assert checks.is_ipa_text("ŋɡ ʃuːt t͡ʃɛ̃") and not checks.is_ipa_text("N7") and checks.is_ipa_text("")
    made = lexiweave.make_g2p("und", "eng-arpabet")
    assert checks.check_outcome(made, made("tonga, ile"), arpabet=arpabet) and checks.check_outcome(made, made("tonga"), arpabet=arpabet, shallow=True)
    odd = Transducer(Mapping([{"in": "a", "out": "7"}], in_lang="x", out_lang="x-ipa", type="mapping"))
    assert not checks.check_outcome(odd, odd("a"), arpabet=arpabet) and checks.unknown_outputs([odd.mapping]) == [("x", "x-ipa", "7")]
    chars, sensitive = checks.mapped_characters(api.registry().mappings, "und")
    assert "q" in chars and not sensitive


def test_command_line(capsys, tmp_path):
    assert cli.main(["convert", "yes", "und-ascii", "und-ipa", "-a", "-e"]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "jes"
    (tmp_path / "t.txt").write_text("yes\nno\n")
    assert cli.main(["convert", str(tmp_path / "t.txt"), "und-ascii", "und-ipa", "-f", "-c"]) == 0 and capsys.readouterr().out == "jes\nno\n"
    assert cli.main(["convert", "yes", "und-ascii", "none"]) == 2 and cli.main(["convert", "yes", "und-ascii", "und-ipa", "--no-tok", "-t", "und"]) == 2
    assert cli.main(["doctor"]) == cli.main(["show-mappings", "und"]) == 0
    for args in (["und-ascii", "--ipa"], ["und-ascii", "--ipa", "--merge"], ["und-ascii", "--dummy"], ["und-ascii", "--list-dummy"], ["--from", "und-ascii_to_und-ipa", "--to", "eng"], ["--from", "und-ipa_to_eng-ipa[in]", "--to", "eng-ipa_to_eng-arpabet"]):
        assert cli.main(["generate-mapping", *args, "--folder", str(tmp_path)]) == 0
    assert (tmp_path / "und-ipa_to_eng-ipa.json").exists() and "a,ɑ,," in capsys.readouterr().out
    for args in ([], ["und"], ["x", "--ipa"], ["--from", "eng"], ["--from", "und-ascii[in]", "--to", "eng"], ["--from", "und_to_und-ascii", "--to", "eng"], ["--from", "und_to_und-ascii[x]", "--to", "eng"], ["--ipa", "--dummy", "und-ascii"]):
        assert cli.main(["generate-mapping", *args]) == 2


def test_service():
    r = api.registry()
    assert service.langs(r)[0] == {"code": "und", "name": "Undetermined"} and [n["code"] for n in service.nodes(r)] == ["eng-arpabet", "eng-ipa", "und", "und-ascii", "und-ipa"]
    assert service.outputs_for(r, "eng-ipa") == ["eng-arpabet"] and service.ancestors(r, "und-ascii") == ["und"] and service.path(r, "und", "eng-ipa") == ["und", "und-ascii", "und-ipa", "eng-ipa"]
    for call, kind in ((lambda: service.inputs_for(r, "q"), InvalidLanguageCode), (lambda: service.path(r, "eng-ipa", "und"), NoPath), (lambda: service.g2p(r, "eng-ipa", "und", "a"), NoPath)):
        with pytest.raises(kind):
            call()
    assert service.g2p(r, "und-ascii", "und-ipa", "yes", index=True) == {"input-text": "yes", "output-text": "jes", "debugger": False, "index": [(0, 0), (1, 1), (2, 2)]}
    word, gap, _ = service.convert(r, "und-ascii", "eng-arpabet", "ya 🙂ya", indices=True)[:3] if len(service.convert(r, "und-ascii", "eng-arpabet", "ya 🙂ya")) > 2 else (None, None, None)
    assert [c["out_lang"] for c in word["conversions"]] == ["eng-arpabet", "eng-ipa", "und-ipa"] and word["conversions"][0]["substring_alignments"] == [("j", "Y "), ("ɑ", "AA ")]
    assert gap["conversions"] == [{"in_lang": None, "out_lang": None, "input_nodes": [" ", "🙂"], "output_nodes": [" ", "🙂"], "alignments": [(0, 0), (1, 1)], "substring_alignments": [(" ", " "), ("🙂", "🙂")]}]
    one = service.convert(r, "und-ascii", "eng-arpabet", "ya", compose_from="und-ipa", tokenize=False)[0]["conversions"]
    assert [(c["in_lang"], c["out_lang"], c["substring_alignments"]) for c in one] == [("und-ipa", "eng-arpabet", [("j", "Y "), ("a", "AA ")]), ("und-ascii", "und-ipa", [("y", "j"), ("a", "a")])]


def test_empty_rule_lists_are_warned_of():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        Mapping([])
    assert "no rules" in str(seen[0].message)


def test_transliteration_of_many_scripts():
    read = lexiweave.make_g2p("und", "und-ascii", tokenize=False).text
    for source, target in (("さくら", "sakura"), ("ツシマ", "tsushima"), ("서울", "seoul"), ("한글", "hangeul"), ("ᑭᓇ", "kina"), ("ᏣᎳᎩ", "tsalagi"), ("שלום", "shlvm"), ("كتاب", "ktab"), ("ሀገር", "hagare"), ("नमक", "nmk")):
        assert read(source) == target, (source, read(source))


def test_missing_files_are_warned_of(tmp_path):
    (tmp_path / "aa").mkdir()
    (tmp_path / "aa/r.csv").write_text("a,b\n")
    (tmp_path / "aa/config-g2p.yaml").write_text("mappings:\n  - {in_lang: aa, out_lang: aa-ipa, rules_path: r.csv}\n  - {in_lang: aa, out_lang: bb, type: lexicon, alignments_path: gone.txt}\n")
    with pytest.warns(UserWarning, match="left out"):
        assert [m.out_lang for m in Registry.from_folder(tmp_path).mappings] == ["aa-ipa"]
    with pytest.raises(FileNotFoundError):
        files.load_config(tmp_path / "aa/config-g2p.yaml")


def test_schema_holds_for_the_samples(tmp_path):
    import json
    from pathlib import Path

    import yaml

    assert cli.main(["update-schema", str(tmp_path / "s.json")]) == 0
    fields = json.loads((tmp_path / "s.json").read_text())["properties"]["mappings"]["items"]["properties"]
    samples = Path(lexiweave.__file__).parent / "samples"
    for m in yaml.safe_load((samples / "velari/config-g2p.yaml").read_text())["mappings"]:
        assert set(m) <= set(fields) and m["type"] in fields["type"]["enum"] and m.get("norm_form") in fields["norm_form"]["enum"]


def test_http():
    import io
    import json

    def ask(method, path, query="", body=None):
        data, seen = json.dumps(body).encode() if body is not None else b"", []
        environ = {"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(data)), "wsgi.input": io.BytesIO(data)}
        said = b"".join(service.app(environ, lambda status, headers: seen.append((status, dict(headers)))))
        assert seen[0][1]["Content-Length"] == str(len(said))
        return int(seen[0][0][:3]), json.loads(said)

    r = api.registry()
    assert ask("GET", "/api/v1/langs") == (200, service.langs(r)) and ask("GET", "/api/v2/langs", "allnodes=true") == (200, service.nodes(r))
    assert ask("GET", "/api/v2/path/und/und-ipa") == (200, ["und", "und-ascii", "und-ipa"]) and ask("GET", "/api/v1/ancestors/und-ascii") == (200, ["und"])
    assert ask("GET", "/api/v1/g2p", "in-lang=und-ascii&out-lang=und-ipa&text=jag+och&index=true")[1]["output-text"] == "ʒaɡ ot͡ʃh"
    body = {"in_lang": "und-ascii", "out_lang": "eng-arpabet", "text": "ya, no", "indices": True}
    assert ask("POST", "/api/v2/convert", body=body) == (200, json.loads(json.dumps(service.convert(r, "und-ascii", "eng-arpabet", "ya, no", indices=True))))
    for asked, status in ((("GET", "/api/v2/path/und/no"), 404), (("GET", "/api/v2/path/eng-ipa/und"), 400), (("GET", "/api/v1/g2p"), 422), (("GET", "/nowhere"), 404)):
        assert ask(*asked)[0] == status


def test_compiled_registry(spark, tmp_path):
    from pathlib import Path

    known = Registry.from_folder(Path(lexiweave.__file__).parent / "samples", with_builtin=True)
    known.write(spark, f"file://{tmp_path}/r")
    back = Registry.read(spark, f"file://{tmp_path}/r")
    assert back.mappings == known.mappings and back.network.edges == known.network.edges
    assert back.make_g2p("vel-words", "vel-ipa").text("the and") == known.make_g2p("vel-words", "vel-ipa").text("the and") != ""
