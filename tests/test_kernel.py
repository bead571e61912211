"""Strings, edges and segments of rule mappings: own examples, and random rules against a rewriter that works one cell at a time."""

import random
import warnings
from unicodedata import normalize

import pytest

from lexiweave.errors import InvalidNormalization, MalformedMapping, RecursionError
from lexiweave.functions import edges as E
from lexiweave.functions import text as T
from lexiweave.operators.provenance import rewrite, transduce
from lexiweave.plans.mapping import Mapping, Rule, expand_abbreviations


def brute(rules, text):
    """Literal rules (input, output, characters before, characters after) as written: output and edges, cell by cell."""
    cells = [(c, {k}) for k, c in enumerate(text)]
    for given, made, before, after in rules:
        now, k, whole = [], 0, "".join(c for c, _ in cells)
        while k < len(cells):
            end = k + len(given)
            fits = whole[k:end] == given and (not before or whole[k - 1 : k] and whole[k - 1] in before) and (not after or whole[end : end + 1] and whole[end] in after)
            if not fits:
                now.append(cells[k])
                k += 1
                continue
            own = [set() for _ in made]
            for j, (_, whence) in enumerate(cells[k:end]):
                if made:
                    own[min(j, len(made) - 1)] |= whence
            for j in range(len(given), len(made)):
                own[j] |= cells[end - 1][1]
            now += zip(made, own)
            k = end
        cells = now
    reached = {i: [o for o, (_, whence) in enumerate(cells) if i in whence] for i in range(len(text))}
    edges = []
    for i in range(len(text)):
        left = next((reached[j][-1] for j in range(i, -1, -1) if reached[j]), None)
        right = next((reached[j][0] for j in range(i, len(text)) if reached[j]), None)
        edges += [(i, o) for o in reached[i]] or [(i, right if left is None else left)]
    return "".join(c for c, _ in cells), edges


def mapping_of(rules, **options):
    return Mapping([dict(zip(("in", "out", "context_before", "context_after"), r)) for r in rules], **options)


def test_against_brute_force():
    rng = random.Random(11)
    some = lambda letters, most, least=0: "".join(rng.choices(letters, k=rng.randint(least, most)))
    for _ in range(1500):
        rules = [(some("pqrs", 3, 1), some("pqrsXY", 3), some("pqr", 2) * rng.randint(0, 1), some("qrs", 2) * rng.randint(0, 1)) for _ in range(rng.randint(1, 4))]
        text = some("pqrs", 12)
        made = mapping_of([(a, b, f"[{c}]" if c else "", f"[{d}]" if d else "") for a, b, c, d in rules], norm_form="none")
        # a rule that deletes applies to adjacent matches too, which stands in the README; cells do the same
        got = transduce(made, text)
        want, edges = brute(rules, text)
        assert (got.output, rewrite(made, text)) == (want, want), (rules, text)
        if got.output:
            assert sorted(got.edges) == sorted(edges), (rules, text)
        else:
            assert got.edges == [(k, None) for k in range(len(text))]
        joined = E.segments(text, got.output, got.edges)
        assert ("".join(a for a, _ in joined), "".join(b for _, b in joined)) == (text, got.output)


#: rules, options, input, output, edges; the groups of index notation and options that cells do not know.
CASES = [
    ([("l{1}o{2}", "o{2}l{1}")], {}, "plot", "polt", [(0, 0), (1, 2), (2, 1), (3, 3)]),
    ([("m{1}u{2}", "u{2}m{1}u{2}")], {}, "mu", "umu", [(0, 1), (1, 0), (1, 2)]),
    ([("k{1}n{2}", "N{2}")], {}, "akna", "aNa", [(0, 0), (1, 0), (2, 1), (3, 2)]),
    ([("r{1}st{2}", "ST{2}r{1}")], {}, "verst", "veSTr", [(0, 0), (1, 1), (2, 4), (3, 2), (4, 3)]),
    ([("nd{1}r{2}", "r{2}")], {}, "andra", "ara", [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2)]),
    ([("ö", "OE Q")], {"norm_form": "NFC", "out_delimiter": "-"}, "öö", "OE Q-OE Q-", [(0, k) for k in range(5)] + [(1, k) for k in range(5, 10)]),
    ([("ö", "OE")], {"norm_form": "NFD", "out_delimiter": "-"}, normalize("NFD", "bö"), "bOE-", [(0, 0), (1, 1), (2, 2), (2, 3)]),
    ([("g", "k")], {"reverse": True}, "kg", "gg", [(0, 0), (1, 1)]),
    ([("o", "u"), ("ou", "w")], {}, "you", "yuu", None),
    ([("o", "u"), ("ou", "w")], {"rule_ordering": "apply-longest-first"}, "you", "yw", None),
    ([("p", "b", "[mn]|[rl]", "")], {}, "amparpap", "ambarbap", None),
    ([("p", "b", "ra|^", "s|$")], {}, "p raps", "p rabs", None),
    ([("Q", "k")], {"case_sensitive": False}, "qQ", "kk", [(0, 0), (1, 1)]),
    ([("q", "k")], {}, "qQ", "kQ", [(0, 0), (1, 1)]),
    ([("x", "y"), ("y", "z")], {"prevent_feeding": True}, "xyx", "yzy", [(0, 0), (1, 1), (2, 2)]),
    ([("no", "yes"), ("e", "i")], {"prevent_feeding": True}, "noe", "yesi", [(0, 0), (1, 1), (1, 2), (2, 3)]),
    ([("K", "g", "L", "")], {"abbreviations": {"K": ["k", "c"], "L": ["l", "r"]}}, "lkarck", "lgargk", None),
    ([("w+", "v")], {"escape_special": True}, "w+w", "vw", [(0, 0), (1, 0), (2, 1)]),
    ([("ñ", "n")], {}, "ñu", "nu", [(0, 0), (1, 1)]),
    ([("\\u00f1", "N")], {"norm_form": "NFC"}, "ña", "Na", [(0, 0), (1, 0), (2, 1)]),
]


@pytest.mark.parametrize("rules, options, source, target, edges", CASES)
def test_cases(rules, options, source, target, edges):
    mapping = mapping_of(rules, **options)
    got = transduce(mapping, source)
    assert got.output == target == rewrite(mapping, source)
    assert edges is None or got.edges == edges
    assert {a for a, _ in got.edges} == set(range(len(source)))


@pytest.mark.parametrize("source, target", [("Nya", "Ña"), ("NYA", "ÑA"), ("nya", "ña"), ("Ära", "Éra"), ("kara", "ƙara"), ("KARA", "⅄ARA"), ("1Nya!", "1Ña!")])
def test_case_is_preserved(source, target):
    m = mapping_of([("ny", "ñ"), ("ä", "é"), ("k", "ƙ")], case_sensitive=False, preserve_case=True, norm_form="NFC", case_equivalencies={"ƙ": "⅄"})
    assert transduce(m, source).output == target


def test_repair_and_composition():
    N = None
    assert E.repair([(0, 2), (1, N), (2, 3)]) == [(0, 2), (1, 2), (2, 3)]
    assert E.repair([(0, N), (1, N), (2, 4), (2, 5), (3, N)]) == [(0, 4), (1, 4), (2, 4), (2, 5), (3, 5)]
    assert E.repair([]) == [] and E.repair([(0, N)]) == [(0, N)]
    rng = random.Random(5)
    for _ in range(200):
        first = sorted({(rng.randrange(6), rng.randrange(6)) for _ in range(8)})
        second = sorted({(rng.randrange(6), rng.randrange(6)) for _ in range(8)})
        assert sorted(set(E.compose(first, second))) == sorted({(a, d) for a, b in first for c, d in second if b == c})


#: What canonical and compatibility (de)composition are by Unicode's definition, and which characters go where.
NORMALIZED = [
    ("\xf1", "NFD", "ñ", [(0, 0), (0, 1)]), ("\xe4̣", "NFD", "ạ̈", [(0, 0), (0, 2), (1, 1)]), ("ǘ", "NFD", "ǘ", [(0, 0), (0, 1), (0, 2)]),
    ("ñ", "NFC", "\xf1", [(0, 0), (1, 0)]), ("ǘx", "NFC", "ǘx", [(0, 0), (1, 0), (2, 0), (3, 1)]), ("ǘ", "none", "ǘ", [(0, 0), (1, 1), (2, 2)]),
    ("\xf1", "NFKD", "ñ", [(0, 0), (0, 1)]),
]


def test_normal_forms():
    for text, form, out, edges in NORMALIZED:
        assert T.normalize_with_indices(text, form) == (out, edges) and (form == "none" or normalize(form, text) == out)
    with pytest.raises(InvalidNormalization):
        T.normalize_with_indices("word", "NFZ")
    assert T.unicode_escape("\\u00e6\\U01F40Ey\\u9") == "\xe6\U0001f40ey\\u9"


def test_rules_and_mappings():
    assert expand_abbreviations("STOPS", {"STOPS": ["VOICED", "p", "t"], "VOICED": ["b", "d"]}) == "b|d|p|t"
    with pytest.raises(RecursionError):
        expand_abbreviations("X", {"X": ["Y"], "Y": ["X", "q"]})
    for bad in [{"norm_form": "NFZ"}, {"rule_ordering": "shuffled"}, {"type": "magic"}, {"preserve_case": True}, {"case_equivalencies": {"p": "qq"}}]:
        with pytest.raises((MalformedMapping, InvalidNormalization)):
            mapping_of([("p", "q")], **bad)
    with pytest.raises(MalformedMapping):
        Mapping([{"in": "p"}])
    with pytest.raises(MalformedMapping):
        mapping_of([("[", "q")]).compiled
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert transduce(mapping_of([("", "qq", "p", "")]), "p").output == "p"
    assert "disallowed" in str(seen[0].message)
    m = Mapping([{"in": "p", "out": "q", "note": 1}, {"in": "r", "out": ""}, {"in": "p", "out": "q"}], in_lang="one", out_lang="one-ipa")
    assert m.inventory() == ["p", "r", "p"] and m.inventory("out", True) == ["q", "q"] and m.display_name == "one custom to one-ipa IPA" and m.index({"in": "r", "out": ""}) == 1
    m.deduplicate()
    m.extend(Mapping([Rule("s", "t")]))
    assert m.plain_mapping() == [{"in": "p", "out": "q"}, {"in": "r", "out": ""}, {"in": "s", "out": "t"}]


def test_trace():
    got = transduce(mapping_of([("k", "g")]), "kiki", trace=True)
    assert [(t["start"], t["end"], t["output"]) for t in got.trace] == [(0, 1, "gigi"), (2, 3, "gigi")]
