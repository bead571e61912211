"""Rules and mappings: what they hold, and how they are made into patterns that are applied in order."""

from __future__ import annotations

import dataclasses
import warnings
from dataclasses import dataclass, field
from functools import lru_cache

import regex

from ..errors import InvalidNormalization, MalformedLookbehind, MalformedMapping, RecursionError
from ..functions import text as T

#: Private characters that stand for the outputs of a rule while others may not see them: this plus the rule's number.
HIDDEN = 0xF0000
TYPES = ("mapping", "unidecode", "lexicon", "neural")
ORDERINGS = ("as-written", "apply-longest-first")
NORM_FORMS = ("NFC", "NFD", "NFKC", "NFKD", "NKFC", "NKFD", "none")
_INDEX = regex.compile(r"\{\d+\}")
_GROUP = regex.compile(r"([^0-9{}]+)\{(\d+)\}")


@dataclass
class Rule:
    rule_input: str
    rule_output: str
    context_before: str = ""
    context_after: str = ""
    prevent_feeding: bool = False
    comment: str | None = None

    @classmethod
    def of(cls, row: "Rule | dict") -> Rule:
        """From a dictionary with the keys in and out (or rule_input, rule_output); others that are not known are ignored."""
        if isinstance(row, Rule):
            return dataclasses.replace(row)
        row = dict(row)
        try:
            found = {"rule_input": row.pop("in") if "in" in row else row["rule_input"], "rule_output": row.pop("out") if "out" in row else row["rule_output"]}
        except KeyError as e:
            raise MalformedMapping(f"a rule needs in and out: {row}") from e
        found |= {k: row[k] for k in ("context_before", "context_after", "prevent_feeding", "comment") if row.get(k) is not None}
        for k in ("rule_input", "rule_output", "context_before", "context_after"):
            found[k] = "" if found.get(k) is None else str(found[k])
        return cls(**found)

    def to_dict(self) -> dict:
        out = {"in": self.rule_input, "out": self.rule_output}
        out |= {k: getattr(self, k) for k in ("context_before", "context_after", "prevent_feeding", "comment") if getattr(self, k)}
        return out


def strip_indices(text: str) -> str:
    """Without index notation such as {1}."""
    return _INDEX.sub("", text)


def groups_of(text: str) -> list[tuple[str | None, str]]:
    """(number, characters) runs of index notation, in order; what has no number has None."""
    out, at = [], 0
    for m in _GROUP.finditer(text):
        if m.start() > at:
            out.append((None, strip_indices(text[at : m.start()])))
        out.append((m[2], m[1]))
        at = m.end()
    if at < len(text):
        out.append((None, strip_indices(text[at:])))
    return [x for x in out if x[1]]


def expand_abbreviations(text: str, abbreviations: dict[str, list[str]], depth: int = 0) -> str:
    """Names are replaced by their alternatives, longest names first, without brackets; deeper than 10 is a RecursionError."""
    if depth > 10:
        raise RecursionError(f"abbreviations in {text} go deeper than 10 levels")
    for name in sorted(abbreviations, key=len, reverse=True):
        if name and name in text:
            text = expand_abbreviations(text.replace(name, "|".join(abbreviations[name])), abbreviations, depth + 1)
    return text


def abbreviations_from_rows(rows: list[list[str]]) -> dict[str, list[str]]:
    return {r[0]: [x for x in r[1:] if x] for r in rows if r and r[0]}


def abbreviations_to_rows(abbreviations: dict[str, list[str]]) -> list[list[str]]:
    return [[name, *values] for name, values in abbreviations.items()] or [[""] * 6 for _ in range(10)]


@dataclass
class Mapping:
    """A list of rules, or another kind of conversion, between two languages. Rules are compiled on first use."""

    rules: list = field(default_factory=list)
    in_lang: str = "standalone"
    out_lang: str = "standalone"
    id: str | None = None
    language_name: str | None = None
    display_name: str | None = None
    case_sensitive: bool = True
    case_equivalencies: dict = field(default_factory=dict)
    preserve_case: bool = False
    escape_special: bool = False
    norm_form: str | None = "NFD"
    out_delimiter: str = ""
    reverse: bool = False
    rule_ordering: str = "as-written"
    as_is: bool | None = None
    prevent_feeding: bool = False
    type: str | None = None
    alignments: list | None = None
    authors: list = field(default_factory=list)
    abbreviations: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        self.rules = [Rule.of(r) for r in self.rules or []]
        self.norm_form = self.norm_form or "none"
        if self.norm_form not in NORM_FORMS:
            raise InvalidNormalization(self.norm_form)
        if self.as_is is not None:
            warnings.warn("as_is is deprecated, use rule_ordering", DeprecationWarning, stacklevel=2)
            self.rule_ordering = "as-written" if self.as_is else "apply-longest-first"
        if self.rule_ordering not in ORDERINGS:
            raise MalformedMapping(f"rules are ordered {' or '.join(ORDERINGS)}, not {self.rule_ordering}")
        if self.type not in (None, *TYPES):
            raise MalformedMapping(f"a mapping is a {', '.join(TYPES)}, not {self.type}")
        if self.preserve_case and self.case_sensitive:
            raise MalformedMapping("case is preserved only where it does not matter for rules")
        for a, b in self.case_equivalencies.items():
            if len(a) != len(b):
                raise MalformedMapping(f"equivalents must be of one length: {a}, {b}")
        if self.type in (None, "mapping") and not self.rules:
            warnings.warn(f"the mapping from {self.in_lang} to {self.out_lang} has no rules", stacklevel=2)
        self.language_name = self.language_name or self.in_lang
        self.display_name = self.display_name or f"{self.in_lang} {T.kind_of_language(self.in_lang)} to {self.out_lang} {T.kind_of_language(self.out_lang)}"
        self._compiled: list[Compiled] | None = None

    @property
    def compiled(self) -> list[Compiled]:
        if self._compiled is None:
            self._compiled = compile_rules(self)
        return self._compiled

    def index(self, rule: Rule) -> int:
        return self.rules.index(Rule.of(rule))

    def inventory(self, side: str = "in", non_empty: bool = False) -> list[str]:
        """Inputs or outputs of the rules in order, repeats included; of a lexicon its words or sounds."""
        if self.type == "lexicon":
            units = [(w, "".join(o for _, o in a)) for w, a in self.alignments or []]
            found = [u[side != "in"] for u in units]
        else:
            found = [r.rule_input if side == "in" else r.rule_output for r in self.rules]
        return [x for x in found if x] if non_empty else found

    def plain_mapping(self) -> list[dict]:
        return [r.to_dict() for r in self.rules]

    def extend(self, other: Mapping) -> None:
        self.rules += [Rule.of(r) for r in other.rules]
        self._compiled = None

    def deduplicate(self) -> None:
        """Of equal rules the first stays."""
        seen: dict = {}
        for r in self.rules:
            seen.setdefault(dataclasses.astuple(r), r)
        self.rules, self._compiled = list(seen.values()), None


@lru_cache(maxsize=4096)
def _alike(char: str) -> str:
    """Characters besides this one that it matches where case does not matter, and that lower case leaves as they are."""
    return "".join(c for c in _cased() if c != char and regex.fullmatch(regex.escape(char), c, regex.IGNORECASE))


@lru_cache(maxsize=1)
def _cased() -> tuple[str, ...]:
    every = (chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
    return tuple(c for c in every if c.lower() == c and (c.upper() != c or c.casefold() != c or c.title() != c))


@dataclass
class Compiled:
    """A rule ready to apply; number is its place among all rules, empty ones included."""

    number: int
    pattern: str
    output: str
    hidden: bool
    groups: tuple | None
    rule: Rule
    flags: int

    def __post_init__(self):
        plain = strip_indices(self.rule.rule_input)
        #: what a text must hold for the rule to match, where that is plain to see
        self.need = plain if regex.escape(plain) == plain and not self.flags & regex.IGNORECASE else ""
        #: what str.replace() may look for instead, in a text (in lower case where case does not matter) without any of `unlike`
        self.plain, self.unlike = "", None
        bare = regex.sub(r"\\(.)", r"\1", plain)
        if plain and not (self.rule.context_before or self.rule.context_after) and plain in (bare, regex.escape(bare)) and (regex.escape(bare) == bare or plain != bare):
            if not self.flags & regex.IGNORECASE:
                self.plain = bare
            elif bare == bare.lower():
                self.plain, self.unlike = bare, regex.compile("[" + "".join(map(regex.escape, sorted(set("".join(map(_alike, bare)))))) + "]") if any(map(_alike, bare)) else None
        try:
            self.match = regex.compile(self.pattern, self.flags)
        except regex.error as e:
            raise (MalformedLookbehind if self.rule.context_before else MalformedMapping)(f"{self.rule.to_dict()}: {e}") from e

    @property
    def written(self) -> str:
        """What a match is replaced by: the output, or as many private characters."""
        return chr(HIDDEN + self.number) * len(self.output) if self.hidden else self.output


def _ordered(mapping: Mapping) -> list[Rule]:
    if mapping.rule_ordering == "apply-longest-first":
        import unicodedata

        return sorted(mapping.rules, key=lambda r: -len(unicodedata.normalize("NFD", strip_indices(r.rule_input))))
    return list(mapping.rules)


def compile_rules(mapping: Mapping) -> list[Compiled]:
    """Sorted, abbreviations expanded, reversed, escaped, normalised; then patterns. Rules without an input are left out.

    The pattern is look-behind, input, look-ahead next to one another: an input with bare alternatives binds the look-behind
    to its first and the look-ahead to its last, as written.
    """
    form, out = T.check_form(mapping.norm_form), []
    for number, rule in enumerate(_ordered(mapping)):
        rule = dataclasses.replace(rule)
        if mapping.abbreviations:
            for k in ("rule_input", "context_before", "context_after"):
                setattr(rule, k, expand_abbreviations(getattr(rule, k), mapping.abbreviations))
        if mapping.reverse:
            rule = dataclasses.replace(rule, rule_input=rule.rule_output, rule_output=rule.rule_input, context_before="", context_after="")
        if mapping.escape_special:
            for k in ("rule_input", "context_before", "context_after"):
                setattr(rule, k, _escaped(getattr(rule, k)))
        if form != "none":
            for k in ("rule_input", "rule_output", "context_before", "context_after"):
                setattr(rule, k, T.normalize(getattr(rule, k), form))
        if not rule.rule_input:
            warnings.warn(f"rules with an empty input are disallowed: {rule.to_dict()}", stacklevel=3)
            continue
        explicit = bool(_INDEX.search(rule.rule_input) and _INDEX.search(rule.rule_output))
        before = f"(?<={looked_behind(rule.context_before)})" if rule.context_before else ""
        after = f"(?={rule.context_after})" if rule.context_after else ""
        out.append(
            Compiled(
                number=number, pattern=before + strip_indices(rule.rule_input) + after, output=strip_indices(rule.rule_output), hidden=mapping.prevent_feeding or rule.prevent_feeding,
                groups=(tuple(groups_of(rule.rule_input)), tuple(groups_of(rule.rule_output))) if explicit else None, rule=rule, flags=0 if mapping.case_sensitive else regex.IGNORECASE,
            )
        )
    return out


_ALTERNATIVES = regex.compile(r"[\\\[\]\p{L}\p{M}|.:'^$]+")


def looked_behind(context: str) -> str:
    """A context before, as mappings rely on it: where the shortest alternatives of a list end in one that is there twice, the
    list goes without those of that length. A look-behind may have alternatives of any length here."""

    def listed(m) -> str:
        size = lambda x: 0 if x in ("^", "$") else len(x)
        parts = sorted(m[0].split("|"), key=len, reverse=True)
        if parts.count(parts[-1]) == 1:
            return m[0]
        return "|".join(p for p in parts if size(p) != size(parts[-1])) or "(?!)"

    return _ALTERNATIVES.sub(listed, context)


def _escaped(text: str) -> str:
    """Escaped for patterns; index notation stays what it is."""
    out, at = [], 0
    for m in _INDEX.finditer(text):
        out += [regex.escape(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, regex.escape(text[at:])])
