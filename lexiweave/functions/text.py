"""Unicode functions on strings: escapes, normal forms with the indices they move, categories, names of languages."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from ..errors import InvalidNormalization

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{6})")
_IPA, _XSAMPA = re.compile(r"[-_]?ipa$"), re.compile(r"[-_]?x(-?)sampa$")


def unicode_escape(text: str) -> str:
    r"""\u with four and \U with six hexadecimal digits become the character; other text stays."""
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), text) if "\\" in text else text


def check_form(form: str | None) -> str:
    if not form or form == "none":
        return "none"
    if form not in FORMS:
        raise InvalidNormalization(form)
    return form


def normalize(text: str, form: str | None) -> str:
    """Escapes resolved, then the normal form; with "none" the text is returned as it is."""
    form = check_form(form)
    return text if form == "none" else unicodedata.normalize(form, unicode_escape(text))


def _decomposed(text: str, form: str) -> tuple[str, list[tuple[int, int]]]:
    """Each character on its own, then combining marks in canonical order; a stable sort tells which went where."""
    parts = [(c, i) for i, whole in enumerate(text) for c in unicodedata.normalize(form, whole)]
    out: list[tuple[str, int]] = []
    run: list[tuple[str, int]] = []
    for c, i in parts:
        if unicodedata.combining(c):
            run.append((c, i))
            continue
        out += sorted(run, key=lambda x: unicodedata.combining(x[0]))
        run = []
        out.append((c, i))
    out += sorted(run, key=lambda x: unicodedata.combining(x[0]))
    return "".join(c for c, _ in out), sorted((i, o) for o, (_, i) in enumerate(out))


def _compose(first: list, second: list) -> list:
    onward: dict[int, list] = {}
    for a, b in second:
        onward.setdefault(a, []).append(b)
    return list(dict.fromkeys((a, c) for a, b in first for c in onward.get(b, ())))


def normalize_with_indices(text: str, form: str | None) -> tuple[str, list[tuple[int, int]]]:
    """The normal form, and (input, output) pairs of the characters that belong together, sorted."""
    form = check_form(form)
    if form == "none" or text.isascii():
        return text, [(i, i) for i in range(len(text))]
    apart, edges = _decomposed(text, "NFKD" if "K" in form else "NFD")
    if form.endswith("D"):
        return apart, edges
    whole = unicodedata.normalize("NFC", apart)
    back, towards = _decomposed(whole, "NFD")
    if back != apart:  # compositions that are excluded from NFC come apart in the same way
        return whole, [(i, min(i, len(whole) - 1)) for i in range(len(text))] if whole else []
    return whole, sorted(_compose(edges, [(o, i) for i, o in towards]))


@lru_cache(maxsize=65536)
def category(char: str) -> str:
    """One of letter, number, diacritic, punctuation, symbol, whitespace and other; private characters count as letters."""
    kind = unicodedata.category(char)
    if kind[0] == "L" or kind == "Co":
        return "letter"
    return {"N": "number", "M": "diacritic", "P": "punctuation", "S": "symbol", "Z": "whitespace"}.get(kind[0], "whitespace" if char in "\t\n\r\f\v" else "other")


def is_ipa(lang: str) -> bool:
    return bool(_IPA.search(lang.lower()))


def is_xsampa(lang: str) -> bool:
    return bool(_XSAMPA.search(lang.lower()))


def is_dummy(lang: str) -> bool:
    return lang.lower() == "dummy"


def kind_of_language(lang: str) -> str:
    """How a display name calls it."""
    return "IPA" if is_ipa(lang) else "XSAMPA" if is_xsampa(lang) else "dummy" if is_dummy(lang) else "custom"
