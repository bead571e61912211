"""Letters of other scripts in ASCII. Tables are made from Unicode's own data: decompositions, and names of letters.

Coverage: what decomposes to ASCII, Latin letters of their own, Greek, Cyrillic, Hebrew and Arabic letters (consonants and long
vowels), kana, Hangul, Canadian, Cherokee and Ethiopic syllables, and the scripts of India that have names in common. Other
scripts give nothing, as a logograph's name does not say how it is read.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from ..functions import text as T
from ..functions.edges import compose
from ..plans.mapping import Mapping
from .provenance import Outcome

#: Kept besides letters, as they mean sounds.
SPECIALS = "@?',:"
#: Latin letters that do not decompose, and names of letters whose sound is not how the name begins.
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "ŋ": "ng", "ə": "@", "ʔ": "?", "ʼ": "'", "’": "'", "‘": "'", "ː": ":"}
NAMES = {"ALPHA": "a", "EPSILON": "e", "ETA": "e", "IOTA": "i", "OMICRON": "o", "UPSILON": "u", "OMEGA": "o", "CHI": "kh", "PHI": "ph", "PSI": "ps", "THETA": "th", "XI": "x", "RHO": "r", "EF": "f", "EL": "l", "EM": "m", "EN": "n", "ER": "r", "ES": "s", "HA": "kh", "IE": "e", "IO": "io", "SHORT I": "i", "SHORT U": "u", "YERU": "y", "HARD SIGN": "", "SOFT SIGN": "'", "GHE": "g", "TSE": "ts", "CHE": "ch", "SHA": "sh", "SHCHA": "shch", "ZHE": "zh", "YU": "yu", "YA": "ya", "YI": "yi", "UKRAINIAN IE": "e", "BYELORUSSIAN-UKRAINIAN I": "i", "FINAL SIGMA": "s"}
#: Hebrew and Arabic letters by their names, and kana whose Hepburn reading is not their name.
SEMITIC = {"ALEF": "a", "BET": "b", "BEH": "b", "GIMEL": "g", "DALET": "d", "DAL": "d", "HE": "h", "HEH": "h", "VAV": "v", "WAW": "w", "ZAYIN": "z", "ZAIN": "z", "HET": "h", "HAH": "h", "TET": "t", "TAH": "t", "YOD": "y", "YEH": "y", "KAF": "k", "FINAL KAF": "k", "LAMED": "l", "LAM": "l", "MEM": "m", "FINAL MEM": "m", "MEEM": "m", "NUN": "n", "FINAL NUN": "n", "NOON": "n", "SAMEKH": "s", "SEEN": "s", "AYIN": "'", "AIN": "'", "PE": "p", "FINAL PE": "p", "PEH": "p", "FEH": "f", "TSADI": "ts", "FINAL TSADI": "ts", "SAD": "s", "QOF": "q", "QAF": "q", "RESH": "r", "REH": "r", "SHIN": "sh", "SHEEN": "sh", "TAV": "t", "TEH": "t", "TEH MARBUTA": "h", "THEH": "th", "JEEM": "j", "TCHEH": "ch", "KHAH": "kh", "THAL": "dh", "DAD": "d", "ZAH": "z", "GHAIN": "gh", "GAF": "g", "HAMZA": "'", "ALEF MAKSURA": "a"}
KANA = {"SI": "shi", "TI": "chi", "TU": "tsu", "HU": "fu", "ZI": "ji", "DI": "ji", "DU": "zu"}
SYLLABLES = ("HIRAGANA LETTER ", "KATAKANA LETTER ", "HANGUL SYLLABLE ", "CHEROKEE LETTER ", "CHEROKEE SMALL LETTER ", "ETHIOPIC SYLLABLE ", "CANADIAN SYLLABICS ")
INDIC = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")


def _jamo(c: str) -> str | None:
    """A part of a Hangul syllable, as names of syllables spell it."""
    name = lambda code: unicodedata.name(chr(code))[len("HANGUL SYLLABLE ") :].lower()
    silent = 0xAC00 + 11 * 588
    if 0x1100 <= ord(c) < 0x1113:
        return name(0xAC00 + (ord(c) - 0x1100) * 588)[:-1]
    if 0x1161 <= ord(c) < 0x1176:
        return name(silent + (ord(c) - 0x1161) * 28)
    if 0x11A8 <= ord(c) < 0x11C3:
        return name(silent + ord(c) - 0x11A7)[1:]
    return None


def _by_name(c: str) -> str:
    name = unicodedata.name(c, "")
    part = _jamo(c)
    if part is not None:
        return part
    for head in SYLLABLES:
        if name.startswith(head):
            last = name[len(head) :].split()[-1]
            return KANA.get(last, last.lower()) if last.isalpha() and "FINAL" not in name and "MARK" not in name else ""
    for script in ("HEBREW", "ARABIC"):
        if name.startswith(f"{script} LETTER "):
            letter = name[len(script) + 8 :].split(" WITH ")[0]
            return SEMITIC.get(letter, "")
    for script in INDIC:
        for kind in (" LETTER ", " VOWEL SIGN "):
            if name.startswith(script + kind):
                letter = name[len(script + kind) :].split()[-1].lower()
                consonant = kind == " LETTER " and len(letter) > 1 and letter[0] not in "aeiou" and letter.endswith("a")
                return letter[:-1] if consonant else letter
    return ""


@lru_cache(maxsize=65536)
def ascii_of(char: str) -> str:
    """A character's letters in ASCII, empty where none are known."""
    out = []
    for c in unicodedata.normalize("NFKD", char):
        if ord(c) < 128:
            out.append(c)
        elif c.lower() in LATIN:
            said = LATIN[c.lower()]
            out.append(said if c.islower() or not c.isalpha() else said.capitalize())
        elif unicodedata.category(c)[0] == "L" or unicodedata.category(c) in ("Mc", "Mn"):
            name = unicodedata.name(c, "")
            out.append(_by_name(c))
            for script in ("GREEK", "CYRILLIC"):
                for size in ("SMALL", "CAPITAL"):
                    head = f"{script} {size} LETTER "
                    if name.startswith(head):
                        letter = name[len(head) :].split(" WITH ")[0]
                        said = NAMES.get(letter, letter[:1].lower())
                        out.append(said if size == "SMALL" else said.capitalize())
    return "".join(out)


def converted(char: str) -> str:
    """Only letters and SPECIALS of what a character becomes; a space stays."""
    return "".join(c for c in ascii_of(char) if c.isalpha() or c in SPECIALS or char.isspace())


def apply_translit(mapping: Mapping, text: str) -> Outcome:
    ready, moved = T.normalize_with_indices(T.unicode_escape(text), mapping.norm_form)
    out, edges = "", []
    for k, char in enumerate(ready):
        said = converted(char)
        edges += [(k, len(out) + j) for j in range(len(said))] if said else [(k, max(len(out) - 1, 0))]
        out += said
    return Outcome(text, out, [e for e in compose(moved, edges) if e[0] < len(text)] if out else [])
