"""A few mappings that are always there. Larger collections are loaded from their own folders."""

from __future__ import annotations

from pathlib import Path

from ..plans.mapping import Mapping
from .files import load_rules

#: Fixed values, as files of rules (input, tab, output): und_to_ipa.tsv has letters of undetermined text and the IPA they are read as,
#: und_ipa_to_eng_ipa.tsv that IPA and the nearest of English, ipa_to_arpabet.tsv IPA of English and its ARPABET.
TABLES = Path(__file__).parent / "tables"


def rules(name: str) -> list[dict]:
    return load_rules(TABLES / f"{name}.tsv")


def mappings() -> list[Mapping]:
    und = {"language_name": "Undetermined"}
    return [
        Mapping(rules("und_to_ipa"), in_lang="und-ascii", out_lang="und-ipa", case_sensitive=False, display_name="Undetermined ASCII to IPA", **und),
        Mapping([], in_lang="und", out_lang="und-ascii", type="unidecode", display_name="Undetermined Unicode to ASCII", **und),
        Mapping(rules("und_ipa_to_eng_ipa"), in_lang="und-ipa", out_lang="eng-ipa", rule_ordering="apply-longest-first", display_name="Undetermined IPA to English IPA", **und),
        Mapping(rules("ipa_to_arpabet"), in_lang="eng-ipa", out_lang="eng-arpabet", norm_form="NFC", out_delimiter=" ", rule_ordering="apply-longest-first", display_name="English IPA to Arpabet", language_name="English"),
    ]
