"""Checks of outputs and of texts: ARPABET, IPA, characters that nothing maps."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.mapping import Mapping, strip_indices
from .inventories import segments
from .transducers import BaseTransducer, Graph, TokenizingTransducer


def is_arpabet(text: str, inventory: set[str]) -> bool:
    """Whether every word is one of the outputs of the mapping to ARPABET."""
    return all(w in inventory for w in text.split())


def arpabet_ok(text: Column, inventory: list[str]) -> Column:
    """The same for a column; the inventory is small and stands in the plan."""
    said = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.forall(said, lambda w: w.isin(inventory))


def is_ipa_text(text: str) -> bool:
    """Whether every word consists of known IPA segments only."""
    for word in text.split():
        plain = unicodedata.normalize("NFD", word)
        if "".join(segments(plain)) != plain:
            return False
    return True


def ipa_ok(text: Column) -> Column:
    """The same for a column, in the JVM but for normal forms of what is not ASCII: letters of the charts, each with its marks."""
    from .columns import normalized
    from .inventories import letters

    known = "".join(sorted(letters()))
    said = F.filter(F.split(normalized(text, "NFD"), r"\s+"), lambda w: w != "")
    return F.forall(said, lambda w: w.rlike(f"^(?:[{known}][\\p{{Mn}}\\p{{Lm}}\\p{{Sk}}]*)+$"))


def outcome_ok(transducer: BaseTransducer, text: Column, arpabet: list[str]) -> Column:
    """check_outcome() of a conversion for a column, on Arrow batches; null for null."""
    from pyspark.sql.functions import arrow_udf

    known = set(arpabet)

    @arrow_udf("boolean")
    def run(texts):
        import pyarrow as pa

        return pa.array([None if t is None else check_text(transducer, t, arpabet=known) for t in texts.to_pylist()], pa.bool_())

    return run(text)


def check_outcome(transducer: BaseTransducer, graph: Graph, *, arpabet: set[str], shallow: bool = False) -> bool:
    """Whether what languages promise holds for their tiers; shallow: for the last one only. Of tokenised texts words are checked."""
    if isinstance(transducer, TokenizingTransducer):
        words = [t.text for t in transducer.tokenizer.tokenize_text(T.normalize(graph.input_string, transducer.norm_form)) if t.is_word]
        return all(check_outcome(transducer.transducer, transducer.transducer(w), arpabet=arpabet, shallow=shallow) for w in words)
    pairs = list(zip(transducer.transducers, graph.tiers))
    for t, tier in pairs[-1:] if shallow else pairs:
        said = tier.output_string
        if "eng-arpabet" in t.out_lang:
            if not is_arpabet(said, arpabet):
                return False
        elif T.is_ipa(t.out_lang) and not is_ipa_text(said):
            return False
    return True


def check_text(transducer: BaseTransducer, text: str, *, arpabet: set[str]) -> bool:
    """check_outcome() of a text's conversion, which needs the outputs of its tiers and none of their edges."""
    if isinstance(transducer, TokenizingTransducer):
        return check_outcome(transducer, Graph(transducer.outcomes(text)), arpabet=arpabet)
    for t in transducer.transducers:
        text = t.text(text)
        if "eng-arpabet" in t.out_lang:
            if not is_arpabet(text, arpabet):
                return False
        elif T.is_ipa(t.out_lang) and not is_ipa_text(text):
            return False
    return True


def unknown_outputs(mappings: list[Mapping]) -> list[tuple[str, str, str]]:
    """(in_lang, out_lang, output) of the rules of IPA mappings whose outputs are no IPA."""
    return [(m.in_lang, m.out_lang, r.rule_output) for m in mappings if m.type == "mapping" and T.is_ipa(m.out_lang) for r in m.rules if not is_ipa_text(strip_indices(r.rule_output))]


def mapped_characters(mappings: list[Mapping], lang: str) -> tuple[set[str], bool]:
    """Characters that inputs of a language's mappings hold, and whether case counts."""
    own = [m for m in mappings if m.in_lang.startswith(lang) and "ipa" not in m.in_lang]
    sensitive = all(m.case_sensitive for m in own)
    chars = {c for m in own for x in m.inventory("in") for c in unicodedata.normalize("NFD", strip_indices(x))}
    return ({c.lower() for c in chars} if not sensitive else chars), sensitive


def unmapped(df: DataFrame, column: str, characters: set[str], *, case_sensitive: bool = True, ignore: str = " \n.", normalize: bool = True) -> DataFrame:
    """char and n: characters of a column that are not mapped, with how often they occur. Counts are added up before any shuffle."""
    from .columns import normalized

    text = normalized(F.col(column), "NFD") if normalize else F.col(column)
    text = text if case_sensitive else F.lower(text)
    # what is known goes first, so that only few characters are taken apart
    known = "".join(sorted({*characters, *ignore}))
    rest = F.translate(text, known, "")
    return df.select(F.explode(F.split(rest, "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("n"))
