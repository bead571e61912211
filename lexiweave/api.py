"""The public functions, over one registry for the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import InvalidLanguageCode, NoPath
from .operators import columns
from .operators.tokenizers import Token, Tokenizer
from .operators.transducers import BaseTransducer
from .sources.files import load_config
from .sources.registry import Registry

BaseTokenizer = Tokenizer
__all__ = ["BaseTokenizer", "BaseTransducer", "InvalidLanguageCode", "NoPath", "Token", "convert_column", "convert_frame", "get_arpabet_langs", "load_folder", "make_g2p", "make_tokenizer", "registry", "tokenize_and_map", "with_config"]

_registry: list[Registry] = []


def registry() -> Registry:
    if not _registry:
        _registry.append(Registry.default())
    return _registry[0]


def load_folder(folder: str, *, with_builtin: bool = True) -> Registry:
    """Makes the mappings under a folder those of the session."""
    _registry[:] = [Registry.from_folder(folder, with_builtin=with_builtin)]
    return _registry[0]


def with_config(path: str) -> Registry:
    """The session's mappings and those of a configuration, which stay as they are."""
    return registry().overlay(load_config(path))


def make_g2p(in_lang: str, out_lang: str, *, tokenize: bool = True, custom_tokenizer: Tokenizer | None = None, neural: bool = False) -> BaseTransducer:
    return registry().make_g2p(in_lang, out_lang, tokenize=tokenize, custom_tokenizer=custom_tokenizer, neural=neural)


def make_tokenizer(in_lang: str | None = None, out_lang: str | None = None, tok_path: list[str] | None = None) -> Tokenizer:
    return registry().make_tokenizer(in_lang, out_lang, tok_path)


def tokenize_and_map(tokenizer: Tokenizer, transducer: BaseTransducer, text: str) -> str:
    return "".join(transducer.text(t.text) if t.is_word else t.text for t in tokenizer.tokenize_text(text))


def get_arpabet_langs() -> tuple[list[str], dict[str, str]]:
    return registry().arpabet_languages()


def convert_column(text: Column, in_lang: str, out_lang: str, *, tokenize: bool = True) -> Column:
    return columns.convert(make_g2p(in_lang, out_lang, tokenize=tokenize), text)


def convert_frame(df: DataFrame, column: str, in_lang: str, out_lang: str, *, tokenize: bool = True, alignments: bool = False, into: str = "converted") -> DataFrame:
    """Adds the conversion of a column, or a struct of output, edges, segments and tiers."""
    conversion = make_g2p(in_lang, out_lang, tokenize=tokenize)
    df = columns.spread(df)
    return df.withColumn(into, columns.align(conversion, F.col(column)) if alignments else columns.convert(conversion, F.col(column)))
