"""Index-preserving text transduction on Spark."""

from .api import (  # noqa: F401
    BaseTokenizer,
    BaseTransducer,
    InvalidLanguageCode,
    NoPath,
    Token,
    get_arpabet_langs,
    make_g2p,
    make_tokenizer,
    tokenize_and_map,
)
