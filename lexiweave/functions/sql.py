"""Functions for SQL: g2p_convert(text, in, out), g2p_align(text, in, out), and the table function g2p_tokens(text, lang)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, pandas_udf, udtf

from ..operators.columns import ALIGNED


def register(spark: SparkSession, folder: str | None = None) -> None:
    """Registers them for a session. folder: mappings besides the built-in ones, from a path that executors see too."""

    def registry(_cache={}):  # noqa: B006 (one for each worker)
        if "r" not in _cache:
            from lexiweave.sources.registry import Registry

            _cache["r"] = Registry.from_folder(folder, with_builtin=True) if folder else Registry.default()
        return _cache["r"]

    @arrow_udf("string")
    def convert(text, in_lang, out_lang):
        import pyarrow as pa

        rows = zip(text.to_pylist(), in_lang.to_pylist(), out_lang.to_pylist())
        return pa.array([None if None in (t, a, b) else registry().make_g2p(a, b).text(t) for t, a, b in rows], pa.string())

    @pandas_udf(ALIGNED)
    def align(text, in_lang, out_lang):
        import pandas as pd

        rows = []
        for t, a, b in zip(text, in_lang, out_lang):
            if t is None or a is None or b is None:
                rows.append((None, None, None, None))
                continue
            made = registry().make_g2p(a, b)
            g = made(t, trace=False)
            pairs = lambda edges: [{"i": x, "o": y} for x, y in edges]
            tiers = [{"tier": k, "in_lang": m.in_lang, "out_lang": m.out_lang, "input": x.input_string, "output": x.output_string, "edges": pairs(x.edges)} for k, (m, x) in enumerate(zip(made.transducers, g.tiers))]
            rows.append((g.output_string, pairs(g.alignments()), [{"in_sub": x, "out_sub": y} for x, y in g.substring_alignments()], tiers))
        return pd.DataFrame(rows, columns=["output", "edges", "segments", "tiers"])

    @udtf(returnType="pos int, text string, is_word boolean")
    class Tokens:
        def eval(self, text: str, lang: str):
            if text is not None:
                for k, t in enumerate(registry().make_tokenizer(lang).tokenize_text(text)):
                    yield k, t.text, t.is_word

    spark.udf.register("g2p_convert", convert)
    spark.udf.register("g2p_align", align)
    spark.udtf.register("g2p_tokens", Tokens)
