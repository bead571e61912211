"""Conversion of text columns.

Plans, cheapest first; `convert` picks one:

* translate: one character to at most one, no contexts, no feeding: a single expression;
* regex: up to MAX_NESTED rules that Java's regular expressions read as Python's do: nested expressions, all in the JVM;
* arrow: anything else, on Arrow batches, tokenised and converted in one pass with the words of the worker in a bounded cache.
  Words repeat, so most are looked up; nothing is exploded, joined or shuffled. Alignments come from the same pass on request.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import bounded_batches
from ..plans.mapping import HIDDEN, Mapping
from .provenance import Outcome, composed_arrays, cuts_of, edge_arrays
from .tokenizers import Tokenizer
from .transducers import BaseTransducer, Graph, TokenizingTransducer, Transducer

#: Words that a worker keeps, what they and their outputs may have in characters, and how long a word may be to be kept.
MAX_NESTED, CACHE, CACHE_CHARS, CACHED = 40, 200_000, 4_000_000, 64
_META = re.compile(r"[\\^$.|?*+()\[\]{}]")
#: Python's word characters, as Java writes them: combining marks are not among them.
_W = r"[\p{L}\p{N}_]"
_BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def translate_table(mapping: Mapping) -> tuple[str, str] | None:
    """(from, to) of a single translate() call that does what the mapping does, or None."""
    if mapping.type not in (None, "mapping") or mapping.preserve_case or mapping.out_delimiter or not mapping.case_sensitive:
        return None
    single, gone, outs = {}, [], set()
    for r in mapping.compiled:
        plain = re.sub(r"\\([^\w\s])", r"\1", r.rule.rule_input)
        if r.groups or r.rule.context_before or r.rule.context_after or len(plain) != 1 or len(r.output) > 1 or _META.search(r.rule.rule_input.replace("\\" + plain, "")) or plain in outs:
            return None
        if plain in single or plain in gone:
            continue
        if r.output:
            single[plain] = r.output
        else:
            gone.append(plain)
        if not r.hidden:
            outs.add(r.output)
    # an output that an earlier rule would not have seen is no feeding; one that a later rule reads is
    return "".join([*single, *gone]), "".join(single.values())


def java_pattern(mapping: Mapping, pattern: str) -> str | None:
    r"""A rule's pattern for Java, or None where the two may differ: \b and \w are spelled out, \d and \s are left to Python."""
    if re.search(r"\\[dDsSBWpPNkgGAZ]|\(\?[^=!<:]|\(\?<[^=!]|\[\[|&&|\{[^\d,}]|\(\?<=[^)]*[*+]", pattern):
        return None
    out = re.sub(r"\\b", lambda _: _BOUNDARY, pattern)
    if r"\w" in out:
        if re.search(r"\[[^\]]*\\w", out):
            return None
        out = out.replace(r"\w", _W)
    return out if mapping.case_sensitive else f"(?iu){out}"


def regex_column(mapping: Mapping, text: Column) -> Column | None:
    """Nested replacements for a rule mapping whose input is ASCII or not to be normalised, or None."""
    if mapping.type not in (None, "mapping") or mapping.preserve_case or len(mapping.compiled) > MAX_NESTED:
        return None
    steps = []
    for r in mapping.compiled:
        p = java_pattern(mapping, r.pattern)
        if p is None or r.match.match(""):
            return None
        steps.append((p, r.written + mapping.out_delimiter))
    quoted = lambda s: re.sub(r"([\\$])", r"\\\1", s)
    col = text if mapping.case_sensitive else F.lower(text)
    for p, out in steps:
        col = F.regexp_replace(col, F.lit(p), F.lit(quoted(out)))
    for r in mapping.compiled:
        if r.hidden and r.output:
            col = F.regexp_replace(col, F.lit(f"(?:{chr(HIDDEN + r.number)}){{{len(r.output)}}}"), F.lit(quoted(r.output)))
    return col


def _plain(mapping: Mapping) -> bool:
    return mapping.norm_form == "none"


#: Words of conversions by their names, which a worker keeps from task to task for the KEPT conversions that came last.
_words: dict[str, dict[str, str]] = {}
#: Characters of those words and their outputs.
_held: dict[str, int] = {}
KEPT = 4


class _Words:
    """A conversion with its words in a bounded cache, one for each worker and conversion."""

    def __init__(self, transducer: BaseTransducer):
        self.whole = transducer
        self.inner = transducer.transducer if isinstance(transducer, TokenizingTransducer) else None
        self.name = uuid.uuid4().hex

    @property
    def cache(self) -> dict[str, str]:
        if self.name not in _words:
            while len(_words) >= KEPT:
                del _words[first := next(iter(_words))], _held[first]
            _words[self.name], _held[self.name] = {}, 0
        return _words[self.name]

    def text(self, text: str) -> str:
        if self.inner is None:
            return self.whole.text(text)
        out, cache = [], self.cache
        for word, gap in self.whole.tokenizer.pairs(T.normalize(text, self.whole.norm_form)):
            if not word:
                out.append(gap)
                continue
            said = cache.get(word)
            if said is None:
                said = self.inner.text(word)
                if len(word) <= CACHED:
                    if len(cache) >= CACHE or _held[self.name] >= CACHE_CHARS:
                        cache.clear()
                        _held[self.name] = 0
                    cache[word] = said
                    _held[self.name] += len(word) + len(said)
            out.append(said)
        return "".join(out)


def spread(df: DataFrame) -> DataFrame:
    """The rows of df over as many tasks as run at once, where its scan makes fewer: for columns that Python computes, in batches of
    bounded bytes."""
    bounded_batches(df.sparkSession)
    plan = df._jdf.queryExecution().executedPlan() if hasattr(df, "_jdf") else None
    if plan is None or plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df  # has been shuffled already
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= n else df.repartition(n)


def arrow_column(transducer: BaseTransducer, text: Column) -> Column:
    from pyspark.sql.functions import arrow_udf

    words = _Words(transducer)

    @arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        pieces = [pa.array([None if t is None else words.text(t) for t in texts.slice(a, b - a).to_pylist()], pa.string()) for a, b in _slices(texts)]
        return pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())

    return run(text)


def convert(transducer: BaseTransducer, text: Column, *, ascii_only: bool = False) -> Column:
    """The output of a conversion; null stays null. ascii_only: the caller knows that texts are ASCII without escapes, so
    normal forms change nothing."""
    chain = transducer.transducers
    if isinstance(transducer, TokenizingTransducer) or not all(isinstance(t, Transducer) for t in chain):
        return arrow_column(transducer, text)
    steps = []
    for k, t in enumerate(chain):
        if not (_plain(t.mapping) or ascii_only and k == 0):
            return arrow_column(transducer, text)
        table = translate_table(t.mapping)
        if table is not None:
            steps.append(lambda c, table=table: F.translate(c, *table))
        elif regex_column(t.mapping, F.lit("")) is not None:
            steps.append(lambda c, m=t.mapping: regex_column(m, c))
        else:
            return arrow_column(transducer, text)
    return reduce(lambda c, s: s(c), steps, text)


EDGES = "array<struct<i:int,o:int>>"
SEGMENTS = "array<struct<in_sub:string,out_sub:string>>"
TIERS = f"array<struct<tier:int,in_lang:string,out_lang:string,input:string,output:string,edges:{EDGES}>>"
PARTS = {"output": "string", "edges": EDGES, "segments": SEGMENTS, "tiers": TIERS}
ALIGNED = "struct<" + ",".join(f"{k}:{v}" for k, v in PARTS.items()) + ">"
#: Characters of texts that are aligned before their rows are handed on, however many rows a batch has.
ALIGNED_CHARS = 1 << 18


def _tiers(transducer: BaseTransducer, text: str) -> list[tuple[str, str, np.ndarray]]:
    """Input, output and edges (n, 2), -1 for none, of each step."""
    if all(type(t) is Transducer for t in transducer.transducers) and not isinstance(transducer, TokenizingTransducer):
        out: list = []
        for t in transducer.transducers:
            source = out[-1][1] if out else text
            found = edge_arrays(t.mapping, source)
            if found is None:
                o = t.outcomes(source)[0]
                found = o.output, edge_array(o.edges)
            out.append((source, *found))
        return out
    return [(o.input, o.output, edge_array(o.edges)) for o in transducer.outcomes(text)]


def edge_array(edges: list) -> np.ndarray:
    return np.asarray([(i, -1 if o is None else o) for i, o in edges], np.int64).reshape(-1, 2)


def _whole(tiers: list[tuple[str, str, np.ndarray]]) -> np.ndarray:
    """Edges from the first input to the last output."""
    if all(_total(i, e) for i, _, e in tiers):
        return reduce(composed_arrays, (e for *_, e in tiers))
    lists = [[(a, None if b < 0 else b) for a, b in e.tolist()] for *_, e in tiers]
    return edge_array(Graph([Outcome(i, o, e) for (i, o, _), e in zip(tiers, lists)]).alignments())


def _total(source: str, edges: np.ndarray) -> bool:
    """Whether edges are sorted, each once, lead from every character, and all of them to one or none does."""
    step = np.diff(edges, axis=0)
    return not source and not len(edges) or bool(
        len(edges) and ((step[:, 0] == 1) | (step[:, 0] == 0) & (step[:, 1] > 0)).all() and edges[0, 0] == 0 and edges[-1, 0] == len(source) - 1 and (edges[:, 1].min() >= 0 or edges[:, 1].max() < 0)
    )


def _listed(arrays: list, values) -> pa.Array:
    """A list array of as many rows as there are arrays, which are None or have a length each; values: of all rows."""
    sizes = np.asarray([0 if x is None else len(x) for x in arrays], np.int64)
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pa.ListArray.from_arrays(offsets, values)


def _edges_of(arrays: list) -> pa.Array:
    every = np.concatenate([np.zeros((0, 2), np.int64), *(x for x in arrays if x is not None)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1], mask=every[:, 1] < 0)], names=["i", "o"])
    return _listed(arrays, pairs)


def _aligned(transducer: BaseTransducer, texts: list[str | None], parts: list[str]) -> pa.StructArray:
    """The parts of the alignments of texts, as Arrow holds them; a null text has null."""
    kept = {name: [] for name in parts}
    for text in texts:
        if text is None:
            for name in parts:
                kept[name].append(None)
            continue
        tiers = _tiers(transducer, text)
        whole = _whole(tiers) if "edges" in kept or "segments" in kept else None
        for name in parts:
            if name == "segments":
                here, there = (x.tolist() for x in cuts_of(tiers[0][0], tiers[-1][1], whole))
                i, o = tiers[0][0], tiers[-1][1]
                kept[name].append([(i[a:c], o[b:d]) for a, c, b, d in zip(here, here[1:], there, there[1:])])
            else:
                kept[name].append(tiers[-1][1] if name == "output" else whole if name == "edges" else tiers)
    columns = []
    for name in parts:
        rows = kept[name]
        if name == "output":
            columns.append(pa.array(rows, pa.string()))
        elif name == "edges":
            columns.append(_edges_of(rows))
        elif name == "segments":
            every = [x for r in rows if r is not None for x in r]
            columns.append(_listed(rows, pa.StructArray.from_arrays([pa.array([x[k] for x in every], pa.string()) for k in (0, 1)], names=["in_sub", "out_sub"])))
        else:
            every = [(k, t.in_lang, t.out_lang, *x[:2]) for r in rows if r is not None for k, (t, x) in enumerate(zip(transducer.transducers, r))]
            fields = [pa.array([x[k] for x in every], kind) for k, kind in enumerate((pa.int32(), *[pa.string()] * 4))]
            fields.append(_edges_of([x[2] for r in rows if r is not None for x in r]))
            columns.append(_listed(rows, pa.StructArray.from_arrays(fields, names=["tier", "in_lang", "out_lang", "input", "output", "edges"])))
    return pa.StructArray.from_arrays(columns, names=parts, mask=pa.array([t is None for t in texts], pa.bool_()))


def align(transducer: BaseTransducer, text: Column) -> Column:
    """Output, composed edges, pieces and tiers of a conversion, in one pass."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(ALIGNED)
    def run(texts: pa.Array) -> pa.Array:
        pieces = [_aligned(transducer, texts.slice(a, b - a).to_pylist(), list(PARTS)) for a, b in _slices(texts)]
        return pa.concat_arrays(pieces) if pieces else _aligned(transducer, [], list(PARTS))

    return run(text)


def _slices(texts: pa.Array) -> list[tuple[int, int]]:
    """Beginnings and ends of runs of rows of about ALIGNED_CHARS, or of one long text."""
    ends = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.flatnonzero(np.append(True, np.diff(ends // ALIGNED_CHARS) != 0)).tolist() if len(ends) else []
    return list(zip(starts, [*starts[1:], len(ends)]))


def aligned(df: DataFrame, column: str, transducer: BaseTransducer, parts: list[str]) -> DataFrame:
    """df with the parts of the alignments of a text column that are asked for (names of PARTS) in place of its columns of those names, for
    whole corpora: rows are handed on as soon as ALIGNED_CHARS characters are aligned, so a worker holds no more, but for one long text."""
    others = [c for c in df.columns if c not in parts]
    at, places = df.columns.index(column), [df.columns.index(c) for c in others]

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch.column(at)):
                piece = batch.slice(a, b - a)
                made = _aligned(transducer, piece.column(at).to_pylist(), parts)
                # fields of a null text are null as well
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in places), *made.flatten()], names=[*others, *parts])

    fields = [(f.name, f.dataType.simpleString()) for f in df.select(*others).schema.fields] + [(p, PARTS[p]) for p in parts]
    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))


def normalized(text: Column, form: str) -> Column:
    """A Unicode normal form of a column; ASCII passes through in the JVM."""
    form = T.check_form(form)
    if form == "none":
        return text
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        import unicodedata

        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return F.when(F.length(text) == F.octet_length(text), text).otherwise(run(text))


def tokenizing(transducer: BaseTransducer, tokenizer: Tokenizer | None = None) -> TokenizingTransducer:
    return TokenizingTransducer(transducer, tokenizer or Tokenizer())
