"""Cutting texts into words and what lies between them, as the languages they are converted to need it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.mapping import Mapping, strip_indices

WORD_CLASS = r"\p{L}\p{Co}\p{N}\p{M}"


@dataclass(frozen=True)
class Token:
    text: str
    is_word: bool


def merged(tokens: list[Token]) -> list[Token]:
    """Runs of one kind become one token."""
    out: list[list] = []
    for t in tokens:
        if out and out[-1][1] == t.is_word:
            out[-1][0].append(t.text)
        else:
            out.append([[t.text], t.is_word])
    return [Token("".join(parts), kind) for parts, kind in out]


def merged_gaps(tokens: list[Token]) -> list[Token]:
    """Only runs of what is no word become one token."""
    out: list[Token] = []
    for is_word, run in groupby(tokens, lambda t: t.is_word):
        out += run if is_word else [Token("".join(t.text for t in run), False)]
    return out


def split_gaps(tokens: list[Token]) -> list[Token]:
    """What is no word is cut into characters, where it has more than five into the first two, the rest, and the last two."""
    out: list[Token] = []
    for t in tokens:
        if t.is_word:
            out.append(t)
            continue
        s = t.text
        parts = list(s) if len(s) <= 5 else [s[0], s[1], s[2:-2], s[-2], s[-1]]
        out += [Token(p, False) for p in parts]
    return out


class Tokenizer:
    """Words are letters, numbers, marks and private characters in a row."""

    case_sensitive = True
    _runs = None

    def __init__(self, lang: str = "", dot_is_letter: bool = False):
        self.lang, self.dot_is_letter = lang, dot_is_letter

    def units(self, text: str) -> list[str]:
        return list(text)

    def is_word_character(self, unit: str) -> bool:
        return bool(unit) and all(T.category(c) in ("letter", "number", "diacritic") for c in unit)

    def _pattern(self) -> str:
        return f"([{WORD_CLASS}]+)|([^{WORD_CLASS}]+)"

    def _by_runs(self) -> bool:
        return not self.dot_is_letter and type(self) in (Tokenizer, InventoryTokenizer)

    def pairs(self, text: str) -> list[tuple[str, str]]:
        """The tokens as (word, "") and ("", gap)."""
        if not self._by_runs():
            return [(t.text, "") if t.is_word else ("", t.text) for t in self.tokenize_text(text)]
        if self._runs is None:
            self._runs = regex.compile(self._pattern(), regex.DOTALL | (0 if self.case_sensitive else regex.IGNORECASE))
        return self._runs.findall(text)

    def tokenize_text(self, text: str) -> list[Token]:
        if not self._by_runs():
            return self.by_units(text)
        return [Token(word or gap, bool(word)) for word, gap in self.pairs(text)]

    def by_units(self, text: str) -> list[Token]:
        """One unit after another; runs of a kind are one token. For all but dots that are letters this is what runs give."""
        found = self.units(text)
        kinds = [self.is_word_character(u) for u in found]
        if self.dot_is_letter:
            for k in range(len(found) - 2, -1, -1):
                if found[k] == "." and kinds[k + 1]:
                    kinds[k] = True
        return merged([Token(u, k) for u, k in zip(found, kinds)])


class InventoryTokenizer(Tokenizer):
    """Inputs of the mappings that follow are word characters too, the longest first."""

    def __init__(self, mappings: list[Mapping], dot_is_letter: bool = False):
        super().__init__(mappings[0].language_name, dot_is_letter)
        self.case_sensitive = mappings[0].case_sensitive
        pieces = [p for m in mappings for x in m.inventory("in") for p in re.split(r"(?<!\\)\|", strip_indices(x))]
        if not self.case_sensitive:
            pieces = [p.lower() for p in pieces]
        self.inventory = dict.fromkeys(p for p in pieces if p)
        plain = sorted({*self.inventory, *(regex.sub(r"\\(.)", r"\1", p) for p in self.inventory)}, key=lambda p: -len(p))
        self.inventory |= dict.fromkeys(plain)
        self.pieces = plain
        self._cut = regex.compile("|".join([*map(regex.escape, plain), "."]), regex.DOTALL | (0 if self.case_sensitive else regex.IGNORECASE))

    def _pattern(self) -> str:
        begins = "|".join([*map(regex.escape, self.pieces), f"[{WORD_CLASS}]"])
        return f"((?:{begins})++)|((?:(?!{begins}).)++)"

    def units(self, text: str) -> list[str]:
        return self._cut.findall(text)

    def is_word_character(self, unit: str) -> bool:
        return (unit if self.case_sensitive else unit.lower()) in self.inventory or super().is_word_character(unit)


class LexiconTokenizer(Tokenizer):
    """Words of a lexicon are tokens whatever they hold; the longest that begins here is taken. The rest is as by default."""

    def __init__(self, mapping: Mapping):
        super().__init__(mapping.language_name)
        self.words = frozenset(w.lower() for w, _ in mapping.alignments or ())
        self._longest = max(map(len, self.words), default=0)
        self._plain = Tokenizer()

    def tokenize_text(self, text: str) -> list[Token]:
        out: list[Token] = []
        for k, block in enumerate(re.split(r"(\s+)", text)):
            if k % 2:
                out.append(Token(block, False))
                continue
            rest, at = split_gaps(self._plain.tokenize_text(block)), 0
            while at < len(rest):
                # lower case is never shorter, so what is longer than any word is none
                end, size = at, 0
                while end < len(rest) and size + len(rest[end].text) <= self._longest:
                    size += len(rest[end].text)
                    end += 1
                for n in range(end, at + 1, -1):
                    whole = "".join(t.text for t in rest[at:n])
                    if whole.lower() in self.words:
                        out.append(Token(whole, True))
                        break
                else:
                    n = at + 1
                    out.append(Token(rest[at].text, rest[at].is_word or rest[at].text.lower() in self.words and len(rest) - at > 1))
                at = n
        return merged_gaps(out)


TOKENS = "array<struct<text:string,is_word:boolean>>"


def _told_apart(text: Column, found: Column, first: str) -> Column:
    """Tokens of runs that are words and gaps by turns: only the beginning of a text is looked at. Both stand in an array of one, as what a
    function of elements refers to by an expression is computed for each of them."""
    once = F.array(F.struct(found.alias("found"), text.rlike(first).alias("word")))
    kinds = lambda s: F.transform(s["found"], lambda t, k: F.struct(t.alias("text"), (s["word"] == (k % 2 == 0)).alias("is_word")))
    return F.get(F.transform(once, kinds), F.lit(0))


def default_tokens(text: Column) -> Column:
    """The default tokenizer as an expression: an array of (text, is_word)."""
    found = F.regexp_extract_all(text, F.lit(f"[{WORD_CLASS}]++|[^{WORD_CLASS}]++"), F.lit(0))
    return _told_apart(text, found, f"^[{WORD_CLASS}]")


def inventory_tokens(text: Column, tokenizer: InventoryTokenizer) -> Column:
    """An inventory's tokenizer as an expression. A word is a run of its pieces and of word characters, a gap a run of what begins
    neither; the runs are possessive, so that Java neither backtracks nor recurses on long ones. Pieces of one character join the class of
    word characters, which leaves no longer piece to look for where all are made of those."""
    flags = "" if tokenizer.case_sensitive else "(?iu)"
    single = [p for p in tokenizer.pieces if len(p) == 1]
    known = WORD_CLASS + "".join(f"\\x{{{ord(p):x}}}" for p in single)
    inside = regex.compile(f"[{WORD_CLASS}{''.join(map(regex.escape, single))}]+")
    longer = [p for p in tokenizer.pieces if not inside.fullmatch(p)]
    if not longer:
        found = F.regexp_extract_all(text, F.lit(f"{flags}[{known}]++|[^{known}]++"), F.lit(0))
        return _told_apart(text, found, f"{flags}^[{known}]")
    begins = "|".join([*(r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E" for p in tokenizer.pieces), f"[{WORD_CLASS}]"])
    found = F.regexp_extract_all(text, F.lit(f"{flags}(?s)(?:{begins})++|(?:(?!{begins}).)++"), F.lit(0))
    return _told_apart(text, found, f"{flags}^(?:{begins})")


def tokens(df: DataFrame, column: str, tokenizer: Tokenizer | None = None, into: str = "tokens") -> DataFrame:
    """Adds the tokens of a text column; null texts have null. Lexicons and dots that are letters run on Arrow batches, else expressions."""
    if tokenizer is None or type(tokenizer) is Tokenizer and not tokenizer.dot_is_letter:
        return df.withColumn(into, default_tokens(F.col(column)))
    if type(tokenizer) is InventoryTokenizer and not tokenizer.dot_is_letter:
        return df.withColumn(into, inventory_tokens(F.col(column), tokenizer))
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(TOKENS)
    def cut(texts: pa.Array) -> pa.Array:
        offsets, said, kinds = [0], [], []
        pieces = []
        for k, t in enumerate(texts):
            for x in () if (t := t.as_py()) is None else tokenizer.tokenize_text(t):
                said.append(x.text)
                kinds.append(x.is_word)
            offsets.append(len(said))
            if len(said) >= CUT_ROWS or k == len(texts) - 1:
                pieces.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _token_structs(said, kinds)))
                offsets, said, kinds = [0], [], []
        whole = pa.concat_arrays(pieces) if pieces else pa.array([], pa.list_(_token_structs([], []).type))
        # nulls are told by a mask, which lists made from offsets take without a slice only
        return pa.ListArray.from_arrays(whole.offsets, whole.values, mask=texts.is_null()) if texts.null_count else whole

    return df.withColumn(into, cut(F.col(column)))


#: Tokens of a task in Python at once; what is more is handed on, or held as Arrow does.
CUT_ROWS = 50_000


def _token_structs(said: list[str], kinds: list[bool]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(kinds, pa.bool_())], names=["text", "is_word"])


def _cut_rows(df: DataFrame, keys: list[str], column: str, tokenizer: Tokenizer) -> DataFrame:
    """token_rows() by a tokenizer in Python: a batch of rows as soon as there are CUT_ROWS, also within a text."""
    names = [*keys, "pos", "text", "is_word"]

    def run(batches):
        for batch in batches:
            rows, pos, said, kinds = [], [], [], []

            def flush(batch=batch):
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), pa.array(pos, pa.int32()), pa.array(said, pa.string()), pa.array(kinds, pa.bool_())], names=names)

            for row, text in enumerate(batch.column(len(keys))):
                for k, t in enumerate(() if (text := text.as_py()) is None else tokenizer.tokenize_text(text)):
                    rows.append(row)
                    pos.append(k)
                    said.append(t.text)
                    kinds.append(t.is_word)
                    if len(rows) >= CUT_ROWS:
                        yield flush()
                        rows, pos, said, kinds = [], [], [], []
            if rows:
                yield flush()

    given = df.select(*keys, F.col(column).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*keys).schema.fields)
    return given.mapInArrow(run, f"{fields}{', ' if keys else ''}pos int, text string, is_word boolean")


def _as_expression(tokenizer: Tokenizer | None) -> bool:
    return tokenizer is None or type(tokenizer) in (Tokenizer, InventoryTokenizer) and not tokenizer.dot_is_letter


def token_rows(df: DataFrame, keys: list[str], column: str, tokenizer: Tokenizer | None = None) -> DataFrame:
    """keys, pos, text and is_word: a row for each token."""
    if not _as_expression(tokenizer):
        return _cut_rows(df, keys, column, tokenizer)
    cut = tokens(df.select(*keys, F.col(column).alias("_text")), "_text", tokenizer, "_tokens")
    return cut.select(*keys, F.posexplode("_tokens").alias("pos", "_t")).select(*keys, "pos", F.col("_t.text").alias("text"), F.col("_t.is_word").alias("is_word"))


class TokenizerLibrary:
    """Tokenizers by language, made once. mapping(in, out) finds mappings, successors(lang) the network's next languages."""

    def __init__(self, mapping, successors):
        self._mapping, self._successors, self._made = mapping, successors, {None: Tokenizer()}

    def make_tokenizer(self, in_lang: str | None = None, out_lang: str | None = None, tok_path: list[str] | None = None) -> Tokenizer:
        """By the mappings from in_lang: along tok_path up to the first IPA, three steps at most; else to out_lang; else to the
        language's own IPA, by one step or two. The default where there is none."""
        if tok_path and tok_path[0] != in_lang:
            raise ValueError("tok_path must begin with in_lang")
        key = None if not in_lang else (in_lang, *(tok_path or ())) if tok_path else (in_lang, "to", out_lang or f"{in_lang}-ipa")
        if key not in self._made:
            self._made[key] = self._make(in_lang, out_lang, list(tok_path or ()))
        return self._made[key]

    def _make(self, in_lang, out_lang, tok_path) -> Tokenizer:
        if tok_path:
            steps = tok_path[1:4]
            ipa = next((k for k, x in enumerate(steps) if T.is_ipa(x)), None)
            through = steps[: (ipa if ipa is not None else min(2, len(steps)) - 1) + 1]
        elif out_lang:
            through = [out_lang]
        else:
            through = self._towards_ipa(in_lang)
        if not through:
            return self._made[None]
        chain = []
        for a, b in zip([in_lang, *through], through):
            try:
                chain.append(self._mapping(a, b))
            except LookupError:
                return self._made[None]
        if any(m is None for m in chain):
            import logging

            logging.getLogger(__name__).warning("no mapping from %s by %s; using the default tokenizer", in_lang, through)
            return self._made[None]
        first = chain[0]
        if first.type == "lexicon":
            return LexiconTokenizer(first)
        if first.type not in (None, "mapping"):
            return self._made[None]
        return InventoryTokenizer([m for m in chain if m.type in (None, "mapping")], dot_is_letter=in_lang in ("tli", "sal-apa"))

    def _towards_ipa(self, lang) -> list[str]:
        try:
            nexts = list(self._successors(lang))
        except KeyError:
            return []
        for n in nexts:
            if T.is_ipa(n):
                return [n]
        for n in nexts[:1]:
            for m in self._successors(n):
                if T.is_ipa(m):
                    return [n, m]
        return nexts[:1]
