"""Conversions as objects: one mapping, a chain of them, and either applied to the words of a text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from ..errors import NeuralDependencyError
from ..functions import edges as E
from ..functions import text as T
from ..plans.mapping import Mapping
from .lexicon import apply_lexicon
from .provenance import Outcome, cased_by_character, edge_arrays, preserve_case, rewrite, transduce
from .tokenizers import Tokenizer
from .translit import apply_translit, converted

#: Characters from which on arrays of edges are faster than lists.
LONG = 200
#: Handlers of neural mappings by name: (mapping, text) to text.
NEURAL: dict[str, Callable[[Mapping, str], str]] = {}


class Graph:
    """A conversion's outcome: tiers of strings with edges between them; one tier where one mapping was applied."""

    def __init__(self, tiers: list[Outcome]):
        self._tiers = tiers

    @property
    def tiers(self) -> list[Graph]:
        return [Graph([t]) for t in self._tiers]

    @property
    def input_string(self) -> str:
        return self._tiers[0].input if self._tiers else ""

    @property
    def output_string(self) -> str:
        return self._tiers[-1].output if self._tiers else ""

    @property
    def input_nodes(self) -> list[tuple[int, str]]:
        return list(enumerate(self.input_string))

    @property
    def output_nodes(self) -> list[tuple[int, str]]:
        return list(enumerate(self.output_string))

    @property
    def edges(self) -> list:
        """Of one tier its edges, of several a list for each."""
        return self._tiers[0].edges if len(self._tiers) == 1 else [t.edges for t in self._tiers]

    @property
    def debugger(self) -> list:
        return [t.trace for t in self._tiers]

    def clear_debugger(self) -> None:
        for t in self._tiers:
            t.trace = []

    def alignments(self) -> list:
        """From the first input to the last output."""
        edges = reduce(E.compose, (t.edges for t in self._tiers))
        if len(self._tiers) > 1:
            known = {a for a, _ in edges}
            edges = E.repair(edges + [(k, None) for k in range(len(self.input_string)) if k not in known and self._tiers[0].edges])
        return edges

    def pretty_edges(self) -> list:
        found = [E.pretty(t.input, t.output, t.edges) for t in self._tiers]
        return found[0] if len(found) == 1 else found

    def substring_alignments(self) -> list[tuple[str, str]]:
        return E.segments(self.input_string, self.output_string, self.alignments())

    def append(self, other: Graph) -> Graph:
        """Another text's outcome after this one's, tier by tier."""
        if len(self._tiers) != len(other._tiers):
            raise ValueError("only graphs with as many tiers can be appended")
        self._tiers = [joined([a, b]) for a, b in zip(self._tiers, other._tiers)]
        return self

    __iadd__ = append

    def as_dict(self) -> dict:
        return {"input": self.input_nodes, "output": self.output_nodes, "edges": self.edges, "input_string": self.input_string, "output_string": self.output_string}

    def __str__(self) -> str:
        return self.output_string


def joined(parts: list[Outcome]) -> Outcome:
    """One outcome of many in order, edges moved by what is before them, and repaired over the whole."""
    edges, before, after = [], 0, 0
    for p in parts:
        edges += [(a + before, None if b is None else b + after) for a, b in p.edges]
        before, after = before + len(p.input), after + len(p.output)
    return Outcome("".join(p.input for p in parts), "".join(p.output for p in parts), E.repair(edges), [t for p in parts for t in p.trace])


class BaseTransducer:
    """What converts a text to a Graph, or with text() only to its output."""

    in_lang = out_lang = ""

    def outcomes(self, text: str, trace: bool = False) -> list[Outcome]:
        raise NotImplementedError

    def text(self, text: str) -> str:
        return self.outcomes(text)[-1].output

    def __call__(self, text: str, trace: bool = True) -> Graph:
        return Graph(self.outcomes(text, trace))

    @property
    def transducers(self) -> list[BaseTransducer]:
        return [self]


class Transducer(BaseTransducer):
    def __init__(self, mapping: Mapping):
        self.mapping = mapping
        self.in_lang, self.out_lang, self.norm_form = mapping.in_lang, mapping.out_lang, mapping.norm_form

    def outcomes(self, text: str, trace: bool = False) -> list[Outcome]:
        m = self.mapping
        if m.type == "lexicon":
            out = apply_lexicon(m, text)
        elif m.type == "unidecode":
            out = apply_translit(m, text)
        elif m.type == "neural":
            said = self._neural(text)
            n = max(len(text), len(said))
            out = Outcome(text, said, E.repair([(min(k, len(text) - 1), min(k, len(said) - 1) if said else None) for k in range(n)]) if text else [])
        else:
            return [transduce(m, text, trace)]
        if m.preserve_case:
            out.output = preserve_case(out.input, out.output, out.edges, m.case_equivalencies)
        return [out]

    def text(self, text: str) -> str:
        m = self.mapping
        if m.type in (None, "mapping"):
            if not m.preserve_case:
                return rewrite(m, text)
            if (said := cased_by_character(m, text)) is not None:
                return said
            found = edge_arrays(m, text) if len(text) >= LONG else None
            return super().text(text) if found is None else found[0]
        if m.type == "unidecode":
            return "".join(map(converted, T.normalize(text, m.norm_form)))
        return super().text(text)

    def _neural(self, text: str) -> str:
        name = self.mapping.extra.get("neural_model_handler")
        if name not in NEURAL:
            raise NeuralDependencyError(f"no handler for neural mappings is registered as {name}")
        return NEURAL[name](self.mapping, text)


class CompositeTransducer(BaseTransducer):
    def __init__(self, transducers: list[BaseTransducer]):
        self._chain = list(transducers)
        self.in_lang = self._chain[0].in_lang if self._chain else ""
        self.out_lang = self._chain[-1].out_lang if self._chain else ""
        self.norm_form = getattr(self._chain[0], "norm_form", "none") if self._chain else "none"

    @property
    def transducers(self) -> list[BaseTransducer]:
        return self._chain

    def outcomes(self, text: str, trace: bool = False) -> list[Outcome]:
        out: list[Outcome] = []
        for t in self._chain:
            out += t.outcomes(out[-1].output if out else text, trace)
        return out

    def text(self, text: str) -> str:
        return reduce(lambda x, t: t.text(x), self._chain, text)


class TokenizingTransducer(BaseTransducer):
    """Words are converted each on its own; what lies between them stays on every tier."""

    def __init__(self, transducer: BaseTransducer, tokenizer: Tokenizer):
        self.transducer, self.tokenizer = transducer, tokenizer
        self.in_lang, self.out_lang, self.norm_form = transducer.in_lang, transducer.out_lang, getattr(transducer, "norm_form", "none")

    @property
    def transducers(self) -> list[BaseTransducer]:
        return self.transducer.transducers

    def outcomes(self, text: str, trace: bool = False) -> list[Outcome]:
        n = len(self.transducers)
        tiers: list[list[Outcome]] = [[] for _ in range(n)]
        for token in self.tokenizer.tokenize_text(T.normalize(text, self.norm_form)):
            same = Outcome(token.text, token.text, [(k, k) for k in range(len(token.text))])
            for tier, out in zip(tiers, self.transducer.outcomes(token.text, trace) if token.is_word else [same] * n):
                tier.append(out)
        return [joined(t) for t in tiers]

    def text(self, text: str) -> str:
        return "".join(self.transducer.text(t.text) if t.is_word else t.text for t in self.tokenizer.tokenize_text(T.normalize(text, self.norm_form)))
