"""Rewriting that knows where each character came from.

The working string is a list of characters, and beside each lie the inputs it stems from. Applying a rule rebuilds both from left to
right over the matches found in the string as it was before: gaps are copied, a match's characters are paired with those
of the output, further outputs stem from what the one before them did, and further inputs join the last output. A match
without an output leaves its inputs deleted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex

from ..functions import edges as E
from ..functions import text as T
from ..plans.mapping import HIDDEN, Compiled, Mapping


@dataclass
class Outcome:
    """Input and output strings, edges between them, and the trace where it was asked for."""

    input: str
    output: str
    edges: list
    trace: list = field(default_factory=list)


def prepare(mapping: Mapping, text: str) -> tuple[str, list]:
    """The text as rules see it: escapes resolved, in lower case where case does not matter, normalised; and edges to it."""
    text = T.unicode_escape(text)
    if not mapping.case_sensitive:
        text = text.lower()
    return T.normalize_with_indices(text, mapping.norm_form)


def rewrite(mapping: Mapping, text: str) -> str:
    """Only the output string of a rule mapping."""
    if not mapping.case_sensitive:
        text = T.unicode_escape(text).lower()
    text = T.normalize(text, mapping.norm_form) if mapping.norm_form != "none" else T.unicode_escape(text)
    hidden = False
    for rule in mapping.compiled:
        if rule.need and rule.need not in text:
            continue
        out = rule.written + mapping.out_delimiter
        hidden |= rule.hidden
        if rule.plain and not (rule.unlike and rule.unlike.search(text)):
            text = text.replace(rule.plain, out)
            continue
        text = rule.match.sub(lambda m, out=out: out if m.end() > m.start() else "", text)
    return reveal(mapping, text) if hidden else text


def reveal(mapping: Mapping, text: str) -> str:
    """Private characters of hidden rules to what they stand for, one after another."""
    outputs = {chr(HIDDEN + r.number): r.output for r in mapping.compiled if r.hidden and r.output}
    if not outputs:
        return text
    run = regex.compile("|".join(f"{c}+" for c in outputs))
    return run.sub(lambda m: "".join(outputs[m[0][0]][k % len(outputs[m[0][0]])] for k in range(len(m[0]))), text)


def _pairs(rule: Compiled, size: int) -> list[tuple[int | None, int | None]]:
    """(input, output) places within a match that go together; None for what has no partner."""
    if rule.groups is None:
        n = len(rule.written)
        return [(k, k) for k in range(min(n, size))] + [(size - 1, k) for k in range(size, n)] + ([(k, n - 1 if n else None) for k in range(n, size)])
    found: list[dict] = []
    for side in rule.groups:
        places: dict = {}
        at = 0
        for name, chars in side:
            places.setdefault(name, []).extend(range(at, at + len(chars)))
            at += len(chars)
        found.append(places)
    into, outof = found
    total_in, out = sum(map(len, into.values())), []
    for name, ins in into.items():
        outs = outof.get(name, [])
        out += [(i, o) for i, o in zip(ins, outs)]
        out += [(ins[-1], o) for o in outs[len(ins) :]]
        out += [(i, None) for i in ins[len(outs) :]]
    known = {o for _, o in out}
    out += [(None, o) for outs in outof.values() for o in outs if o not in known]
    # a pattern may match more or fewer characters than it is written with
    out += [(i, None) for i in range(total_in, size)]
    return [(i, o) for i, o in out if i is None or i < size]


def _apply(rule: Compiled, chars: list[str], sources: list[tuple], gone: list[int], delimiter: str, trace: list | None, mapping: Mapping):
    text = "".join(chars)
    matches = [m.span() for m in rule.match.finditer(text) if m.end() > m.start()]
    if not matches:
        return chars, sources
    out_chars: list[str] = []
    out_sources: list[tuple] = []
    at = 0
    for start, end in matches:
        out_chars += chars[at:start]
        out_sources += sources[at:start]
        at = end
        written = rule.written
        own: list[dict] = [{} for _ in written]
        dropped = []
        for i, o in _pairs(rule, end - start):
            if o is None:
                dropped.append(sources[start + i])
            elif i is not None:
                own[o].update(dict.fromkeys(sources[start + i]))
        for k, found in enumerate(own):
            if not found:  # no partner of its own: that of its neighbour
                own[k] = dict(own[k - 1]) if k else dict.fromkeys(s for j in range(start, end) for s in sources[j])
        out_chars += written
        out_sources += [tuple(s) for s in own]
        gone += [s for d in dropped for s in d]
        if delimiter:
            last = out_sources[-1] if written else (sources[end - 1] if end > start else ())
            out_chars += delimiter
            out_sources += [last] * len(delimiter)
    out_chars += chars[at:]
    out_sources += sources[at:]
    if trace is not None:
        after = "".join(out_chars)
        if after != text or rule.rule.context_before or rule.rule.context_after:
            trace += [{"input": text, "output": reveal(mapping, after), "rule": rule.rule.to_dict(), "start": a, "end": b} for a, b in matches]
    return out_chars, out_sources


def transduce(mapping: Mapping, text: str, trace: bool = False) -> Outcome:
    """A rule mapping applied to a text, with edges from the text's characters."""
    ready, moved = prepare(mapping, text)
    chars, sources, gone, steps = list(ready), [(k,) for k in range(len(ready))], [], [] if trace else None
    for rule in mapping.compiled:
        chars, sources = _apply(rule, chars, sources, gone, mapping.out_delimiter, steps, mapping)
    output = reveal(mapping, "".join(chars))
    edges = [(s, k) for k, own in enumerate(sources) for s in own]
    kept = {s for s, _ in edges}
    edges += [(s, None) for s in dict.fromkeys(gone) if s not in kept]
    edges = E.compose(moved, E.repair(edges))
    edges = [(a, b) for a, b in edges if a < len(text)]
    if mapping.preserve_case:
        output = preserve_case(text, output, edges, mapping.case_equivalencies)
    return Outcome(text, output, edges, steps or [])


def _spread(spans: list, size: int, n: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of `size` characters the first place after a rule, and how many from there on are paired with it: matches are `spans`, the
    output has n characters and d of a delimiter. The same pairs as _pairs() without index notation."""
    start, end = np.asarray(spans, np.int64).T
    length = end - start
    grown = np.zeros(size, np.int64)
    grown[start] = n + d - length
    base = np.arange(size) + np.cumsum(grown) - grown  # right for gaps and the first character of a match
    many = np.ones(size, np.int64)
    at = np.repeat(start, length)
    k = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    inside = at + k
    if n:
        last = np.minimum(n, np.repeat(length, length)) - 1
        base[inside] = base[at] + np.minimum(k, last)
        many[inside] = np.where(k >= last, n + d - last, 1)
    else:
        base[inside] = base[at]
        many[inside] = np.where(k == np.repeat(length, length) - 1, d, 0)
    return base, many


def _expanded(first: np.ndarray, base: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Edges (n, 2) whose second place becomes each of `many` places from `base` on, sorted, each once."""
    count = many[first[:, 1]]
    a, at = np.repeat(first[:, 0], count), np.repeat(base[first[:, 1]], count)
    return _sorted_once(np.stack([a, at + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)], 1))


def _sorted_once(edges: np.ndarray) -> np.ndarray:
    if not len(edges):
        return edges
    step = np.diff(edges, axis=0)
    if not ((step[:, 0] > 0) | (step[:, 0] == 0) & (step[:, 1] > 0)).all():
        edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
        edges = edges[np.append(True, (np.diff(edges, axis=0) != 0).any(1))]
    return edges


def _attached(edges: np.ndarray, size: int) -> np.ndarray:
    """Edges (n, 2) from all of `size` inputs: those without one go to the output before them, or else the one after; -1 if there is none."""
    known = np.zeros(size, bool)
    known[edges[:, 0]] = True
    if known.all():
        return edges
    if not len(edges):
        return np.stack([np.arange(size), np.full(size, -1)], 1)
    gone = np.flatnonzero(~known)
    before = np.searchsorted(edges[:, 0], gone) - 1
    return _sorted_once(np.concatenate([edges, np.stack([gone, edges[np.maximum(before, 0), 1]], 1)]))


def edge_arrays(mapping: Mapping, text: str) -> tuple[str, np.ndarray] | None:
    """What transduce() gives, the edges as an array (n, 2) with -1 for none; None for what it does not do: index notation, and texts
    that a normal form may change."""
    if mapping.type not in (None, "mapping") or any(r.groups is not None for r in mapping.compiled) or not (mapping.norm_form == "none" or text.isascii() and "\\" not in text):
        return None
    ready = T.unicode_escape(text)
    if not mapping.case_sensitive:
        ready = ready.lower()
    size = len(ready)
    edges = np.repeat(np.arange(size)[:, None], 2, 1)
    for rule in mapping.compiled:
        if rule.need and rule.need not in ready:
            continue
        spans = [m.span() for m in rule.match.finditer(ready) if m.end() > m.start()]
        if not spans:
            continue
        written = rule.written + mapping.out_delimiter
        edges = _expanded(edges, *_spread(spans, len(ready), len(rule.written), len(mapping.out_delimiter)))
        parts, at = [], 0
        for a, b in spans:
            parts += (ready[at:a], written)
            at = b
        ready = "".join([*parts, ready[at:]])
    output = reveal(mapping, ready)
    edges = _attached(edges, size)
    edges = edges[edges[:, 0] < len(text)]
    if mapping.preserve_case:
        output = preserved_case(text, output, edges, mapping.case_equivalencies)
    return output, edges


def composed_arrays(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Edges over two steps, both from edge_arrays(), where all inputs of a text have edges."""
    if not len(first) or first[0, 1] < 0 or not len(second) or second[0, 1] < 0:
        every = np.unique(first[:, 0])
        return np.stack([every, np.full(len(every), -1)], 1)
    low = np.searchsorted(second[:, 0], first[:, 1])
    count = np.searchsorted(second[:, 0], first[:, 1], side="right") - low
    a, at = np.repeat(first[:, 0], count), np.repeat(low, count)
    return _sorted_once(np.stack([a, second[at + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count), 1]], 1))


def cuts_of(source: str, target: str, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of functions.edges.segments() begin in both strings, and the strings' ends; of sorted edges."""
    if not len(edges) or edges[0, 1] < 0:
        return (np.asarray([0, len(source)]), np.asarray([0, len(target)])) if source or target else (np.zeros(1, np.int64),) * 2
    heads = np.flatnonzero(np.append(True, np.diff(edges[:, 0]) != 0))
    least = np.minimum.accumulate(np.minimum.reduceat(edges[:, 1], heads)[::-1])[::-1]
    most = np.maximum.accumulate(np.maximum.reduceat(edges[:, 1], heads))
    cut = np.flatnonzero(most[:-1] < least[1:]) + 1
    return np.concatenate([[0], edges[heads[cut], 0], [len(source)]]), np.concatenate([[0], least[cut], [len(target)]])


def preserved_case(source: str, target: str, edges: np.ndarray, equivalents: dict[str, str]) -> str:
    """preserve_case() of sorted edges: only pieces that hold upper case or its equivalents are looked at."""
    down = set(equivalents.values())
    found: list[np.ndarray] = []
    here, there = cuts_of(source, target, edges)
    for text, cuts in ((source, here), (target, there)):
        marks = [c for c in set(text) if c.isupper() or c in down]
        at = np.asarray([m.start() for m in regex.finditer("|".join(map(regex.escape, marks)), text)] if marks else [], np.int64)
        found.append(np.searchsorted(cuts, at, side="right") - 1)
    out, done = [], 0
    for k in np.unique(np.concatenate(found)).tolist():
        a, b, c, d = int(here[k]), int(here[k + 1]), int(there[k]), int(there[k + 1])
        out += (target[done:c], preserve_case(source[a:b], target[c:d], [(0, 0)] if b > a and d > c else [], equivalents))
        done = d
    return "".join([*out, target[done:]])


def cased_by_character(mapping: Mapping, text: str) -> str | None:
    """The output of a mapping that preserves case, where its rules make one character of one, so that pieces are characters; else None."""
    if mapping.norm_form != "none" or mapping.out_delimiter or any(len(r.plain) != 1 or len(r.output) != 1 for r in mapping.compiled) or "\\" in text or len(text.lower()) != len(text):
        return None
    plain, down = rewrite(mapping, text), set(mapping.case_equivalencies.values())
    out, known = list(plain), {}
    for side in (text, plain):
        marks = [c for c in set(side) if c.isupper() or c in down]
        for m in regex.finditer("[" + "".join(map(regex.escape, marks)) + "]", side) if marks else ():
            k = m.start()
            pair = text[k], plain[k]
            if pair not in known:
                known[pair] = preserve_case(*pair, [(0, 0)], mapping.case_equivalencies)
            out[k] = known[pair]
    return "".join(out)


def preserve_case(source: str, target: str, edges: list, equivalents: dict[str, str]) -> str:
    """Upper case for pieces of the output whose input has some, by the smallest pieces that align."""
    up, down, out = dict(equivalents), {b: a for a, b in equivalents.items()}, []
    for before, after in E.segments(source, target, edges):
        upper = any(c.isupper() or c in down for c in before)
        lower = any(c.islower() or c in up for c in before)
        if upper:
            out.append("".join(up.get(c, c.upper() if c.islower() else c) for c in after))
        elif lower:
            out.append("".join(down.get(c, c.lower() if c.isupper() else c) for c in after))
        else:
            out.append(after)
    return "".join(out)
