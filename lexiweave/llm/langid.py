"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are counts of character n-grams (bytes of the lower-cased UTF-8, lengths 1 to 4), hashed into DIM places and taken as
square roots of their shares, over the whole text. Models are fitted on at most `per_language` distinct labelled texts of each
language, those with the smallest hash (all of them where there are fewer), and where there are so many languages that this were more than
GATHERED texts in all, on an even share of that for each, AT_LEAST at least: no language is left out. Everything else is computed over all rows. Families are those of the languages where
known; a language of no known family makes one of its own, and within a family each pair of languages has a machine. Rows
whose text is null or has no letter are `und` with score 0, as are all rows where nothing could be learned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, fresh, give_back, small, stored, trimmed

DIM = 1 << 13
#: Bounds of what is gathered to fit: labelled texts of a language, of all languages, and of each however many languages there are.
PER_LANGUAGE, GATHERED, AT_LEAST = 400, 8_000, 8
#: Texts of a language that its gate learns from, the fewest that make one, and the share of clean pieces that are to pass.
GATE_TEXTS, GATE_LEAST, KEPT = 120, 10, 0.995
#: Texts of fewer letters are not judged: a word alone cannot be told from junk.
LETTERS = 10
#: Language codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv", "uralic": "fi et hu", "celtic": "cy ga gd br", "turkic": "tr az kk uz ky", "indic": "hi bn ur pa mr gu ne", "semitic": "ar he mt am", "sinitic": "zh yue wuu", "austronesian": "id ms tl jv",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def family(language: str) -> str:
    return FAMILY.get(language.lower().replace("_", "-").split("-")[0], language)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str) -> np.ndarray:
    """A vector of unit length."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out, h = np.zeros(DIM), np.zeros(len(data), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(4):
            if len(data) <= n:
                break
            h = (h[: len(data) - n] + data[n:] + np.uint32(1)) * _MULTIPLIERS[n]
            h ^= h >> np.uint32(15)
            counts = np.bincount((h & np.uint32(DIM - 1)).astype(np.int64), minlength=DIM)
            out += counts * (1.0 / (len(data) - n))
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12) -> np.ndarray:
    """A linear machine with squared hinge loss by dual coordinate descent; the last weight is the bias. y is 1 or -1."""
    plain, x = x, np.ones((len(x), x.shape[1] + 1))
    x[:, :-1] = plain
    w, alpha, rng = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(0)
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    ridge = 1 / (2 * c * share)
    square = np.einsum("ij,ij->i", x, x) + ridge
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = (1 - y[i] * (x[i] @ w) - ridge[i] * alpha[i]) / square[i]
            new = max(0.0, alpha[i] + step)
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(m, -40, 40)))


class Classifier:
    """Machines for families (one against the rest) and for pairs of languages within one."""

    def __init__(self, families: list[str], first: np.ndarray, members: dict[str, list[str]], pairs: dict[str, np.ndarray]):
        self.families, self.first, self.members, self.pairs = families, first, members, pairs
        self.gates: dict[str, tuple[np.ndarray, float]] = {}

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> Classifier | None:
        if not labels:
            return None
        kinds = sorted(set(labels))
        names = np.array(labels)
        of = np.array([family(k) for k in labels])
        families = sorted(set(of))
        first = np.array([machine(x, np.where(of == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else np.zeros((1, x.shape[1] + 1))
        members, pairs = {}, {}
        for f in families:
            own = members[f] = [k for k in kinds if family(k) == f]
            made = []
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    rows = (names == a) | (names == b)
                    made.append(machine(x[rows], np.where(names[rows] == a, 1.0, -1.0)))
            pairs[f] = np.array(made).reshape(-1, x.shape[1] + 1)
        return cls(families, first, members, pairs)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the family's share times the language's mean share of its duels. Ties go to the first in order."""
        x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        p = _sigmoid(x1 @ self.first.T)
        p /= p.sum(axis=1, keepdims=True)
        chosen = p.argmax(axis=1)
        out, score = [""] * len(x), np.zeros(len(x))
        for k in set(chosen.tolist()):
            at = np.flatnonzero(chosen == k)
            own = self.members[self.families[k]]
            votes, shares, j = np.zeros((len(at), len(own))), np.zeros((len(at), len(own))), 0
            for a in range(len(own)):
                for b in range(a + 1, len(own)):
                    q = _sigmoid(x1[at] @ self.pairs[self.families[k]][j])
                    j += 1
                    votes[:, a] += q >= 0.5
                    votes[:, b] += q < 0.5
                    shares[:, a] += q
                    shares[:, b] += 1 - q
            rank = votes + shares / (len(own) + 1)
            best = rank.argmax(axis=1)
            share = shares[np.arange(len(at)), best] / (len(own) - 1) if len(own) > 1 else np.ones(len(at))
            for i, row in enumerate(at):
                out[row] = own[best[i]]
            score[at] = p[at, k] * share
        return out, np.clip(score, 0.0, 1.0)


    def readable(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        """Whether the margin of each text against junk, by the gate of its language, reaches that gate's bound."""
        x1 = np.hstack([folded(x), np.ones((len(x), 1), x.dtype)])
        gates = [self.gates.get(k) for k in names]
        return np.array([g is None or float(row @ g[0]) >= g[1] for row, g in zip(x1, gates)], bool)


def folded(x: np.ndarray) -> np.ndarray:
    """Vectors in a quarter of the places, which is enough for gates."""
    return x.reshape(*x.shape[:-1], 4, DIM // 4).sum(axis=-2)


def junk(text: str, rng: np.random.Generator) -> str:
    """A text of the same shape without language: each letter is one of a to z instead, or the letters change places."""
    letters = [i for i, c in enumerate(text) if c.isalpha()]
    out = list(text)
    if rng.integers(2):
        for i, c in zip(letters, rng.integers(97, 123, len(letters)).tolist()):
            out[i] = chr(c)
    else:
        for i, j in zip(letters, rng.permutation(letters).tolist()):
            out[i] = text[j]
    return "".join(out)


def cases(text: str, seed: int) -> list[tuple[bool, np.ndarray]]:
    """What a gate learns from a labelled text: pieces of one to twelve words and a longer one, each with two of junk in its shape."""
    rng, words, out = np.random.default_rng(seed & (1 << 63) - 1), text.split(), []
    for most in (3, 12, 200):
        n = int(rng.integers(1, most + 1))
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        piece = " ".join(words[at : at + n])
        if has_letter(piece):
            out += [(True, folded(features(piece))), *((False, folded(features(junk(piece, rng)))) for _ in range(2))]
    return out


def gate(x: np.ndarray, clean: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, float]:
    """A machine of clean text against junk, and the margin that all but a KEPT share of clean pieces reach when not learned from."""
    y, margins = np.where(clean, 1.0, -1.0), []
    for part in (0, 1):
        w = machine(x[group % 2 != part], y[group % 2 != part])
        margins.append(x[clean & (group % 2 == part)] @ w[:-1] + w[-1])
    return machine(x, y), min(0.0, float(np.quantile(np.concatenate(margins), 1 - KEPT)))


def held_out(docs: DataFrame):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sampled(docs: DataFrame, per_language: int, texts: bool = False) -> DataFrame | None:
    """lang, h, v, text (if asked for) and r: of each language the vectors of the `per_language` distinct texts of the smallest hashes."""
    bounded_batches(docs.sparkSession)
    labelled = docs.where("lang is not null and lang <> '' and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    # Copies count once from here on: the bounds are for distinct texts.
    labelled = labelled.withColumn("letters", F.col("text").rlike("\\p{L}"))
    hashes = stored(labelled.groupBy("lang", "h").agg(F.max("letters").alias("letters")), "hashes")
    counts = stored(hashes.groupBy("lang").agg(F.count_if("letters").alias("texts")).where("texts > 0"), "languages")
    kinds = counts.count()
    forget(hashes)
    if not kinds:
        return None
    per_language = min(per_language, max(AT_LEAST, GATHERED // kinds))
    # Hashes spread evenly, so the smallest few lie below a bound that the count gives; the exact number is cut afterwards.
    bound = F.least(F.lit(1.0), 2.0 * (per_language + 50) / F.col("texts")) * 2.0**64 - 2.0**63
    low = labelled.join(small(counts), "lang").where((F.col("h").cast("double") <= bound) & F.col("letters")).select("lang", "text", "h")
    low = stored(low.dropDuplicates(["lang", "h"]), "labelled")

    def vectors(batches):
        for batch in batches:
            rows = [(k, h, features(t).astype("<f2").tobytes(), t if texts else None) for k, t, h in zip(*(batch.column(c).to_pylist() for c in range(3))) if has_letter(t)]
            cols, types = list(zip(*rows)) or [[]] * 4, (pa.string(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["lang", "h", "v", "text"])

    from pyspark.sql import Window

    few = low.mapInArrow(vectors, "lang string, h long, v binary, text string")
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language)
    return stored(few, "sample", compact=True)


def _rows(few: DataFrame | None) -> list:
    return [] if few is None else sorted(few.select("lang", "h", "v").collect(), key=lambda r: (r["lang"], r["h"]))


def sample(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> list:
    """The rows (lang, h, v) to fit on, in order."""
    return _rows(_sampled(docs, per_language))


def _gates(few: DataFrame) -> dict[str, tuple[np.ndarray, float]]:
    """A gate for each language of enough texts, fitted where its texts are; only weights are gathered."""

    def fit(found: pa.Table) -> pa.Table:
        rows = sorted(zip(found["h"].to_pylist(), found["text"].to_pylist()))
        made = [c for c in (cases(t, h) for h, t in rows) if c] if len(rows) >= GATE_LEAST else []
        out = []
        if len(made) >= GATE_LEAST:
            w, bound = gate(np.array([x for c in made for _, x in c]), np.array([ok for c in made for ok, _ in c]), np.array([i for i, c in enumerate(made) for _ in c]))
            out = [(found["lang"][0].as_py(), w.tobytes(), bound)]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("lang", pa.string()), ("w", pa.binary()), ("bound", pa.float64())))})

    few = few.where(F.col("r") <= GATE_TEXTS).select("lang", "h", "text")
    return {r["lang"]: (np.frombuffer(r["w"]), r["bound"]) for r in few.groupBy("lang").applyInArrow(fit, "lang string, w binary, bound double").collect()}


def train(docs: DataFrame, *, per_language: int = PER_LANGUAGE, gates: bool = False) -> Classifier | None:
    """Fits on text and lang of the rows given, of which only a bounded number is gathered: as vectors of whole texts."""
    found = _sampled(docs, per_language, gates)
    few = _rows(found)
    if not few:
        return None
    labels, x = [r["lang"] for r in few], np.empty((len(few), DIM), np.float32)
    for k in range(len(few)):
        # vectors go from the list as they come into the array, so that the driver holds each once
        x[k], few[k] = np.frombuffer(few[k]["v"], "<f2"), None
    model = Classifier.fit(x, labels)
    del x
    give_back()
    if gates:
        model.gates = _gates(found)
    return model


def predict(docs: DataFrame, model: Classifier | None, columns: list[str], names: tuple[str, str] = ("lang_pred", "score"), *, readable: bool = False) -> DataFrame:
    """Adds the language and its score, under names of their own, to the columns asked for; readable: junk is `und`, too."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = fresh("_text", columns)
    rows = docs.select(*columns, F.col("text").alias(text))

    def run(batches):
        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            at = [i for i, t in enumerate(texts) if shared.value is not None and has_letter(t)]
            found, scores = ["und"] * len(texts), np.zeros(len(texts))
            for k in range(0, len(at), 250):
                part = at[k : k + 250]
                x = np.array([features(texts[i]) for i in part])
                got, score = shared.value.predict(x)
                if readable:
                    fine = shared.value.readable(x, got) | np.array([sum(map(str.isalpha, texts[i])) < LETTERS for i in part])
                    got, score = [k if ok else "und" for k, ok in zip(got, fine)], np.where(fine, score, 0.0)
                for i, name in zip(part, got):
                    found[i] = name
                scores[part] = score
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(found, pa.string()), pa.array(scores)], names=[*columns, *names])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lambda batches: trimmed(run(batches)), ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{names[0]}` string, `{names[1]}` double")


def identify(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score, a row for each row; learned from rows that are not held out."""
    model = train(docs.where(~held_out(docs)), per_language=per_language)
    return predict(docs.select("doc_id", held_out(docs).alias("held_out"), "text"), model, ["doc_id", "held_out"])


def only_known(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs that are text of a language and not junk, with what was found as their lang; other columns as they are.

    Junk is what a machine of the language found rejects, learned from labelled texts against junk of the same shape; the bound
    depends on that language's texts alone, not on how many others there are. Languages of fewer than GATE_LEAST texts have none, and texts
    of fewer than LETTERS letters pass. Null, empty and letterless texts go; rows are judged by their texts alone, so repeated rows stay or go alike.
    """
    model = train(docs.where(~held_out(docs)), per_language=per_language, gates=True)
    lang, score = fresh("_lang", docs), fresh("_score", docs)
    out = predict(docs, model, list(docs.columns), (lang, score), readable=True).where(F.col(lang) != "und")
    return out.withColumn("lang", F.col(lang)).select(*docs.columns)
