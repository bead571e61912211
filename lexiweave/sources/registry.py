"""All mappings that are known, the network they make, and conversions and tokenizers over it."""

from __future__ import annotations

import gzip
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidLanguageCode, MappingMissing, NeuralDependencyError, NoPath
from ..functions import text as T
from ..operators.tokenizers import Tokenizer, TokenizerLibrary
from ..operators.transducers import BaseTransducer, CompositeTransducer, TokenizingTransducer, Transducer
from ..plans.mapping import Mapping
from ..plans.network import LanguageNetwork, node_link_data
from . import builtin
from .files import load_config

#: Folders whose mappings are no languages of their own.
HIDDEN_FOLDERS = ("generated", "font-encodings")
#: Languages for which no pronunciation is offered, and endings of names of steps on the way.
NOT_OFFERED, STEPS = ("und-ascii", "moh-festival"), ("-ipa", "-equiv", "-no-symbols")


class Registry:
    """Mappings in order, with the folder each came from. A registry does not change others; overlay() makes a larger one."""

    def __init__(self, mappings: list[tuple[str, Mapping]]):
        self.entries = list(mappings)
        self.network = LanguageNetwork((m.in_lang, m.out_lang) for _, m in self.entries)
        self._made: dict = {}
        self.tokenizers = TokenizerLibrary(self._for_tokenizer, self.network.successors)

    @classmethod
    def default(cls) -> Registry:
        return cls([("builtin", m) for m in builtin.mappings()])

    @classmethod
    def from_folder(cls, folder: str | Path, *, with_builtin: bool = False) -> Registry:
        """Of each configuration one level below the folder, folders by name."""
        found = sorted(Path(folder).glob("*/config-g2p.y*ml"), key=lambda p: p.parent.stem)
        if not found:
            raise FileNotFoundError(f"no configurations under {folder}")
        entries = [(p.parent.stem, m) for p in found for m in load_config(p, skip_missing=True)]
        return cls((cls.default().entries if with_builtin else []) + entries)

    def overlay(self, mappings: list[Mapping]) -> Registry:
        return Registry([*self.entries, *(("overlay", m) for m in mappings)])

    @property
    def mappings(self) -> list[Mapping]:
        return [m for _, m in self.entries]

    def find_mapping(self, in_lang: str, out_lang: str, neural: bool = False) -> Mapping:
        """The last one between two languages that is not neural; with neural the first that is, if there is one."""
        found = [m for m in self.mappings if (m.in_lang, m.out_lang) == (in_lang, out_lang)]
        if neural and (nets := [m for m in found if m.type == "neural"]):
            return nets[0]
        found = [m for m in found if m.type != "neural"]
        if not found:
            raise MappingMissing(in_lang, out_lang)
        return found[-1]

    def _for_tokenizer(self, in_lang, out_lang) -> Mapping | None:
        try:
            return self.find_mapping(in_lang, out_lang)
        except MappingMissing:
            return None

    def find_mapping_by_id(self, id_: str) -> Mapping:
        for m in self.mappings:
            if m.id == id_:
                return m
        raise MappingMissing(id_)

    def available_languages(self) -> list[str]:
        return sorted({m.language_name for f, m in self.entries if f not in HIDDEN_FOLDERS})

    def available_mappings(self) -> list[dict]:
        return [{"in_lang": m.in_lang, "out_lang": m.out_lang, "display_name": m.display_name} for _, m in self.entries]

    def path(self, in_lang: str, out_lang: str) -> list[str]:
        for code in (in_lang, out_lang):
            if code not in self.network:
                raise InvalidLanguageCode(code)
        if in_lang == out_lang:
            raise NoPath(in_lang, out_lang)
        try:
            return self.network.shortest_path(in_lang, out_lang)
        except ValueError as e:
            raise NoPath(in_lang, out_lang) from e

    def make_tokenizer(self, in_lang: str | None = None, out_lang: str | None = None, tok_path: list[str] | None = None) -> Tokenizer:
        return self.tokenizers.make_tokenizer(in_lang, out_lang, tok_path)

    def make_g2p(self, in_lang: str, out_lang: str, *, tokenize: bool = True, custom_tokenizer: Tokenizer | None = None, neural: bool = False) -> BaseTransducer:
        """The conversion along the shortest path, of words unless tokenize is off. Made once for each set of arguments."""
        key = (in_lang, out_lang, tokenize, neural, id(custom_tokenizer) if custom_tokenizer else None)
        if key not in self._made:
            path = self.path(in_lang, out_lang)
            steps = [self.find_mapping(a, b, neural) for a, b in zip(path, path[1:])]
            if neural and not any(m.type == "neural" for m in steps):
                raise NeuralDependencyError(f"no neural mapping lies between {in_lang} and {out_lang}")
            chain: BaseTransducer = Transducer(steps[0]) if len(steps) == 1 else CompositeTransducer([Transducer(m) for m in steps])
            if custom_tokenizer or tokenize:
                chain = TokenizingTransducer(chain, custom_tokenizer or self.make_tokenizer(in_lang, None, path))
            self._made[key] = (chain, custom_tokenizer)  # the tokenizer stays, so that its id does
        return self._made[key][0]

    def arpabet_languages(self) -> tuple[list[str], dict[str, str]]:
        """Languages that lead to eng-arpabet, with their names, sorted."""
        names: dict[str, str] = {}
        for m in self.mappings:
            lang = m.in_lang
            if not lang.endswith(STEPS) and lang not in NOT_OFFERED and "eng-arpabet" in self.network and lang in self.network.ancestors("eng-arpabet"):
                names.setdefault(lang, m.language_name)
        names = dict(sorted(names.items()))
        return list(names), names

    # as rows and files

    def edge_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(self.network.edges)], "ord int, src string, dst string")

    def mapping_rows(self, spark: SparkSession) -> DataFrame:
        import dataclasses

        rules = [[r.to_dict() | {"comment": r.comment} for r in m.rules] for m in self.mappings]
        config = [json.dumps({x.name: getattr(m, x.name) for x in dataclasses.fields(m) if x.name != "as_is"} | {"rules": r}, ensure_ascii=False) for m, r in zip(self.mappings, rules)]
        rows = [(k, f, m.id, m.in_lang, m.out_lang, m.type or "mapping", m.language_name, m.display_name, [(r.rule_input, r.rule_output, r.context_before, r.context_after, r.prevent_feeding) for r in m.rules], config[k]) for k, (f, m) in enumerate(self.entries)]
        return spark.createDataFrame(rows, "ord int, dir string, id string, in_lang string, out_lang string, type string, language_name string, display_name string, rules array<struct<`in`:string,out:string,context_before:string,context_after:string,prevent_feeding:boolean>>, config string")

    def write(self, spark: SparkSession, path: str) -> None:
        """Mappings and network as Parquet; read() has them back without the files they came from."""
        self.mapping_rows(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/mappings")
        self.edge_rows(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/edges")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Registry:
        """What write() has written, from wherever Spark reads: mappings in their order with all that a configuration says."""
        entries = []
        for r in spark.read.parquet(f"{path}/mappings").select("ord", "dir", "config").orderBy("ord").collect():
            said = json.loads(r["config"])
            if said.get("alignments") is not None:
                said["alignments"] = [(w, [tuple(u) for u in units]) for w, units in said["alignments"]]
            entries.append((r["dir"], Mapping(**said)))
        return cls(entries)

    def write_network(self, path: str | Path) -> None:
        """The network as compressed JSON, the same bytes for the same network."""
        Path(path).write_bytes(gzip.compress(json.dumps(node_link_data(self.network), ensure_ascii=False).encode(), mtime=0))

    def is_ipa_step(self, m: Mapping) -> bool:
        return T.is_ipa(m.out_lang)
