"""Rule files, abbreviations, lexicons and configurations: read and written on the driver, since the order of rules counts.

rule_rows() has the same rules as rows in Spark, each with its place.
"""

from __future__ import annotations

import csv
import io
import json
import warnings
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..errors import IncorrectFileType, MalformedMapping
from ..operators.lexicon import parse_alignment
from ..plans.mapping import Mapping, Rule, abbreviations_from_rows

DELIMITERS = {".csv": ",", ".tsv": "\t", ".psv": "|"}
BOM = "﻿"
COLUMNS = ("in", "out", "context_before", "context_after")
#: Keys of a configuration that are fields of a mapping.
FIELDS = ("id in_lang out_lang language_name display_name case_sensitive case_equivalencies preserve_case escape_special norm_form out_delimiter reverse rule_ordering as_is prevent_feeding type authors abbreviations rules alignments").split()


def delimited_rows(text: str, delimiter: str) -> list[list[str]]:
    return [[c.replace(BOM, "") for c in row] for row in csv.reader(io.StringIO(text), delimiter=delimiter) if any(c.strip() for c in row)]


def rules_from_rows(rows: list[list[str]]) -> list[dict]:
    if rows and [c.strip() for c in rows[0][:2]] == ["in", "out"]:
        rows = rows[1:]
    for row in rows:
        if len(row) < 2:
            raise MalformedMapping(f"a rule needs an input and an output: {row}")
    return [dict(zip(COLUMNS, [*row[:4], "", ""])) for row in rows]


def load_rules(path: str | Path) -> list[dict]:
    """Rules of a csv, tsv, psv, xlsx (where openpyxl is there) or json file, in order; an empty one is malformed."""
    path = Path(path)
    kind = path.suffix.lower()
    if kind in DELIMITERS:
        rules = rules_from_rows(delimited_rows(path.read_text("utf-8-sig"), DELIMITERS[kind]))
    elif kind == ".json":
        rules = json.loads(path.read_text("utf-8"))
    elif kind == ".xlsx":
        rules = _workbook(path)
    else:
        raise IncorrectFileType(f"{path}: rules come from csv, tsv, psv, xlsx and json files")
    if not rules:
        raise MalformedMapping(f"{path} has no rules")
    return rules


def _workbook(path: Path) -> list[dict]:
    try:
        from openpyxl import load_workbook
    except ImportError as e:
        raise IncorrectFileType(f"{path}: workbooks need openpyxl") from e
    sheet = load_workbook(path, read_only=True).active
    return rules_from_rows([["" if c is None else str(c) for c in row] for row in sheet.iter_rows(max_col=4, values_only=True) if any(row)])


def load_abbreviations(path: str | Path) -> dict[str, list[str]]:
    path = Path(path)
    if path.suffix.lower() not in DELIMITERS:
        raise IncorrectFileType(f"{path}: abbreviations come from csv, tsv and psv files")
    return abbreviations_from_rows(delimited_rows(path.read_text("utf-8-sig"), DELIMITERS[path.suffix.lower()]))


def load_alignments(path: str | Path) -> list[tuple[str, list[tuple[int, str]]]]:
    """Words with their units, sorted; empty lines are left out."""
    return sorted(parse_alignment(line) for line in Path(path).read_text("utf-8").splitlines() if line.strip())


def mapping_from_config(entry: dict, parent: str | Path = ".") -> Mapping:
    """A mapping from an entry of a configuration; files are relative to parent, keys that are not known are kept apart."""
    entry = dict(entry)
    for key, load in (("rules", load_rules), ("abbreviations", load_abbreviations), ("alignments", load_alignments)):
        path = entry.pop(f"{key}_path", None)
        if path:
            entry[key] = load(Path(parent) / path)
    for key in ("rules", "abbreviations", "alignments"):
        if isinstance(entry.get(key), str):
            entry[key] = {"rules": load_rules, "abbreviations": load_abbreviations, "alignments": load_alignments}[key](Path(parent) / entry[key])
    known = {k: entry.pop(k) for k in FIELDS if k in entry}
    return Mapping(**{k: v for k, v in known.items() if v is not None or k == "norm_form"}, extra=entry)


def load_config(path: str | Path, *, skip_missing: bool = False) -> list[Mapping]:
    """All mappings of a YAML configuration, in order. skip_missing: those whose files are not there are warned of and left out."""
    path = Path(path)
    data = yaml.safe_load(path.read_text("utf-8")) or {}
    if not isinstance(data, dict) or "mappings" not in data:
        raise MalformedMapping(f"{path} has no list of mappings")
    found = []
    for entry in data["mappings"]:
        try:
            found.append(mapping_from_config(entry, path.parent))
        except FileNotFoundError as e:
            if not skip_missing:
                raise
            warnings.warn(f"{path}: the mapping from {entry.get('in_lang')} to {entry.get('out_lang')} is left out, as {e.filename} is not there", stacklevel=2)
    return found


def load_mapping(path: str | Path, index: int = 0) -> Mapping:
    return load_config(path)[index]


def rule_rows(spark: SparkSession, mapping: Mapping) -> DataFrame:
    rows = [(k, r.rule_input, r.rule_output, r.context_before, r.context_after, r.prevent_feeding, r.comment) for k, r in enumerate(mapping.rules)]
    return spark.createDataFrame(rows, "ord int, `in` string, out string, context_before string, context_after string, prevent_feeding boolean, comment string")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule file through Spark's readers, so from wherever they read: ord and the four columns."""
    kind = Path(path).suffix.lower()
    lines = spark.read.text(path, wholetext=True).head()[0]
    if kind in DELIMITERS:
        rules = rules_from_rows(delimited_rows(lines, DELIMITERS[kind]))
    elif kind == ".json":
        rules = json.loads(lines)
    else:
        raise IncorrectFileType(path)
    return rule_rows(spark, Mapping(rules))


def golden_rows(spark: SparkSession, path: str, delimiter: str = "|") -> DataFrame:
    """in_lang, out_lang, input, expected of a file of examples; lines that begin with # are comments, further columns are left out."""
    rows = spark.read.csv(path, sep=delimiter, comment="#", header=False, encoding="UTF-8")
    rows = rows.select(*[rows[c].alias(n) for c, n in zip(rows.columns, ("in_lang", "out_lang", "input", "expected"))])
    return rows.where("expected is not null")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


# Sinks


def mapping_to_text(mapping: Mapping, kind: str = "json") -> str:
    rules = mapping.plain_mapping()
    if kind == "json":
        return "[\n" + ",\n".join("    " + json.dumps(r, ensure_ascii=False) for r in rules) + "\n]\n"
    if kind in ("csv", "tsv", "psv"):
        out = io.StringIO()
        writer = csv.writer(out, delimiter=DELIMITERS[f".{kind}"], lineterminator="\n")
        writer.writerows([[r.get(c, "") for c in COLUMNS] for r in rules])
        return out.getvalue()
    raise IncorrectFileType(f"rules are written as json, csv, tsv and psv, not {kind}")


def mapping_to_file(mapping: Mapping, folder: str | Path, kind: str = "json") -> Path:
    path = Path(folder) / f"{mapping.in_lang}_to_{mapping.out_lang}.{kind}"
    path.write_text(mapping_to_text(mapping, kind), "utf-8")
    return path


def config_entry(mapping: Mapping, rules_kind: str = "json") -> dict:
    default = Mapping([Rule("a", "b")])
    out = {"in_lang": mapping.in_lang, "out_lang": mapping.out_lang, "language_name": mapping.language_name, "display_name": mapping.display_name, "rules_path": f"{mapping.in_lang}_to_{mapping.out_lang}.{rules_kind}"}
    for k in FIELDS:
        if k not in out and k not in ("rules", "alignments", "as_is") and getattr(mapping, k) != getattr(default, k):
            out[k] = getattr(mapping, k)
    return out


def config_to_file(mapping: Mapping, path: str | Path, rules_kind: str = "json") -> None:
    """Adds the mapping to a configuration; where its languages are there already only the authors are renewed."""
    path = Path(path)
    data = (yaml.safe_load(path.read_text("utf-8")) if path.exists() else None) or {"mappings": []}
    for m in data["mappings"]:
        if (m.get("in_lang"), m.get("out_lang")) == (mapping.in_lang, mapping.out_lang):
            m["authors"] = list(mapping.authors)
            break
    else:
        data["mappings"].append(config_entry(mapping, rules_kind))
    path.write_text(yaml.safe_dump(data, allow_unicode=True, sort_keys=False), "utf-8")


def config_schema() -> dict:
    """A JSON schema of configurations, from the fields of a mapping."""
    import dataclasses
    import typing

    from ..plans.mapping import NORM_FORMS, ORDERINGS, TYPES

    kinds = {str: "string", bool: "boolean", dict: "object", list: "array", type(None): "null"}
    hints, fields = typing.get_type_hints(Mapping), {}
    for f in dataclasses.fields(Mapping):
        if f.name != "extra":
            parts = typing.get_args(hints[f.name]) or (hints[f.name],)
            names = [kinds[typing.get_origin(p) or p] for p in parts]
            fields[f.name] = {"type": names[0] if len(names) == 1 else names}
    for name, values in (("norm_form", NORM_FORMS), ("rule_ordering", ORDERINGS), ("type", TYPES)):
        fields[name] = {"enum": sorted(values) + ([None] if name != "rule_ordering" else [])}
    rule = {k: {"type": "string"} for k in COLUMNS} | {"prevent_feeding": {"type": "boolean"}, "comment": {"type": ["string", "null"]}}
    fields["rules"] = {"anyOf": [{"type": "string"}, {"type": "array", "items": {"type": "object", "properties": rule, "required": ["in", "out"]}}]}
    fields |= {f"{k}_path": {"type": "string"} for k in ("rules", "abbreviations", "alignments")}
    mapping = {"type": "object", "properties": fields, "required": ["in_lang", "out_lang"]}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "properties": {"mappings": {"type": "array", "items": mapping}}, "required": ["mappings"]}
