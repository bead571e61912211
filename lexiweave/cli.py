"""The command line: convert, scan, doctor, generate-mapping, show-mappings, update, update-schema, serve."""

from __future__ import annotations

import argparse
import pprint
import sys

from . import api
from .errors import CommandLineError, EngineError
from .operators import checks, inventories
from .sources import files


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lexiweave").getOrCreate()


def convert(args) -> None:
    if args.no_tok and args.tok_lang:
        raise CommandLineError("--tok-lang says how to tokenise, --no-tok not to")
    known = api.with_config(args.config) if args.config else api.registry()
    made = known.make_g2p(args.in_lang, args.out_lang, tokenize=not args.no_tok, custom_tokenizer=known.make_tokenizer(args.tok_lang) if args.tok_lang else None, neural=args.neural)
    if args.spark:
        from .operators.columns import convert as column
        from pyspark.sql import functions as F

        lines = files.text_lines(_session(), args.text)
        lines.select(column(made, F.col("value")).alias("value")).write.text(args.spark)
        return
    source = [args.text] if not args.file else sys.stdin if args.text == "-" else open(args.text, encoding="utf-8")
    arpabet = set(known.find_mapping("eng-ipa", "eng-arpabet").inventory("out")) if args.check and "eng-arpabet" in known.network else set()
    for line in source:
        graph = made(line)
        sys.stdout.write(graph.output_string if args.file else graph.output_string + "\n")
        if args.check and not checks.check_outcome(made, graph, arpabet=arpabet):
            print(f"Warning: the output of {line!r} is not what {args.out_lang} promises", file=sys.stderr)
        for on, what in ((args.edges, graph.pretty_edges), (args.alignments, graph.substring_alignments), (args.debugger, lambda g=graph: g.debugger)):
            if on:
                pprint.pprint(what())


def scan(args) -> None:
    chars, sensitive = checks.mapped_characters(api.registry().mappings, args.lang)
    for r in checks.unmapped(files.text_lines(_session(), args.path), "value", chars, case_sensitive=sensitive).orderBy("char").collect():
        print(f"{r.char}\t{r.n}")


def doctor(args) -> None:
    for a, b, out in checks.unknown_outputs([m for m in api.registry().mappings if not args.mapping or args.mapping in (m.in_lang, m.out_lang)]):
        print(f"{a} to {b}: {out!r} is no IPA")


def show_mappings(args) -> None:
    for m in api.registry().mappings:
        if not args.lang or args.lang in (m.in_lang, m.out_lang):
            print(f"{m.in_lang} -> {m.out_lang}: {m.display_name} ({m.type or 'mapping'}, {len(m.rules)} rules)")


def language_spec(known, spec: str) -> list[tuple]:
    """Mappings and their sides that a specification names: LANG, IN_to_OUT, or IN_to_OUT[in] or [out]."""
    from .functions.text import is_ipa

    name, bracket, side = spec.partition("[")
    side = side.rstrip("]")
    in_lang, between, out_lang = name.partition("_to_")
    if between:
        m = known.find_mapping(in_lang, out_lang)
        side = side or ("out" if is_ipa(out_lang) else "in" if is_ipa(in_lang) else "")
        if side not in ("in", "out"):
            raise CommandLineError(f"{spec}: say [in] or [out], as neither side is IPA" if not side else f"{spec}: only [in] and [out] are sides")
        return [(m, side)]
    if bracket:
        raise CommandLineError(f"{spec}: a side goes with IN_to_OUT only")
    if in_lang == "eng":
        return [(known.find_mapping("eng-ipa", "eng-arpabet"), "in")]
    found = [m for m in known.mappings if m.out_lang == f"{in_lang}-ipa" and not is_ipa(m.in_lang)]
    if not found:
        raise CommandLineError(f"no mappings lead to the IPA of {spec}")
    return [(known.find_mapping(m.in_lang, m.out_lang), "out") for m in found]


def generate_mapping(args) -> None:
    known = api.registry()
    modes = [args.ipa, args.dummy, args.list_dummy, bool(args.source or args.target)]
    if sum(modes) != 1 or bool(args.source) != bool(args.target):
        raise CommandLineError("choose one of --ipa, --dummy, --list-dummy, and --from with --to")
    if args.source:
        made = [inventories.create_multi_mapping(language_spec(known, args.source), language_spec(known, args.target), distance_name=args.distance)]
    else:
        if not args.lang:
            raise CommandLineError("a language is needed")
        own = [m for m in known.mappings if args.lang in (m.in_lang, f"{m.in_lang}-ipa", m.out_lang.removesuffix("-ipa")) and (m.out_lang.endswith("ipa") or not args.ipa)]
        if not own:
            raise CommandLineError(f"no mappings begin at {args.lang}")
        if args.ipa:
            target = known.find_mapping("eng-ipa", "eng-arpabet")
            made = [inventories.create_multi_mapping([(m, "out") for m in own], [(target, "in")], distance_name=args.distance)] if args.merge else [inventories.create_mapping(m, target, distance_name=args.distance) for m in own]
        else:
            read = known.make_g2p("und", "und-ipa", tokenize=False).text if "und" in known.network else None
            made = [inventories.align_to_dummy_fallback(m, "out", und_to_ipa=read, distance_name=args.distance) for m in own]
    for m in made:
        if args.list_dummy:
            sys.stdout.write(files.mapping_to_text(m, "csv"))
        else:
            files.mapping_to_file(m, args.folder)
            files.config_to_file(m, f"{args.folder}/config-g2p.yaml")


def update(args) -> None:
    from .sources.registry import Registry

    Registry.from_folder(args.folder).write(_session(), args.out)


def update_schema(args) -> None:
    """Writes a JSON schema of configurations."""
    import json
    from pathlib import Path

    Path(args.out).write_text(json.dumps(files.config_schema(), indent=2, ensure_ascii=False) + "\n", "utf-8")


def serve(args) -> None:
    from . import service

    service.serve(args.host, args.port)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiweave")
    p.add_argument("--mappings", help="folder of mappings besides those built in")
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("convert")
    for name in ("text", "in_lang", "out_lang"):
        c.add_argument(name)
    for flag in ("-a/--alignments", "-e/--edges", "-d/--debugger", "-f/--file", "-c/--check", "-n/--neural", "--no-tok"):
        c.add_argument(*flag.split("/"), action="store_true")
    c.add_argument("-t", "--tok-lang")
    c.add_argument("--config")
    c.add_argument("--spark", metavar="FOLDER", help="convert the file TEXT in Spark, to this folder")
    c.set_defaults(run=convert)
    s = sub.add_parser("scan")
    s.add_argument("lang")
    s.add_argument("path")
    s.set_defaults(run=scan)
    d = sub.add_parser("doctor")
    d.add_argument("-m", "--mapping")
    d.set_defaults(run=doctor)
    m = sub.add_parser("show-mappings")
    m.add_argument("lang", nargs="?")
    m.set_defaults(run=show_mappings)
    g = sub.add_parser("generate-mapping")
    g.add_argument("lang", nargs="?")
    for flag in ("--ipa", "--dummy", "--list-dummy", "--merge"):
        g.add_argument(flag, action="store_true")
    g.add_argument("--from", dest="source", metavar="SPEC")
    g.add_argument("--to", dest="target", metavar="SPEC")
    g.add_argument("--folder", default=".")
    g.add_argument("--distance", default=inventories.METHODS[0], choices=inventories.METHODS)
    g.set_defaults(run=generate_mapping)
    u = sub.add_parser("update")
    u.add_argument("folder")
    u.add_argument("out")
    u.set_defaults(run=update)
    j = sub.add_parser("update-schema")
    j.add_argument("out")
    j.set_defaults(run=update_schema)
    w = sub.add_parser("serve")
    w.add_argument("--host", default="127.0.0.1")
    w.add_argument("--port", type=int, default=8000)
    w.set_defaults(run=serve)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.mappings:
        api.load_folder(args.mappings)
    try:
        args.run(args)
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
