"""What a web service over conversions answers, as plain functions on JSON-like values, and `app`, which serves them over HTTP (WSGI).

Unknown languages raise InvalidLanguageCode (a 404), pairs without a path NoPath (a 400).
"""

from __future__ import annotations

from .errors import InvalidLanguageCode, NoPath
from .functions import edges as E
from .operators.tokenizers import Token
from .operators.transducers import Graph
from .sources.registry import Registry


def _known(registry: Registry, *codes: str) -> None:
    for code in codes:
        if code not in registry.network:
            raise InvalidLanguageCode(code)


def langs(registry: Registry) -> list[dict]:
    """Languages that are converted from, by code: those whose names do not say that they are a step on the way."""
    names: dict[str, str] = {}
    for folder, m in registry.entries:
        if not m.in_lang.endswith(("-ipa", "-equiv", "-no-symbols")) and folder not in ("generated", "font-encodings"):
            names.setdefault(m.in_lang, m.language_name)
    return [{"code": k, "name": v} for k, v in sorted(names.items())]


def nodes(registry: Registry) -> list[dict]:
    """All nodes of the network with a name."""
    names: dict[str, str] = {}
    for m in registry.mappings:
        names.setdefault(m.in_lang, m.language_name if not m.in_lang.endswith("-ipa") else f"{m.language_name} IPA")
        names.setdefault(m.out_lang, m.display_name)
    return [{"code": n, "name": names[n]} for n in sorted(registry.network.nodes)]


def outputs_for(registry: Registry, lang: str) -> list[str]:
    _known(registry, lang)
    return sorted(registry.network.descendants(lang))


def inputs_for(registry: Registry, lang: str) -> list[str]:
    _known(registry, lang)
    return sorted(registry.network.ancestors(lang))


descendants, ancestors = outputs_for, inputs_for


def path(registry: Registry, in_lang: str, out_lang: str) -> list[str]:
    _known(registry, in_lang, out_lang)
    try:
        return registry.network.shortest_path(in_lang, out_lang)
    except ValueError as e:
        raise NoPath(in_lang, out_lang) from e


def g2p(registry: Registry, in_lang: str, out_lang: str, text: str, *, index: bool = False, debugger: bool = False, tokenize: bool = False) -> dict:
    """A whole string, by default as one word."""
    graph = registry.make_g2p(in_lang, out_lang, tokenize=tokenize)(text)
    return {"input-text": graph.input_string, "output-text": graph.output_string, "debugger": debugger and graph.debugger, "index": index and graph.edges}


def _conversion(source: str, target: str, edges: list, in_lang: str | None, out_lang: str | None, indices: bool) -> dict:
    return {
        "in_lang": in_lang, "out_lang": out_lang, "input_nodes": list(source) if indices else None, "output_nodes": list(target) if indices else None,
        "alignments": edges if indices else None, "substring_alignments": E.segments(source, target, edges),
    }


def convert(registry: Registry, in_lang: str, out_lang: str, text: str, *, tokenize: bool = True, compose_from: str | None = None, indices: bool = False) -> list[dict]:
    """Segments of a text with their conversions, the last step first. compose_from: from that language on, steps are one."""
    made = registry.make_g2p(in_lang, out_lang)
    out = []
    for token in registry.make_tokenizer(in_lang).tokenize_text(text) if tokenize else [Token(text, True)]:
        if not token.is_word:
            same = [(k, k) for k in range(len(token.text))]
            out.append({"conversions": [_conversion(token.text, token.text, same, None, None, indices)]})
            continue
        steps = list(zip(made.transducers, made.outcomes(token.text)))
        first = next((k for k, (t, _) in enumerate(steps) if t.in_lang == compose_from), len(steps))
        found = [_conversion(o.input, o.output, o.edges, t.in_lang, t.out_lang, indices) for t, o in steps[:first]]
        if first < len(steps):
            rest = Graph([o for _, o in steps[first:]])
            found.append(_conversion(rest.input_string, rest.output_string, rest.alignments(), compose_from, made.out_lang, indices))
        out.append({"conversions": found[::-1]})
    return out


# HTTP: /api/v1 with single answers, /api/v2 with segments of texts. Any WSGI server runs app(); serve() runs Python's own.


def _body(environ: dict) -> dict:
    import json

    size = int(environ.get("CONTENT_LENGTH") or 0)
    return json.loads(environ["wsgi.input"].read(size) or b"{}") if size else {}


def _flag(value, default: bool) -> bool:
    return default if value is None else value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes")


def _answer(registry: Registry, method: str, parts: list[str], asked: dict, body: dict):
    """The answer to a request, or KeyError where there is no such address."""
    match (method, *parts):
        case ("GET", "api", "v1", "langs"):
            return langs(registry)
        case ("GET", "api", "v1", "descendants", lang):
            return descendants(registry, lang)
        case ("GET", "api", "v1", "ancestors", lang):
            return ancestors(registry, lang)
        case ("GET", "api", "v1", "g2p"):
            options = {k: _flag(asked.get(k), False) for k in ("index", "debugger", "tokenize")}
            return g2p(registry, asked["in-lang"], asked["out-lang"], asked["text"], **options)
        case ("GET", "api", "v2", "langs"):
            return langs(registry) if not _flag(asked.get("allnodes"), False) else nodes(registry)
        case ("GET", "api", "v2", "outputs_for", lang):
            return outputs_for(registry, lang)
        case ("GET", "api", "v2", "inputs_for", lang):
            return inputs_for(registry, lang)
        case ("GET", "api", "v2", "path", in_lang, out_lang):
            return path(registry, in_lang, out_lang)
        case ("POST", "api", "v2", "convert"):
            options = {"tokenize": _flag(body.get("tokenize"), True), "indices": _flag(body.get("indices"), False), "compose_from": body.get("compose_from")}
            return convert(registry, body["in_lang"], body["out_lang"], body["text"], **options)
    raise LookupError("/".join(parts))


def app(environ: dict, start_response, registry: Registry | None = None):
    """The service as a WSGI application over the session's registry."""
    import json
    from urllib.parse import parse_qsl, unquote

    from . import api

    known = registry or api.registry()
    parts = [unquote(p) for p in environ.get("PATH_INFO", "").split("/") if p]
    try:
        asked = dict(parse_qsl(environ.get("QUERY_STRING", ""), keep_blank_values=True))
        status, said = "200 OK", _answer(known, environ["REQUEST_METHOD"], parts, asked, _body(environ))
    except InvalidLanguageCode as e:
        status, said = "404 Not Found", {"detail": str(e)}
    except NoPath as e:
        status, said = "400 Bad Request", {"detail": str(e)}
    except (KeyError, ValueError) as e:
        status, said = "422 Unprocessable Content", {"detail": f"missing or malformed: {e}"}
    except LookupError as e:
        status, said = "404 Not Found", {"detail": f"there is nothing at {e}"}
    data = json.dumps(said, ensure_ascii=False).encode()
    start_response(status, [("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(data)))])
    return [data]


def serve(host: str = "127.0.0.1", port: int = 8000) -> None:
    from wsgiref.simple_server import make_server

    with make_server(host, port, app) as server:
        server.serve_forever()
