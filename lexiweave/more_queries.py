"""Further queries: conversions whose mappings come from files, whole-text conversions, tokenizers, checks and the registry."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import functions as F

from . import api
from .functions import text as T
from .operators import checks, columns, graphs, inventories
from .operators.lexicon import convert_by_join, lexicon_frame
from .operators.tokenizers import token_rows
from .operators.transducers import CompositeTransducer, Transducer
from .plans.mapping import Mapping
from .queries import ARPABET, IS_WORD_SQL, TOKEN_SQL, _values, docs, query, scratch, sha, word_freq
from .sources import files
from .sources.registry import Registry

SAMPLES = Path(__file__).parent / "samples"
_made: list[Registry] = []


def samples() -> Registry:
    if not _made:
        _made.append(Registry.from_folder(SAMPLES, with_builtin=True))
    return _made[0]


def _converted(spark, sf_dir, made, normal: str = "none"):
    said = columns.normalized(columns.convert(made, F.col("text")), normal)
    return docs(spark, sf_dir).select("doc_id", sha(said).alias("converted_sha256"))


VEL_SQL = "replace(replace(replace(replace(replace(text, 'th', 'θ'), 'sh', 'ʃ'), 'qu', 'kw'), 't', 'd'), '''', 'ʔ')"
PLAIN_SQL = f"replace(replace(replace({VEL_SQL}, 'θ', 'z'), 'ʃ', 'x'), 'ʔ', '')"


@query(f"SELECT doc_id, sha256({VEL_SQL}) AS converted_sha256 FROM documents")
def file_rules_csv(spark, sf_dir):
    """A mapping of a YAML configuration whose rules are a csv file with a header, the longest first."""
    return _converted(spark, sf_dir, samples().make_g2p("vel", "vel-ipa", tokenize=False))


@query("SELECT doc_id, sha256(replace(replace(replace(text, 'θ', 'z'), 'ʃ', 'x'), 'ʔ', '')) AS converted_sha256 FROM documents")
def file_rules_json(spark, sf_dir):
    """One mapping of a configuration by its place; rules are JSON."""
    return _converted(spark, sf_dir, Transducer(files.load_mapping(SAMPLES / "velari/config-g2p.yaml", 1)))


@query(f"SELECT doc_id, sha256({PLAIN_SQL.replace('text', "replace(replace(text, '~', 't'), 'ph', 'f')")}) AS converted_sha256 FROM documents")
def path_of_files(spark, sf_dir):
    """Three steps along the shortest path of a network of files (psv, csv, json)."""
    return _converted(spark, sf_dir, samples().make_g2p("vel-old", "vel-plain", tokenize=False))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[aeiou]', 'V', 'g'), '[ptk]', 'T', 'g')) AS converted_sha256 FROM documents")
def file_abbreviations(spark, sf_dir):
    """Rules of a tsv file over classes of a csv file of abbreviations."""
    return _converted(spark, sf_dir, samples().make_g2p("vel-classes", "vel-short", tokenize=False))


@query("SELECT doc_id, sha256(replace(replace(replace(text, 'é', 'E'), 'ü', 'U'), 'sch', 'ʃ')) AS converted_sha256 FROM documents")
def unicode_escapes(spark, sf_dir):
    """Rules that write their characters as escapes."""
    return _converted(spark, sf_dir, samples().make_g2p("vel-escapes", "vel-marked-ipa", tokenize=False))


@query("SELECT doc_id, sha256(replace(replace(nfc_normalize(text), 'é', 'E'), 'ü', 'U')) AS converted_sha256 FROM documents")
def normalised_rules(spark, sf_dir):
    """Rules written with combining marks, in a mapping that normalises to composed characters."""
    return _converted(spark, sf_dir, samples().make_g2p("vel-composed", "vel-marks", tokenize=False))


@query(f"""WITH w AS (SELECT lower(t) AS word, count(*) AS n FROM ({TOKEN_SQL}) WHERE {IS_WORD_SQL} GROUP BY 1),
l(word, said) AS (VALUES ('the', 'ð-ə-'), ('and', 'ə-n-d-'), ('der', ''), ('que', 'k-ə-'))
SELECT w.word AS word, n, coalesce(said, '') AS output FROM w LEFT JOIN l ON w.word = l.word""")
def file_lexicon(spark, sf_dir):
    """A file of aligned words, read and parsed in Spark and joined with each distinct word."""
    return convert_by_join(word_freq(spark, sf_dir), "word", lexicon_frame(spark, f"file://{SAMPLES}/velari/words.txt", "-"), delimiter="-")


@query(f"SELECT doc_id, sha256({PLAIN_SQL}) AS converted_sha256 FROM documents")
def compiled_registry(spark, sf_dir):
    """The registry written as Parquet and read back, without the files it came from; a conversion over it."""
    path = scratch(spark, "registry")
    samples().write(spark, path)
    return _converted(spark, sf_dir, Registry.read(spark, path).make_g2p("vel", "vel-plain", tokenize=False))


MAPPINGS = [
    ("und-ascii", "und-ipa", "mapping"), ("und", "und-ascii", "unidecode"), ("und-ipa", "eng-ipa", "mapping"), ("eng-ipa", "eng-arpabet", "mapping"),
    ("vel", "vel-ipa", "mapping"), ("vel-ipa", "vel-plain", "mapping"), ("vel-old", "vel", "mapping"), ("vel-classes", "vel-short", "mapping"),
    ("vel-escapes", "vel-marked-ipa", "mapping"), ("vel-composed", "vel-marks", "mapping"), ("vel-words", "vel-ipa", "lexicon"),
]


@query(f"SELECT CAST(k AS INTEGER) AS ord, a AS in_lang, b AS out_lang, t AS type FROM (VALUES {_values([(k, *m) for k, m in enumerate(MAPPINGS)])}) v(k, a, b, t)")
def list_mappings(spark, sf_dir):
    """All mappings of the registry in their order."""
    return samples().mapping_rows(spark).select("ord", "in_lang", "out_lang", "type")


EDGES_SQL = _values([(k, a, b) for k, (a, b, _) in enumerate(MAPPINGS)])


@query(f"""WITH RECURSIVE edges(ord, src, dst) AS (VALUES {EDGES_SQL}), walk AS (SELECT src, dst, 1 AS hops, [src, dst] AS trail, [ord] AS ords FROM edges
UNION ALL SELECT w.src, e.dst, w.hops + 1, list_append(w.trail, e.dst), list_append(w.ords, e.ord) FROM walk w JOIN edges e ON w.dst = e.src WHERE NOT list_contains(w.trail, e.dst))
SELECT src, dst, CAST(hops AS INTEGER) AS hops, array_to_string(trail, '>') AS path FROM walk QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY hops, ords) = 1""")
def network_paths(spark, sf_dir):
    """Shortest paths between all languages of the registry."""
    return graphs.shortest_paths(samples().edge_rows(spark)).withColumn("path", F.array_join("path", ">"))


GOLDENS = [
    ("vel", "vel-ipa", "the ship", "θe ʃip"), ("vel", "vel-ipa", "quit that", "kwid θad"), ("vel", "vel-plain", "quit that's shut", "kwid zads xud"),
    ("vel-old", "vel-ipa", "phe ~hat", "fe θad"), ("vel-classes", "vel-short", "potato", "TVTVTV"), ("vel-escapes", "vel-marked-ipa", "é, ü, schön", "E, U, ʃön"),
    ("und", "eng-arpabet", "Ködja mi", "K OW JH AA  M IY "), ("und", "und-ascii", "Жаба かき", "Zhaba kaki"),
]


@query(f"SELECT a AS in_lang, b AS out_lang, i AS input, e AS expected, e AS said FROM (VALUES {_values(GOLDENS)}) v(a, b, i, e)")
def goldens(spark, sf_dir):
    """A file of examples, each converted between the languages it names, by the SQL function."""
    from .functions.sql import register

    register(spark, str(SAMPLES))
    rows = files.golden_rows(spark, f"file://{SAMPLES}/goldens.psv")
    return rows.select("in_lang", "out_lang", "input", "expected", F.expr("g2p_convert(input, in_lang, out_lang)").alias("said"))


@query(r"""SELECT doc_id, pos, t AS text, regexp_matches(t, '^[\p{L}\p{Co}\p{N}\p{M}''~]') AS is_word FROM (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS pos
FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{Co}\p{N}\p{M}''~]+|[^\p{L}\p{Co}\p{N}\p{M}''~]+') AS w FROM documents))""")
def tok_multi_hop(spark, sf_dir):
    """Words by the inventories of two steps on the way to IPA."""
    tok = samples().make_tokenizer("vel-old", None, ["vel-old", "vel", "vel-ipa"])
    return token_rows(docs(spark, sf_dir), ["doc_id"], "text", tok).withColumn("pos", F.col("pos").cast("long"))


@query(r"""SELECT doc_id, pos, t AS text, regexp_matches(t, '^[\p{L}\p{Co}\p{N}\p{M}]') AS is_word FROM (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS pos
FROM (SELECT doc_id, regexp_extract_all(text, '[Ii][Tt]''[Ss]\b|[\p{L}\p{Co}\p{N}\p{M}]+|[^\p{L}\p{Co}\p{N}\p{M}]+') AS w FROM documents))""")
def tok_lexicon(spark, sf_dir):
    """A lexicon makes a word of what it lists, whatever stands in it."""
    tok = samples().make_tokenizer("vel-words", "vel-ipa")
    return token_rows(columns.spread(docs(spark, sf_dir)), ["doc_id"], "text", tok).withColumn("pos", F.col("pos").cast("long"))


SINK = Mapping([{"in": "a", "out": "b,c"}, {"in": "d", "out": "e", "context_before": "f"}], in_lang="x", out_lang="y")
SINK_ROWS = [("csv", 'a,"b,c",,\nd,e,f,\n'), ("tsv", "a\tb,c\t\t\nd\te\tf\t\n"), ("psv", "a|b,c||\nd|e|f|\n"), ("json", '[\n    {"in": "a", "out": "b,c"},\n    {"in": "d", "out": "e", "context_before": "f"}\n]\n')]


@query(f"SELECT kind, text FROM (VALUES {_values(SINK_ROWS)}) v(kind, text)")
def sink_rules(spark, sf_dir):
    """A mapping as text of each kind of file."""
    return spark.createDataFrame([(k, files.mapping_to_text(SINK, k)) for k, _ in SINK_ROWS], "kind string, text string")


@query("SELECT * FROM (VALUES ('vel-escapes', 'vel-marked-ipa', 'E'), ('vel-escapes', 'vel-marked-ipa', 'U')) v(in_lang, out_lang, output)")
def doctor(spark, sf_dir):
    """Outputs of mappings to IPA that are no IPA."""
    return spark.createDataFrame(checks.unknown_outputs(samples().mappings), "in_lang string, out_lang string, output string")


@query(f"""WITH l AS (SELECT DISTINCT unnest([a, b]) AS lang FROM (VALUES {EDGES_SQL}) v(k, a, b))
SELECT lang, lang LIKE '%-ipa' AS is_ipa, lang LIKE '%-x-sampa' AS is_xsampa, lang LIKE '%dummy' AS is_dummy FROM l""")
def kinds_of_languages(spark, sf_dir):
    """What the name of each language of the network says it is."""
    rows = [(n, bool(T.is_ipa(n)), bool(T.is_xsampa(n)), bool(T.is_dummy(n))) for n in samples().network.nodes]
    return spark.createDataFrame(rows, "lang string, is_ipa boolean, is_xsampa boolean, is_dummy boolean")


@query(f"SELECT m AS method, a.s AS a, b.s AS b, CAST(levenshtein(a.s, b.s) AS DOUBLE) AS d FROM (VALUES ('levenshtein_distance'), ('fast_levenshtein_distance')) t(m), (VALUES {_values([(s,) for s in ARPABET])}) a(s), (VALUES {_values([(s,) for s in ARPABET])}) b(s)")
def distances(spark, sf_dir):
    """Two of the six distances over all pairs of an inventory; the others are held against their definitions in tests."""
    rows = [(m, a, b, float(inventories.distance(m)(a, b))) for m in ("levenshtein_distance", "fast_levenshtein_distance") for a in ARPABET for b in ARPABET]
    return spark.createDataFrame(rows, "method string, a string, b string, d double")


@query(f"""WITH w AS (SELECT DISTINCT lower(t) AS word FROM ({TOKEN_SQL}) WHERE {IS_WORD_SQL}) SELECT word, regexp_full_match(strip_accents(word), '[a-zæœøðħŋβθχʔəɛɔ]+') AS ok FROM w""")
def ipa_check(spark, sf_dir):
    """Whether each distinct word is made of letters of the IPA, with marks."""
    words = word_freq(spark, sf_dir).select("word")
    return words.select("word", checks.ipa_ok(F.col("word")).alias("ok"))


@query(f"SELECT DISTINCT lower(t) AS word, TRUE AS ok FROM ({TOKEN_SQL}) WHERE {IS_WORD_SQL}")
def check_conversions(spark, sf_dir):
    """Whether what is said for each distinct word is what ARPABET and the IPA before it promise."""
    words = columns.spread(word_freq(spark, sf_dir).select("word"))
    return words.select("word", checks.outcome_ok(api.make_g2p("und", "eng-arpabet", tokenize=False), F.col("word"), ARPABET).alias("ok"))


LETTERS = "a AA, b B, c CH, d D, e EY, f F, g G, h HH, i IY, j ZH, k K, l L, m M, n N, o OW, p P, q K, r D, s S, t T, u UW, v V, w W, x K, y Y, z Z, ə AH"
_SAID = "regexp_replace(replace(replace(replace(replace(lower(strip_accents(t)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), '[^a-zə]', '', 'g')"
_SAID = f"replace({_SAID}, 'dj', 'JH ')"
for _pair in LETTERS.split(", "):
    _SAID = f"replace({_SAID}, '{_pair[0]}', '{_pair[2:]} ')"


@query(f"""WITH w AS (SELECT DISTINCT t, CASE WHEN {IS_WORD_SQL} THEN {_SAID} ELSE t END AS said FROM ({TOKEN_SQL}))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(s.said, '')) END AS converted_sha256 FROM documents d
LEFT JOIN (SELECT doc_id, string_agg(w.said, '' ORDER BY pos) AS said FROM ({TOKEN_SQL}) k JOIN w ON k.t = w.t GROUP BY doc_id) s ON d.doc_id = s.doc_id""")
def convert_und_arpabet(spark, sf_dir):
    """Three steps, transliteration first, of the words of whole texts: each from the cache of its worker, no shuffle of words."""
    made = api.make_g2p("und", "eng-arpabet")
    return columns.spread(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", sha(columns.convert(made, F.col("text"))).alias("converted_sha256"))


@query("""WITH x AS (SELECT doc_id, unnest(c) AS ch, unnest(range(len(c))) AS i FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE text <> '')),
s AS (SELECT doc_id, i, k, sum(k) OVER (PARTITION BY doc_id ORDER BY i) - k AS spot FROM (SELECT *, CASE WHEN ch IN ('n', 'o') THEN 2 ELSE 1 END AS k FROM x)),
e AS (SELECT doc_id, i, CAST(spot + j AS BIGINT) AS o FROM s, LATERAL (SELECT unnest(range(k)) AS j)),
t AS (SELECT doc_id, count(*) AS n_edges, string_agg(i || ':' || o, ',' ORDER BY i, o) AS edges FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_edges, 0) AS n_edges, sha256(coalesce(edges, '')) AS edges_sha256, sha256(replace(replace(text, 'n', 'nn'), 'o', 'uu')) AS output_sha256 FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""")
def align_documents(spark, sf_dir):
    """Alignments of whole documents over two steps, composed from the first input to the last output."""
    chain = CompositeTransducer([Transducer(Mapping([{"in": "n", "out": "nn"}], norm_form="none")), Transducer(Mapping([{"in": "o", "out": "uu"}], norm_form="none"))])
    a = columns.aligned(columns.spread(docs(spark, sf_dir).select("doc_id", "text")), "text", chain, ["output", "edges"])
    pairs = F.array_join(F.transform("edges", lambda e: F.concat_ws(":", e["i"], e["o"])), ",")
    return a.select("doc_id", F.size("edges").cast("long").alias("n_edges"), sha(pairs).alias("edges_sha256"), sha("output").alias("output_sha256"))
