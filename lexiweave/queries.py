"""Queries over the engine's own operators, each over whole tables, with SQL of its own to hold them against."""

from __future__ import annotations

import tempfile
import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import alignments, checks, columns, graphs, inventories
from .operators.lexicon import convert_by_join
from .operators.tokenizers import default_tokens, token_rows
from .operators.transducers import CompositeTransducer, Transducer
from .plans.mapping import Mapping, strip_indices
from .sources import builtin
from .sources.files import rule_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for what a query writes, where driver and executors see it; only a local session may do without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = "file://" + tempfile.mkdtemp(prefix="lexiweave-")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def sha(col) -> F.Column:
    return F.sha2(col, 256)


# --- pieces of SQL that several references share, written for DuckDB on their own

WORDS_SQL = r"regexp_extract_all(text, '[\p{L}\p{Co}\p{N}\p{M}]+|[^\p{L}\p{Co}\p{N}\p{M}]+')"
IS_WORD_SQL = r"regexp_matches(t, '^[\p{L}\p{Co}\p{N}\p{M}]')"
TOKEN_SQL = f"SELECT doc_id, lang, source, unnest(w) AS t, unnest(range(len(w))) AS pos FROM (SELECT *, {WORDS_SQL} AS w FROM documents)"
# a to z and the marks that are read, on lower-cased ASCII
LETTER_FROM, LETTER_TO = "gjy@?'," , "ɡʒjəʔʔʔ"
UND_SQL = "replace(replace(translate(lower({x}), 'gjy@?'',', 'ɡʒjəʔʔʔ'), 'c', 't͡ʃ'), ':', '')"


def _values(rows: list[tuple]) -> str:
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


# --- conversions


#: Composed letters whose base is read as something else, apart: what canonical decomposition makes of them.
MARKED = {c + m: composed for c in "cgjy" for m in "\u0301\u0302\u0306\u0307\u030C\u0308\u0300\u0303\u0304\u0327" if len(composed := unicodedata.normalize("NFC", c + m)) == 1}
_APART = "nfc_normalize(lower(text))"
for _two, _one in MARKED.items():
    _APART = f"replace({_APART}, '{_one}', '{_two}')"
UND_IPA_SQL = f"nfc_normalize({UND_SQL.format(x=_APART)})"


@query(f"SELECT doc_id, sha256({UND_IPA_SQL}) AS converted_sha256, CAST(length({UND_IPA_SQL}) AS BIGINT) AS n FROM documents")
def convert_und_ipa(spark, sf_dir):
    """Undetermined text to IPA over whole texts; marks stay on what they stood on. No rule looks over white space, so no word needs a cache."""
    made = api.make_g2p("und-ascii", "und-ipa", tokenize=False)
    texts = columns.spread(docs(spark, sf_dir).select("doc_id", "text"))
    said = columns.normalized(columns.convert(made, F.col("text")), "NFC")
    return texts.select("doc_id", said.alias("c")).select("doc_id", sha("c").alias("converted_sha256"), F.length("c").cast("long").alias("n"))


@query("SELECT doc_id, sha256(regexp_replace(translate(text, 'aeiou', 'eioua'), '[xz]', '', 'g')) AS converted_sha256 FROM documents")
def convert_translate(spark, sf_dir):
    """One character to one at most, without feeding: a single expression."""
    rules = [{"in": a, "out": b} for a, b in zip("aeiou", "eioua")] + [{"in": "x", "out": ""}, {"in": "z", "out": ""}]
    made = Transducer(Mapping(rules, norm_form="none", prevent_feeding=True))
    return docs(spark, sf_dir).select("doc_id", sha(columns.convert(made, F.col("text"))).alias("converted_sha256"))


CHARS_SQL = "SELECT doc_id, unnest(c) AS ch, unnest(range(len(c))) AS pos FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE text <> '')"


@query(
    f"""WITH x AS (SELECT doc_id, pos, ch, lag(ch) OVER w AS before, lead(ch) OVER w AS after FROM ({CHARS_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(y.said, '')) END AS converted_sha256 FROM documents d LEFT JOIN (SELECT doc_id,
    string_agg(CASE WHEN ch = 't' AND after IN ('h', 'i') THEN 'θ' WHEN ch = 's' AND before IN ('a', 'e') THEN 'z' ELSE ch END, '' ORDER BY pos) AS said FROM x GROUP BY doc_id) y ON d.doc_id = y.doc_id"""
)
def convert_context_rules(spark, sf_dir):
    """Contexts before and after, in nested expressions. No rule's output is another's context."""
    made = Transducer(Mapping([{"in": "t", "out": "θ", "context_after": "h|i"}, {"in": "s", "out": "z", "context_before": "[ae]"}], norm_form="none"))
    return docs(spark, sf_dir).select("doc_id", sha(columns.convert(made, F.col("text"))).alias("converted_sha256"))


def _ordering(name, ordering, sql):
    def run(spark, sf_dir):
        made = Transducer(Mapping([{"in": "e", "out": "x"}, {"in": "er", "out": "y"}, {"in": "the", "out": "z"}], rule_ordering=ordering, norm_form="none"))
        return docs(spark, sf_dir).select("doc_id", sha(columns.convert(made, F.col("text"))).alias("converted_sha256"))

    run.__name__ = name
    query(sql)(run)


_ordering("rules_as_written", "as-written", "SELECT doc_id, sha256(replace(replace(replace(text, 'e', 'x'), 'er', 'y'), 'the', 'z')) AS converted_sha256 FROM documents")
_ordering("rules_longest_first", "apply-longest-first", "SELECT doc_id, sha256(replace(replace(replace(text, 'the', 'z'), 'er', 'y'), 'e', 'x')) AS converted_sha256 FROM documents")


@query("SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, 'th', chr(983040)), 'h', chr(983041)), 'e', chr(983042)), chr(983040), 'he'), chr(983041), 'th') .replace(chr(983042), 'a')) AS converted_sha256 FROM documents")
def prevent_feeding(spark, sf_dir):
    """Outputs that later rules would read are hidden from them."""
    made = Transducer(Mapping([{"in": "th", "out": "he"}, {"in": "h", "out": "th"}, {"in": "e", "out": "a"}], prevent_feeding=True, norm_form="none"))
    return docs(spark, sf_dir).select("doc_id", sha(columns.convert(made, F.col("text"))).alias("converted_sha256"))


@query("SELECT doc_id, sha256(replace(replace(text, 'on', 'x'), 'an', 'y')) AS converted_sha256 FROM documents")
def reverse_mapping(spark, sf_dir):
    made = Transducer(Mapping([{"in": "x", "out": "on"}, {"in": "y", "out": "an"}], reverse=True, norm_form="none"))
    return docs(spark, sf_dir).select("doc_id", sha(columns.convert(made, F.col("text"))).alias("converted_sha256"))


@query("SELECT doc_id, sha256(translate(text, 'aAnN', 'οΟµ#')) AS converted_sha256 FROM documents")
def case_preserve(spark, sf_dir):
    """Case does not matter to rules and comes back with the output; µ has an upper case of its own here."""
    made = Transducer(Mapping([{"in": "a", "out": "ο"}, {"in": "n", "out": "µ"}], case_sensitive=False, preserve_case=True, norm_form="none", case_equivalencies={"µ": "#"}))
    texts = columns.spread(docs(spark, sf_dir).select("doc_id", "text"))
    return texts.select("doc_id", sha(columns.convert(made, F.col("text"))).alias("converted_sha256"))


@query("SELECT doc_id, sha256(regexp_replace(replace(text, 'sh', 's'), '(s|t)', '\\1·', 'g')) AS converted_sha256 FROM documents")
def out_delimiter(spark, sf_dir):
    """A delimiter follows each output; sh and s have one output, so that they do not feed each other."""
    made = Transducer(Mapping([{"in": "sh?", "out": "s"}, {"in": "t", "out": "t"}], out_delimiter="·", norm_form="none"))
    return docs(spark, sf_dir).select("doc_id", sha(columns.convert(made, F.col("text"))).alias("converted_sha256"))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(text, 'the', 'þe'), 'in', 'ı'), 'þe', 'ðə'), 'ı', 'ɪn')) AS converted_sha256 FROM documents")
def composite_two_hops(spark, sf_dir):
    """What one mapping writes the next one reads."""
    one = Mapping([{"in": "the", "out": "þe"}, {"in": "in", "out": "ı"}], norm_form="none")
    two = Mapping([{"in": "þe", "out": "ðə"}, {"in": "ı", "out": "ɪn"}], norm_form="none")
    made = CompositeTransducer([Transducer(one), Transducer(two)])
    return docs(spark, sf_dir).select("doc_id", sha(columns.convert(made, F.col("text"))).alias("converted_sha256"))


@query(r"SELECT doc_id, sha256(regexp_replace(replace(text, 'ab', 'q'), '(a|e|i|o|u)', 'V', 'g')) AS converted_sha256 FROM documents")
def abbreviations(spark, sf_dir):
    """VOWEL stands for its letters."""
    made = Transducer(Mapping([{"in": "ab", "out": "q"}, {"in": "VOWEL", "out": "V"}], abbreviations={"VOWEL": list("aeiou")}, norm_form="none"))
    return docs(spark, sf_dir).select("doc_id", sha(columns.convert(made, F.col("text"))).alias("converted_sha256"))


@query("SELECT doc_id, sha256(replace(replace(text, '.', '<stop>'), '(', '<open>')) AS converted_sha256 FROM documents")
def escape_special(spark, sf_dir):
    made = Transducer(Mapping([{"in": ".", "out": "<stop>"}, {"in": "(", "out": "<open>"}], escape_special=True, norm_form="none"))
    return docs(spark, sf_dir).select("doc_id", sha(columns.convert(made, F.col("text"))).alias("converted_sha256"))


@query("SELECT conv_id, turn, role, replace(replace(text, 'qu', 'k'), 'ou', 'u') AS converted FROM conversations")
def turn_convert(spark, sf_dir):
    made = Transducer(Mapping([{"in": "qu", "out": "k"}, {"in": "ou", "out": "u"}], norm_form="none"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", columns.convert(made, F.col("text")).alias("converted"))


@query("SELECT page_id, sha256(replace(replace(html, '&amp;', '&'), 'th', 'þ')) AS converted_sha256 FROM pages")
def page_convert(spark, sf_dir):
    made = Transducer(Mapping([{"in": "&amp;", "out": "&"}, {"in": "th", "out": "þ"}], norm_form="none"))
    return table(spark, sf_dir, "pages").select("page_id", sha(columns.convert(made, F.col("html"))).alias("converted_sha256"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256, nfc_normalize(text) <> text AS changed FROM documents")
def norm_nfc(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text", columns.normalized(F.col("text"), "NFC").alias("n"))
    return d.select("doc_id", sha("n").alias("nfc_sha256"), (F.col("n") != F.col("text")).alias("changed"))


# --- tokens


@query(f"SELECT doc_id, pos AS pos, t AS text, {IS_WORD_SQL} AS is_word FROM ({TOKEN_SQL})")
def tok_default(spark, sf_dir):
    return token_rows(docs(spark, sf_dir), ["doc_id"], "text").withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT lower(t) AS word, count(*) AS n FROM ({TOKEN_SQL}) WHERE {IS_WORD_SQL} GROUP BY 1")
def word_freq(spark, sf_dir):
    words = F.filter(default_tokens(F.col("text")), lambda t: t["is_word"])
    return docs(spark, sf_dir).select(F.explode(words).alias("t")).groupBy(F.lower("t.text").alias("word")).agg(F.count("*").alias("n"))


@query(f"SELECT lang, count(*) AS n_tokens, count(DISTINCT lower(t)) AS n_types FROM ({TOKEN_SQL}) WHERE {IS_WORD_SQL} GROUP BY lang")
def types_by_lang(spark, sf_dir):
    words = F.filter(default_tokens(F.col("text")), lambda t: t["is_word"])
    counts = docs(spark, sf_dir).select("lang", F.explode(words).alias("t")).groupBy("lang", F.lower("t.text").alias("w")).agg(F.count("*").alias("n"))
    return counts.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"))


@query(r"""SELECT doc_id, pos, t AS text, regexp_matches(t, '^([\p{L}\p{Co}\p{N}\p{M}]|'')') AS is_word FROM (
SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{Co}\p{N}\p{M}'']+|[^\p{L}\p{Co}\p{N}\p{M}'']+') AS w FROM documents))""")
def tok_inventory(spark, sf_dir):
    """A mapping that reads the apostrophe makes it part of words."""
    from .operators.tokenizers import InventoryTokenizer

    tok = InventoryTokenizer([Mapping([{"in": "'", "out": "ʔ"}, {"in": "'s", "out": "z"}])])
    return token_rows(docs(spark, sf_dir), ["doc_id"], "text", tok).withColumn("pos", F.col("pos").cast("long"))


@query(r"""WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''),
k AS (SELECT CASE WHEN regexp_matches(ch, '[\p{L}\p{Co}]') THEN 'letter' WHEN regexp_matches(ch, '\p{N}') THEN 'number' WHEN regexp_matches(ch, '\p{M}') THEN 'diacritic' WHEN regexp_matches(ch, '\p{P}') THEN 'punctuation'
 WHEN regexp_matches(ch, '\p{S}') THEN 'symbol' WHEN regexp_matches(ch, '[\p{Z}\t\n\r\x0B\x0C]') THEN 'whitespace' ELSE 'other' END AS category FROM c) SELECT category, count(*) AS n FROM k GROUP BY 1""")
def charset_category(spark, sf_dir):
    """Counts of characters by class: each character is counted, and each distinct one then classed."""
    from pyspark.sql.functions import arrow_udf

    from .functions.text import category

    @arrow_udf("string")
    def kind(chars):
        import pyarrow as pa

        return pa.array([category(c) or "other" for c in chars.to_pylist()], pa.string())

    chars = docs(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return chars.select(kind("ch").alias("category"), "n").groupBy("category").agg(F.sum("n").alias("n"))


@query("WITH c AS (SELECT unnest(string_split(nfd, '')) AS ch FROM (SELECT lower(text) AS nfd FROM documents WHERE text <> '')) SELECT ch AS char, count(*) AS n FROM c WHERE NOT regexp_matches(ch, '^[a-z@?'',: \n.]$') GROUP BY 1")
def scan_unmapped(spark, sf_dir):
    """Characters that no rule of undetermined ASCII reads."""
    chars = {c for x in api.registry().find_mapping("und-ascii", "und-ipa").inventory("in") for c in x.replace("\\", "")}
    return checks.unmapped(docs(spark, sf_dir), "text", chars, case_sensitive=False, normalize=False)


# --- lexicons

LEXICON = [("the", "ðə"), ("and", "ənd"), ("of", "əv"), ("les", "le"), ("und", "ʊnt"), ("que", "ke"), ("dead", "")]


def _lexicon(spark):
    return spark.createDataFrame([(w, [(len(w), s)]) for w, s in LEXICON], "word string, units array<struct<n:int,out:string>>")


@query(f"""WITH w AS (SELECT lower(t) AS word, count(*) AS n FROM ({TOKEN_SQL}) WHERE {IS_WORD_SQL} GROUP BY 1), l(word, said) AS (VALUES {_values(LEXICON)})
SELECT w.word AS word, n, CASE WHEN coalesce(said, '') <> '' THEN said || '_' ELSE '' END AS output FROM w LEFT JOIN l ON w.word = l.word""")
def lexicon_convert(spark, sf_dir):
    """Each distinct word once, by a join."""
    return convert_by_join(word_freq(spark, sf_dir), "word", _lexicon(spark), delimiter="_")


@query(f"""WITH w AS (SELECT lang, lower(t) AS word FROM ({TOKEN_SQL}) WHERE {IS_WORD_SQL}), l(word, said) AS (VALUES {_values(LEXICON)})
SELECT lang, count(*) AS n_words, count(*) FILTER (WHERE word NOT IN (SELECT word FROM l)) AS n_oov FROM w GROUP BY lang""")
def lexicon_oov(spark, sf_dir):
    words = F.filter(default_tokens(F.col("text")), lambda t: t["is_word"])
    rows = docs(spark, sf_dir).select("lang", F.explode(words).alias("t")).groupBy("lang", F.lower("t.text").alias("word")).agg(F.count("*").alias("n"))
    known = _lexicon(spark).select("word", F.lit(True).alias("known"))
    return rows.join(F.broadcast(known), "word", "left").groupBy("lang").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("n_oov"))


# --- alignments


def _aligned(spark, sf_dir, rules, **options):
    made = Transducer(Mapping(rules, norm_form="none", **options))
    turns = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return turns.select("item_id", F.col("text").alias("input"), columns.align(made, F.col("text")).alias("a"))


BENCH_CHARS = "SELECT item_id, unnest(c) AS ch, unnest(range(len(c))) AS i FROM (SELECT item_id, string_split(text, '') AS c FROM benchmark WHERE text <> '')"


@query(f"""WITH x AS (SELECT item_id, i, ch, CASE WHEN ch = 'n' THEN 2 WHEN ch = 'o' THEN 0 ELSE 1 END AS k FROM ({BENCH_CHARS})),
s AS (SELECT item_id, i, k, sum(k) OVER (PARTITION BY item_id ORDER BY i) - k AS spot FROM x),
e AS (SELECT item_id, i, spot + j AS o FROM s, LATERAL (SELECT unnest(range(k)) AS j) UNION ALL SELECT item_id, i, NULL FROM s WHERE k = 0)
SELECT item_id, CAST(i AS INTEGER) AS i, CAST(coalesce(o, last_value(o IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY i, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(o IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY i, o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS INTEGER) AS o FROM e""")
def edges_of_rules(spark, sf_dir):
    """Edges of insertions and deletions, repaired: from the kernel."""
    a = _aligned(spark, sf_dir, [{"in": "n", "out": "nn"}, {"in": "o", "out": ""}])
    return a.select("item_id", F.explode("a.edges").alias("e")).select("item_id", "e.i", "e.o")


def _raw_edges(spark, sf_dir):
    """Edges before repair, as rows: n becomes two characters, o none."""
    c = table(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", F.posexplode(F.split("text", "")).alias("i", "ch")).where("ch <> ''")
    from pyspark.sql import Window

    w = Window.partitionBy("item_id").orderBy("i")
    k = F.when(F.col("ch") == "n", 2).when(F.col("ch") == "o", 0).otherwise(1)
    at = c.withColumn("k", k).withColumn("at", F.sum("k").over(w) - F.col("k"))
    places = F.when(F.col("k") == 0, F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1))
    return at.select("item_id", F.col("i").cast("int").alias("i"), F.posexplode(places).alias("ord", "o")).select("item_id", "i", F.col("o").cast("int").alias("o"), "ord")


@query(SQL["edges_of_rules"])
def edges_repair(spark, sf_dir):
    """The same repair over rows, with windows."""
    return alignments.repair(_raw_edges(spark, sf_dir), ["item_id"]).select("item_id", "i", "o")


@query(f"""WITH x AS (SELECT item_id, i, CASE WHEN ch = 'n' THEN 2 WHEN ch = 'o' THEN 0 ELSE 1 END AS k FROM ({BENCH_CHARS})),
s AS (SELECT item_id, i, k, sum(k) OVER (PARTITION BY item_id ORDER BY i) - k AS spot FROM x),
e AS (SELECT item_id, i, spot + j AS o FROM s, LATERAL (SELECT unnest(range(k)) AS j))
SELECT DISTINCT item_id, CAST(i AS INTEGER) AS i, CAST(o // 2 AS INTEGER) AS o FROM e""")
def compose_edges(spark, sf_dir):
    """Edges over two steps; the second puts characters together in pairs."""
    first = _raw_edges(spark, sf_dir).where("o is not null")
    second = first.select("item_id", F.col("o").alias("i"), (F.col("o") / 2).cast("int").alias("o")).distinct()
    return alignments.compose(first, second, ["item_id"])


PIECES_SQL = f"""WITH x AS (SELECT item_id, i, ch, lead(ch) OVER (PARTITION BY item_id ORDER BY i) AS nx, lag(ch) OVER (PARTITION BY item_id ORDER BY i) AS pv FROM ({BENCH_CHARS})),
f AS (SELECT item_id, i, ch, ch = 'e' AND nx = 'r' AS a, ch = 'r' AND pv = 'e' AS b, nx FROM x)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS pos, CASE WHEN a THEN 'er' ELSE ch END AS in_sub, CASE WHEN a THEN 're' WHEN ch = 's' THEN 'zz' ELSE ch END AS out_sub FROM f WHERE NOT b"""
PIECES_RULES = [{"in": "e{1}r{2}", "out": "r{2}e{1}"}, {"in": "s", "out": "zz"}]


@query(PIECES_SQL)
def substring_alignments(spark, sf_dir):
    """Pieces that do not cross, from the kernel: a metathesis and an insertion."""
    a = _aligned(spark, sf_dir, PIECES_RULES)
    return a.select("item_id", F.posexplode("a.segments").alias("pos", "s")).select("item_id", "pos", "s.in_sub", "s.out_sub")


@query(PIECES_SQL)
def substring_align_rows(spark, sf_dir):
    """The same over rows, from edges and windows."""
    a = _aligned(spark, sf_dir, PIECES_RULES)
    edges = a.select("item_id", F.explode("a.edges").alias("e")).select("item_id", "e.i", "e.o")
    texts = a.select("item_id", "input", F.col("a.output").alias("output"))
    return alignments.segments(edges, texts, ["item_id"])


@query(f"""WITH x AS (SELECT item_id, i, ch, CASE WHEN ch = 'a' THEN 'A!' ELSE ch END AS t FROM ({BENCH_CHARS})), s AS (SELECT item_id, i, ch, t, sum(length(t)) OVER (PARTITION BY item_id ORDER BY i) - length(t) AS spot FROM x)
SELECT item_id, ch AS "from", t[j + 1] AS "to", count(*) AS n FROM s, LATERAL (SELECT unnest(range(length(t))) AS j) GROUP BY ALL""")
def pretty_edges(spark, sf_dir):
    a = _aligned(spark, sf_dir, [{"in": "a", "out": "A!"}])
    edges = a.select("item_id", F.explode("a.edges").alias("e")).select("item_id", "e.i", "e.o")
    texts = a.select("item_id", "input", F.col("a.output").alias("output"))
    return alignments.pretty(edges, texts, ["item_id"]).groupBy("item_id", "from", "to").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT item_id, replace(text, 'on', 'o') AS one FROM benchmark) SELECT item_id, 0 AS tier, one AS output FROM t UNION ALL SELECT item_id, 1, replace(one, 'o', 'uu') FROM t""")
def tiers(spark, sf_dir):
    """Each step of a chain as a row."""
    chain = CompositeTransducer([Transducer(Mapping([{"in": "on", "out": "o"}], norm_form="none")), Transducer(Mapping([{"in": "o", "out": "uu"}], norm_form="none"))])
    a = table(spark, sf_dir, "benchmark").select("item_id", F.explode(columns.align(chain, F.col("text"))["tiers"]).alias("t"))
    return a.select("item_id", "t.tier", "t.output")


@query("SELECT conv_id, string_agg(replace(text, 'e', 'ee'), '' ORDER BY turn) AS output, CAST(sum(length(text)) AS BIGINT) AS n_edges_in FROM conversations GROUP BY conv_id")
def graph_append(spark, sf_dir):
    """Turns of a conversation appended: their outputs joined, edges moved and repaired."""
    made = Transducer(Mapping([{"in": "e", "out": "ee"}], norm_form="none"))
    t = columns.spread(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("input")))
    parts = alignments.appended_lists(columns.aligned(t, "input", made, ["output", "edges"]), ["conv_id"])
    return alignments.joined_lists(parts, ["conv_id"]).select("conv_id", "output", "n_edges_in")


# --- network, registry and rules

EDGES = [(k, a, b) for k, (a, b) in enumerate([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "b"), ("e", "a"), ("f", "f"), ("c", "g"), ("g", "h"), ("b", "h")])]
WALK_SQL = f"""WITH RECURSIVE edges(ord, src, dst) AS (VALUES {_values(EDGES)}), walk AS (SELECT src AS node, dst AS other, 1 AS hops, [src, dst] AS trail, [ord] AS ords FROM edges WHERE src <> dst
UNION ALL SELECT w.node, e.dst, w.hops + 1, list_append(w.trail, e.dst), list_append(w.ords, e.ord) FROM walk w JOIN edges e ON w.other = e.src WHERE NOT list_contains(w.trail, e.dst))"""


def _edges(spark):
    return spark.createDataFrame(EDGES, "ord int, src string, dst string")


@query(WALK_SQL + " SELECT DISTINCT node, other FROM walk")
def graph_descendants(spark, sf_dir):
    return graphs.descendants(_edges(spark))


@query(WALK_SQL + " SELECT DISTINCT other AS node, node AS other FROM walk")
def graph_ancestors(spark, sf_dir):
    return graphs.ancestors(_edges(spark))


@query(WALK_SQL + " SELECT node AS src, other AS dst, CAST(hops AS INTEGER) AS hops, array_to_string(trail, '>') AS path FROM walk QUALIFY row_number() OVER (PARTITION BY node, other ORDER BY hops, ords) = 1")
def graph_shortest_path(spark, sf_dir):
    return graphs.shortest_paths(_edges(spark)).withColumn("path", F.array_join("path", ">"))


@query(WALK_SQL + """, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), d AS (SELECT node, count(DISTINCT other) AS k FROM walk GROUP BY node), u AS (SELECT other AS node, count(DISTINCT node) AS k FROM walk GROUP BY other)
SELECT n.node AS node, coalesce(u.k, 0) AS n_ancestors, coalesce(d.k, 0) AS n_descendants, greatest(2, least(20, coalesce(u.k, 0) + coalesce(d.k, 0))) AS size FROM n LEFT JOIN d ON n.node = d.node LEFT JOIN u ON n.node = u.node""")
def graph_degrees(spark, sf_dir):
    return graphs.degrees(_edges(spark)).withColumn("size", F.col("size").cast("long"))


RULES = [(k, a, b) for k, (a, b) in enumerate([("a", "b"), ("c", "d"), ("a", "b"), ("e{1}", "f{1}"), ("c", "x"), ("c", "d")])]


@query(f"WITH r(ord, i, o) AS (VALUES {_values(RULES)}) SELECT CAST(row_number() OVER (ORDER BY min(ord)) - 1 AS INTEGER) AS place, i AS \"in\", o AS out FROM r GROUP BY i, o")
def dedupe_rules(spark, sf_dir):
    """Rules once each, in the order they first came, as the engine drops repeats."""
    mapping = Mapping([{"in": a, "out": b} for _, a, b in RULES])
    mapping.deduplicate()
    return rule_rows(spark, mapping).select(F.col("ord").alias("place"), "in", "out")


@query(f"WITH r(ord, i, o) AS (VALUES {_values(RULES)}) SELECT ord, regexp_replace(i, '[{{][0-9]+[}}]', '', 'g') AS \"in\", CAST(row_number() OVER (ORDER BY length(regexp_replace(i, '[{{][0-9]+[}}]', '', 'g')) DESC, ord) AS INTEGER) AS place FROM r")
def longest_first_order(spark, sf_dir):
    """The order in which the engine applies rules, the longest input without index notation first."""
    mapping = Mapping([{"in": a, "out": b, "comment": str(k)} for k, a, b in RULES], rule_ordering="apply-longest-first")
    rows = [(int(r.rule.comment), strip_indices(r.rule.rule_input), k) for k, r in enumerate(mapping.compiled, start=1)]
    return spark.createDataFrame(rows, "ord int, `in` string, place int")


@query("SELECT * FROM (VALUES ('und-ascii', 'und-ipa', 'newer'), ('und', 'und-ascii', 'unidecode'), ('und-ipa', 'eng-ipa', 'mapping'), ('eng-ipa', 'eng-arpabet', 'mapping')) t(in_lang, out_lang, found)")
def find_mapping_last_wins(spark, sf_dir):
    """Of several mappings between two languages the last one."""
    known = api.registry().overlay([Mapping([{"in": "a", "out": "b"}], in_lang="und-ascii", out_lang="und-ipa", id="newer")])
    found = [(a, b, known.find_mapping(a, b)) for a, b in known.network.edges]
    return spark.createDataFrame([(a, b, m.id or m.type or "mapping") for a, b, m in found], "in_lang string, out_lang string, found string")


# --- checks and inference

ARPABET = sorted({r["out"] for r in builtin.rules("ipa_to_arpabet")})


@query(f"""WITH t AS (SELECT conv_id, turn, upper(text) AS said FROM conversations), w AS (SELECT conv_id, turn, unnest(string_split_regex(said, '\\s+')) AS u FROM t)
SELECT conv_id, turn, bool_and(u = '' OR u IN ({", ".join(repr(x) for x in ARPABET)})) AS ok FROM w GROUP BY conv_id, turn""")
def arpabet_check(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", checks.arpabet_ok(F.upper("text"), ARPABET).alias("ok"))


SYMBOLS = ["tion", "and", "the", "ment", "ung"]


@query(f"""WITH w AS (SELECT DISTINCT lower(t) AS word FROM ({TOKEN_SQL}) WHERE {IS_WORD_SQL}), s(k, symbol) AS (VALUES {_values(list(enumerate(SYMBOLS)))})
SELECT word, symbol FROM w, s QUALIFY row_number() OVER (PARTITION BY word ORDER BY levenshtein(regexp_replace(word, '[^\\x00-\\x7F]', '#', 'g'), symbol), k) = 1""")
def levenshtein_nearest(spark, sf_dir):
    """For each distinct word the nearest of a few symbols."""
    words = word_freq(spark, sf_dir).select("word")
    return words.select("word", inventories.nearest(F.col("word"), SYMBOLS).alias("symbol"))


@query("SELECT * FROM (VALUES ('und', 'Undetermined')) t(lang, name)")
def arpabet_languages(spark, sf_dir):
    langs, names = api.get_arpabet_langs()
    return spark.createDataFrame([(k, names[k]) for k in langs], "lang string, name string")


# --- streaming


@query("SELECT doc_id, sha256(replace(replace(text, 'er', 'x'), 'on', 'y')) AS converted_sha256 FROM documents")
def stream_convert(spark, sf_dir):
    """Documents as a stream, converted to Parquet without state, each once; then what has been written."""
    from .streaming.lines import convert_stream

    base = scratch(spark, "stream")
    batch = table(spark, sf_dir, "documents")
    folder, name = sf_dir, "documents.parquet"
    source = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*").select("doc_id", "text")
    made = Transducer(Mapping([{"in": "er", "out": "x"}, {"in": "on", "out": "y"}], norm_form="none"))
    convert_stream(source, made, f"{base}/out", f"{base}/checkpoint", column="text", available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id", sha("converted").alias("converted_sha256"))


# --- without an equivalent in SQL; tests hold these against brute force


@query()
def align_und_arpabet(spark, sf_dir):
    """The same with edges, pieces and tiers: how many there are of each for every benchmark item."""
    made = api.make_g2p("und", "eng-arpabet")
    a = table(spark, sf_dir, "benchmark").select("item_id", columns.align(made, F.col("text")).alias("a"))
    return a.select("item_id", "a.output", F.size("a.edges").alias("n_edges"), F.size("a.segments").alias("n_segments"), F.size("a.tiers").alias("n_tiers"))


@query()
def sql_functions(spark, sf_dir):
    """g2p_convert and the table function g2p_tokens, from SQL."""
    from .functions.sql import register

    register(spark)
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("lexiweave_items")
    return spark.sql("SELECT item_id, pos, t.text, is_word, g2p_convert(t.text, 'und', 'und-ipa') AS said FROM lexiweave_items i, LATERAL g2p_tokens(i.text, 'und') t")


@query()
def infer_mapping(spark, sf_dir):
    """Rules from the IPA of undetermined text to that of English, by features."""
    known = api.registry()
    made = inventories.create_mapping(known.find_mapping("und-ascii", "und-ipa"), known.find_mapping("eng-ipa", "eng-arpabet"))
    return rule_rows(spark, made).select("ord", "in", "out")


from . import more_queries  # noqa: E402, F401 (it adds its queries to these)
