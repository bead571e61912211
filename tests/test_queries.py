"""Every query of the engine against its SQL, over a small table that holds the odd cases."""

import pytest

duckdb = pytest.importorskip("duckdb")
pd = pytest.importorskip("pandas")

from lexiweave import queries as Q

TEXTS = ["The cat's sheet: then Thither!", "été naïve Ünder ñandú, que les", "", "x" * 50 + " tion ung", "a\tb\nc (d). ə ½ 日本 ©", "and of the dead", "SHE sits; ashes, easy est", "qu ou on an er on"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    make = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    make([(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    make([(i, t) for i, t in enumerate(TEXTS) if t], "item_id long, text string", "benchmark")
    make([(i % 3, i, "user", t) for i, t in enumerate(TEXTS) if t], "conv_id long, turn long, role string, text string", "conversations")
    make([(i, "u", t) for i, t in enumerate(TEXTS)], "page_id long, url string, html string", "pages")
    db = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "pages"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, db


def rows(frame):
    cols = sorted(frame.columns)
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    return cols, sorted((tuple(str(plain(v)) for v in r) for r in frame[cols].itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, data, name):
    folder, db = data
    assert rows(Q.QUERIES[name](spark, folder).toPandas()) == rows(db.execute(Q.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_others_run(spark, data, name):
    assert Q.QUERIES[name](spark, data[0]).collect()


def test_arpabet_conversion_is_the_object_s(spark, data):
    import hashlib

    from lexiweave import make_g2p

    got = {r.doc_id: r.converted_sha256 for r in Q.QUERIES["convert_und_arpabet"](spark, data[0]).collect()}
    assert got == {i: hashlib.sha256(make_g2p("und", "eng-arpabet")(t).output_string.encode()).hexdigest() for i, t in enumerate(TEXTS)}
