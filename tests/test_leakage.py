"""Phrases with a frequent opening."""

from pyspark.sql import functions as F

from evalloom.operators import leakage

INDEX = "case_id string, rule_id string, mode string, value string"
PARTS = "case_id string, request_id string, pos int, location_class string, text string"


def test_a_frequent_opening_is_no_key(spark):
    phrases = [("c", "r", "phrase", f"the quick brown fox {i} ran home") for i in range(40)] + [("c", "r", "phrase", "the quick brown"), ("c", "r", "phrase", "alone"), ("c", "r", "phrase", "never seen here")]
    texts = [("c", f"q{i}", 0, "task", f"well, The quick brown fox {i % 50} ran home again and again") for i in range(400)] + [("c", "one", 1, "task", "left ALONE"), ("d", "other", 0, "task", "alone")]
    index, parts = spark.createDataFrame(phrases, INDEX), spark.createDataFrame(texts, PARTS)
    got = {(r["request_id"], r["match"]) for r in leakage.scan_phrases(parts, index).collect()}
    want = {(f"q{i}", f"the quick brown fox {i % 50} ran home") for i in range(400) if i % 50 < 40} | {(f"q{i}", "the quick brown") for i in range(400)} | {("one", "alone")}
    assert got == want
    assert {r["request_id"] for r in leakage.scan_phrases(parts.drop("case_id"), index, None).filter("match = 'alone'").collect()} == {"one", "other"}
    grams = parts.select("request_id", F.explode(leakage._grams(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "))).alias("gram"))
    keys = leakage.phrase_keys(index.select("case_id", "rule_id", "value"), grams, ["gram"])
    sizes = {r["value"]: r["n"] for r in keys.join(grams, "gram").groupBy("value").agg(F.count("*").alias("n")).collect()}
    assert "never seen here" not in sizes and all(n == (400 if v == "the quick brown" else 2 if v == "alone" else 8) for v, n in sizes.items()) and len(sizes) == 42


def test_leaked_phrases_equal_their_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    from evalloom.plans import text_queries

    items = ["Große Straße am Fluß", "the ﬁrst oﬃce  №５", "İstanbul und ΣΊΣΥΦΟΣ", "été dernier", "-- !!", "ſound half ½ x²", "plain words here", "ﷺ x", "it's ﬆ ㌀"]
    docs = [(1, "GROSSE STRASSE AM FLUSS, ja"), (2, "The First Office no5 open"), (3, "i̇stanbul und σίσυφος"), (3, "also PLAIN words here"), (3, "again plain words here"), (None, "Été dernier PLAIN words here"), (None, "sound HALF 1⁄2 x2"), (4, None), (5, ""), (6, "so صلى الله عليه وسلم x"), (7, "It's st アパート")]
    tables = {"benchmark": spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), "documents": spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, source string")}
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("leaked_phrases", "leakage_audit"):
        rows = getattr(text_queries, name)(spark, str(tmp_path))
        assert sorted(map(str, (tuple(r) for r in rows.collect()))) == sorted(map(str, con.execute(text_queries.ORACLE_SQL[name]).fetchall())), name
    assert len(con.execute(text_queries.ORACLE_SQL["leaked_phrases"]).fetchall()) == 9
