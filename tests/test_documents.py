"""Contract documents and file trees."""

import json

import pytest
from pyspark.sql import functions as F

from evalloom.operators import bundles
from evalloom.sources import contracts, documents

PRICES = """
schema_version: "1.0"
version: v1
effective_date: 2026-01-02
currency: USD
source: https://example.org/prices
entries:
  - {provider: a, model: m1, input_rate: 1.5, cached_rate: 0.5, output_rate: 3}
  - {provider: b, model: m0, input_rate: 2, cached_rate: 2, output_rate: 4, note: odd}
"""


def test_yaml_price_tables(spark, tmp_path):
    (tmp_path / "prices.yaml").write_text(PRICES)
    docs = documents.read_documents(spark, "price_table", str(tmp_path / "prices.yaml"))
    assert [tuple(r) for r in documents.check_documents(docs, "price_table").collect()] == [("unknown_field", "prices.yaml", "$.entries[].note")]
    assert contracts.check_contract(docs.select("document.*"), "price_table").count() == 0
    rows = documents.price_rows(docs).orderBy("model").collect()
    assert [(r["provider"], float(r["input_rate"]), str(r["effective_date"])) for r in rows] == [("b", 2.0, "2026-01-02"), ("a", 1.5, "2026-01-02")]
    (tmp_path / "odd.yaml").write_text(PRICES.replace("provider: a", "provider: z").replace("USD", "EUR").replace("https", "http"))
    odd = documents.read_documents(spark, "price_table", str(tmp_path / "odd.yaml"))
    assert {r["rule"] for r in contracts.check_contract(odd.select("document.*"), "price_table").collect()} == {"currency", "source", "order"}


def test_documents_that_are_none(spark, tmp_path):
    for name, text in {"a.json": '["x"]', "b.json": '{"run_id": ', "c.json": '"text"', "d.json": '{"run_id": "r", "evidence": [{"reference": "x", "page": 2}], "more": null}', "e.json": '{"run_id": "r", "confidence": "high"}'}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "f.json").write_bytes(b"\xff{}")
    docs = documents.read_documents(spark, "finding", str(tmp_path / "*.json"))
    found = sorted(tuple(r) for r in documents.check_documents(docs, "finding").collect())
    assert found == [("bad_value", "e.json", "confidence"), *(("not_object", f"{n}.json", "") for n in "abcf"), ("unknown_field", "d.json", "$.evidence[].page"), ("unknown_field", "d.json", "$.more")]
    with pytest.raises(ValueError, match="is read from"):
        documents.read_documents(spark, "finding", str(tmp_path / "findings.txt"))


def test_lines_and_deep_fields(spark, tmp_path):
    good = {"run_id": "r", "usage": {"input_tokens": 3}, "retry_history": [{"attempt": 1, "classification": "x"}]}
    bad = good | {"usage": {"input_tokens": 3, "cache": 1}, "retry_history": [{"attempt": 1}, {"try": 2}]}
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, (good, bad))) + "\n\n")
    docs = documents.read_documents(spark, "run_record", str(tmp_path / "r.jsonl"))
    assert docs.count() == 2
    assert sorted(r["detail"] for r in documents.check_documents(docs, "run_record").collect()) == ["$.retry_history[].try", "$.usage.cache"]


def test_trees(spark, tmp_path):
    root = tmp_path / "a (1) tree"
    (root / "src").mkdir(parents=True)
    for name, content in {"src/a.py": b"x\r\ny\rz", "src/b.bin": b"a\0b", "c.txt": b"\xff\xfe", "link": b"target"}.items():
        (root / name).write_bytes(content)
    modes = spark.createDataFrame([("link", "120000"), ("src/a.py", "100755"), ("c.txt", "160000")], "path string, mode string")
    files = documents.read_tree(spark, str(root), modes)
    assert {r["path"]: (r["size"], r["mode"]) for r in files.collect()} == {"src/a.py": (6, "100755"), "src/b.bin": (3, "100644"), "c.txt": (2, "160000"), "link": (6, "120000")}
    assert {tuple(r) for r in documents.check_tree(files, "reject").collect()} == {("binary", "src/b.bin"), ("not_utf8", "c.txt"), ("unsupported", "c.txt"), ("symlink", "link")}
    assert documents.check_tree(files, "omit", "follow").count() == 1
    assert {r["path"]: r["content"] for r in bundles.decode_content(files.filter(F.col("mode") != "120000")).collect()} == {"src/a.py": "x\ny\nz"}
