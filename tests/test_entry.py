"""The driver's contract: names, oracle texts, and the flagship query."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names_agree():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 60


def test_imports_without_training_data_operators():
    code = "import sys; sys.modules['evalloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 27 and {r["effect"] for r in rows} == {"vulnerable_lift", "fixed_false_positive_increase", "net_useful_lift"}
