import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 12


def test_rest_stands_alone(tmp_path):
    """Without the language-model package and the pipeline the entry point still imports."""
    code = "import sys; sys.modules['textgate.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


@pytest.mark.parametrize("name", ["gate_line_families", "certainty_group_counts", "quantifier_sets", "summary_by_class", "run_summary", "fnv_keys", "session_idle_gap", "line_of_offset", "nearest_match", "html_mask_lengths", "stems"])
def test_sql_agrees(spark, name):
    from textgate.plans import catalogue

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = catalogue.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    cursor = con.execute(f"select {', '.join(columns)} from ({catalogue.oracle_sql()[name]})")
    key = lambda row: tuple(str(round(v, 6) if isinstance(v, float) else v) for v in row)
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, cursor.fetchall()))
