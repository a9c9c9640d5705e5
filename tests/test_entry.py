import importlib
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_names():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_stands_alone():
    code = "import sys; sys.modules['claimloom.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40; assert 'p2_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)})
    for p in (ROOT / "claimloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text(encoding="utf-8")), p


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_same_results_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from claimloom.plans import core

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    show = lambda v: "nan" if v != v else repr(v)
    for name in ("bm25_topk", "planned_queries", "near_dup_components", "temporal_eligibility", "registrable_domains", "item_violations"):
        df = core.QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        ours = sorted(tuple(map(show, r)) for r in df.select(*columns).collect())
        r = con.execute(core.SQL[name])
        names = [d[0] for d in r.description]
        theirs = sorted(tuple(show(row[names.index(c)]) for c in columns) for row in r.fetchall())
        assert sorted(names) == columns and ours == theirs, name
