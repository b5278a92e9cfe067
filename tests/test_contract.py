import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_core_queries_give_rows(spark):
    from skald.plans.registry import QUERIES, SQL

    assert set(SQL) <= set(QUERIES)
    may_be_empty = {"extract_entities_documents"}
    for name, f in QUERIES.items():
        df = f(spark, DATA)
        assert df.count() > 0 or name in may_be_empty, name


def test_core_does_not_need_the_llm_subpackage():
    code = "import sys; sys.modules['skald.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p9_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
    for folder, _, files in os.walk(os.path.join(ROOT, "skald")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "llm" not in source.read(), f
