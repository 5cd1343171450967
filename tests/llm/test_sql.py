"""The registered queries against their SQL, and without the folder of these operators."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from breachlens.llm.catalog import ORACLES, QUERIES

from .. import parity

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def duck():
    return parity.duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    found, problem = parity.compare_frame(duck, entry.queries()[name](spark, FOLDER), ORACLES.get(name))
    assert problem is None
    assert found > 0


@pytest.mark.parametrize("name", ["op1_preference_format", "op2_exact_dedup", "op4_mix_sources"])
def test_native_plans_hold_no_python(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("gone", ["('corpus_pipeline', 'breachlens.llm')", "('regex',)", "('public_tokenizers',)", "('breachlens.llm.catalog',)"])
def test_the_rest_works_without_this_part(gone):
    """The folder deleted, one that is empty, or a library that only this part needs."""
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {gone}:
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 70 and not any(n.startswith("op1_") or n == "pipeline" for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
