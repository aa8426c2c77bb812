"""Every registered query against its SQL, and that the entry points hold together."""

import subprocess
import sys

import pytest
from conftest import DATA, ROOT, assert_same

from weftline.plans import catalogue, catalogue_io, catalogue_text  # noqa: F401

FREE = sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    assert_same(catalogue.QUERIES[name](spark, DATA), duck, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", FREE)
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('weftline.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
assert 'vocab_first_seen' in e.queries() and not any(k.startswith('op') for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
