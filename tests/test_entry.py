"""The driver contract without the optional subpackage."""

import subprocess
import sys

import pytest

from shroud.plans.oracles import ORACLES
from shroud.plans.queries import QUERIES

ROOT = __file__.rsplit("/", 2)[0]


@pytest.mark.parametrize("missing", ["shroud.llm", "ahocorasick", "tiktoken", "public_tokenizers", "corpus_pipeline", ""])
def test_queries_without_a_module(missing):
    """Each of these may be missing; the other queries stay."""
    code = f"import sys; sys.modules.update({{m: None for m in [{missing!r}] if m}}); import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"
    found, sql = map(eval, subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.splitlines())
    own = {q for q in found if not (q.startswith("op") or q == "pipeline")}
    assert own == set(QUERIES) and set(ORACLES) <= set(QUERIES) and set(ORACLES) <= set(sql) <= set(found)
    if missing:
        assert found == sorted(QUERIES)


def test_all_but_one_query_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"type_counts"}
