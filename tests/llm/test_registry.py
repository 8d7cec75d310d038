from __future__ import annotations

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck
from tests.llm.conftest import LARGER


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize(
    "name",
    [
        "op5_substring_dedup",
        "op8_jaccard_join",
        "op11_merkle_manifest",
        "op12_conversation_repair",
        "op13_tree_dedup",
    ],
)
def test_queries_match_their_sql(spark, name):
    sql = entry.oracle_sql()[name]
    assert differences(entry.queries()[name](spark, LARGER), duck(LARGER), sql) is None


def test_entry_works_without_the_subpackage():
    code = (
        "import sys\n"
        "sys.modules['silvermart.llm'] = sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert 'op1_order_minhash' not in e.queries() and 'bi_top10_loss' in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)


def test_broken_subpackages_are_not_hidden():
    code = (
        "import sys\n"
        "sys.modules['tokenizers'] = None\n"
        "import silvermart.llm.word_bpe\n"
        "sys.modules['numpy'] = None\n"
        "for m in [m for m in sys.modules if m.startswith('silvermart.llm')]: del sys.modules[m]\n"
        "import __spark_entry__ as e\n"
        "try:\n    e.queries()\n"
        "except ImportError:\n    sys.exit(0)\n"
        "sys.exit(1)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
