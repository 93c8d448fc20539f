"""The driver contract, with and without the corpus operators."""

import subprocess
import sys

import __spark_entry__ as entry


def test_queries_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_corpus_operators():
    code = "import sys, listingloom.queries, listingloom.sources.readers, listingloom.streaming.quality; sys.exit(any(m.startswith('listingloom.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rpartition("/")[0]).returncode == 0
