"""Queries of the subpackage that SQL can express, against it."""

import os

import pytest

from stratalog.llm import registry

from ..oracle import DATA, agree

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    agree(spark, registry.QUERIES[name], registry.SQL[name])


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(registry.__file__)))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "llm" not in source.read()
