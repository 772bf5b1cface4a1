"""No module of the package defines a top-level name twice, as the second one would silently replace the first."""

import ast
from collections import Counter
from pathlib import Path

import pytest

import sparkweft

MODULES = sorted(Path(sparkweft.__file__).parent.rglob("*.py"))


@pytest.mark.parametrize("path", MODULES, ids=lambda p: p.stem)
def test_names_are_defined_once(path):
    tree = ast.parse(path.read_text())
    names = Counter(n.name for n in tree.body if isinstance(n, ast.FunctionDef | ast.ClassDef))
    assert [n for n, k in names.items() if k > 1] == []
