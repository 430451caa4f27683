"""One local session for all tests, and a comparison of Spark results with DuckDB's."""

from __future__ import annotations

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairloom.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.01"  # the smallest size with more than one chromosome


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[8]", 8, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(x):
    """A cell as both engines should have it: numbers to nine digits, no NaN, no minus zero."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if hasattr(x, "__float__"):
        x = float(x)
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
