from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowkit.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def small_bands(monkeypatch):
    """Force every refinement step of the ranking on tiny data."""
    from flowkit.operators import ranking

    monkeypatch.setattr(ranking, "BAND_ROWS", 2)
    monkeypatch.setattr(ranking, "SKETCH_FROM", 3)
