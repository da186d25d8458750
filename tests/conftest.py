from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from harrow.session import local_session

    return local_session(4, 4)


@pytest.fixture(scope="session")
def sf() -> str:
    return "/root/testdata/sf0.001"
