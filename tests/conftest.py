import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logsieve.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "logsieve-tests", master="local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="6g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def odd_texts():
    """Random texts of every kind of line break, accent, digit run and long line."""
    import random

    rng = random.Random(7)
    words = ["error", "Warning", "CRITICAL", "info", "naïve", "déjà-vu", "über", "a@b.io", "555 123 4567", "x" * 900, "İ", "–", ""]
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", " ", " ", "  "]
    texts = ["", "\n", "\r\n\r\n", "one line", "x" * 5000, "a\n" * 3000, "end\n", " "]
    for _ in range(150):
        texts.append("".join(rng.choice(words) + rng.choice(breaks) for _ in range(rng.randint(0, 120))))
    return texts
