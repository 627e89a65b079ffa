import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import ensure_checkpoint_dir, local_session

    s = local_session("tests", cores=4, memory="4g")
    s.sparkContext.setLogLevel("OFF")
    ensure_checkpoint_dir(s)
    return s
