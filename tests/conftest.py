import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from arborform.session import get_session
    s = get_session("local[4]", shuffle_partitions=4, driver_memory="4g")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arborform-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def stub_vocab(spark):
    """Specials 0-4 plus a few words."""
    from arborform.operators.vocab import SPECIALS
    words = [("x", 5), ("=", 6), ("1", 7), ("a", 8), ("+", 9), ("b", 10)]
    return spark.createDataFrame(SPECIALS + words, "token string, id int")
