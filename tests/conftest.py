from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lapel.session import local_session  # noqa: E402
from lapel.sources import generate  # noqa: E402
from lapel.sources.star import MappedStar, write_star  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.maxMetadataStringLength", "1000")
    yield session
    session.stop()


#: Modules whose rows are all hand-made and few: not worth compiling code for.
HAND_MADE = ("test_edges", "test_rules", "test_policy", "test_scoring", "test_usage", "test_generate", "test_ranking", "test_snapshots")


@pytest.fixture(autouse=True)
def quick(request, spark):
    """Everything else runs with compiled code, as on a cluster."""
    compiled = not request.module.__name__.endswith(HAND_MADE)
    spark.conf.set("spark.sql.codegen.wholeStage", str(compiled).lower())


@pytest.fixture(scope="session")
def sample(spark):
    """The generated sample star, written once and read back."""
    folder = tempfile.mkdtemp(prefix="lapel-sample-")
    return write_star(MappedStar(spark, generate.sample_star(spark)), folder)


def rows(df):
    """Rows as a list of plain tuples."""
    return [tuple(r) for r in df.collect()]


def comparable(values):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row)) for row in values)
