import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from voxelcohort.session import local_session

    session = local_session(8, 2, "tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def volumes_of(spark):
    """Headers of test volumes: ids to shape, spacing (0.5, 0.5, 3.0) unless given."""

    def make(shapes, spacing=(0.5, 0.5, 3.0)):
        return spark.createDataFrame(
            [(v, list(s), [float(x) for x in spacing]) for v, s in shapes.items()], "volume_id long, shape array<int>, spacing array<double>"
        )

    return make


@pytest.fixture
def masks_of(spark):
    """Sparse masks from ids to coordinate lists."""

    def make(masks):
        rows = [(v, int(i), int(j), int(k)) for v, pts in masks.items() for i, j, k in pts]
        return spark.createDataFrame(rows, "volume_id long, i int, j int, k int")

    return make
