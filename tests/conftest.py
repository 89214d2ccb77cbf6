import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from prematch.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8)
    yield session
    session.stop()


DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def tables(spark):
    from prematch.plans.bindings import Tables

    if not DATA.exists():
        pytest.skip("driver tables are not present")
    return Tables(spark, str(DATA))


def rows(df, *cols):
    picked = df.select(*cols) if cols else df
    return sorted([tuple(r) for r in picked.collect()], key=str)


pytest.rows = rows
