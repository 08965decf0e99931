import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from barscope.session import local_session

    session = local_session("4", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Build a bar table from {code: list of closes}; other prices follow the close."""
    import datetime as dt

    def make(data, start=dt.date(2024, 1, 1), **more):
        rows = []
        for code, closes in data.items():
            for i, c in enumerate(closes):
                row = {"code": code, "d": start + dt.timedelta(days=i), "c": c}
                rows.append(row | {k: v[code][i] for k, v in more.items()})
        types = ", ".join(["code string", "d date", "c double", *[f"{k} double" for k in more]])
        return spark.createDataFrame([tuple(r.values()) for r in rows], types)

    return make
