import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from drillspectra.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def cells(spark):
    """Set pixels of a plane as rows; extra columns are constants or planes."""

    def build(mask, **extra):
        at = np.argwhere(mask)
        names, columns = [], []
        for name, value in extra.items():
            names.append(name)
            columns.append([value[tuple(p)].item() for p in at] if isinstance(value, np.ndarray) else [value] * len(at))
        rows = [("A", int(l), int(s), *values) for (l, s), *values in zip(at.tolist(), *columns)]
        kinds = []
        for name, column in zip(names, columns):
            kind = {int: "int", float: "double", str: "string", bool: "boolean"}[type(column[0]) if column else float]
            kinds.append(f"{name} {kind}")
        return spark.createDataFrame(rows, ", ".join(["scene_id string", "line int", "sample int", *kinds]))

    return build


@pytest.fixture(scope="session")
def frame(spark):
    def build(shape):
        return spark.createDataFrame([("A", *shape)], "scene_id string, lines int, samples int")

    return build


@pytest.fixture(scope="session")
def plane():
    """Rows back to a boolean plane."""

    def build(df, shape):
        out = np.zeros(shape, dtype=bool)
        for row in df.select("line", "sample").collect():
            out[row["line"], row["sample"]] = True
        return out

    return build
