import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loomtext.session import get_session

    session = get_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def same_rows(frame, relation) -> None:
    """Both have the same columns and, whatever their order, the same rows."""

    def plain(rows, names):
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(tuple(repr(round(v, 6) + 0.0 if isinstance(v, float) else v) for v in (row[i] for i in order)) for row in rows)

    assert sorted(frame.columns) == sorted(relation.columns)
    assert plain(frame.collect(), frame.columns) == plain(relation.fetchall(), relation.columns)
