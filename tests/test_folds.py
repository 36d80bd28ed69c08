"""Folds of tiles of unequal size."""

import duckdb
import pandas as pd

from gridloom import catalog
from gridloom.operators import metrics as me
from gridloom.plans import metric_queries as mq


def test_folds_of_unequal_tiles(spark):
    """Six tiles of two candidates and nineteen of one: folds as in the query's SQL."""
    rows = [(i, i % 25) for i in range(31)]
    own = mq.q_group_kfold(spark.createDataFrame(rows, "label long, tile_1km int")).toPandas()
    base = catalog.oracle_sql()["group_kfold"].partition("SELECT tile_1km AS tile")
    con = duckdb.connect()
    con.register("cand", pd.DataFrame(rows, columns=["label", "tile_1km"]))
    other = con.sql(base[1] + base[2]).df()
    assert sorted(map(tuple, own[["tile", "fold", "n"]].values.tolist())) == sorted(map(tuple, other[["tile", "fold", "n"]].values.tolist()))
    assert own["fold"].nunique() == 5


def test_greedy_folds(spark):
    """The operator fills the emptiest fold: 5 | 3 + 1 | 3 + 1."""
    rows = [(g,) for g, n in (("a", 5), ("b", 3), ("c", 3), ("d", 1), ("e", 1)) for _ in range(n)]
    assert dict(map(tuple, me.group_folds(spark.createDataFrame(rows, "g string"), "g", 3).collect())) == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 2}
