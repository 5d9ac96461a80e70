import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from oracle import DATA, connect, same

from verdatrace.llm import queries

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, str(DATA)), connect(), queries.ORACLES[name])


def test_all_registered():
    import __spark_entry__ as e

    assert set(queries.QUERIES) | {"pipeline"} <= set(e.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_licenses_are_inherited_as_in_sql(spark, tmp_path):
    """Documents named like license files; a text that only looks like one speaks for itself alone."""
    import duckdb

    rows = [("LICENSE", "Released under the MIT License.", "en", "a"), ("x.py", "code", "en", "a"), ("y.py", None, "en", "a"), ("readme.txt", "Licensed under the Apache License, Version 2.0", "de", "a"), ("z.py", "code", "de", "a"), ("COPYING.txt", "All rights reserved.\n\nGNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", None, "b"), ("w.py", "# SPDX-License-Identifier: ISC\ncode", None, "b"), ("v.py", "code", None, "b"), (None, "code", None, None), ("LICENSE", "no such thing", "fr", "a"), ("u.py", "code", "fr", "a")]
    spark.createDataFrame(rows, "doc_id string, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.QUERIES["op5_license_scan"](spark, str(tmp_path))
    same(df, db, queries.ORACLES["op5_license_scan"])
    got = {(r["path"], r["license"]) for r in df.where("inherited_license IS NOT NULL").collect()}
    assert {("a/en/x.py", "MIT"), ("a/en/y.py", "MIT"), ("b/v.py", None)} - got <= {("b/v.py", None)} and ("a/de/z.py", "Apache-2.0") not in got
