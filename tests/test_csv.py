"""CSV input keeps every character."""

import pandas as pd
import pytest
from pyspark.sql import types as T

from hazardline.sources.tables import read_csv_table


def test_quotes_breaks_and_blanks(spark, tmp_path):
    rows = [("a", '46,XY "clone A", del(5q)', 1.5), ("b", "line one\nline two", None), ("c", "  kept  ", 2.0), ("d", "none", 3.0)]
    pd.DataFrame(rows, columns=["ID", "NOTE", "X"]).to_csv(tmp_path / "t.csv", index=False)
    schema = T.StructType([T.StructField("ID", T.StringType()), T.StructField("NOTE", T.StringType()), T.StructField("X", T.DoubleType())])
    got = read_csv_table(spark, str(tmp_path / "t.csv"), schema, multi_line=True)
    assert sorted(map(tuple, got.collect())) == rows


def test_wrong_field_count_stops(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ID,X\na,1\nb,2,3\n")
    with pytest.raises(Exception):
        read_csv_table(spark, str(tmp_path / "t.csv"), T.StructType([T.StructField("ID", T.StringType()), T.StructField("X", T.DoubleType())])).collect()
