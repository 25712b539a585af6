import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def tables(con, sf=SF):
    for f in Path(sf).iterdir():
        con.sql(f"CREATE OR REPLACE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canon(frame):
    cols = sorted(frame.columns)

    def text(v):
        if pd.isna(v):
            return "None"
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return cols, sorted(tuple(map(text, r)) for r in frame[cols].astype(object).itertuples(index=False, name=None))
