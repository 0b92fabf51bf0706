import os
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, [os.environ.get("PYTHONPATH")])])  # for the workers


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "3").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables():
    """A folder of the driver's smallest tables, or none."""
    d = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    return str(d) if d.exists() else pytest.skip("no test tables")


@pytest.fixture(scope="session")
def odd_tables(tables, tmp_path_factory):
    """The same tables: empty ones, and ones with every column null in a row, empty and long texts, repeated rows and columns of clashing names."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    clashing = "id k nos count x spelling kind factor by v r pos term part score rank n key head bucket cluster sig sections row old new h a b".split()
    out = {}
    for kind in ("empty", "odd"):
        out[kind] = d = tmp_path_factory.mktemp(kind)
        for f in Path(tables).glob("*.parquet"):
            t = pq.read_table(f)
            if kind == "empty":
                pq.write_table(t.slice(0, 0), d / f.name)
                continue
            base = t.slice(0, 6).to_pylist()
            rows = [base[0] | {c: None} for c in t.column_names] + [dict.fromkeys(t.column_names)] + base + base[:1]
            rows += [base[1] | {c: v} for c in t.column_names if pa.types.is_string(t.schema.field(c).type) for v in ("", "  ", "x" * 30_000, "​")]
            t = pa.Table.from_pylist(rows, schema=t.schema)
            for c in clashing:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array(["q"] * t.num_rows))
            pq.write_table(t, d / f.name)
    return {k: str(v) for k, v in out.items()}
