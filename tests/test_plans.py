"""Plans are the ones wanted: pruned scans, rank limits before shuffles, top-k, and no Python in any registered query."""

import json
import os

import pytest

from capweave.plans.query import captures
from capweave.queries import ORACLE, QUERIES
from capweave.sources import packed
from capweave.sources.text import read_text

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("packed")
    lines = [f"com,example,h{i % 7})/{i} 202401{1 + i % 28:02d}000000 " + json.dumps({"url": f"https://h{i % 7}.example.com/{i}", "status": "200", "mime": "text/html"}) for i in range(200)]
    (folder / "a.cdxj").write_text("\n".join(lines))
    packed.write_packed(read_text(spark, [str(folder / "a.cdxj")]), str(folder / "p.parquet"), check=False)
    return spark.read.parquet(str(folder / "p.parquet"))


def test_keys_and_columns_reach_the_scan(store):
    p = plan(captures(store, "*.example.com", use_key_ranges=True, filters=["=status:200"], fields=["url"]))
    assert "PushedFilters: [" in p and "LessThan(urlkey,com,example*)" in p  # the second range is cut from the text
    schema = p.split("ReadSchema:")[1].split("\n")[0]
    assert "url:string" in schema and "digest" not in schema and "filename" not in schema and "extras" not in schema


def test_collapse_cuts_ranks_before_the_shuffle(store):
    p = plan(captures(store, collapse="urlkey"))
    assert p.index("WindowGroupLimit") < p.rindex("WindowGroupLimit") and "Partial" in p


def test_limits_are_top_k(store):
    for options in ({"sort": "timestamp"}, {"sort": "reverse_timestamp"}, {"closest": "202401"}, {}):
        assert "TakeOrderedAndProject" in plan(captures(store, limit=5, **options)), options


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_no_python_and_no_unbounded_product_in_queries(spark):
    for name, q in QUERIES.items():
        p = plan(q(spark, DATA))
        assert not any(x in p for x in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "CartesianProduct")), name


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
