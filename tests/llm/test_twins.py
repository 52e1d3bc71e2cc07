"""Text queries that SQL can express give the rows of their SQL twins."""

import math

import duckdb
import pytest

pytest.importorskip("flowlake.llm")

import check_queries  # noqa: E402
from flowlake.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, small, name):
    verdict, _ = check_queries.compare(spark, small, name, queries.QUERIES[name], queries.ORACLES[name])
    assert verdict.startswith("match"), verdict


def test_near_duplicates_twin_on_planted_vectors(spark, tmp_path):
    """Chains, copies, other labels and unusable vectors; the given small tables hold no links."""
    turn = [[math.cos(a), math.sin(a), 0.0] for a in (0.0, 0.3, 0.6, 0.9)]  # only neighbours are within cosine 0.93
    nan, inf = float("nan"), float("inf")
    rows = [(10 - i, v, 1) for i, v in enumerate(turn)] + [(20, turn[0], 1), (21, turn[0], 1), (3, turn[1], 2), (30, turn[1], 2)]
    rows += [(40, turn[0], None), (41, None, 1), (42, [0.0, 0.0, 0.0], 1), (43, [1.0, None, 0.0], 1), (44, [nan, 1.0, 0.0], 1), (45, [inf, 1.0, 0.0], 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"select vec_id, n_links, component_id, kept from ({queries.ORACLES['op6_embedding_dups']})").fetchall()
    got = queries.op6_embedding_dups(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    by_id = {r[0]: r[1:] for r in want}
    assert by_id[10] == (3, 7, False) and by_id[8] == (2, 7, False) and by_id[7] == (1, 7, True)
    assert by_id[30] == (1, 3, False) and all(by_id[i] == (0, i, True) for i in range(40, 46))


def test_archive_twin_on_repeats(spark, tmp_path):
    rows = [(3, "u", "a"), (1, "v", "a"), (2, None, "é"), (4, "w", None), (5, "w", "")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = con.execute(f"select {names} from ({queries.ORACLES['op11_warc']})").fetchall()
    got = queries.op11_warc(spark, str(tmp_path)).select(*names.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    found = {r[0]: (r[1], *r[3:]) for r in want}
    assert found == {1: (1, "response", None), 3: (1, "revisit", 1), 2: (2, "response", None), 4: (0, "response", None), 5: (0, "revisit", 4)}
