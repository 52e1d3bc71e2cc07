import os
import random
import sys

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))
from llm_cases import awkward, empty  # noqa: E402

import corpus_pipeline  # noqa: E402
from flowlake.llm import ego, simhash  # noqa: E402
from flowlake.llm.components import components  # noqa: E402
from flowlake.sources.durable import durable  # noqa: E402


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words)] if 0 < len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {got[i] for i in range(100, 160)} == {100}
    assert got[300] == 299
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 5])
def test_links_find_every_close_pair_once(spark, bits):
    rng = random.Random(bits)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(4):
            near = v
            for b in rng.sample(range(64), rng.randint(1, 6)):
                near ^= 1 << b
            values.add(near)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), bits).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_links_broadcast_no_side_of_their_join(spark):
    rng = random.Random(9)
    values = [rng.getrandbits(63) for _ in range(300)]
    nodes = durable(spark.createDataFrame([(v,) for v in [*values, *(v ^ 5 for v in values)]], "fp bigint"), "nodes")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    found = simhash.links(nodes)
    assert {tuple(r) for r in found.collect()} == {(min(v, v ^ 5), max(v, v ^ 5)) for v in values}
    # the plan as it ended, after adaptive changes, and as it began
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_clusters_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3]
    roots = plain_components(len(rows), edges)
    got = {r["id"]: r for r in simhash.clusters(docs).collect()}
    for i, (key, _) in enumerate(rows):
        assert got[key]["fp"] & (2**64 - 1) == fps[i]
        assert got[key]["component"] == rows[roots[i]][0]


def test_simhash_awkward_rows(spark):
    found = simhash.clusters(awkward(spark)).collect()
    assert len(found) == 13
    by = {r["id"]: r for r in found}
    assert by[1]["component"] == by[2]["component"] == by[3]["component"] == 1
    assert {by[k]["fp"] for k in (4, 5, 6)} == {0} and {by[k]["component"] for k in (4, 5, 6)} == {4}
    assert by[None]["component"] is None
    kept = simhash.deduplicated(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 7, 9, 10, 11]
    assert simhash.clusters(empty(spark)).count() == 0
    assert simhash.deduplicated(empty(spark)).count() == 0


def test_pipeline_stage_keeps_one_document_of_each_group(spark, small):
    random.seed(7)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    for i in range(60):
        words = [f"w{random.randrange(5000)}" for _ in range(400)]
        for changed in range(3):
            text = list(words)
            text[17:18] = ["changed"] * changed
            rows.append(rows[0] | {"doc_id": 10**9 + 3 * i + changed, "text": " ".join(text)})
    fps = [plain_fingerprint(r["text"]) for r in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3]
    least = {}
    for r, root in zip(rows, plain_components(len(rows), edges)):
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    given = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema)
    kept = corpus_pipeline.distinct(spark, given, small)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_pipeline_stage_joins_exploded_variants_without_a_broadcast(spark, small, monkeypatch):
    written = {}

    def watched(df, name="stage", **options):
        out = durable(df, name, **options)
        written[name] = df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr("flowlake.llm.components.durable", watched)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    corpus_pipeline.distinct(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    assert "Generate explode" in written["edges"] and "SortMergeJoin" in written["edges"]
    assert "Broadcast" not in written["edges"]


VECTORS = "vec_id bigint, embedding array<float>, label int, node bigint, weight string"


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(scale=0.11, size=(900, 16))).astype(np.float32)
    x[50:90] = x[50]
    labels = rng.integers(0, 3, 900)
    labels[:300] = 1
    rows = [(i, x[i].tolist(), int(labels[i]), 0, "") for i in range(900)]
    got = {r["id"]: r for r in ego.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    wide = x.astype(np.float64)
    norm = np.sqrt((wide * wide).sum(axis=1))
    near = (wide @ wide.T / np.outer(norm, norm) >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    roots = plain_components(900, zip(*np.nonzero(near)))
    assert near.sum() > 2000
    for i in range(900):
        assert got[i]["links"] == near[i].sum()
        assert got[i]["component"] == roots[i]


def test_embedding_awkward_rows(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    rows = [(i, v, 1, 0, "") for i, v in enumerate(bad)]
    rows += [(20, [1.0, 1.0], 1, 0, ""), (21, [2.0, 2.0], 1, 0, ""), (22, [1.0, 1.0], None, 0, ""), (23, [1.0, 1.0, 0.0], 1, 0, "")]
    rows += [(24, [1.0, 1.0], 2, 0, ""), (None, [1.0, 1.0], 1, 0, ""), (20, [1.0, 1.0], 1, 0, "")]
    got = ego.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(rows)
    links = {r["id"]: (r["links"], r["component"]) for r in got}
    assert all(links[i] == (0, i) for i in [*range(6), 22, 23, 24])
    assert links[20] == (2, 20) and links[21] == (2, 20)
    assert links[None] == (0, None)
    assert ego.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    assert ego.near_duplicates(spark.createDataFrame(rows[:2], VECTORS)).count() == 2
