import glob
import hashlib
import math
import os
import sys
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from llm_cases import ROWS, awkward, empty  # noqa: E402

import corpus_pipeline  # noqa: E402
from flowlake.llm import digest, lm, quality, queries, toxicity  # noqa: E402


def test_sliding_entropy_matches_counts():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 105, 400), rng.integers(0, 256, 300), np.full(90, 65)]).astype(np.uint8)
    got = digest.entropy_levels(data)
    for i, level in enumerate(got):
        n = np.bincount(data[i : i + 64])
        n = n[n > 0] / 64
        assert abs(level - (-(n * np.log2(n)).sum()) / 6 * (digest.LEVELS - 1)) <= 1.01
    assert len(got) == len(data) - 63


def test_digest_of_neighbours(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    rank = digest.ranks(digest.level_counts(docs))
    got = {r["id"]: r for r in digest.neighbours(docs).collect()}
    assert len(got) == len(rows)
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        changed = digest.edited(text, after)
        own, new, following = digest.digests([t.encode() for t in (text, changed, after)], rank)
        r = got[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == digest.likeness(own, new) and r["near_next"] == digest.likeness(own, following)
    near = [r["near_edited"] for r in got.values() if r["n_chars"] > 600]
    assert np.mean(near) > 0.35 > 10 * np.mean([r["near_next"] for r in got.values() if r["n_chars"] > 600])


def test_digest_awkward_rows(spark):
    docs = awkward(spark)
    found = digest.fingerprints(docs).collect()
    by = {r["id"]: r["fingerprint"] for r in found}
    assert by[1] == by[2] and by[4] == by[5] == "" and by[9] and len(found) == len(ROWS)
    assert digest.neighbours(docs).count() == len(ROWS)
    ends = digest.neighbours(docs).where("id = 4").first()
    assert ends["n_chars"] == 0 and ends["near_edited"] == 1.0
    assert digest.neighbours(empty(spark)).count() == 0
    one = docs.limit(1).select(digest.alike(F.lit("AAAA"), F.lit("AAAA")).alias("a")).first()
    assert one["a"] == 1.0


def test_filter_never_underestimates(spark):
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    counts = rng.zipf(1.6, 5000).clip(1, 10**6)
    grams = spark.createDataFrame([(int(h), int(c)) for h, c in zip(hashes, counts)], "gram bigint, n bigint")
    levels = lm.level_of(counts)
    built, lowest = lm.build_filter(grams, sorted(Counter(levels.tolist()).items()), 1 << 22)
    got = built.levels(hashes)
    assert lowest == 1 and (got >= levels).all() and (got == levels).mean() > 0.95
    assert (built.levels(rng.integers(0, 2**63, 5000, dtype=np.uint64)) == 0).mean() > 0.95
    many = [(q, n * 20) for q, n in sorted(Counter(levels.tolist()).items())]
    tight, cut = lm.build_filter(grams, many, 1 << 17)
    assert tight.bits.nbytes <= 1 << 17 and cut > 1


def test_language_model_scores(spark, small):
    got = queries.op5_lm_scores(spark, small).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    tokens = {k: [*t.encode().lower().split(), None] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    c = Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    for r in got:
        own = tokens[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(own) and r["train_tokens"] == n
        assert r["n_known"] == sum(c[w] > 0 for w in own)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-6
        assert r["score"] <= 0
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def _plain_scores(docs, held_out):
    """The smoothed model with exact counts in plain dictionaries; pairs and contexts stand as their level's middle."""
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, t in docs.items()}
    train = [t for k, t in tokens.items() if not held_out(k)]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([True, *t], t))
    scale, level = sum(c.values()) + 0.5 * (len(c) + 1), lambda n: int(lm.level_of(np.array([n]))[0]) if n else 0
    stands = lm._STANDS

    def looked(before, word):
        at = level(len(train) if before is True else c[before])
        n = pairs[before, word]
        pair = stands[level(n)] if n >= lm.LEAST else 0.0
        weight = max(min(pair, stands[at]) - lm.DISCOUNT, 0.0) if pair >= lm.LEAST else 0.0
        return at, weight, pair

    seen, kept = Counter(), Counter()
    for t in train:
        for before, word in zip([True, *t], t):
            at, weight, pair = looked(before, word)
            seen[at] += 1
            kept[at] += weight / max(min(pair, max(stands[at], 1)), 1)
    out = {}
    for k, t in tokens.items():
        total = 0.0
        for before, word in zip([True, *t], t):
            at, weight, _ = looked(before, word)
            share = kept[at] / seen[at] if seen[at] else 0.0
            total += math.log10(min(weight / max(stands[at], 1) + (1 - share) * (c[word] + 0.5) / scale, 1.0))
        out[k] = total
    return out


def test_scores_match_exact_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = _plain_scores({r["doc_id"]: r["text"] for r in docs.collect()}, lambda k: zlib.crc32(str(k).encode()) % 5 == 1)
    train = docs.where(queries.remainder(F.col("doc_id"), 5) != 1).select("text")
    for table in (lm.FREQUENT, 500):
        model, counts = lm.train_model(train, frequent=table)
        assert model.lowest == 1 and model.pairs == model.pairs_held
        got = {r["id"]: r["score"] for r in lm.score(docs, model, counts).collect()}
        # the filter can only err towards pairs that were not seen often
        assert got.keys() == want.keys()
        apart = sorted(abs(got[k] - want[k]) / abs(want[k]) for k in want)
        # a false pair shows in texts of a few words only
        assert apart[len(apart) // 2] < 1e-3 and apart[len(apart) * 98 // 100] < 0.01 and apart[-1] < 0.1
        assert abs(sum(got.values()) - sum(want.values())) < 1e-3 * abs(sum(want.values()))


def test_a_filter_too_small_for_its_pairs_stays_at_or_above_the_words(spark, small):
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    train = docs.where(queries.remainder(F.col("doc_id"), 5) != 1).select("text")
    model, counts = lm.train_model(train, filter_bytes=1 << 17, frequent=2000)
    assert model.lowest > 1 and model.pairs_held < model.pairs
    held = [r for r in lm.score(docs, model, counts).collect() if zlib.crc32(str(r["id"]).encode()) % 5 == 1]
    assert sum(r["score"] for r in held) >= sum(r["base_score"] for r in held)


def test_scores_do_not_depend_on_what_is_broadcast(spark, small):
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(awkward(spark).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null"))
    train = docs.where(queries.remainder(F.col("doc_id"), 5) != 1).select("text")
    repeats = {}
    for r in docs.collect():
        own = (r["text"] or "").encode().lower().split()
        repeats[r["doc_id"]] = max([1, *Counter(zip(own, own[1:])).values(), repeats.get(r["doc_id"], 0)])
    seen = []
    for room, table in ((lm.FILTER_BYTES, lm.FREQUENT), (1 << 17, 2000), (0, 0)):
        model, tables = lm.train_model(train, filter_bytes=room, frequent=table)
        assert (model.blocks > 0) == (tables.filter is not None) == (room < lm.FILTER_BYTES) and (room or model.pairs_held == 0)
        rows = lm.score(docs, model, tables).collect()
        seen.append(sorted((r["id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows))
    for other in seen[1:]:
        assert [r[:3] for r in other] == [r[:3] for r in seen[0]]
        assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(other, seen[0]))
        apart = sorted(abs(a[4] - b[4]) / max(abs(b[4]), 1) for a, b in zip(other, seen[0]))
        # a false level, one in 200 pairs, moves each token of its pair by a quarter at most
        far = [a for a, b in zip(other, seen[0]) if abs(a[4] - b[4]) > 0.25 * repeats[a[0]] + 0.01 * abs(b[4])]
        assert apart[len(apart) * 98 // 100] < 0.01 and not far


def test_parts_of_the_filter_are_probed_as_the_whole(spark):
    rng = np.random.default_rng(5)
    grams = spark.range(600_000).selectExpr("xxhash64(id) as gram", "1 + id % 3 as n")
    blocks = lm._blocks_for(600_000 * 3)
    bits = np.zeros((blocks, lm._BLOCK_WORDS), np.uint64)
    for r in lm._filled(grams, F.lit(True), blocks).toLocalIterator():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint64)
    assert blocks > 4 and (bits != 0).any(axis=1).all()
    whole = lm.LogFrequencyFilter(bits.ravel())
    asked = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    asked[:10_000] = np.array([r["gram"] for r in grams.limit(10_000).collect()], np.int64).view(np.uint64)
    block = lm.LogFrequencyFilter.block_of(asked, blocks)
    place, level = rng.integers(-1, 1 << 20, 20_000), rng.integers(-1, 60, 20_000)
    for part in np.unique(block // 2):
        some, mine = lm.LogFrequencyFilter(bits[part * 2 : part * 2 + 2].ravel()), block // 2 == part
        sent = lm._unpacked(lm._packed(block[mine] % 2, asked[mine], place[mine], level[mine]).ravel())
        assert (sent[2] == place[mine]).all() and (sent[3] == level[mine]).all()
        assert (some.levels(sent[1], sent[0]) == whole.levels(asked[mine])).all()
    assert (whole.levels(asked[:10_000]) > 0).all()


def test_language_model_awkward_rows(spark):
    docs = awkward(spark)
    model, counts = lm.train_model(docs.select("text"))
    got = lm.score(docs, model, counts).collect()
    assert len(got) == len(ROWS) and all(np.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["id"] in (4, 5, 6)} == {1}
    nothing, none = lm.train_model(empty(spark).select("text"))
    assert nothing.tokens == 0
    assert all(np.isfinite(r["base_score"]) for r in lm.score(docs, nothing, none).collect())
    assert lm.score(empty(spark), model, counts).count() == 0


LABELS = "doc_id bigint, quality int, toxic int, label int"


def labelled(spark, folder, query):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    return [(labels[r["doc_id"]], r) for r in query(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]


def test_quality_held_out(spark):
    rows = labelled(spark, "/root/testdata/sf0.01", queries.op7_quality)
    assert sum(a["quality"] == b["predicted"] for a, b in rows) / len(rows) > 0.95


def test_toxicity_held_out(spark):
    rows = labelled(spark, "/root/testdata/sf0.01", queries.op8_toxicity)
    assert sum(a["toxic"] == b["predicted"] for a, b in rows) / len(rows) > 0.93
    clean = [b["predicted"] for a, b in rows if not a["toxic"]]
    assert sum(clean) / len(clean) < 0.02


def test_toxicity_learns_from_all_sure_features_and_a_large_sample(spark):
    assert (toxicity.FEATURES, toxicity.SAMPLE, toxicity._STEPS) == (1 << 14, 30_000, 250)
    counts = spark.range(20_000).select(F.col("id").alias("gram"), F.lit(90).alias("toxic"), F.lit(10).alias("clean"))
    hashes, ratios = toxicity.choose(counts, 100, 100)
    assert len(hashes) == len(ratios) == 1 << 14


def test_stretch_sums_match_bincount(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 40, 300) * (rng.random(300) < 0.7)
    places = rng.integers(0, 50, sizes.sum()).astype(np.uint32)
    values = rng.normal(size=50)
    want = np.bincount(np.repeat(np.arange(300), sizes), values[places], minlength=300)
    for stretch in (1, 37, 1 << 20):
        monkeypatch.setattr(toxicity, "_STRETCH", stretch)
        assert np.allclose(toxicity._stretch_sums(values, places, sizes), want)
    assert not toxicity._stretch_sums(values, places[:0], np.zeros(3, np.int64)).any()


def test_risk_step_falls(spark):
    rng = np.random.default_rng(2)

    def made(n, shift):
        x = np.zeros((n, quality.WIDTH), np.float32)
        x[:, 0] = rng.normal(shift, 1, n)
        x[:, -1] = 1
        return [(r.tobytes(),) for r in x]

    positives = spark.createDataFrame(made(300, 2), "x binary")
    everything = spark.createDataFrame(made(600, 2) + made(200, -2), "x binary")
    scorer = quality.fit(everything, positives, 0.75)
    x = np.zeros((2, quality.WIDTH))
    x[:, 0], x[:, -1] = (2, -2), 1
    high, low = scorer.score(x)
    assert high > 0.9 and low < 0.3


def test_classifiers_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame(
        [(1, 1, 0, 9), (1, 1, 1, 9), (7, 0, 0, 9), (None, 1, 1, 9), (5, None, None, 9), (9, 0, 1, 9)], LABELS
    )
    usable = lambda key: key.isNotNull()
    for module in (quality, toxicity):
        for given in (labels, labels.limit(0)):
            got = module.learn_and_score(docs, given, usable).collect()
            assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        assert module.learn_and_score(empty(spark), labels, usable).count() == 0
    kept = quality.accepted(docs, labels, usable)
    assert kept.columns == docs.columns and kept.count() <= len(ROWS)
    assert quality.accepted(empty(spark), labels, usable).count() == 0


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    columns, seen = docs.columns, docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, small).cache()
        assert seen.columns == columns
        counts.append({r["doc_id"] for r in seen.collect()})
    good = [k for k, q in labels.items() if q == 1]
    assert sum(k in counts[0] for k in good) > 0.9 * len(good)
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]
    pieces = corpus_pipeline.run(spark, small)
    sizes = {r["sequence_id"]: r["n"] for r in pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert max(sizes.values()) <= 4096 and {r["doc_id"] for r in pieces.collect()} == counts[3]


def test_pairs_and_probes_are_shuffled_packed():
    rng = np.random.default_rng(6)
    grams = np.sort(rng.integers(0, 2**64, 100_000, dtype=np.uint64))[:4096]
    n, at = rng.zipf(3, 4096).astype(np.uint32), rng.integers(-1, 60, 4096).astype(np.int8)
    steps = np.diff(grams, prepend=np.uint64(0))
    sent = lm._squeezed(steps, n, at)
    assert len(sent) < 9 * 4096
    got = lm._restored(sent, np.uint64, np.uint32, np.int8)
    assert all((a == b).all() for a, b in zip(got, (steps, n, at))) and (np.cumsum(got[0]) == grams).all()
    probes = lm._packed(rng.integers(0, 16, 4096), grams, rng.integers(-1, 5000, 4096), at)
    assert len(sent := lm._squeezed(probes)) < 8.2 * 4096
    assert (lm._restored(sent, lm._PACKED)[0] == probes).all()
    begin, end = lm._runs(np.repeat([3, 4, 9], [5000, 1, 4096]))
    assert begin.tolist() == [0, 4096, 5000, 5001] and end.tolist() == [4096, 5000, 5001, 9097]
    one = lm._squeezed(np.array([7], np.uint64))
    assert lm._restored(one, np.uint64)[0].tolist() == [7]


def test_pairs_are_added_up_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(lm, "_PART_TOKENS", 50)
    monkeypatch.setattr(lm, "_ROW_ITEMS", 3)
    lines = ["a b a b", "b a rare b", None, "", "a b rare b", "x"] * 3
    train = spark.createDataFrame([(t,) for t in lines], "text string").repartition(5)
    for table in (lm.FREQUENT, 3, 0):
        model, _ = lm.train_model(train, frequent=table)
        got = {r["gram"]: r for r in lm.pair_counts(train, model).collect()}
        want, context = Counter(), {}
        counts = Counter(h for t in lines for h in lm.token_hashes((t or "").encode()).tolist())
        for t in lines:
            tokens = lm.token_hashes((t or "").encode())
            before = lm._contexts(tokens, np.array([len(tokens)]))
            for gram, h in zip(lm.pair_hashes(before, tokens).view(np.int64).tolist(), before.tolist()):
                want[gram] += 1
                context[gram] = h
        assert {g: r["n"] for g, r in got.items()} == {g: n for g, n in want.items() if n >= lm.LEAST}
        frequent = set(model.frequent.tolist())
        for gram, r in got.items():
            h = context[gram]
            if h == int(lm.START) or h in frequent:
                n = len(lines) if h == int(lm.START) else counts[h]
                assert r["at"] == lm.level_of(np.array([n]))[0] and r["context"] is None
            else:
                assert r["at"] is None and r["context"] == int(np.array([h], np.uint64).view(np.int64)[0])


def test_training_and_scoring_leave_no_shuffle_files(spark, small):
    def files():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = files(), spark.conf.get(key, None)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model, tables = lm.train_model(docs.select("text"), filter_bytes=0)
    scored = lm.score(docs, model, tables)
    for _ in range(50):
        if left := files() - before:
            time.sleep(0.2)
    assert tables.filter is not None and not left and spark.conf.get(key, None) == kept
    assert scored.count() == docs.count() == scored.select("id").distinct().count()
