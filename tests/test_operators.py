import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataforge.functions import sketches
from strataforge.operators import aggregate, audience, bandit, candidates, changes, ranking, views
from strataforge.queries import queries
from strataforge.streaming import live

QUERIES = queries()


def test_the_privacy_gate_gives_all_or_nothing(spark):
    df = spark.createDataFrame([("c1", 5.0), ("c1", None), ("c2", 12.0)], "c string, v double")
    with pytest.raises(aggregate.GroupTooSmall):
        aggregate.checked(df, ["c"], ["v"], 2)
    with pytest.raises(Exception, match="fewer"):
        aggregate.aggregate(df, ["c"], ["v"], 2).collect()
    assert {r.c: r.sum_v for r in aggregate.aggregate(df, ["c"], ["v"]).collect()} == {"c1": 5.0, "c2": 12.0}


def replay(hits, limit=None, window=None, ttl=None):
    out, state = {}, {}
    for user, event, now in sorted(hits, key=lambda h: (h[0], h[2], h[1])):
        times, last = state.setdefault(user, ([], [None]))
        ok = True
        if limit is not None:
            if sum(t > now - window for t in times) >= limit:
                ok = False
            else:
                times.append(now)
        if ok and ttl is not None:
            if last[0] is not None and now < last[0] + ttl:
                ok = False
            else:
                last[0] = now
        out[event] = ok
    return out


@pytest.mark.parametrize("rules", [dict(ttl=60), dict(limit=3, window=100), dict(limit=2, window=50, ttl=20)])
def test_audience_decisions_equal_a_replay(spark, rules):
    rnd = random.Random(5)
    hits = [(rnd.randrange(4), i, rnd.randrange(1000)) for i in range(400)]
    df = spark.createDataFrame(hits, "user int, event long, sec long")
    got = {r.event: r.allowed for r in audience.decide(df, ["user"], ["event"], "sec", audience.Rules(**rules)).collect()}
    assert got == replay(hits, **rules)


def test_a_busy_key_is_cut_where_no_state_is_left(spark):
    rnd = random.Random(6)
    hits = [(None if i % 3 else 1, i, 1000 * rnd.randrange(40) + rnd.randrange(90)) for i in range(600)]
    df = spark.createDataFrame(hits, "piece int, cell long, sec long")
    rules = dict(limit=2, window=50, ttl=20)
    dealt = audience._dealt(df, ["piece"], "sec", audience.Rules(**rules))
    assert dealt.columns == df.columns and dealt.count() == len(hits)
    # without adaptive execution, which puts partitions as small as these together
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = dealt.where("piece is null").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert tasks > 1
    got = {r.cell: r.allowed for r in audience.decide(df, ["piece"], ["cell"], "sec", audience.Rules(**rules)).collect()}
    assert got == replay([(-1 if user is None else user, event, at) for user, event, at in hits], **rules)


def test_bandits_converge(spark):
    rnd = random.Random(7)
    rates = {"a": .1, "b": .55, "c": .3}
    arms = bandit.init(spark, list(rates))
    rows = [(a, float(rnd.random() < p)) for a, p in rates.items() for _ in range(400)]
    arms = bandit.reward_beta(arms, spark.createDataFrame(rows, "arm string, reward double")).persist()
    picks = bandit.sample(arms, spark.range(2000), "id", seed=1).groupBy("arm").count().collect()
    assert {r.arm: r["count"] for r in picks}.get("b", 0) >= 1800
    assert bandit.exploit(arms).first().arm == "b"
    again = bandit.sample(arms, spark.range(2000), "id", seed=1)
    assert again.join(bandit.sample(arms, spark.range(2000), "id", seed=1).withColumnRenamed("arm", "other"), "id").where("arm <> other").count() == 0
    fresh = bandit.init(spark, ["x", "y"])
    assert bandit.ucb1(fresh).first().arm == "x"


def test_mmr_is_greedy_and_bounded():
    import numpy as np

    v = np.array([[1, 0], [1, 0], [0, 1]], float)
    assert ranking.mmr_order(v, 1.0, 3) == [0, 1, 2]
    assert ranking.mmr_order(v, .5, 2) == [0, 2]
    assert ranking.mmr_order(v, .5, 9) == [0, 2, 1]
    assert ranking.mmr_order(np.zeros((0, 2)), .5, 3) == []


def test_recommend_is_its_parts(spark):
    rows = [("a", "us", [1.0, 0.0, 0.0]), ("b", "us", [.8, .2, 0.0]), ("c", "us", [0.0, 1.0, 0.0]), ("d", "eu", [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, region string, emb array<double>")
    slate, stages = ranking.recommend(df, "emb", [1.0, 0.0, 0.0], 2, "id", "region = 'us'", diversified=False)
    assert [r.id for r in slate.orderBy("slot").collect()] == ["a", "b"]
    slate, _ = ranking.recommend(df, "emb", [1.0, 0.0, 0.0], 2, "id", "region = 'us'", lam=.1)
    assert [r.id for r in slate.orderBy("slot").collect()] == ["a", "c"]
    assert {r.stage: (r.n_in, r.n_out) for r in stages.collect()}["filter"] == (4, 3)


def test_candidates_find_what_brute_force_finds(spark):
    rows = [(1, "habibs"), (2, "habib"), (3, "abibas"), (4, "starbucks"), (5, "haviano")]
    index = candidates.trigram_index(spark.createDataFrame(rows, "id int, name string"), "id", "name")
    assert [r.id for r in candidates.trigram_search(index, "id", "habibs", .5).collect()] == [1, 2, 3]
    texts = [(1, "the quick brown fox jumps over the lazy dog"), (2, "the quick brown fox jumps over the lazy dogs"), (3, "something else entirely, nothing shared")]
    sims = candidates.simhash(spark.createDataFrame(texts, "id int, body string"), "id", "body")
    found = candidates.simhash_search(sims, sims.where("id = 1").withColumnRenamed("id", "q"), "id", "q", 16)
    assert {r.id for r in found.collect()} == {1, 2}


def test_hyperplane_search_recalls_most(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    near = candidates.ann_search(e, e.where("vec_id % 50 = 0"), "vec_id", "v", 1, planes=candidates.hyperplanes(64, 8, 6))
    assert near.where("query_id = vec_id").count() == e.where("vec_id % 50 = 0").count()


@pytest.mark.parametrize("name, k", [("I9", 10), ("I11", 5)])
def test_registered_vector_search_recalls_nine_in_ten(spark, name, k):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {(r.query_id, r.vec_id) for r in QUERIES[name](spark, sf).collect()}
    want = set()
    for q in {q for q, _ in got}:
        order = np.argsort(1 - v @ v[ids == q][0], kind="stable")
        want |= {(q, int(i)) for i in ids[order][:k]} - {(q, q)}
    assert len(got & want) >= .9 * len(want)


def test_near_copies_at_the_edge_are_found(spark, tmp_path):
    rnd, rows = random.Random(1), []
    for q in range(60):
        words = [f"q{q}w{rnd.random()}" for _ in range(39)]
        rows += [(q * 20, " ".join(words[:34])), (q * 20 + 1, " ".join(words[5:]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len({r.query_id for r in QUERIES["C3"](spark, str(tmp_path)).collect()}) >= 54


def test_deltas_equal_a_recount(spark):
    base = spark.createDataFrame([("us", 10.0), ("us", 7.0)], "region string, amount double")
    v = views.ViewDef("v", "b", "region", group_by=["region"], count="n", sums={"amount": "total"})
    changed = spark.createDataFrame([(("us", 7.0), ("us", 9.0)), (None, ("eu", 1.0)), (("eu", 1.0), None)], "old struct<region:string,amount:double>, new struct<region:string,amount:double>")
    out = views.apply_deltas(views.derive(base, v), views.deltas(changed, v), v)
    assert [tuple(r) for r in out.collect()] == [("us", 2, 19.0)]


def test_backups_expire_by_both_rules(spark, tmp_path):
    store = views.Store(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    notes = [views.backup(store, "t", df, i) for i in range(3)]
    at = notes[-1]["at"]
    assert len(views.to_delete(store.versions("backup-t"), at, keep_latest=1)) == 2
    assert views.to_delete(store.versions("backup-t"), at, keep_latest=1, max_age=1000) == []
    log = spark.createDataFrame([(5, "put", 1, "b"), (6, "put", 2, "c"), (7, "delete", 1, None)], "index long, op string, id int, v string")
    out = views.restore(store, "t", "again", log=log, keys=["id"], index=6)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "b"), (2, "c")]
    with pytest.raises(FileExistsError):
        views.restore(store, "t", "again")


def test_transactions_are_all_or_nothing(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    key = spark.createDataFrame([(2,)], "id int")
    with pytest.raises(changes.TransactionCancelled):
        changes.transact(t, ["id"], deletes=[key], checks=[(key, "v = 'x'")])
    assert changes.transact(t, ["id"], deletes=[key], checks=[(key, "v = 'b'")]).count() == 1


def test_iterators_know_what_was_trimmed():
    assert changes.start_index("TRIM_HORIZON", 5, 9) == 5
    assert changes.start_index("LATEST", 5, 9) == 10
    assert changes.start_index("AFTER_SEQUENCE_NUMBER", 5, 9, 4) == 5
    with pytest.raises(changes.StreamTrimmed):
        changes.start_index("AT_SEQUENCE_NUMBER", 5, 9, 4)


def test_a_fast_view_ignores_repeated_batches(spark, tmp_path):
    rows = [(i, i % 3, i * 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "index long, k long, v double")
    df.where("index < 10").coalesce(1).write.parquet(f"{tmp_path}/log")
    store = views.Store(spark, f"file://{tmp_path}/store")
    go = lambda: live.fast_view(live.follow(spark, f"{tmp_path}/log", 1), store, "v", ["k"], "index", f"{tmp_path}/cp").awaitTermination()
    go()
    df.where("index >= 10").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    go()
    view = lambda: sorted((r.k, r["index"]) for r in live.read_fast_view(store, "v", ["k"], "index").collect())
    assert view() == [(0, 18), (1, 19), (2, 17)]
    assert len(store.versions("v")) == 2
    # a stream that starts anew gives batch numbers that are there already
    live.fast_view(live.follow(spark, f"{tmp_path}/log", 1), store, "v", ["k"], "index", f"{tmp_path}/cp2").awaitTermination()
    assert view() == [(0, 18), (1, 19), (2, 17)] and len(store.versions("v")) == 2


def test_segments_of_a_fast_view_are_merged(spark, tmp_path):
    store = views.Store(spark, f"file://{tmp_path}/store")
    for i in range(9):
        spark.createDataFrame([(i, i % 4), (i + 100, 9)], "index long, k long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    live.fast_view(live.follow(spark, f"{tmp_path}/log", 1), store, "v", ["k"], "index", f"{tmp_path}/cp", segments=3).awaitTermination()
    got = {r.k: r["index"] for r in live.read_fast_view(store, "v", ["k"], "index").collect()}
    assert got == {0: 8, 1: 5, 2: 6, 3: 7, 9: 108}
    assert sum(v["whole"] for v in store.versions("v")) == 2 and len(store.versions("v")) < 9


def test_stream_decisions_equal_batch_decisions(spark, tmp_path):
    rnd = random.Random(9)
    hits = [(rnd.randrange(3), i, rnd.randrange(1, 500)) for i in range(100)]
    df = spark.createDataFrame(hits, "user int, event long, sec long")
    df.coalesce(1).write.parquet(f"{tmp_path}/hits")
    out = live.decide_stream(live.follow(spark, f"{tmp_path}/hits"), ["user"], "sec", limit=3, window=100)
    out.writeStream.format("memory").queryName("decided").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    streamed = sum(r.allowed for r in spark.table("decided").collect())
    assert streamed == sum(replay(hits, limit=3, window=100).values())


def test_stream_state_lives_by_the_time_of_hits(spark, tmp_path):
    """Batches far apart in time, some of them within a rule's reach of the one before."""
    hits, at = [], 1000
    for i, step in enumerate((0, 5, 5, 4000, 10, 90, 9000, 1, 1, 1)):
        at += step
        hits += [(1, i, at)]
        spark.createDataFrame(hits[-1:], "user int, event long, sec long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/hits")
    out = live.decide_stream(live.follow(spark, f"{tmp_path}/hits", 1), ["user"], "sec", limit=2, window=100, ttl=20, late="10 seconds")
    out.writeStream.format("memory").queryName("decided_by_time").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {r.event: r.allowed for r in spark.table("decided_by_time").collect()}
    assert got == replay(hits, limit=2, window=100, ttl=20) and len(spark.table("decided_by_time").columns) == 5


@pytest.mark.parametrize("shape", [0.3, 1.0, 2.5, 40.0])
def test_draws_by_counter_have_their_distribution(shape):
    numbers = bandit._Numbers(np.arange(60_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    g, z = numbers.gamma(np.full(60_000, shape)), numbers.normal()
    assert abs(g.mean() - shape) < 5 * np.sqrt(shape / 60_000) and abs(g.var() / shape - 1) < .1
    assert abs(z.mean()) < .02 and abs(z.std() - 1) < .02


def test_a_draw_depends_on_its_request_only():
    table = pd.DataFrame({"arm": list("abc"), "pulls": [3, 0, 9], "rewards": [1.0, 0, 8], "alpha": [2.0, 1, 9], "beta": [3.0, 1, 2], "mu": [.1, .2, .3], "m2": [0.0] * 3})
    keys = np.arange(-50, 50)
    for policy, family in (("thompson", "beta"), ("thompson", "gaussian"), ("epsilon", "beta")):
        whole = bandit._drawn(table, keys, policy, family, 7, .3, 1.0)
        some = [int(bandit._drawn(table, keys[i:i + 1], policy, family, 7, .3, 1.0)[0]) for i in range(100)]
        assert whole.tolist() == some and len(set(some)) > 1


def test_sharded_cuckoo_filters_have_no_false_negative(spark):
    rows = [(f"v{i}", 1) for i in range(3000)] + [(f"v{i}", -1) for i in range(0, 3000, 3)] + [(None, 1), ("never", -1)]
    filters = sketches.cuckoo_shards(spark.createDataFrame(rows, "v string, sign int"), "v", 4, 1 << 9, 16, "sign")
    asked = spark.createDataFrame([(f"v{i}",) for i in range(6000)] + [(None,), ("never",)], "v string")
    got = {r.v for r in sketches.cuckoo_members(filters, asked, "v", 4, 1 << 9, 16).collect()}
    want = {f"v{i}" for i in range(3000) if i % 3}
    assert got >= want and len(got - want) < 40
    assert sketches.cuckoo_members(filters, asked.limit(0), "v", 4, 1 << 9, 16).count() == 0


def test_request_ids_are_remembered_for_their_life(spark):
    rows = [("a", 1, 0), ("a", 2, 59), ("a", 3, 60), ("a", 4, 100), ("b", 5, 1), (None, 6, 1), (None, 7, 1)]
    got = audience.fresh_requests(spark.createDataFrame(rows, "id string, n int, sec long"), "id", ["n"], "sec").collect()
    assert sorted(r.n for r in got) == [1, 3, 5, 6, 7]


def test_a_slate_that_is_too_long_raises(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MAX_SLATE", 5)
    ranked = spark.createDataFrame([(i, [float(i), 1.0], float(i)) for i in range(6)], "vec_id long, v array<double>, distance double")
    with pytest.raises(Exception, match="more than"):
        ranking.diversify(ranked, "v", .5, 3, ["distance", "vec_id"]).collect()
    assert ranking.diversify(ranked.limit(5), "v", .5, 3, ["distance", "vec_id"]).count() == 3


def _bucket_oracle(v, ids, asked, planes, weakest, k):
    """The k nearest by cosine of those that share a bucket with a query, row by row."""
    dots = np.einsum("sbd,nd->nsb", planes, v)
    bits = dots >= 0
    margin = np.argsort(np.abs(dots) / np.linalg.norm(planes, axis=2), axis=2)[..., :weakest]
    unit, out = v / np.linalg.norm(v, axis=1, keepdims=True), set()
    for i in np.flatnonzero(asked):
        differ = bits != bits[i]
        near = np.zeros(differ.shape[:2], dtype=bool)
        for s in range(len(planes)):
            may = np.zeros(differ.shape[2], dtype=bool)
            may[margin[i, s]] = True
            near[:, s] = (differ[:, s].sum(axis=1) == 0) | ((differ[:, s].sum(axis=1) == 1) & ~(differ[:, s] & ~may).any(axis=1))
        members = np.flatnonzero(near.any(axis=1))
        d = np.round(1 - unit[members] @ unit[i], 12)
        best = np.lexsort((ids[members], d))[:k]
        out |= {(int(ids[i]), int(ids[members[b]]), r + 1) for r, b in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [8192, 7])
def test_vector_search_gives_the_best_of_the_buckets_without_making_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(candidates, "BLOCK", block)
    rnd = np.random.default_rng(3)
    v = np.round(rnd.standard_normal((160, 8)), 3)
    v[40:100] = v[0]
    ids = rnd.permutation(160)
    rows = [(int(i), x.tolist()) for i, x in zip(ids, v)]
    odd = [(1000, [None] + [1.0] * 7), (1001, [float("nan")] * 8), (1002, None), (1003, [1.0])]
    e = spark.createDataFrame(rows + odd, "id long, v array<double>")
    planes = candidates.hyperplanes(8, 3, 3)
    found = candidates.ann_search(e, e.where("id % 4 = 0"), "id", "v", 5, planes=planes, weakest=1)
    assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == _bucket_oracle(v, ids, ids % 4 == 0, planes, 1, 5)
    # buckets meet as blocks: no join has a row for each pair of a query and a candidate
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows_met", [32768, 60])
def test_wide_buckets_meet_once_and_not_once_for_each_sketch(spark, monkeypatch, rows_met):
    monkeypatch.setattr(candidates, "ROWS_MET", rows_met)
    rnd = np.random.default_rng(5)
    v = np.round(rnd.standard_normal((300, 8)), 3)
    v[40:100], v[200:230] = v[0], -v[0]
    ids = rnd.permutation(300)
    e = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<double>")
    # of few sketches many near rows are no candidates, so some queries look at all their pairs
    for planes, weakest in ((candidates.hyperplanes(8, 4, 3), 2), (candidates.hyperplanes(8, 1, 4), 2)):
        found = candidates.ann_search(e, e.where("id % 4 = 0"), "id", "v", 5, planes=planes, weakest=weakest)
        assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == _bucket_oracle(v, ids, ids % 4 == 0, planes, weakest, 5)
        # rows aren't repeated for their buckets
        assert " MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_selective_buckets_are_still_read_by_bucket(spark):
    rnd = np.random.default_rng(6)
    v, ids = np.round(rnd.standard_normal((200, 8)), 3), rnd.permutation(200)
    e = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<double>")
    planes = candidates.hyperplanes(8, 1, 4)
    found = candidates.ann_search(e, e.where("id % 4 = 0"), "id", "v", 5, planes=planes, weakest=0)
    assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == _bucket_oracle(v, ids, ids % 4 == 0, planes, 0, 5)
    assert " MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_that_count_are_found_however_far_behind_others_they_are():
    rnd = np.random.default_rng(7)
    q, v = rnd.standard_normal((6, 5)), rnd.standard_normal((900, 5))
    v[100:160] = v[3]
    allowed = np.zeros((6, 900), dtype=bool)
    allowed[:, ::2] = True
    allowed[1, :], allowed[2, :] = False, False
    far = np.argsort(((v - q[2]) ** 2).sum(axis=1))[-3:]
    allowed[2, far] = True
    i, j, d = candidates.nearest_in_block(q, v, 4, "euclidean", lambda a, b: allowed[a, b])
    for x in range(6):
        rows = np.flatnonzero(allowed[x])
        want = np.sqrt(((v[rows] - q[x]) ** 2).sum(axis=1))
        assert np.allclose(np.sort(want)[:4], d[i == x]) and set(j[i == x]) <= set(rows)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_block_distances_are_those_of_the_columns(spark, metric):
    from strataforge.functions import distance as distances

    rnd = np.random.default_rng(4)
    q, v = rnd.standard_normal((9, 6)), rnd.standard_normal((50, 6))
    q[1], v[3], v[10:30] = q[0], 0, v[5]
    i, j, d = candidates.nearest_in_block(q, v, 4, metric)
    pairs = spark.createDataFrame([(a, b, x.tolist(), y.tolist()) for a, x in enumerate(q) for b, y in enumerate(v)], "a int, b int, x array<double>, y array<double>")
    want = {}
    for r in pairs.select("a", "b", distances.operator(metric)(F.col("x"), F.col("y")).alias("d")).collect():
        want.setdefault(r.a, []).append((r.d, r.b))
    got = {}
    for a, b, x in zip(i.tolist(), j.tolist(), d.tolist()):
        got.setdefault(a, []).append((x, b))
    assert got == {a: sorted(x)[:4] for a, x in want.items()}


def test_classes_of_simhashes_stand_for_all_pairs_in_fewer_rows(spark, tmp_path):
    names = ["red bolt", "red bolts", "hot ring", "a far longer name of a part", "x", ""]
    rows = [(i, names[i % 6] if i % 11 else None) for i in range(600)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    out = QUERIES["I8"](spark, str(tmp_path)).collect()
    sims = {i: candidates._simhash(n) for i, n in rows if n is not None}
    want = {(q, i, ((sims[q] ^ sims[i]) & (1 << 64) - 1).bit_count()) for q in sims if q % 20 == 0 for i in sims if ((sims[q] ^ sims[i]) & (1 << 64) - 1).bit_count() <= 3}
    members, of = {}, {}
    for r in out:
        if r.kind == "member":
            members.setdefault(r.class_id, []).append(r.p_partkey)
            of[r.p_partkey] = r.class_id
    near = [(r.class_id, r.near_id, r.bits) for r in out if r.kind == "pair"]
    got = [(q, i, bits) for a, b, bits in near for q in members[a] if q % 20 == 0 for i in members[b]]
    assert len(got) == len(set(got)) and set(got) == {(q, i, bits) for q, i, bits in want}
    assert sorted(of) == sorted(sims) and all(min(members[c]) == c for c in members)
    # before, each query met each copy: 2,500 rows and more
    assert len(out) <= len(sims) + 36
    probes = spark.createDataFrame([(i, n) for i, n in rows if n is not None], "id long, name string")
    index = candidates.simhash(probes, "id", "name")
    found = candidates.simhash_search(index, index.where("id % 20 = 0").withColumnRenamed("id", "q"), "id", "q", 3)
    assert {tuple(r) for r in found.collect()} == want


@pytest.mark.parametrize("block", [8192, 5])
def test_near_sets_are_those_of_the_bands_without_making_pairs(spark, monkeypatch, block):
    from strataforge.functions import distance as distances

    monkeypatch.setattr(candidates, "BLOCK", block)
    rnd, rows = random.Random(5), [(900, None), (920, ""), (940, ""), (960, " "), (961, "x")]
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(30)]
        for i in range(20):
            kept = words if i % 3 == 0 else [w for w in words if rnd.random() < .9]
            rows.append((family * 20 + i, " ".join(kept)))
    df = spark.createDataFrame(rows, "id long, text string")
    words = F.split("text", " ")
    found = candidates.near_sets(df, "id", words, F.col("id") % 20 == 0, .3, 32, 4)
    # the plain way: every pair of a bucket, then the distance of each
    bands = candidates.minhash_bands(df, "id", words, 32, 4)
    pairs = candidates.band_candidates(bands.where("id % 20 = 0").withColumnRenamed("id", "query_id"), bands, "query_id", "id").where("query_id <> id")
    sets = df.select("id", F.array_distinct(words).alias("w"))
    full = pairs.join(sets, "id").join(sets.select(F.col("id").alias("query_id"), F.col("w").alias("v")), "query_id")
    want = [tuple(r) for r in full.select("query_id", "id", F.round(distances.jaccard(F.col("v"), F.col("w")), 6).alias("d")).where("d <= .3").collect()]
    assert len(want) > 50 and sorted(tuple(r) for r in found.collect()) == sorted(want)
    # sets travel once for each bucket, and no join has a row for each pair
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join [band" not in plan


@pytest.mark.parametrize("rows_met,portion", [(32768, 1 << 21), (40, 60)])
def test_near_sets_leave_out_no_pair_within_reach(spark, tmp_path, monkeypatch, rows_met, portion):
    for name, value in (("ROWS_MET", rows_met), ("LEAST_BLOCKS", 1), ("WORDS_MET", portion), ("CELLS", max(64, portion))):
        monkeypatch.setattr(candidates, name, value, raising=False)
    rnd, rows = random.Random(8), []
    for pair in range(240):                 # 14 words of 20 in common, so at a distance of 0.3 exactly
        words = [f"p{pair}w{i}" for i in range(20)]
        rnd.shuffle(words)
        rows += [(20 * pair, " ".join(words[:17])), (20 * pair + 1, " ".join(words[:14] + words[17:]))]
    for i in range(90):                     # one family of near and exact copies, of common words and of many sizes
        words = [f"c{w}" for w in range(40 + i // 3)]
        rows.append((10000 + 5 * i, " ".join(words if i % 4 else [w for w in words if rnd.random() < .85])))
    rows += [(20000, None), (20020, ""), (20021, ""), (20040, "x"), (20041, "X x"), (20041, "x"), (20041, "y"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sets = [(i, set(t.lower().split(" "))) for i, t in rows if i is not None and t is not None]

    def all_within(within):
        pairs = [(q, i, round(1 - len(x & y) / len(x | y), 6)) for q, x in sets if q % 20 == 0 for i, y in sets if i != q]
        return sorted(p for p in pairs if p[2] <= within)

    want = all_within(.3)
    assert sum(q < 4800 for q, _, _ in want) == 240 and len(want) > 700
    # before, pairs without a band in common were left out
    assert sorted((r.query_id, r.doc_id, r.distance) for r in QUERIES["C3"](spark, str(tmp_path)).collect()) == want
    words = F.split(F.lower("text"), " ")
    few = df.where("doc_id % 200 = 0 or doc_id >= 20000")
    kept = {r.doc_id for r in few.collect()}
    for within in (0, .9, 1):
        found = candidates.near_sets(few, "doc_id", words, F.col("doc_id") % 20 == 0, within)
        assert sorted((r.query_id, r.doc_id, r.distance) for r in found.collect()) == [p for p in all_within(within) if p[0] in kept and p[1] in kept]


def test_min_hashes_are_those_of_sparks_function(spark, monkeypatch):
    monkeypatch.setattr(candidates, "TOKENS_AT_ONCE", 3)
    rnd = random.Random(6)
    sets = [["".join(rnd.choice("aé z") for _ in range(n)) for n in (size, 1, 40)] for size in range(70)] + [[None, "a"], [None], [""]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sets)] + [(100, []), (101, None)], "id long, t array<string>")
    minima = F.array(*(F.array_min(F.transform("t", lambda t: F.xxhash64(F.lit(7), F.lit(i), t))) for i in range(4)))
    by_hand = df.where(F.size("t") > 0).select("id", minima.alias("m"))
    want = {(r.id, b): x for r in by_hand.select("id", *(F.xxhash64(F.slice("m", 2 * b + 1, 2)).alias(f"b{b}") for b in range(2))).collect() for b, x in enumerate((r.b0, r.b1))}
    bands = candidates.minhash_bands(df, "id", F.col("t"), 4, 2, 7)
    assert {(r.id, r.band): r.bucket for r in bands.collect()} == want
    # before, each hash of each token was an expression of its own that Spark interprets
    assert "MapInArrow" in bands._jdf.queryExecution().executedPlan().toString()


def test_classes_of_bands_stand_for_all_candidate_pairs_in_fewer_rows(spark, tmp_path):
    from strataforge.queries import queries

    odd = ["", " ", "  lead", "trail  ", "A\x0bb\x0cc\r\nd", "no\xa0break \x1c here", None, "\u0130x I"]
    rows = [(i, "one text of many copies " * 3 + ("" if i % 4 else f"end{i % 3}")) for i in range(200)] + [(300 + i, x) for i, x in enumerate(odd * 2)] + [(400 + i, f"text {i} alone {i * 7}") for i in range(41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bands = candidates.minhash_bands(docs, "doc_id", F.array_distinct(F.split(F.lower("text"), r"\s+")), 32, 4)
    pairs = candidates.band_candidates(bands.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), bands, "query_id", "doc_id")
    found = queries()["I7"](spark, str(tmp_path))
    classes = found.collect()
    asked = {}
    members = {}
    for r in classes:
        members.setdefault((r.band, r.bucket), set()).add(r.doc_id)
        if r.asked:
            asked.setdefault(r.doc_id, set()).add((r.band, r.bucket))
    assert {(q, x) for q, at in asked.items() for b in at for x in members[b]} == {(r.query_id, r.doc_id) for r in pairs.collect()}
    assert len(classes) <= 8 * len(rows) and pairs.count() > len(classes)
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("MapInArrow") == 1       # one pass of min-hashes
