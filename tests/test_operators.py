"""Operators on small tables: ties, empty tables, gaps, and twins that must agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import datasets, embed, evaluate, fit, lookup, runs, scan, search

INDEX = "path string, embedding array<double>"
NAN = float("nan")


def index(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [NAN, 1.0]), ("e", [1.0]), ("f", []), ("g", [-1.0, 0.0])]
    return spark.createDataFrame(rows, INDEX).repartition(3)


def hits(df):
    return [(r["query_id"], r["path"], r["score"], r["rank"]) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("k", [-1, 0, 2, 50])
def test_search_equals_full_sort(spark, k):
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [NAN, 3.0]), (3, [5.0]), (4, [0.0, 0.0])], "query_id long, embedding array<double>")
    fast = search.topk_search(index(spark), queries, k, block=2)
    plain = search.rank_hits(search.score_pairs(index(spark), search.prepare_queries(queries)), k)
    assert hits(fast) == hits(plain)
    if k == 2:
        assert hits(fast)[:2] == [(1, "a", 1.0, 1), (1, "b", 1.0, 2)]
    skipped = search.topk_search(index(spark), queries, 1, on_non_finite="skip")
    assert {r["query_id"] for r in skipped.collect()} == {1, 3, 4}


def test_search_beyond_a_broadcast(spark, monkeypatch):
    """Several blocks and slices, and no query vector on the driver."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(200)]
    big = spark.createDataFrame(rows, "path long, embedding array<double>").repartition(3)
    queries = big.select(F.col("path").alias("query_id"), "embedding")
    plain = hits(search.rank_hits(search.score_pairs(big, search.prepare_queries(queries)), 3))

    def refuse(*_, **__):
        raise AssertionError("queries on the driver")

    monkeypatch.setattr(type(queries), "toLocalIterator", refuse)
    monkeypatch.setattr(search, "SLICE", 60, raising=False)
    fast = hits(search.topk_search(big, queries, 3, block=30, broadcast_mb=-1))
    assert len(fast) == 600 and [(r[0], r[3]) for r in fast] == [(r[0], r[3]) for r in plain]
    assert max(abs(a[2] - b[2]) for a, b in zip(fast, plain, strict=True)) < 1e-12
    assert hits(search.topk_search(big, queries, 3)) == fast


@pytest.mark.parametrize("key", ["long", "string"])
def test_search_in_place_shuffles_hits_only(spark, monkeypatch, tmp_path, key):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-2, 3, 2 + i % 2).astype(float).tolist()) for i in range(3000)]
    spark.createDataFrame(rows, "path long, embedding array<double>").withColumn("path", F.col("path").cast(key)).repartition(2).write.parquet(f"{tmp_path}/index")
    big = spark.read.parquet(f"{tmp_path}/index")
    queries = big.where(F.col("path").cast("long") % 20 == 0).select(F.col("path").alias("query_id"), "embedding")
    monkeypatch.setattr(search, "SLICE", 70)  # ties and prunes across many slices
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    fast = search.topk_search(search.fix_index(big), queries, 4)
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan.split("Exchange")[1]
    assert hits(fast) == hits(search.rank_hits(search.score_pairs(big, search.prepare_queries(queries)), 4))


def test_pairs_beyond_a_broadcast(spark):
    rows = [(i, [float(i % 5), 1.0, float(i)][: 2 + i % 2]) for i in range(40)]
    big = spark.createDataFrame(rows, "path long, embedding array<double>")
    asked = big.where("path % 4 = 0").select(F.col("path").alias("query_id"), "embedding")
    both = [sorted(map(tuple, search.score_pairs(big, asked, broadcast_mb=mb).collect())) for mb in (64, -1)]
    assert both[0] == both[1] and len(both[0]) == 10 * 20


def test_best_of_columns():
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 6, (40, 30)).astype(float)
    for k in (1, 3, 40, 99):
        entry, ask, score = search.best_of_columns(scores, k)
        want = np.argsort(-scores, axis=0, kind="stable")[:k]
        assert entry.tolist() == want.T.ravel().tolist() and ask.tolist() == np.repeat(np.arange(30), len(want)).tolist()
        assert score.tolist() == np.take_along_axis(scores, want, axis=0).T.ravel().tolist()


def test_problem_report(spark):
    items = [("x", f"p{i:02}") for i in range(6)] + [("y", "only")]
    got = {r["kind"]: (r["problems"], r["preview"]) for r in search.problem_report(spark.createDataFrame(items, "kind string, path string")).collect()}
    assert got == {"x": (6, "p00, p01, p02, p03, p04, ..."), "y": (1, "only")}


def test_embedding_skips_blank_texts(spark):
    docs = spark.createDataFrame([("a", "hello world"), ("b", "  "), ("c", None), ("d", "hello world")], "path string, contents string")
    got = {r["path"]: r["embedding"] for r in embed.embed_documents(docs).collect()}
    assert got.keys() == {"a", "d"} and got["a"] == got["d"] and sum(x * x for x in got["a"]) == pytest.approx(1)
    assert [r["path"] for r in search.skipped_documents(docs, embed.embed_documents(docs)).orderBy("path").collect()] == ["b", "c"]


def test_native_model_equals_the_plugged_one(spark):
    docs = spark.createDataFrame([("a", "Hello hello World"), ("b", " \n"), ("c", None), ("d", "één\ttwo  three"), ("d", "other")], "path string, contents string")
    both = [sorted((r["path"], [round(x, 9) for x in r["embedding"]]) for r in embed.embed_documents(docs, load).collect()) for load in (None, embed.HashingEmbedder)]
    assert both[0] == both[1] and [p for p, _ in both[0]] == ["a", "d", "d"]


def test_pooling_of_masked_tokens(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [True, True, False]), ([[1.0, 1.0]], [False])], "t array<array<double>>, m array<boolean>")
    for strategy, want in (("mean", [2.0, 3.0]), ("max", [3.0, 4.0]), ("last", [3.0, 4.0]), ("first", [1.0, 2.0]), ("cls", [1.0, 2.0]), ("none", [2.0, 3.0])):
        got = [r["v"] for r in df.select(embed.pool(strategy, "t", "m", normalized=False).alias("v")).collect()]
        assert got == [want, []]


def test_positions_and_batches(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), "id").repartition(5)
    got = sorted((r["position"], r["a"], r["id"]) for r in datasets.with_position(df, "a", "id", parts=5).collect())
    assert [g[0] for g in got] == list(range(1000)) and [g[1:] for g in got] == sorted((i % 7, i) for i in range(1000))
    batches = datasets.assign_batches(df, "a", "id", size=64).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in batches) == [1000 % 64] + [64] * 15
    assert datasets.assign_batches(df.limit(0), "a", size=3).count() == 0
    names = spark.createDataFrame([(f"p{i % 90:03}", i, "kept") for i in range(400)] + [(None, 400, "kept")], "path string, _n long, position string").repartition(6)
    named = datasets.assign_batches(names, "path", "_n", size=7)
    assert named.columns == ["path", "_n", "position", "batch_id", "pos"] and named.where("position <> 'kept'").count() == 0
    rows = sorted((r["batch_id"] * 7 + r["pos"], r["path"] or "", r["_n"]) for r in named.collect())
    assert [r[0] for r in rows] == list(range(401)) and [r[1:] for r in rows] == sorted((f"p{i % 90:03}" if i < 400 else "", i) for i in range(401))
    tied = datasets.with_position(names, "position").collect()
    assert sorted(r["position"] for r in tied) == list(range(401))


def test_shuffle_is_a_repeatable_permutation(spark):
    df = spark.range(300).select(F.col("id").alias("k"))
    order = lambda seed, epoch: [r["k"] for r in datasets.seeded_shuffle(df, "k", seed, epoch).orderBy("position").collect()]
    assert order(1, 0) == order(1, 0) != order(1, 1) != order(2, 0)
    assert sorted(order(1, 0)) == list(range(300))


def test_metrics(spark):
    df = spark.createDataFrame([([1.0, 3.0], 1), ([1000.0, 0.0], 1)], "logits array<double>, label int")
    assert evaluate.accuracy(df).first()[0] == 0.5
    assert evaluate.cross_entropy(df).first()[0] == pytest.approx((np.log(1 + np.exp(-2)) + 1000) / 2)
    steps = spark.createDataFrame([(i, float(i), 0.5, 10) for i in range(1, 26)], "iter long, loss double, seconds double, tokens long")
    report = {r["report"]: r for r in evaluate.training_report(steps).collect()}
    assert report[0]["iterations_per_second"] == 2 and report[2]["iter"] == 25 and report[2]["loss"] == 23
    two = steps.withColumn("run", F.lit("x")).unionByName(steps.withColumn("run", F.lit("y")))
    assert evaluate.training_report(two, by=["run"]).count() == 6
    marks = evaluate.checkpoints(steps, 10, 5).collect()
    assert sorted((r["iter"], r["mark"]) for r in marks) == [(1, "validated"), (5, "validated"), (10, "saved"), (10, "validated"), (15, "validated"), (20, "saved"), (20, "validated"), (25, "validated")]
    scored = spark.createDataFrame([(1, 2.0, 0.5), (1, 4.0, 0.5), (10, 1.0, 0.25)], "iter long, loss double, seconds double")
    assert sorted(tuple(r) for r in evaluate.validation_report(steps, scored, 10).na.fill(-1).collect()) == [(1, 3.0, 1.0), (10, 1.0, 0.25), (20, -1.0, -1.0)]
    assert evaluate.perplexity(steps.limit(0)).first()["perplexity"] is None


def test_runs(spark):
    events = spark.createDataFrame(
        [(1, 1, "2024-01-01 00:00:01", "chunk", ""), (1, 2, "2024-01-01 00:00:02", "chunk", "a"), (1, 3, "2024-01-01 00:00:03", "tool", None), (1, 4, "2024-01-01 00:00:04", "chunk", "z"), (2, 1, "2024-01-01 00:00:01", "tool", None)],
        "run_id long, seq long, ts string, kind string, chunk string",
    ).withColumn("ts", F.to_timestamp("ts"))
    table = spark.createDataFrame([(1, "m", 2), (2, "m", 2), (3, "m", 2)], "run_id long, model string, max_tokens int").withColumn("start_ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    got = {r["run_id"]: r for r in runs.generation_metrics(events, table).collect()}
    assert (got[1]["ttft_ms"], got[1]["rate_tokens"], got[1]["total_tokens"], got[1]["tokens_per_second"], got[1]["truncated"]) == (1000, 3, 2, 1, True)
    assert got[2]["tokens_per_second"] is None and got[2]["rate_tokens"] == 1 and got[3]["ttft_ms"] is None and not got[3]["truncated"]
    assert {r["run_id"]: r["output"] for r in runs.assemble_output(events).collect()} == {1: "a"}


def test_chats(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", ""), (2, 0, "assistant", ""), (2, 1, "user", ""), (3, 0, "user", "u"), (3, 1, "tool", "t"), (3, 2, "system", "s")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((r["conv_id"], r["turn"]) for r in runs.open_turn(chats).collect()) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    got = {r["conv_id"]: [(m["role"], m["text"]) for m in r["messages"]] for r in runs.assemble_chat(chats, chats.where("conv_id = 3")).collect()}
    assert got[3] == [("system", "s"), ("user", "u"), ("tool", "t\n[Cancelled]")] and got[1] == [("user", "q"), ("assistant", "")]


def test_prompts(spark):
    prompts = spark.createDataFrame([(1, "plain"), (2, "@b,@a"), (3, "@a,@gone"), (4, None)], "prompt_id long, prompt string")
    files = spark.createDataFrame([("a", "A"), ("b", "B")], "path string, contents string")
    assert {r[0]: r[1] for r in runs.resolve_prompts(prompts, files, "dflt").collect()} == {1: "plain", 2: "B\nA", 3: "dflt", 4: "dflt"}


def test_descent_on_moments_equals_descent_on_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, 200)
    y = 3 + 0.5 * x + 3 * x**2 + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double")
    theta, trace = np.zeros(3), []
    for _ in range(51):
        trace.append(theta.copy())
        error = theta[0] + theta[1] * x + theta[2] * x**2 - y
        theta = theta - 0.1 * 2 * np.array([(error * x**k).mean() for k in range(3)])
    got = fit.fit_poly(df, 2, 0.1, 50, trace=True).orderBy("step").collect()
    assert np.allclose([r["theta"] for r in got], trace)
    line = spark.range(100).select((F.col("id") / 100).alias("x"), (F.col("id") / 100 * 0.25 + 7).alias("y"))
    assert fit.fit_poly(line, 1, 0.5, 2000).first()["theta"] == pytest.approx([7, 0.25], abs=1e-6)
    assert fit.fit_poly(df.limit(0), 1, 0.5, 3).count() == 0


def test_zones_and_tables(spark):
    points = spark.createDataFrame([(9, 5), (10, 5), (19, 39), (20, 5), (30, 30), (25, 25), (0, 7)], "x int, y int")
    got = {(r["x"], r["y"]): (r["wall"], r["value"], r["static"]) for r in lookup.tag_zones(points, [(10, 5, 10, 35)], [(30, 30, 10, 0.75), (25, 25, 6, 0.0)], 64, 64).collect()}
    assert got[(10, 5)][0] and got[(19, 39)][0] and not got[(9, 5)][0] and not got[(20, 5)][0]
    assert got[(30, 30)] == (False, 0.75, True) and got[(25, 25)] == (False, 0.0, False) and got[(0, 7)][2]
    at = spark.createDataFrame([(0.0,), (1.5,), (2.0,), (2.1,), (-0.1,)], "x double")
    assert [r[0] for r in at.select(lookup.interpolate([1.0, 3.0, 9.0], "x")).collect()] == [1, 6, 9, None, None]


def test_throttle(spark):
    rows = [("a", t, i) for i, t in enumerate([0, 400, 500, 900, 1000, 1499, 1500])] + [("b", 100, 0)]
    df = spark.createDataFrame(rows, "key string, ms long, n int").select("key", F.timestamp_millis("ms").alias("ts"), "n")
    got = sorted((r["key"], r["n"]) for r in scan.throttle(df, "key", "ts", "n", 0.5).collect())
    assert got == [("a", 0), ("a", 2), ("a", 4), ("a", 6), ("b", 0)]


def test_schedules(spark):
    b = lookup.betas(0.1, 0.4, 4, "scaled")
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(b)] + [("z", 0, 1.0), ("z", 1, 0.5)], "k string, i int, beta double")
    got = {(r["k"], r["i"]): r for r in lookup.noise_schedule(df, "k", "i", "beta").collect()}
    product = np.cumprod(1 - np.array(b))
    assert np.allclose([got[("k", i)]["alphas_product"] for i in range(4)], product)
    assert np.allclose([got[("k", i)]["sigma"] for i in range(4)], np.sqrt((1 - product) / product))
    assert got[("z", 1)]["alphas_product"] == 0 and got[("z", 1)]["sigma"] is None


def test_tool_calls(spark):
    calls = [
        ("add_two_numbers", '{"first": 1, "second": 2}', '{"result":3}'), ("add_two_numbers", '{"second": -5, "first": 5, "more": [1]}', '{"result":0}'), ("add_two_numbers", '{"first": 1}', "Malformed arguments"),
        ("add_two_numbers", '{"first": 1, "second": null}', "Malformed arguments"), ("add_two_numbers", '{"first": 1.5, "second": 2}', "Malformed arguments"), ("add_two_numbers", "", "Malformed arguments"), ("add_two_numbers", None, "Malformed arguments"),
        ("add_two_numbers", '{"first": 9223372036854775807, "second": 1}', "Malformed arguments"), ("add", "{}", "Unknown tool: add"), (None, "{}", "Unknown tool: "), ("shout", '{"text": "a"}', '{"loud":"A"}'), ("shout", '{"times": 2}', "Malformed arguments"),
    ]
    shout = runs.Tool("shout", "text string, times int", ("text",), lambda a: F.struct(F.upper(a["text"]).alias("loud")))
    df = spark.createDataFrame(calls, "name string, arguments string, want string")
    assert all(r["result"] == r["want"] for r in runs.route_tool_calls(df, tools=[runs.ADD, shout]).collect())


def test_ties_are_spread_over_partitions(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"), F.col("id").alias("v"), F.create_map(F.lit("a"), "id").alias("m"))
    done = datasets.with_position(df, "k", parts=8)
    assert sorted(r["position"] for r in done.select("position").collect()) == list(range(20000))
    files = spark.read.parquet(next(f for f in done.inputFiles()).rsplit("/", 1)[0]).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 8 and max(r["count"] for r in files) < 2 * 20000 / 8


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    at = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{at}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return embed.HashingEmbedder(8)

    docs = spark.range(64, numPartitions=32).select(F.col("id").alias("path"), F.lit("a b").alias("contents"))
    assert embed.embed_documents(docs, load).count() == 64
    made = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(made) == len(set(made)) < 32


def test_pairs_that_can_rank(spark, monkeypatch):
    """Pairs of the first k only are passed on, by one matrix product a slice."""
    monkeypatch.setattr(search, "SLICE", 50)
    rng = np.random.default_rng(11)
    big = spark.createDataFrame([(i, rng.integers(-2, 3, 3 + i % 2).astype(float).tolist()) for i in range(600)], "path long, embedding array<double>").repartition(2)
    asked = big.where("path % 50 = 0").select(F.col("path").alias("query_id"), "embedding")
    every = search.score_pairs(big, asked)
    assert "MapInArrow" in every._jdf.queryExecution().executedPlan().toString() and every.count() == 12 * 300
    for mb in (64, -1):
        few = search.score_pairs(big, asked, broadcast_mb=mb, k=3)
        assert few.count() <= 12 * 3 * (2 if mb > 0 else 12) and hits(search.rank_hits(few, 3)) == hits(search.rank_hits(every, 3))
