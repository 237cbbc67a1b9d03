"""Results whose rows and work grow with the input, not with products of its parts."""

from pyspark.sql import functions as F

from trajspark.plans import callgraph

READS = "record_index int, instance_id string, trace_idx int, file_path string, start_line int, end_line int"


def test_step_details_by_class(spark):
    """A thousand nodes of one range are one class in each step that touches them."""
    nodes = spark.range(1000).select(F.lit("i").alias("instance_id"), F.col("id").alias("node_key"), F.lit("a").alias("file_path"), F.lit(5).alias("start_line"), F.lit(9).alias("end_line"), F.lit(0.5).alias("normalized_distance"))
    far = spark.createDataFrame([("i", 2000, "a", 9, 20, None), ("i", 2001, "b", 1, 2, 0.0)], "instance_id string, node_key long, file_path string, start_line int, end_line int, normalized_distance double")
    reads = spark.createDataFrame([(1, "i", 0, "a", 1, 5), (1, "i", 0, "a", 9, 9), (1, "i", 0, "a", 9, 9), (1, "i", 1, "a", 100, 101), (2, "i", 0, "a", 10, 30)], READS)
    steps = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "record_index int, trace_idx int").select("*", F.lit("read").alias("family"), F.lit("a").alias("target"))
    got = {(r.record_index, r.trace_idx): r for r in callgraph.step_details(steps, reads, nodes.unionByName(far)).collect()}
    assert {k: (r.n_reads, r.n_hit, r.nearest, r.min_distance) for k, r in got.items()} == {(1, 0): (3, 1001, 0, 0.5), (1, 1): (1, 0, None, None), (1, 2): (0, 0, None, None), (2, 0): (1, 1, 2000, 1.0)}
    assert [(c.d, c.nearest, c.start_line, c.end_line, c.n) for c in got[1, 0].hit_classes] == [(0.5, 0, 5, 9, 1000), (1.0, 2000, 9, 20, 1)] and got[1, 1].hit_classes == []


def test_topology_by_hit(spark):
    """A record has a row with its hits in the listing, not one for each node of it."""
    nodes = spark.range(500).select(F.lit("i").alias("instance_id"), F.col("id").alias("node_key"), F.lit("a").alias("file_path"), F.col("id").cast("int").alias("start_line"), F.lit(0.5).alias("normalized_distance"))
    hits = spark.createDataFrame([(1, "i", 7, 4), (1, "i", 7, 2), (1, "i", 3, 5), (2, "i", 9, 0), (3, "none", 9, 0), (4, "i", 900, 0)], "record_index int, instance_id string, node_key long, trace_idx int")
    got = {r.record_index: r for r in callgraph.topology(nodes, hits).collect()}
    assert {k: (r.n_nodes, [tuple(h) for h in r.hits]) for k, r in got.items()} == {1: (500, [(3, 3, 5), (7, 7, 2)]), 2: (500, [(9, 9, 0)])}


def test_hits_by_record(spark):
    """Reads go to their record in one row each, whatever they touch, and classes read twice count once, at their first step."""
    from trajspark.operators import overlap, sequences

    nodes = spark.createDataFrame([("i", k, "a", k % 40, k % 40 + 1, (k % 4) / 4, k % 10 > 0) for k in range(800)], "instance_id string, node_key int, file_path string, start_line int, end_line int, normalized_distance double, rewardable boolean")
    reads = spark.createDataFrame([(1, "i", 0, "a", 5, 9), (1, "i", 2, "a", 0, 60), (1, "i", 1, "a", 7, 12), (1, "i", 3, "a", 5, 9), (2, "i", 0, "a", 0, 60), (3, "i", 0, "b", 1, 2)], READS)
    hit = lambda s, e: {k for k in range(800) if k % 10 and s <= k % 40 + 1 and e >= k % 40}
    first = {}
    for step, (s, e) in enumerate([(5, 9), (7, 12), (0, 60)]):
        for k in hit(s, e):
            first.setdefault(k, step)
    rows = overlap.hit_classes(reads, nodes)
    assert {r.record_index: r.n for r in rows.groupBy("record_index").agg(F.sum("n").alias("n")).collect()} == {1: 720, 2: 720}
    pairs = [((k % 4 > j % 4) - (k % 4 < j % 4)) for k in first for j in first if first[k] < first[j] and k % 4 != j % 4]
    score = {r.record_index: r.order_score for r in sequences.order_score(rows).collect()}
    assert set(score) == {1} and abs(score[1] - sum(pairs) / len(pairs)) < 1e-12
    assert {r.record_index: (r.precision, r.recall) for r in overlap.precision_recall(reads, nodes).collect()} == {1: (1.0, 1.0), 2: (1.0, 1.0)}
    plan = overlap.hit_classes(reads, nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") and plan.index("Generate explode") < plan.index("Aggregate [record_index")


def test_planned_runs_order_only_the_first(spark):
    """Instances are numbered within the limit alone, and cells meet the plan, not all instances."""
    from trajspark.plans import cache

    inst = spark.range(1000).select(F.lit("d").alias("dataset"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("instance_id"), (999 - F.col("id")).alias("at"))
    models = spark.createDataFrame([("e", "p", m, m, "d") for m in ("m0", "m1")], "experiment_id string, provider_source string, model_api_name string, model_label string, dataset string")
    cells = inst.select(F.lit("e").alias("experiment_id"), F.lit("p").alias("provider_source"), F.lit("m1").alias("model_api_name"), "dataset", "instance_id", F.when(F.col("at") % 2 == 0, "done").otherwise("error").alias("status"))
    runs = cache.planned_runs(models, cache.placed(inst, "at", 5), cells, 5)
    want = {("smoke" if k == 0 else "full", m, f"i{999 - k}") for k in range(5) for m in ("m0", "m1") if m == "m0" or k % 2}
    assert {(r.phase, r.model_api_name, r.instance_id) for r in runs.collect()} == want
    plan = cache.placed(inst, "at", 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


FRAMES = "instance_id int, trace_idx int, frame_idx int, file_path string, line_no int, func_name string, qualified_name string, is_patched boolean"


def test_unobserved_reads_patched_frames_alone(spark, monkeypatch):
    """No table of the call graph is made for it."""
    f = spark.createDataFrame([(1, 0, 0, "a.py", 1, "f", "f", True), (1, 0, 1, "a.py", 5, "g", "g", False)], FRAMES)
    m = spark.createDataFrame([(1, "a.py", "f", 1, 2), (1, "a.py", "g", 5, 6), (2, "a.py", "f", 1, 2)], "instance_id int, file_path string, qualified_name string, start_line int, end_line int")
    monkeypatch.setattr(callgraph, "stage", lambda *_: 1 / 0)
    assert {(r.instance_id, r.node_key) for r in callgraph.unobserved(f, m).collect()} == {(1, "a.py::g"), (2, "a.py::f")}


def test_anchors_are_scored_once(spark, monkeypatch):
    """Both walks of the root counts share the scores of frames."""
    from trajspark.functions import anchors
    from trajspark.plans import roots

    calls, whole = [], anchors.frame_scores
    monkeypatch.setattr(anchors, "frame_scores", lambda *a: calls.append(1) or whole(*a))
    f = spark.createDataFrame([(1, 0, 0, "a.py", 1, "make", "make", False), (1, 0, 1, "a.py", 5, "g", "g", True)], FRAMES)
    issues = spark.createDataFrame([(1, "It fails in `make`")], "instance_id int, issue_text string")
    assert roots.select_roots(f, issues).counts.count() == 1 and len(calls) == 1


def test_plain_paths_need_no_cleaning(spark):
    from trajspark.functions.anchors import anchor_path
    from trajspark.functions.testout import test_file_reason as reason

    paths = ["a/b-c.py", "./a.py", "a.py:3", "a.py\n", "\\a\\tests\\b.py", "'a.py'", "a.py#L3", "tests/a.py", "x/my_runner.py", "src/contest.py", "a/conftest.py", "", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(anchor_path(F.col("p")), reason(F.col("p")))
    assert [tuple(r) for r in df.collect()] == [("a/b-c.py", None), ("a.py", None), ("a.py", None), ("a.py", None), ("a/tests/b.py", "a/tests/**"), ("a.py", None), ("a.py", None), ("tests/a.py", "tests/**"), ("x/my_runner.py", "*_runner.py"), ("src/contest.py", None), ("a/conftest.py", "conftest.py"), ("", None), (None, None)]


def test_equal_steps_are_parsed_once(spark, monkeypatch):
    """Each distinct text of a step goes through the patterns once, nulls and empty lists included, and a range is one row for its record."""
    from trajspark.plans import scoring

    kept, whole = {}, scoring.stage
    monkeypatch.setattr(scoring, "stage", lambda df, name: kept.setdefault(name, whole(df, name)))
    view = '{"tool_calls": [{"function": {"name": "str_replace_editor", "arguments": "{\\"command\\": \\"view\\", \\"path\\": \\"a.py\\", \\"view_range\\": [1, 5]}"}}], "observation": "it failed"}'
    raw = '{"p2a_step_traces": [' + ", ".join([view, "null", '{"tool_calls": []}', view]) + "]}"
    records = spark.range(50).select(F.col("id").alias("record_index"), F.when(F.col("id") == 7, '{"p2a_step_traces": []}').otherwise(raw).alias("raw"))
    got = scoring.parse(records)
    assert kept["steps"].count() == 3
    rows = {r.record_index: ([s.family for s in r.steps], r.errors) for r in got.collect()}
    assert rows.pop(7) == ([], []) and len(rows) == 49
    assert all(r == (["read", "other", "other", "read"], [True, False, False, True]) for r in rows.values())
    reads = scoring._listed_reads(got.withColumn("map_id", F.lit("i"))).where("record_index = 1").collect()
    assert [(r.file_path, r.start_line, r.end_line, r.read, r.step, r.block, r.box, sorted(r.places)) for r in reads] == [("a.py", 1, 5, True, 0, 0, False, [0, 3])]


def test_items_are_counted_in_pieces(spark):
    """Adaptive execution merges no pieces of the count into large tasks."""
    from trajspark import catalog

    assert catalog.QUERIES["first_range_whole"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == catalog.PIECES


def test_blocks_are_made_once(spark, monkeypatch):
    """Counts and tokens read the same blocks."""
    from trajspark.operators import credit

    made, whole = [], credit.stage
    monkeypatch.setattr(credit, "stage", lambda df, name: made.append(name) or whole(df, name))
    rows = spark.createDataFrame([(1, [1.0, 1.0], [1, 1])], "record_index int, advantages array<double>, response_mask array<int>")
    spans = spark.createDataFrame([(1, 0, 0, 0, 1, 0.0, True), (1, 1, 1, 1, 2, None, True)], "record_index int, trace_idx int, block_index int, response_start int, response_end int, distance double, is_read boolean")
    got = credit.block_metrics(credit.block_factors(rows, spans), rows).first()
    assert made == ["blocks"] and tuple(got) == (2, 1, 1, 1.0, 0.5)


def test_ranges_alone_in_their_file_bring_no_classes(spark):
    """A class can be met twice only by reads of its file, so a record's only range there brings one level for each distance."""
    from trajspark.plans import scoring

    nodes = spark.createDataFrame([("i", f"n{k}", p, k % 40, k % 40 + 1, (k % 4) / 4, k % 10 > 0) for k in range(160) for p in "ab"], "instance_id string, node_key string, file_path string, start_line int, end_line int, normalized_distance double, rewardable boolean")
    chain = spark.createDataFrame([("i", f"n{k}", k == 1, k == 5) for k in range(1, 9)], "instance_id string, node_key string, is_anchor boolean, is_root boolean")
    reads = spark.createDataFrame([(1, "i", True, "a", 0, 60, True, 0, 0, False, [0], True), (1, "i", True, "b", 5, 9, True, 1, 1, False, [1], False), (1, "i", True, "b", 7, 12, True, 2, 2, False, [2], False)], "record_index int, instance_id string, has_step_reads boolean, file_path string, start_line int, end_line int, read boolean, step int, block int, box boolean, places array<int>, alone boolean")
    hits = scoring._hits(reads, scoring._range_hits(reads, nodes, chain)).cache()
    assert [len(r.levels) for r in hits.orderBy("step").collect()] == [4, 6, 6]  # no node of line 10 has a reward
    hit = lambda s, e: {k for k in range(160) if s <= k % 40 + 1 and e >= k % 40}
    b = hit(5, 9) | hit(7, 12)
    got = scoring._first_levels(hits).first()
    assert got.n_hit_nodes == len({k for k in range(160) if k % 10}) + len({k for k in b if k % 10})
    assert sum(x.n for x in got.levels if x.at == 2) == len({k for k in hit(7, 12) - hit(5, 9) if k % 10})


def test_order_scores_of_a_batch(spark, monkeypatch):
    """All lists of a batch are scored at once, a bounded number of pairs at a time."""
    import pyarrow as pa

    from trajspark.plans import scoring

    monkeypatch.setattr(scoring, "PAIRS", 10)
    lists = [[(at % 4, (7 * at + size) % 4 / 4 if at % 5 else None, at + 1) for at in range(size)] for size in (0, 1, 2, 5, 9, 30)] + [None]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("d", pa.float64()), ("n", pa.int64())]))
    rows = pa.array([x and [dict(zip(("at", "d", "n"), y, strict=True)) for y in x] for x in lists], kind)

    def score(x):
        pairs = [((a[1] > b[1]) - (a[1] < b[1]), a[2] * b[2]) for a in x or [] for b in x if a[0] < b[0] and None not in (a[1], b[1]) and a[1] != b[1]]
        return sum(s * n for s, n in pairs) / sum(n for _, n in pairs) if pairs else None

    assert scoring.order_scores(rows).to_pylist() == [score(x) for x in lists] and any(score(x) for x in lists)


def test_frames_are_made_and_walked_once(spark, monkeypatch):
    """Frames that are prepared and staged are not written once more, and anchors come of the walk itself, not of another join of all frames."""
    made, whole = [], callgraph.stage
    monkeypatch.setattr(callgraph, "stage", lambda df, name: made.append(name) or whole(df, name))
    f = spark.createDataFrame([(1, 0, 0, "a.py", 1, "make", "make", False), (1, 0, 1, "a.py", 5, "g", "g", True), (1, 1, 0, "a.py", 1, "make", "make", False)], FRAMES)
    m = spark.createDataFrame([(1, "a.py", "g", 5, 6)], "instance_id int, file_path string, qualified_name string, start_line int, end_line int")
    issues = spark.createDataFrame([(1, "It fails in `make`")], "instance_id int, issue_text string")
    p = callgraph.prepared(f)
    got = callgraph.build(p, m, issues)
    assert made == ["roots", "starts", "nodes"]
    assert {(r.node_key, r.node_role) for r in got.nodes.collect()} == {("a.py::make", "symptom"), ("a.py::g", "root_cause")}
    roots = spark.createDataFrame([(1, "a.py::g")], "instance_id int, node_key string")
    starts = callgraph.reward_starts(p, roots, issues).localCheckpoint()
    plan = callgraph.node_table(p, starts, roots)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_edges_are_made_in_pieces(spark):
    """A task holds one of many pieces of the edges, whatever the session's number of partitions, and steps are sorted once."""
    from trajspark.catalog import QUERIES
    from trajspark.operators import graphs
    from trajspark.plans.testdata import PIECES, Tables

    assert Tables(spark, "/root/testdata/sf0.001").all_edges().rdd.getNumPartitions() == PIECES
    plan = QUERIES["node_roles_whole"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip("+-: ").startswith("Window") for line in plan.splitlines()) == 1
    edges = spark.createDataFrame([("i", 1, 2), ("j", 2, 1)], "instance_id string, caller int, callee int")
    everywhere = spark.createDataFrame([(1, "symptom"), (2, "test_harness")], "node_key int, node_role string")
    by_instance = everywhere.crossJoin(edges.select("instance_id")).select("instance_id", "node_key", "node_role")
    want = {("i", 1, 2, "symptom", "test_harness", "symptom->test_harness", True), ("j", 2, 1, "test_harness", "symptom", "test_harness->symptom", False)}
    assert {tuple(r) for r in graphs.edge_roles(edges, everywhere).collect()} == {tuple(r) for r in graphs.edge_roles(edges, by_instance).collect()} == want


def test_steps_are_gathered_where_they_are_sorted(spark, monkeypatch):
    """Neither making nor parsing of records groups its steps by an aggregate of arrays; signatures are 128 bits."""
    from trajspark import catalog
    from trajspark.plans import scoring
    from trajspark.plans.testdata import Tables

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    made = catalog._rollouts(Tables(spark, "/root/testdata/sf0.001"))
    assert "collect_list" in plan(made) and "Aggregate" not in plan(made)
    monkeypatch.setattr(scoring, "stage", lambda df, name: df.localCheckpoint())
    texts = ['{"tool_calls": []}', None, "plain"]
    opened = spark.createDataFrame([(1, None, "d", None, texts, []), (2, None, "d", None, [], []), (3, None, "d", None, texts[::-1], [])], "record_index int, instance_id string, data_source string, run_step long, texts array<string>, box_reads array<struct<file_path:string,start_line:int,end_line:int>>")
    got = scoring.with_steps(opened)
    assert "Aggregate" not in plan(got)
    rows = {r.record_index: r for r in got.collect()}
    assert [len(rows[i].steps) for i in (1, 2, 3)] == [len(rows[i].errors) for i in (1, 2, 3)] == [3, 0, 3]
    assert rows[1].steps == rows[3].steps[::-1] and [s.is_object for s in rows[1].steps] == [True, False, False]
    assert all(len(s.signature) == 16 for s in rows[1].steps)
