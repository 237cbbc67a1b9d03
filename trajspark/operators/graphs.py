"""Call graphs from fault traces: edges, hops, reachability, terminal components, chains.

Graphs are many and small, one for each instance; all operators work on all of them at once, keyed by ``instance_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import shared_folder, stage

KEY = "instance_id"
#: An instance with more edges is not settled inside one task.
GROUP_EDGES = 1_000_000


def call_edges(frames: DataFrame) -> DataFrame:
    """Distinct (instance_id, caller, callee) of consecutive frames up to the last patched frame of each trace, without loops.

    ``frames``: instance_id, trace_idx, frame_idx (outer to inner), node_key, is_patched.
    """
    trace = W.partitionBy(KEY, "trace_idx")
    df = frames.withColumn("last", F.max(F.when(F.col("is_patched"), F.col("frame_idx"))).over(trace)).withColumn("callee", F.lead("node_key").over(trace.orderBy("frame_idx")))
    return df.where("frame_idx < last and callee <> node_key").select(KEY, F.col("node_key").alias("caller"), "callee").distinct()


def hop_distances(frames: DataFrame, roots: DataFrame) -> DataFrame:
    """(instance_id, node_key, hop): least number of frames from a node to the first occurrence of a root behind it."""
    first = frames.join(roots.select(KEY, "node_key"), [KEY, "node_key"], "left_semi").groupBy(KEY, "trace_idx", F.col("node_key").alias("root")).agg(F.min("frame_idx").alias("root_idx"))
    return frames.join(first, [KEY, "trace_idx"]).where("frame_idx <= root_idx").groupBy(KEY, "node_key").agg(F.min(F.col("root_idx") - F.col("frame_idx")).alias("hop"))


def normalized_distances(hops: DataFrame) -> DataFrame:
    """``hops`` (instance_id, node_key, hop, rewardable) with normalized_distance: hop over the greatest rewardable hop, 1 at most and for other nodes."""
    top = F.greatest(F.max(F.when(F.col("rewardable"), F.col("hop"))).over(W.partitionBy(KEY)), F.lit(1))
    df = hops.withColumn("hop_max", F.coalesce(top, F.lit(1)))
    return df.withColumn("normalized_distance", F.when(F.col("rewardable"), F.least("hop", "hop_max") / F.col("hop_max")).otherwise(1.0))


def _large(edges: DataFrame, limit: int) -> DataFrame | None:
    """Instances with more edges than one task should hold; None if there are none."""
    big = edges.groupBy(KEY).count().where(f"count > {limit}").select(KEY)
    return None if big.isEmpty() else stage(big, "large")


def _split(edges: DataFrame, others: DataFrame, limit: int, small, large) -> DataFrame:
    """``small`` of the instances that fit into a task each, and ``large`` of the others, by rounds over all of them."""
    big = _large(edges, limit)
    if big is None:
        return small(edges, others)
    part = lambda how: [df.join(big, KEY, how) for df in (edges, others)]
    return small(*part("left_anti")).unionByName(large(*part("left_semi")))


def _by_instance(edges: DataFrame, nodes: DataFrame, settle: Callable[[list, list], Iterable[tuple]], shape: str) -> DataFrame:
    """Rows (instance_id, *row) for each row of ``settle(edges, nodes)`` of each instance. ``edges``: instance_id, a, b; ``nodes``: instance_id, a.

    Instances are many and small: a task streams over its own, sorted, and holds one at a time.
    """
    rows = edges.select(KEY, F.col(edges.columns[1]).alias("a"), F.col(edges.columns[2]).alias("b"), F.lit(True).alias("edge"))
    none = F.lit(None).cast(rows.schema["b"].dataType)
    rows = rows.unionAll(nodes.select(KEY, F.col(nodes.columns[1]).cast(rows.schema["a"].dataType), none, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ways, own = (), [], []
        kinds = None

        def settled(out: list[tuple]) -> None:
            if now:
                out += [(now[0], *row) for row in settle(ways, own)]

        def given(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * (1 + len(names))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [kinds[0]] + [kinds[1]] * len(names), strict=True)], names=[KEY, *names])

        for batch in batches:
            kinds = batch.schema.types
            out: list[tuple] = []
            for key, a, b, edge in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not now or key != now[0]:
                    settled(out)
                    now, ways, own = (key,), [], []
                if edge:
                    ways.append((a, b))
                else:
                    own.append(a)
            yield given(out)
        if now:
            out = []
            settled(out)
            yield given(out)

    names = [c.split()[0] for c in shape.split(", ")[1:]]
    return rows.repartition(KEY).sortWithinPartitions(KEY).mapInArrow(run, shape)


def reachable(edges: DataFrame, starts: DataFrame, *, forward: bool = True, limit: int = GROUP_EDGES) -> DataFrame:
    """(instance_id, node_key) that can be reached from ``starts``, those included; backwards against the edges.

    Each instance is settled inside its own group; one with more than ``limit`` edges by rounds over distributed tables.
    """
    src, dst = ("caller", "callee") if forward else ("callee", "caller")
    e = stage(edges.select(KEY, F.col(src).alias("node_key"), F.col(dst).alias("next")).distinct(), "edges")
    s = starts.select(KEY, "node_key").distinct()
    shape = f"{KEY} {s.schema[KEY].dataType.simpleString()}, node_key {s.schema['node_key'].dataType.simpleString()}"

    def spread(ways: list, begun: list) -> Iterable[tuple]:
        out: dict = {}
        for a, b in ways:
            out.setdefault(a, []).append(b)
        seen = set(begun)
        todo = list(seen)
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return [(n,) for n in seen]

    def small(e: DataFrame, s: DataFrame) -> DataFrame:
        return _by_instance(e, s, spread, shape)

    return _split(e, s, limit, small, _by_rounds)


def _by_rounds(e: DataFrame, starts: DataFrame) -> DataFrame:
    """Only what the last round has added is followed, as long as there is any. Each round cuts its lineage by a reliable checkpoint."""
    seen = new = _cut(starts)
    while True:
        new = _cut(new.join(e, [KEY, "node_key"]).select(KEY, F.col("next").alias("node_key")).distinct().join(seen, [KEY, "node_key"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = _cut(seen.unionByName(new))


def _cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: A round of shrinking is worth another while it takes away such a share of the edges.
SHRINKS = 0.05


def components(nodes: DataFrame, edges: DataFrame, *, limit: int = GROUP_EDGES) -> DataFrame:
    """(instance_id, node_key, component) of every node: strongly connected components, each named by its least node.

    Edges at nodes that aren't listed, and loops, tie nothing. Each instance is settled inside its own group, in linear time; one with
    more than ``limit`` edges is shrunk first, by rounds over distributed tables (``_shrunk``), and if that leaves a dense core, the
    core is settled by colours. No table of pairs is made.
    """
    n = nodes.select(KEY, "node_key").distinct()
    e = edges.where("caller <> callee").select(KEY, "caller", "callee").distinct()
    e = stage(e.join(n.withColumnRenamed("node_key", "caller"), [KEY, "caller"], "left_semi").join(n.withColumnRenamed("node_key", "callee"), [KEY, "callee"], "left_semi"), "edges")
    tied = _split(e, n, limit, lambda e, n: _settled(e), lambda e, n: _shrunk(e, limit))
    return n.join(tied, [KEY, "node_key"], "left").withColumn("component", F.coalesce("component", "node_key"))


def _settled(edges: DataFrame) -> DataFrame:
    """(instance_id, node_key, component) of the nodes of edges, one group for each instance."""
    key, node = edges.schema[KEY].dataType.simpleString(), edges.schema["caller"].dataType.simpleString()

    def settle(ways: list, own: list) -> Iterable[tuple]:
        part = parts([], ways)
        least: dict = {}
        for node, p in part.items():
            least[p] = min(node, least.get(p, node))
        return [(node, least[p]) for node, p in part.items()]

    return _by_instance(edges.select(KEY, "caller", "callee"), edges.select(KEY, "caller").limit(0), settle, f"{KEY} {key}, node_key {node}, component {node}")


def _shrunk(edges: DataFrame, limit: int) -> DataFrame:
    """Components of large instances. Nodes without a way in or out are alone; a node with one way out is passed by, again and again, in both directions by turns.

    To pass a node by is to lead its ways in on to its one target. Components of the others stay as they are, and the node is in its
    target's if one of the nodes before it is; so, when the rest is settled, nodes get theirs in the order opposite to that in which
    they went. Of neighbours that could both go, hashes that change with the round choose; a row of nodes loses a third in a round.
    """
    now, steps, size, turn = _cut(edges), [], None, 0
    while True:
        now = _cut(now.join(now.select(KEY, F.col("caller").alias("callee")).distinct(), [KEY, "callee"], "left_semi").join(now.select(KEY, F.col("callee").alias("caller")).distinct(), [KEY, "caller"], "left_semi"))
        n = now.count()
        if not n or _large(now, limit) is None:
            tied = _settled(now)
            break
        if turn % 2 == 0:
            if size is not None and n > size * (1 - SHRINKS):
                tied = _by_colour(now)
                break
            size = n
        ways = ("caller", "callee") if turn % 2 == 0 else ("callee", "caller")
        e = now.select(KEY, F.col(ways[0]).alias("a"), F.col(ways[1]).alias("b"))
        one = e.groupBy(KEY, "a").agg(F.count("*").alias("n"), F.min("b").alias("to")).where("n = 1").select(KEY, F.col("a").alias("v"), "to")
        rank = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: B023, E731
        free = one.select(KEY, F.col("v").alias("to"), F.lit(True).alias("also"))
        able = _cut(one.join(free, [KEY, "to"], "left").where(F.col("also").isNull() | (rank("v") < rank("to")) | (rank("v") == rank("to")) & (F.col("v") < F.col("to"))).select(KEY, "v", "to"))
        gone = _cut(able.join(able.select(KEY, F.col("v").alias("to")), [KEY, "to"], "left_anti"))
        steps.append(_cut(gone.join(e.select(KEY, F.col("b").alias("v"), F.col("a").alias("before")), [KEY, "v"])))
        led = e.join(gone.select(KEY, F.col("v").alias("a")), [KEY, "a"], "left_anti").join(gone.select(KEY, F.col("v").alias("b"), "to"), [KEY, "b"], "left")
        now = led.select(KEY, F.col("a").alias(ways[0]), F.coalesce("to", "b").alias(ways[1])).where("caller <> callee").distinct()
        turn += 1
    tied = _cut(tied)
    for step in reversed(steps):
        of = lambda c: tied.select(KEY, F.col("node_key").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: B023, E731
        met = step.join(of("before"), [KEY, "before"], "left").join(of("to"), [KEY, "to"], "left")
        target = F.coalesce("of_to", "to")
        found = met.where(F.coalesce("of_before", "before") == target).select(KEY, F.col("v").alias("node_key"), target.alias("component")).distinct()
        # A target that was alone until now is named by itself.
        heads = found.join(tied, [KEY, "node_key"], "left_anti").select(KEY, F.col("component").alias("node_key")).distinct().join(tied.select(KEY, "node_key"), [KEY, "node_key"], "left_anti").withColumn("component", F.col("node_key"))
        tied = _cut(tied.unionByName(found).unionByName(heads))
    least = tied.groupBy(KEY, "component").agg(F.min("node_key").alias("least"))
    return tied.join(least, [KEY, "component"]).select(KEY, "node_key", F.col("least").alias("component"))


def _by_colour(edges: DataFrame) -> DataFrame:
    """Components by colours: each node takes the greatest name that leads to it; what of a colour leads back to its name is a component, the rest goes on."""
    found = None
    while not edges.isEmpty():
        colour = _cut(edges.select(KEY, F.explode(F.array("caller", "callee")).alias("node_key")).distinct().withColumn("colour", F.col("node_key")))
        while True:
            seen = edges.join(colour.withColumnRenamed("node_key", "caller"), [KEY, "caller"]).groupBy(KEY, F.col("callee").alias("node_key")).agg(F.max("colour").alias("new"))
            then = _cut(colour.join(seen, [KEY, "node_key"], "left").select(KEY, "node_key", F.greatest("colour", "new").alias("colour"), F.coalesce(F.col("new") > F.col("colour"), F.lit(False)).alias("changed")))
            colour = then.drop("changed")
            if then.where("changed").isEmpty():
                break
        same = edges.join(colour.withColumnRenamed("node_key", "caller"), [KEY, "caller"]).join(colour.select(KEY, F.col("node_key").alias("callee"), F.col("colour").alias("_c")), [KEY, "callee"]).where("colour = _c").select(KEY, "caller", "callee")
        back = _cut(same.select(KEY, F.col("callee").alias("node_key"), F.col("caller").alias("next")))
        reached = _by_rounds(back, colour.where("node_key = colour").select(KEY, "node_key"))
        own = reached.join(colour, [KEY, "node_key"]).select(KEY, "node_key", F.col("colour").alias("component"))
        found = own if found is None else found.unionByName(own)
        left = lambda c: reached.withColumnRenamed("node_key", c)  # noqa: B023, E731
        edges = _cut(same.join(left("caller"), [KEY, "caller"], "left_anti").join(left("callee"), [KEY, "callee"], "left_anti"))
    return found


def terminal_nodes(nodes: DataFrame, edges: DataFrame, *, limit: int = GROUP_EDGES) -> DataFrame:
    """Nodes of the components that lead to no other: all that a node reaches also reaches it.

    Each instance is settled inside its own group, in linear time; one with more than ``limit`` edges by its components.
    """
    n = nodes.select(KEY, "node_key").distinct()
    e = stage(edges.select(KEY, "caller", "callee").distinct(), "edges")
    shape = f"{KEY} {n.schema[KEY].dataType.simpleString()}, node_key {n.schema['node_key'].dataType.simpleString()}"

    def small(e: DataFrame, n: DataFrame) -> DataFrame:
        return _by_instance(e, n, lambda ways, own: [(x,) for x in sinks(own, ways)], shape)

    return _split(e, n, limit, small, lambda e, n: _by_components(e, n, limit))


def sinks(nodes: list, edges: Iterable[tuple]) -> list:
    """Those of ``nodes`` from which every way leads back: components that no edge leaves."""
    edges = list(edges)
    part = parts(nodes, edges)
    left = {part[a] for a, b in edges if part[a] != part[b]}
    return [n for n in nodes if part[n] not in left]


def parts(nodes: list, edges: Iterable[tuple]) -> dict:
    """A member of its strongly connected component for each node, of those of edges too.

    Components are taken along reversed edges, in the order in which a depth-first search finishes last.
    """
    out: dict = {n: [] for n in nodes}
    back: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
        back.setdefault(b, []).append(a)
    finished, seen = [], set()
    for start in out:
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(out[start]))]
        while stack:
            node, ways = stack[-1]
            step = next((w for w in ways if w not in seen), None)
            if step is None:
                finished.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(out[step])))
    part: dict = {}
    for start in reversed(finished):
        todo = [] if start in part else [start]
        while todo:
            node = todo.pop()
            if node not in part:
                part[node] = start
                todo += [b for b in back.get(node, ()) if b not in part]
    return part


def _by_components(edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Nodes of components that no edge leaves. An edge to a node that isn't listed leaves its component, too."""
    every = edges.select(KEY, F.explode(F.array("caller", "callee")).alias("node_key")).unionByName(nodes).distinct()
    of = stage(components(every, edges, limit=limit), "components")
    end = lambda c: of.select(KEY, F.col("node_key").alias(c), F.col("component").alias(f"of_{c}"))
    left = edges.join(end("caller"), [KEY, "caller"]).join(end("callee"), [KEY, "callee"]).where("of_caller <> of_callee").select(KEY, F.col("of_caller").alias("component")).distinct()
    return of.join(left, [KEY, "component"], "left_anti").join(nodes, [KEY, "node_key"], "left_semi").select(KEY, "node_key")


def edge_roles(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """``edges`` with the roles of both ends and the transition between them.

    ``roles``: instance_id, node_key, node_role; without instance_id where a node has one role in all instances.
    """
    keys = [c for c in roles.columns if c == KEY]
    of = lambda end: roles.select(*keys, F.col("node_key").alias(end), F.col("node_role").alias(f"{end}_role"))
    out = edges.join(of("caller"), [*keys, "caller"]).join(of("callee"), [*keys, "callee"]).select(KEY, "caller", "callee", *[c for c in edges.columns if c not in (KEY, "caller", "callee")], "caller_role", "callee_role")
    return out.withColumn("role_transition", F.concat_ws("->", "caller_role", "callee_role")).withColumn("reward_path_edge", ~F.col("caller_role").isin("test_harness", "pre_symptom"))


def chain(edges: DataFrame, anchors: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges on some path from an anchor to a root: both ends are reached from an anchor and reach a root."""
    inside = reachable(edges, anchors).join(reachable(edges, roots, forward=False), [KEY, "node_key"], "left_semi")
    return edges.join(inside.withColumnRenamed("node_key", "caller"), [KEY, "caller"], "left_semi").join(inside.withColumnRenamed("node_key", "callee"), [KEY, "callee"], "left_semi")


def _signature(frames: str, times: int) -> Column:
    """A bit for each frame that stands at least so often in a trace: what a longer trace has to have, too."""
    often = F.array_distinct(F.filter(frames, lambda x: F.size(F.filter(frames, lambda y: y == x)) >= times)) if times > 1 else F.array_distinct(frames)
    return F.aggregate(often, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def maximal_traces(traces: DataFrame) -> DataFrame:
    """Distinct traces (instance_id, frames array) of which none is a subsequence of a longer one of its instance.

    A trace is looked for where the rarest of its frames stands: in the traces of its instance with that frame, of which only
    those are gone through that are longer and have all its frames by two 64-bit signatures (frames; frames that stand twice).
    Frames that all traces share, such as the patched function at the end, bring nothing together. A trace without frames is
    part of any other; nulls in frames equal nothing.
    """
    d = stage(traces.select(KEY, "frames").distinct().withColumns({"size": F.size("frames"), "once": _signature("frames", 1), "twice": _signature("frames", 2), "id": F.xxhash64(KEY, "frames")}), "traces")
    at = d.select(KEY, "id", "size", "once", "twice", F.explode(F.array_distinct("frames")).alias("f")).where("f is not null")
    common = at.groupBy(KEY, "f").agg(F.count("*").alias("n"))
    rarest = at.join(common, [KEY, "f"]).groupBy(KEY, "id", "size", "once", "twice").agg(F.min_by("f", F.struct("n", "f")).alias("f"))
    short, long = (x.select(KEY, "f", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "size", "once", "twice")]) for x, s in ((rarest, "a"), (at, "b")))
    met = short.join(long, [KEY, "f"]).where("a_size < b_size and (a_once & ~b_once) = 0 and (a_twice & ~b_twice) = 0").select(KEY, "a_id", "b_id")
    # Only pairs that may be carry their frames.
    of = lambda s: d.select(KEY, F.col("id").alias(f"{s}_id"), F.col("frames").alias(s))
    inside = F.expr("aggregate(b, 0, (i, x) -> if(i < size(a) and get(a, i) = x, i + 1, i)) = size(a)")
    dropped = met.join(of("a"), [KEY, "a_id"]).join(of("b"), [KEY, "b_id"]).where(inside).select(KEY, F.col("a").alias("frames")).distinct()
    longer = d.groupBy(KEY).agg(F.max("size").alias("most"))
    empty = d.where("size = 0").join(longer.where("most > 0").select(KEY), KEY, "left_semi").select(KEY, "frames")
    return d.select(KEY, "frames").join(dropped.unionByName(empty), [KEY, "frames"], "left_anti")
