"""The driver's star-schema tables seen as records, steps, reads, nodes and frames; each view also as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
#: Pieces in which large tables are worked on. Up to 200, writers of pieces hold no rows (spark.shuffle.sort.bypassMergeThreshold).
PIECES = 200


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def records(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
        return self.orders.select(F.col("o_orderkey").alias("record_index"), F.col("o_orderpriority").alias("model_label"), F.col("o_orderpriority").alias("data_source"), F.month("o_orderdate").alias("run_step"), status.alias("status"), F.col("o_totalprice").alias("price"))

    def steps(self) -> DataFrame:
        family = F.when(F.col("l_returnflag") == "R", "read").when(F.col("l_returnflag") == "A", "edit").otherwise("exec")
        return self.lineitem.withColumn("trace_idx", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*STEP_ORDER)) - 1).select(F.col("l_orderkey").alias("record_index"), "trace_idx", family.alias("family"), F.col("l_linestatus").alias("target"), F.col("l_linestatus").alias("signature"), "l_partkey", "l_suppkey", "l_quantity", "l_discount")

    def reads(self) -> DataFrame:
        start = F.col("l_quantity").cast("int")
        r = self.steps().where("family = 'read'").join(self.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        return r.select("record_index", F.lit("i").alias("instance_id"), "trace_idx", F.col("p_brand").alias("file_path"), start.alias("start_line"), (start + F.round(F.col("l_discount") * 100).cast("int")).alias("end_line"))

    def nodes(self) -> DataFrame:
        d = (F.col("p_size") % 5) / 4.0
        return self.part.select(F.lit("i").alias("instance_id"), F.col("p_partkey").alias("node_key"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"), d.alias("normalized_distance"), (F.col("p_size") % 7 != 0).alias("rewardable"))

    def frames(self) -> DataFrame:
        return self.steps().select(F.lit("g").alias("instance_id"), F.col("record_index").alias("trace_idx"), F.col("trace_idx").alias("frame_idx"), F.col("l_suppkey").alias("node_key"), (F.col("l_suppkey") % 10 == 0).alias("is_patched"))

    def owned_frames(self) -> DataFrame:
        """All frames with their real node keys; an instance is the customer of the order."""
        owner = self.orders.select(F.col("o_orderkey").alias("trace_idx"), F.col("o_custkey").alias("instance_id"))
        return self.frames().drop("instance_id").join(owner, "trace_idx")

    def all_edges(self) -> DataFrame:
        """Every pair of neighbouring steps of every order, by instance; loops too.

        Steps are sorted once. The number of pieces is fixed, as a task's memory is that of its piece.
        """
        order = W.partitionBy("l_orderkey").orderBy(*STEP_ORDER)
        steps = self.lineitem.select("l_orderkey", *STEP_ORDER).repartition(PIECES, "l_orderkey")
        e = steps.select("l_orderkey", F.col("l_suppkey").alias("caller"), F.lead("l_suppkey").over(order).alias("callee")).where("callee is not null")
        owner = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("instance_id"))
        return e.join(owner, "l_orderkey").select("instance_id", "caller", "callee").repartition(PIECES, "instance_id").distinct()



SQL = {
    "records": "records AS (SELECT o_orderkey AS record_index, o_orderpriority AS model_label, o_orderpriority AS data_source, month(o_orderdate)::INT AS run_step, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'error' END AS status, o_totalprice AS price FROM orders)",
    "steps": f"steps AS (SELECT l_orderkey AS record_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(STEP_ORDER)}) - 1 AS trace_idx, CASE l_returnflag WHEN 'R' THEN 'read' WHEN 'A' THEN 'edit' ELSE 'exec' END AS family, l_linestatus AS target, l_linestatus AS signature, l_partkey, l_suppkey, l_quantity, l_discount FROM lineitem)",
    "reads": "reads AS (SELECT record_index, trace_idx, p_brand AS file_path, trunc(l_quantity)::INT AS start_line, trunc(l_quantity)::INT + round(l_discount * 100)::INT AS end_line FROM steps JOIN part ON l_partkey = p_partkey WHERE family = 'read')",
    "nodes": "nodes AS (SELECT p_partkey AS node_key, p_brand AS file_path, p_size AS node_start, p_size + 10 AS node_end, (p_size % 5) / 4.0 AS d, p_size % 7 <> 0 AS rewardable FROM part)",
    "frames": "frames AS (SELECT record_index AS trace_idx, trace_idx AS frame_idx, l_suppkey AS node_key, l_suppkey % 10 = 0 AS is_patched FROM steps)",
    "details": "details AS (SELECT r.record_index, r.data_source, r.model_label, r.run_step, coalesce(min(d), -1.0) AS min_distance, count(DISTINCT q.trace_idx) AS n_reads FROM records r LEFT JOIN reads q USING (record_index) LEFT JOIN nodes n ON n.file_path = q.file_path AND rewardable AND start_line <= node_end AND end_line >= node_start GROUP BY ALL)",
    "hits": "hits AS (SELECT record_index, node_key, min(d) AS d, min(trace_idx) AS trace_idx FROM reads q JOIN nodes n ON n.file_path = q.file_path AND rewardable AND start_line <= node_end AND end_line >= node_start GROUP BY ALL)",
    "blocks": "flagged AS (SELECT *, CASE WHEN family IS NOT DISTINCT FROM lag(family) OVER w AND target IS NOT DISTINCT FROM lag(target) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM steps WINDOW w AS (PARTITION BY record_index ORDER BY trace_idx)), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY record_index ORDER BY trace_idx) - 1 AS block_index FROM flagged), blocks AS (SELECT record_index, block_index::BIGINT AS block_index, family, target, count(*) AS n_steps, min(trace_idx)::INT AS first_step, max(trace_idx)::INT AS last_step, count(*) >= 3 AND count(DISTINCT signature) = 1 AS is_loop FROM numbered GROUP BY ALL)",
    "lead_frames": "lead_frames AS (SELECT *, lead(node_key) OVER (PARTITION BY trace_idx ORDER BY frame_idx) AS callee, max(CASE WHEN is_patched THEN frame_idx END) OVER (PARTITION BY trace_idx) AS last FROM frames)",
    "all_edges": "owned AS (SELECT o_custkey AS instance_id, f.*, lead(node_key) OVER (PARTITION BY trace_idx ORDER BY frame_idx) AS callee FROM frames f JOIN orders ON trace_idx = o_orderkey), all_edges AS (SELECT DISTINCT instance_id, node_key AS caller, callee FROM owned WHERE callee IS NOT NULL)",
}


def sql(*views: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[v] for v in views) + "\n" + body
