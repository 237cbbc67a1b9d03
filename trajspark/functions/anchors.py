"""What an issue's text points at, and how well a stack frame matches it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.staging import stage

#: Names too common to point at anything by themselves.
GENERIC = "__call__ __new__ call delete dispatch func function get handle head inner main method options patch post put run setup teardown test view wrapper".split()
#: Kinds of anchors in the order in which they are looked for, each with its pattern; a traceback names a path and a function.
TRACEBACK = r'(?U)File "([^"\n]+\.py)", line \d+, in ([A-Za-z_]\w*|<[^>]+>)'
KINDS = {
    "backtick": (r"`([^`\n]{1,200})`", 1),
    "file_path": (r"(?U)(?<![\w/.-])(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.py(?::\d+)?", 0),
    "dotted_name": (r"(?U)(?<![\w.])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)(?![\w.])", 1),
    "call": (r"(?U)(?<![\w.])([A-Za-z_]\w*)\s*\(", 1),
}


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def anchor_path(path: Column) -> Column:
    """A path with forward slashes, without quotes, fragment, line number and leading dots and slashes."""
    p = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"(?U)^\s+|\s+$", ""), r"^[\"']+|[\"']+$", "")
    cleaned = F.regexp_replace(F.regexp_replace(F.substring_index(p, "#", 1), r":\d+(?::\d+)?$", ""), r"^[./]+", "")
    # A path of these characters has nothing to clean.
    return F.when(path.rlike(r"\A[A-Za-z0-9_][A-Za-z0-9_./-]*\z"), path).otherwise(cleaned)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"\(\)$", "")


def _cleaned(raw: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), r"^[`\"']+|[`\"']+$", "")
    return _bare(F.regexp_replace(v, r"^[ \t\r\n.,;:)\]}]+|[ \t\r\n.,;:)\]}]+$", ""))


def leaf(name: Column) -> Column:
    """The last part of a dotted name, of what is behind its last double colon."""
    return F.substring_index(F.substring_index(_bare(name), "::", -1), ".", -1)


def is_generic(name: Column) -> Column:
    return F.lower(name).isin(*GENERIC)


def candidates(issues: DataFrame, text: str = "issue_text") -> DataFrame:
    """(instance_id, kind, raw, value, file_path, qualified_name, name, place) of the mentions in each issue's text that can be an anchor.

    Of mentions with equal kind, path, qualified name and name the first counts; ``place`` numbers them in the order of kinds.
    Names that are too common or too short don't count unless a path or a dotted name stands with them. A null or blank text
    has none.
    """
    t = F.coalesce(text, F.lit(""))
    none = F.lit(None).cast("string")
    pair = F.arrays_zip(F.regexp_extract_all(t, F.lit(TRACEBACK), F.lit(1)).alias("p"), F.regexp_extract_all(t, F.lit(TRACEBACK), F.lit(2)).alias("f"))
    frames = F.transform(F.filter(pair, lambda x: ~x["f"].startswith("<")), lambda x: F.struct(F.lit("traceback_frame").alias("kind"), F.concat(anchor_path(x["p"]), F.lit("::"), x["f"]).alias("raw"), anchor_path(x["p"]).alias("p"), x["f"].alias("q")))
    others = [F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(g)), _mention(kind, none)) for kind, (p, g) in KINDS.items()]
    rows = issues.select("instance_id", F.posexplode(F.concat(frames, *others)).alias("place", "m")).select("instance_id", "place", "m.*").withColumn("value", _cleaned(F.col("raw")))
    rows = rows.where((F.col("value") != "") & ~F.col("value").rlike(r"(?U)\s"))
    v, given = F.col("value"), F.col("q").isNotNull()
    split, pathlike, dotted = v.contains("::") & ~given, v.contains(".py") | v.contains("/"), v.contains(".")
    left, right = F.substring_index(v, "::", 1), F.regexp_extract(v, r"(?s)^.*?::(.*)$", 1)
    path = F.when(F.col("p").isNotNull(), F.col("p")).when(split, F.when(left.contains(".py") | left.contains("/"), anchor_path(left))).when(pathlike, anchor_path(v))
    rows = rows.withColumn("file_path", _none_if_empty(path))
    qualified = F.when(given, _bare(F.col("q"))).when(split, _bare(right)).when(~pathlike & dotted, _bare(v))
    rows = rows.withColumn("qualified_name", _none_if_empty(qualified))
    name = F.when(F.col("qualified_name").isNotNull(), leaf(F.col("qualified_name"))).when(F.col("file_path").isNull() & ~split, _bare(v))
    rows = rows.withColumn("name", _none_if_empty(name))
    alone = F.col("file_path").isNull() & ~F.coalesce(F.col("qualified_name").contains("."), F.lit(False))
    weak = (is_generic(F.col("name")) & alone) | ((F.length("name") < 3) & ~F.col("name").startswith("__"))
    rows = rows.where(~F.coalesce(weak, F.lit(False)))
    first = F.min_by(F.struct("raw", "value", "place"), "place").alias("m")
    return rows.groupBy("instance_id", "kind", "file_path", "qualified_name", "name").agg(first).select("instance_id", "kind", "m.raw", "m.value", "file_path", "qualified_name", "name", "m.place")


def _mention(kind: str, none: Column):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("raw"), none.alias("p"), none.alias("q"))


def issue_anchors(issues: DataFrame, text: str = "issue_text") -> DataFrame:
    """(instance_id, kind, value, file_path, qualified_name, name): the candidates, without their places."""
    return candidates(issues, text).drop("raw", "place")


def plain_qualname(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit(".<locals>."), F.lit(".")), F.lit("<locals>."), F.lit(""))


def _ends(whole: Column, part: Column, sign: str) -> Column:
    return (whole == part) | F.endswith(whole, F.concat(F.lit(sign), part))


def name_matches(qualified: Column, name: Column) -> Column:
    """Whether a frame's own name is the given one, or for a name that isn't common that name with ``_value`` or ``_values``."""
    return _named(F.substring_index(plain_qualname(qualified), ".", -1), name, is_generic(name))


def _named(own: Column, name: Column, generic: Column) -> Column:
    return (own == name) | (~generic & own.isin(F.concat(name, F.lit("_value")), F.concat(name, F.lit("_values"))))


def _frame_side(path: Column, qualified: Column) -> dict[str, Column]:
    """What a score needs of a frame."""
    plain = plain_qualname(qualified)
    return {"f_path": anchor_path(path), "f_name": plain, "f_own": F.substring_index(plain, ".", -1)}


def _anchor_side(path: Column, qualified: Column, name: Column) -> dict[str, Column]:
    """What a score needs of a candidate."""
    last = leaf(qualified)
    is_class = F.substring(last, 1, 1) != F.lower(F.substring(last, 1, 1))
    return {"c_path": anchor_path(path), "c_name": plain_qualname(_bare(qualified)), "c_last": last, "c_class": is_class, "c_common_last": is_generic(last), "c_own": name, "c_common_own": is_generic(name)}


def _score(s: dict[str, Column]) -> Column:
    same_path = _ends(s["f_path"], s["c_path"], "/") | F.endswith(s["c_path"], F.concat(F.lit("/"), s["f_path"]))
    same_name = _ends(s["f_name"], s["c_name"], ".")
    dotted = lambda c: F.concat(F.lit("."), c, F.lit("."))
    same_class = s["c_class"] & F.contains(dotted(s["f_name"]), dotted(s["c_last"]))
    same_leaf = ~s["c_common_last"] & _named(s["f_own"], s["c_last"], s["c_common_last"])
    own = _named(s["f_own"], s["c_own"], s["c_common_own"])
    # The scores.
    with_path = F.when(~same_path, None).when(s["c_name"].isNotNull(), F.when(same_name, 100)).when(s["c_own"].isNotNull(), F.when(own, 80)).when(s["c_path"].contains("/"), 30)
    without = F.when(s["c_name"].isNotNull(), F.when(same_name, 90).when(same_class, 70).when(same_leaf, 60)).when(s["c_own"].isNotNull(), F.when(own, 50))
    return F.when(s["c_path"].isNotNull(), with_path).otherwise(without)


def match_score(path: Column, qualified: Column, c_path: Column, c_qualified: Column, c_name: Column) -> Column:
    """Score of a frame under a candidate; null without a match.

    With a path: 100 path and qualified name, 80 path and name, 30 the path alone, which has to have a folder. Without: 90 the
    end of the qualified name, 70 a class on it, 60 its last part, 50 the name.
    """
    return _score(_frame_side(path, qualified) | _anchor_side(c_path, c_qualified, c_name))


def scored_pairs(frames: DataFrame, anchors: DataFrame) -> DataFrame:
    """Frames (instance_id, path, own) with the anchors of their instance that match them, and the ``score``.

    Names are taken apart once for each frame and each anchor, not for each pair; both are staged, so that the code of the pairs stays small.
    """
    sides = _frame_side(F.col("path"), F.col("own")), _anchor_side(F.col("file_path"), F.col("qualified_name"), F.col("name"))
    f = stage(frames.select("instance_id", "path", "own").distinct().withColumns(sides[0]), "frames")
    a = stage(anchors.withColumns(sides[1]), "anchors")
    names = [*sides[0], *sides[1]]
    return f.join(a, "instance_id").withColumn("score", _score({n: F.col(n) for n in names})).where("score is not null").drop(*names)


def frame_scores(frames: DataFrame, anchors: DataFrame) -> DataFrame:
    """(instance_id, file_path, qualified_name, score): the best score of each distinct frame of an instance under its anchors."""
    f = frames.select("instance_id", F.coalesce("file_path", F.lit("")).alias("path"), F.coalesce(_none_if_empty(F.col("qualified_name")), "func_name", F.lit("")).alias("own"))
    return scored_pairs(f, anchors.select("instance_id", "file_path", "qualified_name", "name").distinct()).groupBy("instance_id", "path", "own").agg(F.max("score").alias("score"))


def select_anchors(frames: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each trace the frame with the best score, the deepest of equals. ``frames`` have no test files and end at the root."""
    own = frames.withColumn("path", F.coalesce("file_path", F.lit(""))).withColumn("own", F.coalesce(_none_if_empty(F.col("qualified_name")), "func_name", F.lit("")))
    scored = own.join(frame_scores(frames, anchors), ["instance_id", "path", "own"]).drop("path", "own")
    best = scored.withColumn("_n", F.row_number().over(W.partitionBy("instance_id", "trace_idx").orderBy(F.desc("score"), F.desc("frame_idx"))))
    return best.where("_n = 1").drop("_n")
