"""Task rows: ids from repository and commit, and the frames that a trace keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_bare_hash(text: Column) -> Column:
    """Twenty or more lower-case hex digits and nothing else; null is none."""
    return F.coalesce(text.rlike(r"^[0-9a-f]{20,}\z"), F.lit(False))


def image_repository(image: Column) -> Column:
    """The repository in an image name ``owner/repository[_final]:tag``; null without an owner."""
    name = F.substring_index(F.regexp_extract(image, r"(?s)^[^/]*/(.*)$", 1), ":", 1)
    return F.nullif(F.regexp_replace(name, r"_final\z", ""), F.lit(""))


def task_id(instance_id: Column, repo: Column, commit: Column, image: Column, digits: int = 8) -> Column:
    """A readable id: the given one unless it is a bare hash, else repository and short commit, else what there is; nulls count as empty."""
    given, commit = F.nullif(instance_id, F.lit("")), F.nullif(commit, F.lit(""))
    repo = F.coalesce(F.nullif(repo, F.lit("")), image_repository(image))
    both = F.concat(repo, F.lit("__"), F.substring(commit, 1, digits))
    return F.coalesce(F.when(~is_bare_hash(given), given), both, F.substring(commit, 1, 12), given, F.lit("unknown"))


def kept_frames(frames: Column, limit: int = 80) -> Column:
    """The first frame and the last ``limit - 1`` of a longer trace."""
    return F.when(F.size(frames) > limit, F.concat(F.slice(frames, 1, 1), F.slice(frames, -(limit - 1), limit - 1))).otherwise(frames)


#: Where the text of an issue may stand, in order.
ISSUE_FIELDS = ("problem_statement", "issue", "issue_text", "description", "problem", "title")


def _object(c: Column) -> Column:
    """A JSON object's text; a string that holds one is decoded; null for all else."""
    # The lambda names the value once; else texts nested in texts would be parsed anew for each mention.
    return F.get(F.filter(F.array(c), lambda x: F.ltrim(x).startswith("{") & F.try_parse_json(x).isNotNull()), F.lit(0))


def extra_info(task: Column) -> Column:
    """The ``extra_info`` object of a task in JSON, whether it stands as an object or as text."""
    return _object(F.get_json_object(task, "$.extra_info"))


def tools_kwargs(task: Column) -> Column:
    """The task's own object of tool arguments, or that of its extra info."""
    return F.coalesce(_object(F.get_json_object(task, "$.tools_kwargs")), _object(F.get_json_object(extra_info(task), "$.tools_kwargs")))


def reward_metadata(task: Column) -> Column:
    return _object(F.get_json_object(tools_kwargs(task), "$.reward.metadata"))


def task_field(task: Column, name: str) -> Column:
    """A field of a task: its own, else that of its extra info, else that of its reward metadata; a null at the top counts as missing."""
    path = f"$.{name}"
    found = F.coalesce(F.get_json_object(task, path), F.get_json_object(extra_info(task), path), F.get_json_object(reward_metadata(task), path))
    if name == "repo_name":
        return F.coalesce(found, task_field(task, "repo"))
    return found


def flatten_tasks(tasks: DataFrame, fields: list[str], raw: str = "raw") -> DataFrame:
    """``tasks`` with a column for each field, and relevant_files as an array if asked for."""
    cols = {f: task_field(F.col(raw), f) for f in fields}
    if "relevant_files" in cols:
        cols["relevant_files"] = F.from_json(cols["relevant_files"], "array<string>")
    return tasks.withColumns(cols)


def issue_text(task: Column) -> Column:
    """The first text that is not blank among the issue fields, of the task and then of its extra info; white space is kept."""
    extra = extra_info(task)
    texts = [F.get_json_object(c, f"$.{f}") for c in (task, extra) for f in ISSUE_FIELDS]
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts])


def row_instance_id(task: Column) -> Column:
    """The id of a row: its own, that of its extra info, that of its reward metadata; empty ones count as missing."""
    return F.coalesce(*[F.nullif(F.get_json_object(c, "$.instance_id"), F.lit("")) for c in (task, extra_info(task), reward_metadata(task))])


def row_data_source(task: Column) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(c, "$.data_source"), F.lit("")) for c in (task, extra_info(task))], F.lit("unknown"))


def prompt(task: Column) -> Column:
    """The prompt's messages as array<string>, those that are objects; null where there are none."""
    items = F.filter(F.from_json(F.get_json_object(task, "$.prompt"), "array<string>"), lambda x: F.ltrim(x).startswith("{"))
    return F.when(F.size(items) > 0, items)


def commit_content(task: Column) -> Column:
    return F.coalesce(*[_object(F.get_json_object(c, "$.parsed_commit_content")) for c in (task, reward_metadata(task))])


def commit_ref(task: Column, instance_id: Column | None = None) -> Column:
    """The commit before the change: the old or base commit, else the parent of the fixed one, else of the id's suffix."""
    meta, content = reward_metadata(task), commit_content(task)
    text = lambda c, f: F.nullif(F.get_json_object(c, f"$.{f}"), F.lit(""))
    known = F.coalesce(*[text(c, f) for c in (task, meta, content) for f in ("old_commit_hash", "base_commit")])
    fixed = F.coalesce(text(task, "commit_hash"), text(meta, "commit_hash"))
    given = [] if instance_id is None else [F.nullif(instance_id, F.lit(""))]
    iid = F.coalesce(*given, text(task, "instance_id"), text(meta, "instance_id"))
    suffix = F.nullif(F.when(iid.contains("__"), F.substring_index(iid, "__", -1)), F.lit(""))
    return F.coalesce(known, F.concat(fixed, F.lit("^")), F.concat(suffix, F.lit("^")))


def file_contents(task: Column, side: str) -> Column:
    """map<path, content> of the ``old`` or ``new`` contents of a commit's files; files without a path or content are left out."""
    content = F.coalesce(commit_content(task), _object(F.get_json_object(task, "$.parsed_commit")))
    diffs = F.from_json(F.get_json_object(content, "$.file_diffs"), f"array<struct<header:struct<file:struct<path:string>>,{side}_file_content:string>>")
    pairs = F.transform(F.coalesce(diffs, F.array().cast(f"array<struct<header:struct<file:struct<path:string>>,{side}_file_content:string>>")), lambda d: F.struct(d["header"]["file"]["path"].alias("key"), d[f"{side}_file_content"].alias("value")))
    kept = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"].isNotNull() if side == "old" else p["value"] != ""))
    # Of a path that is named twice, the last content counts.
    last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + F.lit(2), F.size(kept)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def id_repository(instance_id: Column) -> Column:
    """What stands before the last double underscore, lower-cased; null without one."""
    return F.when(instance_id.contains("__"), F.nullif(F.lower(F.trim(F.regexp_extract(instance_id, r"(?s)^(.*)__", 1))), F.lit("")))


def id_suffix(instance_id: Column) -> Column:
    return F.when(instance_id.contains("__"), F.nullif(F.lower(F.trim(F.substring_index(instance_id, "__", -1))), F.lit("")))


def mirror_image(image: Column, registry: str, namespace: str) -> Column:
    """An image name on the mirror: without its first part, below registry and namespace; one that is there already stays."""
    path = F.when(image.contains("/"), F.regexp_extract(image, r"(?s)^[^/]*/(.*)$", 1)).otherwise(image)
    return F.when(image.startswith(registry), image).otherwise(F.concat(F.lit(f"{registry.rstrip('/')}/{namespace.strip('/')}/"), path))


def by_difficulty(tasks: DataFrame, difficulty: DataFrame, wanted: list[str] | None, key: str = "instance_id") -> DataFrame:
    """``tasks`` with the difficulty of their id, of the wanted ones alone; None asks for no difficulty, and then tasks without one stay."""
    out = tasks.join(difficulty.select(key, "difficulty").dropDuplicates([key]), key, "left")
    return out if wanted is None else out.where(F.col("difficulty").isin(wanted))
