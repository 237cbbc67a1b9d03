"""Scalar functions on paths, test output, errors and numbers, all as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Container folders that a path may start with.
ROOTS = ("/testbed/", "/workspace/", "/repo/")
#: Names of test helpers.
HELPERS = ("test.py", "tests.py", "conftest.py", "pytest_plugin.py", "pytest_plugins.py")
TEST_FOLDERS = ("tests", "test", "testing")


def normalize_path(path: Column) -> Column:
    """Trimmed path without its container folder, or else without leading dots and slashes of a relative path."""
    p = F.trim(path)
    out = F.when(p.startswith("./"), F.regexp_replace(p, r"^[./]+", "")).otherwise(p)
    for root in reversed(ROOTS):
        out = F.when(p.startswith(root), F.substring(p, len(root) + 1, 1 << 30)).otherwise(out)
    return out


def is_test_file(path: Column) -> Column:
    """Whether a path looks like a test, a helper of tests or a runner."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    name = F.element_at(parts, -1)
    return name.isin(*HELPERS) | name.endswith("_runner.py") | (path.startswith("r2e_tests/") & (name == "helper.py")) | F.exists(parts, lambda p: p.isin(*TEST_FOLDERS) | p.startswith("test_") | p.endswith("_test.py"))


def module_name(path: Column) -> Column:
    """Dotted module of a .py path; a package's own file gives the package."""
    return F.translate(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), "/", ".")


def patched_files(patch: Column) -> Column:
    """Sorted .py files of a unified diff, from both sides."""
    sides = [F.regexp_extract_all(patch, F.lit(rf"(?m)^{s} {d}/(.+\.py)\s*$"), F.lit(1)) for s, d in ((r"---", "a"), (r"\+\+\+", "b"))]
    return F.array_sort(F.array_union(*sides))


def status_lines(raw: Column) -> Column:
    """Test node -> its last status, from lines ``node STATUS`` or ``STATUS node`` of pytest output."""
    pattern = r"^(?:(\S+::\S+)\s+(PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS)\b|(PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS)\s+(\S+::\S+))"
    lines = F.filter(F.split(raw, "\n"), lambda s: s.rlike(pattern))
    node = lambda s: F.concat(F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 4))
    status = lambda s: F.concat(F.regexp_extract(s, pattern, 2), F.regexp_extract(s, pattern, 3))
    pairs = F.transform(lines, lambda s: F.struct(node(s).alias("key"), status(s).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + F.lit(2), F.greatest(F.size(pairs) - i, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def error_kind(error: Column) -> Column:
    """Kind of an error by ordered rules over its text; null stays null. The words and kinds are fixed values."""
    low = F.lower(error)
    has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    rules = [
        (has("arl_gateway_url"), "arl_config_missing"),
        (has("websocket") & has("403", "forbidden", "rejected"), "arl_shell_forbidden"),
        (has("interactive shell", "/shell"), "arl_shell_unavailable"),
        (has("arl") & has("connection", "connect", "gateway", "timeout", "refused"), "arl_gateway_unreachable"),
        (has("network", "connection refused", "connection reset", "temporary failure"), "network_error"),
        (has("timeout", "timed out"), "runtime_timeout"),
    ]
    out = F.when(error.isNull(), F.lit(None).cast("string"))
    for rule, kind in rules:
        out = out.when(rule, kind)
    return out.otherwise("runtime_error")


def is_system_error(kind: Column) -> Column:
    return kind.isin("arl_config_missing", "arl_shell_forbidden", "arl_shell_unavailable", "arl_gateway_unreachable", "network_error", "runtime_timeout")


def tail_text(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def slug(text: Column) -> Column:
    """A name for files: all but letters, digits, dots, underscores and hyphens become underscores."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_")


def duration_seconds(text: Column) -> Column:
    """Seconds of ``15m``, ``2h``, ``30s`` or a plain number; null for an empty text, for ``0`` and for what is no duration."""
    n, unit = (F.regexp_extract(F.lower(text), r"^\s*([\d.]+)\s*([smh]?)\s*$", g) for g in (1, 2))
    return F.when(text != "0", n.try_cast("double") * F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1))


def redacted(text: Column, words: tuple[str, ...] = ("key", "token", "secret", "password", "authorization")) -> Column:
    """A JSON text in which every string or number under a name with one of the words is replaced."""
    names = "|".join(words)
    return F.regexp_replace(text, rf'(?i)("[^"]*(?:{names})[^"]*"\s*:\s*)("(?:[^"\\]|\\.)*"|-?[\d.eE+-]+|true|false)', '$1"<redacted>"')


def instance_candidates(instance_id: Column) -> Column:
    """Ids under which a map may be stored: the id, and with an 8-digit commit if it ends in a longer hex one."""
    short = F.regexp_extract(instance_id, r"(?s)^(.*__[0-9a-fA-F]{8})[0-9a-fA-F]+$", 1)
    return F.when(short == "", F.array(instance_id)).otherwise(F.array(instance_id, short))


def dotted_names(text: Column) -> Column:
    """Dotted names of a text, each once, in order: candidates for what an issue points at."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\w./])([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)"), F.lit(1)))


def rate(num: Column, den: Column) -> Column:
    """num / den; null where den is null or zero."""
    return F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def multiplier(distance: Column, m_max: float, sign: Column) -> Column:
    """m_max ** (1 - distance), turned around for a negative sign; 1 without a hit or sign."""
    return F.when((distance < 0) | (sign == 0), 1.0).otherwise(F.pow(F.lit(m_max), (1 - distance) * F.signum(sign)))
