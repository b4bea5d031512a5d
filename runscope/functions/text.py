"""Column functions on texts, paths, times and arrays.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT_MARK = "\n[...]\n"


def bound(text: Column, size: int) -> Column:
    """The first ``size`` characters."""
    return F.substring(text, 1, size)


def head_tail(text: Column, head: int, tail: int) -> Column:
    """A long text reduced to its two ends."""
    return F.when(F.length(text) > head + tail, F.concat(F.substring(text, 1, head), F.lit(CUT_MARK), F.substring(text, -tail, tail))).otherwise(text)


def normalize_command(text: Column) -> Column:
    """Times and temporary paths masked, white space collapsed."""
    out = F.regexp_replace(text, r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?", "<time>")
    out = F.regexp_replace(out, r"(/var)?/tmp/[^ \t\n\"']*", "<tmp>")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def normalize_error(text: Column) -> Column:
    """As a command, with hexadecimal numbers, other paths and digits masked too, in lower case."""
    out = F.lower(normalize_command(text))
    out = F.regexp_replace(out, r"0x[0-9a-f]+", "<hex>")
    out = F.regexp_replace(out, r"/[a-z0-9._-]+(/[a-z0-9._-]+)+", "<path>")
    return F.regexp_replace(out, r"[0-9]+", "<n>")


def error_fingerprint(text: Column) -> Column:
    return F.sha2(normalize_error(text), 256)


def canonical_path(path: Column, workspace: Column) -> Column:
    """Relative to the workspace where it lies below it; ``.``, ``..`` and empty parts resolved."""
    inside = F.when(F.startswith(path, F.concat(workspace, F.lit("/"))), F.substr(path, F.length(workspace) + 2)).when(path == workspace, F.lit("")).otherwise(path)
    rooted = F.startswith(inside, F.lit("/"))

    def step(held: Column, part: Column) -> Column:
        up = F.when(F.size(held) > 0, F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(held)
        return F.when((part == "") | (part == "."), held).when(part == "..", up).otherwise(F.concat(held, F.array(part)))

    parts = F.aggregate(F.split(inside, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def file_name(path: Column) -> Column:
    """What a notice may show of a path."""
    return F.element_at(F.split(path, "/"), -1)


def _under(path: Column, bounds: Column) -> Column:
    return F.exists(bounds, lambda p: (path == p) | F.startswith(path, F.concat(p, F.lit("/"))))


def is_forbidden(path: Column, forbidden: Column) -> Column:
    return F.coalesce(_under(path, forbidden), F.lit(False))


def is_unexpected(path: Column, expected: Column) -> Column:
    """Outside every expected prefix; nothing is unexpected where none is given."""
    return F.coalesce((F.size(expected) > 0) & ~_under(path, expected), F.lit(False))


def test_counts(text: Column, exit_code: Column) -> Column:
    """struct(runner, passed, failed) from what known runners print, else from the exit code."""
    number = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("int")
    cargo = F.rlike(text, F.lit(r"test result: "))
    vitest = F.rlike(text, F.lit(r"Tests +[0-9]"))
    pytest = F.rlike(text, F.lit(r"[0-9]+ (passed|failed)"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    runner = F.when(cargo, "cargo").when(vitest, "vitest").when(pytest, "pytest").when(exit_code.isNotNull(), "generic")
    passed = F.when(cargo | vitest | pytest, zero(number(r"([0-9]+) passed"))).when(exit_code.isNotNull(), (exit_code == 0).cast("int"))
    failed = F.when(cargo | vitest | pytest, zero(number(r"([0-9]+) failed"))).when(exit_code.isNotNull(), (exit_code != 0).cast("int"))
    return F.struct(runner.alias("runner"), passed.alias("passed"), failed.alias("failed"))


def event_id(*cols: Column) -> Column:
    """Stable id of session, offset, type and payload hash."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def pseudonymize(path: Column, salt: str) -> Column:
    """Keyed pseudonyms of a path's parts; the separators stay."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.when(p == "", p).otherwise(F.substring(F.sha2(F.concat(F.lit(salt), p), 256), 1, 12))), "/")


def parse_time(text: Column) -> Column:
    """RFC 3339 time, else null."""
    fine = F.rlike(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"))
    return F.when(fine, F.try_to_timestamp(F.upper(text)))


def elapsed(start: Column, end: Column) -> Column:
    """Whole seconds."""
    return F.timestamp_diff("SECOND", start, end)


def cursor(path: Column, offset: Column, mark: Column) -> Column:
    return F.concat_ws(":", path, offset.cast("string"), mark)


def parse_cursor(text: Column) -> Column:
    """struct(path, offset, mark); a path may hold colons, the last two parts may not."""
    parts = F.split(text, ":")
    n = F.size(parts)
    whole = n >= 3
    return F.struct(
        F.when(whole, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), ":")).alias("path"),
        F.when(whole, F.try_element_at(parts, n - 1).try_cast("long")).alias("offset"),
        F.when(whole, F.try_element_at(parts, n)).alias("mark"),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 1 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(1.0))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def concern_fingerprint(concerns: Column) -> Column:
    """Hash of kinds, severities and references; the wording plays no part."""
    flat = F.transform(concerns, lambda c: F.concat_ws("|", c["kind"], c["severity"], F.array_join(F.array_sort(c["evidence_refs"]), ",")))
    return F.sha2(F.array_join(F.array_sort(flat), "\n"), 256)


def dedupe_key(session: Column, status: Column, fingerprint: Column, event_cursor: Column) -> Column:
    return F.concat_ws("+", session, status, fingerprint, event_cursor)


def escape_markup(text: Column) -> Column:
    """A backslash before each reserved character of the notice markup."""
    return F.regexp_replace(text, r"([_*\[\]()~`>#+=|{}.!\\-])", r"\\$1")


def is_unique(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)
