"""Redaction: a table of classes and patterns folded over a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.functions import literals
from runscope.functions.text import head_tail

#: (class, pattern, replacement), applied in this order.  The patterns use neither look-around nor back references.
#: A key whose end is cut off is redacted to the end of the text.
PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("private_key", r"(?s)-----BEGIN [A-Z ]*(PRIVATE KEY|CERTIFICATE)-----.*?(-----END [A-Z ]*(PRIVATE KEY|CERTIFICATE)-----|$)", "[REDACTED:private_key]"),
    ("bearer", r"(?i)(authorization:[ ]*)?(bearer|basic)[ ]+[A-Za-z0-9._~+/=-]{8,}", "[REDACTED:bearer]"),
    ("cookie", r"(?i)(set-)?cookie:[ ]*[^\n]+", "[REDACTED:cookie]"),
    ("oauth", r"(?i)(access_token|refresh_token|id_token)([\"']?[ ]*[=:][ ]*[\"']?)[A-Za-z0-9._~+/-]{8,}", "$1$2[REDACTED:oauth]"),
    ("env_secret", r"(?i)([A-Z0-9_]*(SECRET|TOKEN|PASSWORD|PASSWD|API_KEY|APIKEY|PRIVATE_KEY)[A-Z0-9_]*)([\"']?[ ]*=[ ]*[\"']?)[^ \n\"']+", "$1$3[REDACTED:env_secret]"),
    ("api_key", r"(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED:api_key]"),
)


def _quoted(literal: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " _" else c for c in literal)


def patterns(prefixes: tuple[str, ...] = (), usernames: tuple[str, ...] = ()) -> tuple[tuple[str, str, str], ...]:
    """The table with configured path prefixes and user names."""
    own = tuple(("path_prefix", _quoted(p), "[REDACTED:path_prefix]") for p in prefixes) + tuple(("username", rf"\b{_quoted(u)}\b", "[REDACTED:username]") for u in usernames)
    return PATTERNS + own


#: What a text must hold, in lower case, before a class's pattern is tried: plain searches are far cheaper than patterns.
NEEDS: dict[str, tuple[str, ...]] = {
    "private_key": ("-----begin",),
    "bearer": ("bearer ", "basic "),
    "cookie": ("cookie:",),
    "oauth": ("access_token", "refresh_token", "id_token"),
    "env_secret": ("secret", "token", "password", "passwd", "api_key", "apikey", "private_key"),
    "api_key": ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "eyj"),
}


def _worth(text: Column, name: str) -> Column:
    low = F.lower(text)
    out = F.lit(name not in NEEDS)
    for literal in NEEDS.get(name, ()):
        out = out | F.contains(low, F.lit(literal))
    return out & F.contains(text, F.lit("=")) if name == "env_secret" else out


def redact(text: Column, table: tuple = PATTERNS) -> Column:
    out = text
    for name, pattern, replacement in table:
        out = F.when(_worth(text, name), F.regexp_replace(out, pattern, replacement)).otherwise(out)
    return out


def classes(text: Column, table: tuple = PATTERNS, limit: int | None = None) -> Column:
    """Sorted classes that a redaction of the text applies, never the values."""
    names = sorted({c for c, _, _ in table})
    found = {n: _worth(text, n) & F.rlike(text, F.lit("|".join(f"(?:{p})" for c, p, _ in table if c == n))) for n in names}
    if limit is not None:
        found["oversized_output"] = F.length(text) > limit
    return F.array_compact(F.array(*[F.when(found[n], F.lit(n)) for n in sorted(found)]))


def safe_summary(text: Column, size: int, table: tuple = PATTERNS, exit_code: Column | None = None) -> Column:
    """Redacted and bounded: the whole text is redacted before it is cut, so that no half secret slips through and no text is lost.

    With an exit code that is not null (a command's output) both ends of a long text
    stay, three quarters of the room for the last, and the code in front.
    """
    whole = redact(text, table)
    if exit_code is None:
        return F.substring(whole, 1, size)
    front = F.concat(F.lit("exit "), exit_code.cast("string"), F.lit("\n"))
    room = size - 32  # of the code and the mark of the cut
    ends = F.concat(front, head_tail(whole, room - room * 3 // 4, room * 3 // 4))
    return F.when(exit_code.isNotNull() & (F.length(whole) > size), ends).otherwise(F.substring(whole, 1, size))


#: Seeds that are searched for one by one; more go through ``literals``.
FEW = 50


def leak_scan(rows: DataFrame, column: str | None, secrets: DataFrame) -> DataFrame:
    """Rows whose column still holds a seeded secret (``secret``), one for each secret held; a null text holds none.

    Without a column all text columns are searched, nested ones too.  There may be any
    number of seeds.
    """
    seeds = secrets.select("secret").where("secret <> ''").distinct()
    if column is None or seeds.limit(FEW + 1).count() > FEW:
        return literals.holding(rows, seeds, columns=None if column is None else [column])
    return rows.join(F.broadcast(seeds), F.contains(F.col(column), F.col("secret"))).select(*rows.columns, "secret")


def redact_configured(rows: DataFrame, column: str, prefixes: DataFrame, usernames: DataFrame) -> DataFrame:
    """A column without configured path prefixes and user names (tables of one column each, of any size); a user name counts as a whole word."""
    own = lambda df, kind, whole: df.select(F.col(df.columns[0]).alias("literal"), F.lit(kind).alias("class"), F.lit(whole).alias("whole"))
    return literals.replaced(rows, column, own(prefixes, "path_prefix", False).unionByName(own(usernames, "username", True)))
