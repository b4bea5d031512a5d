"""Personal data: detection and keyed surrogate generation.

Every detected entity gets a replacement of its own type: the same value always
the same one (coreference), different values different ones (distinctness), with
the format of the original: digits for digits, letters for letters, separators in
place, a valid check digit where there was one, names of the same gender and
script.  A surrogate is a keyed permutation of all values of one format, so it
cannot repeat within a format; a check over all entities of the corpus draws again
where one equals itself, another entity's value, or a surrogate already given.
From attempt PLAIN on a surrogate grows by a character with each, so that there is
always room and the drawing ends however many values a format has.

The key comes from the session's ``spark.runscope.surrogateKey``.  Where that is
unset a random one is drawn for the application and kept nowhere: nobody can undo
the surrogates then, and another run gives others.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.llm.batches import fresh, map_batches, struct
from runscope.session import materialize

KEY_SETTING = "spark.runscope.surrogateKey"
#: Attempts whose surrogates have the length of the original; attempts after which drawing is given up with an error.
PLAIN, LAST = 6, 200
#: Redrawn entities that tasks get as a table in memory; beyond that they come by a join.
REDRAWN = 50_000

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_SECRET = re.compile(r"""\b(?:password|passwd|pwd|secret|token|api[_-]?key)["']?\s*[=:]\s*["']?([A-Za-z0-9+/_-]{8,})""", re.I)
_CREDENTIAL = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")
_NUMBERS = (
    ("ipv4", re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)")),
    ("card", re.compile(r"(?<![\d-])(?:\d{4}[ -]?){3}\d{1,7}(?![\d-])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])")),
)
_TEN = re.compile(r"(?<![^\W_])(?:tel|phone|telephone|mobile|cell|fax|call|telefon|teléfono|téléphone)\W{1,3}([2-9]\d{9})(?!\d)", re.I)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:])")
# The first digits of card numbers and how long such numbers are.
_ISSUERS = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|(?:222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|35\d{14}|(?:6011|65\d\d|64[4-9]\d)\d{12,15}")
# Forms of address, and the syllables of invented names.
_ADDRESS = {"n": ("Dr.", "Prof.", "Professor", "Doctor"), "m": ("Mr.", "Mister", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"), "f": ("Mrs.", "Ms.", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Κυρία")}
_SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga go ka ke la le lo ma me mi na ne no ra re ri ro sa se ta te to va ve".split(), {"n": ("is", "en", "o", "y"), "m": ("n", "r", "l", "s"), "f": ("a", "ia", "ina", "ella"), "s": ("son", "berg", "man", "dale")}),
    "cyrillic": ("ба бо ва ве га го да де за зо ка ко ла ле ма ми на не ра ро са се та те".split(), {"n": ("о", "и", "е", "ко"), "m": ("н", "р", "й", "м"), "f": ("а", "ина", "ия", "ана"), "s": ("ов", "ин", "енко", "ский")}),
    "greek": ("βα βε γα δα δε ζα θε κα κο λα λε μα μι να νε ρα ρο σα σε τα τε".split(), {"n": ("ι", "ω", "υ", "ιω"), "m": ("ς", "ος", "ης", "ας"), "f": ("α", "η", "ια", "ινη"), "s": ("ου", "ίδης", "άκης", "όπουλος")}),
}
_FORMS = [f for forms in _ADDRESS.values() for f in forms]
_PERSON = re.compile(rf"(?<!\w)({'|'.join(map(re.escape, _FORMS))})[  ]+([^\W\d_a-zа-яα-ω][\w'’-]+)(?:[  ]([^\W\d_a-zа-яα-ω][\w'’-]+))?")
_OWNER = re.compile(r"['’]s$|['’-]+$")
_WORD = re.compile(r"[^\W_]+")
_GENDER = {f: g for g, forms in _ADDRESS.items() for f in forms}


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin"


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions of the names that stand behind a form of address somewhere in the text."""
    spans, first, forms = [], {}, set()
    for m in _PERSON.finditer(text):
        words = [k for k in (2, 3) if m[k]]
        for k in words:
            name = _OWNER.sub("", m[k])
            spans.append((m.start(k), m.start(k) + len(name)))
            forms |= {name, name.upper()}
            if k != words[-1]:
                first.setdefault(name.lower(), _GENDER[m[1]])
    if not spans:
        return []
    given = set(spans)
    words = _WORD if all(map(str.isalpha, forms)) else re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(forms, key=len, reverse=True)))})(?!\w)")
    spans += [w.span() for w in words.finditer(text) if w[0] in forms and w.span() not in given]
    return [(a, b, f"name-{first.get(text[a:b].lower(), 's')}-{script_of(text[a:b])}", text[a:b].lower()) for a, b in spans]


def _mails(text: str) -> list[tuple[int, int, str, str]]:
    """Mail addresses: from each ``@`` outwards, so that a long run without one is passed once."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        while a < at and not text[a].isalnum():
            a += 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            found.append((a, m.end(), "email", text[a : m.end()].lower()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def _numbers(text: str) -> list[tuple[int, int, str, str]]:
    found = []
    for kind, pattern in _NUMBERS:
        for m in pattern.finditer(text):
            value = m[0] if kind == "ipv4" else "".join(c for c in m[0] if c.isdigit())
            if kind == "phone" and len(value) == 11 and value[0] == "1":
                value = value[1:]  # the same number with and without its country
            # a bare number needs a check digit that fits
            if kind != "card" or _ISSUERS.fullmatch(value) and (not m[0].isdigit() or int(value[-1]) == _luhn(value[:-1])):
                found.append((*m.span(), kind, value))
    found += [(*m.span(1), "phone", m[1]) for m in _TEN.finditer(text)]
    for m in _IBAN.finditer(text):
        value = m[0].replace(" ", "")
        if _iban_check(value) == value[2:4]:
            found.append((*m.span(), "iban", value))
    if ":" in text:
        for m in _IPV6.finditer(text):
            try:
                value = str(ipaddress.IPv6Address(m[0]))
            except ValueError:
                continue
            if sum(map(bool, m[0].split(":"))) > 2:
                found.append((*m.span(), "ipv6", value))
    return found


def _iban_check(value: str) -> str:
    """The check digits that fit a country and an account."""
    digits = "".join(str(int(c, 36)) for c in value[4:] + value[:2])
    return f"{98 - int(digits + '00') % 97:02d}"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of each entity, without overlaps, in order.

    ``value`` is canonical: lower case for mail, digits alone for numbers (without a
    country's 1 for telephones).  A card number has an issuer's first digits and, if
    it is one run of digits, a check digit that fits.  A name
    after a form of address gives an entity for each of its words, and so does every
    other mention of such a word, before or after, as written there or in capitals.
    A word that is once a first name in the text has that kind wherever it stands.
    """
    found = _mails(text)
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret", m[1]) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[1])]
    if _DIGIT.search(text):
        found += _numbers(text)
    if any(p in text for p in ("AKIA", "ASIA", "gh", "sk-", "xox")):
        found += [(*m.span(), "credential", m[0]) for m in _CREDENTIAL.finditer(text)]
    if any(f in text for f in _FORMS):
        found += _names(text)
    found.sort(key=lambda e: (e[0], -e[1]))
    out, last = [], -1
    for e in found:
        if e[0] >= last:
            out.append(e)
            last = e[1]
    return out


_DIGIT = re.compile(r"\d")


def permute(x: int, size: int, tweak: bytes) -> int:
    """A keyed permutation of 0 .. size-1: alternating additions to two halves of mixed radix."""
    a = 1 << max(1, size.bit_length() // 2)
    b = -(-size // a)
    while True:  # a * b is just above size: values beyond it walk on
        left, right = x % a, x // a
        for k in range(6):
            r = hashlib.shake_256(tweak + bytes([k]) + (right if k % 2 == 0 else left).to_bytes(-(-size.bit_length() // 8) + 1, "big")).digest(-(-size.bit_length() // 8) + 8)
            if k % 2 == 0:
                left = (left + int.from_bytes(r, "big")) % a
            else:
                right = (right + int.from_bytes(r, "big")) % b
        x = right * a + left
        if x < size:
            return x


_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _alphabet(c: str) -> str:
    return _DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER if c in _UPPER else c


def _shuffle(value: str, alphabets: list[str], tweak: bytes) -> str:
    """Permutes all strings with these alphabets, place by place."""
    x, size = 0, 1
    for c, a in zip(value, alphabets, strict=True):
        x, size = x * len(a) + a.index(c), size * len(a)
    y = permute(x, size, tweak + "|".join(sorted(set(alphabets))).encode() + size.to_bytes(-(-size.bit_length() // 8), "big")) if size > 1 else x
    out = []
    for a in reversed(alphabets):
        y, k = divmod(y, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """Check digit that completes the digits."""
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _name(kind: str, value: str, tweak: bytes, attempt: int) -> str:
    _, role, script = kind.split("-")
    syllables, endings = _SYLLABLES[script]
    n = len(syllables)
    x = int.from_bytes(hashlib.shake_256(tweak + kind.encode() + value.encode()).digest(16 + attempt), "big")
    count, end = 2 + x % 2 + attempt, endings[role][x // 2 % 4]
    x //= 8
    out = []
    for _ in range(count):
        x, k = divmod(x, n)
        out.append(syllables[k])
    return "".join(out) + end


def surrogate(kind: str, value: str, attempt: int, key: str) -> str:
    """The replacement of a canonical value; another attempt gives another one, longer from PLAIN on."""
    tweak = hashlib.blake2b(f"{kind}/{attempt}".encode(), key=hashlib.sha256(key.encode()).digest(), digest_size=16).digest()
    if kind.startswith("name-"):
        return _name(kind, value, tweak, attempt)
    if kind == "ipv4" and attempt >= PLAIN:  # of all addresses of single machines
        y = int.from_bytes(hashlib.shake_256(tweak + value.encode()).digest(16), "big") % (223 << 24)
        return f"{1 + (y >> 24)}.{y >> 16 & 255}.{y >> 8 & 255}.{y & 255}"
    made = _permuted(kind, value, tweak)
    if attempt < PLAIN or kind == "ipv6":
        return made
    more = hashlib.shake_256(tweak + b"more" + value.encode()).digest(attempt - PLAIN + 1)
    if kind == "email":
        return "".join(_LOWER[b % 26] for b in more) + made
    tail = "".join(_DIGITS[b % 10] for b in more)
    if kind == "card" and int(made[-1]) == _luhn(made[:-1]):
        return made[:-1] + tail + str(_luhn(made[:-1] + tail))
    if kind == "iban":
        return made[:2] + _iban_check(made + tail) + made[4:] + tail
    return made + tail


def _permuted(kind: str, value: str, tweak: bytes) -> str:
    """Another value of the same format."""
    if kind == "ipv4":
        first, *rest = map(int, value.split("."))
        low, high = (1, 224) if 1 <= first < 224 else (224, 256) if first else (0, 1)
        x = ((first - low) * 256 + rest[0]) * 65536 + rest[1] * 256 + rest[2]
        y = permute(x, (high - low) << 24, tweak + bytes([low]))
        return f"{low + (y >> 24)}.{y >> 16 & 255}.{y >> 8 & 255}.{y & 255}"
    if kind == "card":
        if int(value[-1]) == _luhn(value[:-1]):
            body = value[0] + _shuffle(value[1:-1], [_DIGITS] * (len(value) - 2), tweak + value[0].encode() + b"v")
            return body + str(_luhn(body))
        body = value
        while True:  # values with a valid check digit walk on
            body = value[0] + _shuffle(body[1:], [_DIGITS] * (len(value) - 1), tweak + value[0].encode())
            if int(body[-1]) != _luhn(body[:-1]):
                return body
    if kind == "phone":
        keep = max(0, len(value) - 10)
        return value[:keep] + _shuffle(value[keep:], [_DIGITS] * (len(value) - keep), tweak + value[:keep].encode())
    if kind == "iban":
        body = _shuffle(value[4:], [_alphabet(c) for c in value[4:]], tweak + value[:2].encode() + "".join(_alphabet(c)[0] for c in value[4:]).encode())
        return value[:2] + _iban_check(value[:4] + body) + body
    if kind == "ipv6":
        # the first group stays; zeros that a format leaves out stay out, as each group begins with another digit than zero
        groups = value.split(":")
        heads = [k for k, g in enumerate(groups) if k and g and g != "0"]
        flat = "".join(groups[k] for k in heads)
        sets, at = [], 0
        for k in heads:
            sets += [_HEX[1:], *[_HEX] * (len(groups[k]) - 1)]
        flat = _shuffle(flat, sets, tweak + value.translate(str.maketrans(_HEX[1:], "1" * 15)).encode()) if flat else flat
        for k in heads:
            groups[k], at = flat[at : at + len(groups[k])], at + len(groups[k])
        return ":".join(groups)
    if kind == "ssn":
        return _shuffle(value, [_DIGITS] * len(value), tweak)
    if kind == "email":
        stem, dot, top = value.rpartition(".")
        return _shuffle(stem, [_alphabet(c) for c in stem], tweak + re.sub("[a-z]", "a", re.sub("[0-9]", "0", stem)).encode() + top.encode()) + dot + top
    if kind == "credential":
        keep = 4 if value[3] not in "-" else 3
        return value[:keep] + _shuffle(value[keep:], [_alphabet(c) for c in value[keep:]], tweak + value[:keep].encode() + "".join(_alphabet(c)[0] for c in value).encode())
    if not set(value) - set(_HEX):
        return _shuffle(value, [_HEX] * len(value), tweak + b"x")
    return _shuffle(value, [_alphabet(c) for c in value], tweak + "".join(_alphabet(c)[0] for c in value).encode())


def dressed(kind: str, original: str, made: str) -> str:
    """The surrogate in the format of the occurrence: its separators and its case."""
    if kind in ("card", "ssn", "phone"):
        country = max(0, sum(c.isdigit() for c in original) - len(made))  # digits before the number itself stay
        digits = iter("".join(c for c in original if c.isdigit())[:country] + made)
        return "".join(next(digits) if c.isdigit() else c for c in original) + "".join(digits)
    if kind == "iban":
        chars = iter(made)
        return "".join(next(chars) if c.isalnum() else c for c in original) + "".join(chars)
    if kind == "ipv6":
        return made.upper() if original.upper() == original and original.lower() != original else made
    if kind.startswith("name-"):
        return made.upper() if original.isupper() and len(original) > 1 else made[0].upper() + made[1:]
    if kind == "email":
        more = len(made) - len(original)
        return made[:more] + "".join(m.upper() if o.isupper() else m for o, m in zip(original, made[more:], strict=True))
    return made


def replace(text: str, attempts: dict[tuple[str, str], int], key: str) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced."""
    given = lru_cache(None)(lambda kind, value: surrogate(kind, value, attempts.get((kind, value), 0), key))
    out, at, kinds = [], 0, []
    for start, end, kind, value in detect(text):
        out += [text[at:start], dressed(kind, text[start:end], given(kind, value))]
        at = end
        kinds.append(kind)
    return ("".join(out) + text[at:], kinds) if kinds else (text, kinds)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, value) over all whole texts; a batch gives each once, so a hot entity is added up early."""

    def make():
        def run(batch: pa.RecordBatch):
            found = sorted({(k, v) for t in batch.column(0).to_pylist() if t for _, _, k, v in detect(t)})
            return [[k for k, _ in found], [v for _, v in found]]

        return run

    return map_batches(docs.select(F.col(f"`{text}`")), make, struct(("kind", T.StringType()), ("value", T.StringType()))).distinct()


def _drawn(pending: DataFrame, attempt: int, key: str) -> DataFrame:
    def make():
        return lambda b: [b.column(0), b.column(1), [attempt] * b.num_rows, [surrogate(k, v, attempt, key) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]]

    return map_batches(pending.select("kind", "value"), make, struct(("kind", T.StringType()), ("value", T.StringType()), ("attempt", T.IntegerType()), ("surrogate", T.StringType())))


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting, else one drawn at random for this application."""
    sc = spark.sparkContext
    given = spark.conf.get(KEY_SETTING, None)
    if given:
        return given
    if not hasattr(sc, "_runscope_surrogate_key"):
        sc._runscope_surrogate_key = secrets.token_hex(32)
    return sc._runscope_surrogate_key


def assign(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt, surrogate): no surrogate twice within a kind, none that is a value of the corpus.

    Rounds of attempts over what is still open; almost all settle in the first.  From
    PLAIN on each round draws from ten times as many strings or more, while the values
    stay as many as they are, so the open ones dwindle to none.  Only addresses of
    networks cannot grow; a corpus with nearly all of them raises after LAST rounds.
    """
    settled, pending, attempt = None, found, 0
    while True:
        if attempt > LAST:
            raise ValueError("no free surrogates are left")
        drawn = _drawn(pending, attempt, key)
        taken = found.select("kind", F.col("value").alias("surrogate"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "surrogate"))
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        won = free.withColumn("n", F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("value"))).where("n = 1").drop("n")
        won = materialize(won.select("kind", "value", "attempt", "surrogate"), f"surrogates{attempt}")
        settled = won if settled is None else settled.unionByName(won)
        pending = pending.join(won, ["kind", "value"], "left_anti")
        if pending.isEmpty():
            return settled
        pending = materialize(pending, f"open{attempt}")
        attempt += 1


def pseudonymize(docs: DataFrame, text: str = "text", key: str | None = None, redrawn: int = REDRAWN, kinds: str = "pii_kinds") -> DataFrame:
    """``docs`` with surrogates in the column ``text``, and the kinds replaced in the column ``kinds`` (in order of place).

    A null text stays null and an empty one empty, both without kinds; a text
    without an entity is unchanged; repeated rows get the same text; an empty table
    gives no row; other columns are kept, one named like ``kinds`` is replaced.  The
    key is the session's (``session_key``) if none is given.
    """
    key = key or session_key(docs.sparkSession)
    found = materialize(entities(docs, text), "entities")
    again = materialize(assign(found, key).where("attempt > 0").select("kind", "value", "attempt"), "redrawn")
    keep = [c for c in docs.columns if c != kinds]
    own_hash, again_name = fresh(keep, "own", "again")
    at = keep.index(text)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(kinds, T.ArrayType(T.StringType()))])
    if again.count() <= redrawn:
        shared = {(r["kind"], r["value"]): r["attempt"] for r in again.collect()}
        source = docs.select(*[F.col(f"`{c}`") for c in keep])
    else:
        shared = {}
        own = lambda t: F.md5(F.coalesce(F.col(f"`{t}`"), F.lit("")).cast("binary"))

        def list_entities():
            def run(batch: pa.RecordBatch):
                rows = [(h, k, v) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for _, _, k, v in detect(t)]
                return [[r[k] for r in rows] for k in range(3)]

            return run

        used = map_batches(docs.select(own(text), F.col(f"`{text}`")), list_entities, struct((own_hash, T.StringType()), ("kind", T.StringType()), ("value", T.StringType()))).distinct()
        by_text = used.join(again, ["kind", "value"]).groupBy(own_hash).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(again_name))
        source = docs.select(*[F.col(f"`{c}`") for c in keep], own(text).alias(own_hash)).join(by_text, own_hash, "left").select(*[F.col(f"`{c}`") for c in keep], again_name)

    def make():
        def run(batch: pa.RecordBatch):
            texts = batch.column(at).to_pylist()
            lists = batch.column(len(keep)).to_pylist() if batch.num_columns > len(keep) else [None] * len(texts)
            done = [replace(t, {(x["kind"], x["value"]): x["attempt"] for x in own} if own else shared, key) if t else (t, []) for t, own in zip(texts, lists, strict=True)]
            cols = [batch.column(k) for k in range(len(keep))]
            cols[at] = pa.array([d[0] for d in done], pa.string())
            return [*cols, [d[1] for d in done]]

        return run

    return map_batches(source, make, schema)
