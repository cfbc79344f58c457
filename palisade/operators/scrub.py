"""Finding and hiding credentials in text columns: tests as built-in expressions, redaction by a scanner of telling words."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the refusal contract: names that count as secrets when assigned, and the shapes that are refused.
# A name of the second group hides what is left of a text whose values of the first group are hidden already.
ASSIGNED = (("api[-_]?key", "access[-_]?token", "token", "password", "secret"), ("credential",))
CREDENTIAL_NAMES = "|".join(name for group in ASSIGNED for name in group)
REFUSED = (
    r"://[^/\s:]*:[^/\s]+@",
    rf"(?i)[?&](?:{CREDENTIAL_NAMES})=[^&#\s]+",
    rf"(?i)({CREDENTIAL_NAMES}|authorization)(?:['\"]\s*[:=]|\s*=|\s*:(?=\s|['\"]))",
    r"(?i)authorization['\"]?\s*:\s*[a-z][\w-]*\s+\S",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+",
)
#: Every refused text has a sign of the first kind and one of the second; most texts lack the first, and few have both.
_SIGNED, _TOLD = r"(?i)[:=]|bearer", rf"(?i)://|{CREDENTIAL_NAMES}|authorization|bearer"
HIDDEN, HIDDEN_URI = "<redacted>", "<redacted-uri>"


def decoded(text: Column) -> Column:
    """One percent-decoding pass; `+` stays, and so does text that does not decode."""
    return F.when(F.contains(text, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)).otherwise(text)


def _either(text: Column, test) -> Column:
    """Whether a test holds for a text as it is or decoded once; null counts as no."""
    return F.coalesce(test(text) | (F.contains(text, F.lit("%")) & test(decoded(text))), F.lit(False))


def is_credential_shaped(text: Column) -> Column:
    """Text holds a credential URI or query, an assignment to a secret name, or an Authorization or Bearer value."""
    return _either(text, lambda t: t.rlike(_SIGNED) & t.rlike(_TOLD) & reduce(lambda a, b: a | b, [t.rlike(p) for p in REFUSED]))


def is_credential_identity(text: Column) -> Column:
    """is_credential_shaped, or any `://` with an `@` later on."""
    return is_credential_shaped(text) | _either(text, lambda t: F.contains(t, F.lit("://")) & t.rlike(r"(?s)://.*@"))


def is_clean_identity(text: Column) -> Column:
    """Not blank, trimmed, free of control characters and of credentials; null is not clean."""
    shape = text.rlike(r"^\S(?:[\s\S]*\S)?$") & ~text.rlike(r"[\x00-\x1F\x7F]")
    return F.coalesce(shape, F.lit(False)) & ~is_credential_identity(text)


def display_resource(value: Column) -> Column:
    """A resource without userinfo, query and fragment.

    Hidden after the scheme where an `@` sits elsewhere, or where the value is
    not one URI from its start. Values without `://` stay as they are.
    """
    whole = r"(?s)^(\s*[A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*@)?([^/?#]*)([^?#]*)(.*)$"
    scheme, host, path, tail = (F.regexp_extract(value, whole, i) for i in (1, 3, 4, 5))
    start = F.regexp_extract(value, r"(?s)^(.*?://)", 1)
    odd = F.contains(F.concat(path, tail), F.lit("@")) | value.rlike(r"(?s)['\"].*@") | (F.contains(value, F.lit("%")) & F.contains(F.concat(path, tail), F.lit("%40")))
    encoded = ~F.contains(value, F.lit("://")) & F.contains(value, F.lit("%")) & F.coalesce(F.contains(decoded(value), F.lit("://")), F.lit(False))
    return (
        F.when(encoded, HIDDEN_URI)
        .when(~F.contains(value, F.lit("://")), value)
        .when(~value.rlike(whole) | odd, F.concat(start, F.lit(HIDDEN_URI)))
        .otherwise(F.concat(scheme, host, path))
    )


#: A text without one of these words keeps all it says.
TELLING = rf"(?iu){CREDENTIAL_NAMES}|authorization|bearer"
HEADER, BEARER, FIRST, SECOND = 1, 2, 3, 4
_WORD = re.compile(f"(?=(authorization)|(bearer)|({'|'.join(ASSIGNED[0])})|({'|'.join(ASSIGNED[1])}))", re.I)
_BLANK = re.compile(r"\s*")
#: Where a value ends that is neither quoted nor bracketed, and what a bearer token is made of. The length of what is hidden follows from them.
_STOP = re.compile(r"[\s,}\]]")
_TOKEN = re.compile(r"[A-Za-z0-9._~+/=-]*")


def _words(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, kind) of every telling word, overlapping ones too."""
    return [(m.start(k), m.end(k), k) for m in _WORD.finditer(text) if (k := m.lastindex)]


def _value_at(text: str, end: int) -> int:
    """Where the value begins that a name ending at `end` is assigned: after a quote perhaps, a sign, and blanks. -1: nothing is assigned."""
    if text[end : end + 1] in ("'", '"'):
        end += 1
    end = _BLANK.match(text, end).end()
    if text[end : end + 1] not in (":", "="):
        return -1
    begin = _BLANK.match(text, end + 1).end()
    return begin if begin < len(text) else -1


def _bare_end(text: str, begin: int) -> int:
    m = _STOP.search(text, begin)
    return m.start() if m else len(text)


class Hidden(NamedTuple):
    """A stretch of text of which only `shown` stays."""

    begin: int
    end: int
    shown: str


def _bearers(text: str, words: list[tuple[int, int, int]]) -> list[Hidden]:
    out: list[Hidden] = []
    for begin, end, kind in words:
        if kind != BEARER or (out and begin < out[-1].end) or (begin and (text[begin - 1].isalnum() or text[begin - 1] == "_")):
            continue
        value = _BLANK.match(text, end).end()
        last = _TOKEN.match(text, value).end()
        if end < value < last:
            out.append(Hidden(end, last, f" {HIDDEN}"))
    return out


def _assigned(text: str, words: list[tuple[int, int, int]], kind: int, inside: list[Hidden]) -> list[Hidden]:
    """Stretches from a name on to its value's end. Those of `inside` that a value reaches are part of it, and names within them are gone."""
    out: list[Hidden] = []
    begins = [h.begin for h in inside]
    for begin, end, k in words:
        if k != kind or (out and begin < out[-1].end):
            continue
        at = bisect_right(begins, begin) - 1
        if at >= 0 and begin < inside[at].end:
            continue
        value = _value_at(text, end)
        if value < 0:
            continue
        if text[value] in "'\"[{":
            last = len(text)
        else:
            last, at = _bare_end(text, value), at + 1
            while at < len(inside) and inside[at].begin < last:
                if inside[at].shown[:1] == " ":
                    last = min(last, inside[at].begin)
                    break
                last = max(last, inside[at].end)
                last, at = _bare_end(text, last), at + 1
        if last > value:
            out.append(Hidden(begin, last, f"{text[begin:end]}={HIDDEN}"))
    return out


def _over(outer: list[Hidden], inner: list[Hidden]) -> list[Hidden]:
    """Both in order, without inner ones that begin in an outer one; what such a one hides beyond it stays hidden."""
    out: list[Hidden] = []
    for h in sorted([*outer, *inner]):
        if out and h.begin < out[-1].end:
            if h.end > out[-1].end:
                out.append(Hidden(out[-1].end, h.end, h.shown if h.shown[:1] == " " else ""))
        else:
            out.append(h)
    return out


def redacted(text: str) -> str:
    """A text with the values of headers, bearer tokens and secret names replaced; time is linear in it.

    Telling words are found once. A header's value runs to the end of the
    text, and so does one that begins with a quote or a bracket; a bare one
    ends at white space, a comma or a closing bracket. Names stay.
    """
    words = _words(text)
    for begin, end, kind in words:
        if kind == HEADER and _value_at(text, end) >= 0:
            text = f"{text[:begin]}Authorization={HIDDEN}"
            words = [w for w in words if w[1] <= begin]
            break
    bearers = _bearers(text, words)
    first = _over(_assigned(text, words, FIRST, bearers), bearers)
    stretches = _over(_assigned(text, words, SECOND, first), first)
    out, at = [], 0
    for h in stretches:
        out += (text[at : h.begin], h.shown)
        at = h.end
    return "".join([*out, text[at:]])


def redact_credentials(text: Column) -> Column:
    """redacted() of a text column. Only texts with a telling word leave the JVM, in Arrow batches."""

    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    return F.coalesce(scan(F.when(text.rlike(TELLING), text)), text)


def scrub_free_text(text: Column) -> Column:
    """Every white-space-free run of a text through display_resource, then redact_credentials."""
    runs = F.transform(F.split(text, r"(?<=\s)|(?=\s)", -1), lambda run: F.when(F.contains(run, F.lit("://")), display_resource(run)).otherwise(run))
    return redact_credentials(F.array_join(runs, ""))


def scrub_rows(rows: DataFrame, resources: tuple[str, ...] = (), texts: tuple[str, ...] = (), identities: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows fit to leave, refused rows): columns by role.

    Resource columns are shown without userinfo, free text is scrubbed, and
    rows with a credential-shaped identity are refused whole, with the name of
    the column but never its value.
    """
    bad = F.array_compact(F.array(*[F.when(is_credential_identity(F.col(c)), F.lit(c)) for c in identities])) if identities else F.array().cast("array<string>")
    marked = rows.withColumn("_bad", bad)
    clean = marked.filter(F.size("_bad") == 0).drop("_bad")
    clean = clean.withColumns({c: display_resource(F.col(c)) for c in resources} | {c: scrub_free_text(F.col(c)) for c in texts})
    return clean, marked.filter(F.size("_bad") > 0).select(F.array_join("_bad", ",").alias("refused_columns"))
