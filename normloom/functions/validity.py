"""Legal status: vocabularies, the search predicate and single steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IN_FORCE, AMENDED, REPEALED, SUPERSEDED, NOT_YET = "in_force", "amended", "repealed", "superseded", "not_yet_effective"
#: The codes, classes and labels that sources write for a status. A suspended document counts as repealed.
STATUS_WORDS = {
    IN_FORCE: ("in_force", "chl", "principal", "còn hiệu lực"),
    AMENDED: ("partial", "hhl1p", "hhl1phan", "hết hiệu lực một phần"),
    REPEALED: ("expired", "suspended", "hhl", "tdhl", "repealed", "hết hiệu lực", "tạm dừng hiệu lực"),
    NOT_YET: ("not_yet", "cchl", "tnhl", "chuacohieuluc", "chưa có hiệu lực"),
}
#: Relation labels and the event they mean; any other label is informational.
EVENT_WORDS = {
    AMENDED: ("amends", "amend", "amends_supplements", "corrects", "correction"),
    SUPERSEDED: ("replaces", "replace", "supersedes", "supersede", "superseded"),
    REPEALED: ("repeals", "repeal", "abrogates", "abrogate"),
}
#: Space characters around a value.
_OUTER = " \t\n\v\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _lookup(words: dict[str, tuple[str, ...]], value: Column) -> Column:
    clean, out = F.lower(F.trim(value, F.lit(_OUTER))), F.when(F.lit(False), F.lit(""))
    for result, tokens in words.items():
        out = out.when(clean.isin(*tokens), F.lit(result))
    return out


def map_validity(raw: Column, effective: Column, now: Column) -> Column:
    """A known word decides, whatever its case and outer white space; else the effective date: none or past is in force."""
    return F.coalesce(_lookup(STATUS_WORDS, raw), F.when(effective.isNull() | (effective <= now), F.lit(IN_FORCE)).otherwise(F.lit(NOT_YET)))


def event_kind(label: Column) -> Column:
    """amended, superseded or repealed; null for a label that changes no status."""
    return _lookup(EVENT_WORDS, label)


def current(status: Column) -> Column:
    """Amended law counts as current."""
    return status.isin(IN_FORCE, AMENDED)


def as_of(effective: Column, expiry: Column, moment: Column) -> Column:
    """Effective inclusive, expiry exclusive; an open end is no bound."""
    return (effective.isNull() | (effective <= moment)) & (expiry.isNull() | (expiry > moment))


def predicate(in_force_only: bool = False, moment: Column | None = None, status: str = "validity_status", effective: str = "effective_date", expiry: str = "expiry_date") -> Column:
    """The two independent switches of a search: current law only, and law as of a moment."""
    out = F.lit(True)
    if in_force_only:
        out = out & current(F.col(status))
    if moment is not None:
        out = out & as_of(F.col(effective), F.col(expiry), moment)
    return out


def transition(status: Column, kind: Column) -> Column:
    """One event: repealed absorbs everything and always wins; amended and superseded replace; else nothing changes."""
    return F.when((status == REPEALED) | (kind == REPEALED), F.lit(REPEALED)).when(kind.isin(AMENDED, SUPERSEDED), kind).otherwise(status)
