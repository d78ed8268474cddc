"""Phone columns: candidate evidence, list rejection, normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from .text import pin, strip

PHONE = "(?iU)" + rules.PHONE


def _cue_before() -> str:
    """Look-behind for a cue word and separators within the cue window."""
    return "(?<=" + "|".join(
        f"{cue}{rules.PHONE_CUE_SEPARATOR}{{0,{rules.PHONE_CUE_WINDOW - len(cue.replace(chr(92), ''))}}}"
        for cue in rules.PHONE_CUES) + ")"


#: A phone right after a cue word.  The cheap look-ahead comes first, so the
#: look-behind is only tried where a number may start.
CUED_PHONE = r"(?iU)(?=[+\d])" + _cue_before() + rules.PHONE


#: The shape of a phone with the five blanks that engines without look-around know; \s has the vertical tab too.
OWN_PHONE_BODY = rules.PHONE_BODY.replace(r"[\s", r"[ \t\n\f\r").replace(r"\s*", r"[ \t\n\f\r]*")
#: A phone together with the characters around it.
OWN_PHONE = r"(?i)(?:\A|[^\p{L}\p{N}_.])(" + OWN_PHONE_BODY + r")(?:\z|[^\p{L}\p{N}_.])"


def phone_runs(text: Column, own_borders: bool = False) -> Column:
    """Digit runs shaped like phone numbers.

    With ``own_borders`` two runs do not share the character between them, as
    in searches of engines without look-around: of ``A +B`` with one blank,
    ``A`` and then ``B`` is found.
    """
    return F.regexp_extract_all(text, F.lit(OWN_PHONE if own_borders else PHONE), F.lit(1 if own_borders else 0))


def has_own_evidence(raw: Column) -> Column:
    """True for a number with an international prefix or several digit groups."""
    return raw.rlike(r"^\s*(?:\+|00)") | raw.rlike(r"(?U)\d[^\d]+\d") | raw.contains("(")


def dialable_runs(text: Column) -> Column:
    """Digit runs with a sign of being a phone number: their own shape or a cue word before them."""
    cued = F.regexp_extract_all(text, F.lit(CUED_PHONE), F.lit(0))
    return F.filter(phone_runs(text), lambda r: has_own_evidence(r) | F.array_contains(cued, r))


def looks_like_number_list(raw: Column) -> Column:
    """True for dates, identifiers, addresses of hosts and rows of figures."""
    s = strip(raw)
    groups = F.regexp_extract_all(raw, F.lit(r"(?U)\d+"), F.lit(0))
    lengths = F.transform(groups, F.length)
    total = F.length(F.regexp_replace(raw, r"(?U)[^\d]", ""))
    uniform = F.size(F.array_distinct(lengths)) == 1
    first = F.get(lengths, F.lit(0))
    prefixed = s.rlike(r"^(?:\+|00)")
    return (
        s.rlike(r"(?U)^(?:19|20)\d{2}\s*[-/]\s*\d")
        | s.rlike(r"(?U)^\d{1,2}\s*[-/.]\s*\d{1,2}\s*[-/.]\s*(?:(?:19|20)\d{2}|\d{2})$")
        | s.rlike(r"(?U)^\d{1,3}(?:\.\d{1,3}){2,3}$")
        | (F.size(groups) > 5)
        | ((total > 12) & ~prefixed)
        | ((F.size(groups) >= 4) & uniform & (first >= 3) & (total > 12))
        | ((F.size(groups) >= 4) & uniform & (first == 2) & ~s.rlike(r"^[+0]")))


def with_normalised_phone(df: DataFrame, raw: str, out: str, whole: Column | None = None) -> DataFrame:
    """Add the normal form ``+digits`` or ``digits``, with `` xN`` for an extension.

    Null for anything that cannot be a phone number.  Where ``whole`` holds,
    the digits of an extension count as digits of the number.
    """
    c = F.col
    keep = list(df.columns)
    spaced = F.regexp_replace(strip(c(raw)), r"(?iU)\s*(?:ext|x|extn|poste)\.?\s*(\d{1,5})\s*$",
                              " x$1")
    df = df.withColumns({"__l": looks_like_number_list(c(raw)), "__t": spaced})
    cut = F.instr(c("__t"), " x")
    body = F.when(cut > 0, F.substring_index(c("__t"), " x", 1)).otherwise(c("__t"))
    digits = F.regexp_replace(F.regexp_replace(body, r"(?U)[^\d+]", ""), "^00", "+")
    if whole is not None:
        cut = F.when(whole, F.lit(0)).otherwise(cut)
        # two zeros apart are no prefix there
        digits = F.when(whole, F.regexp_replace(F.regexp_replace(c(raw), "^00", "+"), r"[^\d+]", "")).otherwise(digits)
    df = df.withColumns({
        "__x": F.when(cut > 0, F.concat(F.lit(" x"), strip(F.substr(c("__t"), cut + 2))))
                .otherwise(F.lit("")),
        "__d": digits, "__c": F.regexp_replace(digits, r"^\++", "")})
    core, n = c("__c"), F.length(c("__c"))
    ok = (~c("__l") & core.rlike(r"(?U)^\d+$") & n.between(7, 15)
          & ~(c("__d").startswith("+") & (n < 10))
          & (F.size(F.array_distinct(F.split(core, ""))) > 2)
          & ~(core.rlike("^(?:19|20)") & n.isin(8, 10)))
    return pin(df, out, F.when(ok, F.concat(
        F.when(c("__d").startswith("+"), F.lit("+")).otherwise(F.lit("")), core, c("__x"),
    ))).select(*keep, out)
