"""Text statistics and predicates as columns, built-ins only.

Patterns are Java's; where SQL engines with RE2 can run them too they are spelled so that both agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import half_up

# fixed values: code point classes
NON_PRINTABLE = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
CONTROL = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}]"
RTL_LETTER = r"[\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{1E900}-\x{1E95F}&&\p{L}]"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
RARE_CJK = r"[\x{3400}-\x{4DBF}\x{20000}-\x{2EBEF}]"
LATIN1_SUPPLEMENT = r"[\x{A0}-\x{FF}]"
LATIN1_ANCHOR = "[ÃÂâãÐðÞþ]"
LATIN_EXTENDED = r"[\x{100}-\x{24F}\x{1E00}-\x{1EFF}]"
DOT_LEADER = "^[.·•․‥…]{3,}$"
LATEXIT = r"<latexit[^>]*>[A-Za-z0-9+/=\s]{80,}"
DIGRAPH = "LJ"
CURRENCY = "$¥€£"
CELL_SIGNS = ".,()%+-/~·⋅∙×^" + CURRENCY
LINE_SIGNS = ".,()%+-" + CURRENCY
SCORE_WORDS = ("below", "under", "over", "above", "about", "approximately")
ORDINALS = ("st", "nd", "rd", "th")
CAPTION = r"(?i)^(?:fig(?:ure)?\.?|table|tab\.|図|表)\s*[0-9]+"


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def once(value: Column, say: Callable[[Column], Column]) -> Column:
    """What ``say`` makes of a value that is worked out once, however often it is said: a column is worked out at each mention."""
    return F.get(F.transform(F.array(value), say), F.lit(0))


def code_points(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def utf16_units(text: Column) -> Column:
    """Characters as JSON and many viewers count them."""
    return (F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")) / 2).cast("long")


def ratio(part: Column, whole: Column, digits: int | None = 3) -> Column:
    r = F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return r if digits is None else half_up(r, digits)


def non_printable_count(text: Column) -> Column:
    return count(text, NON_PRINTABLE)


def non_printable_ratio(text: Column) -> Column:
    return ratio(non_printable_count(text), code_points(text))


def private_use_count(text: Column) -> Column:
    return count(text, PRIVATE_USE)


def private_use_ratio(text: Column) -> Column:
    return ratio(private_use_count(text), count(text, r"\S"), None)


def replacement_count(text: Column) -> Column:
    return count(text, r"\x{FFFD}")


def letters(text: Column) -> Column:
    return count(text, r"\p{L}")


def rtl_letters(text: Column) -> Column:
    return count(text, RTL_LETTER)


def rtl_dominant(text: Column) -> Column:
    rtl = count(text, r"[\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]")
    return (rtl > 0) & (rtl >= count(text, r"[A-Za-z\x{C0}-\x{24F}]"))


def cjk_leading(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[\x{2E80}-\x{2EFF}\x{3000}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"), F.lit(False))


def has_cjk(text: Column) -> Column:
    """A CJK letter: the scripts are only looked up in texts with a code point from their first block on."""
    return F.coalesce(text.rlike(r"[\x{2E80}-\x{10FFFF}]") & text.rlike(CJK), F.lit(False))


def digraph_samples(text: Column) -> Column:
    """Up to three words of small letters and digits with the capital digraph inside them."""
    words = F.array_distinct(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}\p{N}_]+"))
    small = lambda part: part.rlike(r"^[\p{Ll}\p{Nd}]+$")
    sides = lambda w: F.split(w, DIGRAPH)
    odd = F.filter(words, lambda w: F.contains(w, F.lit(DIGRAPH)) & (F.size(sides(w)) == 2) & F.forall(sides(w), small))
    return F.when(F.contains(text, F.lit(DIGRAPH)), F.slice(odd, 1, 3)).otherwise(F.array().cast("array<string>"))


def cjk_spacing_pairs(text: Column) -> Column:
    """CJK letters that only spaces part from the next one."""
    return count(text, rf"{CJK}(?=[ \t\x{{3000}}]+{CJK})")


def cjk_doubled_pairs(text: Column) -> Column:
    return count(text, rf"({CJK})\1")


def cjk_repeated_run(text: Column, least: int = 8) -> Column:
    """One CJK letter so often in a row, whatever blanks stand between."""
    return F.coalesce(F.translate(text, " \t\u3000", "").rlike(rf"({CJK})\1{{{least - 1}}}"), F.lit(False))


def cjk_mojibake_count(text: Column) -> Column:
    """Extended Latin letters with no Latin neighbour."""
    return count(text, rf"(?<!\p{{IsLatin}}){LATIN_EXTENDED}(?!\p{{IsLatin}})")


def latin1_mojibake(text: Column) -> Column:
    shown, odd = count(text, r"\S"), count(text, rf"[{LATIN1_SUPPLEMENT}&&\S]")
    return F.coalesce((odd >= 4) & (odd / F.greatest(shown, F.lit(1)) >= 0.6) & text.rlike(f"{LATIN1_SUPPLEMENT}{{2}}") & text.rlike(LATIN1_ANCHOR), F.lit(False))


def sequential_extension_run(text: Column, least: int = 8, most_step: int = 4) -> Column:
    """Rare CJK code points that climb by one constant step, ``least`` of them in a row."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: ~c.rlike(r"^\s*$"))
    rare = f"^{RARE_CJK}$"
    code = F.transform(chars, lambda c: F.when(c.rlike(rare), F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("step"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def merge(acc: Column, c: Column) -> Column:
        step = c - acc["last"]
        fits = c.isNotNull() & acc["last"].isNotNull() & (step > 0) & (step <= most_step)
        run = F.when(c.isNull(), 0).when(~F.coalesce(fits, F.lit(False)), 1).when((acc["step"] != 0) & (acc["step"] != step), 2).otherwise(acc["run"] + 1)
        return F.struct(c.alias("last"), F.when(F.coalesce(fits, F.lit(False)), step).otherwise(F.lit(0)).cast("long").alias("step"), run.cast("int").alias("run"), F.greatest(acc["best"], run).cast("int").alias("best"))

    best = F.aggregate(code, start, merge, lambda a: a["best"])
    n_rare = F.size(F.filter(code, lambda c: c.isNotNull()))
    return (n_rare >= least) & (n_rare / F.greatest(F.size(chars), F.lit(1)) >= 0.75) & (best >= least)


def dot_leader_length(text: Column) -> Column:
    """Length of a standalone dotted leader, else null."""
    token = F.regexp_replace(text, r"\s+", "")
    return F.when(token.rlike(DOT_LEADER), F.length(token))


def _class(signs: str) -> str:
    return "0-9" + "".join("\\" + c for c in signs)


def numeric_cell(text: Column) -> Column:
    """A table cell that holds a number, token by token.

    A token is digits and signs, in which a digit may be an ordinal; a word of comparison counts before a
    token that begins with a digit, and a ratio's ``x`` after a digit, at the cell's end.
    """
    own = f"[{_class(CELL_SIGNS)}]"
    tokens = F.split(F.trim(text), r"\s+")
    last = F.size(tokens) - 1
    after = lambda i: F.coalesce(F.get(tokens, i + 1), F.lit(""))
    before = lambda i: F.when(i > 0, F.get(tokens, i - 1)).otherwise("")
    plain = lambda t: t.rlike(f"(?i)^(?:{own}|[0-9](?:{'|'.join(ORDINALS)})(?![\\p{{L}}0-9_]))+$")
    compares = lambda t, i: F.lower(F.regexp_extract(t, f"^{own}*(.*)$", 1)).isin(*SCORE_WORDS) & after(i).rlike("^[0-9]")
    ratio_ = lambda t, i: (i == last) & ((F.lower(t) == "x") & before(i).rlike("[0-9]$") | t.rlike("[0-9][xX]$") & F.regexp_replace(t, "[xX]$", "").rlike(f"^{own}+$"))
    fits = F.transform(tokens, lambda t, i: plain(t) | compares(t, i) | ratio_(t, i))
    return F.coalesce(text.rlike("[0-9]") & F.forall(fits, lambda ok: ok), F.lit(False))


def numeric_line(text: Column) -> Column:
    """A short line of digits, signs and blanks."""
    t = F.trim(text)
    return F.length(t).between(1, 80) & t.rlike("[0-9]") & t.rlike(f"^[{_class(LINE_SIGNS)}\\s]+$")


def currency_only(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) == 1) & F.contains(F.lit(CURRENCY), t)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short_sample(text: Column, most: int = 40) -> Column:
    t = collapsed(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def strip_controls(text: Column) -> Column:
    """Without control characters (tab and line ends stay), nor lines that held nothing else."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    kept = F.filter(lines, lambda s: ~((F.length(s) > 0) & (F.length(F.regexp_replace(s, CONTROL, "")) == 0)))
    return F.regexp_replace(F.array_join(kept, "\n"), CONTROL, "")


def field_name_tokens(name: Column) -> Column:
    """camelCase, snake_case and dotted names as lower-case words."""
    # \p{Alnum} is ASCII: as [^A-Za-z0-9]+ it takes 16 times as long on 8 threads of Java 17
    parts = F.split(name, r"\P{Alnum}+|(?<=[\p{Lower}\p{Digit}])(?=\p{Upper})")
    return F.transform(F.filter(parts, lambda w: F.length(w) > 0), lambda w: F.lower(w))


def flag_names(value: Column, names: list[str]) -> Column:
    """Names of the bits that are set, lowest first."""
    return F.filter(F.array(*[F.when(F.getbit(value, F.lit(i)) == 1, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())


def symbol_ratio(text: Column) -> Column:
    shown = count(text, r"\S")
    return F.when(shown > 0, count(text, r"[^\p{L}\p{N}\s]") / shown).otherwise(F.lit(0.0))
