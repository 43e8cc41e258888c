"""Writing systems: code-point ranges, groups, detection by majority, and checks of words. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inclusive ranges of code points by script, in order of precedence. Fixed values.
SCRIPTS: dict[str, tuple[tuple[int, int], ...]] = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "cyrillic": ((0x400, 0x4FF), (0x500, 0x52F)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "han_kana": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3000, 0x303F), (0xFF00, 0xFFEF)),
    "korean": ((0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F)),
    "odia": ((0xB00, 0xB7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "burmese": ((0x1000, 0x109F),),
    "khmer": ((0x1780, 0x17FF),),
    "armenian": ((0x530, 0x58F),),
    "georgian": ((0x10A0, 0x10FF), (0x2D00, 0x2D2F)),
    "ethiopic": ((0x1200, 0x137F), (0x1380, 0x139F), (0x2D80, 0x2DDF)),
    "tibetan": ((0xF00, 0xFFF),),
    "emoji": ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF), (0x2600, 0x26FF), (0x2700, 0x27BF)),
}
#: Groups in order of their numbers, and their scripts in order of theirs. Fixed values.
GROUPS: dict[str, tuple[str, ...]] = {
    "latin": ("latin",),
    "cyrillic_greek": ("cyrillic", "greek"),
    "arabic": ("arabic",),
    "hebrew": ("hebrew",),
    "sino_japanese": ("han_kana",),
    "korean": ("korean",),
    "ne_indic": ("devanagari", "gurmukhi", "gujarati", "bengali", "odia"),
    "south_indic": ("kannada", "telugu", "malayalam", "tamil", "sinhala"),
    "se_asian": ("thai", "lao", "burmese", "khmer"),
    "emoji": ("emoji",),
    "caucasus": ("armenian", "georgian"),
    "ethiopic": ("ethiopic",),
    "tibetan": ("tibetan",),
}
#: (script, group, script_id, group_id, local_id) in order of script_id.
MEMBERS = [(s, g, 0, gi, k) for gi, (g, of) in enumerate(GROUPS.items()) for k, s in enumerate(of)]
MEMBERS = [(s, g, i, gi, k) for i, (s, g, _, gi, k) in enumerate(MEMBERS)]
DEFAULT = "latin"
#: Characters inside the ranges that never count: ASCII brackets and marks, and white space.
SILENT = (0x5B, 0x5C, 0x5D, 0x5E, 0x7B, 0x7D, 0x85, 0xA0, 0x3000)
#: Names of scripts in other collections. Fixed values.
OTHER_NAMES = {"hindi": "devanagari", "bangla": "bengali", "gurumukhi": "gurmukhi", "punjabi": "gurmukhi", "oriya": "odia", **{s: s for s in ("gujarati", "kannada", "malayalam", "odia", "tamil", "telugu", "devanagari", "bengali")}}
#: Ideographs of both blocks, and kana.
HAN, KANA = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}", r"\x{3040}-\x{30FF}"
#: Code points of the two blocks of ideographs.
UNIFIED, EXTENSION = 20992, 6592


def without(ranges: tuple[tuple[int, int], ...], gone: tuple[int, ...] = SILENT) -> list[tuple[int, int]]:
    """The ranges cut at some code points."""
    out = []
    for first, last in ranges:
        for g in sorted(x for x in gone if first <= x <= last):
            if g > first:
                out.append((first, g - 1))
            first = g + 1
        if first <= last:
            out.append((first, last))
    return out


def members(ranges) -> str:
    """Ranges as the inside of a character class, for Java and RE2 alike."""
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


def script(c: Column) -> Column:
    """The script of most characters; of equals the one seen first; without any, the default. White space, digits and ASCII punctuation don't count."""
    votes = []
    for name, ranges in SCRIPTS.items():
        own = f"[{members(without(ranges))}]"
        votes.append(F.struct((F.length(c) - F.length(F.regexp_replace(c, own, ""))).alias("n"), (-F.regexp_instr(c, F.lit(own))).alias("first"), F.lit(name).alias("script")))
    best = F.array_max(F.filter(F.array(*votes), lambda v: v["n"] > 0))
    others = "".join(members(r) for s, r in SCRIPTS.items() if s != DEFAULT)
    return F.when(c.rlike(f"[{others}]"), F.coalesce(best["script"], F.lit(DEFAULT))).otherwise(DEFAULT)


def placed(script: Column) -> Column:
    """(group, script_id, group_id, local_id) of a script; of an unknown one those of the default."""
    known = F.create_map(*(x for s, g, i, gi, k in MEMBERS for x in (F.lit(s), F.struct(F.lit(g).alias("group"), F.lit(i).alias("script_id"), F.lit(gi).alias("group_id"), F.lit(k).alias("local_id")))))
    return F.coalesce(F.try_element_at(known, script), F.try_element_at(known, F.lit(DEFAULT)))


def allowed(names: list[str]) -> list[tuple[int, int]]:
    """(group_id, local_id) of scripts that decoding is restricted to; an unknown name is an error."""
    places = {s: (gi, k) for s, _, _, gi, k in MEMBERS}
    if unknown := sorted(set(names) - set(places)):
        raise ValueError(f"unknown scripts: {', '.join(unknown)}")
    return sorted({places[n] for n in names})


def only_script(c: Column, name: str) -> Column:
    """Nothing but characters of the script, printable ASCII, separators, punctuation and decimal digits."""
    return c.rlike(rf"^[\x20-\x7E\p{{Z}}\p{{P}}\p{{Nd}}{members(SCRIPTS[name])}]*$")


def has_script(c: Column, name: str) -> Column:
    return c.rlike(f"[{members(SCRIPTS[name])}]")


def assigned(c: Column) -> Column:
    """No code point that this machine's Unicode version doesn't know."""
    return ~c.rlike(r"\p{Cn}")


def list_word(c: Column, name: str) -> Column:
    """A word for a script's list: 2 to 15 characters, at least one of the script, none of another, all assigned."""
    return F.length(c).between(2, 15) & has_script(c, name) & only_script(c, name) & assigned(c)


def has_han(c: Column) -> Column:
    return c.rlike(f"[{HAN}]")


def has_kana(c: Column) -> Column:
    return c.rlike(f"[{KANA}]")


def han_chars(c: Column) -> Column:
    """Different ideographs of a text, in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"[{HAN}]"), F.lit(0)))


def cjk_word(c: Column) -> Column:
    """2 to 15 characters with an ideograph or kana."""
    return F.length(c).between(2, 15) & (has_han(c) | has_kana(c))


def word_list_of(c: Column) -> Column:
    """Which list a new word goes to: kana alone to the Japanese one, all else to the common one."""
    return F.when(has_kana(c) & ~has_han(c), "japanese").otherwise("han_kana")


def normal_name(c: Column) -> Column:
    """The script that another collection's name of a folder means; null if it means none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in OTHER_NAMES.items() for x in kv)), F.lower(c))
