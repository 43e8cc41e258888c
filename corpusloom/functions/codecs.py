"""Codecs between text and token numbers: characters, bigrams, Hangul syllables, grapheme clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from corpusloom.functions import text as T

#: Hangul arithmetic of the Unicode standard: first syllable, syllables a leading sound, syllables a vowel, number of syllables.
HANGUL, LEAD, VOWEL, SYLLABLES = 0xAC00, 588, 28, 11172


def encode_chars(c: Column, ids: Column) -> Column:
    """Numbers of a text's characters by an array column over code points; unknown characters are dropped."""
    return F.filter(F.transform(T.chars(c), lambda t: F.get(ids, F.ascii(t))), lambda i: i.isNotNull())


def char_numbers(ids: dict[str, int]):
    """A function of a text column: the numbers of its known characters joined by spaces, looked up for a whole text at once."""
    import numpy as np

    @F.pandas_udf(StringType())
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = np.full(1 + max(map(ord, ids), default=0), "", object)
        for c, i in ids.items():
            names[ord(c)] = str(i)

        def one(x: str | None) -> str | None:
            if x is None:
                return None
            points = np.frombuffer(x.encode("utf-32-le"), np.uint32)
            return " ".join(filter(None, names[points[points < len(names)]].tolist()))

        for t in texts:
            yield t.map(one)

    return encode


def decode(numbers: Column, tokens: Column) -> Column:
    """Text of token numbers by an array column whose first entry is number 1; 0 and numbers out of range give nothing."""
    return F.array_join(F.transform(F.filter(numbers, lambda i: (i > 0) & (i <= F.size(tokens))), lambda i: F.element_at(tokens, i)), "")


def greedy_bigrams(c: Column, pairs: list[str]) -> Column:
    """From left to right, a listed pair where one stands, else a character."""
    import re

    return F.regexp_extract_all(c, F.lit("(?s)(" + "|".join([*map(re.escape, pairs), "."]) + ")"), F.lit(1))


def code_point_char(cp: Column) -> Column:
    """The character of a code point of the basic plane."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 4, "0")), "UTF-16BE")


def hangul_parts(c: Column) -> Column:
    """(lead, vowel, tail) numbers of a syllable, tail 0 if it has none; null for other characters."""
    at = F.ascii(c) - HANGUL
    return F.when(at.between(0, SYLLABLES - 1), F.struct(F.floor(at / LEAD).cast("int").alias("lead"), F.floor(at % LEAD / VOWEL).cast("int").alias("vowel"), (at % VOWEL).cast("int").alias("tail")))


def hangul_syllable(lead: Column, vowel: Column, tail: Column) -> Column:
    return code_point_char(F.lit(HANGUL) + lead * LEAD + vowel * VOWEL + tail)


@F.pandas_udf(StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition."""
    for t in texts:
        yield t.str.normalize("NFC")


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition."""
    for t in texts:
        yield t.str.normalize("NFKC")


@F.pandas_udf(ArrayType(StringType()))
def grapheme_clusters(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Extended grapheme clusters; the JVM's own rule differs for Indic scripts."""
    import regex

    split = regex.compile(r"\X").findall
    for t in texts:
        yield t.map(lambda x: None if x is None else split(x))


#: Ranges of code points that vocabularies are made of. Fixed values.
ASCII_MARKS = ((0x20, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0xA3, 0xA3), (0xA5, 0xA5), (0x20AC, 0x20AC))
TYPOGRAPHIC = ((0xAB, 0xAB), (0xBB, 0xBB), (0x2010, 0x2010), (0x2013, 0x2014), (0x2018, 0x2019), (0x201C, 0x201E), (0x2026, 0x2026))
RUPEE = ((0x20B9, 0x20B9),)
DANDA, ABBREVIATION = ((0x964, 0x964),), ((0x970, 0x970),)
#: Scripts of one token a character. Fixed values.
PLAIN = {
    "latin": ((0x20, 0x7E), (0xA1, 0xFF), (0x100, 0x24F), (0x1E00, 0x1EFF), (0x2010, 0x2011), (0x2013, 0x2014), (0x2018, 0x201A), (0x201C, 0x201E), (0x2020, 0x2020), (0x2026, 0x2026), (0x2032, 0x2033)),
    "cyrillic": (*ASCII_MARKS, (0x400, 0x52F), *TYPOGRAPHIC, (0x2011, 0x2011), (0x2020, 0x2020)),
    "greek": (*ASCII_MARKS, (0x370, 0x3FF), (0x1F00, 0x1FFF), *TYPOGRAPHIC),
    "hebrew": (*ASCII_MARKS, (0x591, 0x5C7), (0x5D0, 0x5F4), (0xFB1D, 0xFB4F), *TYPOGRAPHIC),
    "georgian": (*ASCII_MARKS, (0x10A0, 0x10FF), (0x2D00, 0x2D2F), *TYPOGRAPHIC),
    "armenian": (*ASCII_MARKS, (0x531, 0x58F), *TYPOGRAPHIC, (0x2024, 0x2024)),
    "ethiopic": (*ASCII_MARKS, (0x1200, 0x1399), (0x2D80, 0x2DDF), *TYPOGRAPHIC),
    "emoji": ((0x20, 0x7E), (0xAB, 0xAB), (0xBB, 0xBB), *TYPOGRAPHIC),
}
#: Scripts whose clusters have tokens of their own: base characters, and entries of the vocabulary. Fixed values.
FUSED = {
    "arabic": (500, (*ASCII_MARKS, (0x600, 0x6FF), *TYPOGRAPHIC)),
    "bengali": (900, (*ASCII_MARKS, (0x981, 0x9FB), *DANDA, *ABBREVIATION, *TYPOGRAPHIC, *RUPEE, (0x2032, 0x2032))),
    "burmese": (650, (*ASCII_MARKS, (0x1000, 0x109F), *TYPOGRAPHIC)),
    "devanagari": (1000, (*ASCII_MARKS, (0x900, 0x94D), (0x950, 0x956), (0x958, 0x972), (0x979, 0x97F), *TYPOGRAPHIC, *RUPEE, (0x2015, 0x2015))),
    "gujarati": (900, (*ASCII_MARKS, (0xA80, 0xAFF), *TYPOGRAPHIC, *RUPEE)),
    "gurmukhi": (600, (*ASCII_MARKS, (0xA00, 0xA7F), *DANDA, *TYPOGRAPHIC, *RUPEE)),
    "kannada": (550, (*ASCII_MARKS, (0xC80, 0xCFF), *TYPOGRAPHIC, *RUPEE)),
    "khmer": (950, (*ASCII_MARKS, (0x1780, 0x17FF), *TYPOGRAPHIC)),
    "lao": (500, (*ASCII_MARKS, (0xE80, 0xEFF), (0x3001, 0x3001), (0xFF08, 0xFF09), *TYPOGRAPHIC)),
    "malayalam": (900, (*ASCII_MARKS, (0xD01, 0xD57), (0xD5F, 0xD7F), *TYPOGRAPHIC, *RUPEE)),
    "odia": (850, (*ASCII_MARKS, (0xB00, 0xB73), *DANDA, *ABBREVIATION, *TYPOGRAPHIC, *RUPEE)),
    "sinhala": (500, (*ASCII_MARKS, (0xD82, 0xDE5), (0xA0, 0xA0), *TYPOGRAPHIC, *RUPEE)),
    "tamil": (350, (*ASCII_MARKS, (0xB80, 0xBF9), *TYPOGRAPHIC, *RUPEE)),
    "telugu": (950, (*ASCII_MARKS, (0xC00, 0xC7F), *TYPOGRAPHIC, *RUPEE)),
    "thai": (450, (*ASCII_MARKS, (0xE00, 0xE7F), *TYPOGRAPHIC)),
    "tibetan": (550, (*ASCII_MARKS, (0xF00, 0xFFF), (0xFF08, 0xFF08), *TYPOGRAPHIC)),
}
#: The sign that joins consonants, and the first and last consonant that it may stand before. Fixed values.
JOINERS = {
    "devanagari": (0x94D, 0x915, 0x93A),
    "bengali": (0x9CD, 0x995, 0x9B0),
    "gurmukhi": (0xA4D, 0xA15, 0xA39),
    "gujarati": (0xACD, 0xA95, 0xAB0),
    "odia": (0xB4D, 0xB15, 0xB39),
    "kannada": (0xCCD, 0xC95, 0xCB9),
    "telugu": (0xC4D, 0xC15, 0xC39),
    "malayalam": (0xD4D, 0xD15, 0xD39),
    "tamil": (0xBCD, 0xB95, 0xBB9),
    "sinhala": (0xDCA, 0xD9A, 0xDC6),
    "khmer": (0x17D2, 0x1780, 0x17A2),
    "burmese": (0x1039, 0x1000, 0x1021),
}
#: What the Korean and the ideograph vocabulary have besides, their entries, and the numbers of second halves. Fixed values.
KOREAN_BASE, KOREAN_SIZE = (*ASCII_MARKS, (0x3000, 0x303F), (0x2018, 0x201F), *TYPOGRAPHIC), 1500
HAN_BASE, HAN_SIZE, HALVES = (*ASCII_MARKS, (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), *TYPOGRAPHIC), 4000, 24
#: First tail of a syllable; a syllable has 27 of them or none.
TAIL, TAILS = 0x11A8, 27


def characters(*ranges: tuple[int, int]) -> list[str]:
    """The assigned characters of ranges in order, each once, without controls."""
    import unicodedata

    points = sorted({p for a, b in ranges for p in range(a, b + 1)})
    return [chr(p) for p in points if unicodedata.category(chr(p)) not in ("Cn", "Cc")]


def joined_consonants(script: str) -> list[str]:
    """The joining sign of a script before each of its assigned consonants."""
    if script not in JOINERS:
        return []
    sign, first, last = JOINERS[script]
    return [chr(sign) + c for c in characters((first, last))]


@dataclass(frozen=True)
class Codec:
    """Tokens in order of their numbers from 1; 0 is the blank.

    spelled: characters without a token that two numbers stand for. joined: pairs of numbers that are read as one character. clusters:
    a text is cut into grapheme clusters, and one without a token into its characters. spare: numbers beyond the tokens.
    What has no number at all is dropped.
    """

    tokens: tuple[str, ...] = ()
    form: str = "NFC"
    clusters: bool = False
    spelled: dict = field(default_factory=dict)
    joined: dict = field(default_factory=dict)
    spare: int = 0

    @property
    def size(self) -> int:
        """Entries of the vocabulary, the blank included; 0 for no vocabulary."""
        return len(self.tokens) + self.spare + 1 if self.tokens else 0

    def numbers(self) -> dict[str, int]:
        return {t: i + 1 for i, t in enumerate(self.tokens)}


def plain_codec(script: str) -> Codec:
    return Codec(tuple(characters(*PLAIN[script])))


def fused_codec(script: str, clusters: list[str] = ()) -> Codec:
    """Base characters, then joined consonants, then `clusters` in their order, as many as fit."""
    most, ranges = FUSED[script]
    base = characters(*ranges)
    own = [c for c in clusters if len(c) > 1 and set(c) <= set(base)]
    more = list(dict.fromkeys([*joined_consonants(script), *own]))[: max(0, most - 1 - len(base))]
    return Codec((*base, *more), clusters=True)


def hangul_codec(frequent: list[str] = ()) -> Codec:
    """Marks, tails, syllables without a tail, and frequent syllables with one; the others are spelled as syllable and tail."""
    base, tails = characters(*KOREAN_BASE), [chr(TAIL + i) for i in range(TAILS)]
    open_ = [chr(HANGUL + i) for i in range(0, SYLLABLES, VOWEL)]
    tokens = (*base, *tails, *open_, *list(frequent)[: max(0, KOREAN_SIZE - 1 - len(base) - TAILS - len(open_))])
    number = {t: i + 1 for i, t in enumerate(tokens)}
    pairs = {chr(ord(s) + 1 + t): (number[s], number[tails[t]]) for s in open_ for t in range(TAILS)}
    return Codec(tokens, spelled={c: p for c, p in pairs.items() if c not in number}, joined={p: c for c, p in pairs.items()})


def han_codec(frequent: list[str] = (), alike: dict[str, tuple[int, str]] | None = None) -> Codec:
    """Marks, kana, radicals, frequent ideographs; others are spelled as a look-alike and one of HALVES numbers: alike gives (which, look-alike)."""
    import unicodedata

    radicals = [(ord(c), ord(c)) for c in (unicodedata.normalize("NFKC", chr(p)) for p in range(0x2F00, 0x2FD6))]
    base = characters(*HAN_BASE, *radicals)
    tokens = (*base, *(c for c in frequent if c not in set(base)))
    number = {t: i + 1 for i, t in enumerate(tokens)}
    pairs = {c: (number[leaf], len(tokens) + 1 + which) for c, (which, leaf) in (alike or {}).items() if leaf in number}
    return Codec(tokens, "NFKC", spelled={c: p for c, p in pairs.items() if c not in number}, joined={p: c for c, p in pairs.items()}, spare=HALVES)


def codec_of(script: str, clusters: list[str] = (), alike: dict[str, tuple[int, str]] | None = None) -> Codec:
    """The codec of a script; `clusters` are its frequent tokens. Of an unknown script one that encodes nothing."""
    if script in PLAIN:
        return plain_codec(script)
    if script in FUSED:
        return fused_codec(script, clusters)
    return hangul_codec(clusters) if script == "korean" else han_codec(clusters, alike) if script == "han_kana" else Codec()


def encoder(codecs: dict[str, Codec]):
    """A function of (text, script): the numbers of a text by its script's codec; of an unknown script none."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import unicodedata

        import regex

        split = regex.compile(r"\X").findall
        known = {s: c.numbers() for s, c in codecs.items()}

        def one(text: str | None, script: str | None) -> list[int] | None:
            if text is None:
                return None
            codec, number, out = codecs.get(script, Codec()), known.get(script, {}), []
            text = unicodedata.normalize(codec.form, text)
            for piece in split(text) if codec.clusters else text:
                if piece in number:
                    out.append(number[piece])
                elif piece in codec.spelled:
                    out += codec.spelled[piece]
                elif codec.clusters:
                    out += (number[c] for c in piece if c in number)
            return out

        for texts, scripts in parts:
            yield pd.Series([one(t, s) for t, s in zip(texts, scripts, strict=True)], dtype=object)

    return encode


def decoder(codecs: dict[str, Codec]):
    """A function of (numbers, script): the text; the blank and numbers out of range give nothing."""

    @F.pandas_udf(StringType())
    def decode_(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(numbers, script: str | None) -> str | None:
            if numbers is None:
                return None
            codec, out, held = codecs.get(script, Codec()), [], None
            for n in map(int, numbers):
                if held is not None and (held, n) in codec.joined:
                    out[-1], held = codec.joined[held, n], None
                else:
                    out.append(codec.tokens[n - 1] if 0 < n <= len(codec.tokens) else "")
                    held = n
            return "".join(out)

        for numbers, scripts in parts:
            yield pd.Series([one(x, s) for x, s in zip(numbers, scripts, strict=True)], dtype=object)

    return decode_


def broken_trips(rows, codecs: dict[str, Codec], text: str = "text", script: str = "script"):
    """Rows whose text isn't what decoding its numbers gives."""
    back = decoder(codecs)(encoder(codecs)(F.col(text), F.col(script)), F.col(script))
    return rows.withColumn("decoded", back).filter(~F.col("decoded").eqNullSafe(F.col(text)))


def strict_numbers(tokens: Column, ids: Column) -> Column:
    """Numbers of tokens by a map column; a token that isn't in it is an error that names it."""
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(ids, t), F.raise_error(F.concat(F.lit("not in the vocabulary: "), t)).cast("int")))


def padded_numbers(numbers: Column, width: Column) -> Column:
    """Numbers followed by blanks up to a width."""
    return F.concat(numbers, F.array_repeat(F.lit(0), F.greatest(width - F.size(numbers), F.lit(0))))


def merged_tails(syllables: Column) -> Column:
    """An array of characters in which a syllable without a tail and the tail after it are one: looks one element ahead."""
    tail = lambda c: F.ascii(c).between(TAIL, TAIL + TAILS - 1)
    opens = lambda c: F.ascii(c).between(HANGUL, HANGUL + SYLLABLES - 1) & ((F.ascii(c) - HANGUL) % VOWEL == 0)
    after = lambda i: F.coalesce(F.get(syllables, i + 1), F.lit(""))
    before = lambda i: F.coalesce(F.get(syllables, i - 1), F.lit(""))
    merged = F.transform(syllables, lambda c, i: F.when(opens(c) & tail(after(i)), code_point_char(F.ascii(c) + F.ascii(after(i)) - TAIL + 1)).when(tail(c) & opens(before(i)), F.lit("")).otherwise(c))
    return F.filter(merged, lambda c: c != "")


def renderable(tokens, token: str, fused: bool = False):
    """Tokens that can be drawn alone: no blanks or controls, and of scripts without clusters no marks that need a letter."""
    own = tokens.filter((F.trim(token) != "") & (F.ascii(token) > 32))
    return own if fused else own.filter(~F.col(token).rlike(r"^[\p{M}\s\xa0]"))


def cluster_codec(ids: dict[str, int]):
    """A function of a text column: a cluster's number, else those of its known code points."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        import regex

        split = regex.compile(r"\X").findall
        for t in texts:
            yield t.map(lambda x: None if x is None else [i for c in split(unicodedata.normalize("NFC", x)) for i in ([ids[c]] if c in ids else [ids[p] for p in c if p in ids])])

    return encode
