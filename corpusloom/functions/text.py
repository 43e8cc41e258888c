"""Column functions over text: words, characters, n-grams, scripts, tags. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scripts import SCRIPTS, members
from corpusloom.functions.scripts import script as script  # noqa: PLC0414

#: What separates words, as a Java character class: white space, digits, ASCII and some typographic punctuation, zero-width marks.
GAPS = r"\s\x0b\d\p{Punct} ¡«»¿​-‍‐-‧"
def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s​-‍]+|[\s​-‍]+$", "")


def words(c: Column, least: int = 2, most: int = 15) -> Column:
    """The words of a text with so many characters."""
    return F.filter(F.split(c, f"[{GAPS}]+"), lambda w: F.length(w).between(least, most))


def word_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each word of `text`."""
    return docs.select(*keep, F.explode(words(F.col("text"))).alias("word"))


def chars(c: Column) -> Column:
    """The code points of a text."""
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def bigrams(word: Column) -> Column:
    """Overlapping pairs of characters."""
    return F.when(F.length(word) > 1, F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def in_script(word: Column, script: str) -> Column:
    """At least one character of the script, and no letter of another."""
    own = members(SCRIPTS[script])
    return word.rlike(f"[{own}]") & ~word.rlike(rf"[\p{{L}}&&[^{own}]]")


#: What a token is stripped of at both ends, and what the stricter rules strip as well. Fixed values.
ENDS = ".,;:!?-()[]{}\"'/\\«»“”‘’…–—•·"
ENDS_BESIDE = {"plain": "", "underscore": "_", "digits": "_0123456789"}
#: What separates tokens, as a class for Java and RE2 alike: white space, digits, ASCII marks but the underscore, some typographic marks, zero-width ones.
SEPARATORS = r"\s\x0b\x1c-\x1f\x85\xa0\d.,;:!?\-()\[\]{}\"'/\\@#$%^&*+=<>|~`…–—•·«»“”‘’\x{200B}-\x{200F}\x{FEFF}"
#: What a word of running text is stripped of at both ends. Fixed values.
RUNNING_ENDS = ".,;:!?()[]{}\"“”'‘’«»—–-/\\|@#$%^&*+=<>~`"


def stripped(c: Column, chars: str) -> Column:
    """Without any of the characters at both ends."""
    return F.btrim(c, F.lit(chars))


def tokens(c: Column, ends: str = "plain", least: int = 2, most: int = 15) -> Column:
    """Different tokens of a text between separators, stripped by a rule, within length and not beginning with a digit."""
    cut = F.transform(F.split(c, f"[{SEPARATORS}]+"), lambda w: stripped(w, ENDS + ENDS_BESIDE[ends]))
    return F.array_distinct(F.filter(cut, lambda w: F.length(w).between(least, most) & ~w.rlike(r"^\p{Nd}")))


def running_words(c: Column, script: str, most: int = 50) -> Column:
    """Words of a script in running text: between white space and zero-width marks, stripped, of 1 to `most` characters."""
    cut = F.transform(F.split(c, r"[\s\x0b\x1c-\x1f\x85\x{200B}-\x{200D}\xa0]+"), lambda w: stripped(w, RUNNING_ENDS))
    return F.filter(cut, lambda w: F.length(w).between(1, most) & in_script(w, script))


def clean_word(c: Column) -> Column:
    """Without white space, then without punctuation at both ends."""
    return stripped(strip(c), ENDS)


#: What stands between the parts of a title: dashes of any kind, slashes, the middle dot, commas of two scripts, white space.
TITLE_GAPS = r"[\p{Pd}/·,、\s]+"


def title_parts(title: Column) -> Column:
    """A title without what is in brackets, and the parts of it."""
    plain = strip(F.regexp_replace(title, r"\([^()]*\)", ""))
    return F.array_distinct(F.filter(F.concat(F.array(plain), F.split(plain, TITLE_GAPS)), lambda x: x != ""))


def wiki_links(markup: Column) -> Column:
    """Targets of links `[[target]]` and `[[target|label]]`, trimmed, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(markup, F.lit(r"\[\[([^\]|]+)"), F.lit(1)), lambda x: F.trim(x)))


def table_cells(html: Column, least: int = 2, most: int = 15) -> Column:
    """Text of table cells of so many characters that ends the cell."""
    return F.regexp_extract_all(html, F.lit(rf">([^<>]{{{least},{most}}})</td>"), F.lit(1))


def md5_mod(c: Column, modulus: int = 1000) -> Column:
    """The 128-bit MD5 of a string modulo a small number, by its four 32-bit words."""
    h, step, out = F.md5(c), (1 << 32) % modulus, F.lit(0)
    for i in range(4):
        out = (out * step + F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")) % modulus
    return out
