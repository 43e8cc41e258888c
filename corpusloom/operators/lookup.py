"""Dimension lookups, masks, checks and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import scripts as S
from corpusloom.functions import text as T


#: Rows of a dimension that are broadcast at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def local_ids(members: DataFrame, group: str, member: str) -> DataFrame:
    """(group, member, group_id, member_id, local_id): numbers of groups, of members, and of members inside their group, from 0. For dimensions, which are small."""
    number = lambda *by: F.row_number().over(Window.orderBy(*by)) - 1
    groups = members.select(group).distinct().withColumn("group_id", number(group))
    every = members.select(group, member).distinct()
    return every.join(groups, group).withColumns({"member_id": number(group, member), "local_id": F.row_number().over(Window.partitionBy(group).orderBy(member)) - 1})


def looked_up(rows: DataFrame, dimension: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """The rows with the dimension's value, or the default where it has none."""
    few = dimension.select(key, value)
    return rows.join(F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def covering(items: DataFrame, holders: DataFrame, item: str, holder: str, member: str) -> DataFrame:
    """(item, holder): holders that have every member of the item (relational division)."""
    need = items.groupBy(item).agg(F.count_distinct(member).alias("need"))
    have = items.select(item, member).distinct().join(holders.select(holder, member).distinct(), member).groupBy(item, holder).agg(F.count(F.lit(1)).alias("have"))
    return have.join(need, item).filter("have = need").select(item, holder)


def holders_of(rows: DataFrame, member: str, holder: str) -> DataFrame:
    """(member, holders): the sorted holders of each member, joined by commas. Holders are a dimension."""
    return rows.groupBy(member).agg(F.array_join(F.array_sort(F.collect_set(holder)), ",").alias("holders"))


def issues(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, issue): a row for each check that holds."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))
    return rows.select(key, F.explode(found).alias("issue"))


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key alone: the same on every run and partitioning."""
    return T.md5_mod(F.concat(key.cast("string"), F.lit(":" + salt)), 1000) / F.lit(1000.0)


def weighted_pick(key: Column, weights: dict[str, float], salt: str) -> Column:
    """One of the names, drawn by weight."""
    total, at, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        at += w / total
        hit = F.when(uniform(key, salt) < round(at, 12), name) if out is None else out.when(uniform(key, salt) < round(at, 12), name)
        out = hit
    return out.otherwise(list(weights)[-1])


def contrast(values: Column, least: float) -> Column:
    """Entries that differ by more than `least` from the mean of the middle two of the first, second, last and last but one."""
    ends = F.array_sort(F.array(F.element_at(values, 1), F.element_at(values, 2), F.element_at(values, -2), F.element_at(values, -1)))
    middle = (F.element_at(ends, 2).cast("double") + F.element_at(ends, 3)) / 2
    return F.size(F.filter(values, lambda x: F.abs(x.cast("double") - middle) > least))


def first_match(rows: DataFrame, files: DataFrame, stem: str, path: str, endings: list[str]) -> DataFrame:
    """(..., path) of rows that have a file: of several, the one whose ending comes first in the list."""
    turn = F.array_position(F.array(*map(F.lit, endings)), F.concat(F.lit("."), F.lower(F.element_at(F.split(path, r"\."), -1))))
    found = files.select(F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1).alias(stem), path, turn.alias("_t")).filter("_t > 0")
    best = found.groupBy(stem).agg(F.min_by(path, F.struct("_t", path)).alias(path))
    return rows.join(best, stem)


def members_of(active: DataFrame, script: str, group: str) -> DataFrame:
    """(script) of the active scripts that belong to a group."""
    return active.filter(S.placed(F.col(script))["group"] == group).select(script)


def vocabulary_table(sizes: DataFrame) -> DataFrame:
    """(group_id, group, scripts, sizes) of rows (script, size): names and sizes in order of a group's scripts."""
    at = sizes.withColumn("p", S.placed(F.col("script")))
    whole = at.groupBy(F.col("p.group_id").alias("group_id"), F.col("p.group").alias("group")).agg(F.array_sort(F.collect_list(F.struct(F.col("p.local_id").alias("k"), "script", "size"))).alias("x"))
    return whole.select("group_id", "group", F.transform("x", lambda v: v["script"]).alias("scripts"), F.transform("x", lambda v: v["size"]).alias("sizes"))


#: Words of file names of handwriting and of display fonts. Fixed values.
HANDWRITING = ("caveat", "dancing", "indie", "patrick", "kalam", "nanumpen", "chilanka", "handwrit", "cursive")
DISPLAY = ("permanent", "amatic", "lobster", "pacifico", "special", "display", "condensed")
#: Share of samples and kind of fonts of each style. Fixed values.
STYLES = {"clean": (0.10, "regular"), "printed": (0.35, "regular"), "handwritten": (0.25, "handwriting"), "signage": (0.20, "display"), "degraded": (0.10, "all")}


def styled_fonts(fonts: DataFrame, script: str, path: str, kind: str, least: int = 5) -> DataFrame:
    """Fonts of each script that fit a kind: all, regular, handwriting or display. Where fewer than `least` do, the regular ones; where there are none, all."""
    if kind == "all":
        return fonts
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    rows = fonts.withColumn("_hand", name.rlike("|".join(HANDWRITING))).withColumn("_show", name.rlike("|".join(DISPLAY)))
    regular = ~F.col("_hand") & ~F.col("_show")
    rows = rows.withColumn("_fits", {"regular": regular, "handwriting": F.col("_hand"), "display": F.col("_show")}[kind]).withColumn("_regular", regular)
    counts = rows.groupBy(script).agg(F.count_distinct(F.when(F.col("_fits"), F.col(path))).alias("_n"), F.count_if("_regular").alias("_r"))
    chosen = F.when(F.col("_n") >= least, F.col("_fits")).when(F.col("_r") > 0, F.col("_regular")).otherwise(True)
    return rows.join(F.broadcast(counts), script).filter(chosen).select(*fonts.columns)  # a row a script


def shares_any(a: Column, b: Column) -> Column:
    """Whether two arrays have an entry in common; false where either is null or empty."""
    return F.coalesce(F.arrays_overlap(F.array_compact(a), F.array_compact(b)), F.lit(False))


def combined(spark: SparkSession, *parts: list[str]) -> DataFrame:
    """(word): every choice of one entry from each of some short lists, joined (consonants, vowels, tones)."""
    rows = spark.range(1).select(F.lit("").alias("word"))
    for some in parts:
        rows = rows.select("word", F.explode(F.array(*map(F.lit, some)).cast("array<string>")).alias("part")).select(F.concat("word", "part").alias("word"))
    return rows


def fonts_of_chars(fonts: DataFrame, chars: DataFrame, char: str, font: str) -> DataFrame:
    """(char, fonts): for each character that any font has, its fonts in order, as often as they are listed."""
    return chars.select(char).distinct().join(fonts, char).groupBy(char).agg(F.array_sort(F.collect_list(font)).alias("fonts"))


def chosen_languages(rows: DataFrame, lang: str, only: list[str] | None = None, skip: list[str] = ("en",)) -> DataFrame:
    """Rows of the languages asked for, or of all; in both cases without those to skip."""
    kept = rows.filter(~F.col(lang).isin(list(skip)))
    return kept.filter(F.col(lang).isin(only)) if only else kept


def label_bounds(rows: DataFrame, label: str, least: int | None = 1, most: int | None = 50) -> DataFrame:
    """Rows whose trimmed label has so many characters; None is no bound."""
    n = F.length(T.strip(F.col(label)))
    kept = rows if least is None else rows.filter(n >= least)
    return kept if most is None else kept.filter(n <= most)


def filler_words(spark, scripts: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(script, word) of scripts given by their consonants, signs and joining sign: consonant and sign, two joined consonants, and each sign of the block between consonants.

    Products of short strings, made by exploding one row a script.
    """
    rows = spark.createDataFrame([(k, *v) for k, v in scripts.items()], "script string, consonants string, signs string, joiner string")
    parts = rows.select("script", T.chars(F.col("consonants")).alias("c"), T.chars(F.col("signs")).alias("v"), "joiner")
    with_sign = F.flatten(F.transform("c", lambda c: F.transform("v", lambda v: F.concat(c, v))))
    joined = F.flatten(F.transform(F.slice("c", 1, 10), lambda a: F.transform(F.slice("c", 1, 5), lambda b: F.concat(a, F.col("joiner"), b))))
    between = F.transform("v", lambda v: F.concat(F.get("c", 0), v, F.get("c", 1)))
    return parts.select("script", F.explode(F.array_distinct(F.concat(with_sign, joined, between))).alias("word")).filter(F.length("word") >= 2)


def drawn(key: Column, salt: str, n: int) -> Column:
    """A whole number from 0 below n that depends on the key alone."""
    return F.pmod(T.md5_mod(F.concat(key.cast("string"), F.lit(":" + salt)), 1_000_003), F.lit(n)).cast("int")


def one_of(key: Column, salt: str, choices: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), drawn(key, salt, len(choices)) + 1)


#: Weights of the ways that marks and numbers are mixed into words of any script, and of those for Latin alone. Fixed values.
MIXES = {"end": 25, "dash": 5, "ascii_quote": 5, "quote": 5, "number_before": 10, "number_after": 5, "twice": 3, "short_number": 5}
LATIN_MIXES = {"number": 8, "date": 5, "price": 5, "telephone": 3, "reference": 3}


def quoted(word: Column, key: Column) -> Column:
    """The word in single, double, angled or low quotes."""
    k = drawn(key, "quote", 4)
    return F.when(k == 0, F.concat(F.lit("‘"), word, F.lit("’"))).when(k == 1, F.concat(F.lit("“"), word, F.lit("”"))).when(k == 2, F.concat(F.lit("«"), word, F.lit("»"))).otherwise(F.concat(F.lit("„"), word, F.lit("“")))


def number_text(key: Column) -> Column:
    """A whole number, one with commas, or one with decimals, for 4, 3 and 3 of ten keys."""
    u = drawn(key, "kind", 10)
    cents = F.lpad((drawn(key, "cents", 100)).cast("string"), 2, "0")
    return F.when(u < 4, (drawn(key, "whole", 99999) + 1).cast("string")).when(u < 7, F.format_number(drawn(key, "commas", 999900) + 100, 0)).otherwise(F.concat(drawn(key, "units", 10000).cast("string"), F.lit("."), cents))


def date_text(key: Column) -> Column:
    """A date as day, month, year (four or two digits) or year, month, day, with one of three separators."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    d, m, y, sep = two(drawn(key, "day", 31) + 1), two(drawn(key, "month", 12) + 1), drawn(key, "year", 76) + 1950, one_of(key, "separator", ["-", "/", "."])
    k = drawn(key, "order", 3)
    return F.when(k == 0, F.concat_ws("", d, sep, m, sep, y.cast("string"))).when(k == 1, F.concat_ws("", d, sep, m, sep, two(y % 100))).otherwise(F.concat_ws("", y.cast("string"), sep, m, sep, d))


def mixed_with_marks(word: Column, key: Column, script: Column, share: float = 0.15) -> Column:
    """The word, for a share of keys with punctuation or numbers mixed in; pure numbers only for Latin. Draws depend on the key alone."""
    digit = lambda salt: drawn(key, salt, 10).cast("string")
    made = {
        "end": F.concat(word, one_of(key, "end", list(".,;:!?"))),
        "dash": F.concat(word, one_of(key, "dash", ["…", "–", "—"])),
        "ascii_quote": F.concat(one_of(key, "open", list("\"'(")), word, one_of(key, "close", list("\"')"))),
        "quote": quoted(word, key),
        "number_before": F.concat(digit("before"), one_of(key, "point", list(".)")), F.lit(" "), word),
        "number_after": F.concat(word, one_of(key, "stroke", list("-/")), digit("after")),
        "twice": F.concat(word, one_of(key, "joint", list("-/&")), F.left(word, F.greatest(F.lit(2), F.floor(F.length(word) / 2).cast("int")))),
        "short_number": (drawn(key, "short", 999) + 1).cast("string"),
        "number": number_text(key),
        "date": date_text(key),
        "price": F.concat(F.lit("$"), number_text(key)),
        "telephone": F.concat(F.lpad(drawn(key, "area", 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad(drawn(key, "line", 10000).cast("string"), 4, "0")),
        "reference": F.concat(one_of(key, "sign", list("#*")), (drawn(key, "note", 999) + 1).cast("string")),
    }

    def pick(weights: dict[str, int]) -> Column:
        at, end, out = drawn(key, "way", sum(weights.values())), 0, None
        for name, w in weights.items():
            end += w
            out = F.when(at < end, made[name]) if out is None else out.when(at < end, made[name])
        return out

    return F.when(uniform(key, "mix") >= share, word).when(script == "latin", pick(MIXES | LATIN_MIXES)).otherwise(pick(MIXES))
