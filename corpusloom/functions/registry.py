"""Scalar functions by name: for code that picks them by configuration, and for SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from corpusloom.functions import codecs, scripts, text

#: Column functions of one column.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {}


def register(name: str) -> Callable:
    """A decorator that puts a function into the table; a name is given once."""

    def add(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
        if name in FUNCTIONS:
            raise ValueError(f"{name} is registered")
        FUNCTIONS[name] = function
        return function

    return add


for _name, _function in {"strip": text.strip, "clean_word": text.clean_word, "script": scripts.script, "without_tags": text.without_tags, "title_parts": text.title_parts, "nfc": codecs.nfc, "nfkc": codecs.nfkc, "grapheme_clusters": codecs.grapheme_clusters}.items():
    register(_name)(_function)


def applied(c: Column, names: list[str]) -> Column:
    """The functions of these names, one after the other."""
    for n in names:
        c = FUNCTIONS[n](c)
    return c


def to_sql(spark: SparkSession, prefix: str = "corpus_") -> list[str]:
    """Make the Arrow functions callable from SQL text under their names with a prefix; the others are expressions already."""
    made = []
    for name, function in FUNCTIONS.items():
        if hasattr(function, "evalType"):
            spark.udf.register(prefix + name, function)
            made.append(prefix + name)
    return made
