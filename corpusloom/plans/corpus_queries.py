"""Queries over text: frequencies, vocabularies, encodings, merges, checks. SQL maps each to DuckDB's dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import codecs as K
from corpusloom.functions import scripts as S
from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.sources.tables import table

#: GAPS as a class of DuckDB's regular expressions.
_GAPS = r"\s\x0b\d[:punct:]\x{00a0}\x{00a1}\x{00ab}\x{00bb}\x{00bf}\x{200b}-\x{200d}\x{2010}-\x{2027}"
_WORDS = f"unnest(list_filter(regexp_split_to_array(text, '[{_GAPS}]+'), lambda w: length(w) BETWEEN 2 AND 15))"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_CHARS = "regexp_extract_all(text, '(?s).')"
_LATIN = S.members(S.SCRIPTS["latin"])
_SCRIPTS = ", ".join(f"('{name}', '[{S.members(S.without(ranges))}]')" for name, ranges in S.SCRIPTS.items())
_VOCAB = f"v AS (SELECT row_number() OVER (ORDER BY c) AS token_id, c FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[{_LETTERS}]')) AS c FROM documents))"
_PAIRS = "SELECT substring(word, i, 2) AS pair FROM (SELECT word, unnest(range(1, length(word))) AS i FROM w)"


def word_freq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent words of each language."""
    return C.top_by(C.count_by(T.word_rows(table(spark, sf_dir, "documents"), "lang"), "lang", "word"), "lang", "word", 20)


def bigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 75 most frequent character pairs inside words of each language."""
    words = C.count_by(T.word_rows(table(spark, sf_dir, "documents"), "lang"), "lang", "word")
    return C.top_by(C.pair_counts(words, "lang"), "lang", "pair", 75)


def char_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each language by number."""
    return C.count_by(table(spark, sf_dir, "documents").select("lang", F.explode(T.chars(F.col("text"))).alias("char")), "lang", "char")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token_id, c): the vocabulary of letters that occur."""
    found = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"[{_LETTERS}]"), F.lit(0)))).alias("c"))
    return C.numbered(found, "c")


def vocab_char_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of letters, numbered in order."""
    return letters(spark, sf_dir)


def encode_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each document's letters, joined by spaces; other characters are dropped."""
    ids = {r["c"]: r["token_id"] for r in letters(spark, sf_dir).collect()}  # a vocabulary: letters of one script
    return table(spark, sf_dir, "documents").select("doc_id", K.char_numbers(ids)(F.col("text")).alias("ids"))


def decode_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text decoded from its letters' numbers."""
    v = letters(spark, sf_dir)
    both = table(spark, sf_dir, "documents").crossJoin(F.broadcast(C.by_code(v, "c", "token_id"))).crossJoin(F.broadcast(C.as_array(v, "c", "token_id")))
    return both.select("doc_id", K.decode(K.encode_chars(F.col("text"), F.col("ids")), F.col("tokens")).alias("decoded"))


def encode_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts cut from left to right into the 75 most frequent pairs of documents' words and single characters."""
    pairs = C.pair_counts(C.count_by(T.word_rows(table(spark, sf_dir, "documents")), "word"))
    best = [r["pair"] for r in pairs.orderBy(F.desc("n"), "pair").limit(75).collect()]
    tokens = K.greedy_bigrams(F.col("text"), best)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, "|").alias("tokens"))


def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script of most of each document's characters."""
    return table(spark, sf_dir, "documents").select("doc_id", T.script(F.col("text")).alias("script"))


def script_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the Latin script by language, and words in all."""
    words = T.word_rows(table(spark, sf_dir, "documents"), "lang")
    return words.groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.count_if(T.in_script(F.col("word"), "latin")).alias("latin_words"))


def new_words_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark that no document holds."""
    return C.without(T.word_rows(table(spark, sf_dir, "benchmark")), T.word_rows(table(spark, sf_dir, "documents")), "word")


def word_list_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of benchmark and documents with their number in documents."""
    return C.upsert(T.word_rows(table(spark, sf_dir, "benchmark")), C.count_by(T.word_rows(table(spark, sf_dir, "documents")), "word"), "word")


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How documents cover the words of the benchmark."""
    return C.coverage(T.word_rows(table(spark, sf_dir, "benchmark")), C.count_by(T.word_rows(table(spark, sf_dir, "documents")), "word"), "word")


def rare_char_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 rarest letters with the 5 most frequent, in both orders, where no word has the pair."""
    words = C.count_by(T.word_rows(table(spark, sf_dir, "documents")), "word")
    chars = C.char_counts(words)
    known = words.select(F.explode(T.bigrams(F.col("word"))).alias("pair")).distinct()
    return C.pairings(chars.orderBy("n", "char").limit(10), chars.orderBy(F.desc("n"), "char").limit(5), known)


def label_charset_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that are neither ASCII nor Latin letters, by language, with the number of documents."""
    return C.charset_issues(table(spark, sf_dir, "documents"), rf"\x00-\x7F{_LETTERS}")


def word_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each language's words."""
    return C.word_quality(T.word_rows(table(spark, sf_dir, "documents"), "lang"))


def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, each kept where it first stands."""
    lines = C.first_lines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.size(lines).cast("long").alias("n_distinct"), F.array_join(lines, "\n").alias("deduped"))


def spell_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each ASCII word of the benchmark, the nearest word of documents within one edit."""
    ascii_ = F.col("word").rlike("^[a-z]{3,15}$")
    return C.spelling(T.word_rows(table(spark, sf_dir, "benchmark")).filter(ascii_), T.word_rows(table(spark, sf_dir, "documents")).filter(ascii_))


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all tags removed."""
    return table(spark, sf_dir, "pages").select("page_id", T.without_tags(F.col("html")).alias("text"))


def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of 2 to 15 characters of list links (these pages have no tables; see table_cells), and the pages that hold them."""
    cells = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(">([^<>]{2,15})</a>"), F.lit(1)))).alias("cell"))
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n_pages"))


def multi_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the words of each source, the share of occurrences that belong to words found more than once."""
    counts = C.count_by(T.word_rows(table(spark, sf_dir, "documents"), "source"), "source", "word")
    return counts.groupBy("source").agg(F.sum("n").alias("words"), F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("repeat_rate"))


def source_only_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words that occur in one source alone, by source."""
    words = T.word_rows(table(spark, sf_dir, "documents"), "source").distinct()
    alone = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source")).filter("n = 1")
    return alone.groupBy("source").agg(F.count(F.lit(1)).alias("own_words"))


_W = f"w AS (SELECT lang, source, {_WORDS} AS word FROM documents), bw AS (SELECT {_WORDS} AS word FROM benchmark)"
_TOP = "SELECT lang, {0}, n, rank::INTEGER AS rank FROM (SELECT lang, {0}, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, {0}) AS rank FROM {1} GROUP BY lang, {0}) WHERE rank <= {2}"

QUERIES = {f.__name__: f for f in (word_freq_topk, bigram_topk, char_freq, vocab_char_ids, encode_chars, decode_chars, encode_bigrams, script_detect, script_words, new_words_antijoin, word_list_upsert, coverage_report, rare_char_pairs, label_charset_issues, word_list_quality, ordered_dedupe, spell_candidates, html_strip, html_cells, multi_rate, source_only_words)}

SQL = {
    "word_freq_topk": f"WITH {_W} " + _TOP.format("word", "w", 20),
    "bigram_topk": f"WITH {_W}, p AS (SELECT lang, substring(word, i, 2) AS pair FROM (SELECT lang, word, unnest(range(1, length(word))) AS i FROM w)) " + _TOP.format("pair", "p", 75),
    "char_freq": f"SELECT lang, char, count(*) AS n FROM (SELECT lang, unnest({_CHARS}) AS char FROM documents) GROUP BY lang, char",
    "vocab_char_ids": f"WITH {_VOCAB} SELECT token_id::INTEGER AS token_id, c FROM v",
    "encode_chars": f"WITH {_VOCAB}, m AS (SELECT map_from_entries(list((c, token_id))) AS ids FROM v) SELECT doc_id, array_to_string(list_filter(list_transform({_CHARS}, lambda c: ids[c]), lambda i: i IS NOT NULL), ' ') AS ids FROM documents, m",
    "decode_chars": f"SELECT doc_id, array_to_string(regexp_extract_all(text, '[{_LETTERS}]'), '') AS decoded FROM documents",
    "encode_bigrams": f"WITH {_W}, t AS (SELECT pair, count(*) AS n FROM ({_PAIRS}) GROUP BY pair ORDER BY n DESC, pair LIMIT 75), r AS (SELECT '(?s)(' || string_agg(pair, '|' ORDER BY n DESC, pair) || '|.)' AS rule FROM t), e AS (SELECT item_id, regexp_extract_all(text, rule) AS tokens FROM benchmark, r) SELECT item_id, len(tokens) AS n_tokens, array_to_string(tokens, '|') AS tokens FROM e",
    "script_detect": f"WITH s(script, cls) AS (VALUES {_SCRIPTS}), n AS (SELECT doc_id, script, length(regexp_replace(text, cls, '', 'g')) - length(text) AS less FROM documents, s) SELECT doc_id, CASE WHEN min(less) < 0 THEN arg_min(script, less) ELSE 'latin' END AS script FROM n GROUP BY doc_id",
    "script_words": f"WITH {_W} SELECT lang, count(*) AS words, count(*) FILTER (WHERE regexp_matches(word, '[{_LATIN}]') AND NOT regexp_matches(regexp_replace(word, '[{_LATIN}]', '', 'g'), '\\p{{L}}')) AS latin_words FROM w GROUP BY lang",
    "new_words_antijoin": f"WITH {_W} SELECT DISTINCT word FROM bw WHERE word NOT IN (SELECT word FROM w)",
    "word_list_upsert": f"WITH {_W}, c AS (SELECT word, count(*) AS n FROM w GROUP BY word), e AS (SELECT DISTINCT word FROM bw) SELECT coalesce(e.word, c.word) AS word, coalesce(n, 0) AS n FROM e FULL OUTER JOIN c ON e.word = c.word",
    "coverage_report": f"WITH {_W}, c AS (SELECT word, count(*) AS n FROM w GROUP BY word), u AS (SELECT n FROM (SELECT DISTINCT word FROM bw) LEFT JOIN c USING (word)) SELECT count(*) AS universe, count(n) AS covered, round(100.0 * count(n) / greatest(count(*), 1), 4) AS percent, min(n) AS least, list_sort(list(n) FILTER (WHERE n IS NOT NULL))[count(n) // 2 + 1] AS median, count(*) FILTER (WHERE n = 1) AS once, count(*) FILTER (WHERE n >= 5) AS five_or_more FROM u",
    "rare_char_pairs": f"WITH {_W}, k AS (SELECT char, count(*) AS n FROM (SELECT unnest(regexp_extract_all(word, '(?s).')) AS char FROM w) GROUP BY char), r AS (SELECT char FROM k ORDER BY n, char LIMIT 10), p AS (SELECT char FROM k ORDER BY n DESC, char LIMIT 5) SELECT DISTINCT pair FROM (SELECT unnest([r.char || p.char, p.char || r.char]) AS pair FROM r, p) WHERE pair NOT IN ({_PAIRS})",
    "label_charset_issues": f"SELECT lang, char, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(text, '[^\\x00-\\x7F{_LETTERS}]')) AS char FROM documents) GROUP BY lang, char",
    "word_list_quality": f"WITH {_W} SELECT lang, count(*) AS words, count(DISTINCT word) AS distinct_words, round(1 - count(DISTINCT word) / count(*), 6) AS repeat_share, count(*) FILTER (WHERE length(word) NOT BETWEEN 1 AND 50) AS bad_length, count(*) FILTER (WHERE regexp_matches(word, '^\\d')) AS digit_first, count(*) FILTER (WHERE NOT regexp_matches(word, '[{_LATIN}]')) AS no_letter FROM w GROUP BY lang",
    "ordered_dedupe": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), d AS (SELECT doc_id, x, list_filter(x, lambda v, i: list_position(x, v) = i) AS y FROM l) SELECT doc_id, len(x) AS n_lines, len(y) AS n_distinct, array_to_string(y, chr(10)) AS deduped FROM d",
    "spell_candidates": f"WITH {_W}, q AS (SELECT DISTINCT word FROM bw WHERE regexp_full_match(word, '[a-z]{{3,15}}')), d AS (SELECT DISTINCT word AS entry FROM w WHERE regexp_full_match(word, '[a-z]{{3,15}}')), m AS (SELECT word, entry, levenshtein(word, entry) AS distance FROM q JOIN d ON abs(length(word) - length(entry)) <= 1 AND levenshtein(word, entry) <= 1) SELECT word, best, distance::INTEGER AS distance FROM (SELECT word, entry AS best, distance, row_number() OVER (PARTITION BY word ORDER BY distance, entry) AS r FROM m) WHERE r = 1",
    "html_strip": "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages",
    "html_cells": "SELECT cell, count(*) AS n_pages FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '>([^<>]{2,15})</a>', 1)) AS cell FROM pages) GROUP BY cell",
    "multi_rate": f"WITH {_W}, c AS (SELECT source, word, count(*) AS n FROM w GROUP BY source, word) SELECT source, sum(n)::BIGINT AS words, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS repeat_rate FROM c GROUP BY source",
    "source_only_words": f"WITH {_W}, c AS (SELECT word, min(source) AS source FROM w GROUP BY word HAVING count(DISTINCT source) = 1) SELECT source, count(*) AS own_words FROM c GROUP BY source",
}
