"""All queries of the library outside its language-model subpackage, by name, with the SQL that each must equal."""

from __future__ import annotations

from corpusloom.plans import corpus_queries, dataset_queries, extra_queries, fixture_queries, lookup_queries

FLAGSHIP = "word_freq_topk"

QUERIES = {**corpus_queries.QUERIES, **dataset_queries.QUERIES, **lookup_queries.QUERIES, **fixture_queries.QUERIES, **extra_queries.QUERIES}
SQL = {**corpus_queries.SQL, **dataset_queries.SQL, **lookup_queries.SQL, **fixture_queries.SQL, **extra_queries.SQL}
