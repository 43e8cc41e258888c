import random

from corpusloom.llm import token_counts as N
from corpusloom.llm.common import read


def lengths_of(texts):
    import tiktoken

    e = tiktoken.Encoding("t", pat_str=N.PATTERN, mergeable_ranks=N.ranks(), special_tokens={})
    return [len(e.encode_ordinary(t or "")) for t in texts]


def check(rows, lengths):
    assert {r.n_tokens: r.n_docs for r in rows} == {n: lengths.count(n) for n in set(lengths)}
    for r in rows:
        assert r.docs_up_to == sum(n <= r.n_tokens for n in lengths) and r.docs_beyond == len(lengths) - r.docs_up_to
        assert r.all_docs == len(lengths) and r.all_tokens == sum(lengths)
        assert r.kept_tokens == sum(min(n, r.n_tokens) for n in lengths)


def test_suffix_sums_and_answers(spark):
    random.seed(6)
    lengths = [random.choice([0, 1, 5, 1023, 1024, 1025, random.randint(0, 5000)]) for _ in range(400)]
    sums = N.suffix_sums(N.histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))).cache()
    check(sums.collect(), lengths)
    for limit in (0, 3, 1024, 2000, 10**6):
        assert N.truncated_total(sums, limit).first()[0] == sum(min(n, limit) for n in lengths)
    for q in (0.1, 0.5, 0.99, 1.0):
        assert sums.agg(N.quantile(sums, q)).first()[0] == min(n for n in lengths if sum(x <= n for x in lengths) >= q * len(lengths))


def test_query(spark, data):
    check(N.op8_token_counts(spark, data).collect(), lengths_of([r.text for r in read(spark, data, "documents").collect()]))


def test_awkward_rows(spark, awkward):
    check(N.suffix_sums(N.histogram(N.with_length(awkward))).collect(), lengths_of([r.text for r in awkward.collect()]))
    none = N.suffix_sums(N.histogram(N.with_length(awkward.limit(0))))
    assert none.count() == 0 and N.truncated_total(none, 5).first()[0] == 0
