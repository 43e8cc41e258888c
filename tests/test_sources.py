"""Readers, writers and streams on small files."""

from pyspark.sql import functions as F

from corpusloom.sources import tables as S
from corpusloom.streaming import counts


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def words(df, c="word"):
    return sorted(r[c] for r in df.collect())


def test_word_list(spark, tmp_path):
    a, b = write(tmp_path / "a", "ab\n ab \n1x\nx\n" + "y" * 16 + "\n"), write(tmp_path / "b", "cd\n\nab\n")
    assert words(S.word_list(spark, a, b)) == ["ab", "cd"]


def test_frequency_table(spark, tmp_path):
    assert [tuple(r) for r in S.frequency_table(spark, write(tmp_path / "f", "a\t3\nb\n\"c\t1\n")).collect() if r[1]] == [("a", 3), ('"c', 1)]


def test_dictionary(spark, tmp_path):
    assert words(S.dictionary(spark, write(tmp_path / "d", "﻿house/S\na/x\ncat\n"))) == ["cat", "house"]


def test_cedict(spark, tmp_path):
    assert words(S.cedict(spark, write(tmp_path / "c", "# x\n漢字 汉字 [han4 zi4] /x/\n一 一 [yi1] /one/\n"))) == ["一", "汉字", "漢字"]


def test_unihan(spark, tmp_path):
    rows = S.unihan(spark, write(tmp_path / "u", "# c\nU+4E00\tkDefinition\tone\nU+4E01\tkOther\tx\n"), ["kDefinition"]).collect()
    assert [tuple(r) for r in rows] == [(0x4E00, "kDefinition", "one")]


def test_feed(spark):
    xml = "<rss><item><title>A longer title</title><description>ab</description></item></rss>"
    assert words(S.feed_texts(spark.createDataFrame([(xml,)], "xml string")), "text") == ["A longer title"]


def test_append_and_counts(spark, tmp_path):
    path = str(tmp_path / "list")
    for given in (["a", "b", "a"], ["b", "c"], []):
        S.append_new(spark.createDataFrame([(x,) for x in given], "word string"), path)
    assert words(spark.read.parquet(path)) == ["a", "b", "c"]
    S.write_counts(spark.createDataFrame([("a", 1), ("b", 2)], S.WORD_FREQ), str(tmp_path / "t"))
    assert sorted(tuple(r) for r in S.frequency_table(spark, str(tmp_path / "t")).collect()) == [("a", 1), ("b", 2)]


def test_shards(spark, tmp_path):
    S.write_shards(spark.range(25).withColumn("split", F.when(F.col("id") < 5, "val").otherwise("train")), str(tmp_path / "s"), 10)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("split").count().orderBy("split").collect()[0]["count"] == 20
    assert all(r["n"] <= 10 for r in back.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect())


def test_stream_of_words(spark, tmp_path):
    docs = str(tmp_path / "docs")
    for texts in (["ab cd ab"], ["cd ef"]):
        spark.createDataFrame([(t,) for t in texts], "text string").write.mode("append").parquet(docs)
        counts.append_new_words(spark.readStream.schema("text string").parquet(docs), str(tmp_path / "out"), str(tmp_path / "state"))
    assert words(spark.read.parquet(str(tmp_path / "out"))) == ["ab", "cd", "ef"]


def test_chunks_are_replaced_and_read_flat_or_by_chunk(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = [(i, "val" if i % 5 == 0 else "train", i // 10) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, split string, chunk int")
    S.write_chunks(df, path, 3)
    S.write_chunks(df.filter("chunk = 1"), path, 3)
    assert sorted(r.id for r in S.read_shards(spark, path, "train").collect()) == [i for i in range(40) if i % 5]
    flat = str(tmp_path / "flat")
    S.write_shards(df.drop("chunk"), flat, 3)
    assert S.read_shards(spark, flat, "val").columns == ["id"] and S.read_shards(spark, flat, "val").count() == 8


def test_shard_files(spark, tmp_path):
    for n in ("real_2.bin", "shard_b.bin", "sub/shard_a.bin", "char_shard_1.bin", "other.bin"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    got = [r.path.rsplit("/", 1)[1] for r in S.shard_files(spark, str(tmp_path)).collect()]
    assert sorted(got[:2]) == ["shard_a.bin", "shard_b.bin"] and got[2:] == ["char_shard_1.bin", "real_2.bin"]


def test_vocabulary_file(spark, tmp_path):
    tokens = ["∅", "a", '"', "é\n", "th"]
    S.save_vocabulary(spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "token_id int, token string").repartition(3), str(tmp_path / "v"))
    assert [(r.token_id, r.token) for r in S.load_vocabulary(spark, str(tmp_path / "v")).orderBy("token_id").collect()] == list(enumerate(tokens))


def test_labels_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text('a.png,one\nb.png,"two, three"\nlonely\nc.png,\nd.png,' + "x" * 30 + "\n")
    assert sorted(map(tuple, S.labels_csv(spark, str(tmp_path / "l.csv")).collect())) == [("a.png", "one"), ("b.png", "two, three")]


def test_label_words(spark):
    df = spark.createDataFrame([("  ab  cd ",), ("",), (None,), ("x" * 30,)], "label string")
    assert [r.word for r in S.label_words(df).collect()] == ["ab", "cd"]


def test_readings(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# c\nU+4E00\tkMandarin\tyī\nU+4E00\tkOther\tx\nU+20000\tkMandarin\thē\nU+4E00\tkCantonese\tjat1\n")
    got = {r.char: [(x.field, x.value) for x in r.readings] for r in S.unihan_readings(spark, str(tmp_path / "u.txt"), ["kMandarin", "kCantonese"]).collect()}
    assert got == {"一": [("kCantonese", "jat1"), ("kMandarin", "yī")], "\U00020000": [("kMandarin", "hē")]}


def test_store_round_trip(spark):
    rows = [(1, bytearray(b"i1"), "eins"), (2, bytearray(b"i2"), "zwei")]
    pairs = S.samples_to_pairs(spark.createDataFrame(rows, "idx long, image binary, label string"))
    assert sorted(map(tuple, S.pairs_to_samples(pairs, 1).collect())) == rows
    assert [r.idx for r in S.pairs_to_samples(pairs, 0).collect()] == [1]


def test_lists_are_written_in_order(spark, tmp_path):
    words = spark.createDataFrame([("b", "y"), ("a", "y"), ("é", "x"), ("z", "x"), ("a", "y"), ("\U00020000", "x"), ("\uffee", "x")], "word string, list string")
    S.write_lists(words, str(tmp_path / "lists"))
    read = lambda name: [line for f in sorted((tmp_path / "lists" / f"list={name}").glob("part-*")) for line in f.read_text().split("\n") if line]
    assert read("x") == ["z", "é", "\uffee", "\U00020000"]
    assert read("y") == ["a", "b"]
