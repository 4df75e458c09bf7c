import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from watchtide.llm import ngram_join

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, DIR).write.parquet(path)
        out.append((docs, made := spark.read.parquet(path)))
        docs = made
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages_keep_columns_and_take_effect(spark, steps):
    for docs, made in steps[:-1]:
        assert made.columns == docs.columns
        assert ids(made) <= ids(docs)
    toxic = ids(spark.read.parquet(f"{DIR}/labels.parquet").where("toxic = 1"))
    assert len(toxic & ids(steps[0][1])) < len(toxic & ids(steps[0][0])) / 2
    clean = ids(spark.read.parquet(f"{DIR}/labels.parquet").where("toxic = 0"))
    assert len(clean & ids(steps[0][1])) > 0.9 * len(clean & ids(steps[0][0]))


def test_no_near_copy_is_left(steps):
    sets = [set(ngram_join.shingle_set(r[0], ngram_join._WordHash()).tolist()) for r in steps[2][1].select("text").collect()]
    sets = [s for s in sets if s]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert len(a & b) < 0.8 * len(a | b)


def test_pieces_are_of_the_documents_left(spark, steps):
    docs, pieces = steps[-1]
    assert ids(pieces) == ids(docs)
    rows = corpus_pipeline.run(spark, DIR).select("doc_id", "piece", "ids_crc32")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, pieces.select("doc_id", "piece", "ids_crc32").collect()))


def test_empty_and_null_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    for table in (docs.limit(0), odd):
        made = table
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, made, DIR)
        assert made.count() == 0


def test_documents_of_several_languages_stay(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    one = [r[0].split()[:40] for r in docs.where("length(text) > 400").groupBy("lang").agg(F.min_by("text", "doc_id")).where("lang IS NOT NULL").select(F.col("min_by(text, doc_id)")).collect()]
    mixed = [(k, " ".join(w for own in one[k:] for w in own)) for k in range(len(one) - 1)] + [(90, "12 34"), (91, None)]
    rows = spark.createDataFrame(mixed, "doc_id long, text string")
    assert len(one) >= 4 and ids(corpus_pipeline.keep_languages(spark, rows, DIR)) == set(range(len(one) - 1))


def test_rows_without_an_id_or_with_a_shared_one(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bad = spark.read.parquet(f"{DIR}/labels.parquet").where("toxic = 1").join(docs, "doc_id")
    bad = bad.where("length(text) < 3000").join(corpus_pipeline.drop_toxic(spark, docs, DIR), "doc_id", "left_anti").first().text
    clean, other = "the weather was fine and we walked along the river until the evening", "my neighbour grows tomatoes and beans behind the old wooden house"
    item = spark.createDataFrame([(None, "one day every item of this test stood in a benchmark table")], "item_id long, text string")
    item.write.parquet(str(tmp_path / "benchmark.parquet"))

    def left(stage, rows, where=DIR):
        made = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), where).collect()
        return sorted(((r.doc_id, r.text) for r in made), key=repr)

    assert left(corpus_pipeline.drop_toxic, [(None, bad), (7, bad), (7, clean)]) == [(7, clean)]
    assert left(corpus_pipeline.keep_languages, [(None, "12 34"), (7, "?!"), (7, clean)]) == [(7, clean)]
    rows = [(None, clean), (5, clean), (5, clean), (6, clean.upper()), (5, other), (None, "one two"), (None, "one two"), (9, None)]
    assert left(corpus_pipeline.drop_near_copies, rows) == sorted([(5, clean), (5, other), (None, "one two"), (9, None)], key=repr)
    said = "they say that one day every item of this test stood in a benchmark table indeed"
    assert left(corpus_pipeline.drop_leaked, [(None, said), (7, said), (7, clean), (None, clean), (8, None)], str(tmp_path)) == sorted([(7, clean), (None, clean), (8, None)], key=repr)


def test_clashing_columns_ties_repeats_and_long_texts_pass(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    clean = docs.join(spark.read.parquet(f"{DIR}/labels.parquet").where("toxic = 0"), "doc_id").where("length(text) BETWEEN 500 AND 2000")
    clean = corpus_pipeline.drop_leaked(spark, corpus_pipeline.drop_toxic(spark, clean, DIR), DIR)
    text, other = (clean.where(f"lang = '{lang}'").orderBy("doc_id").first().text for lang in ("en", "de"))
    whole = " ".join(r.text for r in docs.where("lang = 'fr'").select("text").limit(200).collect())
    rows = [(5, text, "en", "s", 1), (5, text, "en", "s", 1), (4, text, None, "t", 2), (6, other, "de", None, None), (7, whole * 3, "fr", "s", 3)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {"score": "0.5", "predicted": "1", "lang_pred": "'x'", "_row": "7", "_row0": "8", "component_id": "9", "kept": "false", "_key": "'k'", "_words": "'w'", "_doc": "3", "contaminated": "true", "_leaked": "'l'", "_digest": "'d'", "piece": "4"}
    made = made.selectExpr(*names, *(f"{v} AS {k}" for k, v in clash.items()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, made, DIR).write.parquet(path)
        made = spark.read.parquet(path)
        assert made.columns == [*names, *clash]
    assert ids(made) <= {4, 6, 7} and made.count() == len(ids(made)) and 4 in ids(made)
    assert ids(corpus_pipeline.pack(spark, made, DIR)) == ids(made)
