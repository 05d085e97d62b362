"""Every step that is said to run on a stream gives there what it gives on a table."""

import pytest

from millrace.base import STEPS
from millrace.operators import clean, cluster, encode, forest, knn, linalg, scale, select, text  # noqa: F401 - fill the registry
from millrace.streaming.apply import STREAMABLE, transform_stream

OPTIONS = {
    "tfidf": {"text_column": "t"}, "ngram_counts": {"text_column": "t"}, "text_normalization": {"text_column": "t"},
    "sentiment": {"text_column": "t", "lexicon": {"red": 1.5, "fish": -0.5}}, "one_hot": {"columns": ["c"]},
    "ordinal": {"columns": ["c"]}, "frequency_encoding": {"columns": ["c"]}, "fix_column_types": {}, "narrow_types": {},
    "simple_imputation": {}, "infinity_to_null": {}, "mean_fill": {}, "correlation_filter": {}, "variance_threshold": {},
    "pca": {"columns": ["x"], "n_components": 1}, "svd": {"columns": ["x", "y"], "n_components": 2},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "t")
    rows = [(float(i % 17), float(i * i % 31) if i % 6 else None, f"c{i % 4}" if i % 5 else None, ["red fish", "blue, sky", ""][i % 3], str(i)) for i in range(60)]
    spark.createDataFrame(rows, "x double, y double, c string, t string, n string").repartition(2).write.parquet(path)
    return path


@pytest.mark.parametrize("name", sorted(STREAMABLE))
def test_a_stream_gives_what_a_table_gives(spark, folder, tmp_path, name):
    table = spark.read.parquet(folder)
    options = OPTIONS.get(name)
    fitted = STEPS[name](**({"columns": ["x", "y"]} if options is None else options)).fit(table)
    stream = transform_stream(spark.readStream.schema(table.schema).parquet(folder), [fitted])
    run = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
           .trigger(availableNow=True).start())
    run.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(str, got)) == sorted(map(str, fitted.transform(table).collect()))


def test_other_steps_are_refused(spark, folder):
    class Whole:
        name = "knn_imputation"

    with pytest.raises(ValueError, match="whole table"):
        transform_stream(spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder), [Whole()])
