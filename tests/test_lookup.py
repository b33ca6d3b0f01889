import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import containment as C
from plumbline.operators import vectors as V
from plumbline.plans import search
from plumbline.sources import models, rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """2,000 rows in eight files of several row groups, keys that grow with the row, two to each."""
    path = str(tmp_path_factory.mktemp("rows") / "table")
    own = spark.range(2000, numPartitions=8).select((F.col("id") / 2).cast("bigint").alias("key"), F.concat(F.lit("text "), "id").alias("body"), F.lit(7).alias("row_index"))
    own.write.option("parquet.block.size", 4096).parquet(path)
    return path


def test_numbers_count_over_files(spark, folder):
    got = {r.row: r.body for r in rows.numbered(spark, folder).collect()}
    assert got == {i: f"text {i}" for i in range(2000)}
    counts = rows.file_counts(spark, folder).orderBy("first").collect()
    assert [r.n for r in counts] == [250] * 8 and [r["first"] for r in counts] == list(range(0, 2000, 250))


def test_a_lookup_reads_files_and_ranges_of_the_wanted_rows(spark, folder):
    wanted = spark.createDataFrame([(3,), (3,), (249,), (1001,), (1002,), (None,), (-1,), (5000,)], "row long")
    found = rows.rows_at(spark, folder, wanted, ["body"], "key")
    assert {r.row: r.body for r in found.collect()} == {i: f"text {i}" for i in (3, 249, 1001, 1002)}
    assert found.columns == ["row", "body"] and len([f for f in found.inputFiles() if folder in f]) == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThanOrEqual(key" in plan and "row_index#" not in plan.split("ReadSchema: ")[1].split(">")[0]
    assert rows.rows_at(spark, folder, wanted.where("row > 4000"), ["body"], "key").collect() == []


def test_ranges_are_few(spark):
    keys = spark.range(500).select(F.lit("f").alias("_file"), (F.col("id") * rows.BLOCK).alias("_at"), F.col("id").alias("key"))
    got = rows.key_ranges(keys, 10)
    assert len(got) == 10 and got[0][0] == 0 and got[-1][1] == 499 and all(a[1] < b[0] for a, b in zip(got, got[1:]))


def test_a_cache_reads_only_what_is_missing(spark, folder, tmp_path):
    asked = []

    def read(missing):
        asked.append(sorted(r.row for r in missing.collect()))
        return rows.rows_at(spark, folder, missing, ["body"], "key")

    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "row long")
    get = lambda *ids: {r.row: r.body for r in rows.cached(spark, str(tmp_path / "cache"), of(*ids), ["row"], read).collect()}
    assert get(1, 2) == {1: "text 1", 2: "text 2"}
    assert get(2, 9) == {2: "text 2", 9: "text 9"} and get(1, 9) == {1: "text 1", 9: "text 9"}
    assert asked == [[1, 2], [9]]


def test_models_come_back_and_changes_are_seen(spark, tmp_path):
    own = search.corpus(spark, SMALL).select("id", "vector")
    model = V.fit_pca(own)
    mark = models.save_pca(spark, str(tmp_path / "pca"), model)
    again = models.load_pca(spark, str(tmp_path / "pca"))
    assert all((getattr(model, k) == getattr(again, k)).all() for k in ("mean", "components", "variance"))
    direct, loaded = (sorted(map(str, V.project(own, m, 5).collect())) for m in (model, again))
    assert direct == loaded and models.save_pca(spark, str(tmp_path / "twin"), again) == mark
    table = spark.read.parquet(str(tmp_path / "pca"))
    changed = F.when((F.col("field") == "components") & (F.col("at") == 3), F.transform("values", lambda x, i: F.when(i == 0, x + 1e-12).otherwise(x))).otherwise(F.col("values"))
    table.withColumn("values", changed).write.parquet(str(tmp_path / "changed"))
    table.where("not (field = 'components' and at = 3)").write.parquet(str(tmp_path / "short"))
    table.limit(0).write.parquet(str(tmp_path / "none"))
    for bad in ("changed", "short", "none"):
        with pytest.raises(ValueError):
            models.load_pca(spark, str(tmp_path / bad))
    assert models.models(spark, [str(tmp_path / "pca")]).first()["digest"] == mark


@pytest.mark.parametrize("coding", ["exact", "pq", "sign"])
def test_indexes_come_back(spark, tmp_path, coding):
    own = search.corpus(spark, SMALL).select("id", "vector")
    index, coded = V.build_index(own, nlist=5, coding=coding)
    models.save_index(spark, str(tmp_path / "index"), index)
    again = models.load_index(spark, str(tmp_path / "index"))
    assert again.coding == coding and (again.books is None) == (index.books is None)
    asked = search.queries(own)
    a, b = (sorted(map(tuple, V.search_index(i, coded, asked, 5, 2).collect())) for i in (index, again))
    assert a == b


def test_values_of_any_shape(spark, tmp_path):
    fields = {"number": np.float64(3.5), "none": np.zeros((0, 4)), "cube": np.arange(24.0).reshape(2, 3, 4), "odd": np.array([np.nan, np.inf, -0.0])}
    mark = models.save(spark, str(tmp_path / "m"), fields)
    got = models.load(spark, str(tmp_path / "m"))
    assert got["cube"].shape == (2, 3, 4) and (got["cube"] == fields["cube"]).all() and got["none"].shape == (0, 4) and got["number"] == 3.5
    assert np.isnan(got["odd"][0]) and mark == models.digest(got)


def test_places_of_sentences(spark):
    corpus = [
        (1, 0, 'The tenth  season of "South Park", an American series, began in March.'),
        (1, 1, "an American series, began in March. Other words follow here and there."),
        (2, 0, "the tenth season of South Park, an american series, began in march."),
        (3, 0, "nothing like that stands here at all"),
        (4, None, None),
    ]
    asked = [
        (1, "The tenth season of South Park, an American series, began in March."),
        (2, "Other words follow here\nand there."),
        (3, "an American series, began in March."),
        (4, "tenth season of South Park an American series ended in March"),
        (5, "No such words were ever written down"),
        (6, "at all"),
        (7, None),
    ]
    got = {r.sid: r for r in C.locate(spark.createDataFrame(asked, "sid int, text string"), spark.createDataFrame(corpus, "doc_id int, chunk int, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert (got[1].n_strict, got[1].n_quoted, got[1].best, got[1].lead, got[1].token_unique) == (1, 2, 1.0, 0.0, False)
    assert (got[2].n_strict, got[2].doc_id, got[2].chunk, got[2].token_unique, got[2].lead) == (1, 1, 1, True, 0.25)
    assert (got[3].n_strict, got[3].adjacent) == (3, False)
    assert got[4].n_strict == 0 and got[4].best == round(10 / 11, 9) and (got[4].doc_id, got[4].chunk) == (1, 0)
    assert got[5].best is None and not got[5].token_unique and got[6].n_strict == 0 and got[6].short
    one = C.by_question(spark.createDataFrame(list(got.values())).withColumn("qid", F.lit(1))).first()
    assert one.n_sents == 6 and not one.all_one_strict and one.any_zero_quoted and one.n_short == 4


def test_tables_are_swept(spark):
    import os

    from plumbline.sources.tables import cut, discard, sweep

    sweep(spark)
    tables = [cut(spark.range(10), "one"), cut(spark.range(10), "two")]
    folders = [t.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://") for t in tables]
    discard(tables[0])
    assert [os.path.exists(f) for f in folders] == [False, True] and sweep(spark) == 1 and not os.path.exists(folders[1]) and sweep(spark) == 0
