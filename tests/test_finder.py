import pytest
from pyspark.sql import functions as F

from affinity.operators import catalog, finder


@pytest.fixture(scope="module")
def rows(spark):
    words = F.array(*map(F.lit, ["Bolt", "bOLTed", "Ünder", "sky", "100% _x", "İz", "a"]))
    pick = lambda k: F.get(words, (F.col("id") * k % 7).cast("int"))
    base = spark.range(6000).select("id", F.concat_ws(" ", pick(1), pick(3), F.concat(F.lit("("), (1950 + F.col("id") % 60).cast("string"), F.lit(")"))).alias("title"))
    base = base.select("id", F.when(F.col("id") % 11 != 0, F.col("title")).alias("title"), F.when(F.col("id") % 13 == 0, "").otherwise(F.concat_ws("|", pick(2), pick(5))).alias("genres"),
                       F.when(F.col("id") % 5 != 0, F.col("id") % 17).alias("popularity_score"))
    more = spark.createDataFrame([(None, "Bolt (1995)", "sky", 3), (7, "Bolt again", None, None)], "id long, title string, genres string, popularity_score long")
    return base.unionByName(more).cache()


@pytest.fixture(scope="module", params=[finder.NAMED, 3])
def kept(request, spark, rows, tmp_path_factory):
    before, finder.NAMED = finder.NAMED, request.param
    path = tmp_path_factory.mktemp("finder")
    yield finder.write_catalog(rows, f"{path}/catalog", 16384), finder.write_postings(rows, f"{path}/postings", block=256)
    finder.NAMED = before


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize(("text", "genres"), [("bolt", None), ("BOLTed sky", None), ("ü", "sky"), ("ünder", None), ("100% _", "Bolt, ünder"), ("_", None), ("(1995)", "Ünder,, a "), ("absent", None), ("", "sky"), ("İz", None), ("i̇z", None)])
def test_search_is_exact(rows, kept, text, genres):
    same(finder.search_title(*kept, text, genres, size=10000), catalog.search_title(rows, text, genres, size=10000))


def test_filters_are_exact(rows, kept):
    for genres in (None, "", "sky", "Bolt,sky", "bolt", "a"):
        same(finder.filter_genres_all(*kept, genres), catalog.filter_genres_all(rows, genres))
    for year in (None, "1995", "19"):
        same(finder.filter_year(*kept, year), catalog.filter_year(rows, year))


def test_lists_are_bounded_and_whole(rows, kept):
    lists = kept[1]
    assert lists.agg(F.max(F.size("ids"))).first()[0] <= 256
    ids = lists.where("field = 'title' and gram = 'bol'").select(F.explode("ids").alias("id"))
    same(ids, rows.where("id is not null and lower(title) like '%bol%'").select("id").distinct())


def scanned(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value(), leaf.toString()


def test_look_up_skips_row_groups(kept, rows):
    for k in (42, 5999, 7):
        found = finder.get_item(kept[0], k)
        read, plan = scanned(found)
        assert f"EqualTo(id,{k})" in plan and read < 1500
        same(found, rows.where(F.col("id") == k))
    assert scanned(finder.get_item(kept[0], 10**9))[0] == 0


def test_search_reads_only_rows_that_can_match(spark, rows, tmp_path):
    some = rows.where("id is not null").withColumn("title", F.when(F.col("id") == 4321, "Zanzibar").otherwise(F.col("title")))
    table, lists = finder.write_catalog(some, f"{tmp_path}/c", 16384), finder.write_postings(some, f"{tmp_path}/p")
    found = finder.holding(table, lists, [("title", "zanzi")])
    read, plan = scanned(found)
    assert found.count() == 1 and read < 1500 and "PushedFilters" in plan


@pytest.mark.parametrize("descending", [True, False])
def test_pages_by_key_agree_with_offsets(rows, descending):
    some, last = rows.where("id < 400"), None
    for number in range(1, 6):
        want = catalog.browse(some, descending=descending, number=number, size=90).collect()
        got = finder.page_after(some, "popularity_score", last, descending, 90).collect()
        assert [r.id for r in got if r.id != 7] == [r.id for r in want if r.id != 7]
        if got:
            last = (got[-1].popularity_score, got[-1].id)


def test_empty(spark, rows, tmp_path):
    none = rows.limit(0)
    table, lists = finder.write_catalog(none, f"{tmp_path}/c"), finder.write_postings(none, f"{tmp_path}/p")
    assert finder.search_title(table, lists, "bolt").count() == finder.get_item(table, 1).count() == finder.page_after(table, "title").count() == 0
    with pytest.raises(ValueError, match="sort"):
        finder.page_after(table, "genres")
