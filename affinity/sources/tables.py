"""Rating, item and tag tables read from the star-schema tables.

The statements run unchanged in Spark and in DuckDB; table names are filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.kept import keep

CHANGES_SQL = """
SELECT o.o_custkey + 1 AS user_id, l.l_partkey + 1 AS item_id,
  ((CAST(l.l_quantity AS INT) - 1) % 10 + 1) * CAST(0.5 AS DOUBLE) AS rating, l.l_shipdate AS ts,
  l.l_orderkey AS seq, l.l_linenumber AS line, l.l_quantity AS quantity
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

RATINGS_SQL = """
SELECT user_id, item_id, rating, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, seq DESC, line DESC, quantity DESC) AS rn
  FROM {changes}) x WHERE rn = 1
"""

ITEMS_SQL = """
SELECT p.p_partkey + 1 AS id, concat(p.p_name, ' (', CAST(1950 + p.p_partkey % 70 AS STRING), ')') AS title,
  CASE WHEN p.p_partkey % 50 = 0 THEN '(no genres listed)'
    ELSE concat_ws('|', split_part(p.p_name, ' ', 1), split_part(p.p_name, ' ', 2), p.p_type) END AS genres,
  CASE WHEN p.p_partkey % 10 = 0 THEN 'nan' ELSE CAST(p.p_partkey + 1 AS STRING) END AS tmdb_id,
  CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE concat('/p', CAST(p.p_partkey AS STRING), '.jpg') END AS poster_path,
  CASE WHEN p.p_partkey % 3 = 0 THEN NULL ELSE d.text END AS overview, d.lang AS original_language,
  CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE p.p_brand END AS director,
  concat_ws(', ', s1.s_name, s2.s_name) AS cast_list, p.p_size AS runtime,
  CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE CAST(p.p_size AS DOUBLE) / 5 END AS vote_average
FROM {part} p CROSS JOIN (SELECT count(*) AS nd FROM {documents}) nd CROSS JOIN (SELECT count(*) AS ns FROM {supplier}) ns
JOIN {documents} d ON d.doc_id = p.p_partkey % nd.nd
JOIN {supplier} s1 ON s1.s_suppkey = p.p_partkey % ns.ns
JOIN {supplier} s2 ON s2.s_suppkey = (p.p_partkey * 7 + 3) % ns.ns
"""

TAGS_SQL = """
SELECT o.o_custkey + 1 AS user_id, l.l_partkey + 1 AS item_id,
  concat(lower(substr(o.o_orderpriority, 3)), '_', lower(c.c_mktsegment)) AS tag, l.l_shipdate AS ts
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
"""


class Tables:
    """Tables of one folder, and the frames made from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._ratings: DataFrame | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, statement: str, *names: str) -> DataFrame:
        return self.spark.sql(statement, **{n: self.read(n) for n in names})

    def changes(self) -> DataFrame:
        """The raw log of rating changes, in order of (ts, seq, line, quantity)."""
        return self._sql(CHANGES_SQL, "lineitem", "orders")

    def ratings(self) -> DataFrame:
        """The latest rating of each user and item. They are found once and kept, as most
        queries read them several times and each time would join and sort the whole log. The
        log is dealt by user, so that the ratings of a user lie together and count up to a row before a shuffle."""
        if self._ratings is None:
            self._ratings = keep(self.spark.sql(RATINGS_SQL, changes=self.changes().repartition("user_id")), "ratings")
        return self._ratings

    def items(self) -> DataFrame:
        return self._sql(ITEMS_SQL, "part", "documents", "supplier")

    def tags(self) -> DataFrame:
        return self._sql(TAGS_SQL, "lineitem", "orders", "customer")

    def factors(self, keys: DataFrame, key: str, times: int) -> DataFrame:
        """(key, features, bias) with vectors of ``embeddings``, dealt by key * times
        modulo their number; the bias is a hundredth of the label. Vectors keep their
        single precision, half the bytes in a shuffle; products are of doubles."""
        spark = self.spark
        return spark.sql(
            f"""SELECT k.{key}, e.embedding AS features, CAST(e.label AS DOUBLE) / 100 AS bias
            FROM {{keys}} k CROSS JOIN (SELECT count(*) AS n FROM {{e}}) n JOIN {{e}} e ON e.vec_id = (k.{key} * {times}) % n.n""",
            keys=keys.select(key).distinct(),
            e=self.read("embeddings"),
        )

    def user_factors(self) -> DataFrame:
        return self.factors(self.ratings(), "user_id", 1)

    def item_factors(self) -> DataFrame:
        return self.factors(self.ratings(), "item_id", 7)


def with_tables(body: str) -> str:
    """DuckDB statement ``body`` with the same frames in front of it."""
    plain = {n: n for n in ("lineitem", "orders", "part", "documents", "supplier", "customer")}
    return (
        f"WITH changes AS ({CHANGES_SQL.format(**plain)}), ratings AS ({RATINGS_SQL.format(changes='changes')}), "
        f"items AS ({ITEMS_SQL.format(**plain)}), tags AS ({TAGS_SQL.format(**plain)}), "
        "user_factors AS (SELECT k.user_id, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS features, CAST(e.label AS DOUBLE) / 100 AS bias "
        "FROM (SELECT DISTINCT user_id FROM ratings) k JOIN embeddings e ON e.vec_id = k.user_id % (SELECT count(*) FROM embeddings)), "
        "item_factors AS (SELECT k.item_id, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS features, CAST(e.label AS DOUBLE) / 100 AS bias "
        "FROM (SELECT DISTINCT item_id FROM ratings) k JOIN embeddings e ON e.vec_id = (k.item_id * 7) % (SELECT count(*) FROM embeddings)) "
        + body
    )
