"""Parts of the DuckDB statements: further common frames, each with a leading comma."""

from __future__ import annotations

from .. import schemas as s


def clean(column: str) -> str:
    return rf"trim(lower(regexp_replace(regexp_replace({column}, '\s*\(\d{{4}}\)\s*$', ''), '[^\p{{L}}\p{{N}}_\s]', '', 'g')))"


DECADE = r"CASE WHEN regexp_extract(title, '\((\d{4})\)', 1) = '' THEN '' ELSE concat('decade_', substr(regexp_extract(title, '\((\d{4})\)', 1), 1, 3), '0s') END"

SCORED = f"""
, newest AS (SELECT max(epoch(ts)) AS mx FROM ratings),
pop AS (SELECT item_id, avg(rating) * ln(1 + count(*)) AS p FROM ratings GROUP BY item_id),
trend AS (
  SELECT item_id, sum(rating * w) / sum(w) * ln(1 + sum(w)) AS t
  FROM (SELECT item_id, rating, power(CAST(2 AS DOUBLE), -(mx - epoch(ts)) / {s.HALF_LIFE_SECONDS}) AS w FROM ratings, newest) GROUP BY item_id
), scored AS (
  SELECT i.*, round(coalesce(p, 0), 6) AS popularity_score, round(coalesce(t, 0), 6) AS trending_score
  FROM items i LEFT JOIN pop ON pop.item_id = i.id LEFT JOIN trend ON trend.item_id = i.id
) """

TAGGED = (
    SCORED
    + f""", tag_counts AS (SELECT item_id, lower(trim(tag)) AS tag, count(*) AS c FROM tags GROUP BY 1, 2),
tag_ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, tag) AS r FROM tag_counts),
best_tags AS (SELECT item_id, string_agg(tag, ' ' ORDER BY r) AS user_tags FROM tag_ranks WHERE r <= {s.TOP_TAGS} GROUP BY item_id),
tagged AS (SELECT scored.*, user_tags FROM scored LEFT JOIN best_tags ON best_tags.item_id = scored.id) """
)


def _channel(expression: str) -> str:
    return f"CASE WHEN trim({expression}) <> '' THEN {expression} END"


_GENRES = f"CASE WHEN genres <> '{s.NO_GENRES}' THEN replace(genres, '|', ' ') END"
_PARTS = [_GENRES] * 3 + [clean("title"), "lower(overview)"] + [clean("director")] * 2 + [clean("cast_list"), "lower(user_tags)", DECADE]
_PARTS.append("CASE WHEN original_language <> 'en' THEN concat('lang_', original_language) END")
FEATURE_TEXT = "concat_ws(' ', " + ", ".join(map(_channel, _PARTS)) + ")"

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in s.STOP_WORDS) + "]"
TERMS = rf"""
, words AS (
  SELECT id AS item_id, list_filter(regexp_extract_all(lower({FEATURE_TEXT}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w)) AS w FROM tagged
), counts AS (
  SELECT item_id, term, count(*) AS tf FROM (
    SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS term FROM words
  ) GROUP BY item_id, term
), vocab AS (
  SELECT term, count(*) AS df FROM counts GROUP BY term
  HAVING count(*) >= {s.MIN_DF} AND count(*) <= {s.MAX_DF_SHARE} * (SELECT count(*) FROM items) ORDER BY sum(tf) DESC, term LIMIT {s.MAX_TERMS}
) """

WEIGHTS = """
, raw_weights AS (
  SELECT item_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM items)) / (1 + df)) + 1) AS w FROM counts JOIN vocab USING (term)
), weights AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM raw_weights) """

SIMILAR = """
SELECT item_id, other_id, similarity, rank, title, genres FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, other_id) AS rank FROM (
    SELECT a.item_id, b.item_id AS other_id, round(sum(a.w * b.w), 6) AS similarity
    FROM weights a JOIN weights b ON a.term = b.term AND a.item_id <> b.item_id GROUP BY 1, 2) WHERE similarity > 0) JOIN items ON items.id = other_id WHERE rank <= 10
"""

PROFILES = f"""
, best_ratings AS (SELECT *, max(rating) OVER (PARTITION BY user_id) AS best FROM ratings),
profiles AS (
  SELECT user_id, term, sum(rating * w) AS p FROM best_ratings JOIN weights USING (item_id)
  WHERE rating >= {s.PROFILE_FLOOR} OR best < {s.PROFILE_FLOOR} GROUP BY user_id, term
) """

CONTENT = """
, unit_profiles AS (SELECT user_id, term, p / sqrt(sum(p * p) OVER (PARTITION BY user_id)) AS p FROM profiles),
content_sums AS (SELECT user_id, item_id, round(sum(p * w), 6) AS similarity FROM unit_profiles JOIN weights USING (term) GROUP BY user_id, item_id),
content AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, item_id) AS rank
  FROM content_sums ANTI JOIN ratings USING (user_id, item_id) WHERE similarity > 0
) """

POPULAR = """
, pop AS (SELECT item_id, round(avg(rating) * ln(1 + count(*)), 6) AS popularity_score FROM ratings GROUP BY item_id),
lists AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY popularity_score DESC, item_id) AS rank
  FROM (SELECT DISTINCT user_id FROM ratings) u CROSS JOIN pop ANTI JOIN ratings USING (user_id, item_id)
) """

SPLIT = """
, parts AS (SELECT *, CAST(concat('0x', substr(md5(concat_ws(':', user_id, item_id)), 1, 8)) AS BIGINT) % 100 < 80 AS is_train FROM ratings),
train AS (SELECT user_id, item_id, rating, ts FROM parts WHERE is_train), test AS (SELECT user_id, item_id, rating, ts FROM parts WHERE NOT is_train) """

TRAIN_LISTS = """
, pop AS (SELECT item_id, round(avg(rating) * ln(1 + count(*)), 6) AS popularity_score FROM train GROUP BY item_id),
recs AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY popularity_score DESC, item_id) AS rank
    FROM (SELECT DISTINCT user_id FROM test) u CROSS JOIN pop ANTI JOIN train USING (user_id, item_id)
  ) WHERE rank <= 10
) """

HITS = f"""
, relevant AS (SELECT DISTINCT user_id, item_id FROM test WHERE rating >= {s.RELEVANT}),
marked AS (SELECT r.user_id, r.item_id, r.rank, CASE WHEN v.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM recs r LEFT JOIN relevant v ON r.user_id = v.user_id AND r.item_id = v.item_id),
hits AS (SELECT *, CAST(sum(hit) OVER (PARTITION BY user_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hits FROM marked) """

RANK_METRICS = """
, per_user AS (
  SELECT v.user_id, v.rel, coalesce(h.found, 0) AS found, coalesce(h.ap, 0) AS ap, coalesce(h.dcg, 0) AS dcg
  FROM (SELECT user_id, count(*) AS rel FROM relevant GROUP BY user_id) v
  LEFT JOIN (SELECT user_id, sum(hit) AS found, sum(hit * hits / rank) AS ap, sum(hit / log2(rank + 1)) AS dcg FROM hits GROUP BY user_id) h ON h.user_id = v.user_id
)
SELECT count(*) AS users, round(avg(found / 10), 6) AS precision_at_k, round(avg(found / rel), 6) AS recall_at_k,
  round(avg(ap / least(10, rel)), 6) AS map_at_k,
  round(avg(dcg / list_sum(list_transform(range(1, CAST(least(10, rel) AS BIGINT) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg_at_k
FROM per_user
"""

EVALUATED = f"""
, shown AS (SELECT * FROM recs WHERE user_id IN (SELECT user_id FROM test WHERE rating >= {s.RELEVANT})) """

DIVERSITY = """
, sets AS (SELECT r.user_id, r.rank, list_distinct(list_filter(list_transform(string_split(i.genres, '|'), lambda x: lower(trim(x))), lambda x: x <> '')) AS g
  FROM shown r JOIN items i ON i.id = r.item_id),
pairs AS (
  SELECT a.user_id, CASE WHEN len(list_distinct(list_concat(a.g, b.g))) > 0
    THEN 1 - len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) ELSE 1 END AS d
  FROM sets a JOIN sets b ON a.user_id = b.user_id AND a.rank < b.rank
)
SELECT round(avg(d), 6) AS diversity FROM (SELECT user_id, avg(d) AS d FROM pairs GROUP BY user_id)
"""

NOVELTY = """
SELECT round(avg(own), 6) AS novelty FROM (
  SELECT user_id, avg(-log2((coalesce(c, 0) + 1) / ((SELECT count(*) FROM train) + (SELECT count(*) FROM items)))) AS own
  FROM shown LEFT JOIN (SELECT item_id, count(*) AS c FROM train GROUP BY item_id) n USING (item_id) GROUP BY user_id)
"""

TOP_GENRES = f"""
, recent AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS n FROM ratings),
liked AS (SELECT user_id, unnest(string_split(i.genres, '|')) AS genre FROM recent r JOIN items i ON i.id = r.item_id WHERE n <= {s.RECENT_ROWS} AND rating >= {s.LIKED}),
sums AS (SELECT user_id, genre, count(*) AS liked FROM liked WHERE trim(genre) <> '' AND genre <> '{s.NO_GENRES}' GROUP BY user_id, genre)
SELECT user_id, genre, liked, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY liked DESC, genre) AS rank FROM sums) WHERE rank <= {s.TOP_GENRES}
"""

OVERLAP = """
, sets AS (SELECT item_id, list_distinct(list(string_split(tag, '_')[1])) AS a, list_distinct(['high', 'urgent', string_split(any_value(genres), '|')[1]]) AS b
  FROM tags JOIN items ON items.id = tags.item_id GROUP BY item_id)
SELECT item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS overlap FROM sets
"""

LATENT = """
, sized AS (SELECT item_id, features, greatest(sqrt(list_dot_product(features, features)), 1e-9) AS size FROM item_factors),
cosines AS (
  SELECT a.item_id, b.item_id AS other_id, round(list_dot_product(a.features, b.features) / (a.size * b.size), 6) AS similarity
  FROM sized a JOIN sized b ON a.item_id <> b.item_id
)
SELECT item_id, other_id, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, other_id) AS rank FROM cosines WHERE similarity > 0
) WHERE rank <= 10
"""

BIASES = """
, centred AS (SELECT *, rating - (SELECT avg(rating) FROM ratings) AS d FROM ratings),
item_bias AS (SELECT item_id, sum(d) / (5.0 + count(*)) AS b FROM centred GROUP BY item_id),
user_bias AS (SELECT user_id, sum(d - b) / (5.0 + count(*)) AS b FROM centred JOIN item_bias USING (item_id) GROUP BY user_id)
SELECT 'item' AS kind, item_id AS id, round(b, 6) AS bias FROM item_bias UNION ALL SELECT 'user', user_id, round(b, 6) FROM user_bias
"""

_RATING = f"least(greatest((SELECT avg(rating) FROM ratings) + u.bias + i.bias + list_dot_product(u.features, i.features), {s.RATING_LOW}), {s.RATING_HIGH})"
PREDICT = f"""
, predicted AS (SELECT r.user_id, r.item_id, r.rating, {_RATING} AS raw, round({_RATING}, 6) AS prediction
  FROM ratings r JOIN user_factors u ON u.user_id = r.user_id JOIN item_factors i ON i.item_id = r.item_id) """

PREDICT_ALL = f"""
, open_pairs AS (SELECT u.user_id, i.item_id, round({_RATING}, 6) AS prediction FROM user_factors u, item_factors i),
open_items AS (SELECT * FROM open_pairs ANTI JOIN ratings USING (user_id, item_id)) """

HYBRID = (
    TAGGED + TERMS + WEIGHTS + PROFILES + CONTENT + PREDICT_ALL
    + f""", blended AS (
  SELECT o.user_id, o.item_id, round(o.prediction, 2) AS rating_prediction, round(coalesce(c.similarity, 0), 3) AS content_similarity,
    round({s.RATING_WEIGHT} * (o.prediction - 0.5) / 4.5 + {s.CONTENT_WEIGHT} * coalesce(c.similarity, 0), 8) AS score
  FROM open_items o LEFT JOIN (SELECT * FROM content WHERE rank <= {s.CONTENT_POOL}) c ON c.user_id = o.user_id AND c.item_id = o.item_id
), hybrid AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM blended) """
)

_NAMES = "[" + ", ".join(f"'{n}'" for n in s.GENRE_NAMES.values()) + "]"
DISCOVER = f"""
, feed AS (
  SELECT CAST(o_orderkey + 1 AS VARCHAR) AS tmdb_id, concat('Order ', o_orderkey) AS title, strftime(o_orderdate, '%Y-%m-%d') AS release_date,
    round(o_totalprice / 1000, 2) AS popularity, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 10 AS DOUBLE) END AS vote,
    CASE WHEN o_orderkey % 3 > 0 THEN {_NAMES}[o_orderkey % 19 + 1] ELSE 'Drama' END AS genres
  FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1999-12-31'
)
SELECT (SELECT max(id) FROM items) + row_number() OVER (ORDER BY popularity DESC NULLS LAST, tmdb_id) AS id,
  concat(title, ' (', substr(release_date, 1, 4), ')') AS title, genres, tmdb_id, round(popularity, 2) AS popularity_score,
  round(popularity * coalesce(vote, 7.0) / 5, 2) AS trending_score, release_date, coalesce(vote, 7.0) AS vote_average, 'en' AS original_language
FROM feed WHERE tmdb_id NOT IN (SELECT tmdb_id FROM items)
"""


def _set(side: str, column: str, pattern: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({side}.{column}, ''), '{pattern}'), lambda x: lower(trim(x))), lambda x: x <> ''))"


def _overlap(column: str, pattern: str, name: str) -> str:
    a, b = (_set(x, column, pattern) for x in "ab")
    return f"CASE WHEN c.liked_id IS NULL THEN NULL WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0 ELSE round(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))), 3) END AS {name}"


_RATING_PART = f"{s.RATING_WEIGHT} * (rating_prediction - 0.5) / 4.5"
_CONTENT_PART = f"{s.CONTENT_WEIGHT} * content_similarity"
EXPLAIN = f"""
, rated AS (SELECT *, max(rating) OVER (PARTITION BY user_id) AS top FROM ratings),
likes AS (SELECT user_id, item_id AS liked_id FROM rated WHERE rating >= CASE WHEN top >= {s.LIKED} THEN {s.LIKED} ELSE {s.LIKED_FALLBACK} END),
recs AS (SELECT * FROM hybrid WHERE rank <= 10),
pairs AS (SELECT r.user_id, r.item_id, l.liked_id FROM recs r JOIN likes l ON l.user_id = r.user_id WHERE r.item_id <> l.liked_id),
cosines AS (
  SELECT p.item_id, p.liked_id, round(sum(x.w * y.w), 6) AS cosine FROM (SELECT DISTINCT item_id, liked_id FROM pairs) p
  JOIN weights x ON x.item_id = p.item_id JOIN weights y ON y.item_id = p.liked_id AND y.term = x.term GROUP BY 1, 2
), closest AS (
  SELECT * FROM (SELECT p.*, cosine, row_number() OVER (PARTITION BY p.user_id, p.item_id ORDER BY cosine DESC, p.liked_id) AS n
    FROM pairs p JOIN cosines k ON k.item_id = p.item_id AND k.liked_id = p.liked_id WHERE cosine > {s.EXPLAIN_FLOOR}) WHERE n = 1
)
SELECT r.user_id, r.item_id, c.liked_id AS because_id, b.title AS because_title, round(cosine, 3) AS similarity,
  {_overlap("genres", "[|]", "genre_overlap")}, {_overlap("cast_list", ",", "cast_overlap")}, {_overlap("user_tags", "[ ]+", "tag_overlap")},
  CASE WHEN c.liked_id IS NOT NULL THEN coalesce(lower(trim(a.director)) = lower(trim(b.director)), false) END AS same_director,
  CASE WHEN {_RATING_PART} + {_CONTENT_PART} > 0 THEN round({_RATING_PART} / ({_RATING_PART} + {_CONTENT_PART}), 3) ELSE 0 END AS rating_weight,
  CASE WHEN {_RATING_PART} + {_CONTENT_PART} > 0 THEN round({_CONTENT_PART} / ({_RATING_PART} + {_CONTENT_PART}), 3) ELSE 0 END AS content_weight
FROM recs r LEFT JOIN closest c ON c.user_id = r.user_id AND c.item_id = r.item_id
LEFT JOIN tagged a ON a.id = r.item_id LEFT JOIN tagged b ON b.id = c.liked_id
"""
