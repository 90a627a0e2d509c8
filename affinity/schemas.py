"""Column types of the recommendation tables, and constants of the scoring rules."""

from __future__ import annotations

# Scales, thresholds and weights that results depend on.
RATING_LOW, RATING_HIGH = 0.5, 5.0
HALF_LIFE_SECONDS = 31_557_600.0
LIKED, LIKED_FALLBACK = 4.0, 3.0
PROFILE_FLOOR = 3.5
RELEVANT, TOP_K = 3.5, 10
RATING_WEIGHT, CONTENT_WEIGHT = 0.7, 0.3
CONTENT_POOL = 100
COLD_START = 5
EXPLAIN_FLOOR = 0.05
TTL_SECONDS = 3600
HISTORY_ROWS = 500
RECENT_ROWS = 20
TOP_TAGS = 15
TOP_GENRES = 4
MAX_TERMS, MIN_DF, MAX_DF_SHARE = 50_000, 2, 0.95
NO_GENRES = "(no genres listed)"
POPULAR_REASON = "Recommended because it's currently popular"
POSTER_BASE, BACKDROP_BASE = "https://image.tmdb.org/t/p/w500", "https://image.tmdb.org/t/p/original"
CAST_NAMES, DIRECTORS = 5, 2

#: English stop words, as in Spark ML's list; fixed values.
STOP_WORDS = """
    a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot could
    couldn't did didn't do does doesn't doing don don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's
    her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself just let's me more most mustn't my
    myself no nor not now of off on once only or other ought our ours ourselves out over own s same shan't she she'd she'll she's should shouldn't so some
    such t than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under
    until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's will with
    won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()

#: Genre names of the discover feed; fixed values.
GENRE_NAMES = {
    28: "Action",
    12: "Adventure",
    16: "Animation",
    35: "Comedy",
    80: "Crime",
    99: "Documentary",
    18: "Drama",
    10751: "Family",
    14: "Fantasy",
    36: "History",
    27: "Horror",
    10402: "Music",
    9648: "Mystery",
    10749: "Romance",
    878: "Sci-Fi",
    10770: "TV Movie",
    53: "Thriller",
    10752: "War",
    37: "Western",
}

ITEMS_CSV = "movieId bigint, title string, genres string"
RATINGS_CSV = "userId bigint, movieId bigint, rating double, timestamp bigint"
LINKS_CSV = "movieId bigint, imdbId string, tmdbId string"
TAGS_CSV = "userId bigint, movieId bigint, tag string, timestamp bigint"
DETAILS_JSON = (
    "tmdb_id string, status int, poster_path string, backdrop_path string, overview string, release_date string, runtime int, "
    "vote_average double, original_language string, tagline string, "
    "credits struct<crew: array<struct<name: string, job: string>>, cast: array<struct<name: string>>>"
)
DISCOVER_JSON = (
    "id bigint, title string, release_date string, popularity double, vote_average double, original_language string, "
    "genre_ids array<int>, overview string"
)
