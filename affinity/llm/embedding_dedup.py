"""Embedding near-dedup by navigable small-world graphs (operator 7).

Vectors that are equal in every component are one point with a weight. Points are
dealt over shards, each indexed by a graph (``hnsw``) in one task and kept. Blocks of
points query every shard: a beam search finds a point's surroundings, from which all
points in reach are followed. Before a block queries a shard, ``AUDIT`` of its points and
as many moved copies of the shard's own points (so that there always are true links to
find) are searched by brute force too, self-matches aside; while recall of links is
under ``RECALL`` the beam is widened, and after the widest beam the block is compared
exactly. Pairs near the threshold are decided in double precision.

Where many points of a shard lie close together, the graph has one of them, the leader
of a ball; the shard holds the members and the ball's radius. A query whose angle to the
leader puts the whole ball in reach or out of reach needs no more; for the rest members
are compared. So a dense cluster never becomes a list of its pairs. A task returns the
number of links of each query, and of the links themselves only a spanning forest.

Shards hold about ``SHARD`` points or ``SHARD_BYTES`` of components, whichever is less, so
tasks stay bounded for vectors of any length; the number of shards that every point
queries grows with the data.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, and so do rows without an id; vectors link only with ones of their length.
Repeated rows of one id and vector count once, and each is returned. A row without an id
has no component and is kept. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import prepare, table
from .components import components
from .exchange import forest
from .hnsw import Graph, unit

#: An Arrow cell holds a shard's vectors, and must stay under 2 GB.
SHARD, SHARD_BYTES, LEAST_SHARDS = 100_000, 256 << 20, 6
AUDIT, RECALL = 256, 0.99
#: Beam at first and at most, how far below the threshold links are followed, queries at a time.
BEAM, WIDEST, SLACK, CHUNK = 32, 512, 0.05, 2048
#: Single-precision similarities this close to the threshold are computed again.
NEAR = 1e-5
#: Points looked at for balls, of which a ball's leader has at least so many around it, and cosine of a ball.
SEEDS, CROWD, BALL = 1024, 4, 0.95


def balls(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaders, and for each point the number of its ball, or -1."""
    seeds = np.unique(np.linspace(0, len(x) - 1, min(SEEDS, len(x))).astype(np.int64))
    near = x[seeds] @ x[seeds].T >= BALL
    leaders, covered = [], np.zeros(len(seeds), bool)
    for i in np.flatnonzero(near.sum(axis=1) >= CROWD):
        if not covered[i]:
            leaders.append(seeds[i])
            covered |= near[i]
    ball = np.full(len(x), -1, np.int32)
    for a in range(0, len(x) if leaders else 0, CHUNK):
        sims = x[a : a + CHUNK] @ x[leaders].T
        best = sims.argmax(axis=1)
        ball[a : a + CHUNK] = np.where(np.take_along_axis(sims, best[:, None], 1)[:, 0] >= BALL, best, -1)
    ball[leaders] = np.arange(len(leaders))
    return np.array(leaders, np.int64), ball


class Shard:
    """Unit vectors with weights, their balls, and a graph over leaders and points outside balls."""

    def __init__(self, exact: np.ndarray, ids: np.ndarray, weights: np.ndarray, ball: np.ndarray, leaders: np.ndarray, graph: Graph | list[bytes] | None = None):
        self.x, self.ids, self.weights, self.ball, self.leaders = exact, ids, weights, ball, leaders
        alone = ball < 0
        alone[leaders] = True
        self.nodes = np.flatnonzero(alone)
        self.graph = Graph.build(exact[self.nodes]) if graph is None else Graph.unpack(exact[self.nodes], graph)
        order = np.argsort(ball, kind="stable")
        self.members = np.split(order, np.searchsorted(ball[order], np.arange(len(leaders))))[1:]
        self.radius = np.array([np.arccos(np.clip((exact[m] @ exact[c]).min(), -1, 1)) for m, c in zip(self.members, leaders, strict=True)])
        self.mass = np.array([weights[m].sum() for m in self.members], np.int64)

    def pairs(self, q: np.ndarray, least: float, beam: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of cosine ``least`` or more outside balls; by brute force without a beam."""
        if beam is None:
            row, at = np.nonzero(q @ self.x[self.nodes].T >= least)
        else:
            row, at = self.graph.within(q, least - NEAR, min(beam, len(self.nodes)), SLACK)
        node = self.nodes[at]
        free = self.ball[node] < 0
        row, node = row[free], node[free]
        true = np.einsum("nd,nd->n", q[row], self.x[node]) >= least
        return row[true], node[true]

    def beam(self, q: np.ndarray, own: np.ndarray, least: float) -> int | None:
        """The narrowest beam whose recall passes the audit; None if none does."""
        pick = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(np.int64))
        near = np.unique(np.linspace(0, len(self.nodes) - 1, min(AUDIT, len(self.nodes))).astype(np.int64))
        x = self.x[self.nodes[near]]
        aside = np.random.default_rng(0).normal(size=x.shape)
        aside -= np.einsum("nd,nd->n", aside, x)[:, None] * x
        aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-300)
        cosine = (1 + least) / 2
        asked = np.concatenate([q[pick], cosine * x + np.sqrt(1 - cosine * cosine) * aside])
        name = np.concatenate([own[pick], np.full(len(near), np.iinfo(np.int64).min)])

        def links(beam: int | None) -> int:
            row, node = self.pairs(asked, least, beam)
            return int((self.ids[node] != name[row]).sum())

        true, beam = links(None), BEAM
        while links(beam) < RECALL * true:
            if beam >= min(WIDEST, len(self.nodes)):
                return None
            beam *= 4
        return beam

    def in_balls(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight in reach in balls for each query, and (query, node) pairs: one for each ball in reach."""
        count, rows, nodes = np.zeros(len(q), np.int64), [], []
        if not len(self.leaders):
            return count, np.zeros(0, np.int64), np.zeros(0, np.int64)
        angle, limit = np.arccos(np.clip(q @ self.x[self.leaders].T, -1, 1)), np.arccos(least)
        whole = angle + self.radius <= limit - NEAR
        count += whole @ self.mass
        row, ball = np.nonzero(whole)
        rows.append(row)
        nodes.append(self.leaders[ball])
        partly = ~whole & (angle - self.radius <= limit + NEAR)
        for b in np.flatnonzero(partly.any(axis=0)):
            row, members = np.flatnonzero(partly[:, b]), self.members[b]
            for a in range(0, len(members), 8 * CHUNK):
                part = members[a : a + 8 * CHUNK]
                hit = q[row] @ self.x[part].T >= least
                count[row] += hit @ self.weights[part]
                some = hit.any(axis=1)
                rows.append(row[some])
                nodes.append(part[hit[some].argmax(axis=1)])
        return count, np.concatenate(rows), np.concatenate(nodes)

    def query(self, q: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight linked with each query (its own id aside), and a forest (a, b) of ids over the links."""
        beam = self.beam(q, own, least)
        order = np.argsort(self.ids)
        place = order[np.minimum(np.searchsorted(self.ids[order], own), len(order) - 1)]
        here = self.ids[place] == own  # queries that are points of this shard
        links, a, b = np.zeros(len(q), np.int64), [], []
        for i in range(0, len(q), CHUNK):
            part = q[i : i + CHUNK]
            row, node = self.pairs(part, least, beam)
            count, ball_row, ball_node = self.in_balls(part, least)
            other = self.ids[node] != own[i + row]
            links[i : i + CHUNK] = count + np.bincount(row[other], self.weights[node[other]], len(part)).astype(np.int64)
            x, y = forest(own[i + np.concatenate([row, ball_row])], self.ids[np.concatenate([node, ball_node])])
            a.append(x)
            b.append(y)
        mine = here & (self.ball[place] >= 0)
        links[mine] -= self.weights[place[mine]]
        a, b = forest(np.concatenate(a), np.concatenate(b))
        return links, a, b


def shards_for(points: int, components: int, itemsize: int) -> int:
    """Shards for so many points that have so many components together."""
    return max(LEAST_SHARDS, -(-points // SHARD), -(-components * itemsize // SHARD_BYTES))


def near_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    points = (
        rows.where(sound)
        .distinct()
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
        .withColumn("dim", F.size("embedding"))
        .withColumn("point", F.xxhash64("embedding", "rep"))
        .checkpoint()
    )
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else np.float64
    size = points.agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("dim"), F.lit(0)).alias("components")).first()
    shards = shards_for(size.points, size.components, np.dtype(kind).itemsize)
    dealt = points.select("rep", "weight", "embedding", "dim", F.pmod("point", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("point"), F.lit(shards)).cast("int").alias("block"))

    def stacked(vectors: pd.Series) -> np.ndarray:
        return np.stack([np.asarray(v, kind) for v in vectors])

    def index(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep").sample(frac=1, random_state=0)
        raw, ids, weights = stacked(part["embedding"]), part["rep"].to_numpy(np.int64), part["weight"].to_numpy(np.int64)
        exact = unit(raw.astype(np.float64))
        leaders, ball = balls(exact.astype(np.float32))
        shard = Shard(exact, ids, weights, ball, leaders)
        held = {"ids": ids, "weights": weights, "vectors": raw, "balls": ball, "leaders": leaders}
        return pd.DataFrame({"dim": [len(raw[0])], "shard": [int(part["shard"].iloc[0])], **{k: [v.tobytes()] for k, v in held.items()}, "graph": [shard.graph.pack()]})

    schema = "dim int, shard int, ids binary, weights binary, vectors binary, balls binary, leaders binary, graph array<binary>"
    graphs = dealt.groupBy("dim", "shard").applyInPandas(index, schema).checkpoint()
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = dealt.drop("shard").withColumn("shard", every).select("dim", "shard", "block", "rep", "embedding")
    held = graphs.withColumn("block", every)

    def query(own: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(graph):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "b", "links")})
        g = graph.iloc[0]
        raw = np.frombuffer(g["vectors"], kind).reshape(-1, int(g["dim"]))
        ids, weights, leaders = (np.frombuffer(g[c], np.int64) for c in ("ids", "weights", "leaders"))
        shard = Shard(unit(raw.astype(np.float64)), ids, weights, np.frombuffer(g["balls"], np.int32), leaders, list(g["graph"]))
        own = own.sort_values("rep")
        rep = own["rep"].to_numpy(np.int64)
        links, a, b = shard.query(unit(stacked(own["embedding"]).astype(np.float64)), rep, least)
        some = np.flatnonzero(links)
        counts = pd.DataFrame({"a": rep[some], "b": -1, "links": links[some]})
        return pd.concat([counts, pd.DataFrame({"a": a, "b": b, "links": 0})]).astype(np.int64)

    keys = ["dim", "shard", "block"]
    out = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(query, "a long, b long, links long").checkpoint()
    links = out.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(out.where("links = 0").select("a", "b"))
    labelled = (
        points.select("embedding", "rep", "weight")
        .join(links, F.col("rep") == F.col("a"), "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "rep").alias("root"))
    )
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    return (
        rows.join(labelled.withColumnRenamed("embedding", "e"), F.when(sound, F.col("embedding")) == F.col("e"), "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op7_embedding_near_dedup(spark, sf_dir):
    return near_pairs(table(spark, sf_dir, "embeddings"), 0.9)


#: Cosines of all pairs in double precision.
SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), points AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM sound
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM points a JOIN points b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = e.vec_id), e.vec_id)) AS component_id,
  coalesce(e.vec_id <= coalesce((SELECT min(b) FROM reach WHERE reach.a = e.vec_id), e.vec_id), true) AS kept
FROM embeddings e
"""
