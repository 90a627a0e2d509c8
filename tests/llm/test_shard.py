import zlib

from affinity.llm.shard import byte_shards


def brute(rows, shards):
    sized = sorted(((-1 if d is None else d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    total, upto, out, slots = sum(s for _, s, _ in sized), 0, [], {}
    for d, s, c in sized:
        upto += s
        shard = min(shards - 1, shards * (2 * upto - s) // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.append((d, s, c, shard, slots[shard]))
    return out


def test_matches_brute_force(spark):
    rows = [(i, "é" * (i * 37 % 101)) for i in range(300)] + [(None, "x"), (5, None), (5, None), (7, "z" * 4000), (7, "")]
    docs = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, shard int").repartition(7)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in byte_shards(docs, 8).collect())
    assert got == sorted(brute(rows, 8))


def test_one_text_larger_than_a_shard_and_empty(spark):
    docs = spark.createDataFrame([(1, "a" * 1000), (2, "b"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: (r.shard, r.slot) for r in byte_shards(docs).collect()} == {1: (3, 0), 2: (7, 0), 3: (7, 1)}
    assert byte_shards(docs.limit(0)).count() == 0
