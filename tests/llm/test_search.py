"""Nearest neighbours, sharding, url rules and image copies against brute force."""

import bisect
import collections
import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpwood.llm import media
from kelpwood.llm.ann import search
from kelpwood.llm.queries import op6_url_filter
from kelpwood.llm.sharding import assign_shards
from kelpwood.llm.urlfilter import filter_urls


def recall(df):
    """Share of the true 20 nearest that the query's parameters find; ranks, ties and scores are checked."""
    got = collections.defaultdict(list)
    for r in search(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    e = df.orderBy("vec_id").toPandas()
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding.to_numpy()).astype(float)
    hit = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        s[i] = -np.inf
        top = np.lexsort((ids, -s))[:20]
        rows = sorted(got[ids[i]])
        assert [r[0] for r in rows] == list(range(1, 21))
        assert np.allclose([r[2] for r in rows], s[np.searchsorted(ids, [r[1] for r in rows])], atol=1e-12)
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        hit += len(set(ids[top]) & {r[1] for r in rows})
    return hit / (20 * len(got))


def test_recall(spark):
    assert recall(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")) >= 0.9


@pytest.mark.parametrize("jitter", [0.05, 0.4])
def test_recall_of_more_rows(spark, jitter):
    """20,000 rows around the table's vectors."""
    base = np.stack(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().embedding.to_numpy()).astype(float)
    rng = np.random.default_rng(2)
    x = base[rng.integers(0, len(base), 20000)] + rng.normal(size=(20000, base.shape[1])) * jitter * base.std()
    assert recall(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")) >= 0.9


@pytest.mark.parametrize("kind", ["apart", "huge"])
def test_nearest_of_other_rows(spark, kind):
    """Queries that point away from all other rows, which no sample of rows is like, and components beyond single precision: nothing is missed."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 24))
    asks = np.arange(len(x)) % 20 == 0
    if kind == "apart":
        x[~asks, 1] += 5
        x[asks] *= -0.01
        x[asks, 1] -= 5
    else:
        x *= 1e30
    got = collections.defaultdict(set)
    for r in search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got[r["query_id"]].add(r["vec_id"])
    for i in np.flatnonzero(asks):
        s = x @ x[i]
        s[i] = -np.inf
        assert got[i] == set(np.argsort(-s)[:20])


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (80, [1.0, None]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (None, [1.0, 1.0]), (4, [1.0, 2.0, 3.0]), (2, [1.0, 0.0]), (5, [float("inf"), 0.0])]
    got = search(spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, -1.0)]
    assert search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def insert_all(keys, shards, virtual, eps):
    nodes = sorted((int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(virtual))
    n, starts = len(keys), [p for p, _ in nodes]
    room = [math.ceil(n * (1 + eps) / shards)] * shards if eps else [n // shards + (s < n % shards) for s in range(shards)]
    at = [(int(hashlib.md5(str("" if k is None else k).encode()).hexdigest()[:8], 16), k) for k in keys]
    at.sort(key=lambda x: ((x[0] - starts[-1] - 1) % (1 << 32), x[1] is not None, x[1] or 0))
    out, slot = collections.defaultdict(list), [0] * shards
    for p, k in at:
        i = bisect.bisect_left(starts, p) % len(nodes)
        while not room[nodes[i][1]]:
            i = (i + 1) % len(nodes)
        s = nodes[i][1]
        room[s] -= 1
        out[k].append((s, slot[s]))
        slot[s] += 1
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("keys,shards,virtual,eps", [(list(range(1000)), 8, 128, 0.0), ([5] * 300 + list(range(500)) + [None] * 3, 8, 16, 0.0), (list(range(1500)), 5, 64, 0.05), ([1, 2, 3], 8, 32, 0.0)])
def test_ring(spark, keys, shards, virtual, eps):
    df = spark.createDataFrame([(k, "t", 0) for k in keys], "doc_id long, text string, slot int")
    got = collections.defaultdict(list)
    for r in assign_shards(df, "doc_id", shards, virtual, eps).collect():
        got[r["doc_id"]].append((r["shard"], r["slot"]))
    assert {k: sorted(v) for k, v in got.items()} == insert_all(keys, shards, virtual, eps)


def test_ring_empty(spark):
    assert assign_shards(spark.createDataFrame([], "doc_id long")).collect() == []


def test_url_rules(spark):
    rnd = random.Random(4)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "ample.com", "org", "x.org", "xorg"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab"]
    rules = list({(rnd.choice(hosts), rnd.choice(paths)): ("block", "allow")[rnd.randint(0, 1)] for _ in range(16)}.items())
    rows = [(v, h.upper() if rnd.random() < 0.3 else h, p) for (h, p), v in rules] + [("block", None, "/"), ("block", "", "/")]
    urls = [f"http://{rnd.choice(['', 'w.'])}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', 'c', '?q=1', '#t'])}" for _ in range(300)] + [None, "", "no scheme", "http://", "x://COM/a\nb", "http://com?x/a", "a://b://c"]
    df = spark.createDataFrame([(i % 290, u, "own") for i, u in enumerate(urls)], "page_id int, url string, rule string")

    def judge(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fit = [(-len(h + p), h + p, v) for (h, p), v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, min(fit)[1], min(fit)[2]) if fit else (host, path, None, "allow")

    got = filter_urls(df, spark.createDataFrame(rows, "verdict string, host string, path string"), salts=3)
    assert sorted(((r["page_id"], r["url"] or "-", r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()), key=str) == sorted(((i % 290, u or "-", *judge(u)) for i, u in enumerate(urls)), key=str)
    assert filter_urls(df, spark.createDataFrame([], "verdict string, host string, path string")).filter("verdict <> 'allow' or rule is not null").isEmpty()


def test_url_rules_of_the_contract(spark, tmp_path):
    """block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://a.net/de/1", "http://www.example.net/de/81", "http://example.net/de/7", "http://x.org/es/", "http://a.net/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op6_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(urls))] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow")]


def test_url_names_and_control_bytes(spark):
    """No byte of a host joins or ends labels but the point; columns named like helper columns pass through; repeated rows are each judged."""
    rows = [(1, "http://com\x01evil/a"), (2, "http://x.com/a"), (3, "http://com./a"), (4, "http://.com/a"), (5, "http://a..com/a"), (6, None), (2, "http://x.com/a"), (7, "http://com/" + "a" * 300000)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "page_id long, url string, best int, stack int, salt int, key int, `a b` int")
    got = filter_urls(df, spark.createDataFrame([("block", "com", "/a")], "verdict string, host string, path string"))
    assert got.columns == [*df.columns, "host", "path", "rule", "verdict"]
    assert sorted((r["page_id"], r["verdict"]) for r in got.collect()) == [(1, "allow"), (2, "block"), (2, "block"), (3, "allow"), (4, "block"), (5, "block"), (6, "allow"), (7, "block")]


def test_ring_of_hot_keys(spark):
    """A key that holds a third of all rows is dealt into parts; counts are still at most one apart and slots gapless. Helper names are free."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"t{i}", 1, 2, 3, 4) for i in range(36000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first int, within int, before int, runs int")
    got = collections.defaultdict(list)
    for r in assign_shards(df).collect():
        got[r["shard"]].append(r["slot"])
    assert sorted(len(v) for v in got.values()) == [4500] * 8 and all(sorted(v) == list(range(4500)) for v in got.values())


def test_image_headers():
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    raw = media.write_pgm(a)
    for bad in (b"P5 99999999999999999999 9 255\n", b"P5 400000000 400000000 255\nxx", b"P6 1 1 255\nx", b"P5 0 3 255\n", b"P5 4 3 65535\n" + bytes(24), raw[:-1], b"\n", None):
        assert media.read_pgm(bad) is None
    for good in (raw, b"P5 # made by hand\n4\t3 # size\n255\n" + a.tobytes()):
        assert (media.read_pgm(good) == a).all()


def plain_links(images, most_bits=24):
    """All pairs of images, by all their descriptors."""
    made = {i: media.describe(a[None].astype(np.float32))[0] for i, a in images.items()}
    packed = {i: (media._spots(pos), word.tobytes()) for i, (pos, word) in made.items()}
    return {(i, j) for i in images for j in images if i < j and media._linked(packed[i], packed[j], most_bits)}


def test_image_copies_against_all_pairs(spark):
    """The tables' links among all links of all pairs: at least 0.9, and no other."""
    rng = np.random.default_rng(6)
    images = {}
    for i in range(60):
        a = media.draw(rng.normal(size=64))
        images[10 * i] = a
        if i % 3 == 0:
            images |= {10 * i + 1: a[10:74, 6:70], 10 * i + 2: _noisy(a, i, 6), 10 * i + 3: np.rot90(a), 10 * i + 4: a.reshape(40, 2, 40, 2).mean((1, 3))}
    images = {-i: media.read_pgm(media.write_pgm(a)) for i, a in images.items()}
    want = plain_links(images)
    df = spark.createDataFrame([(i, media.write_pgm(a)) for i, a in images.items()], "media_id long, content binary")
    got = {r["media_id"]: r for r in media.copies(df).collect()}
    up = {i: i for i in images}
    for _ in range(6):
        for a, b in sorted(want):
            up[a] = up[b] = min(up[a], up[b])
    same = [got[i]["component_id"] == up[i] for i in images]
    assert np.mean(same) >= 0.9 and sum(r["n_links"] for r in got.values()) >= 0.9 * 2 * len(want)
    planted = [i for i in images if i % 10]
    assert np.mean([got[i]["component_id"] == got[i - i % -10 if i < 0 else i]["component_id"] for i in planted]) >= 0.9


def test_image_groups_of_any_size(spark):
    """A hundred noisy copies of one picture, and repeated ids and files."""
    rng = np.random.default_rng(12)
    x, y = media.draw(rng.normal(size=64)), media.draw(rng.normal(size=64))
    rows = [(100 + i, media.write_pgm(_noisy(x, i))) for i in range(100)] + [(300 + i, media.write_pgm(y)) for i in range(40)] + [(100, media.write_pgm(_noisy(x, 0)))] * 3
    got = media.copies(spark.createDataFrame(rows, "media_id long, content binary")).collect()
    assert len(got) == 143 and collections.Counter(r["component_id"] for r in got) == {100: 103, 300: 40}


def test_image_copies(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 40
    for i in range(n):
        a = media.draw(rng.normal(size=64))
        rows.append((10 * i, media.write_pgm(a)))
        if i % 4 == 0:
            rows += [(10 * i + 1, media.write_pgm(a[6:72, 12:76])), (10 * i + 2, media.write_pgm(np.clip(a * 0.8 + 20, 0, 255))), (10 * i + 3, media.write_pgm(a))]
    rows += [(5001, None), (5002, b""), (5003, b"P5 nonsense"), (None, rows[0][1])]
    got = {r["media_id"]: r for r in media.copies(spark.createDataFrame([(*r, 1) for r in rows], "media_id long, content binary, node int")).collect()}
    assert len(got) == len(rows)
    for i in range(n):
        for extra in range(4 if i % 4 == 0 else 1):
            assert got[10 * i + extra]["component_id"] == 10 * i
    assert all(got[i]["kept"] and got[i]["n_corners"] == 0 for i in (5001, 5002, 5003)) and got[None]["component_id"] is None
    assert media.copies(spark.createDataFrame([], "media_id long, content binary")).count() == 0


def _noisy(a, seed, most=3):
    return np.clip(a * 0.9 + 10 + np.random.default_rng(seed).integers(-most, most + 1, a.shape), 0, 255)


def test_image_copies_behind_a_shared_part(spark):
    """Copies whose lower half also occurs in an unrelated image with a smaller id; all links of a group are counted."""
    rng = np.random.default_rng(5)
    x, other = media.draw(rng.normal(size=64)), media.draw(rng.normal(size=64))
    few = np.concatenate([np.full((44, 80), 90), x[44:64], np.full((16, 80), 90)])
    rows = [(1, media.write_pgm(few)), (2, media.write_pgm(other))] + [(10 + i, media.write_pgm(_noisy(x, i))) for i in range(8)]
    got = {r["media_id"]: r for r in media.copies(spark.createDataFrame(rows, "media_id long, content binary")).collect()}
    assert len({got[10 + i]["component_id"] for i in range(8)}) == 1 and got[2]["component_id"] == 2
    assert min(got[10 + i]["n_links"] for i in range(8)) >= 7


def test_image_links_within_large_groups(spark, monkeypatch):
    """Every pair that shares five keys is compared, however many images have them and whichever is the least: links are those of plain counting."""
    monkeypatch.setattr(media, "BLOCK", 512)
    monkeypatch.setattr(media, "HELD", 16 << 10)
    rng = np.random.default_rng(15)
    x = media.draw(rng.normal(size=64))
    images = {50 + i: _noisy(x, i, 1) for i in range(24)}
    for i in range(14):  # a strip that many unlike images have
        images[i - 7] = np.concatenate([x[:24], media.draw(rng.normal(size=64))[24:]])
    images = {i: media.read_pgm(media.write_pgm(a)) for i, a in images.items()}
    made = {i: media.describe(a[None].astype(np.float32))[0] for i, a in images.items()}
    keys = {i: {(k % 4, w) for k, w in enumerate(np.ascontiguousarray(word).view(np.uint32).ravel().tolist())} for i, (_, word) in made.items()}
    want = {(i, j) for i, j in plain_links(images) if len(keys[i] & keys[j]) >= media.LEAST_VOTES}
    holders = collections.Counter(k for i in keys for k in keys[i])
    led = {i: {k for k in keys[i] if holders[k] <= media.SMALL} for i in keys}
    assert sum(len(led[i] & led[j]) < 2 for i, j in want) > 200  # few of them share rare keys
    got = {r["media_id"]: r for r in media.copies(spark.createDataFrame([(i, media.write_pgm(a)) for i, a in images.items()], "media_id long, content binary")).collect()}
    degree = collections.Counter(i for p in want for i in p)
    assert len(want) > 276 and all(got[i]["n_links"] >= degree[i] for i in images)
    assert sum(r["n_links"] for r in got.values()) <= 2 * len(plain_links(images))


def test_pairs_compared_at_once(monkeypatch):
    """Many pairs at once, of images of any number of corners, agree as each does alone."""
    monkeypatch.setattr(media, "PADDED", 75)  # some are compared one by one
    rng = np.random.default_rng(16)
    pictures = []
    for i in range(12):
        a = media.draw(rng.normal(size=64))
        pictures += [a, a[10:74, 6:70], _noisy(a, i), np.rot90(a)]
    made = [media.describe(media.read_pgm(media.write_pgm(a))[None].astype(np.float32))[0] for a in pictures]
    raw = {"corners": np.array([len(p) for p, _ in made]).tobytes(), "spots": b"".join(media._spots(p) for p, _ in made), "words": b"".join(w.tobytes() for _, w in made)}
    block = media._Images(raw | {"ids": np.arange(len(made)).tobytes(), "keys": b"", "owner": b"", "few": b""})
    i, j = np.triu_indices(len(made), 1)
    want = [k for k in range(len(i)) if media._linked(block.image(i[k]), block.image(j[k]), 24)]
    assert len(want) >= 40 and media._linked_pairs(block, block, i, j, 24).tolist() == want
    assert 0 < sum(len(p) > 75 for p, _ in made) < len(made)


def test_pairs_at_once_take_little_time(monkeypatch):
    """A pair among many takes an eighth of the time that it takes alone, or less; parts of any size give the same."""
    rng = np.random.default_rng(17)
    pictures = [media.draw(rng.normal(size=64)) for _ in range(50)]
    pictures += [np.rot90(a, k % 4) for k, a in enumerate(pictures[:30])] + [_noisy(a, k) for k, a in enumerate(pictures[:20])]
    made = [media.describe(a[None].astype(np.float32))[0] for a in pictures]
    raw = {"corners": np.array([len(p) for p, _ in made]).tobytes(), "spots": b"".join(media._spots(p) for p, _ in made), "words": b"".join(w.tobytes() for _, w in made)}
    block = media._Images(raw | {"ids": np.arange(len(made)).tobytes(), "keys": b"", "owner": b"", "few": b""})
    i, j = np.triu_indices(len(made), 1)
    start = time.process_time()
    want = [k for k in range(len(i)) if media._linked(block.image(i[k]), block.image(j[k]), 24)]
    alone = time.process_time() - start
    took = []
    for _ in range(3):
        start = time.process_time()
        assert media._linked_pairs(block, block, i, j, 24).tolist() == want
        took.append(time.process_time() - start)
    assert len(want) >= 50 and 8 * min(took) < alone
    for name, n in (("PAIRS", 7), ("XORED", 1), ("MATCHES", 40)):
        monkeypatch.setattr(media, name, n)
    assert media._linked_pairs(block, block, i, j, 24).tolist() == want


def test_image_copies_of_a_large_picture(spark):
    """A crop of its faint part, and a copy reduced to a third."""
    rng = np.random.default_rng(8)
    rough = lambda k: media._box(rng.integers(0, 2, (1, k, k)) * 255.0, 3)[0]
    big = np.clip((rough(288) - 127) * 4 + 127, 0, 255)
    big[144:, 144:] = 90 + big[144:, 144:] * 0.2
    third = big.reshape(96, 3, 96, 3).mean((1, 3))
    rows = [(1, big), (2, big[160:260, 160:260]), (3, third), (4, np.clip((rough(96) - 127) * 4 + 127, 0, 255))]
    got = {r["media_id"]: r for r in media.copies(spark.createDataFrame([(i, media.write_pgm(a)) for i, a in rows], "media_id long, content binary")).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 1, 4]
    assert got[1]["n_corners"] > got[3]["n_corners"] > 0


def test_all_near_descriptors():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 63, (300, 2)).astype(np.uint64)
    two, bits = one.copy(), rng.integers(0, 40, len(one))
    for i, n in enumerate(bits):
        for k in rng.choice(128, n, replace=False):
            two[i, k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    i, j = media._near(one, np.arange(300), two, np.arange(300), 24)
    assert sorted(i[i == j]) == [k for k in range(300) if bits[k] <= 24] and (i == j).all()


def test_pictures(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(30)
    out = media.pictures(df).collect()
    assert all(media.read_pgm(r["content"]) is not None for r in out)
    assert df.filter(F.col("vec_id") % 10 == 0).count() * 2 + 30 == len(out)
