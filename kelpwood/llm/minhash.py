"""MinHash near-duplicates with tensored banding.

Two small collections A and B of ``t`` sub-bands of ``r`` minhashes each are computed per document. A
table key is a pair (i, j) with sub-band i of A and sub-band j of B, so 2*t*r minhashes give t*t tables
of 2*r rows: about the square root of the hashing that independent tables would need. ``t`` follows from
the threshold s: the least one with 2 * (1 - s**r)**t <= miss.

1. Texts with the same shingle set become one node (128-bit set fingerprint).
2. Sub-bands that no other node shares are dropped before pairs of sub-bands are formed; most nodes end here.
3. In each table key the member whose sub-bands are the most common is the centre. All others are compared with it on full sets, which
   gives links and each member's edits (shingles that it lacks or adds). Components follow.
4. Two members of a centre that were not both linked with it can only be linked with each other if they share
   edits, and at least so many as their sizes say (see ``_edit_candidates``). Edits that two components share are indexed, rarest
   first, under the prefix filter, and what collides is confirmed on full sets. So every link between components is found without
   forming the pairs of a group: a large group of copies costs a star.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, gram_hashes, materialize, mix, signed, slices
from .components import connected_components
from .sketch import maybe_in


SALTS = 16


def sub_bands(similarity: float, r: int = 2, miss: float = 1e-4) -> int:
    """How many sub-bands each collection needs."""
    t = 1
    while 2 * (1 - similarity**r) ** t > miss:
        t += 1
    return t


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the bounds of each text."""
    w = Words(texts, lower=True)
    h = w.hashes()
    grams = gram_hashes(h, k)
    short = {n: gram_hashes(h, n) for n in range(1, k)} if (w.lengths < k).any() else {}
    sets, bounds = [], np.zeros(w.n + 1, np.int64)
    for d in range(w.n):
        start, n = w.offsets[d], w.lengths[d]
        if n >= k:
            sets.append(np.unique(grams[start : start + n - k + 1]))
        elif n:
            sets.append(short[n][start : start + 1])
        bounds[d + 1] = bounds[d] + (len(sets[-1]) if n else 0)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed << 20)
    c = mix(base * np.uint64(0x9E3779B97F4A7C15))
    return c[:n] | np.uint64(1), c[n:]


def signatures(texts: pa.Array, k: int, t: int, r: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, two fingerprints and 2*t sub-bands of each text."""
    x, bounds = shingle_sets(texts, k)
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    n = len(size)
    fp1, fp2, bands = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, 2 * t), np.uint64)
    if len(full):
        at = bounds[:-1][full]
        fp1[full] = np.add.reduceat(mix(x), at)
        fp2[full] = np.add.reduceat(mix(x ^ np.uint64(0x5851F42D4C957F2D)), at)
        mul, add = _constants(2 * t * r, seed)
        for b in range(2 * t):
            acc = np.full(len(full), np.uint64(b + 1), np.uint64)
            for j in range(b * r, (b + 1) * r):
                acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat((x * mul[j] + add[j]) >> np.uint64(20), at))
            bands[full, b] = acc
    return size, fp1, fp2, bands


def _signature_rows(k: int, t: int, r: int, seed: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                size, fp1, fp2, bands = signatures(part.column("text"), k, t, r, seed)
                flat = pa.array(signed(bands.reshape(-1)))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(size) + 1) * 2 * t, 2 * t, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(signed(fp1)), pa.array(signed(fp2)), rows], ["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return run


def _set_rows(k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x, bounds = shingle_sets(part.column("text"), k)
                raw = [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary())], ["node", "shingles"])

    return run


def _compare(p: np.ndarray, q: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Size of the intersection of two sorted sets, what only the first has, what only the second has."""
    m = np.concatenate([p, q])
    order = np.argsort(m, kind="stable")
    m = m[order]
    same = m[1:] == m[:-1]
    alone = ~(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    mine = order < len(p)
    return int(same.sum()), m[alone & mine], m[alone & ~mine]


def _confirm(percent: int):
    """Keep pairs with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            one, two = batch.column("set_a"), batch.column("set_b")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = np.frombuffer(one[i].as_buffer(), np.uint64), np.frombuffer(two[i].as_buffer(), np.uint64)
                both = _compare(p, q)[0]
                keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(c), pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def _edit_rows(percent: int):
    """Members b against their centres a: linked, S (see _edit_candidates), the centre's size and the edits' hashes."""

    def run(batches):
        for batch in batches:
            linked, weight, size, edits = [], [], [], []
            for one, two in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                c, x = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both, lacks, adds = _compare(c, x)
                linked.append(100 * both >= percent * (len(c) + len(x) - both))
                weight.append((100 + percent) * len(lacks) + percent * len(x))
                size.append(len(c))
                edits.append(signed(np.concatenate([mix(lacks), adds])))
            lists = pa.array(edits, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(weight, pa.int64()), pa.array(size, pa.int64()), lists], ["c", "x", "linked", "weight", "size", "edits"])

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    return with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").select("a", "b", "set_a", "set_b")


def _edit_candidates(stars: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one centre, of different components, that may be linked.

    Let c be the centre, D(x) and A(x) what x lacks and adds, P the percentage and S(x) = (100 + P) |D(x)| + P |x|. For members x and y the
    intersection is |c| - |D(x)| - |D(y)| + e with e the number of edits that both have, so they are linked just if
    (100 + P) e >= S(x) + S(y) - (100 + P) |c|. S is least for the centre: P |c|. So x is linked with the centre just if S(x) <= 100 |c|, and two
    members are linked without shared edits only if both are linked with the centre. For any other link one is not, and e is at least
    ceil((S(x) - 100 |c|) / (100 + P)) for a member that is not linked with the centre and ceil((S(x) - P |c| + 1) / (100 + P)) for one that is.
    These bounds give the prefixes of the edits, rarest first, of which two linked members must share one. As e is at most the number of
    edits that either shares with anyone, S(y) is bounded as well, for a pair and for all members that have an edit.
    """
    own = stars.join(comp.withColumnRenamed("node", "x"), "x", "left").withColumn("comp", F.coalesce("comp", "x"))
    wide = own.groupBy("c").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(~F.col("linked")).alias("far")).filter("lo <> hi and far").select("c")
    least = F.when(F.col("linked"), F.col("weight") - percent * F.col("size") + 1).otherwise(F.col("weight") - 100 * F.col("size"))
    # a large group's rows are dealt by member as well, so that its centre isn't one task
    salted = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = own.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(salted, ["c", "salt"]).drop("salt")
    own = own.withColumn("need", F.greatest(F.ceil(least / F.lit(100 + percent)), F.lit(1)).cast("int"))
    each = own.select("c", "x", "comp", F.explode("edits").alias("e"))
    shared = each.groupBy("c", "e").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("c", "e", "df")
    kept = each.select("c", "x", "e").join(shared, ["c", "e"]).groupBy("c", "x").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    kept = kept.join(own.drop("edits"), ["c", "x"]).filter(F.size("es") >= F.col("need"))
    # the greatest S of a partner with which the edits that this member shares with anyone could be enough
    kept = kept.withColumn("most", F.lit(100 + percent) * (F.col("size") + F.size("es")) - F.col("weight"))
    pre = materialize(kept.select("c", "x", "linked", "comp", "weight", "most", F.explode(F.slice("es", F.lit(1), F.size("es") - F.col("need") + 1)).alias("p")).select("c", "x", "linked", "comp", "weight", "most", F.col("p.e").alias("e")), "mh")
    reach = pre.groupBy("c", "e").agg(F.max("most").alias("top"), F.min(F.when(~F.col("linked"), F.col("weight"))).alias("low"))
    pre = materialize(pre.join(reach, ["c", "e"]).filter((~F.col("linked") & (F.col("weight") <= F.col("top"))) | (F.col("most") >= F.col("low"))).drop("top", "low"), "mh")
    far = pre.filter("not linked").select("c", "e", F.col("x").alias("y"), F.col("comp").alias("yc"), F.col("weight").alias("yw"), F.col("most").alias("ym"))
    enough = (F.col("weight") <= F.col("ym")) & (F.col("yw") <= F.col("most"))
    return far.join(pre, ["c", "e"]).filter((F.col("x") != F.col("y")) & (F.col("comp") != F.col("yc")) & enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, r: int = 2, miss: float = 1e-4, seed: int = 7) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> one row per input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and split at ASCII white space; a set has the distinct ``k``-word shingles, or the
    whole sequence when there are fewer words. Documents whose sets have ``100 * both >= percent * either`` are linked.

    Defined cases: null or empty text: no shingles, linked with nothing, own component, kept. Repeated rows are each
    returned; rows that share a doc_id are one document. Null doc_id: component null, kept. Very long texts are read whole. Of equally common centres the
    least id counts. Empty table: empty result.
    Only doc_id and text are read, so other columns may have any name.
    """
    t = sub_bands(percent / 100, r, miss)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = materialize(base.mapInArrow(_signature_rows(k, t, r, seed), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"), "mh")
    known = sig.filter("n_shingles > 0 and doc_id is not null")
    groups = known.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    nodes = materialize(groups.select("node", "bands"), "mh")

    # sub-bands that at least two nodes share; how common a node's are
    sub = nodes.select("node", F.posexplode("bands").alias("i", "v"))
    common = sub.groupBy("i", "v").agg(F.count("*").alias("c")).filter("c > 1")
    per_node = sub.join(common, ["i", "v"]).groupBy("node").agg(F.sum("c").alias("often"), F.collect_list(F.struct("i", "v")).alias("s"))
    side = lambda low: F.filter("s", lambda x: (x.i < t) if low else (x.i >= t))
    keyed = per_node.select("node", "often", F.explode(side(True)).alias("x"), side(False).alias("ys")).select("node", "often", "x", F.explode("ys").alias("y"))
    keyed = keyed.select(F.xxhash64("x.i", "x.v", "y.i", "y.v").alias("key"), "node", "often")
    many = keyed.groupBy("key").agg(F.count("*").alias("c"), F.max(F.struct("often", (-F.col("node")).alias("minus"))).alias("m")).filter("c > 1")
    star = keyed.join(many.select("key", (-F.col("m.minus")).alias("centre")), "key").filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    star = materialize(star, "mh")

    need = star.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    near, mark = maybe_in(base, "doc_id", need)
    sets = materialize(near.filter(mark).drop(mark).join(need, "doc_id").select("doc_id", "text").dropDuplicates(["doc_id", "text"]).mapInArrow(_set_rows(k), "node long, shingles binary"), "mh")
    compared = _with_sets(star, sets).mapInArrow(_edit_rows(percent), "c long, x long, linked boolean, weight long, size long, edits array<long>")
    stars = materialize(compared, "mh")
    first = stars.filter("linked").select(F.col("c").alias("a"), F.col("x").alias("b"))
    comp = connected_components(first)
    rest = _edit_candidates(stars, comp, percent)
    second = materialize(_with_sets(rest, sets).mapInArrow(_confirm(percent), "a long, b long").distinct(), "mh")
    comp = comp if second.isEmpty() else connected_components(first.unionByName(second))
    by_set = groups.select("fp1", "fp2", "node").join(comp, "node", "left").select("fp1", "fp2", F.coalesce("comp", "node").alias("component"))
    out = sig.join(by_set, ["fp1", "fp2"], "left")
    same = out.groupBy("doc_id").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
    if not same.isEmpty():  # one doc_id with several texts links them
        pairs = out.join(same, "doc_id").select(F.col("component").alias("a"), F.col("least").alias("b")).distinct()
        again = connected_components(pairs).select(F.col("node").alias("component"), F.col("comp").alias("merged"))
        out = out.join(again, "component", "left").withColumn("component", F.coalesce("merged", "component"))
    out = out.withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
