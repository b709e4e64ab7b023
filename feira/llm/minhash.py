"""Near-duplicate detection by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so half the hash evaluations are needed for a signature; both
agree between two documents with the probability of their Jaccard similarity.
Signatures are cut into bands; documents that share a band are candidates.

1. Sketch. One pass over the texts: distinct shingles, their number, a digest of
   the set (equal sets form a class; one document stands for it) and a signature.
2. Candidates. Bands of the classes' representatives are folded to buckets. The
   members of a bucket are joined in a tree by estimated similarity; a bucket
   above `bucket_rows` is not gathered, its members are all joined to its smallest
   id. Joining too much is harmless here: a tree only says who is compared.
3. Confirmation. Connected candidates form clusters. A cluster's shingle sets are
   brought together once; a cluster of more than `block_shingles` or
   `block_docs` documents is cut into blocks, and every pair of blocks is a group of its own, so no group grows with
   the data and no pair is lost. Inside a group, pairs whose signatures agree
   enough and that are not linked yet are compared on their full sets, and a link
   is emitted only if it joins two parts: at most one a document, never all pairs.
4. Components of the confirmed links, and classes mapped back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, with_columns


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection) over an array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of so many words (of
    all its words, if fewer). A-Z are lowered; words are runs of bytes other than
    ASCII white space."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    n = len(w) - k + 1
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = _mix(s + h[i:i + n] + np.uint64(i + 1))
    return np.unique(s)


class Permutations:
    """permutations x 2 signature values of 32 bits for each set."""

    def __init__(self, permutations: int, seed: int):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """Row i: minima, then maxima, of set i (no set may be empty)."""
        x, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        k = len(self.odd)
        out = np.empty((len(sets), 2 * k), np.uint32)
        for j in range(k):
            y = x * self.odd[j] + self.add[j]
            y ^= y >> np.uint64(32)
            y *= self.odd[-1 - j]
            y >>= np.uint64(32)
            y = y.astype(np.uint32)
            out[:, j] = np.minimum.reduceat(y, at)
            out[:, k + j] = np.maximum.reduceat(y, at)
        return out


def _parts(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    a, total = 0, 0
    for i, t in enumerate(texts):
        if total > most:
            yield a, i
            a, total = i, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


def sketch(docs: DataFrame, words: int, permutations: int, rows: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, class (digest of the set; null if empty), sig, bands."""
    perms = Permutations(permutations, seed)
    n_bands = 2 * permutations // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in _parts(texts, 1 << 22):
                sets = [shingles(t, words) for t in texts[a:b]]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list[bytes | None] = [None] * len(sets)
                bands: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    m = perms.signatures([sets[i] for i in full])
                    # minima and maxima take turns, so each band has both
                    cols = np.arange(2 * permutations).reshape(2, permutations).T.ravel()
                    cut = m[:, cols][:, :n_bands * rows].reshape(len(full), n_bands, rows).astype(np.uint64)
                    key = np.zeros((len(full), n_bands), np.uint64) + np.arange(n_bands, dtype=np.uint64)
                    for j in range(rows):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, j])
                    key = key.view(np.int64)
                    for i, row, keys in zip(full, m, key):
                        sig[i], bands[i] = row.tobytes(), keys
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "class", "sig", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, class binary, sig binary, bands array<long>")


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return int(i)

    def roots(self) -> np.ndarray:
        """The root of every position."""
        up = self.up
        while True:
            over = up[up]
            if np.array_equal(over, up):
                return up
            up[:] = over

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _trees(alike: float):
    """Members of buckets -> tree edges among those whose signatures agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for ids, sigs in zip(batch.column("ids"), batch.column("sigs")):
                ids = np.asarray(ids.values)
                m = np.frombuffer(b"".join(sigs.as_py()), np.uint32).reshape(len(ids), -1)
                if len(ids) == 2:
                    if (m[0] == m[1]).mean() >= alike:
                        a.append(int(ids[0]))
                        b.append(int(ids[1]))
                    continue
                sets = _Sets(len(ids))
                for i in range(len(ids) - 1):
                    near = np.flatnonzero((m[i + 1:] == m[i]).mean(1) >= alike) + i + 1
                    if len(near):
                        for j in near[sets.roots()[near] != sets.root(i)]:
                            if sets.join(i, int(j)):
                                a.append(int(ids[i]))
                                b.append(int(ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _candidates(reps: DataFrame, alike: float, bucket_rows: int) -> DataFrame:
    """Edges (a, b) that connect at least all similar representatives."""
    keyed = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("k"), F.min("doc_id").alias("first")).filter("k > 1")
    keyed = materialize(keyed.join(sizes, ["band", "key"]), "buckets")
    small = (keyed.filter(F.col("k") <= bucket_rows).groupBy("band", "key")
             .agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).select("ids").distinct())
    small = small.withColumn("bucket", F.xxhash64("ids")).select("bucket", F.explode("ids").alias("doc_id"))
    small = (small.join(reps.select("doc_id", "sig"), "doc_id").groupBy("bucket")
             .agg(F.collect_list("doc_id").alias("ids"), F.collect_list("sig").alias("sigs")).select("ids", "sigs"))
    trees = small.mapInArrow(_trees(alike), "a long, b long")
    stars = keyed.filter(F.col("k") > bucket_rows).filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    return trees.unionByName(stars)


def _confirm(alike: float, share: int):
    """Rows sorted by group -> links of full similarity that join two parts."""

    def links(ids: list[int], side: list[int], sigs: list[bytes], sets: list[bytes]) -> list[tuple[int, int]]:
        n, out = len(ids), []
        m = np.frombuffer(b"".join(sigs), np.uint32).reshape(n, -1)
        size = np.array([len(s) // 8 for s in sets])
        own: list[set | None] = [None] * n
        s = np.array(side)
        cross = bool(s.any())
        uf = _Sets(n)

        def as_set(i: int) -> set:
            if own[i] is None:
                own[i] = set(np.frombuffer(sets[i], np.uint64).tolist())
            return own[i]

        for i in range(n - 1):
            rest = slice(i + 1, n)
            ok = 100 * np.minimum(size[rest], size[i]) >= share * np.maximum(size[rest], size[i])
            if cross:
                ok &= s[rest] != s[i]
            near = np.flatnonzero(ok) + i + 1
            if not len(near):
                continue
            est = (m[near] == m[i]).mean(1)
            near = near[est >= alike]
            near = near[np.argsort(-est[est >= alike], kind="stable")]
            if not len(near):
                continue
            for j in near[uf.roots()[near] != uf.root(i)].tolist():
                if uf.root(i) == uf.root(j):
                    continue
                both = len(as_set(i) & as_set(j))
                if 100 * both >= share * (int(size[i]) + int(size[j]) - both):
                    uf.join(i, j)
                    out.append((ids[i], ids[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []

        def done() -> pa.RecordBatch:
            found = links(*map(list, zip(*rows))) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("cluster", "p", "q", "doc_id", "side", "sig", "set")]
            for c, p, q, *row in zip(*cols):
                if (c, p, q) != last:
                    if len(rows) > 1:
                        yield done()
                    last, rows = (c, p, q), []
                rows.append(row)
        if len(rows) > 1:
            yield done()

    return run


#: Ids (8 bytes each) of candidates that are broadcast; more are joined by a shuffle.
FEW_IDS = 2_000_000


def near_dedup(docs: DataFrame, words: int = 5, similar: int = 80, permutations: int = 32, rows: int = 3,
               bucket_rows: int = 2048, block_shingles: int = 2_000_000, block_docs: int = 2048, slack: float = 0.25, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with 100 * |A and B| >= similar * |A or B| over their shingle sets
    are linked; component_id is the smallest doc_id reachable. Null and empty
    texts (and those of white space) have no shingles, link with nothing and are
    kept. Copies share a set, hence a component, without being compared. Rows
    that repeat a doc_id each get a row; texts that share an id count as linked.
    A row of null id takes part in no link. Extra columns are ignored; an empty table gives no rows.

    The only chance of a miss is in candidates. At a threshold of 0.8 a pair shares
    none of the 21 bands of 3 with probability 3e-7, and its 64 signature values
    agree to less than 0.8 - slack with probability 4e-6. At 0.85 with rows=4 and
    slack=0.22, which costs less, both are below 1e-5.
    """
    alike = similar / 100 - slack
    d = with_columns(docs, {"doc_id": "long", "text": "string"})
    all_docs = materialize(sketch(d, words, permutations, rows, seed), "sketch")
    keyed = all_docs.filter("class is not null and doc_id is not null")
    reps = keyed.groupBy("class").agg(F.min("doc_id").alias("rep"))
    # a doc_id that stands for several texts links their classes
    linked = keyed.select("doc_id", "class").distinct()
    again = linked.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("class").alias("class")).filter("k > 1")
    again = (linked.join(again.select("doc_id"), "doc_id").join(reps, "class")
             .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    mine = reps.select("class", F.col("rep").alias("doc_id"))
    chosen = (keyed.join(mine, ["class", "doc_id"]).groupBy("doc_id", "class")
              .agg(*[F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")]))
    chosen = materialize(chosen, "classes")
    cluster = materialize(connected_components(_candidates(chosen, alike, bucket_rows)), "clusters")
    members = chosen.join(cluster.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "class", F.col("component").alias("cluster"), "n_shingles", "sig")
    weight = members.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n_shingles") / block_shingles, F.count("*") / block_docs)).cast("int").alias("blocks"))
    members = members.join(weight, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    members = materialize(members.drop("n_shingles"), "members")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["doc_id", "cluster", "blocks", "block", "sig"]
        for batch in batches:
            out = [shingles(t or b"", words).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            own = pa.array([hashlib.blake2b(s, digest_size=16).digest() == c for s, c in zip(out, batch.column("class").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], [*kept, "set"]).filter(own)

    # few candidates are found among the texts by their ids alone, before any text moves
    ids = members.select("doc_id").distinct()
    texts = d.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= FEW_IDS else d
    full = texts.join(members, "doc_id").mapInArrow(sets_of, "doc_id long, cluster long, blocks int, block int, sig binary, set binary")
    # a pair of blocks (p <= q) for each other block, and the block with itself
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select("cluster", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "doc_id",
                       F.when((F.col("block") == F.col("other")), 0).otherwise((F.col("block") > F.col("other")).cast("int") + 1).alias("side"), "sig", "set")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = full.repartition(parts, "cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "doc_id")
    links = full.mapInArrow(_confirm(alike, similar), "a long, b long")
    found = materialize(connected_components(links.unionByName(again)), "components")
    by_class = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    return (all_docs.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
            .join(by_class, "class", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept")))
