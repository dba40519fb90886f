"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. Each text becomes its sequence of words (runs other than [\\x20\\x09-\\x0D]); equal sequences form
   a class, so copies cost one row in all that follows.
2. A class's n-gram set gets BANDS * ROWS minima; each band of ROWS minima is one hash. At the
   threshold 0.8 a pair shares a band with probability 1 - (1 - 0.8**7)**32 = 0.9995.
3. Band hashes shuffle; in each bucket every class links to the bucket's smallest class only. The
   connected components of these links hold every pair of classes that share a bucket.
4. The texts of classes that share buckets meet once or a few times. A component of TILE classes at
   most is one group. A larger one is either cut into tiles, each pair of which is a group, or, where
   that moves fewer rows, taken apart into its buckets, buckets of the same classes counting once;
   only buckets of more than TILE classes are tiled then, so a long chain of candidates costs as
   many rows as it has places in buckets. A pair that meets in several buckets counts in the first.
   Groups are dealt to tasks by number. In a group pairs are verified on full n-gram sets by products
   of incidence matrices; what leaves it is a row per class: its number of links, and the smallest
   class it reaches.
5. Components over the verified links give the near-duplicate classes.

A class is known by the hash of its words throughout, never by a doc_id. Texts shorter than n words
have one n-gram, the whole. Defined cases: a null text, or one without words, has no n-grams, links
with nothing and is a class of its own row; a class's id is its smallest doc_id, nulls last (null if
it has none); rows repeated in id and text are separate documents of one class, and an id that
repeats with different texts is judged text by text; an empty table gives no rows; extra columns of
the input are ignored by ``join`` and kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import connected_components
from ._spark import Scratch, join_groups, key_filter, small_batches, tidy, with_membership

N, BANDS, ROWS = 5, 32, 7
#: The threshold as a fraction, so that it is compared in whole numbers.
SIMILAR = (4, 5)
#: Classes of a tile; n-grams hashed at once; columns of an incidence block; words a worker keeps.
TILE, SLAB, BLOCK, CACHE_WORDS = 256, 512, 4096, 200_000

words_of = re.compile(r"[^\x20\x09-\x0D]+").findall

_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MIX = (_rng.integers(0, 2**63, N, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ROW_MIX = (_rng.integers(0, 2**63, ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_hashes: dict[str, int] = {}


def _finish(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


def ngrams(words: list[str]) -> np.ndarray:
    """The set of n-grams as sorted distinct 64-bit hashes."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < N:
        return np.array([xxhash.xxh3_64_intdigest("\0".join(words))], np.uint64)
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    hashes = []
    for w in words:
        h = _hashes.get(w)
        if h is None:
            h = _hashes[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    h = _finish(np.array(hashes, np.uint64))
    m = len(h) - N + 1
    z = h[:m] * _MIX[0]
    for k in range(1, N):
        z = (z ^ (z >> np.uint64(32))) + h[k : k + m] * _MIX[k]
    return np.unique(_finish(z))


def bands(grams: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band of MinHash rows."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), SLAB):
        h = x[k : k + SLAB, None] * _A
        h += _B
        np.minimum(least, h.min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    z = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        z = (z ^ (z >> np.uint64(32))) * _ROW_MIX[k] + rows[:, k]
        z = _finish(z)
    return z.view(np.int64)


def _class_of(words: list[str]) -> str:
    return hashlib.md5(" ".join(words).encode()).hexdigest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            classes, sets = [], []
            for text in part.column(1).to_pylist():
                words = words_of(text or "")
                classes.append(_class_of(words) if words else None)
                sets.append(bands(ngrams(words)) if words else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(classes, pa.string()), pa.array(sets, pa.list_(pa.int64()))], names=["_id", "_class", "_bands"])
    tidy(_hashes)


def links_within(sets: list[np.ndarray], left: list[int], right: list[int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) of sets at least SIMILAR; with ``same`` left is right and i < j."""
    every = left if same else left + right
    if len(every) < 2:
        return np.empty(0, int), np.empty(0, int)
    flat = np.concatenate([sets[k] for k in every])
    owner = np.repeat(np.arange(len(every)), [len(sets[k]) for k in every])
    _, gram = np.unique(flat, return_inverse=True)
    often = np.bincount(gram)
    live = often[gram] > 1  # n-grams of one text only add to no overlap
    gram, owner = gram[live], owner[live]
    _, gram = np.unique(gram, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    a = len(left)
    common = np.zeros((a, a if same else len(right)), np.float32)
    for k in range(0, int(gram[-1]) + 1 if len(gram) else 0, BLOCK):
        lo, hi = np.searchsorted(gram, [k, k + BLOCK])
        block = np.zeros((len(every), BLOCK), np.float32)
        block[owner[lo:hi], gram[lo:hi] - k] = 1
        common += block[:a] @ (block if same else block[a:]).T
    sizes = np.array([len(sets[k]) for k in every], np.int64)
    inter = common.astype(np.int64)
    union = sizes[:a, None] + (sizes if same else sizes[a:])[None, :] - inter
    hit = (SIMILAR[1] * inter >= SIMILAR[0] * union) & (inter > 0)
    i, j = np.nonzero(np.triu(hit, 1) if same else hit)
    return np.array(left, int)[i], np.array(left if same else right, int)[j]


def class_hash(text: Column) -> Column:
    """What ``_class_of`` gives for the words of a text; null without words."""
    words = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(words != "", F.md5(words))


def _first_meeting(places: list[list[dict] | None], a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Of pairs (a, b) in the bucket of this band, those that share no bucket of an earlier band."""
    table = np.zeros((len(places), BANDS), np.int64)
    for k, own in enumerate(places):
        for p in own or ():
            table[k, p["at"]] = p["band"]
    first = np.empty(len(a), bool)
    for k in range(0, len(a), 65536):
        x, y = table[a[k : k + 65536]], table[b[k : k + 65536]]
        first[k : k + 65536] = ((x == y) & (x != 0)).argmax(axis=1) == bucket
    return first


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (_group, _i, _j): _tile, _class, _members, _at, _places, _text; a row per class of each group out."""
    key, rows, out = None, {}, []

    def close() -> None:
        classes = list(rows)
        i, j, bucket = key[1:]
        left = [k for k, c in enumerate(classes) if rows[c][0] == i]
        right = left if i == j else [k for k, c in enumerate(classes) if rows[c][0] == j]
        a, b = links_within([rows[c][3] for c in classes], left, right, i == j)
        root = list(range(len(classes)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q, key=classes.__getitem__)] = min(p, q, key=classes.__getitem__)
        near = [classes[find(k)] for k in range(len(classes))]
        met = np.bincount(a, minlength=len(classes)) + np.bincount(b, minlength=len(classes))
        if bucket >= 0:
            first = _first_meeting([rows[c][2] for c in classes], a, b, bucket)
            a, b = a[first], b[first]
        members = np.array([rows[c][1] for c in classes], np.int64)
        linked = np.bincount(a, members[b], len(classes)) + np.bincount(b, members[a], len(classes))
        out.extend((c, near[k], int(linked[k])) for k, c in enumerate(classes) if met[k])

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), ()]
        out.clear()
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["_class", "_near", "_links"])

    for batch in batches:
        column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            at = tuple(column[c][r].as_py() for c in ("_group", "_i", "_j", "_at"))
            if at != key:
                if rows:
                    close()
                key, rows = at, {}
                if len(out) > 5000:
                    yield flush()
            grams = ngrams(words_of(column["_text"][r].as_py()))
            rows[column["_class"][r].as_py()] = (*(column[c][r].as_py() for c in ("_tile", "_members", "_places")), grams)
    if rows:
        close()
    yield flush()
    tidy(_hashes)


PLACES = "array<struct<at:int,band:bigint>>"


def _tiled(n: Column) -> Column:
    return F.ceil(n / TILE).cast("int")


def _groups(classes: DataFrame, buckets: DataFrame, maybe: DataFrame, n_classes: int, scratch: Scratch) -> DataFrame:
    """Where each candidate class goes: _class, _group, _at (the bucket's band, -1 for a component), _tiles, _tile, _places."""
    sizes = maybe.groupBy("root").agg(F.count("*").alias("_n"))
    maybe = scratch.save(join_groups(maybe, sizes, "root", "_n", n_classes), "candidates")
    tile = lambda n: F.pmod(F.xxhash64("_class", "_group"), _tiled(n)).cast("int").alias("_tile")
    whole = maybe.select(F.col("node").alias("_class"), F.xxhash64("root").alias("_group"), F.lit(-1).alias("_at"), _tiled(F.col("_n")).alias("_tiles"), "_n", "root")
    large = whole.filter(F.col("_n") > TILE)
    if not large.limit(1).count():
        return whole.select("_class", "_group", "_at", "_tiles", tile(F.col("_n")), F.lit(None).cast(PLACES).alias("_places"))
    placed = classes.select("_class", F.posexplode("_bands").alias("at", "band")).join(buckets.select(F.col("_band").alias("band")), "band")
    placed = scratch.save(placed.join(large.select("_class", "root", "_n"), "_class"), "places")
    # Buckets of the same classes count once; the two sums of hashes name the set of classes.
    same = [F.bit_xor(F.xxhash64("_class", F.lit(k))) for k in (1, 2)]
    used = placed.groupBy("root", "_n", "at", "band").agg(F.count("*").alias("_b"), same[0].alias("_s"), same[1].alias("_t"))
    used = used.groupBy("root", "_n", "_b", "_s", "_t").agg(F.min(F.struct("at", "band")).alias("_place"))
    used = scratch.save(used.select("root", "_n", "_b", "_place.at", "_place.band"), "buckets")
    moved = used.groupBy("root", "_n").agg(F.sum(F.col("_b") * F.ceil(F.col("_b") / TILE)).alias("_moved"))
    apart = scratch.save(moved.filter(F.col("_moved") < F.col("_n") * F.ceil(F.col("_n") / TILE)).select("root", F.lit(True).alias("_apart")), "apart")
    kept = used.join(apart, "root").select("band", "_b")
    placed = scratch.save(placed.select("_class", "at", "band").join(kept, "band"), "kept")
    places = placed.groupBy("_class").agg(F.collect_list(F.struct("at", "band")).alias("_places"))
    parted = placed.join(places, "_class").withColumn("_group", F.col("band"))
    parted = parted.select("_class", "_group", F.col("at").alias("_at"), _tiled(F.col("_b")).alias("_tiles"), tile(F.col("_b")), "_places")
    whole = whole.join(apart, "root", "left").filter("_apart is null")
    return whole.select("_class", "_group", "_at", "_tiles", tile(F.col("_n")), F.lit(None).cast(PLACES).alias("_places")).unionByName(parted)


def _texts_of(texts: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """_class, _text: a text of each class. Only rows with a class's own smallest id move, combined before they do."""
    # First by id alone, so that few texts are hashed; then by id and class.
    named = scratch.save(classes.select("_class", F.col("_rep").alias("_id")), "named")
    n, by_id, own = named.count(), F.xxhash64("_id"), F.xxhash64("_class", "_id")
    first, bits = key_filter(named, by_id, n)
    rows = with_membership(texts, by_id, scratch.save(first, "filter"), bits, "_maybe").filter("_maybe").drop("_maybe")
    keyed = rows.withColumn("_class", class_hash(F.col("_text"))).filter("_class is not null")
    second, bits = key_filter(named, own, n)
    rows = with_membership(keyed, own, scratch.save(second, "filter"), bits, "_maybe").filter("_maybe")
    return rows.groupBy("_class").agg(F.first("_text").alias("_text"))


def _decide(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Signed rows (_id, _class), and per class: _rep, _members, _links, class_id, _best (is the class that stays), _n classes."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fields = [T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_class", T.StringType()), T.StructField("_bands", T.ArrayType(T.LongType()))]
    signed = scratch.save(texts.mapInArrow(_sign, T.StructType(fields)), "signed")
    classes = signed.filter("_class is not null").groupBy("_class")
    classes = scratch.save(classes.agg(F.min("_id").alias("_rep"), F.count("*").alias("_members"), F.first("_bands").alias("_bands")), "classes")
    n_classes = classes.count()
    placed = classes.select("_class", F.explode("_bands").alias("_band"))
    buckets = placed.groupBy("_band").agg(F.min("_class").alias("v"), F.count("*").alias("_n")).filter("_n > 1")
    buckets = scratch.save(buckets.drop("_n"), "buckets")
    edges = placed.join(buckets, "_band").select(F.col("_class").alias("u"), "v")
    groups = scratch.save(_groups(classes, buckets, connected_components(edges, scratch), n_classes, scratch), "groups")
    wanted = scratch.save(classes.join(groups.select("_class").distinct(), "_class", "left_semi").select("_class", "_rep", "_members"), "wanted")
    met = _texts_of(texts, wanted, scratch).join(wanted.select("_class", "_members"), "_class").join(groups, "_class")
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    met = met.withColumn("_i", F.least("_tile", "_other")).withColumn("_j", F.greatest("_tile", "_other"))
    # The groups of a component lie side by side, so a large one is spread evenly.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.col("_j").cast("bigint") * (F.col("_j") + 1) / 2 + F.col("_i")
    task = F.pmod(F.pmod(F.col("_group"), F.lit(parts)) + number.cast("bigint"), F.lit(parts)).cast("int")
    met = met.select("_group", "_i", "_j", "_at", "_tile", "_class", "_members", "_places", "_text", task.alias("_task"))
    dealt = met.repartitionById(parts, "_task").drop("_task").sortWithinPartitions("_group", "_i", "_j")
    found = scratch.save(dealt.mapInArrow(_verify, "_class string, _near string, _links bigint"), "verified")
    links = found.groupBy("_class").agg(F.sum("_links").alias("_links"))
    near = connected_components(found.select(F.col("_class").alias("u"), F.col("_near").alias("v")), scratch)
    near = near.select(F.col("node").alias("_class"), F.col("root").alias("_root"))
    own = classes.select("_class", "_rep", "_members").join(links, "_class", "left").join(near, "_class", "left")
    own = scratch.save(own.withColumn("_root", F.coalesce("_root", "_class")), "nearest")
    first = F.min(F.struct(F.col("_rep").isNull().alias("none"), F.col("_rep").alias("id"), F.col("_class").alias("key")))
    least = own.groupBy("_root").agg(first.alias("_least"), F.count("*").alias("_n"))
    own = join_groups(own, least, "_root", "_n", n_classes).withColumn("class_id", F.col("_least.id"))
    own = own.withColumn("_best", F.col("_class") == F.col("_least.key")).drop("_least", "_root")
    return signed.select("_id", "_class"), scratch.save(own, "decided")


def join(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, n_links, exact_id, exact_size.

    class_id: smallest id reachable over links of similarity >= 0.8; exact_id and exact_size: the
    same for equal word sequences; n_links: other documents linked directly, copies included.
    """
    signed, own = _decide(docs, scratch, id_col, text_col)
    met = join_groups(signed.filter("_class is not null"), own, "_class", "_members", signed.count())
    links = F.coalesce("_links", F.lit(0)) + F.col("_members") - 1
    out = met.select(F.col("_id").alias(id_col), "class_id", links.alias("n_links"), F.col("_rep").alias("exact_id"), F.col("_members").alias("exact_size"))
    same, none, one = F.col("_id"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    alone = signed.filter("_class is null").select(same.alias(id_col), same.alias("class_id"), none.alias("n_links"), same.alias("exact_id"), one.alias("exact_size"))
    return out.unionByName(alone)


def dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate class: of its smallest id (nulls last) and, where that id stands at several of its
    texts, of one text. Rows without words all stay. Only rows of classes with other rows, by a bitmap filter, may shuffle."""
    signed, own = _decide(docs, scratch, id_col, text_col)
    several = scratch.save(own.filter("_members > 1 or _n > 1").select("_class", "_rep", "_best", "_members"), "several")
    filter_, bits = key_filter(several, F.col("_class"), several.count())
    filter_ = scratch.save(filter_, "filter")
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row")
    packed = docs.select(row, docs[f"`{id_col}`"].alias("_id"), class_hash(docs[f"`{text_col}`"]).alias("_class"))
    flagged = with_membership(packed, F.col("_class"), filter_, bits, "_maybe")
    met = join_groups(flagged.filter("_maybe").drop("_maybe"), several, "_class", "_members", signed.count())
    stays = met.filter(F.col("_best") & F.col("_id").eqNullSafe(F.col("_rep"))).groupBy("_class").agg(F.first("_row").alias("_row"))
    passed = flagged.filter("not _maybe").select("_row").unionByName(met.filter("_best is null").select("_row"))
    return passed.unionByName(stays.select("_row")).select("_row.*")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Scratch(spark))


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLES = {}
