"""The k most similar vectors of every vector, by a permutation index.

Pivots are drawn from the vectors themselves, so dense regions get more of them. A vector is
represented by the ordered list of its nearest pivots and posted in the inverted file of each of the
first few. Vectors of one file are ranked for each other by the footrule distance of their lists; the
best are compared exactly (cosine), and the results of a vector's files are merged.

A file is never divided: every vector in it meets every other, whatever its size, so what is found doesn't
hang on how many vectors there are. The vectors of a file larger than a block ask in blocks and answer in
turn, so a task holds two blocks at most. Files grow as the square root of the vectors, and with them the
ranking of a vector, but not what is posted. Products of directions are sums of whole numbers that 64 bits
hold, so a similarity is the same wherever and in whatever company it is computed, and ties are ties: neither
blocks nor batches decide them. Exact copies are collapsed before the search (a file full of
copies would be all ties) and given their neighbours afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators.skew import lookup
from gneiss.session import cut_lineage

#: Pivots per square root of the number of vectors; their number is the index's documented sample.
PIVOTS_PER_ROOT = 4.0
#: No more pivots than this, which bounds the broadcast (times the dimension, times 4 bytes).
MOST_PIVOTS = 32_767
#: Pivots in a vector's list, and the files it is posted in.
LIST_LENGTH = 16
FILES = 4
#: The candidates of a file that are compared exactly, per vector.
RERANKED = 96
#: Vectors in a block: what asks, and what answers at a time, in one task. It bounds memory; results don't depend on it.
BLOCK = 32_768
#: Answering lists that are ranked at a time, which fit a core's cache.
STRETCH = 2_048
#: Pivots beside a list's that are compared exactly for it, as single precision may have misplaced them.
SPARE = 16
#: A candidate is its footrule and, in so many bits, its place.
INDEX_BITS = 20
PLACES = (1 << INDEX_BITS) - 1
#: Members of a class of copies that one task sorts.
MEMBERS = 65_536


def usable_vectors(df: DataFrame, key: str, vector: str, group: str, dimension: int, stated: str | None = None) -> DataFrame:
    """(grp, id, q, same): one row per key with a usable vector; ``q`` is its direction in 16 bits a value, ``same``
    128 bits that all vectors of exactly one direction share.

    Usable: exactly ``dimension`` values, all finite, not all zero (and ``stated``, if given, equal to
    the dimension). Everything else, nulls included, is no vector. Of repeated keys one row counts (the
    smallest). A null group is a group of its own. Values are scaled so that the largest is 32,767: a
    cosine is then off by about 4e-6, and a vector takes half the bytes in every shuffle. Whether two
    vectors are copies is told by their values as they are stored, scaled alike.
    """
    v = F.col(vector)
    ok = v.isNotNull() & (F.size(v) == dimension)
    if stated:
        ok = ok & (F.col(stated) == dimension)
    picked = df.filter(ok & F.col(key).isNotNull()).select(F.col(group).alias("grp"), F.col(key).alias("id"), v.alias("v"))
    kinds = dict(picked.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dimension)  # a null becomes nan
            top = np.abs(x).max(axis=1, initial=0)
            keep = np.flatnonzero(np.isfinite(x).all(axis=1) & (top > 0))
            scaled = x[keep] / top[keep, None]
            q = np.rint(scaled * 32767).astype("<i2")
            same = pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in scaled.astype("<f4")], pa.binary())
            part = b.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binary(q), same], names=["grp", "id", "q", "same"])

    one = picked.mapInArrow(run, f"grp {kinds['grp']}, id {kinds['id']}, q binary, same binary").groupBy("id").agg(F.min(F.struct("grp", "q", "same")).alias("r"))
    return one.select("r.grp", "id", "r.q", "r.same")


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(column: pa.Array, dtype: str) -> np.ndarray:
    """The matrix that a column of equally long binary values holds."""
    if not len(column):
        return np.zeros((0, 1), dtype)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(column), -1)


def _lengths(q: np.ndarray) -> np.ndarray:
    """The lengths of the rows of a matrix of whole numbers, from exact sums."""
    x = q.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _unit(q: np.ndarray) -> np.ndarray:
    """The rows of a matrix of whole numbers as unit vectors of single precision."""
    return (q / _lengths(q)[:, None]).astype(np.float32)


def _nearest_pivots(q: np.ndarray, p: np.ndarray, unit: np.ndarray, m: int) -> np.ndarray:
    """The m nearest rows of ``p`` to each row of ``q``, nearest first, of equal ones the first; ``unit`` are those of ``p``.

    Single precision, whose last bits depend on the rows computed together, only draws up the list; where
    what it left out might be nearer than what is listed, all of ``p`` is compared exactly.
    """
    count, width = len(p), min(len(p), m + SPARE)
    sims = _unit(q) @ unit.T
    near = np.sort(np.argpartition(-sims, width - 1, axis=1)[:, :width], axis=1)
    least = np.take_along_axis(sims, near, 1).min(axis=1)
    lengths, mine = _lengths(p), _lengths(q)[:, None]
    exact = np.matmul(p[near].astype(np.float64), q[:, :, None].astype(np.float64))[..., 0] / lengths[near] / mine
    order = np.argsort(-exact, axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(near, order, 1)
    if width < count:
        error = (2 * p.shape[1] + 16) * np.finfo(np.float32).eps
        unsure = np.flatnonzero(np.take_along_axis(exact, order[:, -1:], 1)[:, 0] <= least + error)
        if len(unsure):
            whole = q[unsure].astype(np.float64) @ p.astype(np.float64).T / lengths / mine[unsure]
            out[unsure] = np.argsort(-whole, axis=1, kind="stable")[:, :m]
    return out


def _pivots(distinct: DataFrame, per_root: float, most: int) -> dict:
    """group -> matrix of pivots, drawn in hash order; group -> number of vectors, on the side."""
    sizes = {r[0]: r[1] for r in distinct.groupBy("grp").count().collect()}  # one row per group (embedding model)
    chosen = {}
    for g, n in sizes.items():
        count = min(n, most, max(8, math.ceil(per_root * math.sqrt(n))))
        mine = distinct.filter(F.col("grp").eqNullSafe(F.lit(g)))
        rows = mine.orderBy(F.xxhash64(F.col("id"), F.lit(17)), "id").select("q").limit(count).collect()
        chosen[g] = _rows(pa.array([bytes(r[0]) for r in rows], pa.binary()), "<i2")
    return chosen


def _listed(distinct: DataFrame, pivots: dict, length: int) -> DataFrame:
    """(grp, id, q, list): each vector with the numbers of its nearest pivots, nearest first."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)
    kinds = dict(distinct.dtypes)
    schema = f"grp {kinds['grp']}, id {kinds['id']}, q binary, list binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: dict = {}
        for b in batches:
            groups = b.column(0).to_pylist()
            for g in dict.fromkeys(groups):
                part = b.take(pa.array([i for i, x in enumerate(groups) if x == g], pa.int64()))
                p = shared.value[g]
                m = min(length, p.shape[0])
                if g not in units:
                    units[g] = _unit(p)
                q = _rows(part.column(2), "<i2")
                lists = np.empty((len(q), m), dtype="<i2")
                for lo in range(0, len(q), 512):
                    lists[lo : lo + 512] = _nearest_pivots(q[lo : lo + 512], p, units[g], m)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), _binary(lists)], names=["grp", "id", "q", "list"])

    return distinct.select("grp", "id", "q").mapInArrow(run, schema)


def _posted(listed: DataFrame, files: int) -> DataFrame:
    """One row per vector and file: ``file`` is the two bytes of a pivot's number."""
    at = F.sequence(F.lit(0), F.least(F.lit(files), (F.length("list") / 2).cast("int")) - 1)
    return listed.select("grp", "id", "q", "list", F.explode(F.transform(at, lambda i: F.col("list").substr(2 * i + 1, F.lit(2)))).alias("file"))


def _blocked(posted: DataFrame, block: int) -> DataFrame:
    """Postings with the block ``qb`` that they meet: role 0 asks and answers, 1 asks, 2 answers.

    A file of at most a block is whole. In a larger one each block of asking vectors meets all vectors of the file.
    """
    sizes = posted.groupBy("grp", "file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    blocks = sizes.select(F.col("grp").alias("g"), F.col("file").alias("f"), F.ceil(F.col("n") / block).cast("int").alias("many"))
    own = posted.join(F.broadcast(blocks), F.col("grp").eqNullSafe(F.col("g")) & (F.col("file") == F.col("f")), "left")  # at most a row per pivot
    at = lambda qb, role: F.struct(qb.cast("int").alias("qb"), F.lit(role).alias("role"))
    asks = F.array(at(F.pmod(F.xxhash64("id"), F.col("many")), 1))
    answers = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda o: at(o, 2))
    roles = F.when(F.col("many").isNull(), F.array(at(F.lit(0), 0))).otherwise(F.concat(asks, answers))
    return own.select("grp", "id", "q", "list", "file", F.explode(roles).alias("x")).select("grp", "id", "q", "list", "file", "x.*")


def _footrule(q: np.ndarray, p: np.ndarray, pivots: int) -> np.ndarray:
    """The footrule distance of each list in ``q`` to each in ``p``, but for a constant.

    A pivot missing from a list counts as if it stood right after its end. Against lists that share nothing, a
    pivot at places i and j takes twice what the later of them lacks to the end: only shared pivots are summed.
    """
    length = q.shape[1]
    left = np.zeros((pivots, p.shape[0]), dtype=np.uint8)  # from a pivot's place to the end, 0 where it is missing
    for j in range(length):
        left[p[:, j], np.arange(p.shape[0])] = length - j
    most = np.arange(length, 0, -1, dtype=np.uint8)[:, None]
    total = np.empty((q.shape[0], p.shape[0]), dtype=np.uint8 if length * (length + 1) < 512 else np.uint16)
    for i, row in enumerate(q):
        both = left[row]
        np.minimum(both, most, out=both)
        np.add.reduce(both, axis=0, dtype=total.dtype, out=total[i])
    return length * (length + 1) - 2 * total.astype(np.uint16)


def _candidates(asking: np.ndarray, answering: np.ndarray, most: int) -> np.ndarray:
    """For each asking list the ``most`` answering ones of least footrule, of equal ones the first: footrule << INDEX_BITS | place."""
    local, lists = np.unique(np.concatenate([asking, answering]), return_inverse=True)  # pivots by their place among those that occur
    lists = lists.reshape(-1, asking.shape[1])
    asking, answering = lists[: len(asking)], lists[len(asking) :]
    top = np.empty((len(asking), 0), np.uint32)
    for start in range(0, len(answering), STRETCH):
        part = answering[start : start + STRETCH]
        apart = _footrule(asking, part, len(local))
        place = np.arange(start, start + len(part), dtype=np.uint32)
        width = min(most, start + len(part))
        kept = np.empty((len(asking), width), np.uint32)
        for lo in range(0, len(asking), 256):
            keys = np.concatenate([top[lo : lo + 256], apart[lo : lo + 256].astype(np.uint32) << INDEX_BITS | place], axis=1)
            kept[lo : lo + 256] = np.partition(keys, width - 1, axis=1)[:, :width]
        top = kept
    return top


def _search(blocks: DataFrame, k: int, reranked: int, block: int) -> DataFrame:
    """(grp, id, other, sim): the k best of a file for every vector in it, of the ``reranked`` nearest by footrule.

    Rows come by role and id, so those that ask are there before those that only answer, of which a block at a time is held.
    """
    kinds = dict(blocks.dtypes)
    schema = f"grp {kinds['grp']}, id {kinds['id']}, other {kinds['id']}, sim float"
    names = ["grp", "id", "other", "sim"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking: list[pa.RecordBatch] = []
        answering: list[pa.RecordBatch] = []
        others: list[pa.Array] = []  # the ids of all that answered
        keys = np.empty((0, 0), np.int64)  # of the candidates so far: footrule, then place among all that answered
        sims = np.empty((0, 0), np.float32)
        grp = ids = v = long = lists = None

        def meet() -> None:
            nonlocal keys, sims, ids, v, long, lists
            if v is None:
                t = pa.Table.from_batches(asking)
                ids, v, lists = t.column("id").combine_chunks(), _rows(t.column("q").combine_chunks(), "<i2"), _rows(t.column("list").combine_chunks(), "<i2")
                long = _lengths(v)
                keys, sims = np.empty((len(v), 0), np.int64), np.empty((len(v), 0), np.float32)
            t = pa.Table.from_batches(answering)
            mine, w = t.column("id").combine_chunks(), _rows(t.column("q").combine_chunks(), "<i2")
            lengths = _lengths(w)
            own = pc.fill_null(pc.index_in(ids, value_set=mine), -1).to_numpy(zero_copy_only=False)
            before = sum(map(len, others))
            others.append(mine)
            found = np.sort(_candidates(lists, _rows(t.column("list").combine_chunks(), "<i2"), reranked + 1), axis=1)  # one is the vector itself
            place = (found & PLACES).astype(np.int64)
            s = np.empty(found.shape, np.float32)
            for lo in range(0, len(v), 64):
                at = place[lo : lo + 64]
                dots = np.matmul(w[at].astype(np.float64), v[lo : lo + 64, :, None].astype(np.float64))[..., 0]
                s[lo : lo + 64] = dots / (lengths[at] * long[lo : lo + 64, None])
            s[place == own[:, None]] = -np.inf
            keys = np.concatenate([keys, (found >> INDEX_BITS).astype(np.int64) << 40 | place + before], axis=1)
            sims = np.concatenate([sims, s], axis=1)
            if keys.shape[1] > reranked + 1:
                near = np.argsort(keys, axis=1)[:, : reranked + 1]
                keys, sims = np.take_along_axis(keys, near, 1), np.take_along_axis(sims, near, 1)

        held = 0
        for b in (b.slice(lo, block) for b in batches for lo in range(0, b.num_rows, block)):
            grp = b.column(0).slice(0, 1) if grp is None else grp
            role = b.column(b.schema.get_field_index("role")).to_numpy()
            for rows, part in ((asking, b.filter(pa.array(role < 2))), (answering, b.filter(pa.array(role != 1)))):
                if part.num_rows:
                    rows.append(part)
            held += int((role != 1).sum())
            if held >= block:
                if asking:
                    meet()
                answering, held = [], 0
        if answering and asking:
            meet()
        if v is None:
            return
        place = keys & ((1 << 40) - 1)
        order = np.lexsort((place, -sims), axis=1)[:, :k]
        best, place = np.take_along_axis(sims, order, 1), np.take_along_axis(place, order, 1)
        keep = np.isfinite(best)
        asked = np.broadcast_to(np.arange(len(v))[:, None], best.shape)[keep]
        yield pa.RecordBatch.from_arrays([grp.take(pa.array(np.zeros(len(asked), np.int64))), ids.take(pa.array(asked)), pa.concat_arrays(others).take(pa.array(place[keep])), pa.array(best[keep])], names=names)

    by = ["grp", "file", "qb"]
    return blocks.repartition(*by).sortWithinPartitions(*by, "role", "id").groupBy(*by).applyInArrow(run, schema)


def neighbours(vectors: DataFrame, k: int, per_root: float = PIVOTS_PER_ROOT, most_pivots: int = MOST_PIVOTS, length: int = LIST_LENGTH, files: int = FILES, reranked: int = RERANKED, block: int = BLOCK) -> DataFrame:
    """(grp, id, other, sim): up to k neighbours of every vector within its group, most similar first.

    ``vectors`` as ``usable_vectors`` gives them. Ties are broken by the smaller id. A vector that is
    alone in its group has no row. ``block`` bounds what a task holds and doesn't change the result.
    """
    if length * (length + 1) >= 1 << (32 - INDEX_BITS) or block > PLACES // 2:
        raise ValueError(f"lists of {length} or blocks of {block} are too large")
    distinct = cut_lineage(vectors.groupBy("grp", "same").agg(F.min(F.struct("id", "q")).alias("r"), F.count(F.lit(1)).alias("copies")).select("grp", "same", "r.id", "r.q", "copies"))
    if distinct.isEmpty():
        return vectors.select("grp", "id", F.col("id").alias("other"), F.lit(0.0).cast("float").alias("sim")).limit(0)
    # Read twice: the sizes of the files, and the files.
    listed = cut_lineage(_listed(distinct, _pivots(distinct, per_root, most_pivots), length))
    found = _search(_blocked(_posted(listed, files), block), k, reranked, block)
    # One shuffle by id serves the merging of a vector's files and the ranking.
    merged = found.repartition("id").groupBy("id", "other").agg(F.first("grp").alias("grp"), F.max("sim").alias("sim"))
    best = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    ranked = merged.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place")
    if distinct.filter("copies > 1").isEmpty():
        return ranked.select("grp", "id", "other", "sim")
    return _with_copies(vectors, distinct, ranked, k)


def _with_copies(vectors: DataFrame, distinct: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Neighbours of every vector from those of the classes of exact copies.

    Of a class at most the k + 1 members of smallest id can be anyone's neighbours. A class may hold a third
    of all rows: its members are never gathered. They are sorted in parts of bounded size for the class's
    heads, and meet what belongs to their class, one row of it, as ``lookup`` has it: hot classes by a
    broadcast of bounded size. A member's copies come before everything else, however many they are.
    """
    several = distinct.filter("copies > 1").select(F.struct("grp", "same").alias("of"), F.col("id").alias("rep"), F.ceil(F.col("copies") / MEMBERS).cast("int").alias("parts"))
    mine = vectors.select("grp", "id", F.struct("grp", "same").alias("class"))
    members = cut_lineage(lookup(mine.withColumn("class", F.xxhash64("class.grp", "class.same")), several.withColumn("of", F.xxhash64("of.grp", "of.same")), "class", "of", "inner").select("grp", "rep", "id", "parts"))
    first = Window.partitionBy("rep", "part").orderBy("id")
    few = members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    heads = few.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("heads"))  # k + 1 per part of a class
    # Neighbours of other classes: a class answers with its heads, and asks for each of its members.
    answers = lookup(ranked.select("grp", "id", "other", "sim"), heads.withColumnRenamed("rep", "of"), "other", "of", "left")
    answers = answers.select("grp", F.col("id").alias("rep"), F.explode(F.coalesce("heads", F.array("other"))).alias("other"), "sim")
    top = Window.partitionBy("rep").orderBy(F.desc("sim"), "other")
    answers = answers.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k).drop("place")
    rest = answers.join(several.select("rep"), "rep", "left_anti").select("grp", F.col("rep").alias("id"), "other", "sim", F.lit(False).alias("copy"))
    # What every member of a class gets: its heads at 1, and where they are few the class's answers.
    far = answers.groupBy("rep").agg(F.collect_list(F.struct("other", "sim", F.lit(False).alias("copy"))).alias("far"))  # at most k
    own = F.transform("heads", lambda h: F.struct(h.alias("other"), F.lit(1.0).cast("float").alias("sim"), F.lit(True).alias("copy")))
    given = heads.join(far, "rep", "left").select(F.col("rep").alias("of"), F.when((F.size("heads") > k) | F.col("far").isNull(), own).otherwise(F.concat(own, "far")).alias("given"))
    near = lookup(members, given, "rep", "of", "inner").select("grp", "id", F.explode("given").alias("x")).select("grp", "id", "x.*").filter("id <> other")
    best = Window.partitionBy("id").orderBy(F.desc("copy"), F.desc("sim"), "other")
    return near.unionByName(rest).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place", "copy")


def pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b): each pair of which one is the other's neighbour once, the smaller id first."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
