"""Near duplicates by b-bit MinHash.

A document is its set of word shingles (five words unless told otherwise), each a 64-bit hash; a shorter
text is one shingle. Equal sets are one class, found by
two 64-bit hashes of the set, so exact copies cost one row however many there are. A class keeps the
minima of HASHES hash functions only while it is signed: bands of ROWS minima become bucket keys, and
the low BITS bits of each minimum are packed into four 64-bit words. Classes that share a bucket are
candidates; a candidate pair's similarity is estimated from the bit count of the XOR of its words,
corrected for the chance that different minima agree in their low bits, and only pairs far below the
threshold go. Every other pair is confirmed on the full sets.

A bucket of more than SMALL members is never expanded into its pairs. Each member meets the bucket's
pivot, and what that links becomes one component, inside which pairs need no test. Where a bucket
then still holds several components, the members outside its largest one are a query set that meets
all its members in blocks: the sets are compared inside the task by an inverted index, and a task
emits only links that join components, a forest at most. So every link between candidates counts, and
what is emitted grows linearly with a group of near copies.

Defined results: null, empty and word-less texts have no shingles and are alone. A null doc_id counts
as larger than any id. Repeated rows of one id are one document. An empty table gives no rows. Extra
columns are ignored. Ties are settled by the smallest id.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLDED_VALUES, chunks, discard, identified, materialize, mix, prefix_sums, range_hash, words
from .components import components

#: Words of a shingle.
SHINGLE = 5
#: 28 bands of 5: two sets at the threshold of 0.8 share no bucket with a chance of 1.5e-5.
BANDS, ROWS = 28, 5
HASHES = BANDS * ROWS
#: Low bits kept of the first PACKED minima: four 64-bit words.
BITS, PACKED = 2, 128
#: A pair estimated below this isn't confirmed: six standard deviations under the threshold.
ESTIMATE_FLOOR = 0.55
PERCENT = 80
#: Buckets of so many members at most are compared pair by pair.
SMALL = 6
#: Shingles on the two sides of a block when members meet inside a task.
QUERY_SHINGLES, ROW_SHINGLES = 250_000, 250_000
#: Up to so many class ids (25 bytes each) are sent to the executors to pick their texts; beyond that texts are shuffled.
BROADCAST_ROWS = 500_000

_RNG = np.random.default_rng(20240)
_A = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)

_SIGNED = "nid boolean, id long, th long, n long, k1 long, k2 long, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's runs of `size` words, in order."""
    step = np.uint64(0x9E3779B97F4A7C15)
    for t in chunks(column):
        start, end, first = words(t)
        hashes = range_hash(prefix_sums(FOLDED_VALUES[t.data]), start, end)
        n = max(0, len(hashes) - size + 1)
        with np.errstate(over="ignore"):
            runs = hashes[:n].copy()
            for j in range(1, size):
                runs = runs * step + hashes[j : j + n]
            runs = mix(runs)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                if b - a >= size:
                    yield np.unique(runs[a : b - size + 1])
                else:  # the whole sequence as one shingle, or none
                    whole = hashes[a : min(a + 1, b)].copy()
                    for j in range(a + 1, b):
                        whole = whole * step + hashes[j]
                    yield mix(whole ^ np.uint64(0x5851F42D4C957F2D + b - a))


def _minima(values: np.ndarray) -> np.ndarray:
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 2048):
            np.minimum(out, (_A[:, None] * x[None, i : i + 2048] + _B[:, None]).min(1), out=out)
    return out


def _sign(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    weights = np.uint64(1) << (np.arange(PACKED // 4, dtype=np.uint64) * np.uint64(BITS))
    band = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        size, keys = [], []
        minima = np.zeros((batch.num_rows, HASHES), np.uint32)
        for i, values in enumerate(shingle_sets(batch["text"], shingle)):
            size.append(len(values))
            with np.errstate(over="ignore"):
                mixed = mix(values + np.uint64(0x632BE59BD9B4E019))
                keys.append((mixed.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(mixed)) if len(values) else np.uint64(0)))
            if len(values):
                minima[i] = _minima(values)
        with np.errstate(over="ignore"):
            low = (minima[:, :PACKED] & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minima), 4, PACKED // 4)
            packed = (low * weights).sum(2, dtype=np.uint64).view(np.int64)
            rows = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
            buckets = np.broadcast_to(band, (len(minima), BANDS)).copy()
            for r in range(ROWS):
                buckets = mix(buckets ^ rows[:, :, r])
        flat = pa.array(buckets.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(minima) + 1, dtype=np.int32) * BANDS), flat)
        k = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
        columns = [batch["nid"], batch["id"], batch["th"], pa.array(size, pa.int64()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), *(pa.array(packed[:, j].copy()) for j in range(4)), lists]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SIGNED.split(", ")])


def estimate(left: list[Column], right: list[Column]) -> Column:
    """Similarity from packed signatures: agreeing slots, less the 1 in 2**BITS that agree by chance."""
    odd = F.lit(0x5555555555555555)
    differ = sum((F.bit_count((x := a.bitwiseXOR(b)).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd)) for a, b in zip(left, right)), F.lit(0))
    chance = 1.0 / (1 << BITS)
    return (1.0 - differ / F.lit(float(PACKED)) - chance) / (1.0 - chance)


def _may_link(a: str, b: str) -> Column:
    col = lambda p, c: F.col(f"{p}.{c}")
    sizes = 100 * F.least(col(a, "n"), col(b, "n")) >= PERCENT * F.greatest(col(a, "n"), col(b, "n"))
    return sizes & (estimate([col(a, f"s{i}") for i in range(4)], [col(b, f"s{i}") for i in range(4)]) >= ESTIMATE_FLOOR)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([x.tobytes() for x in shingle_sets(batch["text"], shingle)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["cid"], sets], ["cid", "set"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch["x"], batch["y"])):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            linked[i] = 100 * common >= PERCENT * (len(both) - common)
        yield batch.select(["a", "b"]).filter(pa.array(linked))


def _full_sets(wanted: DataFrame, texts: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(cid, set) of the class ids in `wanted`, from one text of each class."""
    owners = classes.join(wanted.distinct(), "cid").select("cid", "nid", "id", "th")
    owners = materialize(owners, "owners")
    picked = texts.join(F.broadcast(owners) if owners.count() <= BROADCAST_ROWS else owners, ["nid", "id", "th"])
    return materialize(picked.select("cid", "text").mapInArrow(functools.partial(_sets, shingle=shingle), "cid long, set binary").dropDuplicates(["cid"]), "sets")


def _linked(pairs: DataFrame, texts: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """Which candidate pairs (a, b) of class ids have the similarity, by their full sets."""
    sets = _full_sets(pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))), texts, classes, shingle)
    both = pairs.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a")
    out = materialize(both.select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long"), "links")
    discard(sets)
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join different components in each block of a partition sorted by block."""

    def block(part: pa.RecordBatch) -> tuple[list[int], list[int]]:
        cid, label, asked = part["cid"].to_numpy(), part["label"].to_numpy(), part["asked"].to_numpy(zero_copy_only=False)
        size = part["n"].to_numpy()
        signed = np.stack([part[f"s{i}"].to_numpy() for i in range(4)], 1).view(np.uint64)
        rows = np.flatnonzero(~asked)
        if not asked.any() or not len(rows):
            return [], []
        raw, at = np.frombuffer(part["set"].buffers()[2], np.uint8), np.asarray(part["set"].buffers()[1]).view(np.int32)[part["set"].offset :]
        values = [raw[at[i] : at[i + 1]].copy().view(np.uint64) for i in range(part.num_rows)]
        flat = np.concatenate([values[i] for i in rows])
        owner = np.repeat(np.arange(len(rows)), size[rows])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        root = {int(x): int(x) for x in np.unique(label)}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = [], []
        floor = ESTIMATE_FLOOR * (1 - 1 / (1 << BITS)) + 1 / (1 << BITS)
        for q in np.flatnonzero(asked):
            near = 100 * np.minimum(size[rows], size[q]) >= PERCENT * np.maximum(size[rows], size[q])
            near &= label[rows] != label[q]
            differ = signed[rows] ^ signed[q]
            differ = np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1)
            near &= 1 - differ / PACKED >= floor
            if not near.any():
                continue
            lo, hi = np.searchsorted(flat, values[q], "left"), np.searchsorted(flat, values[q], "right")
            n = hi - lo
            hits = owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            common = np.bincount(hits, minlength=len(rows))
            for r in rows[near & (100 * common >= PERCENT * (size[rows] + size[q] - common))]:
                x, y = find(int(label[q])), find(int(label[r]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(int(cid[q])), b.append(int(cid[r]))
        return a, b

    held: list[pa.RecordBatch] = []

    def done(table: pa.Table):
        one = table.combine_chunks().to_batches()[0]
        a, b = block(one)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch["g"].to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for i, j in zip(cuts, cuts[1:]):
            if held and held[-1]["g"][0].as_py() != g[i]:
                yield done(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield done(pa.Table.from_batches(held))


def _across(members: DataFrame, label: DataFrame, texts: DataFrame, classes: DataFrame, shingle: int) -> DataFrame | None:
    """Links between components that share a large bucket; None where no bucket holds two."""
    own = members.join(label, "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label"))
    held = own.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("unit")).filter("labels > 1")
    # who meets whom: the unit is the largest component of the bucket, the others ask
    units = materialize(own.join(held.select("key", "unit"), "key").select("unit", "cid", "label").distinct(), "units")
    if units.isEmpty():
        return None
    words_ = [f"s{i}" for i in range(4)]
    sets = _full_sets(units.select("cid"), texts, classes, shingle)
    units = units.join(classes.select("cid", "n", *words_), "cid").withColumn("asks", F.col("label") != F.col("unit"))
    sides = units.groupBy("unit").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0)).alias("q"))
    sides = sides.select("unit", F.ceil(F.col("q") / QUERY_SHINGLES).cast("int").alias("qs"), F.ceil(F.col("n") / ROW_SHINGLES).cast("int").alias("rs"))
    units = units.join(sides, "unit")
    part = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    queries = units.filter("asks").withColumn("q", part("qs")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rs") - 1))).withColumn("asked", F.lit(True))
    rows = units.withColumn("r", part("rs")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).withColumn("asked", F.lit(False))
    both = queries.unionByName(rows).select(F.xxhash64("unit", "q", "r").alias("g"), "cid", "label", "n", *words_, "asked").join(sets, "cid")
    links = materialize(both.repartition("g").sortWithinPartitions("g").mapInArrow(_meet, "a long, b long"), "links")
    discard(sets)
    return links


def _grouped(docs: DataFrame, shingle: int) -> DataFrame:
    """(nid, id, th, n, first) of every row; first is the smallest (nid, id) of its group."""
    texts = identified(docs)
    signed = materialize(texts.mapInArrow(functools.partial(_sign, shingle=shingle), _SIGNED), "signed")
    words_ = [f"s{i}" for i in range(4)]
    classes = signed.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("nid", "id", "th")).alias("rep"), *(F.first(c).alias(c) for c in (*words_, "bands")))
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "n", "rep.nid", "rep.id", "rep.th", *words_, "bands")
    classes = materialize(classes, "classes")
    keyed = classes.select(F.explode("bands").alias("key"), "cid")
    shared = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("cid").alias("pivot")).filter("m > 1")
    members = materialize(keyed.join(shared, "key"), "members")
    slim = classes.select("cid", "n", *words_)
    few = members.filter(F.col("m") <= SMALL).select("key", "cid")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") < F.col("y.cid"))).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    pairs = pairs.union(members.filter((F.col("m") > SMALL) & (F.col("cid") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("cid").alias("b"))).distinct()
    near = pairs.alias("p").join(slim.alias("x"), F.col("p.a") == F.col("x.cid")).join(slim.alias("y"), F.col("p.b") == F.col("y.cid")).filter(_may_link("x", "y"))
    links = _linked(materialize(near.select("p.a", "p.b"), "pairs"), texts, classes, shingle)
    label = components(links).withColumnRenamed("id", "cid").withColumnRenamed("component", "label")
    more = _across(members.filter(F.col("m") > SMALL).select("key", "cid"), label, texts, classes, shingle)
    if more is not None and not more.isEmpty():
        label = components(links.union(more)).withColumnRenamed("id", "cid").withColumnRenamed("component", "label")
    labelled = classes.select("cid", "k1", "k2", "n", F.struct("nid", "id").alias("rep")).join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    first = labelled.groupBy("label").agg(F.min("rep").alias("first"))
    labelled = labelled.join(first, "label").select("k1", "k2", "n", "first")
    out = signed.select("nid", "id", "th", "n", "k1", "k2").join(labelled, ["k1", "k2", "n"], "left")
    return out.select("nid", "id", "th", "n", F.coalesce("first", F.struct("nid", "id")).alias("first"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row."""
    doc_id, component = F.when(~F.col("nid"), F.col("id")), F.when(~F.col("first.nid"), F.col("first.id"))
    return _grouped(docs, shingle).select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), doc_id.eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The input's rows and columns, of each group of near duplicates the rows of its smallest doc_id; rows that repeat id and text are one."""
    grouped = _grouped(docs, shingle)
    gone = grouped.filter((F.col("nid") != F.col("first.nid")) | (F.col("id") != F.col("first.id"))).select("nid", "id", "th").distinct()
    gone = materialize(gone, "gone")
    again = materialize(grouped.groupBy("nid", "id", "th").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "again")
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    same = lambda other: (F.col("doc_id").isNull() == other["nid"]) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == other["id"]) & (text == other["th"])
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    kept = docs.join(small(gone), same(gone), "left_anti")
    if again.isEmpty():
        return kept
    again = small(again)
    return kept.join(again, same(again), "left_anti").union(kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))
