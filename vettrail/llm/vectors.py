"""Near-duplicate vectors by NN-descent.

Equal vectors are one class. Within a label, every class gets a first list of neighbours from a few
random-hyperplane tables; then the lists are refined: each vector introduces its neighbours, and those
that list it, to one another (a neighbours-of-neighbours join), an introduction counts where it beats
the end of a list, and only introductions with a fresh entry are made again. Refinement ends when few
lists change. A list that is full of links is saturated and is enlarged; what is still saturated at
the greatest length lies in a dense ball and is compared, as a query set in blocks, with all vectors
of its label, from which only counts and one link per vector and block are kept. Recall is audited
label by label against all rows, for a sample of vectors that grows until enough of them have links;
below the target, more tables are added for those labels and the lists refined again. A label that
still misses the target, or whose sample would be half of it, is compared in blocks like a dense
ball: exactly, at a cost quadratic in the label. Links are the edges at or above the threshold, by
cosine in double precision.

Defined results: a vector that is null, empty, all zero, or holds a null or a non-finite component, or
whose label is null, links with nothing. Vectors of different lengths aren't compared. Equal rows are
vectors of their own that link with each other. A null vec_id counts as larger than any id. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components

#: First length of a list, greatest length, vectors that list one and are introduced in one turn.
NEIGHBOURS, MOST_NEIGHBOURS, LISTED_BY = 10, 40, 12
#: Hyperplane tables at least, vectors that should share a cell, cell size beyond which it is dealt out.
TABLES, CELL, MOST_IN_CELL = 6, 40, 80
#: Chance that a pair at the threshold shares no cell of any table, at most: sets the tables of a label by its size.
UNMET = 0.01
#: Refinement ends when fewer than this share of the entries changed, or after so many turns.
CHANGED, TURNS = 0.002, 6
#: Turns after lists were enlarged; whatever they leave saturated is compared in blocks.
ENLARGED_TURNS = 2
#: Sampled vectors of a label at first, how many of them must have links, growth of a sample with fewer.
AUDIT_ROWS, AUDIT_LINKED, AUDIT_GROWTH = 300, 100, 8
#: Share of links that must be found, repairs before the labels that miss it are compared in blocks.
RECALL, REPAIRS = 0.97, 2
#: Sides of a block when a query set meets all rows.
QUERY_BLOCK, ROW_BLOCK = 512, 4096

_EDGES = "u long, v long, s double"


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[tuple[pa.RecordBatch, np.ndarray]]]:
    """Runs of whole groups from a partition sorted by `key`: (rows, first row of each group and the end)."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def out(table: pa.Table):
        rows = table.combine_chunks().to_batches()[0]
        k = rows[key].to_numpy()
        return rows, np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= 20_000:
            table = pa.Table.from_batches(held)
            k = table[key].to_numpy()
            other = np.flatnonzero(k != k[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield out(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield out(pa.Table.from_batches(held))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, which pass between JVM and Python as they are; floats stay floats."""
    for batch in batches:
        lists = batch["e"]
        at, kind = np.asarray(lists.offsets, np.int64), "<f4" if lists.type.value_type == pa.float32() else "<f8"
        flat = np.ascontiguousarray(np.asarray(lists.values), kind)
        packed = pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([packed if n == "e" else batch[n] for n in batch.schema.names], batch.schema.names)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors of one length as rows in double precision."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return raw.view("<f4" if len(raw) == 4 * dim * len(column) else "<f8").reshape(len(column), dim).astype(np.float64)


def _matrix(column: pa.Array, dim: int, a: int, b: int) -> np.ndarray:
    """Unit rows in double precision."""
    x = _rows(column.slice(a, b - a), dim)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _edges(u: list[np.ndarray], v: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch:
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(join(u, np.int64), pa.int64()), pa.array(join(v, np.int64), pa.int64()), pa.array(join(s, float), pa.float64())], ["u", "v", "s"])


def _cells(keep: int) -> Callable:
    """Within each cell, every vector's best `keep` others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in _groups(batches, "g"):
            ids, (u, v, s) = rows["x"].to_numpy(), ([], [], [])
            for a, b in zip(at[:-1], at[1:]):
                if b - a < 2:
                    continue
                x = _matrix(rows["e"], rows["dim"][a].as_py(), a, b)
                like = x @ x.T
                np.fill_diagonal(like, -2)
                k = min(keep, b - a - 1)
                best = np.argpartition(-like, k - 1, axis=1)[:, :k]
                u.append(np.repeat(ids[a:b], k)), v.append(ids[a:b][best].ravel()), s.append(np.take_along_axis(like, best, 1).ravel())
            yield _edges(u, v, s)

    return run


def _introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group, the pairs with a fresh side that beat the end of the first one's list."""
    for rows, at in _groups(batches, "g"):
        ids, end, fresh, (u, v, s) = rows["x"].to_numpy(), rows["worst"].to_numpy(), rows["fresh"].to_numpy(zero_copy_only=False), ([], [], [])
        for a, b in zip(at[:-1], at[1:]):
            if b - a < 2:
                continue
            x, own, new = _matrix(rows["e"], rows["dim"][a].as_py(), a, b), ids[a:b], fresh[a:b]
            like = x @ x.T
            # an entry that is listed both ways stands twice, one after the other: the first one counts
            twice = np.concatenate(([False], own[1:] == own[:-1]))
            new = new | np.concatenate((twice[1:] & new[1:], [False]))
            like[:, twice] = like[twice] = -2
            np.fill_diagonal(like, -2)
            i, j = np.nonzero((like > end[a:b, None]) & (new[:, None] | new[None, :]))
            u.append(own[i]), v.append(own[j]), s.append(like[i, j])
        yield _edges(u, v, s)


def _blocks(threshold: float) -> Callable:
    """Queries against rows of one block: counts of links (kind 0: of a query, 1: of another row) and links that join what the block joins (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in _groups(batches, "g"):
            kind, one, two = [], [], []
            for a, b in zip(at[:-1], at[1:]):
                asked = rows["asked"].slice(a, b - a).to_numpy(zero_copy_only=False)
                if not asked.any() or asked.all():
                    continue
                x, ids, m = _matrix(rows["e"], rows["dim"][a].as_py(), a, b), rows["x"].to_numpy()[a:b], rows["m"].to_numpy()[a:b]
                dense = rows["dense"].slice(a, b - a).to_numpy(zero_copy_only=False)[~asked]
                q, r = ids[asked], ids[~asked]
                linked = (x[asked] @ x[~asked].T >= threshold) & (q[:, None] != r[None, :])
                kind.append(np.zeros(len(q), np.int32)), one.append(q), two.append(linked @ m[~asked])
                own = ~dense
                kind.append(np.ones(int(own.sum()), np.int32)), one.append(r[own]), two.append(m[asked] @ linked[:, own])
                # components of the block, by the smaller id of two that meet
                left = q.copy()
                far = np.iinfo(np.int64).max
                while True:
                    right = np.where(linked, left[:, None], far).min(0)
                    new = np.minimum(left, np.where(linked, right[None, :], far).min(1))
                    if (new == left).all():
                        break
                    left = new
                met = right < far
                for ids_, to in ((q, left), (r[met], right[met])):
                    kind.append(np.full(len(ids_), 2, np.int32)), one.append(ids_), two.append(to)
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(join(kind, np.int32), pa.int32()), pa.array(join(one, np.int64), pa.int64()), pa.array(join(two, np.int64).astype(np.int64), pa.int64())], ["kind", "a", "b"]
            )

    return run


def _against_all(classes: DataFrame, asked: DataFrame, dense: bool, threshold: float) -> DataFrame:
    """A query set (x, of `classes`) against all vectors of its label in blocks: (kind, a, b) as _blocks() has them."""
    asked = asked.withColumn("asks", F.lit(True))
    marked = classes.join(asked, "x", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    sides = marked.groupBy("label", "dim").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("q")).filter("q > 0")
    sides = sides.select("label", "dim", F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("qs"), F.ceil(F.col("n") / ROW_BLOCK).cast("int").alias("rs"))
    marked = marked.join(sides, ["label", "dim"])
    part = lambda n: F.pmod(F.xxhash64("x"), F.col(n)).cast("int")
    group = lambda q, r: F.xxhash64("label", "dim", q, r).alias("g")
    keep = ["x", "e", "dim", "m"]
    queries = marked.filter("asks").withColumn("q", part("qs")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)))
    rows = marked.withColumn("r", part("rs")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    both = queries.select(group("q", "r"), *keep, F.lit(True).alias("asked"), F.lit(False).alias("dense")).union(
        rows.select(group("q", "r"), *keep, F.lit(False).alias("asked"), (F.col("asks") & F.lit(dense)).alias("dense"))
    )
    return both.repartition("g").sortWithinPartitions("g").mapInArrow(_blocks(threshold), "kind int, a long, b long")


_LISTS = ["u", "v", "s", "fresh", "worst"]


def _best(edges: DataFrame, size: DataFrame | None) -> DataFrame:
    """Each u's best entries, as many as its list holds, with the last one's similarity where the list is full. One shuffle, by u."""
    one = edges.select("u", "v", "s", "fresh").repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    one = one.withColumn("k", F.lit(NEIGHBOURS)) if size is None else one.join(size, "u", "left").withColumn("k", F.coalesce("k", F.lit(NEIGHBOURS)))
    own = W.partitionBy("u")
    ranked = one.withColumn("rank", F.row_number().over(own.orderBy(F.desc("s"), "v"))).filter(F.col("rank") <= F.col("k"))
    return ranked.withColumn("worst", F.coalesce(F.max(F.when(F.col("rank") == F.col("k"), F.col("s"))).over(own), F.lit(-2.0))).select(*_LISTS)


def _tables(first: int, tables: int) -> Callable:
    """Cell codes of each vector in `tables` tables of 20 hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, codes = batch["dim"].to_numpy(), np.zeros((batch.num_rows, tables), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _rows(batch["e"].take(pa.array(at)), int(d))
                for t in range(tables):
                    planes = np.random.default_rng([77, first + t]).standard_normal((20, d))
                    codes[at, t] = ((x @ planes.T > 0) << np.arange(20)).sum(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("x", "label", "dim", "e")), lists], ["x", "label", "dim", "e", "codes"])

    return run


def _first_lists(classes: DataFrame, turn: int, threshold: float, kind: str) -> DataFrame:
    """Edges among vectors that share a cell of a table of this turn. Cells too large are dealt out at random; refinement joins them."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    bits = sizes.select("label", "dim", F.least(F.lit(20), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CELL)))).cast("int").alias("bits"))
    # a plane doesn't part a pair at the threshold with chance `same`
    same = 1 - float(np.arccos(np.clip(threshold, -1, 1 - 1e-9))) / np.pi
    wanted = F.greatest(F.lit(TABLES), F.ceil(F.log(F.lit(UNMET)) / F.log(1 - F.pow(F.lit(same), F.col("bits")))).cast("int"))
    bits = bits.withColumn("tables", F.when(F.col("bits") == 0, TABLES).otherwise(wanted))
    most = bits.agg(F.max("tables")).first()[0] or TABLES
    coded = classes.select("x", "label", "dim", "e").mapInArrow(_tables(turn * 1000, most), f"x long, label {kind}, dim int, e binary, codes array<long>")
    coded = coded.join(bits, ["label", "dim"]).withColumn("codes", F.slice("codes", 1, F.col("tables")))
    cells = coded.select("x", "e", "label", "dim", "bits", F.posexplode("codes").alias("t", "code"))
    cells = cells.withColumn("cell", F.xxhash64("label", "dim", "t", F.expr("code & (shiftleft(1L, bits) - 1)"))).drop("label", "code", "bits")
    held = cells.groupBy("cell").agg(F.count("*").alias("n"))
    dealt = cells.join(held, "cell").withColumn("g", F.xxhash64("cell", F.pmod(F.xxhash64("x", "t"), F.ceil(F.col("n") / MOST_IN_CELL))))
    return dealt.select("g", "x", "e", "dim").repartition("g").sortWithinPartitions("g").mapInArrow(_cells(NEIGHBOURS), _EDGES)


def _refine(lists: DataFrame, classes: DataFrame, size: DataFrame | None, n: int, turns: int = TURNS) -> DataFrame:
    """Introductions until few entries change, `turns` times at most."""
    vectors = classes.select("x", "e", "dim")
    for turn in range(turns):
        worst = lists.groupBy(F.col("u").alias("x")).agg(F.max("worst").alias("worst"))
        nodes = vectors.join(worst, "x", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
        listed_by = lists.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("u", F.lit(turn))))).filter(F.col("r") <= LISTED_BY)
        sides = lists.select(F.col("u").alias("g"), F.col("v").alias("x"), "fresh").union(listed_by.select(F.col("v").alias("g"), F.col("u").alias("x"), "fresh"))
        # groups without a fresh entry have made their introductions
        sides = sides.withColumn("live", F.max("fresh").over(W.partitionBy("g"))).filter("live").drop("live")
        met = sides.join(nodes, "x").select("g", "x", "e", "dim", "worst", "fresh")
        offered = met.repartition("g").sortWithinPartitions("g", "x").mapInArrow(_introduce, _EDGES)
        old = lists.select("u", "v", "s", F.lit(False).alias("fresh"))
        before, lists = lists, materialize(_best(old.union(offered.withColumn("fresh", F.lit(True))), size), "lists")
        discard(before)
        if lists.filter("fresh").count() <= CHANGED * n * NEIGHBOURS:
            break
    return lists


def _audit(classes: DataFrame, links: DataFrame, dense: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(label, dim) of labels that miss the target, and of those where half the label wouldn't tell.

    Every class counts once, whatever its rows. The target holds for all sampled links together and for the
    mean of the sampled vectors that have any, so that neither a large class nor a large group hides pairs.
    """
    key = ["label", "dim"]
    rest, ones = classes.join(dense, "x", "left_anti"), classes.withColumn("m", F.lit(1).cast("long"))
    have = links.select(F.col("a").alias("x")).union(links.select(F.col("b").alias("x"))).groupBy("x").agg(F.count("*").alias("h"))
    left = materialize(rest.groupBy(*key).agg(F.count("*").alias("n")), "unaudited")
    missed, rows = left.filter("false").select(*key), AUDIT_ROWS
    whole = missed
    while True:
        whole = whole.union(left.filter(F.col("n") < 2 * rows).select(*key))
        left = left.filter(F.col("n") >= 2 * rows)
        if left.isEmpty():
            return missed, whole
        sample = rest.join(left, key).filter(F.pmod(F.xxhash64("x", F.lit(5)), F.lit(1 << 30)) < F.lit(float(rows)) / F.col("n") * (1 << 30)).select("x")
        true = _against_all(ones, materialize(sample, "sample"), False, threshold).filter("kind = 0").groupBy(F.col("a").alias("x")).agg(F.sum("b").alias("n")).filter("n > 0")
        each = classes.select("x", *key).join(true, "x").join(have, "x", "left").withColumn("h", F.least("n", F.coalesce("h", F.lit(0))))
        seen = each.groupBy(*key).agg(F.count("*").alias("linked"), (F.sum("h") / F.sum("n")).alias("found"), F.avg(F.col("h") / F.col("n")).alias("mean"))
        enough = materialize(seen.filter(F.col("linked") >= AUDIT_LINKED), "audited")
        missed = missed.union(enough.filter(F.least("found", "mean") < RECALL).select(*key))
        left = materialize(left.join(enough, key, "left_anti"), "unaudited")
        rows *= AUDIT_GROWTH


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    e = F.col("e")
    rows = vectors.select(F.col("vec_id").isNull().alias("nid"), F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("id"), "label", F.col("embedding").alias("e"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("h1", F.xxhash64("e")).withColumn("h2", F.xxhash64(F.lit(7), "e"))
    kind = dict(vectors.dtypes)["label"]
    same = ["label", "h1", "h2"]
    classes = rows.filter("ok").groupBy(*same).agg(F.count("*").alias("m"), F.min(F.struct("nid", "id")).alias("rep"), F.first("e").alias("e"))
    classes = classes.withColumn("dim", F.size("e")).withColumn("x", F.monotonically_increasing_id())
    fields = ", ".join(f"{f.name} {'binary' if f.name == 'e' else f.dataType.simpleString()}" for f in classes.schema)
    classes = materialize(classes.mapInArrow(_packed, fields), "classes")
    n = classes.count()

    lists = materialize(_best(_first_lists(classes, 0, threshold, kind).withColumn("fresh", F.lit(True)), None), "lists")
    lists, size = _refine(lists, classes, None, n), None
    for repair in range(REPAIRS + 1):
        k = NEIGHBOURS
        while k < MOST_NEIGHBOURS:  # saturated lists grow
            k *= 2
            full = lists.groupBy("u").agg(F.count("*").alias("c"), F.min("s").alias("s")).filter((F.col("s") >= threshold) & (F.col("c") * 2 >= k)).select("u", F.lit(k).alias("k"))
            full = materialize(full, "full")
            if full.isEmpty():
                break
            size = full if size is None else materialize(size.union(full).groupBy("u").agg(F.max("k").alias("k")), "sizes")
            held, lists = lists, lists.join(full.select("u", F.lit(True).alias("again")), "u", "left").select("u", "v", "s", (F.col("fresh") | F.coalesce("again", F.lit(False))).alias("fresh"), F.when(F.col("again"), -2.0).otherwise(F.col("worst")).alias("worst"))
            before, lists = held, materialize(lists, "lists")
            discard(before)
            lists = _refine(lists, classes, size, n, ENLARGED_TURNS)
        links = lists.filter(F.col("s") >= threshold).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        links = materialize(links, "links")
        dense = lists.groupBy("u").agg(F.count("*").alias("c"), F.min("s").alias("s")).filter((F.col("s") >= threshold) & (F.col("c") >= MOST_NEIGHBOURS)).select(F.col("u").alias("x"))
        dense = materialize(dense, "dense")
        missed, whole = _audit(classes, links, dense, threshold)
        if repair == REPAIRS or missed.isEmpty():
            break
        again = classes.join(materialize(missed, "missed"), ["label", "dim"], "left_semi")
        extra = _first_lists(again, repair + 1, threshold, kind).withColumn("fresh", F.lit(True))
        before, lists = lists, materialize(_best(lists.select("u", "v", "s", "fresh").union(extra), size), "lists")
        discard(before, links, dense)
        lists = _refine(lists, classes, size, n)
    # labels without the measured recall are compared as a whole
    exact = classes.join(missed.union(whole), ["label", "dim"], "left_semi").select("x")
    dense = materialize(dense.union(exact).distinct(), "dense")

    pairs, sums = links, None
    ends = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    if not dense.isEmpty():
        blocks = materialize(_against_all(classes, dense, True, threshold), "blocks")
        pairs = links.union(blocks.filter("kind = 2").select("a", "b"))
        sums = blocks.filter("kind < 2").select(F.col("a").alias("x"), F.col("b").alias("h"))
        # links with a dense vector are counted by the blocks
        ends = ends.join(dense, "x", "left_anti").join(dense.withColumnRenamed("x", "y"), "y", "left_anti")
    counted = ends.join(classes.select(F.col("x").alias("y"), "m"), "y").select("x", F.col("m").alias("h"))
    counted = (counted if sums is None else counted.union(sums)).groupBy("x").agg(F.sum("h").alias("h"))
    label = components(pairs).select(F.col("id").alias("x"), "component")
    joined = classes.select("x", *same, "m", "rep").join(label, "x", "left").withColumn("component", F.coalesce("component", "x"))
    first = joined.groupBy("component").agg(F.min("rep").alias("first"))
    joined = joined.join(first, "component").join(counted, "x", "left")
    joined = joined.select(*same, (F.coalesce("h", F.lit(0)) + F.col("m") - 1).alias("links"), "first")
    plain = rows.filter("not ok").select("nid", "id", F.lit(0).cast("long").alias("links"), F.struct("nid", "id").alias("first"))
    out = rows.filter("ok").select("nid", "id", *same).join(joined, same).select("nid", "id", "links", "first").union(plain)
    vec_id, component = F.when(~F.col("nid"), F.col("id")), F.when(~F.col("first.nid"), F.col("first.id"))
    return out.select(vec_id.alias("vec_id"), F.col("links").cast("long").alias("n_links"), component.alias("component_id"), vec_id.eqNullSafe(component).alias("kept"))
