"""Faces and the faces before them: persons of new faces, and clusters around leaders.

Faces come in the order of their ids. Each is compared with every face that has a
person by then: the known ones, and new ones of smaller ids. From ``least`` on it
takes the person of the best; below, it founds a person. Which face is best does not
depend on persons, so all best faces are searched at once, and persons follow the
chains of best faces to where they begin, twice as far in each round.

That search deals faces to cells around pivots and keeps each cell's radius: the angle
to a pivot less the radius is a bound, so that cells which can't hold a face within
``least`` are passed over and nothing is missed. Cells are put together to shards of
about ``ROWS`` faces. A query goes once to each shard in which it may find something,
so what is shuffled grows with the number of shards, not of cells. A task takes one
shard and one lot of queries, of ``ROWS`` at most, and multiplies them piece by piece.

Clusters are told by the same order: the first face not yet placed leads, and takes
every later one that is similar enough; so a face's leader is the first before it that
is similar. Each round takes the first ``ROWS`` or so of a block's open faces, finds
the leaders among them in one task, and asks for each open face of the block whether
one of those is its own. Only new leaders travel to other faces.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrail.operators.lineage import settle

#: Pivots at most, and rows of a shard, a lot or a round.
PIVOTS, ROWS = 1_024, 16_384
#: Queries and faces that are multiplied at a time.
STEP, WIDE = 512, 4_096
#: Angles are compared with so much room for rounding, and products.
ROOM = 1e-6


def _units(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable() -> Column:
    """Whether a vector has a direction: finite numbers, not all zero."""
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return (size > 0) & (size < float("inf")) & ~F.isnan(size)


def _celled(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _units(batch.column("vector")) @ pivots.T
                own = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
                yield batch.append_column("cell", pa.array(own, pa.int32())).append_column("angle", pa.array(angle))

    return run


def _visits(pivots: np.ndarray, radius: np.ndarray, shard: np.ndarray, least: float):
    """A row for each query and shard with a cell that may hold a face within ``least`` of it."""
    widest = np.arccos(np.clip(least, -1, 1)) + ROOM
    owns = [(s, np.flatnonzero(shard == s)) for s in range(int(shard.max(initial=-1)) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                may = np.arccos(np.clip(_units(batch.column("vector")) @ pivots.T, -1, 1)) - radius <= widest
                for s, cells in owns:  # one batch each: never all copies of a query at once
                    part = batch.filter(pa.array(may[:, cells].any(1)))
                    if part.num_rows:
                        yield part.append_column("shard", pa.array(np.full(part.num_rows, s, np.int32)))

    return run


def _best(pivots: np.ndarray, radius: np.ndarray, least: float):
    """Each query's most similar face before it, among those given, where one reaches ``least``."""
    widest = np.arccos(np.clip(least, -1, 1)) + ROOM

    def run(key, queries: pa.Table, faces: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and faces.num_rows:
            order = np.lexsort((faces.column("face_id").to_numpy(), faces.column("order").to_numpy()))
            ids, turn = faces.column("face_id").to_numpy()[order], faces.column("order").to_numpy()[order]
            f, cell = _units(faces.column("vector"))[order], faces.column("cell").to_numpy()[order]
            cells, at = np.unique(cell, return_inverse=True)
            mine = np.argsort(queries.column("cell").to_numpy(), kind="stable")  # alike ones together: they pass over the same cells
            asks, q = queries.column("face_id").to_numpy()[mine], _units(queries.column("vector"))[mine]
            for lo in range(0, len(q), STEP):
                x, own = q[lo : lo + STEP], asks[lo : lo + STEP]
                angle = np.arccos(np.clip(x @ pivots[cells].T, -1, 1))
                held = np.flatnonzero((angle - radius[cells] <= widest).any(0)[at])
                best, where = np.full(len(x), -2.0), np.zeros(len(x), np.int64)
                for part in (held[k : k + WIDE] for k in range(0, len(held), WIDE)):
                    near = x @ f[part].T
                    row, col = np.nonzero(near >= least - ROOM)
                    value, to = np.round(near[row, col], 12), part[col]
                    ok = (value >= least) & ((turn[to] == 0) | (ids[to] < own[row]))  # only faces before one's own
                    row, value, to = row[ok], value[ok], to[ok]
                    first = np.lexsort((to, -value, row))  # of equal ones known faces, then smaller ids
                    first = first[np.unique(row[first], return_index=True)[1]]
                    row, value, to = row[first], value[first], to[first]
                    better = value > best[row]  # parts come in the order of faces
                    best[row[better]], where[row[better]] = value[better], to[better]
                ok = best > -2
                out.append((own[ok], best[ok], turn[where[ok]].astype(np.int32), ids[where[ok]]))
        names = ("face_id", "similarity", "order", "other")
        kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int64())
        return pa.table({c: pa.array(np.concatenate([o[k] for o in out]) if out else [], kind) for k, (c, kind) in enumerate(zip(names, kinds))})

    return run


def _dealt(queries: DataFrame, faces: DataFrame, place: list[str], rows: int, run, schema: str) -> DataFrame:
    """``run`` over each place's queries and faces, in lots and parts of about ``rows``."""
    asked = queries.groupBy(*place).agg(F.ceil(F.count("*") / rows).cast("int").alias("lots"))
    held = faces.groupBy(*place).agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    sizes = settle(asked.join(held, place))
    q = queries.join(sizes, place).withColumn("lot", F.pmod(F.xxhash64("face_id"), F.col("lots")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    f = faces.join(sizes, place).withColumn("part", F.pmod(F.xxhash64("face_id"), F.col("parts")).cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    key = [*place, "part", "lot"]
    return q.drop("parts", "lots").groupBy(*key).cogroup(f.drop("parts", "lots").groupBy(*key)).applyInArrow(run, schema)


def _shards(sizes: dict[int, int], n: int, rows: int) -> np.ndarray:
    """The shard of each of ``n`` cells: cells one after another, as long as a shard has no more than ``rows`` faces."""
    shard, now, held = np.zeros(n, np.int32), 0, 0
    for cell in range(n):
        if held and held + sizes.get(cell, 0) > rows:
            now, held = now + 1, 0
        shard[cell], held = now, held + sizes.get(cell, 0)
    return shard


def best_earlier(new: DataFrame, known: DataFrame, least: float, *, rows: int = ROWS, pivots: int = PIVOTS) -> DataFrame:
    """``face_id, similarity, order, other``: each new face's most similar face among the known (order 0) and the new of smaller id (order 1), where one reaches ``least``."""
    faces = known.select("face_id", "vector", F.lit(0).alias("order")).unionAll(new.select("face_id", "vector", F.lit(1).alias("order")))
    faces = settle(faces.where(_usable()).select("face_id", "vector", "order", F.size("vector").alias("dims")))
    kind = f"face_id long, vector {faces.schema['vector'].dataType.simpleString()}, order int, cell int"
    found = None
    for dims, n in sorted((r["dims"], r["n"]) for r in faces.groupBy("dims").agg(F.count("*").alias("n")).collect()):  # vectors of other models are never compared
        own = faces.where(F.col("dims") == dims).drop("dims")
        sample = own.select("vector").orderBy(F.xxhash64("face_id", "order")).limit(min(pivots, max(1, int(n**0.5)))).toArrow()
        centres = _units(sample.column("vector"))
        celled = settle(own.mapInArrow(_celled(centres), f"{kind}, angle double"))
        radius, sizes = np.full(len(centres), -10.0), {}  # no face, no visit
        for r in celled.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # a row a pivot
            radius[r["cell"]], sizes[r["cell"]] = r["radius"] + ROOM, r["n"]
        shard = _shards(sizes, len(centres), rows)
        celled = celled.drop("angle")
        visits = celled.where("order = 1").mapInArrow(_visits(centres, radius, shard, least), f"{kind}, shard int").drop("order")
        placed = celled.withColumn("shard", F.array(*(F.lit(int(x)) for x in shard))[F.col("cell")])
        met = settle(_dealt(visits, placed, ["shard"], rows, _best(centres, radius, least), "face_id long, similarity double, order int, other long"))
        found = met if found is None else found.unionAll(met)
    if found is None:
        return new.select("face_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("order"), F.col("face_id").alias("other")).limit(0)
    best = found.where(F.col("similarity") >= least).groupBy("face_id").agg(F.max(F.struct("similarity", (-F.col("order")).alias("o"), (-F.col("other")).alias("x"))).alias("b"))
    return best.select("face_id", "b.similarity", (-F.col("b.o")).alias("order"), (-F.col("b.x")).alias("other"))


def assigned(new: DataFrame, known: DataFrame, *, least: float = 0.6, rows: int = ROWS, pivots: int = PIVOTS) -> DataFrame:
    """``face_id, person_id, founder, similarity`` of each new face (``face_id, vector``), given ``known`` ones (``face_id, person_id, vector``).

    ``person_id`` is a known person or null; then ``founder`` is the face that founded
    the person, maybe the face's own. ``similarity`` is that to the best face before,
    null if none reaches ``least``. A face without a usable vector has neither person
    nor founder.
    """
    best = settle(best_earlier(new, known, least, rows=rows, pivots=pivots))
    usable = new.where(_usable()).select("face_id")
    to_known = best.where("order = 0").join(known.select(F.col("face_id").alias("other"), "person_id"), "other").select("face_id", "person_id", "similarity", F.lit(None).cast("long").alias("founder"), F.lit(None).cast("long").alias("up"))
    to_new = best.where("order = 1").select("face_id", F.lit(None).cast(known.schema["person_id"].dataType).alias("person_id"), "similarity", F.lit(None).cast("long").alias("founder"), F.col("other").alias("up"))
    founders = usable.join(best.select("face_id"), "face_id", "left_anti").select("face_id", F.lit(None).cast(known.schema["person_id"].dataType).alias("person_id"), F.lit(None).cast("double").alias("similarity"), F.col("face_id").alias("founder"), F.lit(None).cast("long").alias("up"))
    now = settle(to_known.unionByName(to_new).unionByName(founders))
    while now.where("up is not null").limit(1).count():
        ahead = now.select(F.col("face_id").alias("up"), F.col("person_id").alias("p"), F.col("founder").alias("f"), F.col("up").alias("u"))
        now = settle(now.join(ahead, "up", "left").select("face_id", F.coalesce("person_id", "p").alias("person_id"), "similarity", F.coalesce("founder", "f").alias("founder"), F.col("u").alias("up")))
    return new.select("face_id").join(now.select("face_id", "person_id", "founder", "similarity"), "face_id", "left")


def _led(least: float, schema: pa.Schema):
    """The leaders among a block's first open faces, of whatever number: none of them is like one before it that leads."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("face_id").to_numpy())
        x, leads = _units(table.column("vector"))[order], []
        for lo in range(0, len(x), STEP):
            part = x[lo : lo + STEP]
            free = np.ones(len(part), bool)
            for k in range(0, len(leads), WIDE):
                free &= ~(np.round(part @ x[leads[k : k + WIDE]].T, 12) >= least).any(1)
            left = np.flatnonzero(free)
            near, open_ = np.round(part[left] @ part[left].T, 12) >= least, np.ones(len(left), bool)
            for i in range(len(left)):
                if open_[i]:
                    leads.append(lo + int(left[i]))
                    open_[i:] &= ~near[i, i:]
        return table.select(schema.names).take(pa.array(order[leads])).cast(schema)

    return run


def _first(block: list[str], least: float, schema: pa.Schema):
    """Each query's first leader before it, among those given, that is similar enough; a leader its own."""

    def run(key, queries: pa.Table, faces: pa.Table) -> pa.Table:
        if not queries.num_rows or not faces.num_rows:
            return schema.empty_table()
        order = np.argsort(faces.column("face_id").to_numpy())
        ids, mine = faces.column("face_id").to_numpy()[order], queries.column("face_id").to_numpy()
        q, f = _units(queries.column("vector")), _units(faces.column("vector"))[order]
        found = np.full(len(q), -1)
        for lo in range(0, len(q), STEP):
            own, at = mine[lo : lo + STEP], found[lo : lo + STEP]
            for k in range(0, len(f), WIDE):
                part = ids[k : k + WIDE]
                fits = (np.round(q[lo : lo + STEP] @ f[k : k + WIDE].T, 12) >= least) & (part[None, :] < own[:, None])
                fits |= part[None, :] == own[:, None]
                new = (at < 0) & fits.any(1)
                at[new] = k + fits.argmax(1)[new]
        ok = found >= 0
        own = queries.filter(pa.array(ok))
        return pa.table([*(own.column(c) for c in block), own.column("face_id"), pa.array(ids[found[ok]])], schema=schema)

    return run


def _upto(open_: DataFrame, place: list[str], rows: int) -> DataFrame:
    """``place..., upto``: the id up to which each block has half of ``rows`` faces to ``rows``, about; never below its first."""
    shares = [0.5**k for k in range(40)]
    found = open_.groupBy(*place).agg(F.count("*").alias("n"), F.min("face_id").alias("lo"), F.percentile_approx("face_id", shares).alias("q"))
    step = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / rows))).cast("int")
    return found.select(*place, F.greatest("lo", F.col("q")[F.least(F.lit(39), step)]).alias("upto"))


def leader_clusters(faces: DataFrame, *, block: Sequence[str] = ("block",), key: str = "face_id", least: float = 0.6, least_size: int = 2, rows: int = ROWS) -> DataFrame:
    """``block..., face_id, leader``: the first face not yet placed leads, and takes every other one of its block at least that similar. Small clusters go.

    Blocks have any size. A round decides the first ``rows`` open faces of each block,
    about, and all those similar to a leader among them: where leaders have many faces,
    a few rounds are enough; where no face is like another, a block takes its size by
    ``rows``. A vector without a direction is like no other.
    """
    ids, place = [*block, "face_id"], [*block, "dims"]
    own = faces.select(*block, F.col(key).alias("face_id"), "vector", F.size("vector").alias("dims"))
    usable = F.coalesce(_usable(), F.lit(False))
    for c in block:
        usable = usable & F.col(c).isNotNull()
    own = settle(own.withColumn("usable", usable))
    done = own.where("not usable").select(*ids, F.col("face_id").alias("leader"))
    open_ = own.where("usable").drop("usable")
    kinds = [(c, _arrow(faces, c)) for c in block]
    told = [f"{c} {faces.schema[c].dataType.simpleString()}" for c in block]
    leads = pa.schema([*kinds, ("dims", pa.int32()), ("face_id", pa.int64()), ("vector", _arrow(faces, "vector"))])
    leads_told = ", ".join([*told, "dims int", "face_id long", f"vector {faces.schema['vector'].dataType.simpleString()}"])
    schema = pa.schema([*kinds, ("face_id", pa.int64()), ("leader", pa.int64())])
    while open_.limit(1).count():
        upto = _upto(open_, place, rows)
        first = open_.join(upto, place).where(F.col("face_id") <= F.col("upto")).drop("upto")
        leaders = settle(first.groupBy(*place).applyInArrow(_led(least, leads), leads_told))
        placed = settle(_dealt(open_, leaders, place, rows, _first(list(block), least, schema), ", ".join([*told, "face_id long", "leader long"])).groupBy(*ids).agg(F.min("leader").alias("leader")))
        done = done.unionByName(placed)
        open_ = settle(open_.join(placed, ids, "left_anti"))
    state = settle(done)
    large = state.groupBy(*block, "leader").agg(F.count("*").alias("n")).where(F.col("n") >= least_size).select(*block, "leader")
    return state.join(large, [*block, "leader"], "left_semi").select(*block, F.col("face_id").alias(key), "leader")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
