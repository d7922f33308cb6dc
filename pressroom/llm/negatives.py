"""Hard negatives: for an anchor and a row like it, rows of other labels that score almost as high.

Vectors have integer components; the score of two rows is their inner product. The positives of an anchor
are the rows of its label with the highest scores, ties by smaller id. A negative of an anchor and a
positive is a row of another label whose score is from ``low`` to ``high`` percent of the positive's;
those with the highest scores are returned.

The search filters by angles. Each row stores its angles to a few reference directions. Two rows with angles
s and t to one direction are at least ``|s - t|`` and at most ``min(s + t, 2 pi - s - t)`` apart, so all
directions together give an interval for the cosine, and the norms make it one for the score, widened by more
than what rounding can be. Only pairs whose interval overlaps a wanted window are scored, in integers:
highest upper bound first, until the next bound is below what is already found. The result is exact
whatever the directions.

1. Reference directions are taken from ``SAMPLE`` rows (those of the smallest hashes of their ids), each the one
   farthest from those before it. Rows are dealt by the nearest direction into cells, and cells by a hash
   into shards of about ``SHARD_ROWS``, so neither a large cell nor many equal vectors meet in one task.
2. Every anchor visits the shards of its own cell. What it finds there is a floor for the rest: it
   visits only cells whose range of angles allows more. This is done once for positives, and once for
   all windows of an anchor. In a task at most ``ANCHORS`` anchors meet one shard.

Bounds: directions are ``REFERENCES`` vectors, and what is known of cells is one row each; both are fixed and
are all that leaves the executors, besides the sample.

Defined results: rows without an id, label, vector or component take no part, nor do rows whose squared
components sum to more than ``MOST``, as their scores would not fit. Where rows share an id, the one of the
smallest label, then vector, takes part. A missing component of a shorter vector counts as 0. An anchor without
positives, or whose positives score below 0, has no row. An empty table gives an empty result.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.rows import bucket
from pressroom.plans.scratch import keep, stored_rows

SAMPLE = 1_024
REFERENCES = 16
SHARD_ROWS = 1 << 14
ANCHORS = 1 << 14
# The largest squared norm; then 100 times a score still fits into 64 bits.
MOST = 9e16
# More than the errors of two stored angles, in radians, and of a product of norms, as a share.
SLACK, SHARE = 4e-6, 1e-9
FIRST_CHUNK = 256
FAR = 1 << 62


def integer_vectors(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component; null for a vector with a component that is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    # the null of an outer `when` keeps floor from ever seeing what is not finite
    return F.when(~bad & (_squares(F.transform(vector, lambda x: x * F.lit(float(scale)))) < 4 * MOST), scaled)


def _squares(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _taking_part(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v, anchor``: one row per id."""
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "v", "anchor"
    ).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull()) & (_squares(F.col("v")) <= MOST)
    )
    placed = rows.withColumn("_bucket", bucket("vec_id"))
    several = keep(rows.groupBy("vec_id").count().filter("count > 1").select(bucket("vec_id").alias("_bucket")).distinct())
    if not stored_rows(several):
        return rows
    once = placed.join(F.broadcast(several), "_bucket", "left_anti").drop("_bucket")
    least = F.min(F.struct("label", "v", "anchor")).alias("r")
    first = placed.join(F.broadcast(several), "_bucket", "left_semi").groupBy("vec_id").agg(least).select("vec_id", "r.*")
    return once.unionByName(first)


def _matrix(vectors: list, kind: type = np.int32) -> np.ndarray:
    """Vectors as rows, the shorter ones filled up with zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), kind)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def reference_directions(rows: DataFrame, count: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors, one a row: of a sample, each the vector farthest from those chosen before."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    x = _matrix(some.column("v").to_pylist(), np.float64)
    norms = np.sqrt((x * x).sum(1))
    x = x[norms > 0] / norms[norms > 0, None]
    if not len(x):
        return np.ones((1, 1))
    chosen = [0]
    nearest = x @ x[0]
    while len(chosen) < count and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def angles_to(x: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The angle of every vector to every direction; a right angle for a vector of norm 0."""
    width = min(x.shape[1], references.shape[1])
    dots = x[:, :width].astype(np.float64) @ references[:, :width].T
    return np.arccos(np.clip(dots / np.where(norms > 0, norms, 1)[:, None], -1, 1))


def _measured(references: np.ndarray) -> tuple[Callable, str]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v = part.column("v").to_pylist()
            x = _matrix(v)
            wide = x.astype(np.float64)
            norms = np.sqrt((wide * wide).sum(1))
            angles = angles_to(x, norms, references).astype(np.float32)
            yield pa.record_batch(
                [part.column("vec_id"), part.column("label"), part.column("anchor"), pa.array(norms),
                 pa.array(list(angles), pa.list_(pa.float32())), pa.array([np.array(r, np.int32).tobytes() for r in v], pa.binary()),
                 pa.array(angles.argmin(1).astype(np.int32))],
                names=["vec_id", "label", "anchor", "norm", "angles", "v", "cell"],
            )

    return run, "vec_id bigint, label bigint, anchor boolean, norm double, angles array<float>, v binary, cell int"


@dataclass
class Cells:
    """What the driver knows of the cells: one row each."""

    first: np.ndarray  # number of the first shard of each cell
    parts: np.ndarray  # shards of each cell
    least: np.ndarray  # smallest angle to each direction
    most: np.ndarray
    short: np.ndarray  # smallest norm
    long: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, count: int, shard_rows: int) -> "Cells":
        angle = lambda k: F.get("angles", F.lit(k))
        table = rows.groupBy("cell").agg(
            F.count("*").alias("n"), F.min("norm").alias("short"), F.max("norm").alias("long"),
            F.array(*[F.min(angle(k)) for k in range(count)]).alias("least"),
            F.array(*[F.max(angle(k)) for k in range(count)]).alias("most"),
        ).collect()
        parts = np.zeros(count, np.int64)
        least, most = np.zeros((2, count, count))
        short, long = np.zeros((2, count))
        for r in table:
            parts[r.cell] = -(-r.n // shard_rows)
            least[r.cell], most[r.cell], short[r.cell], long[r.cell] = r.least, r.most, r.short, r.long
        return cls(np.cumsum(parts) - parts, parts, least, most, short, long)

    def shard(self) -> Column:
        """The shard of a row."""
        of_cell = lambda numbers: F.get(F.array(*[F.lit(int(n)) for n in numbers]), F.col("cell"))
        return of_cell(self.first) + F.pmod(F.xxhash64("vec_id"), of_cell(self.parts).cast("bigint"))

    def bounds(self, angles: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """For one anchor, the least and the largest score in each cell."""
        near = np.maximum(np.maximum(angles - self.most, self.least - angles), 0).max(1)
        opposite = np.pi - angles
        ends = [np.minimum(angles + t, 2 * np.pi - angles - t) for t in (self.least, self.most)]
        inside = (self.least <= opposite) & (opposite <= self.most)
        far = np.where(inside, np.pi, np.maximum(*ends)).min(1)
        low, high = np.cos(np.minimum(far + SLACK, np.pi)), np.cos(np.maximum(near - SLACK, 0))
        room = SHARE * norm * self.long + SHARE
        return (
            norm * np.minimum(low * self.short, low * self.long) - room,
            norm * np.maximum(high * self.short, high * self.long) + room,
        )


def score_bounds(angles: np.ndarray, norm: float, others: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score that one vector can have with each of the others."""
    near = np.abs(others - angles).max(1)
    total = others + angles
    far = np.minimum(total, 2 * np.pi - total).min(1)
    product = norm * norms
    room = SHARE * product + SHARE
    return (
        product * np.cos(np.minimum(far + SLACK, np.pi)) - room,
        product * np.cos(np.maximum(near - SLACK, 0)) + room,
    )


def scores(x: np.ndarray, a: np.ndarray, product: float) -> np.ndarray:
    """Exact inner products; no partial sum is above the product of the norms, which says what type holds them."""
    width = min(x.shape[1], len(a))
    x, a = x[:, :width], a[:width]
    if product < 1 << 24:
        return (x.astype(np.float32) @ a.astype(np.float32)).astype(np.int64)
    if product < 1 << 53:
        return (x.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    return x.astype(np.int64) @ a.astype(np.int64)


def best_in_windows(
    low: np.ndarray, high: np.ndarray, ids: np.ndarray, wants: list[tuple[int, int]], k: int, score: Callable
) -> tuple[list[list[tuple[int, int]]], int]:
    """For each window ``(least, most)`` the ``k`` best ``(id, score)``, and how many rows were scored.

    ``low`` and ``high`` bound the score of each row; ``score`` gives the scores of the rows at some places.
    """
    least, most = min(w[0] for w in wants), max(w[1] for w in wants)
    open_rows = np.flatnonzero((high >= least) & (low <= most))
    open_rows = open_rows[np.argsort(-high[open_rows], kind="stable")]
    floors = [w[0] for w in wants]
    found: list[np.ndarray] = []
    at, size = 0, FIRST_CHUNK
    while at < len(open_rows) and high[open_rows[at]] >= min(floors):
        found.append(score(open_rows[at : at + size]))
        at, size = at + size, size * 2
        sofar = np.concatenate(found)
        for n, (least, most) in enumerate(wants):
            inside = sofar[(sofar >= least) & (sofar <= most)]
            if len(inside) >= k:
                floors[n] = int(np.partition(inside, len(inside) - k)[len(inside) - k])
    done = open_rows[:at]
    got = np.concatenate(found) if found else np.zeros(0, np.int64)
    best = []
    for n, (_, most) in enumerate(wants):
        inside = np.flatnonzero((got >= floors[n]) & (got <= most))
        order = inside[np.lexsort((ids[done[inside]], -got[inside]))][:k]
        best.append([(int(ids[done[r]]), int(got[r])) for r in order])
    return best, len(done)


FOUND = "anchor_id bigint, key bigint, of_key bigint, vec_id bigint, score bigint"


def _met(same: bool, k: int) -> Callable:
    """The best rows of one shard in all windows of each anchor that visits it."""

    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            ids, labels, norms = (rows.column(c).to_numpy() for c in ("vec_id", "label", "norm"))
            angles = np.array(rows.column("angles").to_pylist(), np.float64)
            x = _matrix([np.frombuffer(v, np.int32) for v in rows.column("v").to_pylist()])
            longest = norms.max()
            of_label: dict[int, np.ndarray] = {}
            for a in anchors.to_pylist():
                if a["label"] not in of_label:
                    of_label[a["label"]] = np.flatnonzero((labels == a["label"]) == same)
                own = of_label[a["label"]]
                if same:
                    own = own[ids[own] != a["anchor_id"]]
                if not len(own):
                    continue
                v = np.frombuffer(a["v"], np.int32)
                low, high = score_bounds(np.array(a["angles"], np.float64), a["norm"], angles[own], norms[own])
                wants = [(w["least"], w["most"]) for w in a["wants"]]
                best, _ = best_in_windows(
                    low, high, ids[own], wants, k, lambda at, own=own, v=v, a=a: scores(x[own[at]], v, a["norm"] * longest)
                )
                for want, top in zip(a["wants"], best, strict=True):
                    out += [(a["anchor_id"], want["key"], want["of_key"], i, s) for i, s in top]
        names = [c.split()[0] for c in FOUND.split(", ")]
        return pa.table({c: pa.array([r[n] for r in out], pa.int64()) for n, c in enumerate(names)})

    return run


class Search:
    """Rows in shards, and visits of anchors to them."""

    def __init__(self, vectors: DataFrame, references: int = REFERENCES, shard_rows: int = SHARD_ROWS, anchors: int = ANCHORS) -> None:
        rows = keep(_taking_part(vectors))
        directions = reference_directions(rows, references)
        measured = keep(rows.mapInArrow(*_measured(directions)))
        self.cells = Cells.of(measured, len(directions), shard_rows)
        self.anchors = measured.filter("anchor").select(F.col("vec_id").alias("anchor_id"), "label", "norm", "angles", "v", "cell")
        self.slices = max(1, -(-self.anchors.count() // anchors))
        every = F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))).alias("slice")
        self.rows = measured.select("vec_id", "label", "norm", "angles", "v", self.cells.shard().alias("shard"), every)

    def _visit(self, anchors: DataFrame, same: bool, k: int, home: bool) -> DataFrame:
        """``anchors`` have ``wants``: windows with a key each. Rows as in ``FOUND``, the best ``k`` a shard and window."""
        cells = self.cells

        def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                shards = []
                for a in part.select(["cell", "norm", "angles", "wants"]).to_pylist():
                    if home:
                        go = [a["cell"]]
                    else:
                        low, high = cells.bounds(np.array(a["angles"], np.float64), a["norm"])
                        open_cells = np.zeros(len(low), bool)
                        for w in a["wants"]:
                            open_cells |= (high >= w["least"]) & (low <= w["most"])
                        open_cells[a["cell"]] = False
                        go = np.flatnonzero(open_cells)
                    shards.append([n for c in go for n in range(cells.first[c], cells.first[c] + cells.parts[c])])
                yield pa.record_batch([*part.columns, pa.array(shards, pa.list_(pa.int64()))], names=[*part.schema.names, "shards"])

        kinds = ", ".join(f"{c} {t}" for c, t in anchors.dtypes)
        visits = anchors.mapInArrow(route, f"{kinds}, shards array<bigint>").select(
            "anchor_id", "label", "norm", "angles", "v", "wants", F.explode("shards").alias("shard"),
            F.pmod(F.xxhash64("anchor_id"), F.lit(self.slices)).cast("int").alias("slice"),
        )
        return visits.groupBy("shard", "slice").cogroup(self.rows.groupBy("shard", "slice")).applyInArrow(_met(same, k), FOUND)

    def best(self, wants: DataFrame, same: bool, k: int) -> DataFrame:
        """The best ``k`` rows in each window of ``wants(anchor_id, wants)``, with their rank ``rk``."""
        order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
        anchors = self.anchors.join(wants, "anchor_id")
        home = keep(self._visit(anchors, same, k, home=True).withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k))
        reached = home.filter(F.col("rk") == k).groupBy("anchor_id").agg(F.map_from_arrays(F.collect_list("key"), F.collect_list("score")).alias("floors"))
        raised = F.transform(
            "wants",
            lambda w: F.struct(
                w["key"].alias("key"), w["of_key"].alias("of_key"),
                F.coalesce(F.try_element_at("floors", w["key"]), w["least"]).alias("least"), w["most"].alias("most"),
            ),
        )
        others = anchors.join(reached, "anchor_id", "left").withColumn("wants", raised).drop("floors")
        rest = self._visit(others, same, k, home=False)
        both = home.drop("rk").unionByName(rest)
        return both.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)


def _window(key: Column, of_key: Column, least: Column, most: Column) -> Column:
    values = zip(("key", "of_key", "least", "most"), (key, of_key, least, most), strict=True)
    return F.struct(*[c.cast("bigint").alias(name) for name, c in values])


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **sizes: int
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, label, v, anchor``: integer components, and which rows are anchors.
    """
    search = Search(vectors, **sizes)
    all_scores = F.array(_window(F.lit(0), F.lit(0), F.lit(-FAR), F.lit(FAR)))
    found = keep(search.best(search.anchors.select("anchor_id", all_scores.alias("wants")), True, positives))
    wants = (
        found.withColumn("least", F.expr(f"({low} * score + 99) div 100"))
        .withColumn("most", F.expr(f"{high} * score div 100"))
        .filter("score >= 0 and least <= most")
        .groupBy("anchor_id")
        .agg(F.collect_list(_window(F.col("vec_id"), F.col("score"), F.col("least"), F.col("most"))).alias("wants"))
    )
    return search.best(keep(wants), False, negatives).select(
        "anchor_id",
        F.col("key").alias("positive_id"),
        F.col("rk").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        F.col("of_key").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
