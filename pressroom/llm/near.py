"""Near duplicates by MinHash: universal hash minima, banding, signature and exact checks, components.

Two documents are linked if their sets of word shingles have 100 * intersection >= ``percent`` *
union. Words are runs of characters other than white space, A-Z lower-cased; a text of fewer words
than a shingle has its whole sequence as one, a text without words has an empty set and no link.

1. Every text gives its shingles as 64-bit hashes, ``bands * rows`` minima of universal hashes
   ``a * x + b`` of them, and one key per band of ``rows`` minima. Both follow from ``percent``, so that a
   pair at ``percent`` has no band in common with a probability of at most ``MISS``, 1 in 80,000: 24 bands of
   6 at 85 %, 29 of 5 at 80 %, 40 of 2 at 50 %.
2. Equal sets are one class with its smallest id from here on; copies are never paired.
3. Classes with a band in common are candidates. Small bands are paired in full. In a large one,
   classes are compared with the class that has the most copies, so a large group of near copies costs
   a pair for each member. What is still apart after that is left to an exact prefix filter
   (``apart_pairs``): no band is too large to be finished, and none is cut short.
4. Candidates whose signatures agree in fewer than ``percent`` less five standard deviations are dropped
   (15 points at 85 %, 17 at 80 %); for the others the full sets are compared.
5. Linked classes are joined by large-star and small-star.

Defined results: rows of a null ``doc_id`` are linked with nothing and kept. Rows that share a
``doc_id`` share its component. Empty and null texts are each alone. An empty table gives an empty
result. Only ``doc_id`` and ``text`` are looked at; other columns pass through ``near_dedup`` unchanged.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.bytewords import batches, mix
from pressroom.llm.components import components
from pressroom.llm.rows import bucket, in_buckets_of, without
from pressroom.plans.scratch import keep, stored_rows
from pressroom.plans.skew import spread_join

MISS, DEVIATIONS = 1 / 80_000, 5
# Minima of a text at most, where bands of one minimum do not need more.
MINIMA = 160
SMALL_BAND = 8
# Shingles that are hashed at a time.
BLOCK = 1 << 15


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows: the longest bands that miss a pair at ``percent`` no more often than ``MISS``."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    found = None
    for rows in range(1, MINIMA + 1):
        alike = (percent / 100) ** rows
        bands = math.ceil(math.log(MISS) / math.log1p(-alike)) if alike < 1 else 1
        if found is not None and bands * rows > MINIMA:
            break
        found = bands, rows
    return found


def margin(percent: int, minima: int) -> int:
    """Points that the agreement of the minima of a pair at ``percent`` stays below it at most."""
    t = percent / 100
    return math.ceil(100 * DEVIATIONS * math.sqrt(t * (1 - t) / minima))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return values[:n] | np.uint64(1), values[n:]


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of one text, sorted, as hashes."""
    if not len(words):
        return words
    n = max(len(words) - width + 1, 1)
    size = min(width, len(words))
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(h)


def _set_keys(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums over the shingles, which name a set together with its size; zero for an empty one."""
    return mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """One row of ``count`` minima (32 bits each) for each non-empty set."""
    a, b = _coefficients(count)
    out = np.full((count, len(sets)), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < len(sets):
        upto, size = at, 0
        while upto < len(sets) and (upto == at or size + len(sets[upto]) <= BLOCK):
            size += len(sets[upto])
            upto += 1
        whole = np.concatenate(sets[at:upto])
        for lo in range(0, len(whole), BLOCK):  # more than one turn only for a single large set
            x = whole[lo : lo + BLOCK]
            starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : upto - 1]]))).astype(int) if upto - at > 1 else [0]
            for k in range(count):
                least = np.minimum.reduceat(x * a[k] + b[k], starts)
                out[k, at:upto] = np.minimum(out[k, at:upto], least)
        at = upto
    return (out.T >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::rows].astype(np.uint64) + np.arange(bands, dtype=np.uint64))
    return keys.view(np.int64)


def _sketch(width: int, in_bands: int, in_rows: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
        ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int32())),
    ])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("doc_id")
            for first, words in batches(part.column("text").to_pylist()):
                sets = [shingle_set(w, width) for w in words]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                k1, k2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                bands, sig = [None] * len(sets), [None] * len(sets)
                if len(full):
                    filled = [sets[k] for k in full]
                    k1[full], k2[full] = zip(*map(_set_keys, filled), strict=True)
                    found = signatures(filled, in_bands * in_rows)
                    keys = band_keys(found, in_bands, in_rows)
                    for k, row_keys, row in zip(full, keys, found.view(np.int32), strict=True):
                        bands[k], sig[k] = row_keys, row
                yield pa.record_batch(
                    [ids.slice(first, len(sets)), pa.array(sizes), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int32()))],
                    schema=schema,
                )

    return run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>, sig array<int>"


def _full_sets(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("doc_id")
            for first, words in batches(part.column("text").to_pylist()):
                sets = [shingle_set(w, width) for w in words]
                k1, k2 = zip(*map(_set_keys, sets), strict=True)
                gs = [s.view(np.int64) for s in sets]
                yield pa.record_batch(
                    [ids.slice(first, len(gs)), pa.array(np.array(k1, np.uint64).view(np.int64)),
                     pa.array(np.array(k2, np.uint64).view(np.int64)), pa.array(gs, pa.list_(pa.int64()))],
                    names=["doc_id", "k1", "k2", "gs"],
                )

    return run, "doc_id bigint, k1 bigint, k2 bigint, gs array<bigint>"


def _fits(a: str, b: str, percent: int) -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


class NearGroups:
    """The search for links between classes of equal sets."""

    def __init__(self, docs: DataFrame, percent: int = 80, width: int = 5) -> None:
        self.percent, self.width = percent, width
        in_bands, in_rows = banding(percent)
        self.minima = in_bands * in_rows
        self.docs = docs.select("doc_id", "text")
        self.sketches = keep(self.docs.mapInArrow(*_sketch(width, in_bands, in_rows)))
        named = self.sketches.filter("n > 0 and doc_id is not null")
        self.repeats = self._repeats(named)
        self.classes = self._classes(named)
        self.cells = self._cells(named)
        reps = self.cells.select("rep").distinct()
        # signatures and sets only of classes that share a band: no other is ever compared
        owners = keep(self.classes.join(reps, "rep", "left_semi").select(F.col("first").alias("doc_id"), "k1", "k2", "rep"))
        buckets = owners.select(bucket("doc_id").alias("bucket"))
        close = in_buckets_of(named.select("doc_id", "k1", "k2", "sig"), ["doc_id"], buckets)
        self.sigs = keep(self._once(close.join(owners, ["doc_id", "k1", "k2"]).select("rep", "sig")))
        close = in_buckets_of(self.docs, ["doc_id"], buckets).mapInArrow(*_full_sets(width))
        self.sets = keep(self._once(close.join(owners, ["doc_id", "k1", "k2"]).select("rep", "gs")))
        self.tested: DataFrame | None = None
        self.linked: DataFrame | None = None

    @staticmethod
    def _repeats(named: DataFrame) -> bool:
        return not named.groupBy("doc_id").count().filter("count > 1").isEmpty()

    def _once(self, by_rep: DataFrame) -> DataFrame:
        return by_rep.dropDuplicates(["rep"]) if self.repeats else by_rep

    def _classes(self, named: DataFrame) -> DataFrame:
        """``k1, k2, n, first, copies, rep``: each set with its smallest id, and the number it goes by.

        That is the smallest id as well, but where texts of one id would share it: a hash of the set then.
        """
        found = named.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
        if not self.repeats:
            return keep(found.withColumn("rep", F.col("first")))
        found = keep(found)
        several = found.groupBy("first").agg((F.count("*") > 1).alias("several"))
        rep = F.when(F.col("several"), F.xxhash64("k1", "k2", "n")).otherwise(F.col("first"))
        return keep(spread_join(found, several, ["first"], by="k1").withColumn("rep", rep).drop("several"))

    def _same_id(self) -> DataFrame:
        """``a, b``: classes that hold texts of one id, each linked with one of them."""
        named = self.sketches.filter("n > 0 and doc_id is not null").select("doc_id", "k1", "k2", "n")
        again = named.groupBy("doc_id").count().filter("count > 1").select("doc_id")
        named = keep(named.join(again, "doc_id", "left_semi"))
        reps = keep(spread_join(named, self.classes.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"], by="doc_id").select("doc_id", "rep"))
        least = reps.groupBy("doc_id").agg(F.min("rep").alias("b"))
        return spread_join(reps, least, ["doc_id"], by="rep").select(F.col("rep").alias("a"), "b")

    def _cells(self, named: DataFrame) -> DataFrame:
        """``band, rep, n, copies, size``: classes that share a band with another one."""
        reps = named.join(
            self.classes.select(F.col("first").alias("doc_id"), "k1", "k2", "rep", "copies"), ["doc_id", "k1", "k2"]
        )
        cells = keep(reps.select(F.explode("bands").alias("band"), "rep", "n", "copies").distinct())
        sizes = keep(cells.groupBy("band").agg(F.count("*").alias("rows")).filter("rows > 1"))
        return keep(
            spread_join(cells, sizes, ["band"], by="rep", sizes=sizes).withColumnRenamed("rows", "size")
        )

    def small_pairs(self) -> DataFrame:
        """Every pair of the bands that have few classes."""
        few = self.cells.filter(F.col("size") <= SMALL_BAND)
        i = few.select("band", F.col("rep").alias("i"), F.col("n").alias("ni"))
        j = few.select("band", F.col("rep").alias("j"), F.col("n").alias("nj"))
        return i.join(j, "band").filter("i < j").filter(_fits("ni", "nj", self.percent)).select("i", "j")

    def open_cells(self) -> DataFrame:
        """Rows of the large bands whose classes are not all linked, with ``label``, the component so far."""
        large = self.cells.filter(F.col("size") > SMALL_BAND)
        if self.linked is None:
            now = large.withColumn("label", F.col("rep"))
        else:
            labels = self.linked.select(F.col("node").alias("rep"), F.col("component").alias("label"))
            now = large.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        now = keep(now)
        apart = now.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("rows"))
        apart = keep(apart.filter("x <> y").select("band", "rows"))
        return keep(spread_join(now, apart, ["band"], by="rep", sizes=apart).drop("rows"))

    def pivot_pairs(self, cells: DataFrame) -> DataFrame:
        """Each class of a large band with the class of it that has the most copies."""
        order = F.struct(-F.col("copies"), "rep")
        pivots = cells.groupBy("band").agg(F.min_by(F.struct("rep", "n", "label"), order).alias("p"))
        pivots = keep(pivots.select("band", F.col("p.rep").alias("p"), F.col("p.n").alias("np"), F.col("p.label").alias("lp")))
        met = spread_join(cells, pivots, ["band"], by="rep").filter("label <> lp").filter(_fits("n", "np", self.percent))
        return met.select(F.least("rep", "p").alias("i"), F.greatest("rep", "p").alias("j"))

    def deltas(self, cells: DataFrame) -> DataFrame:
        """``cluster, rep, n, label, p, gd``: each class with what it and the pivot of its cluster do not share.

        A cluster is what bands hold together; its pivot is the class with the most copies. For any
        pivot, two sets differ in exactly those shingles in which their differences to it differ.
        """
        centre = F.min_by("rep", F.struct(-F.col("copies"), "rep"))
        pivots = keep(cells.groupBy("band").agg(centre.alias("b")))
        edges = spread_join(cells.select("band", F.col("rep").alias("a")), pivots, ["band"], by="a").select("a", "b")
        clusters = components(edges.distinct()).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
        nodes = keep(cells.select("rep", "n", "copies", "label").distinct().join(clusters, "rep"))
        pivots = nodes.groupBy("cluster").agg(centre.alias("p"))
        pivots = keep(pivots.join(self.sets.select(F.col("rep").alias("p"), F.col("gs").alias("gp")), "p"))
        placed = spread_join(nodes.join(self.sets, "rep"), pivots, ["cluster"], by="rep", at_most=stored_rows(nodes))
        differ = F.concat(F.array_except("gs", "gp"), F.array_except("gp", "gs"))
        return placed.select("cluster", "rep", "n", "label", "p", differ.alias("gd"), F.size("gp").alias("np"))

    def apart_pairs(self, cells: DataFrame) -> DataFrame:
        """Pairs of classes in different components that could be linked, by an exact prefix filter.

        Sets of similarity t differ in at most (1 - t) / (1 + t) of the sum of their sizes. Counted by their
        differences to a pivot, ``d`` and ``d'`` shingles, they must share ``need`` of these, which is nothing
        only where both are linked to the pivot. So classes near the pivot are paired with it, and the
        others through the rarest shingles of their differences. Near copies that differ from a common text
        in places of their own share few of them and drop out, however many there are.
        """
        most, least = 100 + self.percent, 100 - self.percent
        found = keep(self.deltas(cells).withColumn("d", F.size("gd")).withColumn("q", F.expr(f"{most} * d - {least} * n")))
        near = found.filter(f"rep <> p and {most} * d <= {least} * (n + np)")
        near = near.select(F.least("rep", "p").alias("i"), F.greatest("rep", "p").alias("j"))

        items = found.select("cluster", "rep", "n", "label", "d", "q", F.explode("gd").alias("g"))
        shared = items.groupBy("cluster", "g").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("rows"))
        shared = keep(shared.filter("x <> y").select("cluster", "g", "rows"))
        lowest = keep(found.groupBy("cluster").agg(F.min("q").alias("q0")))
        in_doc = Window.partitionBy("rep")
        heads = keep(
            spread_join(items, shared, ["cluster", "g"], by="rep", sizes=shared)
            .withColumn("s", F.count("*").over(in_doc))
            .withColumn("rk", F.col("d") - F.col("s") + F.row_number().over(in_doc.orderBy("rows", "g")))
            .join(lowest, "cluster")
            # as the one farther from the pivot of a pair, and as the nearer one
            .withColumn("far", F.expr(f"rk <= d - greatest(1, ceil((q + q0) / {2 * most})) + 1"))
            .withColumn("nigh", F.expr(f"rk <= d - greatest(1, ceil(q / {most})) + 1"))
            .filter("far or nigh")
            .select("cluster", "g", "rep", "n", "s", "q", "label", "far", "nigh")
        )
        side = lambda k: heads.select("cluster", "g", *[F.col(c).alias(c + k) for c in ("rep", "n", "s", "q", "label", "far", "nigh")])
        could = (
            (F.struct("qi", "repi") > F.struct("qj", "repj")) & (F.col("labeli") != F.col("labelj"))
            & _fits("ni", "nj", self.percent) & F.expr(f"qi + qj <= {2 * most} * least(si, sj)")
        )
        far, nigh = side("i").filter("fari"), side("j").filter("nighj")
        met = spread_join(far, nigh, ["cluster", "g"], by="repi", on=could, at_most=stored_rows(heads))
        return near.unionByName(met.select(F.least("repi", "repj").alias("i"), F.greatest("repi", "repj").alias("j")))

    def test(self, pairs: DataFrame) -> None:
        """Compare the pairs not compared before; add links and join components."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["i", "j"], "left_anti")
        pairs = keep(pairs)
        if not stored_rows(pairs):
            return
        sig_i = self.sigs.select(F.col("rep").alias("i"), F.col("sig").alias("si"))
        sig_j = self.sigs.select(F.col("rep").alias("j"), F.col("sig").alias("sj"))
        agree = F.aggregate(F.zip_with("si", "sj", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        alike = keep(
            self._with(self._with(pairs, sig_i, "i", "j"), sig_j, "j", "i")
            .filter(100 * agree >= (self.percent - margin(self.percent, self.minima)) * self.minima)
            .select("i", "j")
        )
        set_i = self.sets.select(F.col("rep").alias("i"), F.col("gs").alias("gi"))
        set_j = self.sets.select(F.col("rep").alias("j"), F.col("gs").alias("gj"))
        found = keep(
            self._with(self._with(alike, set_i, "i", "j"), set_j, "j", "i")
            .select("i", "j", F.size("gi").alias("ni"), F.size("gj").alias("nj"), F.size(F.array_intersect("gi", "gj")).alias("o"))
            .filter(F.expr(f"100 * cast(o as bigint) >= {self.percent} * cast(ni + nj - o as bigint)"))
            .select(F.col("i").alias("a"), F.col("j").alias("b"))
        )
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        links = found if self.linked is None else found.unionByName(
            self.linked.select(F.col("node").alias("a"), F.col("component").alias("b"))
        )
        self.linked = keep(components(links))

    @staticmethod
    def _with(pairs: DataFrame, what: DataFrame, side: str, other: str) -> DataFrame:
        return spread_join(pairs, what, [side], by=other, at_most=stored_rows(pairs))

    def run(self) -> DataFrame:
        """``doc_id, n_shingles, component_id`` for every row."""
        if stored_rows(self.cells):
            self.test(self.small_pairs().unionByName(self.pivot_pairs(self.open_cells())))
            cells = self.open_cells()
            if stored_rows(cells):
                self.test(self.apart_pairs(cells))
        keys = self.sketches.select("doc_id", "n", "k1", "k2")
        classes = self.classes
        if self.repeats:
            links = self._same_id()
            if self.linked is not None:
                links = links.unionByName(self.linked.select(F.col("node").alias("a"), F.col("component").alias("b")))
            self.linked = keep(components(links))
        if self.linked is not None:
            classes = classes.join(self.linked.withColumnRenamed("node", "rep"), "rep", "left")
            classes = keep(classes.withColumn("rep", F.coalesce("component", "rep")).drop("component"))
        if self.repeats:  # a number need not be an id here
            least = classes.groupBy("rep").agg(F.min("first").alias("least"))
            classes = keep(spread_join(classes, least, ["rep"], by="k1").drop("rep").withColumnRenamed("least", "rep"))
        full = keep(keys.filter("n > 0 and doc_id is not null"))
        placed = spread_join(full, classes.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"], by="doc_id").select(
            "doc_id", "n", F.col("rep").alias("component_id")
        )
        alone = keys.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        return placed.unionByName(alone).withColumnRenamed("n", "n_shingles")


def near_groups(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    found = NearGroups(docs, percent, width).run()
    alone = F.col("doc_id").isNull()
    return found.withColumn("kept", alone | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_dedup(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near copies, all columns as they were."""
    gone = near_groups(docs, percent, width).filter("not kept").select("doc_id").distinct()
    return without(docs, F.col("doc_id"), keep(gone))
