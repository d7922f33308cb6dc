"""Lines that many documents share leave all of them but one.

A text is cut at line feeds; a null or empty text has one empty line. The key of a line is the line
without white space (space, tab, line feed, vertical tab, form feed, carriage return) at both ends and
with A-Z lower-cased. A key of at least ``least_chars`` code points that at least ``least_docs``
documents hold loses its lines everywhere but in the document of the largest id among these.

1. Every document gives the 128-bit digests of its distinct long keys; they are counted, with the
   largest id. Where an id is repeated its rows are one document: only their digests are made distinct
   before counting.
2. The digests counted often enough are dealt into shards of about ``SHARD_KEYS``. Each shard gets a
   minimal perfect hash that numbers its digests, and arrays by that number: half of the digest as a
   fingerprint, the count, and the largest id.
3. Documents probe the arrays where they lie, and no line or text is shuffled, as long as there are no
   more than ``broadcast_keys`` digests (some 25 bytes each): that is the bound of what is broadcast.
   Beyond it the digests of a document's lines, not the lines, are sent to the shards; only what is to be
   dropped comes back to the document. Both ways give the same result.

A line that is no shared one is taken for one if a digest or fingerprint agrees by chance, which has a
probability of 2**-64 for each line and digest in the same place.

Defined results: rows of a null id are one document with an id below all others. Rows that repeat an id
are each cleaned, all lines of a document that keeps a key stay, and a text whose lines all go is empty.
A null text stays null in ``line_dedup`` and counts as empty for the numbers. An empty table gives an
empty result. Only ``doc_id`` and ``text`` are looked at; other columns, whatever their names, pass
through ``line_dedup`` unchanged.
"""

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.llm.perfect import PerfectHash
from pressroom.llm.rows import bucket, row_key
from pressroom.plans.scratch import keep, stored_rows

SPACES = " \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 15
BROADCAST_KEYS = 1 << 20
# Digests that are sent to one copy of a shard, about.
PROBES = 1 << 20
# Rows that a task takes at a time.
ROWS = 256
NULL_ID = -(1 << 63)


def key_of(line: str, least_chars: int) -> bytes | None:
    """The digest of a line's key; None for a short one."""
    key = line.strip(SPACES)
    if len(key) < least_chars:
        return None
    return blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


def _words(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for first in range(0, part.num_rows, ROWS):
            yield part.slice(first, ROWS)


def _distinct_keys(least_chars: int) -> Callable:
    """The distinct digests of each row, as two words, after the row's other column."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            sets = [
                {key_of(line, least_chars) for line in (text or "").split("\n")} - {None}
                for text in part.column("text").to_pylist()
            ]
            first, second = _words([d for s in sets for d in s])
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
            yield pa.record_batch(
                [ids, pa.array(first.view(np.int64)), pa.array(second.view(np.int64))],
                names=[part.schema.names[0], "a", "b"],
            )

    return run


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id")


def shared_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``a, b, docs, last``: digests that at least ``least_docs`` documents hold, and the largest id of these."""
    named = docs.select(_id(), "text")
    several = keep(named.groupBy("id").count().filter("count > 1").select(bucket("id").alias("_bucket")).distinct())

    def keys(some: DataFrame) -> DataFrame:
        return some.mapInArrow(_distinct_keys(least_chars), "id bigint, a bigint, b bigint")

    if stored_rows(several):
        placed = named.withColumn("_bucket", bucket("id"))
        once = placed.join(F.broadcast(several), "_bucket", "left_anti").select("id", "text")
        repeated = placed.join(F.broadcast(several), "_bucket", "left_semi").select("id", "text")
        lines = keys(once).unionByName(keys(repeated).distinct())
    else:
        lines = keys(named)
    counted = lines.groupBy("a", "b").agg(F.count("*").alias("docs"), F.max("id").alias("last"))
    return counted.filter(F.col("docs") >= least_docs)


class Shard:
    """One shard's hash and arrays."""

    def __init__(self, row: dict) -> None:
        self.hash = PerfectHash.from_bytes(row["hash"])
        self.prints = np.frombuffer(row["prints"], np.uint64)
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.last = np.frombuffer(row["last"], np.int64)

    def probe(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and largest id of each digest; 0 and 0 for those that are not in the shard."""
        at = self.hash.numbers(first, second)
        found = (at >= 0) & (self.prints[at] == second) if len(self.prints) else np.zeros(len(at), bool)
        docs, last = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        docs[found], last[found] = self.docs[at[found]], self.last[at[found]]
        return docs, last


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    column = {c: table.column(c).to_numpy() for c in ("a", "b", "docs", "last")}
    first, second = (column[c].astype(np.int64).view(np.uint64) for c in ("a", "b"))
    hashed = PerfectHash.of(first, second)
    order = np.argsort(hashed.numbers(first, second))
    return pa.table({
        "shard": pa.array([int(table.column("shard")[0].as_py())], pa.int64()),
        "hash": [hashed.to_bytes()],
        "prints": [second[order].tobytes()],
        "docs": [column["docs"][order].tobytes()],
        "last": [column["last"][order].tobytes()],
    })


PACKED = "shard bigint, hash binary, prints binary, docs binary, last binary"


def line_index(shared: DataFrame, shards: int) -> DataFrame:
    """The arrays of each shard, one row for each that has digests; ``shard`` is ``pmod(a, shards)``."""
    dealt = shared.withColumn("shard", F.pmod("a", F.lit(shards).cast("bigint")))
    return dealt.groupBy("shard").applyInArrow(_pack, PACKED)


def _cleaned(part: pa.RecordBatch, least_chars: int, drops: Callable) -> pa.RecordBatch:
    """The batch with its texts cleaned. ``drops(row of each digest, digests)`` tells which of them go."""
    texts = part.column("text").to_pylist()
    lines = [(text or "").split("\n") for text in texts]
    where, digests = [], []
    for row, own in enumerate(lines):
        for place, line in enumerate(own):
            digest = key_of(line, least_chars)
            if digest is not None:
                where.append((row, place))
                digests.append(digest)
    gone: dict[int, set[int]] = {}
    for (row, place), drop in zip(where, drops([row for row, _ in where], digests), strict=True):
        if drop:
            gone.setdefault(row, set()).add(place)
    kept = [
        "\n".join(line for place, line in enumerate(own) if place not in gone[row]) if row in gone else texts[row]
        for row, own in enumerate(lines)
    ]
    return pa.record_batch(
        [part.column("doc"), pa.array([len(own) for own in lines], pa.int64()),
         pa.array([len(gone.get(row, ())) for row in range(len(lines))], pa.int64()), pa.array(kept, pa.string())],
        names=["doc", "n_lines", "n_dropped", "kept"],
    )


def _in_place(rows: DataFrame, packed: DataFrame, shards: int, least_chars: int, schema: T.StructType) -> DataFrame:
    """Clean documents with all arrays at hand."""
    arrays = rows.sparkSession.sparkContext.broadcast([r.asDict() for r in packed.toLocalIterator()])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {r["shard"]: Shard(r) for r in arrays.value}
        for part in _slices(parts):
            ids = part.column("id").to_numpy()

            def drops(row: list[int], digests: list[bytes]) -> np.ndarray:
                first, second = _words(digests)
                shard = np.mod(first.view(np.int64), shards)
                docs, last = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
                for s in np.unique(shard):
                    if s in index:
                        own = np.flatnonzero(shard == s)
                        docs[own], last[own] = index[s].probe(first[own], second[own])
                return (docs > 0) & (last != ids[row])

            yield _cleaned(part, least_chars, drops)

    return rows.mapInArrow(run, schema)


def _probed(key: tuple, lines: pa.Table, arrays: pa.Table) -> pa.Table:
    """``row, digest`` of the lines of one part of a shard that are to be dropped."""
    first, second = (lines.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("a", "b"))
    drop = np.zeros(len(first), bool)
    if arrays.num_rows:
        docs, last = Shard(arrays.slice(0, 1).to_pylist()[0]).probe(first, second)
        drop = (docs > 0) & (last != lines.column("id").to_numpy())
    both = np.stack([first[drop], second[drop]], 1)
    return pa.table({
        "row": lines.column("row").filter(pa.array(drop)),
        "digest": pa.array([d.tobytes() for d in both], pa.binary()),
    })


def _by_shard(rows: DataFrame, packed: DataFrame, shards: int, least_chars: int, schema: T.StructType) -> DataFrame:
    """Send the digests of the documents' lines to the shards and what is dropped back to the documents."""
    owner = F.struct("id", "row").alias("owner")
    lines = keep(
        rows.select(owner, "text")
        .mapInArrow(_distinct_keys(least_chars), "owner struct<id:bigint,row:string>, a bigint, b bigint")
        .select("owner.id", "owner.row", "a", "b", F.pmod("a", F.lit(shards).cast("bigint")).alias("shard"))
    )
    # A line that many documents hold makes its shard a large one: it is probed in several copies.
    sizes = lines.groupBy("shard").agg(F.ceil(F.count("*") / PROBES).alias("parts"))
    sizes = keep(sizes)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("copy")
    dealt = lines.join(F.broadcast(sizes), "shard").withColumn("copy", F.pmod(F.xxhash64("row"), "parts"))
    copies = packed.join(sizes, "shard").select("*", every).drop("parts")
    gone = (
        dealt.groupBy("shard", "copy")
        .cogroup(copies.groupBy("shard", "copy"))
        .applyInArrow(_probed, "row string, digest binary")
        .groupBy("row")
        .agg(F.collect_set("digest").alias("gone"))
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            sets = [set(g or ()) for g in part.column("gone").to_pylist()]
            yield _cleaned(part, least_chars, lambda row, digests, sets=sets: [d in sets[r] for r, d in zip(row, digests, strict=True)])

    return rows.join(gone, "row", "left").select("doc", "id", "text", "gone").mapInArrow(run, schema)


def clean_lines(
    docs: DataFrame, least_chars: int = 40, least_docs: int = 5, broadcast_keys: int = BROADCAST_KEYS, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """``doc, n_lines, n_dropped, kept`` for every row: its other columns as a struct, lines before and dropped, new text."""
    shared = keep(shared_lines(docs, least_chars, least_docs))
    shards = max(1, -(-stored_rows(shared) // shard_keys))
    packed = keep(line_index(shared, shards))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")
    rows = docs.select(others, _id(), "text", row_key().alias("row"))
    schema = T.StructType([rows.schema["doc"]]).add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    if stored_rows(shared) <= broadcast_keys:
        return _in_place(rows.drop("row"), packed, shards, least_chars, schema)
    return _by_shard(rows, packed, shards, least_chars, schema)


def line_dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``docs`` with the shared lines taken out of ``text``, all other columns as they were."""
    clean = clean_lines(docs, least_chars, least_docs)
    return clean.select(*[
        F.col("kept").alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns
    ])
