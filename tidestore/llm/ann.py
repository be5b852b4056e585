"""Approximate nearest neighbours: a forest of hash prefixes.

Every tree gives a vector a hash string of 32 signs of random projections, another set for each tree; a tree
is the sorted array of its strings. It is cut by their first signs into parts of bounded size, so that a
part is one task, and a part that many vectors share is dealt over several tasks.

1. Distinct vectors are packed into blocks, which is the only place where they are stored. The trees hold
   strings and the entries' places in blocks.
2. A query descends every tree in the part that its string leads to, and counts how many entries share
   each number of leading signs with it. Its counts of all trees are added, and the trees ascend together, one sign at a
   time, until they hold ``candidates`` matches. A query that would have to ascend above its parts visits the
   parts beside them, ever more until it has enough.
3. The matches that the ascent has reached go to their blocks, each block's matches of all trees are united,
   and a query's vector goes only to blocks where it has matches. There they are ranked by their exact
   cosine; the best of the blocks' answers win.

Equal vectors are one entry of the index with their smallest ids, as many as an answer can need, so that
large groups of copies neither crowd a part nor hide each other.

Vectors that are null or zero, or that hold nulls or non-finite components, take no part, nor do rows without
an id. Vectors of different sizes have no cosine: each size is a forest of its own. An id that occurs twice is
asked with each of its distinct vectors and gets one ranking, by the best score of any of them. Without any
vector the result is empty. Extra columns are ignored.

Unrelated directions in 64 dimensions are nearly alike far: 51 000 of them need a fifth of all as candidates
for a recall of 0.93 (a test measures it), and more of them need more; data with structure need far fewer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidestore.llm._frames import mapped, written

SIGNS = 32


@dataclass(frozen=True)
class ForestParams:
    k: int = 5
    trees: int = 184
    candidates: int = 10_000  # matches of all trees together (a vector counts once a tree) at which the ascent ends
    block_rows: int = 8192  # vectors in a block, 65536 at most
    part_rows: int = 262_144  # entries of a tree in one task
    query_rows: int = 1024  # queries whose counts one task adds up
    seed: int = 11


def hash_strings(vectors: np.ndarray, params: ForestParams) -> np.ndarray:
    """Hash strings by tree and vector, the first sign in the highest bit."""
    rng = np.random.default_rng((params.seed, vectors.shape[1]))
    out = np.empty((params.trees, len(vectors)), np.uint32)
    for t in range(params.trees):
        signs = np.packbits(vectors @ rng.standard_normal((vectors.shape[1], SIGNS)) > 0, axis=1)
        out[t] = signs.view(">u4").ravel()
    return out


def ranges(keys: np.ndarray, asked: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The part of the sorted ``keys`` that shares its first ``depth`` signs with each query."""
    spare = np.uint64(SIGNS) - np.asarray(depth, np.uint64)
    first = (asked.astype(np.uint64) >> spare) << spare
    last = first + (np.uint64(1) << spare) - np.uint64(1)
    return np.searchsorted(keys, first.astype(np.uint32), "left"), np.searchsorted(keys, last.astype(np.uint32), "right")


def counts_by_depth(keys: np.ndarray, asked: np.ndarray, least: int) -> np.ndarray:
    """How many of the sorted ``keys`` share at least each number of signs, from ``least`` on, with each query."""
    out = np.empty((len(asked), SIGNS + 1 - least), np.int64)
    for depth in range(least, SIGNS + 1):
        a, b = ranges(keys, asked, depth)
        out[:, depth - least] = b - a
    return out


def cosine(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, with one order of summation for every row."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    fine = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return fine.where(~odd & F.exists("v", lambda x: x != 0))


def _by_size(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch by the size of their vectors, with the vectors."""
    lists = batch.column(batch.schema.get_field_index(column))
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    for n in np.unique(size):
        rows = batch if (size == n).all() else batch.filter(pa.array(size == n))
        yield rows, _matrix(rows.column(rows.schema.get_field_index(column)), rows.num_rows)


_BLOCKS = "block long, size int, vectors binary, ids binary, many binary"


def pack_blocks(entries: DataFrame, params: ForestParams) -> DataFrame:
    """One row a block of at most ``block_rows`` entries (v, ids) of one size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        done = 0

        def leave(n: int) -> pa.RecordBatch:
            nonlocal done
            block = (TaskContext.get().partitionId() << 20) | done
            done += 1
            vectors, ids = np.concatenate([x[0] for x in held[n]]), [i for x in held.pop(n) for i in x[1]]
            flat = np.array([i for own in ids for i in own], np.int64)
            many = np.array([len(own) for own in ids], np.int32)
            return pa.record_batch([pa.array([block], pa.int64()), pa.array([n], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (vectors, flat, many))], [f.split()[0] for f in _BLOCKS.split(", ")])

        for batch in batches:
            for rows, vectors in _by_size(batch, "v"):
                n, ids = vectors.shape[1], rows.column(1).to_pylist()
                for a in range(0, len(vectors), params.block_rows):
                    part = slice(a, a + params.block_rows)
                    if sum(len(x[0]) for x in held.get(n, [])) + len(vectors[part]) > params.block_rows:
                        yield leave(n)
                    held.setdefault(n, []).append((vectors[part], ids[part]))
        for n in sorted(held):
            yield leave(n)

    return mapped(entries.select("v", "ids"), run, _BLOCKS)


_STRINGS = "size int, tree int, part int, keys binary, of binary"


def _records(size: int, strings: np.ndarray, of: np.ndarray, bits: int) -> pa.RecordBatch:
    """Strings by tree and first ``bits`` signs, sorted, with the numbers they belong to."""
    rows: list[tuple] = []
    for tree, keys in enumerate(strings):
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], of[order]
        part = keys >> np.uint32(SIGNS - bits) if bits else np.zeros(len(keys), np.uint32)
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        rows += [(size, tree, int(part[x]), keys[x:y].tobytes(), own[x:y].tobytes()) for x, y in zip(at, np.append(at[1:], len(keys)), strict=True)]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _STRINGS.split(", ")])


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _add_counts(level: int, params: ForestParams):
    def add(group: pa.Table) -> pa.Table:
        """The deepest number of signs at which all trees together have enough; -1 if they don't at ``level``."""
        many = _joined(group.column("many"), np.int64)
        q, of = np.unique(_joined(group.column("q"), np.int64), return_inverse=True)
        total = np.zeros((len(q), SIGNS + 1 - level), np.int64)
        np.add.at(total, of, many.reshape(len(of), -1))
        depth = (total >= params.candidates).sum(axis=1) - 1 + level  # counts fall with depth
        return pa.table([pa.array(q), pa.array(np.where(depth < level, -1 if level else 0, depth).astype(np.int32))], ["_q", "_depth"])

    return add


class Forest:
    """The trees of the blocks' entries, and the rounds of asking them."""

    def __init__(self, blocks: DataFrame, rows: int, params: ForestParams) -> None:
        self.params, self.bits = params, max(0, math.ceil(math.log2(max(1, rows / params.part_rows))))
        bits = self.bits

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, size, vectors in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    x = np.frombuffer(vectors, np.float64).reshape(-1, size)
                    yield _records(size, hash_strings(x, params), (block << 16) + np.arange(len(x)), bits)

        entries = written(mapped(blocks.select("block", "size", "vectors"), strings, _STRINGS))
        # a part with far more entries than planned is dealt over several tasks; counts and matches of tasks just add up
        sizes = entries.groupBy("size", "tree", "part").agg(F.sum(F.octet_length("keys")).alias("n")).where(F.col("n") > 8 * params.part_rows)
        self.shares = written(sizes.select("size", "tree", "part", F.ceil(F.col("n") / (4 * params.part_rows)).cast("int").alias("shares")))
        self.dealt = self.shares.limit(1).count() > 0
        shares = F.coalesce("shares", F.lit(1))
        self.entries = (self._with_shares(entries) if self.dealt else entries.withColumn("shares", F.lit(1))).withColumn("share", F.pmod(F.xxhash64("of"), shares).cast("int")).drop("shares")

    def _with_shares(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.shares, ["size", "tree", "part"], "left")

    def sent(self, asked: DataFrame) -> DataFrame:
        """Queries (q, v, level, depth) as records of their strings, for each part that shares their first ``level`` signs."""
        params, bits = self.params, self.bits

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [*(f.split()[0] for f in _STRINGS.split(", ")), "level", "depths"]
            for batch in batches:
                for rows, x in _by_size(batch, "v"):
                    q, level, depth = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("q", "level", "depth"))
                    own = hash_strings(x, params)
                    for n in np.unique(level):
                        of = np.flatnonzero(level == n)
                        got = _records(x.shape[1], own[:, of], of.astype(np.int64), bits)
                        at = [np.frombuffer(b, np.int64) for b in got.column(4).to_pylist()]
                        columns = [*got.columns[:4], pa.array([q[i].tobytes() for i in at], pa.binary()), pa.array([int(n)] * len(at), pa.int32()), pa.array([depth[i].astype(np.int32).tobytes() for i in at], pa.binary())]
                        yield pa.record_batch(columns, names)

        sent = mapped(asked.select("q", "v", "level", "depth"), strings, f"{_STRINGS}, level int, depths binary")
        if bits:
            beside = F.expr(f"shiftleft(1, {bits} - level)")
            first = F.col("part") - F.pmod(F.col("part"), beside)
            sent = sent.withColumn("part", F.explode(F.sequence(first, first + beside - 1)))
        sent = self._with_shares(sent) if self.dealt else sent.withColumn("shares", F.lit(1))
        return sent.withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")

    def _meet(self, asked: DataFrame, answer, schema: str) -> DataFrame:
        """``answer(size, keys, entries, queries' keys, q, levels, depths)`` for each task's share of a part of a tree."""

        def run(own: pa.Table, sent: pa.Table) -> pa.Table:
            empty = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")])
            if not own.num_rows or not sent.num_rows:
                return empty.empty_table()
            keys, of = _joined(own.column("keys"), np.uint32), _joined(own.column("of"), np.int64)
            order = np.argsort(keys, kind="stable")
            asked_keys, q, depth = _joined(sent.column("keys"), np.uint32), _joined(sent.column("of"), np.int64), _joined(sent.column("depths"), np.int32)
            level = np.repeat(sent.column("level").to_numpy(), [len(x) // 4 for x in sent.column("keys").to_pylist()])
            rows = answer(keys[order], of[order], asked_keys, q, level, depth)
            return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(empty)], schema=empty)

        by = ("size", "tree", "part", "share")
        return self.entries.groupBy(*by).cogroup(self.sent(asked).groupBy(*by)).applyInArrow(run, schema)

    def depths(self, asked: DataFrame, queries: int) -> DataFrame:
        """q, v, level, depth: how many leading signs the ascent of each query (q, v) has left at its end."""
        params = self.params
        groups = max(1, math.ceil(queries / params.query_rows))
        found, level = None, self.bits
        open_ = asked.withColumn("level", F.lit(level)).withColumn("depth", F.lit(0))
        while True:

            def count(keys, of, own, q, levels, depth, level=level) -> list[tuple]:  # noqa: ANN001
                many = counts_by_depth(keys, own, level)
                group = q.astype(np.uint64) % np.uint64(groups)
                return [(int(g), q[group == g].tobytes(), many[group == g].tobytes()) for g in np.unique(group)]

            sums = self._meet(open_, count, "group int, q binary, many binary").groupBy("group").applyInArrow(_add_counts(level, params), "_q long, _depth int")
            here = written(open_.join(sums, open_["q"] == sums["_q"], "left").select("q", "v", "level", F.coalesce("_depth", F.lit(-1 if level else 0)).alias("depth")))
            done = here.where("depth >= 0")
            found = done if found is None else found.unionByName(done)
            if not level or here.where("depth < 0").limit(1).count() == 0:
                return found
            level = max(0, level - 4)
            open_ = here.where("depth < 0").select("q", "v").withColumn("level", F.lit(level)).withColumn("depth", F.lit(0))

    def matches(self, asked: DataFrame) -> DataFrame:
        """block, q, slots (distinct, 16-bit): what the ascent of each query (q, v, level, depth) has reached, by block."""

        def reached(keys, of, own, q, levels, depth) -> list[tuple]:  # noqa: ANN001
            a, b = ranges(keys, own, depth)
            size = b - a
            at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            entry, who = of[at], np.repeat(q, size)
            order = np.argsort(entry >> 16, kind="stable")
            entry, who = entry[order], who[order]
            block = entry >> 16
            x = np.flatnonzero(np.concatenate((np.ones(min(1, len(block)), bool), block[1:] != block[:-1])))
            return [(int(block[i]), who[i:j].tobytes(), (entry[i:j] & 0xFFFF).astype(np.uint16).tobytes()) for i, j in zip(x, [*x[1:], len(block)], strict=False)]

        def unite(group: pa.Table) -> pa.Table:
            q, of = np.unique(_joined(group.column("q"), np.int64), return_inverse=True)
            both = np.unique((of << 16) | _joined(group.column("slots"), np.uint16))
            at = np.searchsorted(both >> 16, np.arange(len(q) + 1))
            slots = (both & 0xFFFF).astype(np.uint16)
            return pa.table([pa.array([group.column("block")[0].as_py()] * len(q), pa.int64()), pa.array(q), pa.array([slots[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["block", "q", "slots"])

        got = self._meet(asked, reached, "block long, q binary, slots binary")
        return got.groupBy("block").applyInArrow(unite, "block long, q long, slots binary")


def nearest(index: DataFrame, queries: DataFrame, params: ForestParams = ForestParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``index`` other than the query's own id.

    Both sides have columns id and v, as ``usable_vectors`` gives them.
    """
    spare = params.k + 1
    least = Window.partitionBy("v").orderBy("id")
    ranked = index.distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= spare)
    entries = written(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = written(queries.distinct().select(F.col("id").alias("query_id"), "v", F.xxhash64("id", "v").alias("q")))
    many, rows = asked.count(), entries.count()
    blocks = written(pack_blocks(entries, params))
    forest = Forest(blocks, rows, params)
    deep = written(forest.depths(asked.select("q", "v"), many))
    requests = written(forest.matches(deep).join(asked, "q"))
    # a block that more queries ask than one task should hold is copied to several
    copies = max(1, math.ceil(many * min(1.0, params.candidates * params.block_rows / max(1, rows)) / 262_144))
    right = requests.withColumn("copy", F.pmod("q", F.lit(copies)).cast("int"))
    left = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def answer(block: pa.Table, wanted: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "score": [], "ids": []}
        if block.num_rows and wanted.num_rows:
            vectors = np.frombuffer(block.column("vectors")[0].as_py(), np.float64).reshape(-1, block.column("size")[0].as_py())
            ids, count = (np.frombuffer(block.column(c)[0].as_py(), t) for c, t in (("ids", np.int64), ("many", np.int32)))
            first = np.cumsum(count) - count
            lowest = ids[first]
            unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
            for query_id, q, slots in zip(wanted.column("query_id").to_pylist(), _matrix(wanted.column("v"), wanted.num_rows), wanted.column("slots").to_pylist(), strict=True):
                met = np.frombuffer(slots, np.uint16).astype(np.int64)
                rough = unit[met] @ (q / np.sqrt((q * q).sum()))
                if len(met) > 4 * spare:
                    met = met[rough >= np.partition(rough, -spare)[-spare] - 1e-9]
                score = cosine(vectors[met], q)
                for i in np.lexsort((lowest[met], -score))[:spare]:
                    out["query_id"].append(query_id)
                    out["score"].append(float(score[i]))
                    out["ids"].append(ids[first[met[i]] : first[met[i]] + count[met[i]]].tolist())
        return pa.table(out, pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))]))

    answers = left.groupBy("block", "copy").cogroup(right.groupBy("block", "copy")).applyInArrow(answer, "query_id long, score double, ids array<long>")
    found = answers.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id != vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")


def ann_report(embeddings: DataFrame) -> DataFrame:
    vectors = usable_vectors(embeddings)
    return nearest(vectors, vectors.where("id % 50 = 0"))
