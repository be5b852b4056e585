"""MinHash near-duplicate groups.

1. Each text becomes its set of word shingles (64-bit hashes of lower-cased words). One pass computes
   the set's size, a 128-bit fingerprint and ``bands * rows`` universal-hash minima.
2. Equal sets are one class, represented by the smallest id; the rest works on representatives.
3. Bands of ``rows`` minima are bucketed. Round one ties every bucket's members to its least member
   (one pair a member); pairs whose signatures could reach the threshold are confirmed on full sets.
4. Round two looks only at buckets that still hold several components, and compares members of
   different components. A first pass compares signatures and names the members that have a possible partner;
   a second one has their full sets, confirms, and returns only links that tie components together,
   at most one less than the components there. Nothing is capped and no pairs are listed.
   A bucket is cut into blocks of a bounded number of members and shingles, and a task sees two blocks.
5. Buckets of more than ``crowd`` blocks aren't compared so, since the pairs of blocks grow with the square: their
   members are bucketed anew by twice as many minima, by as many keys as the same chance of a miss needs, and
   rounds one and two run on those keys. Texts that share a template meet by few minima, but not by many.
   Only what is still crowded at ``4 * rows`` minima is compared block by block whatever its size.
6. Full sets are recomputed for the documents concerned, so a link is exact up to 64-bit hash collisions
   inside two documents. Components come from alternating large-star and small-star rounds.

A pair at the threshold is missed with probability ``miss`` at most (see ``bands_for``). Skipping pairs
that already are in one component cannot change components.

Edge cases: null and empty texts, and texts without words, have the empty set and link with nothing;
a text with fewer words than a shingle has one shingle, the whole sequence. A very long text is a chunk of
its own. Rows without an id have
no place in a group and come out with null component and kept = true. A repeated id counts as one
document with the union of its rows' links; each of its rows is returned, and is kept with it. Extra
columns, of any name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestore.llm._frames import collect_garbage, lean, mapped, own_names, written
from tidestore.llm._text import chunks, mix, ngrams, words
from tidestore.llm.components import connected_components


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5
    percent: int = 80  # similarity, in hundredths, at which documents are linked
    rows: int = 5  # minima in a band
    miss: float = 1e-6  # chance that a pair at the threshold shares no band
    block: int = 512  # members of a bucket that one task compares with as many others
    block_shingles: int = 1 << 20  # and their shingles together
    crowd: int = 16  # blocks of a bucket above which its members are bucketed anew

    @property
    def bands(self) -> int:
        return bands_for(self.percent / 100, self.rows, self.miss)


def bands_for(similarity: float, rows: int, miss: float) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and their borders."""
    w = words(data, offs)
    n = len(offs) - 1
    h, d = ngrams(w.hash, w.doc, tuple(range(size)))
    first = w.first_of_doc(n)
    count = np.diff(first)
    if (short := np.flatnonzero((count > 0) & (count < size))).size:
        whole = [mix(np.array([_fold(w.hash[first[i] : first[i + 1]])], np.uint64))[0] for i in short]
        h, d = np.concatenate((h, np.array(whole, np.uint64))), np.concatenate((d, short))
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(n + 1))


def _fold(hashes: np.ndarray) -> int:
    out = len(hashes) * 0x51ED27
    for x in hashes.tolist():
        out = (out * 0x2545F4914F6CDD1D + x) & 0xFFFFFFFFFFFFFFFF
    return out


_SIGNED = "doc_id long, n_shingles long, set_hi long, set_lo long, signature binary"


def _signatures(docs: DataFrame, params: NearDupParams) -> DataFrame:
    k = params.bands * params.rows
    rng = np.random.default_rng(97)
    mul = rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, k, dtype=np.uint32)
    shingle, step = params.shingle, 2048

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch):
                sets, at = shingle_sets(data, offs, shingle)
                low = mix(sets)
                short = (low >> np.uint64(32)).astype(np.uint32)
                minima, fingerprint = [], np.zeros((b - a, 2), np.uint64)
                for i in range(b - a):
                    own = low[at[i] : at[i + 1]]
                    if not len(own):
                        minima.append(None)
                        continue
                    best = np.full(k, np.iinfo(np.uint32).max, np.uint32)
                    for j in range(at[i], at[i + 1], step):
                        hashed = np.multiply.outer(mul, short[j : min(j + step, at[i + 1])])
                        hashed += add[:, None]
                        np.minimum(best, hashed.min(axis=1), out=best)
                    minima.append(best.tobytes())
                    fingerprint[i] = mix(own).sum(), mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum()
                sides = [pa.array(fingerprint[:, j].view(np.int64)) for j in (0, 1)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), *sides, pa.array(minima, pa.binary())], ["doc_id", "n_shingles", "set_hi", "set_lo", "signature"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SIGNED)


def _band_keys(reps: DataFrame, params: NearDupParams) -> DataFrame:
    """id, n_shingles, band, key for every band of every representative."""
    width = params.rows * 4
    bands = F.transform(F.sequence(F.lit(0), F.lit(params.bands - 1)), lambda j: F.xxhash64(j, F.substring("signature", j * width + 1, F.lit(width))))
    return reps.select("id", "n_shingles", F.posexplode(bands).alias("band", "key"))


def _finer_keys(members: DataFrame, rows: int, params: NearDupParams) -> DataFrame:
    """id, n_shingles, band, key of ``rows`` minima each, drawn anew for each key, for signatures (id, n_shingles, signature)."""
    many, k = bands_for(params.percent / 100, rows, params.miss), params.bands * params.rows
    rng = np.random.default_rng(rows)
    drawn = np.array([rng.choice(k, min(rows, k), replace=False) for _ in range(many)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(part.num_rows, k).astype(np.uint64)
                key = np.zeros((part.num_rows, many), np.uint64)
                for j in range(drawn.shape[1]):
                    key = mix(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, drawn[:, j]] + np.uint64(1))
                own = [pa.array(np.repeat(part.column(i).to_numpy(), many)) for i in (0, 1)]
                yield pa.record_batch([*own, pa.array(np.tile(np.arange(many, dtype=np.int32), part.num_rows)), pa.array(key.ravel().view(np.int64))], ["id", "n_shingles", "band", "key"])

    return mapped(members.select("id", "n_shingles", "signature"), run, "id long, n_shingles long, band int, key long")


def _star_links(keys: DataFrame, reps: DataFrame, docs: DataFrame, params: NearDupParams) -> DataFrame:
    """Confirmed links of the members of every bucket with its least member."""
    least = keys.groupBy("band", "key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "key", "a")
    star = keys.join(least, ["band", "key"]).where("id > a").select("a", F.col("id").alias("b")).distinct()
    return written(_confirmed(written(_likely(star, reps, params)), docs, params))


def _likely(pairs: DataFrame, reps: DataFrame, params: NearDupParams) -> DataFrame:
    """The pairs (a, b) whose signatures agree in so many minima that the threshold is possible."""
    sig = reps.select("id", "signature", "n_shingles")
    two = pairs.join(sig.toDF("a", "sig_a", "n_a"), "a").join(sig.toDF("b", "sig_b", "n_b"), "b").where(_sizes_allow("n_a", "n_b", params))
    least = _least_agreement(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in (2, 3))
                yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return mapped(two.select("a", "b", "sig_a", "sig_b"), run, "a long, b long")


def _least_agreement(params: NearDupParams) -> int:
    """Minima that a pair at the threshold shares but for a chance of one in a million (five deviations)."""
    k, j = params.bands * params.rows, params.percent / 100
    return max(0, math.floor(k * j - 5 * math.sqrt(k * j * (1 - j))))


def _sizes_allow(a: str, b: str, params: NearDupParams):
    return F.least(a, b) * 100 >= F.greatest(a, b) * params.percent


def _full_sets(docs: DataFrame, needed: DataFrame, params: NearDupParams) -> DataFrame:
    """(id, shingles) of the documents in ``needed`` (id)."""
    shingle = params.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch):
                sets, at = shingle_sets(data, offs, shingle)
                own = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), own], ["id", "shingles"])

    needed = needed.distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    few = needed.count() <= 1_000_000  # ids of 8 bytes; beyond that Spark shuffles both sides
    return mapped(texts.join(F.broadcast(needed) if few else needed, "id", "left_semi"), run, "id long, shingles array<bigint>")


def _confirmed(pairs: DataFrame, docs: DataFrame, params: NearDupParams) -> DataFrame:
    """The pairs that reach the threshold on their full sets."""
    sets = _full_sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), params)
    both = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared * 100 >= (F.size("set_a") + F.size("set_b") - shared) * params.percent).select("a", "b").distinct()


_CELL = ["band", "key", "i", "j"]


def _mixed(keys: DataFrame, component: DataFrame, params: NearDupParams) -> DataFrame:
    """band, key, id, component, n_shingles, blocks: members of the buckets that hold several components."""
    named = keys.join(component, "id", "left").select("band", "key", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    of = named.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where("lo != hi")
    blocks = F.ceil(F.greatest(F.col("n") / params.block, F.col("s") / params.block_shingles)).cast("long")
    return named.join(of.select("band", "key", blocks.alias("blocks")), ["band", "key"])


def _across_components(members: DataFrame, reps: DataFrame, docs: DataFrame, params: NearDupParams, first: bool) -> DataFrame:
    """Links (a, b) between bucket mates (see ``_mixed``) in different components, enough to tie together all that are linked.

    ``first`` says that the buckets are those of the signatures' bands.
    """
    members = members.drop("n_shingles").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")))
    signed = members.join(reps.select("id", "signature", "n_shingles"), "id")
    spread = signed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = spread.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n_shingles", "signature")
    least, percent, bands, rows = _least_agreement(params), params.percent, params.bands, params.rows

    def possible(group: pa.Table) -> pa.Table:
        ids, comp, n, side = (group.column(c).to_numpy() for c in ("id", "component", "n_shingles", "block"))
        band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
        sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(len(ids), -1)
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        hit = np.zeros(len(ids), bool)
        for x in a:
            other = b[comp[b] != comp[x]]
            other = other[np.minimum(n[other], n[x]) * 100 >= np.maximum(n[other], n[x]) * percent]
            same = sig[other] == sig[x]
            fits = same.sum(axis=1) >= least
            if first:  # the first band in which two meet is the one that compares them
                fits &= ~same.reshape(len(other), bands, rows)[:, :band].all(axis=2).any(axis=1)
            hit[other[fits]] = True
            hit[x] |= fits.any()
        return group.select([*_CELL, "block", "id", "component"]).filter(pa.array(hit))

    flagged = written(cells.groupBy(*_CELL).applyInArrow(lean(possible), "band int, key long, i long, j long, block long, id long, component long"))

    def confirm(group: pa.Table) -> pa.Table:
        ids, comp, side = (group.column(c).to_numpy() for c in ("id", "component", "block"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sets = group.column("shingles").combine_chunks()
        codes = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
        size = np.array([len(x) for x in sets])
        at = np.concatenate(([0], np.cumsum(size)))
        tied = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while tied[c] != c:
                tied[c] = tied[tied[c]]
                c = tied[c]
            return c

        seen, found = np.zeros(int(codes.max()) + 1, bool), [[], []]
        for x in np.flatnonzero(side == i):
            seen[codes[at[x] : at[x + 1]]] = True
            shared = np.add.reduceat(seen[codes].astype(np.int64), at[:-1])
            seen[codes[at[x] : at[x + 1]]] = False
            for y in np.flatnonzero((side == j) & (comp != comp[x]) & (shared * 100 >= (size + size[x] - shared) * percent)):
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    tied[p] = q
                    found[0].append(min(ids[x], ids[y]))
                    found[1].append(max(ids[x], ids[y]))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    full = flagged.join(_full_sets(docs, flagged.select("id"), params), "id")
    return full.groupBy(*_CELL).applyInArrow(lean(confirm), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    signed = written(_signatures(docs, params))
    sets = signed.where("doc_id is not null and signature is not null")
    classes = written(sets.groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")))
    reps = classes.select("id", "n_shingles", "signature")

    keys, rows = written(_band_keys(reps, params)), params.rows
    collect_garbage(docs.sparkSession)
    copies = sets.select("doc_id", "set_hi", "set_lo", "n_shingles").join(classes.drop("signature"), ["set_hi", "set_lo", "n_shingles"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    found, links = None, None
    while True:
        stars = _star_links(keys, reps, docs, params)
        found = connected_components(stars if found is None else stars.unionByName(found).unionByName(links))
        found = found.select(F.col("component").alias("a"), F.col("id").alias("b"))
        members = _mixed(keys, found.select(F.col("b").alias("id"), F.col("a").alias("component")), params)
        last = rows >= 4 * params.rows
        members = written(members)
        links = written(_across_components(members if last else members.where(F.col("blocks") <= params.crowd), reps, docs, params, rows == params.rows))
        crowded = members.where(F.col("blocks") > params.crowd).select("id").distinct()
        if last or crowded.limit(1).count() == 0:
            break
        rows *= 2
        collect_garbage(docs.sparkSession)
        keys = written(_finer_keys(reps.join(crowded, "id", "left_semi"), rows, params))
    # copies are star links to their representative; a repeated id ties the classes of its rows together
    repeated = copies.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("z")).where("a != z").select("b").join(copies, "b").select("a", "b")
    component = connected_components(found.unionByName(links).unionByName(repeated))
    of_class = reps.select("id").join(component, "id", "left").select("id", F.coalesce("component", "id").alias("component_id"))
    of_doc = copies.join(of_class, copies["a"] == of_class["id"]).groupBy("b").agg(F.min("component_id").alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles")
        .join(of_doc.withColumnRenamed("b", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns."""
    name = own_names(docs) + "gone"
    gone = near_duplicates(docs, params).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def near_dup_report(docs: DataFrame) -> DataFrame:
    """Three-word shingles at a similarity of 0.85."""
    return near_duplicates(docs, NearDupParams(shingle=3, percent=85))
