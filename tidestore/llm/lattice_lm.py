"""Language-model scoring by a subword lattice.

The vocabulary is that of a public tokenizer file, its pieces with their scores; no tokenizer is trained. A
word is a piece that starts with a space, then more pieces, then a stop. Every way to segment a word
into pieces counts: its probability is the sum over all segmentations of the product of their pieces'
unigram probabilities, found by a forward recursion in log space. Single bytes are pieces too, so every
word has a probability. First pieces, and further pieces with the stop, each sum to 1, and so do words.
A text's probability is the product over its words and its end, where an end has the share that ends have
of all training tokens and words have the rest; the probabilities of all texts sum to 1.

The public file's scores are ranks, not probabilities; they are taken as 1 / (1 + rank) first and then fitted to the
training texts by expected counts (forward and backward recursion over all segmentations), where every
distinct word weighs as often as it occurs.

Flow: distinct words are counted by task before they are shuffled; expected counts come back as one sum
a piece. The words that all texts, held out or not, use most, ``frequent`` at most, travel in the task closure and
settle most tokens where they are read; the rest join the word table by word, and a word outside the
frequent ones is by that too rare to be a hot key.

Edge cases: null and empty texts consist of the end alone; very long texts are chunks of their own. A null id
is trained on and not held out. Rows with equal id and text come out as often as they went in. Without
training texts N is 0, the base gives every token probability 1, the pieces keep their first probabilities
and word and end share evenly. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestore.llm._frames import crc_of_id, mapped, written
from tidestore.llm._text import HashIndex, binary_column, chunks, mix, spans, words

LN10 = float(np.log(10.0))
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LatticeParams:
    rounds: int = 3  # of fitting
    smoothing: float = 0.1  # added to each piece's expected count
    frequent: int = 131_072  # words that are broadcast at most
    batch_words: int = 20_000
    merge_rows: int = 1_000_000  # distinct words that a counting task holds before it passes them on


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[bytes, ...]  # distinct; the last one, empty, is the stop
    weight: np.ndarray  # first probabilities

    def normalised(self, weight: np.ndarray) -> np.ndarray:
        """Probabilities: pieces that start a word sum to 1, and so do all others with the stop."""
        starts = np.array([p[:1] == b" " for p in self.pieces])
        return weight / np.where(starts, weight[starts].sum(), weight[~starts].sum())


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces that lower-cased text can use, with probabilities from the file's scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:] and not any(65 <= b <= 90 for b in piece):
            weight[piece] = weight.get(piece, 0.0) + 1.0 / (1.0 - model.get_score(i))
    least = min(w for w in weight.values() if w) / 10
    values = np.array([max(w, least) for w in weight.values()] + [0.0])
    values[-1] = values.sum() / 4  # a stop after a few pieces
    raw = Vocabulary((*weight, b""), values)
    return Vocabulary(raw.pieces, raw.normalised(values))


class Lattice:
    """Arcs of many words at once: every place and length at which a piece fits."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        pieces = vocabulary.pieces[:-1]
        self.longest = max(map(len, pieces))
        self.index = HashIndex(np.array([self._hash(p) for p in pieces], np.uint64))

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = np.zeros(1, np.uint64)
        for b in piece:
            h = h * _STEP + np.uint64(b + 1)
        return int(mix(h + np.uint64(len(piece)))[0])

    def arcs(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """(from node, to node, piece, depth of to, depth of from); node offs[w] + w + d is d bytes into word w."""
        n = len(offs) - 1
        word = np.repeat(np.arange(n), np.diff(offs))
        end = offs[1:][word]
        at = np.arange(len(data))
        h, starts, ends, ids = np.zeros(len(data), np.uint64), [], [], []
        for length in range(1, self.longest + 1):
            fits = at + length <= end[: len(at)]
            at = at[fits]
            if not len(at):
                break
            h = h[fits] * _STEP + (data[at + length - 1].astype(np.uint64) + np.uint64(1))
            end = end[: len(fits)][fits]
            piece = self.index.find(mix(h + np.uint64(length)))
            hit = piece >= 0
            starts.append(at[hit])
            ends.append(at[hit] + length)
            ids.append(piece[hit])
        a, b, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)
        w = word[a]
        return a + w, b + w, piece, b - offs[w], a - offs[w]

    @staticmethod
    def _recur(nodes: int, into: np.ndarray, out_of: np.ndarray, depth: np.ndarray, log_p: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Log sums over arcs into each node, level by level; ``known`` nodes have 0."""
        value = np.full(nodes, -np.inf)
        value[known] = 0.0
        order = np.lexsort((into, depth))
        into, out_of, log_p, depth = into[order], out_of[order], log_p[order], depth[order]
        levels = np.flatnonzero(np.concatenate(([True], depth[1:] != depth[:-1]))) if len(depth) else np.zeros(0, np.int64)
        for a, b in zip(levels, np.append(levels[1:], len(depth)), strict=True):
            x = value[out_of[a:b]] + log_p[a:b]
            first = np.flatnonzero(np.concatenate(([True], into[a + 1 : b] != into[a : b - 1])))
            most = np.maximum.reduceat(x, first)
            most = np.where(np.isneginf(most), 0.0, most)  # nodes that nothing reaches stay at -inf
            spread = np.repeat(most, np.diff(first, append=b - a))
            with np.errstate(divide="ignore"):
                value[into[a:b][first]] = most + np.log(np.add.reduceat(np.exp(x - spread), first))
        return value

    def forward(self, data: np.ndarray, offs: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Natural log probability of each word."""
        n = len(offs) - 1
        a, b, piece, depth, _ = self.arcs(data, offs)
        value = self._recur(len(data) + n, b, a, depth, log_p[piece], offs[:-1] + np.arange(n))
        return value[offs[1:] + np.arange(n)]

    def expected(self, data: np.ndarray, offs: np.ndarray, log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, each of which counts ``times``."""
        n = len(offs) - 1
        a, b, piece, depth, from_depth = self.arcs(data, offs)
        own = log_p[piece]
        first, last = offs[:-1] + np.arange(n), offs[1:] + np.arange(n)
        alpha = self._recur(len(data) + n, b, a, depth, own, first)
        beta = self._recur(len(data) + n, a, b, -from_depth, own, last)
        w = np.searchsorted(first, a, "right") - 1
        share = np.exp(alpha[a] + own + beta[b] - alpha[last][w]) * times[w]
        return np.bincount(piece, share, len(log_p))


def _units(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Words of the batch's first column, each after a space, ``size`` at a time and by rising length."""
    data, offs = binary_column(batch.column(0))
    length = np.diff(offs)
    order = np.argsort(length, kind="stable")
    for i in range(0, len(order), size):
        pick = order[i : i + size]
        to = np.concatenate(([0], np.cumsum(length[pick] + 1)))
        unit = np.full(to[-1], 32, np.uint8)
        inner = np.ones(to[-1], bool)
        inner[to[:-1]] = False
        ends = np.cumsum(length[pick])
        unit[inner] = data[np.repeat(offs[:-1][pick] - (ends - length[pick]), length[pick]) + np.arange(ends[-1] if len(ends) else 0)]
        yield pick, unit, to


def count_words(docs: DataFrame, params: LatticeParams) -> DataFrame:
    """word, c, t: every distinct word of all texts, with its count in those whose ``learn`` is true and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

        def merged() -> pa.RecordBatch:
            h, inverse_at, back = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            c, t = (np.bincount(back, np.concatenate([x[i] for x in held]), len(h)).astype(np.int64) for i in (1, 2))
            text = pa.concat_arrays([x[3] for x in held]).take(pa.array(inverse_at)).cast(pa.string())
            held.clear()
            return pa.record_batch([text, pa.array(c), pa.array(t)], ["word", "c", "t"])

        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for a, b, data, offs in chunks(batch, limit=512 << 10):
                w = words(data, offs)
                h, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
                held.append((h, np.bincount(back, learn[a:b][w.doc], len(h)), np.bincount(back, minlength=len(h)), spans(w.lowered, w.start[first], w.length[first])))
                if sum(len(x[0]) for x in held) > params.merge_rows:
                    yield merged()
        if held:
            yield merged()

    return mapped(docs.select("text", "learn"), run, "word string, c long, t long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def fit_pieces(table: DataFrame, tokens: int, vocabulary: Vocabulary, params: LatticeParams) -> np.ndarray:
    """Natural log probabilities of the pieces after ``rounds`` of expected counts over the ``tokens`` words of training."""
    p = vocabulary.weight
    size = params.batch_words
    for _ in range(params.rounds if tokens else 0):
        log_p = np.log(p)

        def run(batches: Iterator[pa.RecordBatch], log_p: np.ndarray = log_p) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(vocabulary), np.zeros(len(log_p))
            for batch in batches:
                times = batch.column(1).to_numpy().astype(float)
                for pick, unit, offs in _units(batch, size):
                    total += lattice.expected(unit, offs, log_p, times[pick])
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used), pa.array(total[used])], ["piece", "uses"])

        got = mapped(table.where("c > 0").select("word", "c"), run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full(len(p), params.smoothing)
        for r in got:
            uses[r["piece"]] += r["uses"]
        uses[-1] += tokens
        p = vocabulary.normalised(uses)
    return np.log(p)


def score_words(table: DataFrame, log_p: np.ndarray, vocabulary: Vocabulary, share: float, params: LatticeParams) -> DataFrame:
    """(word, c, t) with lp, the log10 probability that a token is the word; ``share`` is that of words among tokens."""
    size = params.batch_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary)
        for batch in batches:
            lp = np.zeros(batch.num_rows)
            for pick, unit, offs in _units(batch, size):
                lp[pick] = (lattice.forward(unit, offs, log_p) + log_p[-1] + np.log(share)) / LN10
            yield pa.record_batch([*batch.columns, pa.array(lp)], ["word", "c", "t", "lp"])

    return mapped(table.select("word", "c", "t"), run, "word string, c long, t long, lp double")


def _frequent(scored: DataFrame, most: int) -> tuple[int, list]:
    """A count in all texts, and the words that reach it, ``most`` at most."""
    bins = scored.groupBy(F.floor(F.log2("t")).cast("int").alias("b")).count().collect()
    total, bar = 0, 62
    for b, n in sorted(((r["b"], r["count"]) for r in bins), reverse=True):
        if total + n > most:
            break
        total, bar = total + n, b
    return 1 << bar, scored.where(F.floor(F.log2("t")) >= bar).collect() if total else []


_SUMS = ("copies", "n_tokens", "n_known", "log_c", "lp")


def lattice_scores(docs: DataFrame, learn: Column, vocabulary_path: str, params: LatticeParams = LatticeParams()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    ``learn`` says which rows the counts and the pieces' probabilities come from.
    """
    vocabulary = read_vocabulary(vocabulary_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("learn", F.coalesce(learn, F.lit(True)))
    table = written(count_words(rows, params))
    ends = rows.where("learn").count()
    total = table.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    train_words, distinct_words = total["n"] or 0, total["v"]
    train_tokens, distinct = train_words + ends, distinct_words + (1 if ends else 0)
    log_p = fit_pieces(table, train_words, vocabulary, params)
    share = train_words / train_tokens if train_words else 0.5
    scored = written(score_words(table, log_p, vocabulary, share, params))
    bar, top = _frequent(scored, params.frequent)
    joined = np.frombuffer(" ".join(r["word"] for r in top).encode(), np.uint8)
    known = HashIndex(words(joined, np.array([0, len(joined)])).hash)
    top_log = np.log10(np.array([r["c"] for r in top], float) + 0.1)
    top_lp, top_known = np.array([r["lp"] for r in top], float), np.array([r["c"] > 0 for r in top], float)
    end_log, end_lp = float(np.log10(ends + 0.1)), float(np.log10(ends / train_tokens if ends and train_words else 0.5))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch):
                n = b - a
                w = words(data, offs)
                at = known.find(w.hash)
                hit = at >= 0
                doc, at = w.doc[hit], at[hit]
                columns = [
                    np.ones(n, np.int64),
                    np.bincount(w.doc, minlength=n) + 1,
                    np.bincount(doc, top_known[at], n).astype(np.int64) + (1 if ends else 0),
                    np.bincount(doc, top_log[at], n) + end_log,
                    np.bincount(doc, top_lp[at], n) + end_lp,
                ]
                yield pa.record_batch([batch.column(0).slice(a, n), batch.column(2).slice(a, n), *map(pa.array, columns)], ["doc_id", "th", *_SUMS])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in chunks(batch):
                w = words(data, offs)
                rest = np.flatnonzero(known.find(w.hash) < 0)
                order = rest[np.lexsort((w.hash[rest], w.doc[rest]))]
                h, d = w.hash[order], w.doc[order]
                first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.zeros(0, np.int64)
                k = np.diff(first, append=len(h))
                doc = pa.array(d[first])
                text = spans(w.lowered, w.start[order[first]], w.length[order[first]]).cast(pa.string())
                yield pa.record_batch([batch.column(0).slice(a, b - a).take(doc), batch.column(2).slice(a, b - a).take(doc), text, pa.array(k)], ["doc_id", "th", "word", "k"])

    keyed = rows.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    whole = mapped(keyed, settled, "doc_id long, th long, copies long, n_tokens long, n_known long, log_c double, lp double")
    apart = mapped(keyed, rare, "doc_id long, th long, word string, k long").join(scored.where(F.col("t") < bar), "word")
    late = apart.select(
        "doc_id", "th", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("k")).otherwise(0).cast("long").alias("n_known"),
        (F.col("k") * F.log10(F.col("c") + 0.1)).alias("log_c"), (F.col("k") * F.col("lp")).alias("lp"),
    )
    sums = whole.unionByName(late).groupBy("doc_id", "th").agg(*(F.sum(c).alias(c) for c in _SUMS))
    floor = float(np.log10(train_tokens + 0.1 * (distinct + 1)))
    each = lambda c: F.col(c) / F.col("copies")
    return sums.select(
        "doc_id",
        each("n_tokens").cast("long").alias("n_tokens"),
        each("n_known").cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (each("log_c") - each("n_tokens") * floor).alias("base_score"),
        each("lp").alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def lattice_report(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    held_out = F.coalesce(crc_of_id() % 10 == 0, F.lit(False))
    scores = lattice_scores(docs, ~held_out, vocabulary_path or default_vocabulary())
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
