"""Scoring by a weighted backoff automaton whose counts come from the corpus itself."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, small_batches, text_bytes, word_hashes, words

#: Hashes of the mark at a text's end and of the one before its start; no word has them but by a 64-bit collision.
END, START = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text in a block, and bytes of text whose n-grams a range of keys holds.
BLOCK, RANGE = 8 << 20, 8 << 20
#: Weights of a failure arc among which the counts choose, by powers of two.
GRID = tuple(2.0**k for k in range(-2, 15))


def width_of(size: int) -> int:
    """Bits of an n-gram's key: so many that one of two million questions at most meets another n-gram's key, whatever the size."""
    return min(64, max(32, math.ceil(math.log2(size + 1)) + 21))


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in a row (words, then an end each), and how many each text has."""
    parts, sizes = [], []
    for t in texts:
        h = word_hashes(words(t))
        parts += [h, [END]]
        sizes.append(len(h) + 1)
    return (np.concatenate(parts).astype(np.uint64) if parts else np.empty(0, np.uint64)), np.array(sizes, np.int64)


def places(sizes: np.ndarray) -> np.ndarray:
    """The number of each token in its text, from 0."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def mixed(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = before * _A
        x = (x ^ (x >> np.uint64(29))) * _B + tokens
        x *= _A
        return x ^ (x >> np.uint64(32))


def ngrams(tokens: np.ndarray, sizes: np.ndarray, order: int, width: int):
    """For each order from 1 on: the keys of the n-grams that end at the tokens, and which tokens have one.

    The start mark is the token before a text's first. A key's last bit says whether the n-gram ends with the end of a text.
    """
    at, end = places(sizes), tokens == END
    whole, shift = tokens, np.uint64(64 - width)
    for n in range(1, order + 1):
        if n > 1:
            before = np.empty_like(whole)
            before[1:] = whole[:-1]
            if n == 2:
                before[at == 0] = START
            whole = mixed(before, tokens)
        valid = at >= n - 2
        yield (whole >> shift) & ~np.uint64(1) | end, valid


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and each one's occurrences in training texts."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at[train], minlength=len(distinct)).astype(np.uint32)


def parted(distinct: np.ndarray, bits: int, width: int) -> dict[int, tuple[int, int]]:
    """The ranges (first bits of a key of that width) that sorted keys have, and where each begins and ends among them."""
    if not len(distinct):
        return {}
    ranges = distinct >> np.uint64(width - bits)
    first = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
    return dict(zip(ranges[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(distinct)], strict=True), strict=True))


def planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte of all of them, so that compression finds the empty high bytes."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes()


def unplaned(data: pa.Scalar, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data.as_buffer(), np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed(numbers: np.ndarray) -> bytes:
    """planes() of the differences of sorted numbers."""
    return planes(np.diff(numbers, prepend=np.zeros(1, numbers.dtype)))


def unpacked(data: pa.Scalar) -> np.ndarray:
    return np.cumsum(unplaned(data, np.uint64), dtype=np.uint64)


@dataclass
class BackoffAutomaton:
    """States are the root and one for each history of up to len(kappas) tokens that was seen in training.

    From the state of a history there is an arc for each word that followed it; for any other word the failure arc, of weight
    kappa / (count of the history + kappa), leads to the state of the history without its first token, from one token to the root,
    where every word is read. An arc weighs (count + kappa P(word in the failure state)) / (count of the history + kappa), and the
    root's weigh (c + 0.5) / (N + 0.5 (V + 1)), so each state's probabilities sum to 1.
    """

    total: int
    distinct: int
    kappas: tuple[float, ...]

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def run(self, grams: list[np.ndarray], histories: list[np.ndarray]) -> np.ndarray:
        """log10 weights of reading the tokens of texts from left to right.

        grams[m][i]: training count of token i with the m tokens before it; histories[m - 1][i]: that of those m tokens, 0 if the text
        has not so many before it. The state that is carried to token i is the longest history with a count; as each
        state is known from the tokens before it, the tokens of a block are read together, one failure arc a round.
        """
        p = [self.root(grams[0])]
        for m, kappa in enumerate(self.kappas, 1):
            seen = histories[m - 1]
            p.append(np.where(seen > 0, (grams[m] + kappa * p[-1]) / (seen + kappa), p[-1]))
        state = np.zeros(len(grams[0]), np.int64)
        for m in range(1, len(self.kappas) + 1):
            state[histories[m - 1] > 0] = m
        logs = np.zeros(len(state))
        for m in range(len(self.kappas), 0, -1):
            here = np.flatnonzero(state == m)
            arc = grams[m][here] > 0
            logs[here[arc]] += np.log10(p[m][here[arc]])
            state[here[arc]] = -1
            fails = here[~arc]
            logs[fails] += np.log10(self.kappas[m - 1] / (histories[m - 1][fails] + self.kappas[m - 1]))
            state[fails] = m - 1
        last = state == 0
        logs[last] += np.log10(p[0][last])
        return logs


def failing(counts: np.ndarray, kappa: float) -> float:
    """How many training tokens are expected to take the failure arc of their history's state, each left out of the counts itself."""
    return float((counts * (kappa / (counts - 1 + kappa))).sum())


def chosen(expected: list[float], novel: int) -> float:
    """The least weight of GRID under which no fewer failures are expected than tokens are new after their history if left out."""
    return next((k for k, x in zip(GRID, expected, strict=True) if x >= novel), GRID[-1])


OUT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def cut(docs: DataFrame, *, block_bytes: int) -> DataFrame:
    """Rows (k, train, t) as blocks of about block_bytes of text: block, k, train, sizes, words (distinct hashes), at (places among them)."""
    small_batches(docs.sparkSession)
    kind = to_arrow_type(docs.schema["k"].dataType)

    def run(batches):
        part, n, size = TaskContext.get().partitionId(), 0, 0
        keys, train, texts = [], [], []

        def made():
            tokens, sizes = stream(texts)
            u, at = np.unique(tokens, return_inverse=True)
            k = pa.concat_arrays(keys).cast(kind)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([(part << 32) + n], pa.int64()), one(k), one(pa.concat_arrays(train)), *(pa.array([x], pa.binary()) for x in (planes(sizes), packed(u), planes(at.astype(np.uint32))))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "k", "train", "sizes", "words", "at"])

        for batch in batches:
            bytes_ = batch.column(3).to_pylist()
            first = 0
            for i in range(batch.num_rows):
                size += bytes_[i]
                if size >= block_bytes or i + 1 == batch.num_rows:
                    keys.append(batch.column(0).slice(first, i + 1 - first))
                    train.append(batch.column(1).slice(first, i + 1 - first))
                    texts += batch.column(2).slice(first, i + 1 - first).to_pylist()
                    first = i + 1
                if size >= block_bytes:
                    yield made()
                    keys, train, texts, size, n = [], [], [], 0, n + 1
        if texts:
            yield made()

    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("k", T.ArrayType(docs.schema["k"].dataType)), T.StructField("train", T.ArrayType(T.BooleanType())), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "words", "at"))])
    return docs.select("k", "train", "t", F.coalesce(F.octet_length("t"), F.lit(0)).alias("n")).mapInArrow(run, out)


def score(docs: DataFrame, *, train: Column, text: str = "text", key: str = "doc_id", order: int = 3, block_bytes: int = BLOCK, range_bytes: int = RANGE) -> DataFrame:
    """Score each whole text, learning n-grams of up to `order` tokens from the texts for which train holds (null: not).

    Returns key, trained, n_tokens, n_known, train_tokens, base_score (single tokens) and score (the automaton's log10
    probability of the text), a row for each row of docs; null and empty texts have one token, the end. Repeated rows count and
    are scored each time; null keys pass through; other columns are not read, so their names clash with nothing; an empty table
    gives no rows. A text longer than block_bytes is a block of its own.

    How: the texts of a partition are cut into blocks of about block_bytes, kept as word numbers. A block sends the sorted keys
    of its distinct n-grams, with its own counts, to ranges of key space; a range sums the blocks' counts and answers
    each block in the order of its question. So a frequent n-gram is one number a block, no table of the corpus
    stands in one place, and a block reads its texts with exactly the part of the automaton they can reach. The weight
    of the failure arcs from histories of each length is estimated from the counts (chosen()): the ranges sum what is expected for
    each weight of GRID, and a few numbers of the whole corpus reach the driver.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    size = text_bytes(docs, text) + 1
    bits, width = max(0, math.ceil(math.log2(size / range_bytes))), width_of(size)
    ranges = 1 << bits
    rows = docs.select(F.col(key).alias("k"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("t"))
    # few rows a file: a reader holds many rows of a file at once
    blocks = scratch.save(cut(rows, block_bytes=block_bytes), "blocks", rows_per_file=4)
    n_blocks = max(1, blocks.count())

    def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = unplaned(row["sizes"], np.int64)
        return unpacked(row["words"])[unplaned(row["at"], np.uint32)], sizes, np.array(row["train"].as_py(), bool)

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, sizes, learn = opened({c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)})
                learn = np.repeat(learn, sizes)
                asked: dict[int, list[tuple[bytes, bytes]]] = {}
                for m, (keys, valid) in enumerate(ngrams(tokens, sizes, order, width)):
                    u, c = counted(keys[valid], learn[valid])
                    for r, (a, b) in parted(u, bits, width).items():
                        asked.setdefault(r, [(b"", b"")] * order)[m] = packed(u[a:b]), planes(c[a:b])
                columns = [pa.array(list(asked), pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(asked), pa.int64()), *(pa.array([[x[j] for x in q] for q in asked.values()], pa.list_(pa.binary())) for j in range(2))]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "block", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        totals, words_, tokens, novel, expected = [], 0, 0, [], []
        n = table.num_rows
        for m in range(order):
            parts = [unpacked(x[m]) for x in table["keys"]]
            own = np.concatenate([unplaned(x[m], np.uint32) for x in table["counts"]])
            distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
            total = np.bincount(at, weights=own, minlength=len(distinct)).astype(np.int64)
            totals.append([planes(x) for x in np.split(total[at], np.cumsum([len(p) for p in parts])[:-1])])
            seen = total > 0
            if m == 0:
                tokens, words_ = int(total.sum()), int(seen.sum())
            else:
                novel.append(int((total == 1).sum()))
            if m + 1 < order:
                # the end's own count stands for the start mark's, as histories; longer ones that end a text are none
                history = total[seen & ((distinct & np.uint64(1)) == 0)] if m else total[seen]
                expected.append([failing(history, k) for k in GRID])
        # each block's answer, and the range's own sums in a row without a block
        columns = [
            pa.array([*table["block"].to_pylist(), None], pa.int64()), pa.array([*table["range"].to_pylist(), None], pa.int32()),
            pa.array([*([t[i] for t in totals] for i in range(n)), None], pa.list_(pa.binary())),
            pa.array([None] * n + [[tokens, words_, *novel]], pa.list_(pa.int64())), pa.array([None] * n + [expected], pa.list_(pa.list_(pa.float64()))),
        ]
        return pa.table(columns, names=["block", "range", "totals", "sums", "expected"])

    asked = blocks.mapInArrow(ask, "range int, block long, keys array<binary>, counts array<binary>")
    answers = scratch.save(asked.repartition(ranges, "range").groupBy("range").applyInArrow(answer, "block long, range int, totals array<binary>, sums array<long>, expected array<array<double>>"), "answers")
    whole = answers.where("block is null")
    sums = whole.agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(order + 1)), *(F.sum(F.col("expected")[m][g]).alias(f"e{m}_{g}") for m in range(order - 1) for g in range(len(GRID)))).first()
    model = BackoffAutomaton(sums["s0"] or 0, sums["s1"] or 0, tuple(chosen([sums[f"e{m}_{g}"] or 0.0 for g in range(len(GRID))], sums[f"s{m + 2}"] or 0) for m in range(order - 1)))

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left[c][0] for c in left.column_names}
        tokens, sizes, learn = opened(row)
        right = right.sort_by("range")
        grams = []
        texts = 0
        for m, (keys, valid) in enumerate(ngrams(tokens, sizes, order, width)):
            distinct, at = np.unique(keys[valid], return_inverse=True)
            counts = np.concatenate([unplaned(x[m], np.int64) for x in right["totals"]])
            gram = np.zeros(len(tokens), np.int64)
            gram[valid] = counts[at]
            grams.append(gram)
            if m == 0:
                texts = int(counts[np.flatnonzero(distinct & np.uint64(1))[0]])
        first = places(sizes) == 0
        histories = []
        for m in range(1, order):
            h = np.zeros(len(tokens), np.int64)
            h[1:] = grams[m - 1][:-1]
            h[first] = texts if m == 1 else 0
            histories.append(h)
        ends = np.cumsum(sizes)
        add = lambda v: np.add.reduceat(v, ends - sizes)
        base, logs = np.log10(model.root(grams[0])), model.run(grams, histories)
        columns = [row["k"].values, pa.array(learn), pa.array(sizes), pa.array(add((grams[0] > 0).astype(np.int64))), pa.array(np.full(len(sizes), model.total, np.int64)), pa.array(add(base)), pa.array(add(logs))]
        return pa.table(columns, names=["k", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = T.StructType([T.StructField("k", rows.schema["k"].dataType), *T.StructType.fromDDL(f"train boolean, {OUT}").fields])
    both = blocks.repartition(n_blocks, "block").groupBy("block").cogroup(answers.where("block is not null").select("block", "range", "totals").repartition(n_blocks, "block").groupBy("block"))
    out = both.applyInArrow(read, kind)
    return out.select(F.col("k").alias(key), F.col("train").alias("trained"), *(x.split()[0] for x in OUT.split(", ")))
