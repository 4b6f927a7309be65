"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts up to ``order`` is counted over all training texts.  A byte that a context
has not seen is reached by an escape to the context one byte shorter.  Escapes are estimated by the
number of distinct bytes a context has seen (method C: d of n + d), and bytes that a longer context
has seen are excluded from the shorter ones' counts.  Below the empty context all bytes not yet
excluded are equally likely.  Byte 255, which no text contains, stands for the end of a text and fills
the context before its start.

Counting is a Spark aggregation that grows with the corpus, and so does the model that scores.  Its head,
the ``CONTEXTS`` most frequent contexts, closed under shortening, is broadcast with a full distribution
each.  A byte whose context of ``order`` bytes is not in the head may have been seen in the tail, a Spark table:
such bytes are counted per text and meet their probability in a join.  The size of the head decides the cost,
never a score.

The base score is a smoothed word model; the words of its head (``HEAD`` at most) are broadcast, all
others meet their counts in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.text import fold
from cohortspark.session import materialise

ORDER, CONTEXTS, HEAD = 4, 65_536, 200_000
END, FILL = 255, b"\xff" * ORDER
PIECE = 2 * 1024 * 1024  # bytes of text worked on at once
HELD_IN_TASK = 1_000_000  # distinct grams a task holds before it hands them on; a fifth of that for words
ROWS_AT_ONCE = 1_000
FOLDS, HELD_OUT = 5, 1


def pieces(texts: list[str | None]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Texts cut into groups of at most ``PIECE`` bytes or so: (text, bytes before, bytes with the end)."""
    group, size = [], 0
    for i, text in enumerate(texts):
        plain = (text or "").encode() + b"\xff"
        for at in range(0, len(plain), PIECE):
            part = plain[at : at + PIECE]
            group.append((i, FILL if not at else plain[at - ORDER : at], part))
            size += len(part)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def grams(group: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of a group with the ``ORDER`` bytes before it as one number, and where each text starts."""
    joined = b"".join(x for _, before, part in group for x in (before, part))
    sizes = np.array([len(part) for _, _, part in group])
    padded = joined + b"\0" * 8
    eight = np.ndarray((len(joined) - ORDER,), ">u8", buffer=padded, strides=(1,))
    every = eight.astype(np.uint64) >> np.uint64(8 * (7 - ORDER))
    wanted = np.ones(len(every), bool)
    starts = np.cumsum(sizes + ORDER)[:-1]  # of the bytes before a text, in the joined bytes
    for k in range(ORDER):
        wanted[starts - ORDER + k] = False
    return every[wanted], np.concatenate(([0], np.cumsum(sizes)[:-1]))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(counts)], ["gram", "n"])

    for batch in batches:
        for group in pieces(batch.column(0).to_pylist()):
            new, n = np.unique(grams(group)[0], return_counts=True)
            found, at = np.unique(np.concatenate((found, new)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n))).astype(np.int64)
            if len(found) > HELD_IN_TASK:
                yield rows()
                found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield rows()


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n): how often each byte follows each context of ``ORDER`` bytes, over a one-column table."""
    return texts.mapInArrow(_count_grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Trie:
    """The kept contexts, shortest first, with the log10 probability of every byte after each."""

    tables: list[tuple[np.ndarray, np.ndarray]]  # per order: contexts and rows of an open hash table
    column: np.ndarray  # of each byte; the last column is for bytes never seen in training
    logs: np.ndarray
    seen: np.ndarray  # a bit per row and column: the byte was seen after the context itself
    first: np.ndarray  # row of the first context of every order, and their number

    def rows(self, contexts: np.ndarray) -> np.ndarray:
        """The row of the longest kept suffix of every context."""
        out = np.full(len(contexts), -1, np.int64)
        left = np.arange(len(contexts))
        for order in reversed(range(len(self.tables))):
            asked = contexts[left] & np.uint64((1 << (8 * order)) - 1)
            out[left] = _look_up(self.tables[order], asked)
            left = left[out[left] < 0]
            if not len(left):
                break
        return out

    def log10(self, numbers: np.ndarray) -> np.ndarray:
        """log10 probability of every byte after its context."""
        return self.logs[self.rows(numbers >> np.uint64(8)), self.column[(numbers & np.uint64(255)).astype(np.int64)]]

    def known(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every byte after its context: the log10 in the head, the order found there, whether the byte was seen at that order."""
        rows, columns = self.rows(numbers >> np.uint64(8)), self.column[(numbers & np.uint64(255)).astype(np.int64)]
        last = np.minimum(columns // 8, self.seen.shape[1] - 1)
        bits = self.seen[rows, last] >> (7 - columns % 8) & 1 if self.seen.shape[1] else np.zeros(len(rows), np.uint8)
        return self.logs[rows, columns].astype(float), np.searchsorted(self.first, rows, "right") - 1, (bits == 1) & (columns < self.logs.shape[1] - 1)


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (size - 1)


def _hash_table(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear probing with at most an eighth of the slots in use; empty slots have row -1."""
    size = 1 << max(4, int(8 * len(keys)).bit_length())
    held, at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
    for key, row, slot in zip(keys.tolist(), rows.tolist(), _slots(keys, size).tolist()):
        while at[slot] >= 0:
            slot = (slot + 1) % size
        held[slot], at[slot] = key, row
    return held, at


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    held, at = table
    slots = _slots(keys, len(held))
    rows = at[slots].astype(np.int64)
    wrong = np.flatnonzero((held[slots] != keys) & (rows >= 0))
    while len(wrong):
        slots[wrong] = (slots[wrong] + 1) % len(held)
        rows[wrong] = at[slots[wrong]]
        wrong = wrong[(held[slots[wrong]] != keys[wrong]) & (rows[wrong] >= 0)]
    return rows


def build(order: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> Trie:
    """The trie from rows (order, context, byte, count) whose contexts are closed under shortening."""
    seen = np.unique(symbol)
    column = np.full(256, len(seen), np.int64)
    column[seen] = np.arange(len(seen))
    keys, at = np.unique(np.append(order << 32 | context, 0), return_inverse=True)  # the empty context is always there
    counts = np.zeros((len(keys), len(seen)), np.float32)
    counts[at[:-1], column[symbol]] = n
    lengths, contexts = keys >> 32, keys & 0xFFFFFFFF
    shorter = np.searchsorted(keys, lengths - 1 << 32 | contexts & (1 << 8 * np.maximum(lengths - 1, 0)) - 1)
    shorter[0] = -1
    logs = np.empty((len(keys), len(seen) + 1), np.float32)
    for start in range(0, len(keys), 2_048):
        rows = np.arange(start, min(start + 2_048, len(keys)))
        chance, free = np.zeros((len(rows), len(seen))), np.ones((len(rows), len(seen)), bool)
        mass, node, live = np.ones(len(rows)), rows.copy(), np.ones(len(rows), bool)
        while live.any():
            here = np.where(live[:, None], counts[node], 0).astype(float) * free
            total, distinct = here.sum(axis=1), (here > 0).sum(axis=1)
            whole = np.maximum(total + distinct, 1)
            chance += (mass / whole)[:, None] * here
            mass = np.where(distinct > 0, mass * distinct / whole, mass)
            free &= here == 0
            node = np.where(live, shorter[node], -1)
            live = node >= 0
        left = mass / (free.sum(axis=1) + 256 - len(seen))
        chance = np.where(free, left[:, None], chance)
        logs[rows] = np.log10(np.concatenate((chance, left[:, None]), axis=1))
    tables = []
    for j in range(ORDER + 1):
        own = np.flatnonzero(lengths == j)
        tables.append(_hash_table(contexts[own].astype(np.uint64), own))
    return Trie(tables, column, logs, np.packbits(counts > 0, axis=1), np.searchsorted(lengths, np.arange(ORDER + 1)))


def count_contexts(texts: DataFrame) -> DataFrame:
    """(ord, context, symbol, n) for every context of a one-column table of texts."""
    longest = materialise(count_grams(texts))
    kept_bits = F.array(*[F.struct(F.lit(j).alias("ord"), F.col("gram").bitwiseAND((1 << (8 * (j + 1))) - 1).alias("gram")) for j in range(ORDER + 1)])
    every = longest.select(F.explode(kept_bits).alias("g"), "n").groupBy("g.ord", "g.gram").agg(F.sum("n").alias("n"))
    return materialise(every.select("ord", F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).alias("symbol"), "n"))


def head_and_tail(every: DataFrame, contexts: int = CONTEXTS) -> tuple[Trie, DataFrame]:
    """The most frequent contexts as a trie, and the rows of all others.

    A context is at least as frequent as any it ends, and shorter ones come first among equals, so
    the head is closed under shortening.  Without training texts every byte is equally likely.
    """
    totals = every.groupBy("ord", "context").agg(F.sum("n").alias("total"))
    frequent = materialise(totals.orderBy(F.desc("total"), "ord", "context").limit(contexts).select("ord", "context"))
    model = every.join(frequent, ["ord", "context"]).select("ord", "context", "symbol", "n").toArrow()  # at most 256 rows per kept context
    head = build(*[model.column(c).to_numpy().astype(np.int64) for c in ("ord", "context", "symbol", "n")])
    return head, materialise(every.join(frequent, ["ord", "context"], "left_anti"))


def train(texts: DataFrame, contexts: int = CONTEXTS) -> Trie:
    """The head of the model of a one-column table of texts."""
    return head_and_tail(count_contexts(texts), contexts)[0]


def escapes(every: DataFrame, tail: DataFrame) -> DataFrame:
    """(ord, context, own, n_seen, n_new) of every tail context.

    A byte seen after it with count n has the probability n * own.  The others have the probability that the context one
    byte shorter gives them, times n_seen if they were seen there and n_new if not: what was
    excluded by now is all that the longer context has seen.
    """
    shorter = F.col("context").bitwiseAND(F.expr("shiftleft(1L, 8 * (ord - 1)) - 1"))
    parents = tail.select("ord", "context", "symbol", "n", (F.col("ord") - 1).alias("_ord"), shorter.alias("_context"))
    whole = every.groupBy("ord", "context").agg(F.sum("n").cast("double").alias("_n"), F.count(F.lit(1)).cast("double").alias("_d")).withColumnsRenamed({"ord": "_ord", "context": "_context"})
    counted = every.select(F.col("ord").alias("_ord"), F.col("context").alias("_context"), "symbol", F.col("n").alias("_excluded"))
    own = parents.join(counted, ["_ord", "_context", "symbol"]).groupBy("ord", "context", "_ord", "_context").agg(
        F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("d"), F.sum("_excluded").cast("double").alias("x"),
    )
    met = materialise(own).join(materialise(whole), ["_ord", "_context"])
    new, all_ = F.col("_d") - F.col("d"), F.col("_n") + F.col("_d")
    left = F.col("_n") - F.col("x") + new
    out = F.col("d") / (F.col("n") + F.col("d"))
    return met.select(
        "ord", "context", (1 / (F.col("n") + F.col("d"))).alias("own"), F.when(new > 0, out * all_ / left).alias("n_seen"),
        (out * F.when(new > 0, new / F.col("_d") * all_ / left).otherwise(all_ / F.col("_d"))).alias("n_new"),
    )


MARK = b" g"  # before the eight bytes of a gram that stands among words


def _steps(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for every order above that found in the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            numbers = np.array([int.from_bytes(w[len(MARK) :], "big") for w in words.to_pylist()], np.uint64)
            logs, found, seen = model.value.known(numbers)
            at = np.repeat(np.arange(len(numbers)), ORDER - found)
            order = np.concatenate([np.arange(k + 1, ORDER + 1) for k in found.tolist()] or [np.zeros(0, np.int64)])
            context = (numbers >> np.uint64(8)).astype(np.int64)[at] & ((1 << 8 * order) - 1)
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(at)), pa.array(logs[at]), pa.array(seen[at]), pa.array(order, pa.int32()), pa.array(context), pa.array((numbers & np.uint64(255)).astype(np.int64)[at])],
                ["word", "head", "seen", "ord", "context", "symbol"],
            )

    return run


def tail_logs(words: DataFrame, model: Broadcast, every: DataFrame, tail: DataFrame) -> DataFrame:
    """(word, log) for distinct grams (marked, in a column ``word``) that are not of an order-4 context of the head."""
    steps = materialise(words.mapInArrow(_steps(model), "word binary, head double, seen boolean, ord int, context bigint, symbol bigint"))
    met = steps.join(materialise(escapes(every, tail)), ["ord", "context"], "left").join(tail, ["ord", "context", "symbol"], "left")
    walk = F.array_sort(F.collect_list(F.struct("ord", "own", "n_seen", "n_new", "n")))
    # From the shortest to the longest: a context that was not seen passes on what the shorter one says.
    start = F.struct(F.col("head").alias("log"), F.col("seen").alias("seen"))
    step = lambda a, x: F.when(x["own"].isNull(), F.struct(a["log"].alias("log"), F.lit(False).alias("seen"))).when(x["n"].isNotNull(), F.struct(F.log10(x["n"] * x["own"]).alias("log"), F.lit(True).alias("seen"))).otherwise(F.struct((a["log"] + F.log10(F.when(a["seen"], x["n_seen"]).otherwise(x["n_new"]))).alias("log"), F.lit(False).alias("seen")))  # noqa: E731, E501
    each = met.groupBy("word").agg(F.first("head").alias("head"), F.first("seen").alias("seen"), walk.alias("walk"))
    return each.select("word", F.aggregate("walk", start, step)["log"].alias("log"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update((text or "").encode().lower().split())
            if len(counts) > HELD_IN_TASK // 5:
                yield rows()
                counts.clear()
    yield rows()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over a one-column table of texts."""
    return texts.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


PARTS = "held_out boolean, word binary, times bigint, n_tokens bigint, n_known bigint, base double, score double"


def _score_rows(model: Broadcast, head: Broadcast, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a document: one with what the heads say, one for every other word, and unless the model is ``whole`` one for every gram that may be in its tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = model.value, head.value
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            texts = batch.column("text").to_pylist()
            sums = np.zeros(len(texts))
            at, words, times, figures = [], [], [], []
            for group in pieces(texts):
                numbers, starts = grams(group)
                if whole:
                    logs = trie.log10(numbers).astype(float)
                else:
                    logs, order, _ = trie.known(numbers)
                    asked = np.flatnonzero(order < ORDER)
                    logs[asked] = 0
                    owner = np.array([i for i, _, _ in group])[np.searchsorted(starts, asked, "right") - 1]
                    pairs, n = np.unique(np.stack((owner.astype(np.uint64), numbers[asked])), axis=1, return_counts=True)
                    at += pairs[0].astype(np.int64).tolist()
                    words += [MARK + g.to_bytes(8, "big") for g in pairs[1].tolist()]
                    times += n.tolist()
                np.add.at(sums, [i for i, _, _ in group], np.add.reduceat(logs, starts))
            n_grams = len(at)
            for i, text in enumerate(texts):
                counts = Counter((text or "").encode().lower().split())
                base, n = 0.0, 0
                for word, k in counts.items():
                    value = known.get(word)
                    if value is None:
                        at.append(i)
                        words.append(word)
                        times.append(k)
                    else:
                        n += k
                        base += k * value
                figures.append((sum(counts.values()) + 1, n, base))
            rest, total = len(at), len(at) + len(texts)
            take = pa.array(np.concatenate((np.array(at, np.int64), np.arange(len(texts)))))
            # The row of the document itself has a word that no text can contain, different for each, so that rows spread.
            own = [b" %d %d" % x for x in zip(batch.column("digest").to_pylist(), range(len(texts)))]
            nulls, zeros = [None] * rest, [0] * n_grams + [None] * (rest - n_grams)  # a gram counts for no word
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take), batch.column("digest").take(take), batch.column("held_out").take(take),
                    pa.array(words + own, pa.binary()), pa.array(times + [None] * len(texts), pa.int64()),
                    pa.array(nulls + [f[0] for f in figures], pa.int64()), pa.array(zeros + [f[1] for f in figures], pa.int64()),
                    pa.array(zeros + [f[2] for f in figures], pa.float64()), pa.array(np.concatenate((np.zeros(rest), sums)), pa.float64(), mask=np.arange(total) < rest),
                ],
                ["doc_id", "digest", "held_out", "word", "times", "n_tokens", "n_known", "base", "score"],
            )

    return run


def score(docs: DataFrame, training: Column | None = None, key: str = "doc_id", text: str = "text", contexts: int = CONTEXTS, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``training`` marks the rows to learn from (default: all outside fold ``HELD_OUT``); the others
    are held out.  A null text is an empty one, which still has its end to be predicted.  Equal rows
    are scored alike.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    training = fold(F.col(key), FOLDS) != HELD_OUT if training is None else training
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("digest"), (~training).alias("held_out"), F.col(text).alias("text"))
    learned = rows.where("NOT held_out").select("text")
    counts = materialise(count_words(learned))
    n_texts = learned.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, v = n_words + n_texts, distinct + (n_texts > 0)
    whole = n_all + 0.5 * (v + 1)
    frequent = counts.orderBy(F.desc("n"), "word").limit(head).toArrow()
    logs = np.log10((frequent.column("n").to_numpy() + 0.5) / whole)
    values = dict(zip(frequent.column("word").to_pylist(), logs.tolist()))
    end = float(np.log10((n_texts + 0.5) / whole))

    every = count_contexts(learned)
    trie, tail = head_and_tail(every, contexts)
    whole_model = tail.isEmpty()
    model, known = spark.sparkContext.broadcast(trie), spark.sparkContext.broadcast(values)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest bigint, {PARTS}"
    parts = rows.mapInArrow(_score_rows(model, known, whole_model), schema)
    facts = counts.select(F.col("word").alias("_word"), "n", F.lit(None).cast("double").alias("log"))
    if not whole_model:
        parts = materialise(parts)
        asked = parts.where(F.substring("word", 1, len(MARK)) == F.lit(MARK)).select("word").distinct()
        grams_ = tail_logs(asked, model, every, tail)
        facts = materialise(facts.unionByName(grams_.select(F.col("word").alias("_word"), F.lit(None).cast("bigint").alias("n"), "log")))
    met = parts.join(facts, F.col("word") == F.col("_word"), "left")
    c = F.coalesce("n", F.lit(0))
    added = met.select(
        "doc_id", "digest", "held_out", "score", "n_tokens", (F.col("times") * F.col("log")).alias("_more"),
        F.coalesce("n_known", F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.coalesce("base", F.col("times") * F.log10((c + 0.5) / whole)).alias("base"),
    )
    summed = added.groupBy("doc_id", "digest", "held_out").agg(
        F.count("score").alias("copies"), (F.sum("score") + F.coalesce(F.sum("_more"), F.lit(0.0))).alias("score"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"),
    )
    each = summed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return each.select(
        "doc_id", "held_out", F.expr("n_tokens div copies").alias("n_tokens"), (F.expr("n_known div copies") + int(n_texts > 0)).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"), (F.col("base") / F.col("copies") + end).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
    )
