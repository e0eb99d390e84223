"""LM scoring: masked pseudo-likelihood under a bidirectional window network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import written

UNIT = 1 << 20  # weights are averaged as integers of this unit, so that the order of sums doesn't matter
LOG_UNIT = 1 << 32  # logarithms of far words' counts are summed as integers of this unit, for the same reason


@dataclass(frozen=True)
class Shape:
    """classes * size tokens of the network: all but `rest` of them the most frequent words, the rest hash buckets for
    other words (`rest` is a power of two); `near` is how many words' counts each task holds, the others' are joined."""

    classes: int = 48
    size: int = 48
    rest: int = 256
    near: int = 65_536
    window: int = 3
    width: int = 16
    hidden: int = 32
    batch: int = 8192
    rate: float = 0.2
    rounds: int = 2

    @property
    def tokens(self) -> int:
        return self.classes * self.size

    def parts(self) -> dict[str, tuple[int, ...]]:
        n = 2 * self.window * self.width
        return {"embed": (self.tokens + 1, self.width), "mix": (n, self.hidden), "mix0": (self.hidden,), "group": (self.hidden, self.classes), "group0": (self.classes,), "word": (self.classes, self.hidden, self.size), "word0": (self.classes, self.size)}

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        found, at = {}, 0
        for name, shape in self.parts().items():
            n = int(np.prod(shape))
            found[name] = flat[at : at + n].reshape(shape)
            at += n
        return found

    def start(self, counts: np.ndarray) -> np.ndarray:
        """Small random weights; the tokens' counts in the corpus, plus one, as the softmaxes' constants."""
        rng = np.random.default_rng(7)
        flat = np.concatenate([(rng.standard_normal(int(np.prod(s))) * (0 if name.endswith("0") or name == "word" else 1 / np.sqrt(s[0] if name != "embed" else s[1]))).astype(np.float32) for name, s in self.parts().items()])
        net, n = self.split(flat), counts.reshape(self.classes, self.size) + 1.0
        net["group0"][:] = np.log(n.sum(1) / n.sum())
        net["word0"][:] = np.log(n / n.sum(1, keepdims=True))
        return flat


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z in lower case, and each text's number of words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = lists.flatten(), lists.offsets.to_numpy()
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(some)))
    return words.filter(pa.array(some)), np.diff(upto[ends - ends[0]])


class Coder:
    """Words to the network's tokens: 0 up are the known words by frequency, then the hash buckets; the last is padding.

    A word that isn't known has its bucket's probability times its part of the bucket's count in the corpus. For `near`
    words the log of this part is at hand; of the others, `far`, the bucket's total is, and log n has to be added.
    """

    def __init__(self, near: list[tuple[bytes, int]], totals: np.ndarray, shape: Shape):
        """near: the most frequent words with their counts; totals: how often each token is found."""
        self.place, self.shape = {w: i for i, (w, _) in enumerate(near)}, shape
        low = shape.tokens - shape.rest
        bucket = np.array([buckets(np.array([xxh64_intdigest(w, 42)], np.uint64), shape.rest)[0] for w, _ in near], np.int64)
        known = np.arange(len(near)) < low
        # After the near words: the padding, then the buckets of far words.
        self.token = np.concatenate((np.where(known, np.arange(len(near)), low + bucket), [shape.tokens], low + np.arange(shape.rest))).astype(np.int32)
        inside = np.log(np.maximum(totals[low:], 1))
        counts = np.array([n for _, n in near], float)
        self.share = np.concatenate((np.where(known, 0.0, np.log(np.maximum(counts, 1)) - inside[bucket]), [0.0], -inside))

    def rows(self, texts: pa.Array, score: bool = True) -> tuple:
        """All texts' tokens with padding between, and the places of the tokens; to score also each text's number of tokens,
        the sum of its words' logarithms in their buckets, and the hashes of its far words."""
        words, sizes = split_words(texts)
        kinds = words.dictionary_encode()
        found = [w.encode() for w in kinds.dictionary.to_pylist()]
        pad, window = len(self.place), self.shape.window
        codes = np.fromiter(map(self.place.get, found, repeat(-1)), np.int32, len(found))
        hashes = np.zeros(len(found), np.uint64)
        new = np.flatnonzero(codes < 0)
        hashes[new] = np.fromiter((xxh64_intdigest(found[k], 42) for k in new), np.uint64, len(new))
        codes[new] = pad + 1 + buckets(hashes[new], self.shape.rest)
        index = kinds.indices.to_numpy()
        own = codes[index]
        places = np.arange(len(own)) + window * np.repeat(np.arange(1, len(sizes) + 1), sizes)
        ids = np.full(len(own) + window * (len(sizes) + 1), self.shape.tokens, np.int32)
        ids[places] = self.token[own]
        if not score:
            return ids, places
        ends = np.cumsum(sizes)
        sums = np.concatenate(([0.0], np.cumsum(self.share[own])))
        far = own > pad
        cuts = np.concatenate(([0], np.cumsum(far)))[np.concatenate(([0], ends))]
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashes[index[far]].view(np.int64)))
        return ids, places, sizes, sums[ends] - sums[ends - sizes], lists


def buckets(hashes: np.ndarray, rest: int) -> np.ndarray:
    return (hashes % np.uint64(rest)).astype(np.int64)


def tame(net: dict[str, np.ndarray]) -> bool:
    """Whether no input of a softmax can be over 60: hidden units are in (-1, 1)."""
    return max((np.abs(net[k]).sum(-2) + np.abs(net[f"{k}0"])).max() for k in ("group", "word")) < 60


def exps(x: np.ndarray, small: bool) -> np.ndarray:
    """exp of rows, in place, cut at 60 unless they are known to be small; gives their sums."""
    if not small:
        np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


class Room(dict):
    """Arrays that the steps of one task use again: fresh large ones cost more than the sums in them."""

    def of(self, name: str, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        if name not in self or len(self[name]) < n:
            self[name] = np.empty(n, np.float32)
        return self[name][:n].reshape(shape)


def step(net: dict[str, np.ndarray], shape: Shape, context: np.ndarray, target: np.ndarray, learn: bool, room: Room) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Log probability of each target given the tokens on both sides and, to learn, the gradients of their mean.

    P(token) = P(its class) * P(token | class), each a softmax over what the hidden layer (softsign) makes of the context.
    The targets are put in order of their classes first, so that each class's are a slice.
    """
    n, sides = context.shape
    at, ones = np.arange(n), np.ones(n, np.float32)
    order = np.argsort((target // shape.size).astype(np.int16), kind="stable")
    context, target = context[order], target[order]
    kind, word = target // shape.size, target % shape.size
    edges = np.searchsorted(kind, np.arange(shape.classes + 1))
    flat = context.ravel()
    x = net["embed"].take(flat, axis=0, out=room.of("x", n * sides, shape.width), mode="clip").reshape(n, -1)
    h = np.matmul(x, net["mix"], out=room.of("h", n, shape.hidden))
    h += net["mix0"]
    bent = np.abs(h, out=room.of("bent", n, shape.hidden))
    bent += 1
    h /= bent
    p = np.matmul(h, net["group"], out=room.of("p", n, shape.classes))
    p += net["group0"]
    small = tame(net)
    sums = exps(p, small)
    chance = p[at, kind] / sums
    slope: dict[str, np.ndarray] = {}
    back = room.of("back", n, shape.hidden)
    if learn:
        p *= (1 / (n * sums))[:, None]
        p[at, kind] -= 1 / n
        slope = {"group": h.T @ p, "group0": ones @ p, "word": np.zeros_like(net["word"]), "word0": np.zeros_like(net["word0"])}
        np.matmul(p, net["group"].T, out=back)
    for c in range(shape.classes):
        own = slice(edges[c], edges[c + 1])
        k = edges[c + 1] - edges[c]
        if k:
            q = np.matmul(h[own], net["word"][c], out=room.of("q", k, shape.size))
            q += net["word0"][c]
            sums = exps(q, small)
            chance[own] *= q[at[:k], word[own]] / sums
            if learn:
                q *= (1 / (n * sums))[:, None]
                q[at[:k], word[own]] -= 1 / n
                slope["word"][c], slope["word0"][c] = h[own].T @ q, ones[:k] @ q
                back[own] += q @ net["word"][c].T
    score = np.empty(n, np.float32)
    score[order] = np.log(chance + 1e-30)
    if learn:
        bent *= bent
        back /= bent
        slope["mix"], slope["mix0"] = x.T @ back, ones @ back
        each = np.matmul(back, net["mix"].T, out=x).reshape(-1, shape.width)
        by = np.argsort(flat.astype(np.int16 if shape.tokens < 32_000 else np.int32), kind="stable")
        flat = flat[by]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        sorted_ = each.take(by, axis=0, out=room.of("sorted", *each.shape), mode="clip")
        slope["embed"] = np.zeros_like(net["embed"])
        slope["embed"][flat[first]] = np.add.reduceat(sorted_, first)
    return score, slope


def batches_of(ids: np.ndarray, places: np.ndarray, shape: Shape, times: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sides = np.array([k for k in range(-shape.window, shape.window + 1) if k])
    size = shape.batch * times
    for i in range(0, len(places), size):
        at = places[i : i + size]
        yield ids[at[:, None] + sides], ids[at]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word is found in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = split_words(batch.column(0))[0].value_counts().flatten()
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), n], ["word", "n"])

    return written(docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The `most` most frequent words (ties: by bytes) and their counts. A histogram of the counts tells how frequent they
    are at least, so that tasks send few others to the driver."""
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((x.step, x.words) for x in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    upto = np.cumsum([n for _, n in sizes])
    least = next((k for (k, _), n in zip(sizes, upto) if n >= most), 0)
    return [(bytes(x.word), x.n) for x in counts.filter(step >= least).orderBy(F.desc("n"), "word").limit(most).collect()]


def token_totals(counts: DataFrame, known: list[bytes], shape: Shape) -> np.ndarray:
    """How often each of the network's tokens, words or buckets, is found."""
    spark, found = counts.sparkSession, np.zeros(shape.tokens, np.int64)
    own = counts.join(F.broadcast(spark.createDataFrame(list(zip(known, range(len(known)))), "word binary, i long")), "word", "left")
    token = F.coalesce("i", shape.tokens - shape.rest + F.pmod(F.xxhash64("word"), F.lit(shape.rest)))
    for x in own.groupBy(token.alias("token")).agg(F.sum("n").alias("n")).collect():
        found[x.token] = x.n
    return found


def far_counts(counts: DataFrame, near: list[bytes]) -> DataFrame:
    """h, log: the log of the count, in LOG_UNITs, by the 64-bit hash of each word that isn't near and is there twice or
    more; words of one hash, of which a billion words have less than one pair, count together."""
    first = counts.sparkSession.createDataFrame([(w,) for w in near], "word binary")
    others = counts.join(F.broadcast(first), "word", "left_anti").groupBy(F.xxhash64("word").alias("h")).agg(F.sum("n").alias("n"))
    return others.filter("n > 1").select("h", F.round(F.log("n") * LOG_UNIT).cast("long").alias("log"))


def train(docs: DataFrame, coder: Coder, shape: Shape, weights: np.ndarray) -> np.ndarray:
    """The network's weights, learned, beginning with the given ones, from every token of every document, once.

    In each round every partition of the documents whose turn it is learns from them on its own (Adagrad), beginning with
    the weights of the round before; the weights of the next are the mean over the partitions, by their tokens. The sums
    are a Spark aggregate; what comes to the driver is one network, whatever the input.
    """
    spark = docs.sparkSession
    for turn in range(shape.rounds):
        sent = spark.sparkContext.broadcast((coder, weights))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            coder, flat = sent.value
            flat = flat.copy()
            net, seen, total, room = shape.split(flat), shape.split(np.full_like(flat, 1e-6)), 0, Room()
            for batch in batches:
                ids, places = coder.rows(batch.column(0), False)
                for context, target in batches_of(ids, places, shape):
                    _, slope = step(net, shape, context, target, True, room)
                    for name, s in slope.items():
                        seen[name] += s * s
                        net[name] -= shape.rate * s / np.sqrt(seen[name])
                    total += len(target)
            if total:
                kept = np.rint(flat.astype(np.float64) * UNIT).astype(np.int64) * total
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(kept), dtype=np.int32)), pa.array(kept), pa.array(np.full(len(kept), total))], ["i", "w", "n"])

        own = docs.filter(F.pmod(F.xxhash64("text"), F.lit(shape.rounds)) == turn).select("text")
        mean = own.mapInArrow(run, "i int, w long, n long").groupBy("i").agg((F.sum(F.col("w").cast("decimal(38,0)")) / F.sum("n")).cast("double").alias("w"))
        found = mean.orderBy("i").toPandas()
        if len(found):
            weights = (found["w"].to_numpy() / UNIT).astype(np.float32)
    return weights


@dataclass(frozen=True)
class Model:
    """A trained network: what all tasks hold, and the table of far words' counts."""

    shape: Shape
    coder: Coder
    weights: np.ndarray
    far: DataFrame


def fit(docs: DataFrame, shape: Shape = Shape()) -> Model:
    """A network and word counts from every text of docs."""
    texts = docs.select("text").filter("text is not null")
    counts = word_counts(texts)
    near = frequent_words(counts, max(shape.near, shape.tokens - shape.rest))
    words = [w for w, _ in near]
    totals = token_totals(counts, words[: shape.tokens - shape.rest], shape)
    coder = Coder(near, totals, shape)
    return Model(shape, coder, train(texts, coder, shape, shape.start(totals)), far_counts(counts, words))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of each document under the model. A word that the model's corpus lacks
    counts like one that stands in it once."""
    shape, sent = model.shape, docs.sparkSession.sparkContext.broadcast((model.coder, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, flat = sent.value
        net, room = shape.split(flat), Room()
        for batch in batches:
            ids, places, sizes, inside, far = coder.rows(batch.column(1))
            scores = [step(net, shape, context, target, False, room)[0] for context, target in batches_of(ids, places, shape, 2)]
            sums = np.concatenate([[0.0], np.cumsum(np.concatenate(scores or [np.zeros(0)]), dtype=np.float64)])
            ends = np.cumsum(sizes)
            columns = [batch.column(0), pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes] + inside), far]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "_near", "_far"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, _near double, _far array<long>")
    found = written(found.withColumn("_row", F.monotonically_increasing_id()))
    own = found.select("_row", F.explode("_far").alias("h")).join(model.far, "h")
    more = own.groupBy("_row").agg(F.sum("log").alias("_more"))
    log_prob = F.col("_near") + F.coalesce(F.col("_more") / LOG_UNIT, F.lit(0.0))
    whole = found.drop("_far").join(more, "_row", "left").select("doc_id", "n_tokens", log_prob.alias("log_prob"))
    return whole.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def score(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of each document under a network trained on all of them.

    log_prob is the sum over the tokens of the log probability that the network gives each of them from the `window`
    tokens on both sides, the token itself masked. A word that the network doesn't know by itself has its bucket's
    probability times its part of the bucket's tokens in the whole corpus, so all words have probabilities of their own;
    the counts of all words are a table: the most frequent `near` ones are sent to all tasks, the others are joined to the
    words that need them. A text without words, or null, has 0 tokens, log_prob 0 and a null mean; long texts are scored
    whole. Null and repeated doc_ids are documents of their own; other columns are ignored; an empty table gives no rows.
    """
    return scored(docs, fit(docs, shape))
