"""Language identification: a byte convolutional network trained in numpy, applied to windows of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LETTER = r"\p{L}"


@dataclass(frozen=True)
class Shape:
    """window: bytes of a window; filters: how many of each width; sample: windows that the network learns from, at most,
    over all languages; languages: how many are learned, the most frequent ones."""

    window: int = 128
    embed: int = 8
    filters: tuple[tuple[int, int], ...] = ((2, 8), (3, 16), (4, 16), (5, 8))
    sample: int = 12_000
    per_document: int = 4
    languages: int = 100
    rounds: int = 12
    batch: int = 64
    rate: float = 0.003
    block: int = 256  # windows that are applied at a time

    @property
    def widest(self) -> int:
        return max(w for w, _ in self.filters)

    @property
    def step(self) -> int:
        """Windows overlap, so that no filter misses a place."""
        return self.window - self.widest + 1

    def mask(self) -> np.ndarray:
        """Which inputs of the widest filter each filter has."""
        return np.concatenate([np.repeat(np.arange(self.widest) < w, self.embed)[:, None].repeat(n, 1) for w, n in self.filters], 1)


def byte_classes() -> np.ndarray:
    """What a byte is to the network: A-Z as a-z, other ASCII but letters as a space, 0 as padding."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(1, 128):
        table[b] = ord(chr(b).lower()) if chr(b).isalpha() else 32
    return table


CLASSES = byte_classes()


@dataclass
class Network:
    shape: Shape
    labels: list[str]
    prior: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, shape: Shape, labels: list[str], prior: np.ndarray) -> Network:
        rng = np.random.default_rng(11)
        mask = shape.mask()
        draw = lambda *s: rng.standard_normal(s).astype(np.float32)
        table = draw(256, shape.embed) * 0.5
        table[0] = 0
        conv = draw(*mask.shape) / np.sqrt(mask.sum(0)) * mask
        return cls(shape, labels, prior, {"table": table, "conv": conv.astype(np.float32), "conv0": np.zeros(mask.shape[1], np.float32), "out": draw(mask.shape[1], len(labels)) * 0.1, "out0": np.zeros(len(labels), np.float32)})

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """windows x places x (widest * embed): what a filter sees at each place, padded behind the window."""
        n, size = windows.shape
        x = np.zeros((n, size + self.shape.widest - 1, self.shape.embed), np.float32)
        x[:, :size] = self.weights["table"][windows]
        flat = x.reshape(n, -1)
        view = np.lib.stride_tricks.as_strided(flat, (n, size, self.shape.widest * self.shape.embed), (flat.strides[0], 4 * self.shape.embed, 4))
        return np.ascontiguousarray(view)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filters' maxima over the places (rectified), where they are, and what the filters saw everywhere."""
        seen = self.patches(windows)
        value = seen.reshape(-1, seen.shape[2]) @ self.weights["conv"]
        value = value.reshape(*seen.shape[:2], -1)
        return value.max(1) + self.weights["conv0"], value, seen

    def log_shares(self, windows: np.ndarray) -> np.ndarray:
        top = np.maximum(self.pooled(windows)[0], 0)
        return log_softmax(top @ self.weights["out"] + self.weights["out0"])

    def learn(self, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        """Adam over `rounds` passes of the windows in a seeded order; half of a batch is cut short, so that short texts
        are known too."""
        w, rng = self.weights, np.random.default_rng(5)
        first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
        mask, step = self.shape.mask(), 0
        total = self.shape.rounds * -(-len(windows) // self.shape.batch)
        for _ in range(self.shape.rounds):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), self.shape.batch):
                rows = order[at : at + self.shape.batch]
                x = windows[rows].copy()
                cut = np.where(rng.random(len(rows)) < 0.5, rng.integers(8, self.shape.window + 1, len(rows)), self.shape.window)
                x[np.arange(self.shape.window) >= cut[:, None]] = 0
                grads = self.gradients(x, labels[rows], weight[rows], mask)
                step += 1
                rate = self.shape.rate * min(1.0, 2 * (1 - (step - 1) / total))
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def gradients(self, x: np.ndarray, labels: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross-entropy."""
        w, n = self.weights, len(x)
        top, value, seen = self.pooled(x)
        on = np.maximum(top, 0)
        share = np.exp(log_softmax(on @ w["out"] + w["out0"]))
        share[np.arange(n), labels] -= 1
        share *= (weight / n)[:, None]
        back = (share @ w["out"].T) * (top > 0)
        place = value.argmax(1)  # windows x filters
        at = seen[np.arange(n)[:, None], place]  # windows x filters x inputs
        conv = np.einsum("nf,nfi->if", back, at) * mask
        inputs = np.einsum("nf,if->nfi", back, w["conv"]).reshape(-1, self.shape.embed)
        padded = np.concatenate((x, np.zeros((n, self.shape.widest - 1), np.uint8)), 1)
        bytes_ = padded[np.arange(n)[:, None, None], place[..., None] + np.arange(self.shape.widest)].ravel()
        table = np.zeros_like(w["table"])
        np.add.at(table, bytes_, inputs)
        table[0] = 0
        return {"table": table, "conv": conv, "conv0": back.sum(0), "out": on.T @ share, "out0": share.sum(0)}

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Shares of the languages for each text: the mean of its windows' log shares, and the prior. data: the bytes of
        all texts; bounds: where each begins, and the end."""
        shape, sizes = self.shape, np.diff(bounds)
        number = np.maximum(1, -(-(sizes - shape.widest + 1) // shape.step))
        doc = np.repeat(np.arange(len(sizes)), number)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
        start, end = bounds[doc] + within * shape.step, bounds[1:][doc]
        data = np.concatenate((CLASSES[data], np.zeros(shape.window, np.uint8)))
        sums = np.zeros((len(sizes), len(self.labels)))
        for at in range(0, len(doc), shape.block):
            x = start[at : at + shape.block, None] + np.arange(shape.window)
            windows = data[np.minimum(x, len(data) - 1)]
            windows[x >= end[at : at + shape.block, None]] = 0
            np.add.at(sums, doc[at : at + shape.block], self.log_shares(windows))
        return np.exp(log_softmax(sums / number[:, None] + self.prior))


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the key as text leaves `fold`; null keys aren't held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_windows(docs: DataFrame, key: str, text: str, lang: str, shape: Shape) -> tuple[list[tuple[str, int]], list[tuple[str, bytes]]]:
    """The learned languages with their numbers of documents, and at most `sample` windows with their language.

    Languages share the sample equally. Of each the documents with the least hashes of their text and key are taken, whose
    number is cut down by a limit on the hash before they are put in order; a document gives up to `per_document` windows,
    at places that depend on its hash.
    """
    can = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)) & F.col(text).rlike(LETTER))
    counts = can.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    known = [(r["lang"], r["n"]) for r in counts.orderBy(F.desc("n"), "lang").limit(shape.languages).collect()]
    if not known:
        return [], []
    each = max(1, shape.sample // len(known) // shape.per_document)
    spread = F.pmod(F.xxhash64(text, key), F.lit(1 << 30))
    limit = F.create_map(*(F.lit(v) for name, n in known for v in (name, int(min(1.0, (1.5 * each + 50) / n) * (1 << 30)))))
    near = can.select(F.col(lang).alias("lang"), spread.alias("spread"), F.encode(F.lower(text), "UTF-8").alias("bytes")).filter(F.col("spread") < limit[F.col("lang")])
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("spread", "bytes"))).filter(F.col("rank") <= each)
    places = F.array(*(F.pmod(F.col("spread") * (2 * k + 1) + k * 7919, F.greatest(F.lit(1), F.length("bytes") - shape.window + 1)) for k in range(shape.per_document)))
    cut = F.transform(F.array_distinct(places), lambda p: F.substring("bytes", p.cast("int") + 1, shape.window))
    rows = ranked.select("lang", F.explode(cut).alias("window"), "spread").collect()
    return known, sorted((r["lang"], bytes(r["window"])) for r in rows)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", shape: Shape = Shape()) -> Network | None:
    """The network, learned from a bounded sample of the documents that have a language and aren't held out; None if there
    are none. The prior is the languages' shares of all these documents."""
    known, rows = training_windows(docs, key, text, lang, shape)
    if not rows:
        return None
    labels = sorted(name for name, _ in known)
    n = np.array([dict(known)[x] for x in labels], float)
    net = Network.start(shape, labels, np.log(n / n.sum()))
    windows = np.zeros((len(rows), shape.window), np.uint8)
    for k, (_, window) in enumerate(rows):
        windows[k, : len(window)] = CLASSES[np.frombuffer(window, np.uint8)]
    found = np.array([labels.index(name) for name, _ in rows])
    weight = len(rows) / len(labels) / np.bincount(found, minlength=len(labels))[found]
    net.learn(windows, found, weight)
    return net


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", shape: Shape = Shape(), network: Network | None = None) -> DataFrame:
    """key, held_out, lang_pred, score of every document; a network is trained from docs unless one is given.

    The whole text, in lower case, is cut into windows that overlap by the widest filter; every window goes through the
    network, and the mean of their log shares, with the prior, decides. score is the language's share. A text that is null
    or has no letter is `und` with score 0; so are all if no document has a language to learn from. Repeated and null keys
    are documents of their own (a null key is neither held out nor learned from); other columns are ignored; an empty
    table gives no rows.
    """
    net = network or train(docs, key, text, lang, shape)
    kind = docs.schema[key].dataType.simpleString()
    lettered = F.col(text).rlike(LETTER)
    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.when(lettered, F.lower(text)).alias("text"))
    if net is None:
        return rows.select(F.col("key").alias(key), "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*net.labels, "und"])
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(2)
            some = pc.is_valid(texts).to_numpy(zero_copy_only=False)
            best, score = np.full(batch.num_rows, len(net.labels)), np.zeros(batch.num_rows)
            if some.any():
                joined = pc.drop_null(texts).cast(pa.large_binary())
                sizes = pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                shares = net.predict(np.frombuffer(b"".join(joined.to_pylist()), np.uint8), bounds)
                best[some], score[some] = shares.argmax(1), shares.max(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names.take(pa.array(best)), pa.array(score)], [key, "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"{key} {kind}, held_out boolean, lang_pred string, score double")
