"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs at each word are its own embedding (unknown words share one) and the mean embedding of its character trigrams.
Windows of ``WINDOW`` words overlap by half and cover the whole text; a document scores as its highest window, scaled
to a probability on the training sample.

The fit uses a bounded sample of labelled documents outside the held-out quarter (``sample`` rows, in hash order).
Executors count words in it, keep the odds of at most ``bound_words`` words bound to the toxic class, and pick at most
``per_document`` windows per document (two parameters of the fit, 2,048 and 3): the windows with the most class-bound
words, and others in hash order. Only those windows reach the driver, and only the document texts enter a score.

Defined cases: null texts, empty texts and texts without letters or digits score 0; texts shorter than a window are
one padded window; a document with several labels is toxic if any says so; a null doc_id is never held out and never
learned from; without both classes in the sample every score is 0; repeated rows are scored each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustscore.llm.words import SPACE, RollingHash, Words, find_words, list_array, mix, slices, text_buffer
from trustscore.session import materialized

WINDOW, STRIDE = 16, 8
HIDDEN, WORD_SIZE, CHAR_SIZE, ATTENTION = 8, 6, 6, 8
CHAR_BUCKETS = 4_096
BOUND_WORDS = 2_048  # words whose class odds guide the choice of training windows
PER_DOCUMENT = 3
SAMPLE = 6_000
HELD_OUT = 2
THRESHOLD = 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_KEPT = SPACE.copy()
_KEPT[0x30:0x3A] = _KEPT[0x41:0x5B] = _KEPT[0x61:0x7B] = _KEPT[0x80:] = True


def clean_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words in lower case without ASCII punctuation."""
    kept = _KEPT[data]
    places = np.concatenate([[0], np.cumsum(kept)])
    return find_words(_LOWER[data[kept]], places[offsets])


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of all windows of texts whose words begin at ``first``; the last one ends with the text."""
    sizes = np.diff(first)
    counts = np.where(sizes > 0, 1 + -(-np.maximum(sizes - WINDOW, 0) // STRIDE), 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.minimum(number * STRIDE, np.maximum(sizes[row] - WINDOW, 0)) + first[row]
    return row, start, np.minimum(sizes[row], WINDOW)


def char_buckets(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of the chosen words and how many each has; word ends count as spaces."""
    sizes = (words.ends - words.starts)[chosen]
    # A word of n bytes in spaces has n trigrams.
    place = np.repeat(words.starts[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    end = np.repeat(words.ends[chosen], sizes)
    begin = np.repeat(words.starts[chosen], sizes)
    padded = np.concatenate([[0x20], words.data, [0x20]]).astype(np.uint64)
    left = np.where(place == begin, np.uint64(0x20), padded[place])
    right = np.where(place + 1 == end, np.uint64(0x20), padded[place + 2])
    code = left << np.uint64(16) | padded[place + 1] << np.uint64(8) | right
    return (mix(code + np.uint64(1)) % np.uint64(CHAR_BUCKETS)).astype(np.int64), sizes


def _sigmoid(values: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * values) + 0.5


class Network:
    """Weights by name, the forward pass and its gradient."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        draw = np.random.default_rng(seed)
        size, inputs = HIDDEN, WORD_SIZE + CHAR_SIZE

        def random(*shape: int, scale: float = 0.3) -> np.ndarray:
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        self.vocabulary = vocabulary  # sorted word hashes; the last embedding is for all other words
        self.weights = {
            "words": random(len(vocabulary) + 1, WORD_SIZE, scale=0.1),
            "chars": random(CHAR_BUCKETS, CHAR_SIZE, scale=0.1),
            "attend": random(2 * size, ATTENTION),
            "attend_bias": np.zeros(ATTENTION, np.float32),
            "attend_out": random(ATTENTION),
            "out": random(2 * size),
            "out_bias": np.array([-1.0], np.float32),
        }
        for side in ("forward", "backward"):
            self.weights[f"{side}_in"] = random(inputs, 3 * size)
            self.weights[f"{side}_bias"] = np.zeros(3 * size, np.float32)
            self.weights[f"{side}_again"] = random(size, 3 * size)
        self.scale = np.array([1.0, 0.0])

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.vocabulary, hashes)
        unknown = len(self.vocabulary)
        known = place < unknown
        known[known] = self.vocabulary[place[known]] == hashes[known]
        return np.where(known, place, unknown)

    def inputs(self, numbers: np.ndarray, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words."""
        ends = np.cumsum(sizes)
        chars = np.add.reduceat(self.weights["chars"][buckets], ends - sizes, axis=0) / sizes[:, None]
        return np.concatenate([self.weights["words"][numbers], chars], axis=1).astype(np.float32)

    def _run(self, side: str, given: np.ndarray, at: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """Hidden states (steps, windows, hidden) for rows ``at`` (windows, steps) of the projected inputs."""
        again, count = self.weights[f"{side}_again"], len(at)
        state = np.zeros((count, HIDDEN), np.float32)
        states = np.empty((WINDOW, count, HIDDEN), np.float32)
        for step in range(WINDOW) if side == "forward" else range(WINDOW - 1, -1, -1):
            push = given[at[:, step]]
            pull = state @ again
            gates = _sigmoid(push[:, : 2 * HIDDEN] + pull[:, : 2 * HIDDEN])
            reset, stay = gates[:, :HIDDEN], gates[:, HIDDEN:]
            fresh = np.tanh(push[:, 2 * HIDDEN :] + reset * pull[:, 2 * HIDDEN :])
            after = fresh + stay * (state - fresh)
            if mask is not None:
                after = np.where(mask[:, step, None], after, state)
            if keep is not None:
                keep.append((step, state, pull, reset, stay, fresh))
            state = states[step] = after
        return states

    def forward(self, inputs: np.ndarray, at: np.ndarray, mask: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
        """Scores (log odds) of windows of word rows ``at``."""
        weights, runs = self.weights, {}
        hidden = []
        for side in ("forward", "backward"):
            given = inputs @ weights[f"{side}_in"] + weights[f"{side}_bias"]
            runs[side] = [] if keep is not None else None
            hidden.append(self._run(side, given, at, mask, runs[side]))
        both = np.concatenate(hidden, axis=2)
        look = np.tanh(both @ weights["attend"] + weights["attend_bias"])
        pull = look @ weights["attend_out"]
        if mask is not None:
            pull = np.where(mask.T, pull, -1e9)
        share = np.exp(pull - pull.max(axis=0))
        share /= share.sum(axis=0)
        pooled = (share[:, :, None] * both).sum(axis=0)
        if keep is not None:
            keep |= {"runs": runs, "both": both, "look": look, "share": share, "pooled": pooled}
        return pooled @ weights["out"] + weights["out_bias"][0]

    def gradient(self, inputs, at, mask, kept, slope) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of the input vectors for d(loss)/d(score) = ``slope``."""
        weights, found = self.weights, {}
        both, look, share, pooled = kept["both"], kept["look"], kept["share"], kept["pooled"]
        found["out"], found["out_bias"] = pooled.T @ slope, np.array([slope.sum()], np.float32)
        d_pooled = slope[:, None] * weights["out"]
        d_both = share[:, :, None] * d_pooled
        d_share = (both * d_pooled).sum(axis=2)
        d_pull = share * (d_share - (share * d_share).sum(axis=0))
        found["attend_out"] = (look * d_pull[:, :, None]).sum(axis=(0, 1))
        d_look = d_pull[:, :, None] * weights["attend_out"] * (1 - look**2)
        found["attend"] = both.reshape(-1, 2 * HIDDEN).T @ d_look.reshape(-1, ATTENTION)
        found["attend_bias"] = d_look.sum(axis=(0, 1))
        d_both = d_both + d_look @ weights["attend"].T
        d_inputs = np.zeros_like(inputs)
        for part, side in enumerate(("forward", "backward")):
            again = weights[f"{side}_again"]
            d_given = np.zeros((len(inputs), 3 * HIDDEN), np.float32)
            d_again = np.zeros_like(again)
            d_state = np.zeros((len(at), HIDDEN), np.float32)
            for step, state, pull, reset, stay, fresh in reversed(kept["runs"][side]):
                d_after = d_both[step, :, part * HIDDEN : (part + 1) * HIDDEN] + d_state
                open_ = mask[:, step, None]
                d_new = np.where(open_, d_after, 0)
                d_fresh = d_new * (1 - stay) * (1 - fresh**2)
                d_stay = d_new * (state - fresh) * stay * (1 - stay)
                d_reset = d_fresh * pull[:, 2 * HIDDEN :] * reset * (1 - reset)
                d_push = np.concatenate([d_reset, d_stay, d_fresh], axis=1)
                d_pull_now = np.concatenate([d_reset, d_stay, d_fresh * reset], axis=1)
                d_again += state.T @ d_pull_now
                d_state = np.where(open_, d_new * stay, d_after) + d_pull_now @ again.T
                np.add.at(d_given, at[:, step], d_push)
            found[f"{side}_again"], found[f"{side}_bias"] = d_again, d_given.sum(axis=0)
            found[f"{side}_in"] = inputs.T @ d_given
            d_inputs += d_given @ weights[f"{side}_in"].T
        return found, d_inputs

    def score_texts(self, data: np.ndarray, offsets: np.ndarray, windows_at_once: int = 4_096) -> np.ndarray:
        """The highest window score of each text; minus infinity for texts without words."""
        words = clean_words(data, offsets)
        best = np.full(len(offsets) - 1, -np.inf)
        if not len(words.hashes):
            return best
        distinct, chosen, number = np.unique(words.hashes, return_index=True, return_inverse=True)
        inputs = self.inputs(self.word_numbers(distinct), *char_buckets(words, chosen))
        row, start, size = window_starts(words.first)
        for whole in (True, False):
            own = np.flatnonzero((size == WINDOW) == whole)
            for low in range(0, len(own), windows_at_once):
                part = own[low : low + windows_at_once]
                steps = np.arange(WINDOW)
                mask = None if whole else steps < size[part, None]
                at = number[np.minimum(start[part, None] + steps, len(number) - 1)]
                np.maximum.at(best, row[part], self.forward(inputs, at, mask))
        return best

    def probability(self, scores: np.ndarray) -> np.ndarray:
        flat = np.where(np.isfinite(scores), scores, 0.0) * self.scale[0] + self.scale[1]
        return np.where(np.isfinite(scores), 1 / (1 + np.exp(-np.clip(flat, -50, 50))), 0.0)


def train(windows: list[list[bytes]], labels: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network:
    """A network fitted to labelled windows of clean words by Adam on the log loss."""
    flat = [word for window in windows for word in window]
    data = np.frombuffer(b" ".join(flat), dtype=np.uint8)
    words = find_words(data, np.array([0, len(data)]))
    sizes = np.array([len(window) for window in windows])
    first = np.cumsum(sizes) - sizes
    distinct, chosen, number = np.unique(words.hashes, return_index=True, return_inverse=True)
    twice = np.bincount(number) > 1
    network = Network(distinct[twice], seed)
    numbers = network.word_numbers(distinct)
    buckets, counts = char_buckets(words, chosen)
    edges = np.concatenate([[0], np.cumsum(counts)])
    draw = np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)).astype(np.float32)
    moments = {name: (np.zeros_like(value), np.zeros_like(value)) for name, value in network.weights.items()}
    turn = 0
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for low in range(0, len(order), batch):
            part = order[low : low + batch]
            steps = np.arange(WINDOW)
            mask = steps < sizes[part, None]
            rows = number[np.minimum(first[part, None] + steps, len(number) - 1)]
            used, at = np.unique(rows, return_inverse=True)
            at = at.reshape(rows.shape)
            own = np.concatenate([buckets[edges[u] : edges[u + 1]] for u in used])
            inputs = network.inputs(numbers[used], own, counts[used])
            kept: dict = {}
            score = network.forward(inputs, at, mask, kept)
            slope = ((_sigmoid(score) - labels[part]) * weight[part] / len(part)).astype(np.float32)
            found, d_inputs = network.gradient(inputs, at, mask, kept, slope)
            found["words"] = np.zeros_like(network.weights["words"])
            np.add.at(found["words"], numbers[used], d_inputs[:, :WORD_SIZE])
            found["chars"] = np.zeros_like(network.weights["chars"])
            spread = d_inputs[:, WORD_SIZE:] / counts[used][:, None]
            np.add.at(found["chars"], own, np.repeat(spread, counts[used], axis=0))
            turn += 1
            for name, slope_of in found.items():
                first_moment, second_moment = moments[name]
                first_moment += 0.1 * (slope_of - first_moment)
                second_moment += 0.001 * (slope_of**2 - second_moment)
                lead = first_moment / (1 - 0.9**turn)
                network.weights[name] -= rate * lead / (np.sqrt(second_moment / (1 - 0.999**turn)) + 1e-8)
    return network


def _sliced(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for start, stop in slices(offsets):
            part = offsets[start : stop + 1]
            yield batch.slice(start, stop - start), data[part[0] : part[-1]], part - part[0]


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in _sliced(batches):
        words = clean_words(data, offsets)
        own = [np.unique(words.hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]
        flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [rows.column("toxic"), list_array(flat.view(np.int64), np.array([len(o) for o in own]))], names=["toxic", "words"]
        )


def _training_windows(odds: dict[int, float], per_document: int = PER_DOCUMENT):
    """Arrow function: the windows of a document with the most class-bound words, others in hash order."""
    keys = np.array(sorted(odds), dtype=np.uint64)
    values = np.array([odds[int(key)] for key in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _sliced(batches):
            words = clean_words(data, offsets)
            bound = np.zeros(len(words.hashes) + 1)
            if len(keys) and len(words.hashes):
                place = np.minimum(np.searchsorted(keys, words.hashes), len(keys) - 1)
                bound[1:] = np.cumsum(np.where(keys[place] == words.hashes, values[place], 0.0))
            row, start, size = window_starts(words.first)
            strength = bound[start + size] - bound[start]
            chance = RollingHash(words.hashes).windows(start, start + size) if len(start) else np.zeros(0, np.uint64)
            content, toxic = words.data.tobytes(), rows.column("toxic").to_pylist()
            labels, found = [], []
            for number in range(len(offsets) - 1):
                low, high = np.searchsorted(row, (number, number + 1))
                if toxic[number]:
                    strong = low + np.argsort(-strength[low:high], kind="stable")[: per_document - 1]
                    picked = strong[strength[strong] > 0]
                else:
                    strong = low + np.argsort(-strength[low:high], kind="stable")[:1]
                    picked = np.unique(np.concatenate([strong, low + np.argsort(chance[low:high])[: per_document - 1]]))
                for window in picked.tolist():
                    spots = range(start[window], start[window] + size[window])
                    labels.append(int(toxic[number]))
                    found.append([content[words.starts[w] : words.ends[w]] for w in spots])
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int32()), pa.array(found, pa.list_(pa.binary()))], names=["toxic", "window"]
            )

    return run


def _scored(network: Network, keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _sliced(batches):
            yield pa.RecordBatch.from_arrays(
                [rows.column(keep), pa.array(network.score_texts(data, offsets))], names=[keep, "logit"]
            )

    return run


def held_out(doc_id: Column) -> Column:
    """The quarter of documents that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    per_document: int = PER_DOCUMENT,
    bound_words: int = BOUND_WORDS,
) -> Network | None:
    """A network from at most ``sample`` labelled documents outside the held-out quarter; None without both classes."""
    told = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` rows of two numbers: small enough to send everywhere.
    rows = materialized(documents.select("doc_id", "text").join(F.broadcast(told), "doc_id").select("doc_id", "text", "toxic"), "toxic-sample")
    words = rows.select("text", "toxic").mapInArrow(_distinct_words, "toxic int, words array<long>")
    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not totals[0] or totals[0] == totals[1]:
        return None
    bad, good = float(totals[0]), float(totals[1] - totals[0])
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    bound = (
        words.select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
        .where("bad >= 3")
        .select("word", odds.alias("odds"))
        .where("odds > 1")
        .orderBy(F.desc("odds"), "word")
        .limit(bound_words)
    )
    known = {int(np.int64(row.word).astype(np.uint64)): row.odds for row in bound.collect()}
    picked = rows.select("text", "toxic").mapInArrow(_training_windows(known, per_document), "toxic int, window array<binary>").toArrow()
    windows, marks = picked.column("window").to_pylist(), np.array(picked.column("toxic").to_pylist(), dtype=np.float32)
    order = sorted(range(len(windows)), key=lambda i: (marks[i], windows[i]))
    network = train([windows[i] for i in order], marks[order])
    scored = rows.select("text", "toxic").mapInArrow(_scored(network, "toxic"), "toxic int, logit double").toArrow()
    logits, marks = np.array(scored.column("logit")), np.array(scored.column("toxic"), dtype=float)
    order = np.lexsort((marks, logits))
    network.scale = _platt(logits[order], marks[order])
    return network


def _platt(scores: np.ndarray, labels: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Slope and shift that turn scores into probabilities (Newton steps with a small ridge)."""
    finite = np.isfinite(scores)
    inputs = np.stack([scores[finite], np.ones(finite.sum())], axis=1)
    labels = labels[finite]
    found = np.array([0.5, -1.0])
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(inputs @ found, -30, 30)))
        slope = inputs.T @ (chance - labels) + 1e-3 * found
        curve = (inputs * (chance * (1 - chance))[:, None]).T @ inputs + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        found = found - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return found


def score(
    documents: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    per_document: int = PER_DOCUMENT,
    bound_words: int = BOUND_WORDS,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; the other parameters bound the fit alone."""
    network = fit(documents, labels, sample, per_document, bound_words)
    rows = documents.select("doc_id", "text")
    if network is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _scored(network, "doc_id")(batches):
                chances = network.probability(batch.column("logit").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chances)], names=["doc_id", "score"])

        scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
