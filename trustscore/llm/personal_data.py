"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns find the base spans; they always stay. The field has one node for every token with a digit or an at sign.
Neighbouring nodes share chain potentials; distant nodes of one document that repeat each other (the same token, or
the same digits in another notation) share skip potentials. Unary weights and potentials are learned from counts over
all documents, with the base spans as labels: a table of discrete feature sets, so the driver sees no text. Loopy
message passing then runs until the messages of a document settle and makes labels agree across it, and tokens that the patterns missed (a phone number
repeated without its plus sign, a card number with other separators) become spans too.

An added span must be linked through repeats to a base span of its kind in the same document, hold a posterior of
``threshold``, and look whole (an at sign, four dotted parts, 12 digits of a card, 7 digits of a phone number).

Defined cases: null and empty texts have no spans; a token repeated many times is linked occurrence by occurrence,
and each to the first occurrence under a base span, so links grow with the text and evidence does not fade with
distance; a document whose messages do not settle in ``ROUNDS`` rounds keeps the last ones and has ``converged`` false; without any base span in the table nothing is added; repeated rows are documents each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
ROUNDS = 2_000  # a document that has not settled by then is reported as not converged
TOLERANCE = 1e-4  # of the largest change of a message in log space
DAMPING = 0.5
CLAMP = 8.0
CHAIN, SKIP, ANCHOR = 0, 1, 2  # an anchor sends evidence to its repeats and takes none, so they cannot outvote it
LIMITS = {"chain": 1.5, "skip": 3.0}

_CANDIDATE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: inside the run it would need what follows the run.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CORE = re.compile(r"[A-Za-z0-9].*[A-Za-z0-9]|[A-Za-z0-9]", re.S)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind."""
    spans: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            spans.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    for found in _IP.finditer(text):
        if all(int(part) <= 255 for part in found.group().split(".") if len(part.lstrip("0")) <= 3) and all(
            len(part.lstrip("0")) <= 3 for part in found.group().split(".")
        ):
            spans.append((found.start(), 1, found.end()))
    for found in _CARD.finditer(text):
        digits = "".join(_DIGIT.findall(found.group()))
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((found.start(), 2, found.end()))
    for found in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(found.group())) <= 15:
            spans.append((found.start(), 3, found.end()))
    return sorted(spans)


#: Sizes of the discrete features of a token; their product bounds the table of counts.
FEATURES = (9, 5, 2, 2, 3, 3, 2, 2, 2)
_OFFSETS = np.concatenate([[0], np.cumsum(FEATURES)])


def token_features(token: str) -> tuple[int, ...]:
    digits = "".join(_DIGIT.findall(token))
    count = len(digits)
    letters = sum(character.isalpha() for character in token)
    parts = token.strip(".,;:!?()[]{}\"'*#$%&").split(".")
    return (
        0 if count == 0 else 1 if count < 2 else 2 if count < 3 else 3 if count < 5 else 4 if count < 9 else 5 if count < 12 else 6
        if count < 16
        else 7
        if count < 20
        else 8,
        min(4, token.count(".")),
        int("@" in token),
        int(token.startswith("+")),
        0 if not letters else 1 if 2 * letters < len(token) else 2,
        min(2, token.count("-")),
        int("(" in token),
        int(12 <= count <= 19 and luhn(digits)),
        int(len(parts) == 4 and all(part.isdecimal() and len(part) <= 3 and int(part) <= 255 for part in parts)),
    )


class Graph:
    """Nodes and edges of one document."""

    def __init__(self, text: str, spans: list[Span]):
        self.tokens: list[tuple[int, int]] = []
        self.features: list[tuple[int, ...]] = []
        self.labels: list[int] = []  # label of the base span over the token, 0 if none
        self.edges: list[tuple[int, int, int]] = []  # from, to, CHAIN or SKIP
        self.anchors: list[tuple[int, int, int]] = []  # from the first occurrence under a base span to its repeats
        last_seen: dict[str, int] = {}
        seen: dict[str, list[int]] = {}
        previous_end, pointer = -1, 0
        for found in _TOKEN.finditer(text):
            token = found.group()
            if not _CANDIDATE.search(token):
                previous_end = -1
                continue
            here, (start, end) = len(self.tokens), found.span()
            self.tokens.append((start, end))
            self.features.append(token_features(token))
            while pointer < len(spans) and spans[pointer][2] <= start:
                pointer += 1
            label, look = 0, pointer
            while look < len(spans) and spans[look][0] < end:
                if spans[look][2] > start:
                    label = spans[look][1] + 1
                    break
                look += 1
            self.labels.append(label)
            if previous_end >= 0:
                self.edges.append((here - 1, here, CHAIN))
            previous_end = end
            for key in self._keys(token):
                if key in last_seen:
                    self.edges.append((last_seen[key], here, SKIP))
                last_seen[key] = here
                seen.setdefault(key, []).append(here)
        for places in seen.values():
            first = next((number for number, place in enumerate(places) if self.labels[place]), None)
            if first is not None:  # its neighbours in the chain are linked to it already
                far = places[: max(0, first - 1)] + places[first + 2 :]
                self.anchors += [(places[first], place, ANCHOR) for place in far]

    @staticmethod
    def _keys(token: str) -> set[str]:
        core = _CORE.search(token)
        digits = "".join(_DIGIT.findall(token))
        keys = set()
        if core and (len(digits) >= 3 or "@" in token):
            keys.add("t" + core.group().lower())
        if len(digits) >= 7:
            keys.add("d" + digits)
            keys.add("d" + digits[-7:])
        return keys


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: how often feature sets and pairs of linked labels occur."""
    for batch in batches:
        seen: Counter = Counter()
        for value in batch.column("text"):
            text = value.as_py()
            if not text or not _CANDIDATE.search(text):
                continue
            graph = Graph(text, base_spans(text))
            seen.update(("node", label, 0, "".join(map(str, found))) for found, label in zip(graph.features, graph.labels))
            for a, b, kind in graph.edges:
                seen["skip" if kind == SKIP else "chain", graph.labels[a], graph.labels[b], ""] += 1
        rows = [(*key, n) for key, n in seen.items()]
        columns = list(zip(*rows)) if rows else [[], [], [], [], []]
        types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, types)], names=["what", "a", "b", "features", "n"]
        )


class Field:
    """Weights of the random field."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.potentials = weights, np.stack([chain, skip, skip])

    @staticmethod
    def _one_hot(features: np.ndarray) -> np.ndarray:
        flat = np.zeros((len(features), _OFFSETS[-1] + 1))
        flat[:, -1] = 1
        for column, offset in enumerate(_OFFSETS[:-1]):
            flat[np.arange(len(features)), offset + features[:, column]] = 1
        return flat

    @classmethod
    def fitted(cls, rows: list[tuple[str, int, int, str, int]], rounds: int = 400, rate: float = 1.0, decay: float = 1e-3):
        """Softmax weights by gradient descent on the counts; potentials as clipped mutual information.

        Before any count, neighbours are independent and repeats agree.
        """
        pairs = {"chain": np.full((LABELS, LABELS), 20.0), "skip": 1.0 + 49.0 * np.eye(LABELS)}
        table: dict[str, np.ndarray] = {}
        for what, a, b, features, n in sorted(rows):
            if what == "node":
                table.setdefault(features, np.zeros(LABELS))[a] += n
            else:
                pairs[what][a, b] += n
                pairs[what][b, a] += n
        weights = np.zeros((_OFFSETS[-1] + 1, LABELS))
        if table:
            inputs = cls._one_hot(np.array([[int(c) for c in features] for features in table]))
            wanted = np.sqrt(np.stack(list(table.values())))  # frequent sets must not drown rare ones
            total = wanted.sum()
            for _ in range(rounds):
                scores = inputs @ weights
                scores = np.exp(scores - scores.max(axis=1, keepdims=True))
                scores /= scores.sum(axis=1, keepdims=True)
                slope = inputs.T @ (wanted - scores * wanted.sum(axis=1, keepdims=True)) / total
                weights += rate * (slope - decay * weights)
        shared = []
        for kind in ("chain", "skip"):
            joint = pairs[kind] / pairs[kind].sum()
            alone = joint.sum(axis=1)
            shared.append(np.clip(np.log(joint / np.outer(alone, alone)), -LIMITS[kind], LIMITS[kind]))
        return cls(weights, *shared)

    def unary(self, features: list[tuple[int, ...]]) -> np.ndarray:
        return self._one_hot(np.array(features, dtype=np.int64)) @ self.weights

    def marginals(self, unary: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return self.settled(unary, edges, np.zeros(len(unary), dtype=np.int64))[0]

    def settled(self, unary: np.ndarray, edges: np.ndarray, graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loopy sum-product message passing over all graphs of a batch at once, each until its messages settle.

        ``graph`` is the number of each node's graph. Returns the marginals and the numbers of the graphs that have
        not settled after ``ROUNDS`` rounds.
        """
        final, live = unary.copy(), edges
        messages = np.zeros((2, len(edges), LABELS))  # forward and backward
        for _ in range(ROUNDS):
            if not len(live):
                break
            total = unary.copy()
            np.add.at(total, live[:, 1], messages[0])
            np.add.at(total, live[:, 0], messages[1])
            potentials = self.potentials[live[:, 2]]
            fresh = np.empty_like(messages)
            for way, source, table in ((0, 0, potentials), (1, 1, potentials.transpose(0, 2, 1))):
                scores = (total[live[:, source]] - messages[1 - way])[:, :, None] + table
                top = scores.max(axis=1, keepdims=True)
                fresh[way] = np.log(np.exp(scores - top).sum(axis=1)) + top[:, 0]
            fresh -= fresh.max(axis=2, keepdims=True)
            fresh[1, live[:, 2] == ANCHOR] = 0
            change = np.abs(fresh - messages).max(axis=(0, 2))
            messages = DAMPING * messages + (1 - DAMPING) * fresh
            moving = np.isin(graph[live[:, 0]], graph[live[change > TOLERANCE, 0]])
            if not moving.all():
                np.add.at(final, live[~moving, 1], messages[0, ~moving])
                np.add.at(final, live[~moving, 0], messages[1, ~moving])
                live, messages = live[moving], messages[:, moving]
        np.add.at(final, live[:, 1], messages[0])
        np.add.at(final, live[:, 0], messages[1])
        final = np.exp(final - final.max(axis=1, keepdims=True))
        return final / final.sum(axis=1, keepdims=True), np.unique(graph[live[:, 0]])


def _repeats_of_base(graph: Graph) -> list[set[int]]:
    """Kinds of base spans that each node is linked to through repeats."""
    parent = list(range(len(graph.tokens)))

    def root(node: int) -> int:
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    for a, b, kind in graph.edges:
        if kind == SKIP:
            parent[root(a)] = root(b)
    kinds: dict[int, set[int]] = {}
    for node, label in enumerate(graph.labels):
        if label:
            kinds.setdefault(root(node), set()).add(label)
    return [kinds.get(root(node), set()) for node in range(len(parent))]


def _whole(piece: str, kind: int) -> bool:
    digits = len(_DIGIT.findall(piece))
    return ("@" in piece, piece.count(".") == 3, digits >= 12, digits >= 7)[kind]


def _added(text: str, graph: Graph, marginals: np.ndarray, spans: list[Span], threshold: float) -> list[Span]:
    linked = _repeats_of_base(graph)
    found: list[Span] = []
    run: list[int] = []

    def finish() -> None:
        if run:
            label = int(marginals[run[0]].argmax())
            start, end = graph.tokens[run[0]][0], graph.tokens[run[-1]][1]
            core = _CORE.search(text, start, end)
            if core and _whole(core.group(), label - 1):
                if not any(s < core.end() and core.start() < e for s, _, e in spans):
                    found.append((core.start(), label - 1, core.end()))
            run.clear()

    for node in range(len(graph.tokens)):
        label = int(marginals[node].argmax())
        fits = label and not graph.labels[node] and marginals[node, label] >= threshold and label in linked[node]
        if run and (not fits or label != int(marginals[run[0]].argmax()) or _TOKEN.search(text, graph.tokens[node - 1][1], graph.tokens[node][0])):
            finish()
        if fits:
            run.append(node)
    finish()
    return found


def _searched(known: Field, threshold: float):
    schema_names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "added", "converged"]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def shown(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for offset in range(0, whole.num_rows, 512):
                batch = whole.slice(offset, 512)
                base: list[list[Span]] = []
                added: list[list[Span]] = []
                converged = [True] * batch.num_rows
                graphs: list[tuple[int, str, Graph]] = []
                for number, value in enumerate(batch.column("text")):
                    text = value.as_py() or ""
                    spans = base_spans(text) if _CANDIDATE.search(text) else []
                    base.append(spans)
                    added.append([])
                    if spans:
                        graphs.append((number, text, Graph(text, spans)))
                if graphs:
                    sizes = np.cumsum([0, *(len(graph.tokens) for _, _, graph in graphs)])
                    unary = known.unary([found for _, _, graph in graphs for found in graph.features])
                    labels = np.array([label for _, _, graph in graphs for label in graph.labels])
                    unary[np.flatnonzero(labels), labels[labels > 0]] += CLAMP
                    edges = [
                        (a + int(size), b + int(size), kind)
                        for size, (_, _, graph) in zip(sizes, graphs)
                        for a, b, kind in graph.edges + graph.anchors
                    ]
                    owner = np.repeat([number for number, _, _ in graphs], np.diff(sizes))
                    marginals, open_ones = known.settled(unary, np.array(edges, dtype=np.int64).reshape(-1, 3), owner)
                    for number in open_ones.tolist():
                        converged[number] = False
                    for size, (number, text, graph) in zip(sizes, graphs):
                        own = marginals[size : size + len(graph.tokens)]
                        added[number] = _added(text, graph, own, base[number], threshold)
                counts = [[sum(s[1] == kind for s in spans) for spans in base] for kind in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        *[pa.array(n, pa.int64()) for n in counts],
                        pa.array([shown(spans) for spans in base], span),
                        pa.array([shown(spans) for spans in added], span),
                        pa.array(converged, pa.bool_()),
                    ],
                    names=schema_names,
                )

    return run


def fit(documents: DataFrame) -> Field:
    """The field learned from all documents; only counts reach the driver."""
    seen = documents.select("text").where(F.col("text").rlike("[0-9@]")).mapInArrow(
        _counts, "what string, a int, b int, features string, n long"
    )
    rows = seen.groupBy("what", "a", "b", "features").agg(F.sum("n").alias("n")).collect()
    return Field.fitted([tuple(row) for row in rows])


def find(documents: DataFrame, known: Field | None = None, threshold: float = 0.9) -> DataFrame:
    """``doc_id``, counts of base spans per kind, and the spans: ``base`` and ``added`` (kind, start, end in code points).

    ``converged`` is false where the messages of the document did not settle.
    """
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return documents.select("doc_id", "text").mapInArrow(
        _searched(known or fit(documents), threshold),
        f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base {spans}, added {spans}, converged boolean",
    )
