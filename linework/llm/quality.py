"""Quality classifier: a linear-chain conditional random field over the lines of a document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linework.llm.common import runs_of, small_batches, with_text
from linework.sources.scratch import save

#: Learning is bounded: this many labelled documents, whole (those least by hash of their text), and this many lines of
#: them all (some 100 MB of features); a document of over a tenth of that isn't learned from.
SAMPLE_DOCS, SAMPLE_LINES = 2000, 200_000
#: A training text is learned as chains of this many consecutive lines.
CHAIN = 64
#: Lines, padding counted, that inference holds at once; chains of more lines than LONG go alone.
GROUP_LINES, LONG = 200_000, 4096
ROUNDS, RATE, PENALTY = 250, 0.1, 1e-3
FEATURES = 19
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_STOPS, _SYMBOLS = b".,;:'\"()-?", b"!#$%&*+/<=>@[\\]^_`{|}~"
_HIGH = bytes(range(128, 256))


def _line(line: str, before: set, seen: Counter) -> tuple[tuple[float, ...], set]:
    b = line.encode()
    n, tokens = len(b), line.split()
    k, own = len(tokens), set(tokens)
    share = lambda chars: (n - len(b.translate(None, chars))) / (n or 1)
    pairs = len(set(zip(tokens, tokens[1:], strict=False)))
    return (
        1.0, np.log1p(n), share(_UPPER), share(_LOWER), share(_DIGIT), share(_STOPS), share(_SYMBOLS), share(_HIGH), share(b"!"), share(b"|"),
        len(own) / (k or 1), pairs / max(1, k - 1), n / (k or 1) / 10, np.log1p(k), float(k < 3), float(seen[line] > 1 and k > 2),
        float(b[-1:] in (b".", b"?", b'"')), len(own & before) / (len(own) or 1), np.log((k + 1) / (len(own) + 1)),
    ), own


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of the lines of a text; an empty or null text is one empty line."""
    lines = (text or "").split("\n")
    seen, before, rows = Counter(lines), set(), []
    for line in lines:
        row, before = _line(line, before, seen)
        rows.append(row)
    return np.array(rows, np.float32), np.array([len(x) + 1 for x in lines], np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and of the line after (zeros at the ends)."""
    gap = np.zeros((1, x.shape[1]), x.dtype)
    return np.hstack([x, np.vstack([gap, x[:-1]]), np.vstack([x[1:], gap])])


@dataclass
class Model:
    """Weights of the state 'good' on standardised features, transition scores, calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def node_scores(self, x: np.ndarray) -> np.ndarray:
        return ((with_neighbours(x) - self.mean) / self.scale) @ self.weights

    def marginals(self, nodes: list[np.ndarray]) -> list[np.ndarray]:
        """P(good) of each line; chains of like length go together, in groups of bounded memory."""
        order, out, at = sorted(range(len(nodes)), key=lambda i: -len(nodes[i])), [None] * len(nodes), 0
        while at < len(order):
            longest = len(nodes[order[at]])
            if longest > LONG:
                out[order[at]], at = long_marginals(nodes[order[at]], self.moves), at + 1
                continue
            group = order[at : at + max(1, GROUP_LINES // max(1, longest))]
            for i, (p, _) in zip(group, forward_backward([nodes[i] for i in group], self.moves, False), strict=True):
                out[i] = p
            at += len(group)
        return out

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The share of each document that stands in good lines, calibrated; 0 to 1."""
        good = self.marginals([self.node_scores(x) for x, _ in docs])
        raw = np.array([float(np.average(p, weights=w)) for p, (_, w) in zip(good, docs, strict=True)])
        return _sigmoid(self.slope * _logit(raw) + self.shift)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _ahead(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The forward scores of one long chain (lines, 2), in about the root of its length in steps.

    Each block's products of moves are taken for all blocks at once, then blocks follow each other,
    and the scores inside are what comes in times the product so far.
    """
    lines = len(score)
    size = max(1, int(np.sqrt(lines)))
    blocks = -(-lines // size)
    steps = np.full((blocks * size, 2, 2), -np.inf)
    steps[:, 0, 0] = steps[:, 1, 1] = 0.0  # what pads the last block changes nothing
    steps[:lines] = moves + score[:, None, :]
    steps[0] = score[0]  # the first line comes from nowhere
    steps = steps.reshape(blocks, size, 2, 2)
    times = lambda a, b: np.logaddexp(a[..., 0, None] + b[..., None, 0, :], a[..., 1, None] + b[..., None, 1, :])
    for t in range(1, size):
        steps[:, t] = times(steps[:, t - 1], steps[:, t])
    into, at = np.empty((blocks, 2)), np.array([0.0, -np.inf])
    for n in range(blocks):
        into[n] = at
        at = np.logaddexp(at[0] + steps[n, -1, 0], at[1] + steps[n, -1, 1])
    into = into[:, None, :]
    return np.logaddexp(into[..., 0, None] + steps[..., 0, :], into[..., 1, None] + steps[..., 1, :]).reshape(-1, 2)[:lines]


def long_marginals(node: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(good) of each line of one long chain: forwards, and forwards over the reversed chain."""
    score = np.stack([np.zeros(len(node)), node], axis=1)
    with np.errstate(invalid="ignore"):
        total = _ahead(score, moves) + _ahead(score[::-1], moves.T)[::-1] - score
    return _sigmoid(total[:, 1] - total[:, 0])


def forward_backward(nodes: list[np.ndarray], moves: np.ndarray, counted: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each chain: P(good) of each line and, if counted, the expected number of each of the four moves.

    nodes: a chain's scores of 'good' against 'bad' (0).  Chains go step by step side by side,
    longest first, so that those still running are a prefix.
    """
    order = sorted(range(len(nodes)), key=lambda i: -len(nodes[i]))
    lengths = np.array([len(nodes[i]) for i in order])
    steps, wide = int(lengths[0]) if len(order) else 0, len(order)
    score = np.zeros((steps, wide, 2))
    for col, i in enumerate(order):
        score[: len(nodes[i]), col, 1] = nodes[i]
    live = wide - np.searchsorted(lengths[::-1], np.arange(1, steps + 1))
    ahead, back = score.copy(), np.zeros_like(score)
    for t in range(1, steps):
        n = live[t]
        ahead[t, :n] += np.logaddexp(ahead[t - 1, :n, 0, None] + moves[0], ahead[t - 1, :n, 1, None] + moves[1])
    for t in range(steps - 2, -1, -1):
        n = live[t + 1]
        later = score[t + 1, :n] + back[t + 1, :n]
        back[t, :n] = np.logaddexp(later[:, 0, None] + moves[:, 0], later[:, 1, None] + moves[:, 1])
    total = ahead + back
    good = _sigmoid(total[:, :, 1] - total[:, :, 0])
    expected = np.zeros((wide, 2, 2))
    for t in range(1, steps if counted else 0):
        n = live[t]
        pair = ahead[t - 1, :n, :, None] + moves + (score[t, :n] + back[t, :n])[:, None, :]
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        expected[:n] += pair / pair.sum(axis=(1, 2), keepdims=True)
    out: list = [None] * wide
    for col, i in enumerate(order):
        out[i] = (good[: len(nodes[i]), col], expected[col])
    return out


def fit(chains: list[np.ndarray], weights: list[np.ndarray], labels: list[int]) -> Model:
    """Maximum likelihood with a quadratic penalty; each line carries its document's label.

    Every line is learned with its real neighbours' features; a text is chains of CHAIN lines in a
    row, which leave out only the moves between them.
    One class alone, or no rows, gives a model that says the share of good labels everywhere.
    """
    if len(set(labels)) < 2:
        share = float(np.mean(labels)) if labels else 0.5
        width = FEATURES * 3
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 0.0, float(_logit(np.array(share))))
    whole, x, owner = [with_neighbours(c) for c in chains], [], []
    for n, c in enumerate(whole):
        x += [c[at : at + CHAIN] for at in range(0, len(c), CHAIN)]
        owner += [labels[n]] * -(-len(c) // CHAIN)
    flat = np.vstack(x).astype(np.float64)
    mean, scale = flat.mean(axis=0), flat.std(axis=0)
    mean[scale < 1e-9], scale[scale < 1e-9] = 0.0, 1.0
    flat = (flat - mean) / scale
    ends = np.cumsum([len(c) for c in x])
    target = np.repeat(np.array(owner, float), [len(c) for c in x])
    held = np.zeros((2, 2))
    for c, y in zip(x, owner, strict=True):
        held[y, y] += len(c) - 1
    theta, first, second = np.zeros(flat.shape[1] + 4), 0.0, 0.0
    for k in range(1, ROUNDS + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        found = forward_backward(np.split(flat @ w, ends[:-1]), moves)
        error = target - np.concatenate([p for p, _ in found])
        pull = np.concatenate([flat.T @ error, (held - sum(e for _, e in found)).ravel()]) / len(flat) - PENALTY * theta
        pull[-4:] -= 0.02 * theta[-4:]  # documents never mix labels in training, texts may
        first, second = 0.9 * first + 0.1 * pull, 0.99 * second + 0.01 * pull**2
        theta += RATE * (1 - k / (ROUNDS + 1)) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
    raw = _logit(model.score(list(zip(chains, weights, strict=True))))
    y, slope, shift = np.array(labels, float), 1.0, 0.0
    for _ in range(200):
        p = _sigmoid(slope * raw + shift)
        slope += 0.5 * (float(np.mean((y - p) * raw)) / max(1.0, float(np.mean(raw**2))) - 1e-3 * (slope - 1))
        shift += 0.5 * float(np.mean(y - p))
    model.slope, model.shift = max(slope, 0.05), shift
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, stop in runs_of(batch.column(1)):
            part = batch.slice(at, stop - at)
            made = [line_features(t) for t in part.column(1).to_pylist()]
            blobs = [pa.array([m[n].tobytes() for m in made], pa.binary()) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *blobs], ["good", "x", "w"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on SAMPLE_DOCS labelled documents at most, whole, each text once for each label, of SAMPLE_LINES lines at most
    together; texts of over a tenth of that are not among them.

    Ids with a null or with two different labels are left out.  The bound is on rows: ids are chosen by
    hash first, so that only theirs are joined, then texts, since an id may stand for many.
    """
    sure = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("good"), F.max(label_col).alias("most")).where("good = most")
    chosen = sure.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).select("id", F.col("good").cast("int").alias("good"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    once = texts.join(F.broadcast(chosen), "id").groupBy("good", F.xxhash64("text").alias("th")).agg(F.first("text").alias("text"))
    once = save(once, "labelled-texts")
    lines = F.length(F.regexp_replace("text", "[^\n\r]", "")) + 1
    bound = once.select("th", "good", lines.alias("lines")).where(F.col("lines") <= SAMPLE_LINES // 10).orderBy("th", "good").limit(SAMPLE_DOCS)
    upto = F.sum("lines").over(Window.partitionBy(F.lit(0)).orderBy("th", "good"))  # SAMPLE_DOCS rows at most
    bound = bound.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_LINES).select("th", "good")
    rows = once.join(F.broadcast(bound), ["th", "good"], "left_semi").select("good", "text").transform(small_batches).mapInArrow(_features, "good int, x binary, w binary").collect()
    found = sorted((r["good"], bytes(r["x"]), bytes(r["w"])) for r in rows)
    return fit([np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, x, _ in found], [np.frombuffer(w) for _, _, w in found], [g for g, _, _ in found])


def _scorer(model: Model, kept: list[str], texts: Callable[[pa.RecordBatch], pa.Array]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in runs_of(texts(batch), 1_000_000, 512):
                part = batch.slice(at, stop - at)
                scores = model.score([line_features(t.as_py()) for t in texts(part)])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(scores, pa.float64())], [*kept, "score"])

    return run


def classify(docs: DataFrame, model: Model, columns: list[Column], text_col: str = "text", text_in: str | None = None) -> DataFrame:
    """columns of docs, then score (0 to 1) and predicted (1 if score >= 0.5), from whole texts.

    Null and empty texts are one empty line and get a score too.  Of columns, those named like a
    column of the result give way to it; other columns of docs are ignored.  text_in: a struct among
    columns that has the text.  Repeated rows and empty tables pass through.
    """
    rows, kept, texts = with_text(docs, columns, text_col, ("score", "predicted"), text_in)
    fields = [*rows.schema.fields[: len(kept)], T.StructField("score", T.DoubleType())]
    scored = rows.mapInArrow(_scorer(model, kept, texts), T.StructType(fields))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
