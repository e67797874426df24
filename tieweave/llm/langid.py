"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of WINDOW bytes. In each window a network of
HIDDEN units reads forwards and another one backwards, both states label every byte
position with class probabilities, and a document's score is the mean over all its
positions, whole text. The network is trained in numpy by backpropagation through time.

Training reads a bounded sample: SAMPLE_ROWS labelled rows at most (one for each language
if there are more languages than that), dealt evenly over all languages, those with the
least hashes of their ids; their whole texts come to the driver. Every window of them is
learnt from, and a language's windows count as much as another's. Everything is seeded,
so a fit is repeatable. Prediction needs no shuffle.

Defined results: a text that is null or has no letter gets ``und`` and score 0; so does
any text if there is nothing to learn from; a very long text is read whole; repeated rows
and null ids get results of their own; rows with a null language are predicted but not
learnt from; an empty table gives no rows; other columns are not read by ``predict`` and
pass through ``keep_known``, and an id column that has the name of a result comes back
with ``_id`` after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

WINDOW = 64
HIDDEN = 8
#: Labelled rows, and bytes of their texts, that a fit may read, over all languages.
SAMPLE_ROWS, SAMPLE_BYTES = 480, 1_600_000
#: Passes over the sample's windows.
EPOCHS = 8
BATCH = 256
RATE = 0.02
UNDETERMINED = "und"
#: Windows that run side by side.
SIDE_BY_SIDE = 4096
#: Stands after the end of a text in its last window; labels there don't count.
PADDING = 256
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))



@dataclass
class Network:
    """Weights by direction (0 forwards, 1 backwards); gates in the order update, reset, candidate."""

    languages: list[str]
    inputs: np.ndarray  # (2, 257, 3 * hidden): what each byte adds, with the bias
    recurrent: np.ndarray  # (2, hidden, 3 * hidden)
    output: np.ndarray  # (2 * hidden, languages)
    bias: np.ndarray  # (languages,)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.output, self.bias]


def new_network(languages: list[str], hidden: int, random: np.random.Generator) -> Network:
    def normal(scale: float, *shape: int) -> np.ndarray:
        return random.normal(0, scale, shape).astype(np.float32)

    return Network(
        languages,
        normal(0.5, 2, PADDING + 1, 3 * hidden),
        normal(1 / np.sqrt(hidden), 2, hidden, 3 * hidden),
        normal(1 / np.sqrt(hidden), 2 * hidden, len(languages)),
        np.zeros(len(languages), dtype=np.float32),
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def states(net: Network, windows: np.ndarray, direction: int, keep: list | None = None) -> np.ndarray:
    """States after each position, (window length, windows, hidden).

    windows: (window length, windows), bytes. keep: gets what backpropagation needs.
    """
    steps, n = windows.shape
    h = net.recurrent.shape[1]
    out = np.empty((steps, n, h), dtype=np.float32)
    state = np.zeros((n, h), dtype=np.float32)
    gates_in, candidate_in = net.recurrent[direction][:, : 2 * h], net.recurrent[direction][:, 2 * h :]
    table = net.inputs[direction]
    for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
        given = table[windows[t]]
        gates = sigmoid(given[:, : 2 * h] + state @ gates_in)
        update, reset = gates[:, :h], gates[:, h:]
        candidate = np.tanh(given[:, 2 * h :] + (reset * state) @ candidate_in)
        if keep is not None:
            keep.append((t, state, update, reset, candidate))
        state = state + update * (candidate - state)
        out[t] = state
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=-1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=-1, keepdims=True)
    return scores


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy over all labelled positions, through time.

    windows: (window length, windows); labels, weights: one for each window.
    """
    h = net.recurrent.shape[1]
    kept: tuple[list, list] = ([], [])
    both = np.concatenate([states(net, windows, d, kept[d]) for d in (0, 1)], axis=2)
    wrong = softmax(both @ net.output + net.bias)
    counts = (windows != PADDING) * weights
    wrong[:, np.arange(windows.shape[1]), labels] -= 1
    wrong *= (counts / max(counts.sum(), 1e-9))[:, :, None].astype(np.float32)
    flat = wrong.reshape(-1, wrong.shape[2])
    out = [np.zeros_like(net.inputs), np.zeros_like(net.recurrent), both.reshape(-1, 2 * h).T @ flat, flat.sum(axis=0)]
    back = wrong @ net.output.T
    for d in (0, 1):
        recurrent = net.recurrent[d]
        passed = np.zeros((windows.shape[1], h), dtype=np.float32)
        for t, before, update, reset, candidate in reversed(kept[d]):
            grad = back[t, :, d * h : (d + 1) * h] + passed
            to_candidate = grad * update * (1 - candidate * candidate)
            to_update = grad * (candidate - before) * update * (1 - update)
            through = to_candidate @ recurrent[:, 2 * h :].T
            to_reset = through * before * reset * (1 - reset)
            gates = np.concatenate([to_update, to_reset], axis=1)
            passed = grad * (1 - update) + through * reset + gates @ recurrent[:, : 2 * h].T
            out[1][d][:, : 2 * h] += before.T @ gates
            out[1][d][:, 2 * h :] += (reset * before).T @ to_candidate
            np.add.at(out[0][d], windows[t], np.concatenate([gates, to_candidate], axis=1))
    return out


def train(rows: list[tuple[bytes, str]], *, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> Network | None:
    """A network fitted to texts with their languages (Adam); None without a text."""
    rows = [(raw, lang) for raw, lang in rows if raw]
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    windows, owners = cut_windows([raw for raw, _ in rows])
    labels = np.array([number[lang] for _, lang in rows])[owners]
    weights = (len(windows) / len(languages) / np.bincount(labels, minlength=len(languages)))[labels]
    random = np.random.default_rng(seed)
    net = new_network(languages, hidden, random)
    first, second = [np.zeros_like(x) for x in net.parts], [np.zeros_like(x) for x in net.parts]
    step, steps = 0, epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = random.permutation(len(windows))
        for at in range(0, len(windows), batch):
            own = order[at : at + batch]
            step += 1
            now = rate * (1 - step / (steps + 1))
            for x, g, m, v in zip(net.parts, gradients(net, windows[own].T, labels[own], weights[own]), first, second):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, owners): all windows of all texts, (windows, WINDOW), and the text of each."""
    counts = np.array([len(x) for x in texts], dtype=np.int64)
    per_text = -(-counts // WINDOW)
    padded = b"".join(x.ljust(int(n) * WINDOW, b"\0") for x, n in zip(texts, per_text))
    windows = np.frombuffer(padded, dtype=np.uint8).reshape(-1, WINDOW).astype(np.int16)
    used = np.full(len(windows), WINDOW)
    full = per_text > 0
    used[np.cumsum(per_text)[full] - 1] = counts[full] - (per_text[full] - 1) * WINDOW
    ends = np.flatnonzero(used < WINDOW)
    windows[ends] = np.where(np.arange(WINDOW) < used[ends, None], windows[ends], PADDING)
    return windows, np.repeat(np.arange(len(texts)), per_text)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean class probabilities over all byte positions of each text, (texts, languages)."""
    windows, owners = cut_windows(texts)
    sums = np.zeros((len(texts), len(net.languages)))
    for at in range(0, len(windows), SIDE_BY_SIDE):
        part = np.ascontiguousarray(windows[at : at + SIDE_BY_SIDE].T)
        h = net.recurrent.shape[1]
        scores = states(net, part, 0) @ net.output[:h]
        scores += states(net, part, 1) @ net.output[h:]
        scores += net.bias
        chances = softmax(scores)
        chances *= (part != PADDING)[:, :, None]
        np.add.at(sums, owners[at : at + SIDE_BY_SIDE], chances.sum(axis=0))
    return sums / np.maximum([len(x) for x in texts], 1)[:, None]


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_texts(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, str]]:
    """The bounded sample (text, language), brought to the driver; one scan counts, one takes.

    Whole texts, each language an equal share of ``sample_rows`` and ``sample_bytes`` (one row at least).
    Texts longer than a language's share of bytes are not learnt from.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("place"), F.octet_length(text_col).alias("size"))
    languages = known.select("lang").distinct().count()
    if not languages:
        return []
    each, room = max(1, sample_rows // languages), max(1, sample_bytes // languages)
    known = known.where(F.col("size") <= room)
    counts = dict(known.groupBy("lang").count().collect())
    if not counts:
        return []
    # Rows under its language's share of the hashes' range are about twice as many as wanted.
    span = 1 << 30
    shares = [x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(span, 2 * (each + 8) * span // n)))]
    within = known.where(F.pmod("place", F.lit(span)) < F.element_at(F.create_map(*shares), F.col("lang")))
    order = Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(span)), "place", "text")
    ranked = within.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    ranked = ranked.withColumn("bytes", F.sum("size").over(Window.partitionBy("lang").orderBy("rank")))
    rows = ranked.where(F.col("bytes") <= room).orderBy("lang", "rank").select("text", "lang")
    return [(text.encode(), lang) for text, lang in rows.collect()]


def predict(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row."""

    def make():
        def work(given: pa.Array) -> list[pa.Array]:
            texts = given.to_pylist()
            with_letter = [has_letter(t) and net is not None for t in texts]
            chances = iter(pooled(net, [t.encode() for t, yes in zip(texts, with_letter) if yes]) if any(with_letter) else ())
            langs, scores = [], []
            for yes in with_letter:
                if yes:
                    row = next(chances)
                    best = int(row.argmax())
                    langs.append(net.languages[best])
                    scores.append(min(1.0, float(row[best])))
                else:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_text(docs, make, fields, id_col=id_col, text_col=text_col)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """A network fitted to the labelled rows of ``docs`` that are not held out."""
    return train(training_texts(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample_rows=sample_rows))


def keep_known(docs: DataFrame, net: Network | None, *, min_score: float = 0.5, text_col: str = "text", languages: list[str] | None = None) -> DataFrame:
    """The rows whose predicted language is one of ``languages`` (all learnt ones) with enough score."""
    at, schema = docs.columns.index(text_col), docs.schema
    wanted = set(languages or (net.languages if net else ()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import slices

        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                use = [i for i, t in enumerate(texts) if has_letter(t)]
                keep = np.zeros(len(texts), dtype=bool)
                if use and net is not None:
                    chances = pooled(net, [texts[i].encode() for i in use])
                    best = chances.argmax(axis=1)
                    keep[use] = [chances[k, b] >= min_score and net.languages[b] in wanted for k, b in enumerate(best)]
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
