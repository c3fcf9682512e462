"""Operator 11: document quality by attention over passages (multiple-instance learning).

A document is a bag of passages with one label for all of them. Each passage is encoded by
one learnt layer over its features; a gated attention, learnt from the labels of documents
alone, weighs the passages, and the weighted mean of their codes is scored:

    h = tanh(x W + b)         a ~ exp(w . (tanh(h V) * sigmoid(h U)))
    z = sum of a h            score = sigmoid(z . c + d)

The features are fixed: hashed counts of three bytes in a row, shares of kinds of signs,
and the share of words that the passage repeats. Passages are about PASSAGE bytes of whole
words, over the whole text. A text is scored block by block with three running sums, so
its length does not matter. Rows are scored where they lie: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.llm.rows import arrow_schema, keyed_schema, keyed_text, map_rows, staged_rows

PASSAGE = 512
#: Bytes whose features are taken at a time; a longer text starts a passage at each.
BLOCK = 1 << 18
#: Bound of the labelled rows that are learnt from: rows, and bytes of a row's text.
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 1 << 15

GRAMS = 256
_KINDS = 8
FEATURES = GRAMS + _KINDS + 2
#: Follows each text, so that its last bytes have features as the others do.
_END = b"\n\n"


def _kinds() -> np.ndarray:
    """The kind of each byte: space, line end, digit, capital, letter, stop, sign, other."""
    kinds = np.full(256, 7, np.uint8)
    for kind, signs in enumerate(
        (b" \t\r\x0b\x0c", b"\n", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b".,;:'\"-()?")
    ):
        kinds[list(signs)] = kind
    others = [b for b in range(33, 127) if kinds[b] == 7]
    kinds[others] = 6
    return kinds


_KIND = _kinds()
_SPACE = _KIND < 2
_SCALE = np.minimum(255, np.round(40 * np.log1p(np.arange(4096)))).astype(np.uint8)
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def passage_features(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features (8 bits each) of the passages of all texts, and how many each text has."""
    data = np.frombuffer(b"".join(t + _END for t in texts), np.uint8)
    sizes = np.array([len(t) + len(_END) for t in texts])
    starts = np.cumsum(sizes) - sizes
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    begins[starts] = True
    words = np.nonzero(begins)[0]
    text_of = np.searchsorted(starts, words, "right") - 1
    # A passage ends with the word in which its bytes run out.
    nth = (words - starts[text_of]) // PASSAGE
    first = np.append(True, (nth[1:] != nth[:-1]) | (text_of[1:] != text_of[:-1]))
    passage = np.cumsum(first) - 1
    lengths = np.diff(np.append(words, len(data)))
    of = np.repeat(passage, lengths)
    count = int(passage[-1]) + 1

    wide = np.append(data, (0, 0)).astype(np.uint32)
    grams = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77)
    grams = ((grams + wide[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(24)
    # What begins in the end signs would reach into the next text.
    for back in (1, 2):
        grams[starts + sizes - back] = 0
    out = np.zeros((count, FEATURES), np.uint8)
    counted = np.bincount(of * GRAMS + grams, minlength=count * GRAMS)
    out[:, :GRAMS] = _SCALE[np.minimum(counted, len(_SCALE) - 1)].reshape(count, GRAMS)
    kinds = np.bincount(of * _KINDS + _KIND[data], minlength=count * _KINDS).reshape(count, _KINDS)
    size = kinds.sum(axis=1)
    out[:, GRAMS : GRAMS + _KINDS] = 255 * kinds // size[:, None]

    place = np.arange(len(data)) - np.repeat(words, lengths)
    hashed = np.where(space, np.uint64(0), (data + np.uint64(1)) * _POWERS[place & 255])
    hashed = np.add.reduceat(hashed, words) * np.uint64(0xD6E8FEB86659FD93)
    distinct = np.unique((passage.astype(np.uint64) << np.uint64(40)) | (hashed >> np.uint64(24)))
    distinct = np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=count)
    out[:, -2] = 255 - 255 * distinct // np.bincount(passage)
    out[:, -1] = np.minimum(255, size // 4)
    return out, np.bincount(text_of[first], minlength=len(texts))


def blocks(texts: Sequence[str | None]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts in blocks of bounded size, with the number of the text each part is of."""
    parts, numbers, size = [], [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        for low in range(0, max(len(data), 1), BLOCK):
            part = data[low : low + BLOCK]
            if parts and size + len(part) > BLOCK:
                yield parts, numbers
                parts, numbers, size = [], [], 0
            parts.append(part)
            numbers.append(i)
            size += len(part)
    if parts:
        yield parts, numbers


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Attention:
    """The model: arrays by name, of a size that neither rows nor texts change."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Codes of passages, and their attention before it is normalised."""
        w = self.weights
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        return h, np.exp(np.clip((t * s) @ w["w"], -60, 60)), (x, t, s)

    def scores(self, z: np.ndarray) -> np.ndarray:
        return _sigmoid(z @ self.weights["c"] + self.weights["d"][0])

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of some bags, whose passages begin at starts."""
        w = self.weights
        h, e, (x, t, s) = self.passages(x)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts)
        off = (self.scores(z) - y) / len(y)
        dz = (off[:, None] * w["c"])[of]
        da = (h * dz).sum(axis=1)
        dl = a * (da - np.add.reduceat(a * da, starts)[of])
        dg = dl[:, None] * w["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
        return {
            "W": x.T @ dh,
            "b": dh.sum(axis=0),
            "V": h.T @ dt,
            "U": h.T @ ds,
            "w": (t * s).T @ dl,
            "c": z.T @ off,
            "d": off.sum(keepdims=True),
        }


def untrained(codes: int = 16, gates: int = 12, seed: int = 7) -> Attention:
    rng = np.random.default_rng(seed)

    def array(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    weights = {
        "W": array(FEATURES, codes),
        "b": np.zeros(codes),
        "V": array(codes, gates),
        "U": array(codes, gates),
        "w": array(gates),
        "c": np.zeros(codes),
        "d": np.zeros(1),
    }
    return Attention(np.zeros(FEATURES), np.ones(FEATURES), weights)


def fit(
    bags: Sequence[np.ndarray],
    labels: np.ndarray,
    epochs: int = 14,
    bags_at_a_time: int = 64,
    rate: float = 0.004,
    decay: float = 1e-4,
    seed: int = 7,
) -> Attention:
    """Learns from bags of passages' features; without bags every score is 0.5."""
    model = untrained(seed=seed)
    if not len(bags):
        return model
    rows, total, squares = 0, np.zeros(FEATURES), np.zeros(FEATURES)
    for bag in bags:
        wide = bag.astype(np.float64)
        rows, total, squares = rows + len(bag), total + wide.sum(axis=0), squares + (wide * wide).sum(axis=0)
    model.mean = total / rows
    model.scale = 1 / np.sqrt(np.maximum(squares / rows - model.mean**2, 1.0))
    share = np.clip(labels.mean(), 0.01, 0.99)
    model.weights["d"][:] = np.log(share / (1 - share))
    rng = np.random.default_rng(seed)
    first = {name: np.zeros_like(x) for name, x in model.weights.items()}
    second = {name: np.zeros_like(x) for name, x in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for low in range(0, len(order), bags_at_a_time):
            chosen = order[low : low + bags_at_a_time]
            sizes = np.array([len(bags[i]) for i in chosen])
            x = np.concatenate([bags[i] for i in chosen]).astype(np.float64)
            step += 1
            found = model.gradients(x, np.cumsum(sizes) - sizes, labels[chosen])
            for name, g in found.items():
                # Adam, with a rate that falls to a tenth.
                g = g + decay * model.weights[name]
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                m = first[name] / (1 - 0.9**step)
                v = second[name] / (1 - 0.999**step)
                now = rate * (1 - 0.9 * epoch / epochs)
                model.weights[name] -= now * m / (np.sqrt(v) + 1e-8)
    return model


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    allowed: Column | None = None,
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Attention:
    """Learns from at most ``sample_rows`` labelled documents of at most ``sample_bytes``.

    The sample is that of the lowest hashes of the keys, among those ``allowed`` (a
    condition on the key column). Keys and labels that are null teach nothing; several
    labels of a key count as their mean; of several rows with a key the least text counts.
    The keys of the sample, bounded by sample_rows, go to the texts, which stay; one task
    learns from the sample's features, which the two bounds bound.
    """
    each = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"))
    each = each.where("key is not null and label is not null")
    if allowed is not None:
        each = each.withColumnRenamed("key", key).where(allowed).withColumnRenamed(key, "key")
    each = each.groupBy("key").agg(F.avg(F.col("label").cast("double")).alias("label"))
    chosen = each.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(sample_rows)
    chosen = staged_rows(chosen, "quality-keys")
    rows = keyed_text(docs, key, text).where(
        F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes
    )
    rows = rows.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min("text").alias("text"))

    def start():
        def one(part):
            features = []
            for parts, _ in blocks(part.column("text").to_pylist()):
                found, sizes = passage_features(parts)
                features += [x.tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])]
            return {"key": part.column("order"), "label": part.column("label"), "bag": features}

        return one

    rows = rows.withColumn("order", F.xxhash64("key", F.lit(1)))
    schema = "key long, label double, bag binary"
    sample = staged_rows(map_rows(rows, schema, start), "quality-sample")
    kind = arrow_schema(schema)
    named = "name string, shape array<int>, data binary"
    model = arrow_schema(named)

    def train(batches):
        table = pa.Table.from_batches(list(batches), schema=kind)
        table = table.sort_by([("key", "ascending"), ("label", "ascending")])
        bags = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, FEATURES) for x in table.column("bag")]
        found = fit(bags, table.column("label").to_numpy())
        arrays = found.weights | {"mean": found.mean, "scale": found.scale}
        columns = [
            list(arrays),
            [list(x.shape) for x in arrays.values()],
            [x.astype("<f8").tobytes() for x in arrays.values()],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, model)], schema=model)

    # One bounded task; the model is a few arrays of fixed size.
    rows = sample.coalesce(1).mapInArrow(train, named).collect()
    if not rows:
        return untrained()
    arrays = {r.name: np.frombuffer(r.data, "<f8").reshape(r.shape) for r in rows}
    return Attention(arrays.pop("mean"), arrays.pop("scale"), arrays)


def score_quality(
    docs: DataFrame, model: Attention, key: str = "doc_id", text: str = "text", cutoff: float = 0.7
) -> DataFrame:
    """Key, score (0 to 1), predicted (1 from the cutoff on), n_passages, and of the
    passage with the largest attention its number and weight.

    Every text is scored whole; a null or empty one is one empty passage; the first of
    equal weights is the largest. A null key stays; repeated rows are scored each and
    alike; other columns, of any name, are not read; an empty table gives no rows.
    """
    rows = keyed_text(docs, key, text)
    names = "score double, predicted int, n_passages long, attended long, attention double"

    def start():
        return lambda part: _scored(model, part.column("text").to_pylist(), cutoff) | {
            "key": part.column("key")
        }

    found = map_rows(rows, keyed_schema(rows, "key", names), start)
    return found.select(F.col("key").alias(key), *found.columns[1:])


def _scored(model: Attention, texts: list[str | None], cutoff: float) -> dict[str, list]:
    n = len(texts)
    # What a text has so far: attention, codes times attention, passages, the largest.
    total, codes = np.zeros(n), np.zeros((n, len(model.weights["b"])))
    seen, most, attended = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
    for parts, numbers in blocks(texts):
        features, sizes = passage_features(parts)
        h, e, _ = model.passages(features)
        starts = np.cumsum(sizes) - sizes
        # A text has one part in a block, so its number comes once.
        at = np.array(numbers)
        total[at] += np.add.reduceat(e, starts)
        codes[at] += np.add.reduceat(e[:, None] * h, starts)
        top = np.maximum.reduceat(e, starts)
        is_top = np.nonzero(e == np.repeat(top, sizes))[0]
        place = is_top[np.searchsorted(is_top, starts)] - starts + seen[at]
        better = top > most[at]
        attended[at] = np.where(better, place, attended[at])
        most[at] = np.maximum(top, most[at])
        seen[at] += sizes
    scores = model.scores(codes / total[:, None])
    return {
        "score": scores.tolist(),
        "predicted": (scores >= cutoff).astype(int).tolist(),
        "n_passages": seen.tolist(),
        "attended": attended.tolist(),
        "attention": (most / total).tolist(),
    }
