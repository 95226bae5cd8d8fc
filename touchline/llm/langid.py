"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in windows, forwards and backwards,
and gives each byte a probability for every language; the mean over all bytes of
the whole text is the document's. It is trained here with numpy, by
backpropagation through time, on windows drawn from a bounded sample of labelled
documents: `per_lang` documents of each language and `per_doc` windows of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, list_array, map_text, slices, whole

WINDOW = 96
HIDDEN = 8
#: windows that the network reads side by side
LANES = 4096
UNDETERMINED = "und"
#: part of the way from an even guess to certainty that a document's best language has to be above; the least score of 10,000 labelled documents is 0.14 of it
ABOVE_CHANCE = 0.1


def sample_windows(docs: DataFrame, eligible: Column, per_lang: int, per_doc: int) -> tuple[list[str], list[bytes], np.ndarray]:
    """Windows of at most per_lang labelled documents of each language, chosen by a hash of the id.

    A first pass counts the languages; the second keeps about twice as many
    documents of each as are needed, so that no task gathers a whole language.
    """
    rows = docs.filter(eligible & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], [], np.zeros(0, dtype=np.int64)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 40))
    shares = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, (2 * per_lang + 20) / counts[lang]) * (1 << 40)))])
    near = rows.withColumn("draw", draw).filter(F.col("draw") < F.try_element_at(shares, F.col("lang")))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))).filter(F.col("rank") <= per_lang)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                out, names = [], []
                for text, lang, draw in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    data = text.encode("utf-8")
                    room = max(1, len(data) - WINDOW + 1)
                    for k in range(min(per_doc, -(-len(data) // WINDOW))):
                        at = (draw * (2 * k + 1) + k * 0x9E3779B1) % room
                        out.append(data[at : at + WINDOW])
                        names.append(lang)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(names, pa.string())], names=["bytes", "lang"])

    found = ranked.select("text", "lang", "draw").mapInArrow(cut, "bytes binary, lang string").collect()
    found = sorted((r["lang"], bytes(r["bytes"])) for r in found)
    return langs, [b for _, b in found], np.array([langs.index(lang) for lang, _ in found], dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Two gated recurrent layers, one for each direction, and a softmax over languages at every byte."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        scale = 1 / np.sqrt(hidden)
        self.weights: dict[str, np.ndarray] = {"out": rng.uniform(-scale, scale, (2 * hidden, len(langs))), "bias": np.zeros(len(langs))}
        for d in "fb":
            self.weights[f"{d}_in"] = rng.normal(0, 0.3, (256, 3 * hidden))
            self.weights[f"{d}_state"] = rng.uniform(-scale, scale, (hidden, 3 * hidden))
            self.weights[f"{d}_reset"] = np.zeros(hidden)
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    # -- training

    def _run(self, d: str, ids: np.ndarray):
        """States of one direction over (time, row) bytes, with what the way back needs."""
        w, h = self.weights, self.hidden
        state = np.zeros((ids.shape[1], h), dtype=np.float32)
        states, kept = [], []
        for x in ids:
            g = w[f"{d}_in"][x]
            a = state @ w[f"{d}_state"]
            z, r = _sigmoid(g[:, :h] + a[:, :h]), _sigmoid(g[:, h : 2 * h] + a[:, h : 2 * h])
            c = a[:, 2 * h :] + w[f"{d}_reset"]
            n = np.tanh(g[:, 2 * h :] + r * c)
            kept.append((state, z, r, c, n))
            state = n + z * (state - n)
            states.append(state)
        return np.stack(states), kept

    def _back(self, d: str, ids: np.ndarray, kept: list, grads: np.ndarray, out: dict[str, np.ndarray]) -> None:
        """Backpropagation through time: grads are those of the states from the output."""
        w, h = self.weights, self.hidden
        carried = np.zeros_like(grads[0])
        inputs = np.zeros((*ids.shape, 3 * h), dtype=np.float32)
        for t in range(len(ids) - 1, -1, -1):
            before, z, r, c, n = kept[t]
            g = grads[t] + carried
            dn = g * (1 - z) * (1 - n * n)
            dz = g * (before - n) * z * (1 - z)
            dr = dn * c * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            inputs[t] = np.concatenate([dz, dr, dn], axis=1)
            out[f"{d}_state"] += before.T @ da
            out[f"{d}_reset"] += (dn * r).sum(axis=0)
            carried = g * z + da @ w[f"{d}_state"].T
        np.add.at(out[f"{d}_in"], ids.ravel(), inputs.reshape(-1, 3 * h))

    def fit(self, windows: list[bytes], labels: np.ndarray, steps: int = 220, rows: int = 192, rate: float = 0.02, seed: int = 11) -> ByteGru:
        rng = np.random.default_rng(seed)
        length = np.array([len(x) for x in windows])
        ids = np.zeros((len(windows), WINDOW), dtype=np.int64)
        for i, x in enumerate(windows):
            ids[i, : len(x)] = np.frombuffer(x, dtype=np.uint8)
        place = np.arange(WINDOW)
        back = np.where(place < length[:, None], length[:, None] - 1 - place, place)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        # every language is drawn alike
        members = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        members = [m for m in members if len(m)]
        for step in range(1, steps + 1):
            some = np.concatenate([rng.choice(m, -(-rows // len(members))) for m in members])
            forward, turn = ids[some].T, back[some]
            backward = np.take_along_axis(ids[some], turn, axis=1).T
            hf, kept_f = self._run("f", forward)
            hb, kept_b = self._run("b", backward)
            turned = np.take_along_axis(hb.transpose(1, 0, 2), turn[:, :, None], axis=1).transpose(1, 0, 2)
            both = np.concatenate([hf, turned], axis=2)
            logits = both @ self.weights["out"] + self.weights["bias"]
            p = np.exp(logits - logits.max(axis=2, keepdims=True))
            p /= p.sum(axis=2, keepdims=True)
            mask = (place[:, None] < length[some]).astype(np.float32)
            p[:, np.arange(len(some)), labels[some]] -= 1
            p *= (mask / mask.sum())[:, :, None]
            grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
            grads["out"] = both.reshape(-1, 2 * self.hidden).T @ p.reshape(-1, len(self.langs))
            grads["bias"] = p.sum(axis=(0, 1))
            down = p @ self.weights["out"].T
            self._back("f", forward, kept_f, down[:, :, : self.hidden], grads)
            mirrored = np.take_along_axis(down[:, :, self.hidden :].transpose(1, 0, 2), turn[:, :, None], axis=1).transpose(1, 0, 2)
            self._back("b", backward, kept_b, mirrored, grads)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            speed = rate * (1 - 0.9 * step / steps) * min(1.0, 1.0 / max(norm, 1e-6))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= (speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    # -- prediction

    def _scores(self, d: str, ids: np.ndarray, active: np.ndarray, out: np.ndarray, turn: bool, length: np.ndarray) -> None:
        """Adds one direction's share of the logits to out (time, language, row); rows are sorted from long to short."""
        w, h = self.weights, self.hidden
        half = np.repeat(np.array([0.5, 0.5, 1], dtype=np.float32), h)
        table = np.ascontiguousarray((w[f"{d}_in"] * half).T)
        mix = np.ascontiguousarray((w[f"{d}_state"] * half).T)
        reset = w[f"{d}_reset"][:, None]
        side = np.ascontiguousarray(w["out"][:h].T if d == "f" else w["out"][h:].T)
        state = np.zeros((h, ids.shape[1]), dtype=np.float32)
        column = np.arange(ids.shape[1])
        for t in range(len(ids)):
            k = active[t]
            state = state[:, :k]
            g = np.take(table, ids[t, :k], axis=1)
            a = mix @ state
            a[2 * h :] += reset
            gates = g[: 2 * h]
            gates += a[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            n = g[2 * h :]
            c = a[2 * h :]
            c *= gates[h:]
            n += c
            np.tanh(n, out=n)
            state = state - n
            state *= gates[:h]
            state += n
            if turn:
                out[length[:k] - 1 - t, :, column[:k]] += (side @ state).T
            else:
                out[t, :, :k] += side @ state

    def positions(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probabilities (time, language, row) of the bytes of windows data[start : start + length], lengths falling."""
        top = int(length[0])
        place = np.arange(top)[:, None]
        active = (length[None, :] > place).sum(axis=1)
        limit = len(data) - 1
        logits = np.zeros((top, len(self.langs), len(starts)), dtype=np.float32) + self.weights["bias"][None, :, None]
        self._scores("f", data[np.minimum(starts + place, limit)], active, logits, False, length)
        self._scores("b", data[np.maximum(starts + length - 1 - place, 0)], active, logits, True, length)
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def windows(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start and length of every window, from long to short."""
        size = np.diff(offsets)
        count = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        starts = offsets[:-1][doc] + nth * WINDOW
        length = np.minimum(WINDOW, offsets[1:][doc] - starts)
        order = np.argsort(-length, kind="stable")
        return doc[order], starts[order], length[order]

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probability of every language over the bytes of each document; zeros where there is no byte."""
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        doc, starts, length = self.windows(offsets)
        for a in range(0, len(doc), LANES):
            part = slice(a, a + LANES)
            p = self.positions(data, starts[part], length[part])
            p *= (np.arange(len(p))[:, None] < length[part])[:, None, :]
            sums = p.sum(axis=0)
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(doc[part], weights=sums[k], minlength=len(total))
        return total / np.maximum(np.diff(offsets), 1)[:, None]


def train(docs: DataFrame, eligible: Column | None = None, per_lang: int = 300, per_doc: int = 4) -> ByteGru | None:
    """A network for the languages of the eligible rows' `lang`; None if there is no labelled text."""
    langs, windows, labels = sample_windows(docs, F.lit(True) if eligible is None else eligible, per_lang, per_doc)
    return ByteGru(langs).fit(windows, labels) if langs else None


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = [(t or "").encode("utf-8") for t in column.to_pylist()]
    return np.frombuffer(b"".join(texts) or b"\0", dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def named(column: pa.Array, letters: list[bool], model: ByteGru | None) -> tuple[list[str], np.ndarray]:
    """Language and score of texts; `letters` tells which of them have a letter."""
    claim(None)
    ok = np.array(letters, dtype=bool)
    if model is None or not ok.any():
        return [UNDETERMINED] * len(ok), np.zeros(len(ok))
    mean = model.documents(*_buffers(column))
    names = [model.langs[b] if x else UNDETERMINED for b, x in zip(mean.argmax(axis=1), ok, strict=True)]
    return names, np.where(ok, np.clip(mean.max(axis=1), 0, 1), 0.0)


def predict(df: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row.

    `und` with score 0 where the text is null, has no letter, or nothing was
    learned. The prediction reads the text alone, whole texts in windows; a null
    id stays null, other columns are left out and repeated rows give repeated
    rows. Of languages with equal probabilities the first by name is taken.
    """

    def each(cut: pa.RecordBatch) -> pa.RecordBatch:
        names, score = named(cut.column(1), cut.column(2).to_pylist(), model)
        return pa.RecordBatch.from_arrays([cut.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    return map_text(rows, ["doc_id", "text", "letters"], each, "doc_id long, lang_pred string, score double")


def least_score(languages: int, above_chance: float = ABOVE_CHANCE) -> float:
    """The score below which a text is not told apart from chance: that much of the way from an even guess to certainty."""
    return (1 + above_chance * (languages - 1)) / max(languages, 1) - 1e-6


def with_language(df: DataFrame, model: ByteGru | None, text_col: str = "text", lang_col: str = "lang", above_chance: float = ABOVE_CHANCE) -> DataFrame:
    """The rows of df, all columns, whose text the network gives a language; a null language is filled with it.

    Rows go if their text is null or has no letter, if nothing was learned, or
    if the pooled probability of the best language is below `least_score`.
    Repeated rows stay rows of their own; ids are not looked at. Of languages
    with equal probabilities the first by name is taken.
    """
    place, lang = df.columns.index(text_col), df.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, place):
                names, score = named(cut.column(place), [t is not None and any(map(str.isalpha, t)) for t in cut.column(place).to_pylist()], model)
                told = pc.coalesce(cut.column(lang), pa.array(names, cut.column(lang).type))
                columns = [told if k == lang else cut.column(k) for k in range(cut.num_columns)]
                enough = [n != UNDETERMINED and x >= least_score(len(model.langs), above_chance) for n, x in zip(names, score.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=cut.schema).filter(pa.array(enough, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def label_positions(df: DataFrame, model: ByteGru, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and the runs of bytes with one label: their ends and the place of their language in model.langs."""

    def each(cut: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = _buffers(cut.column(1))
        labels = np.zeros(len(data), dtype=np.int8)
        _, starts, length = model.windows(offsets)
        for a in range(0, len(starts), LANES):
            part = slice(a, a + LANES)
            best = model.positions(data, starts[part], length[part]).argmax(axis=1)
            place = np.arange(len(best))[:, None]
            inside = place < length[part]
            labels[(starts[part] + place)[inside]] = best[inside]
        ends, kinds, sizes = [], [], []
        for a, b in zip(offsets, offsets[1:], strict=False):
            own = labels[a:b]
            cuts = np.flatnonzero(np.diff(own)) + 1
            last = np.r_[cuts, b - a] if b > a else np.zeros(0, dtype=np.int64)
            ends.append(last)
            kinds.append(own[last - 1] if b > a else own[:0])
            sizes.append(len(last))
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (ends, kinds)]
        return pa.RecordBatch.from_arrays([cut.column(0), *(list_array(x.astype(np.int32), np.array(sizes), pa.int32()) for x in flat)], names=["doc_id", "ends", "labels"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return map_text(rows, ["doc_id", "text"], each, "doc_id long, ends array<int>, labels array<int>")
