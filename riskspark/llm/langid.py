"""Language identification with a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes. One network reads a window forwards, one
backwards, and at every byte their states together give a chance for each
language. A document's chances are the means over its letters. The network is
trained here in numpy, by backpropagation through time over excerpts of
documents whose language is known.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.llm import arrow
from riskspark.llm.sample import SPAN

#: Bytes read in one go; the states start anew in each window.
WINDOW = 64
HIDDEN = 8
#: Training: documents per language, characters of each, steps, windows in a step.
TRAIN_DOCS, EXCERPT, STEPS, BATCH = 300, 1200, 260, 192
RATE = 0.02
#: Windows computed together, and chances that may be held for them; with many languages fewer windows are.
TOGETHER, CHANCES = 1024, 1 << 23
#: What a text without letters gets.
UNKNOWN = "und"
PAD = 256

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW symbols, padded; row of each window)."""
    length = np.diff(offsets)
    per_row = -(-length // WINDOW)
    row = np.repeat(np.arange(len(length)), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    begin = offsets[:-1][row] + nth * WINDOW
    place = begin[:, None] + np.arange(WINDOW)
    inside = place < offsets[1:][row][:, None]
    out = np.full(place.shape, PAD, np.int16)
    out[inside] = data[place[inside]]
    return out, row


def together(languages: int) -> int:
    """Windows that are computed in one go."""
    return max(min(TOGETHER, CHANCES // (WINDOW * max(languages, 1))), 1)


class Network:
    """Both directions and the output layer; see `forward` for the equations."""

    NAMES = ("in_f", "in_b", "rec_f", "rec_b", "nb_f", "nb_b", "out", "bias")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def new(cls, languages: int, hidden: int = HIDDEN, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        w = {}
        for d in "fb":
            w[f"in_{d}"] = draw(PAD + 1, 3 * hidden, scale=0.3)
            w[f"rec_{d}"] = draw(hidden, 3 * hidden, scale=hidden**-0.5)
            w[f"nb_{d}"] = np.zeros(hidden, np.float32)
        w["out"] = draw(2 * hidden, languages, scale=0.3)
        w["bias"] = np.zeros(languages, np.float32)
        return cls(w)

    def direction(self, d: str, x: np.ndarray, keep: bool = False):
        """States after each symbol (time x windows x hidden); with `keep`, what backpropagation needs.

        u, r = sigmoid(in[x] + h rec), the update and reset gates;
        n = tanh(in[x] + r (h rec + nb)); h' = n + u (h - n).
        """
        table, rec, nb = self.w[f"in_{d}"], self.w[f"rec_{d}"], self.w[f"nb_{d}"]
        n_win, hid = len(x), rec.shape[0]
        states, kept = np.empty((WINDOW, n_win, hid), np.float32), []
        h = np.zeros((n_win, hid), np.float32)
        steps = range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
        by_time = np.ascontiguousarray(x.T)
        given, back = np.empty((n_win, 3 * hid), np.float32), np.empty((n_win, 3 * hid), np.float32)
        for t in steps:
            np.take(table, by_time[t], axis=0, out=given, mode="clip")
            np.matmul(h, rec, out=back)
            gates = given[:, :2 * hid] + back[:, :2 * hid]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            u, r = gates[:, :hid], gates[:, hid:]
            inner = back[:, 2 * hid:] + nb
            n = r * inner
            n += given[:, 2 * hid:]
            np.tanh(n, out=n)
            new = states[t]
            np.subtract(h, n, out=new)
            new *= u
            new += n
            if keep:
                kept.append((t, h, u, r, inner.copy(), n))
            h = new
        return (states, kept) if keep else states

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Chances of each language at each symbol (time x windows x languages)."""
        hid = self.w["rec_f"].shape[0]
        logits = self.direction("f", x) @ self.w["out"][:hid]
        logits += self.direction("b", x) @ self.w["out"][hid:]
        logits += self.w["bias"]
        np.clip(logits, -40, 40, out=logits)
        np.exp(logits, out=logits)
        logits /= logits @ np.ones((logits.shape[-1], 1), np.float32)
        return logits

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy per letter, and its slope for every weight."""
        total, at_once = max(np.append(_LETTER, False)[x].sum(), 1), together(self.w["out"].shape[1])
        loss, slope = self.share_of_slopes(x[:at_once], y[:at_once], total)
        for i in range(at_once, len(x), at_once):
            more, part = self.share_of_slopes(x[i:i + at_once], y[i:i + at_once], total)
            loss += more
            for k, g in part.items():
                slope[k] = slope[k] + g
        return loss, slope

    def share_of_slopes(self, x: np.ndarray, y: np.ndarray, total: int) -> tuple[float, dict[str, np.ndarray]]:
        """What these windows add to loss and slopes over `total` letters."""
        w, hid = self.w, self.w["rec_f"].shape[0]
        fwd, kept_f = self.direction("f", x, True)
        bwd, kept_b = self.direction("b", x, True)
        both = np.concatenate((fwd, bwd), -1)
        logits = both @ w["out"] + w["bias"]
        logits -= logits.max(-1, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(-1, keepdims=True)
        counts = np.append(_LETTER, False)[x.T]
        at_y = np.take_along_axis(chance, np.broadcast_to(y[None, :, None], (*counts.shape, 1)), -1)[..., 0]
        loss = float(-(np.log(np.maximum(at_y, 1e-9)) * counts).sum() / total)
        d_logits = chance
        np.put_along_axis(d_logits, np.broadcast_to(y[None, :, None], (*counts.shape, 1)), (at_y - 1)[..., None], -1)
        d_logits *= (counts / total)[..., None].astype(np.float32)
        slope = {
            "out": both.reshape(-1, 2 * hid).T @ d_logits.reshape(-1, d_logits.shape[-1]), "bias": d_logits.sum((0, 1)),
        }
        d_both = d_logits @ w["out"].T
        for d, kept, outer in (("f", kept_f, d_both[..., :hid]), ("b", kept_b, d_both[..., hid:])):
            rec = w[f"rec_{d}"]
            g_in, g_rec, g_nb = np.zeros_like(w[f"in_{d}"]), np.zeros_like(rec), np.zeros_like(w[f"nb_{d}"])
            dh = np.zeros((len(x), hid), np.float32)
            for t, h, u, r, inner, n in reversed(kept):
                dh = dh + outer[t]
                dn = dh * (1 - u) * (1 - n * n)
                du = dh * (h - n) * u * (1 - u)
                dr = dn * inner * r * (1 - r)
                d_inner = dn * r
                d_back = np.concatenate((du, dr, d_inner), 1)
                np.add.at(g_in, x[:, t], np.concatenate((du, dr, dn), 1))
                g_rec += h.T @ d_back
                g_nb += d_inner.sum(0)
                dh = dh * u + d_back @ rec.T
            slope |= {f"in_{d}": g_in, f"rec_{d}": g_rec, f"nb_{d}": g_nb}
        return loss, slope


class Identifier:
    """A network and the languages it knows."""

    def __init__(self, languages: list[str], network: Network | None):
        self.languages, self.network = languages, network

    def chances(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: mean chance of each language over its letters, and letters labelled with each."""
        rows, n = len(offsets) - 1, len(self.languages)
        total, labelled, letters = np.zeros((rows, n)), np.zeros((rows, n), np.int64), np.zeros(rows)
        x, row = windows(data, offsets)
        is_letter = np.append(_LETTER, False)
        at_once = together(n)
        for i in range(0, len(x), at_once):
            part, own = x[i:i + at_once], row[i:i + at_once]
            chance = self.network.forward(part)
            counts = is_letter[part.T]
            best = chance.argmax(-1)
            chance *= counts[..., None]
            sums, first = chance.sum(0), np.flatnonzero(np.diff(own, prepend=-1))
            total[own[first]] += np.add.reduceat(sums, first, axis=0)
            letters[own[first]] += np.add.reduceat(counts.sum(0), first)
            marks = np.stack([((best == k) & counts).sum(0) for k in range(n)], 1)
            labelled[own[first]] += np.add.reduceat(marks, first, axis=0)
        return total / np.maximum(letters, 1)[:, None], labelled


def fit(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> Identifier:
    """Trains on excerpts with Adam; every step draws windows of all languages alike."""
    languages = sorted(set(labels))
    if not languages:
        return Identifier([], None)
    network = Network.new(len(languages), seed=seed)
    x, row = windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    y = np.array([languages.index(v) for v in labels])[row]
    of = [np.flatnonzero(y == k) for k in range(len(languages))]
    of = [o for o in of if len(o)]
    if not of:
        return Identifier(languages, network)
    rng, each = np.random.default_rng(seed), max(BATCH // len(of), 8)
    first = {k: np.zeros_like(v) for k, v in network.w.items()}
    second = {k: np.zeros_like(v) for k, v in network.w.items()}
    for step in range(1, steps + 1):
        taken = np.concatenate([rng.choice(o, each) for o in of])
        _, slope = network.slopes(x[taken], y[taken])
        scale = min(1.0, 1.0 / (np.sqrt(sum(float((g * g).sum()) for g in slope.values())) + 1e-9))
        rate = RATE * (1 - 0.9 * step / steps)
        for k, g in slope.items():
            g = g * scale
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            network.w[k] = (network.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Identifier(languages, network)


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS) -> Identifier:
    """Fits on an excerpt of at most `per_language` documents of each language.

    `learn` says which rows may be learnt from. Rows without text or language
    are left out. Copies of a text count once and are reduced to one row before
    anything is drawn: of each language's distinct texts those with the
    smallest hashes are taken, all of them if there are no more than
    `per_language`. The excerpt begins at a place that the hash gives.
    """
    place = F.xxhash64("text")
    begin = (F.pmod(place, F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1) + 1).cast("int")
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
    ).select("lang", place.alias("h"), F.substring("text", begin, F.lit(EXCERPT)).cast("binary").alias("text"))
    sizes = known.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    # Leaves about twice as many texts as are wanted, so that few are shuffled.
    cut = F.pmod("h", F.lit(SPAN))
    few = known.join(F.broadcast(sizes), "lang").where(cut < F.ceil(F.lit((2 * per_language + 50) * SPAN) / F.col("n")))
    once = few.groupBy("lang", "h").agg(F.first("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(cut, "h"))
    rows = once.withColumn("nth", nth).where(F.col("nth") <= per_language).collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    return fit([bytes(r["text"]) for r in rows], [r["lang"] for r in rows])


def _judged(model: Identifier, column):
    """For slices of a text column: (first row, last row, languages, scores, letters labelled)."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = True
    data, offsets = arrow.utf8(column)
    for i, j in arrow.slices(offsets):
        part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        letters = arrow.per_row(ascii_letter[part], own) > 0
        for k in np.flatnonzero(~letters):
            letters[k] = any(map(str.isalpha, part[own[k]:own[k + 1]].tobytes().decode()))
        if not model.languages:
            yield i, j, np.full(j - i, UNKNOWN, object), np.zeros(j - i), np.zeros((j - i, 0), np.int64)
            continue
        chance, labelled = model.chances(part, own)
        best = chance.argmax(1)
        score = np.where(letters, np.clip(chance[np.arange(len(best)), best], 0, 1), 0.0)
        yield i, j, np.where(letters, np.array(model.languages, object)[best], UNKNOWN), score, labelled


def _sent(docs: DataFrame, model: Identifier):
    """The model, to be loaded in tasks; its size depends on the number of languages only."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.network.w if model.network else None))

    def load() -> Identifier:
        languages, weights = sent.value
        return Identifier(languages, Network(weights) if weights else None)

    return load


def identify(docs: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, labelled (letters labelled with each language).

    Every byte of the whole text is labelled. score is the mean chance of the
    predicted language. A text that is null or has no letter gets `und` and 0,
    and so does every text if no language was learnt. Null and repeated ids
    are kept, each row on its own. Other columns are ignored. An empty table
    gives no rows. A very long text is a slice of its own, cut into windows of
    bounded size like any other.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    load, kind = _sent(docs, model), source.schema["doc_id"].dataType.simpleString()
    counted = pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))

    def scan(batches):
        own = load()
        for batch in batches:
            for i, j, pred, score, labelled in _judged(own, batch.column(1)):
                counts = [[{"lang": v, "n": int(n)} for v, n in zip(own.languages, r) if n] for r in labelled]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(pred, pa.string()), pa.array(score), pa.array(counts, counted)],
                    names=["doc_id", "lang_pred", "score", "labelled"],
                )

    return source.mapInArrow(scan, f"doc_id {kind}, lang_pred string, score double, labelled array<struct<lang:string,n:long>>")


def accepted(docs: DataFrame, model: Identifier, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows whose language is known with `least_score` or more; all columns stay.

    Null and empty texts and those without a letter go. Every row is judged on
    its own: repeated rows and ids stay or go alike. An empty table gives no rows.
    """
    at, load = docs.columns.index(text_col), _sent(docs, model)

    def scan(batches):
        own = load()
        for batch in batches:
            for i, j, pred, score, _ in _judged(own, batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array((pred != UNKNOWN) & (score >= least_score)))

    return docs.mapInArrow(scan, docs.schema)
