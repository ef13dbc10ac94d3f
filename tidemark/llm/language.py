"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows, one state running forward and one
backward, and gives every byte a distribution over the languages; a document's
distribution is the mean over all its bytes. It is trained here, in numpy, by
backpropagation through time, on a bounded sample of labelled rows: about
`sample_docs` documents, the languages evenly, and of the windows that their
whole texts are cut into at most `sample_windows`, drawn from all of them alike.
Prediction covers whole texts, window by window, where the rows are: no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, key60, numbered, pick, ship

WINDOW = 64


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, size) bytes, zero-padded; the text of each window; how many bytes each holds."""
    counts = np.array([-(-len(t) // size) for t in texts], np.int64)
    out = np.zeros(int(counts.sum()) * size, np.uint8)
    held = np.full(int(counts.sum()), size, np.int64)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        out[at * size : at * size + len(t)] = np.frombuffer(t, np.uint8)
        if n:
            held[at + n - 1] = len(t) - (n - 1) * size
        at += n
    return out.reshape(-1, size), np.repeat(np.arange(len(texts)), counts), held


def gate(x):
    return np.clip(x * np.float32(0.2) + np.float32(0.5), 0, 1)


class Network:
    """Weights of both directions: input table (256 x 3 H), recurrent (H x 3 H), output (2 H x classes)."""

    def __init__(self, classes: int, hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.hidden, self.typical = hidden, None
        self.w = {"out": rng.normal(0, 0.3, (2 * hidden, classes)).astype(f), "bias": np.zeros(classes, f)}
        for d in "fb":
            self.w |= {f"in_{d}": rng.normal(0, 0.5, (256, 3 * hidden)).astype(f), f"rec_{d}": rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(f)}

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """(time, windows, hidden) states over x (time, windows); `keep` gets what the backward pass needs."""
        H, table, rec = self.hidden, self.w[f"in_{d}"], self.w[f"rec_{d}"]
        h = np.zeros((x.shape[1], H), np.float32)
        out = np.empty((*x.shape, H), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = table.take(x[t], axis=0)
            b = h @ rec
            zr = gate(a[:, : 2 * H] + b[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = a[:, 2 * H :] + r * b[:, 2 * H :]
            c /= 1 + np.abs(c)
            if keep is not None:
                keep.append((t, h, b, zr, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, classes, windows) for bytes x (time, windows).

        The same recurrence as in states(), laid out with the windows last and
        with the gates' slope and offset folded into the weights.
        """
        H, n = self.hidden, x.shape[1]
        y = np.empty((len(x), len(self.w["bias"]), n), np.float32)
        a, b, h, c, d = np.empty((3 * H, n), np.float32), np.empty((3 * H, n), np.float32), np.empty((H, n), np.float32), np.empty((H, n), np.float32), np.empty((H, n), np.float32)
        more = np.empty_like(y[0])
        for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            table, rec = self.w[f"in_{side}"].T.copy(), self.w[f"rec_{side}"].T.copy()
            table[: 2 * H] = table[: 2 * H] * np.float32(0.2) + np.float32(0.5)
            rec[: 2 * H] *= np.float32(0.2)
            out = np.ascontiguousarray((self.w["out"][:H] if side == "f" else self.w["out"][H:]).T)
            h[:] = 0
            for t in order:
                table.take(x[t], axis=1, out=a, mode="clip")
                np.matmul(rec, h, out=b)
                zr = a[: 2 * H]
                zr += b[: 2 * H]
                np.clip(zr, 0, 1, out=zr)
                np.multiply(b[2 * H :], zr[H:], out=c)
                c += a[2 * H :]
                np.abs(c, out=d)
                d += 1
                c /= d
                c -= h
                c *= zr[:H]
                h += c
                np.matmul(out, h, out=y[t] if side == "f" else more)
                if side == "b":
                    y[t] += more
        y += self.w["bias"][:, None]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the bytes that count, and its gradients."""
        H, kept = self.hidden, {"f": [], "b": []}
        s = {d: self.states(x, d, kept[d]) for d in "fb"}
        both = np.concatenate([s["f"], s["b"]], 2)
        y = both @ self.w["out"] + self.w["bias"]
        y -= y.max(2, keepdims=True)
        p = np.exp(y)
        p /= p.sum(2, keepdims=True)
        n = mask.sum()
        loss = float(-(np.log(np.take_along_axis(p, np.broadcast_to(label[None, :, None], (*x.shape, 1)), 2)[..., 0] + 1e-9) * mask).sum() / n)
        p[:, np.arange(x.shape[1]), label] -= 1
        p *= mask[..., None] / n
        g = {"out": both.reshape(-1, 2 * H).T @ p.reshape(-1, p.shape[2]), "bias": p.sum((0, 1))}
        back = p @ self.w["out"].T
        for d, at in (("f", 0), ("b", H)):
            rec = self.w[f"rec_{d}"]
            grec, read, given = np.zeros_like(rec), [], []
            dh = np.zeros((x.shape[1], H), np.float32)
            for t, h, b, zr, c in reversed(kept[d]):
                dh = dh + back[t][:, at : at + H]
                z, r = zr[:, :H], zr[:, H:]
                dc = dh * z * (1 - np.abs(c)) ** 2
                dz = dh * (c - h)
                dr = dc * b[:, 2 * H :]
                dgate = np.concatenate([dz, dr], 1) * ((zr > 0) & (zr < 1)) * np.float32(0.2)
                da = np.concatenate([dgate, dc], 1)
                db = np.concatenate([dgate, dc * r], 1)
                grec += h.T @ db
                read.append(x[t])
                given.append(da)
                dh = dh * (1 - z) + db @ rec.T
            at_byte, given = np.concatenate(read), np.concatenate(given)
            table = np.stack([np.bincount(at_byte, given[:, k], 256) for k in range(3 * H)], 1)
            g |= {f"in_{d}": table.astype(rec.dtype), f"rec_{d}": grec}
        return loss, g


def train(texts: list[bytes], labels: np.ndarray, classes: int, hidden: int = 8, steps: int = 160, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """A network trained by Adam on random windows of the texts, each class weighing the same."""
    net, rng = Network(classes, hidden, seed), np.random.default_rng(seed)
    wins, of, held = windows(texts)
    lab = labels[of]
    wins, lab, held = wins[held >= 8], lab[held >= 8], held[held >= 8]
    by_class = [np.flatnonzero(lab == c) for c in range(classes)]
    by_class = [b for b in by_class if len(b)]
    if not by_class:
        return net
    m, v = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(b, -(-batch // len(by_class))) for b in by_class])
        x = np.ascontiguousarray(wins[rows].T)
        mask = (np.arange(WINDOW)[:, None] < held[rows][None]).astype(np.float32)
        _, g = net.gradients(x, lab[rows], mask)
        lr = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k in net.w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            net.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[bytes], classes: int, rows: int = 2048) -> np.ndarray:
    """Mean class probabilities over all bytes of each text (no bytes: zeros)."""
    wins, of, held = windows(texts)
    total = np.zeros((len(texts), classes))
    for k in range(0, len(wins), rows):
        x = np.ascontiguousarray(wins[k : k + rows].T)
        p = net.probabilities(x)
        full = held[k : k + rows] == WINDOW
        sums = p.sum(0).T.astype(np.float64)
        if not full.all():
            some = np.flatnonzero(~full)
            sums[some] = (p[:, :, some] * (np.arange(WINDOW)[:, None] < held[k : k + rows][some][None])[:, None]).sum(0).T
        np.add.at(total, of[k : k + rows], sums)
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


class Typical:
    """How likely texts are under the byte pairs of their language, and how unlikely a text in it may be.

    A text's likelihood is the mean log probability of its bytes, each given
    the one before, and without enough such pairs the bytes of all languages.
    Each quarter of the sample is scored by the pairs of the rest; `slack` is
    what nearly all of it stays within, below their language's median and beyond the noise of short texts,
    and `spare` more. Beyond `most` languages one table holds all of them.
    """

    def __init__(self, texts: list[bytes], labels: np.ndarray, classes: int, spare: float = 0.4, most: int = 128):
        self.one = classes > most
        labels = np.zeros_like(labels) if self.one else labels
        classes = 1 if self.one else classes
        part = np.arange(len(texts)) % 4
        scores, spread = np.zeros(len(texts)), []
        for side in range(4):
            tables = self.count([t for t, k in zip(texts, part, strict=True) if k != side], labels[part != side], classes)
            for i in np.flatnonzero(part == side):
                logs = self.logs(tables, texts[i], labels[i])
                scores[i] = logs.mean() if len(logs) else 0
                spread.append(logs.std() if len(logs) else 0)
        self.tables = self.count(texts, labels, classes).astype(np.float16)
        sizes = np.array([max(1, len(t) - 1) for t in texts])
        self.noise = 3 * float(np.median(spread))
        self.middle = np.array([np.median(scores[labels == c]) if (labels == c).any() else np.median(scores) for c in range(classes)])
        self.slack = spare + max(0.0, float(np.quantile(self.middle[labels] - scores - self.noise / np.sqrt(sizes), 0.999)))

    @staticmethod
    def count(texts: list[bytes], labels: np.ndarray, classes: int) -> np.ndarray:
        c = np.zeros((classes, 1 << 16), np.float32)
        arrays = [np.frombuffer(t, np.uint8).astype(np.int32) for t in texts]
        for label in range(classes):
            pairs = [b[:-1] << 8 | b[1:] for b, own in zip(arrays, labels, strict=True) if own == label]
            c[label] = np.bincount(np.concatenate([*pairs, np.zeros(0, np.int32)]), minlength=1 << 16)
        c = c.reshape(classes, 256, 256)
        single = c.sum((0, 1)) + 0.01
        return np.log((c + 8 * single / single.sum()) / (c.sum(2, keepdims=True) + 8)).reshape(classes, -1)

    @staticmethod
    def logs(tables: np.ndarray, text: bytes, label: int) -> np.ndarray:
        b = np.frombuffer(text, np.uint8)
        return tables[label].take(b[:-1].astype(np.int32) << 8 | b[1:]).astype(np.float32)

    def fits(self, text: bytes, label: int, step: int = 1 << 20) -> bool:
        """Whether a text is as likely as texts of its language are; one byte always is."""
        n, label = len(text) - 1, 0 if self.one else label
        if n < 1:
            return True
        mean = sum(float(self.logs(self.tables, text[k : k + step + 1], label).sum(dtype=np.float64)) for k in range(0, n, step)) / n
        return mean >= self.middle[label] - self.slack - self.noise / n**0.5


def fit(docs: DataFrame, sample_docs: int = 1600, sample_windows: int = 1 << 14, fold: int = 2, folds: int = 4, most_langs: int = 10000, **kw) -> tuple[Network | None, list[str]]:
    """A network and its languages, from rows whose crc32(doc_id as text) mod `folds` is not `fold`.

    Only windows of about `sample_docs` rows reach the driver, `sample_windows`
    of WINDOW bytes at most, whatever the length of the texts. The counts of
    languages go to every task while there are `most_langs` or fewer, and are
    joined by a shuffle beyond that. Rows without a doc_id, a language or a
    letter don't train; of windows that tie for the last place any may stay
    out, the same each time. Without labelled rows there is no network.
    """
    rows = pick(docs, doc_id="bigint", text="string", lang="string").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds != fold, F.lit(False)))
    counts = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")))
    n_langs = counts.count()
    counts = F.broadcast(counts) if n_langs <= most_langs else counts
    # The i-th smallest of a language's n even numbers is about i / n, so even * n is about the place of a document in it.
    even = key60(F.lit("sample"), F.col("doc_id")) / F.lit(float(1 << 60))
    sample = rows.join(counts, "lang").where(even * F.col("_n") < sample_docs / max(1, n_langs))
    place = F.explode(F.sequence(F.lit(0).cast("long"), (F.octet_length("text") - 1).cast("long"), F.lit(WINDOW).cast("long"))).alias("_at")
    cuts = sample.select("doc_id", "lang", F.encode("text", "UTF-8").alias("_raw"), place)
    cuts = cuts.select("doc_id", "lang", "_at", F.expr(f"substring(_raw, cast(_at + 1 as int), {WINDOW})").alias("_part"))
    got = cuts.orderBy(key60(F.lit("window"), F.col("doc_id"), F.col("_at")), "doc_id", "_at", "_part").limit(sample_windows).collect()
    langs = sorted({r.lang for r in got})
    if not langs:
        return None, []
    whole: dict[tuple[int, str], list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.lang, r["_at"])):
        whole.setdefault((r.doc_id, r.lang), []).append(bytes(r["_part"]))
    texts, labels = [b"".join(w) for w in whole.values()], np.array([langs.index(lang) for _, lang in whole])
    net = train(texts, labels, len(langs), **kw)
    # Of a few texts nothing is known about how unlikely others of their languages are.
    net.typical = Typical(texts, labels, len(langs)) if len(texts) >= 24 else None
    return net, langs


def _predict(batch, net: Network | None, langs: list[str], most: int = 4 << 20):
    """(start, stop, languages, scores, sizes in bytes) over an Arrow batch with text and _letter."""
    raw, letter, done = batch.column("text").cast(pa.binary()), batch.column("_letter").to_pylist(), 0
    while done < batch.num_rows:
        stop, held, texts = done, 0, []
        while stop < batch.num_rows and (not texts or held < most):
            texts.append((raw[stop].as_py() if letter[stop] else None) or b"")
            held += len(texts[-1])
            stop += 1
        p = pooled(net, texts, len(langs)) if net else np.zeros((len(texts), 1))
        best, known = p.argmax(1), [bool(net and t) for t in texts]
        yield done, stop, [langs[b] if k else "und" for b, k in zip(best, known, strict=True)], [min(1.0, float(q[b])) if k else 0.0 for q, b, k in zip(p, best, known, strict=True)], [len(t) for t in texts]
        done = stop


def _lettered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, net: Network | None, langs: list[str]) -> DataFrame:
    """doc_id, lang_pred, score per input row, repeated rows included.

    `und` with score 0 if the text is null, has no letter, or nothing was
    learned. Of equally probable languages the first by code point is taken. A
    null doc_id stays null; an empty table gives an empty result; columns
    beside doc_id and text are not looked at.
    """

    def run(batches):
        for batch in batches:
            for start, stop, lang, score, _ in _predict(batch, net, langs):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[start:stop], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return _lettered(pick(docs, doc_id="bigint", text="string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, net: Network | None, langs: list[str], least: float = 0.3) -> DataFrame:
    """The documents whose language is known with a score of `least` or more and that are likely texts of it; columns as given.

    A text in a language that wasn't learned also has a most probable one, so it
    is told by its likelihood in that one (Typical). With nothing learned no
    language is known to be wrong and all rows stay. Null and empty texts go,
    repeated rows are judged alike, an empty table stays empty and other
    columns may hold nulls and have any names.
    """
    if net is None:
        return docs
    ship(docs.sparkSession)
    names = docs.columns
    at, place = names.index("text"), {la: k for k, la in enumerate(langs)}

    def run(batches):
        for batch in batches:
            plain = batch.select(list(range(len(names))))
            for start, stop, lang, score, _ in _predict(pa.RecordBatch.from_arrays([batch.column(at), batch.column(len(names))], ["text", "_letter"]), net, langs):
                fits = (la != "und" and s >= least and (not net.typical or net.typical.fits(t, place[la])) for la, s, t in zip(lang, score, batch.column(at).cast(pa.binary())[start:stop].to_pylist(), strict=True))
                yield plain.slice(start, stop - start).filter(pa.array(list(fits), pa.bool_()))

    rows, (text,) = numbered(docs, "text")
    lettered = rows.withColumn("_letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return lettered.mapInArrow(run, rows.schema).toDF(*names)


def label_positions(net: Network, langs: list[str], text: str) -> list[str]:
    """The most probable language at every byte of one text."""
    raw = text.encode()
    wins, _, _ = windows([raw])
    best = net.probabilities(np.ascontiguousarray(wins.T)).argmax(1).T.reshape(-1)[: len(raw)]
    return [langs[b] for b in best]
