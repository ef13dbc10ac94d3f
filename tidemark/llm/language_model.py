"""Language-model scoring with a sharded Elias-Fano n-gram trie in memory-mapped files.

Training counts words and, level by level, runs of up to `order` tokens over all
training rows. The first level holds the sorted hashes of all words and the
running total of their counts: differences are exact counts, and the total up to
a word is where its pairs begin in the corpus. Every further level holds its
contexts, which are entries of the level above, and, as monotone pointers, the
range of children of each; then the children, made one monotone sequence by
adding their context's rank times the number of words. Beside each child are its
smoothed probability and, for its own children, its count, both quantised to 16
bits. An n-gram is found by its context, the context's range,
and a successor search for the word among the children of this range.

p(w | h) = (c(h w) + k p(w | h')) / (c(h) + k), h' being h without its first
token, and p(w) = (c(w) + 1) / (N + V + 1). A text's first token has the start
of texts as its context, the next one the start and the first token, and no
context reaches further back than that.

The levels are cut into shards of about `shard_tokens` by hash and by where an
n-gram lies in the running totals: a context with very many tokens behind it is
spread over as many shards by the same rule. Shards are built in parallel,
written to the shared folder and mapped by the scoring tasks, which never hold a
level in memory. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias_fano import Sequence, build, mapped, save
from .runtime import cut, fresh_path, pick, release, runs

LOWEST, STEPS = -16.0, 65535
#: An n-gram's id is its shard's number and, in so many bits, its place in the shard.
SHARD_BITS = 32


def packed(x: np.ndarray) -> np.ndarray:
    """Logarithms between LOWEST and 0 in 16 bits."""
    return np.round(np.clip(x / LOWEST, 0, 1) * STEPS).astype(np.uint16)


def unpacked(q: np.ndarray) -> np.ndarray:
    return LOWEST * (q / STEPS)


def packed_counts(n: np.ndarray) -> np.ndarray:
    """Counts in 16 bits: 11 bits of the number and 5 of its length, exact below 2,048."""
    shift = np.maximum(np.frexp(n.astype(float))[1] - 11, 0).astype(np.int64)
    top = (n + (1 << shift >> 1)) >> shift
    over = top >> 11
    return ((shift + over) << 11 | top >> over).astype(np.uint16)


def unpacked_counts(q: np.ndarray) -> np.ndarray:
    q = q.astype(np.int64)
    return (q & 2047) << (q >> 11)


#: Words are hashed in pieces of eight bytes, and those of more bytes than this on their own.
HASHED_BYTES = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which every bit depends on all."""
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93), (32, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


def _hash(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """64-bit hashes of the words that begin at these bytes, by chunks that stay in the cache."""
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.empty(len(begin), np.uint64)
    for k in range(0, len(begin), chunk):
        out[k : k + chunk] = _hashed(raw, begin[k : k + chunk], size[k : k + chunk])
    return out


def _hashed(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words in bytes that eight more follow; different words of one size up to eight bytes have different ones."""
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    out = _mixed(_mixed(size.astype(np.uint64)) ^ (eight[begin] & masks[np.minimum(size, 8)]))
    left = np.flatnonzero((size > 8) & (size <= HASHED_BYTES))
    for at in range(8, HASHED_BYTES, 8):
        left = left[size[left] > at]
        out[left] = _mixed(out[left] ^ (eight[begin[left] + at] & masks[np.minimum(size[left] - at, 8)]))
    long = np.flatnonzero(size > HASHED_BYTES)
    if len(long):
        from xxhash import xxh64_intdigest

        out[long] = [xxh64_intdigest(raw[a : a + n]) for a, n in zip(begin[long].tolist(), size[long].tolist())]
    return out


#: The hash of a space, which no word holds, stands for the end of a text.
END_HASH = _hash(np.frombuffer(b" ", np.uint8), np.array([0]), np.array([1]))


class Tokens:
    """The tokens of some texts: codes into `hashes`, the last of which is the end."""

    def __init__(self, texts):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        held = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = split.flatten().cast(pa.large_binary())
        _, at, raw = flat.buffers()
        at = np.frombuffer(at, np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        begin, size = at[:-1], np.diff(at)
        if not size.all():
            some = size > 0
            held = np.bincount(np.repeat(np.arange(len(held)), held)[some], minlength=len(held))
            begin, size = begin[some], size[some]
        words = pa.array(_hash(np.frombuffer(raw or b"", np.uint8), begin, size).view(np.int64)).dictionary_encode()
        self.n_docs, self.hashes = len(held), np.append(words.dictionary.to_numpy().view(np.uint64), END_HASH)
        self.sizes = held + 1
        # Each text's words, then its end.
        last = np.cumsum(self.sizes) - 1
        inner = np.ones(int(self.sizes.sum()), bool)
        inner[last] = False
        self.codes = np.full(len(inner), len(self.hashes) - 1, np.int32)
        self.codes[inner] = words.indices.to_numpy()
        #: The code before each token; one past the end stands for the start.
        self.before = np.empty_like(self.codes)
        self.before[1:] = self.codes[:-1]
        self.before[last - held] = len(self.hashes)

    @property
    def doc(self) -> np.ndarray:
        """Which text each token is of."""
        return np.repeat(np.arange(self.n_docs), self.sizes)


def _parts(batch, most: int = 8 << 20):
    """Slices of an Arrow batch of about `most` bytes of text, or of one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    cuts, held = [0], 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            cuts.append(i)
            held = 0
        held += n
    cuts.append(len(sizes))
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def _by_parts(f):
    """A function for mapInArrow that gives f(slice) for every slice; of a slice nothing stays when the next one begins."""

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                yield f(part)
                release()

    return run


class Words:
    """Level one, shard by shard: ids and counts of hashed words."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.sizes = folder, sizes
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.total = int(self.base[-1])

    def _shard(self, k: int):
        arrays = mapped(f"{self.folder}/words-{k}")
        return Sequence(arrays, "hash"), Sequence(arrays, "sum")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids, -1 for words that were never seen."""
        shard = (((hashes >> np.uint64(48)).astype(np.int64)) * len(self.sizes)) >> 16
        out = np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes, kind="stable")
        for k in np.unique(shard).tolist():
            at = order[shard[order] == k]
            if self.sizes[k]:
                found = self._shard(k)[0].find(hashes[at])
                out[at] = np.where(found >= 0, found + self.base[k], -1)
        return out

    def sums(self, ids: np.ndarray) -> np.ndarray:
        """Training tokens of this word's shard and below, up to before this id; relative to the shard's start."""
        shard = np.searchsorted(self.base, ids, "right") - 1
        out = np.zeros(len(ids), np.int64)
        for k in np.unique(shard).tolist():
            at = np.flatnonzero(shard == k)
            out[at] = self._shard(k)[1].get(ids[at] - self.base[k]).astype(np.int64)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Exact counts; 0 for -1."""
        out, known = np.zeros(len(ids), np.int64), np.flatnonzero(ids >= 0)
        shard = np.searchsorted(self.base, ids[known], "right") - 1
        for k in np.unique(shard).tolist():
            at = known[shard == k]
            local, s = ids[at] - self.base[k], self._shard(k)[1]
            out[at] = (s.get(local + 1) - s.get(local)).astype(np.int64)
        return out


@dataclass
class Grams:
    """The different n-grams of some texts at one level, in the order of their contexts and words."""

    context: np.ndarray
    word: np.ndarray
    shard: np.ndarray
    #: Of a level that isn't built: how often these texts have each of them, and log10 of what one level above gives it.
    times: np.ndarray | None = None
    lower: np.ndarray | None = None


class Model:
    """What a task needs to look n-grams up; the levels stay in their files."""

    def __init__(self, words: Words, starts: list[int], tokens: int, docs: int, shards: int, strength: float):
        self.words, self.starts, self.tokens, self.docs, self.shards, self.strength = words, np.array(starts, np.int64), tokens, docs, shards, strength
        #: The highest level whose files are complete.
        self.built = 1

    def place(self, ids: np.ndarray) -> np.ndarray:
        """How many training tokens come before each word in the order of ids; the start of texts is last."""
        out = np.full(len(ids), self.tokens, np.int64)
        known = np.flatnonzero((ids >= 0) & (ids < self.words.total))
        shard = np.searchsorted(self.words.base, ids[known], "right") - 1
        out[known] = self.words.sums(ids[known]) + self.starts[shard]
        return out

    def path(self, level: int, shard: int) -> str:
        return f"{self.words.folder}/grams-{level}-{shard}"

    def find(self, level: int, g: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of n-grams (-1 if never seen), their log10 probabilities, and their counts."""
        ids, p, n = np.full(len(g.context), -1, np.int64), np.zeros(len(g.context)), np.zeros(len(g.context), np.int64)
        known = np.flatnonzero((g.context >= 0) & (g.word >= 0))
        known = known[np.argsort(g.shard[known], kind="stable")]
        for k, part in stretches(g.shard[known]):
            arrays = mapped(self.path(level, k))
            if not arrays:
                continue
            at = known[part]
            context = g.context[at]
            # Contexts come in stretches; each is looked up once and gives the range of its children.
            first = np.flatnonzero(np.diff(context, prepend=-1))
            asked = context[first] - int(arrays["base"][0])
            rank = Sequence(arrays, "context").find(np.where(asked >= 0, asked, np.iinfo(np.int64).max).astype(np.uint64))
            child, some = Sequence(arrays, "child"), np.maximum(rank, 0)
            begin, end = (np.where(rank >= 0, child.get(some + up).astype(np.int64), 0) for up in (0, 1))
            each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
            open_ = np.flatnonzero(end[each] > begin[each])
            each = each[open_]
            local = Sequence(arrays, "word").find((rank[each] * self.words.total + g.word[at[open_]]).astype(np.uint64))
            hit = (local >= begin[each]) & (local < end[each])
            at, local = at[open_[hit]], local[hit]
            ids[at], p[at] = (k << SHARD_BITS) + local, unpacked(arrays["p"][local])
            if "n" in arrays:
                n[at] = unpacked_counts(arrays["n"][local])
        return ids, p, n

    def counts(self, level: int, ids: np.ndarray) -> np.ndarray:
        """Counts of the n-grams with these ids, which are sorted."""
        out = np.zeros(len(ids), np.int64)
        for k, part in stretches(ids >> SHARD_BITS):
            out[part] = unpacked_counts(mapped(self.path(level, k))["n"][ids[part] & ((1 << SHARD_BITS) - 1)])
        return out

    def levels(self, t: Tokens, top: int) -> Grams | None:
        """The n-grams of the level `top` if that isn't built; leaves counts and base log10 probabilities of the different words, and the tokens' words and own log10 probabilities, in `t`.

        Levels that are built are looked up, so that the one after them has
        their ids as contexts. An array with an element for each token is kept
        no longer than it is read, and those that stay are of 32 bits where
        these do: such arrays are what a worker's memory is made of.
        """
        w = self.words
        ids = w.find(t.hashes) if w.total else np.full(len(t.hashes), -1)
        order = np.argsort(ids, kind="stable")
        rank = np.append(np.argsort(order), len(order)).astype(np.int32)
        ids, first = np.append(ids[order], w.total), t.before == len(t.hashes)
        t.word, context = rank[t.codes], rank[t.before]
        t.codes = t.before = None
        n, place = np.append(w.counts(ids[:-1]), self.docs), self.place(ids).astype(float)
        t.n, t.base = n[:-1], np.log10((n[:-1] + 1) / (self.tokens + w.total + 1))
        t.p = t.base[t.word]
        # Of contexts: their ids, their counts, and where they lie in the running totals.
        its, held, begins, share = ids, n, place, place / max(1, self.tokens)
        for level in range(2, top + 1):
            tokens = np.flatnonzero(context >= 0).astype(np.int32)
            pairs = context[tokens] * np.int64(len(ids))
            context = None
            pairs += t.word[tokens]
            gram, of = unique(pairs)
            pairs = None
            a, b = gram // len(ids), gram % len(ids)
            at = begins[a] + held[a] * share[b]
            shard = (at * (self.shards / max(1, self.tokens + self.docs))).astype(np.int64) % self.shards
            g = Grams(its[a], ids[b], shard)
            if level > self.built:
                some = np.zeros(len(gram), np.int32)
                some[of] = tokens  # any of its tokens: the level above gives the same to all
                g.times, g.lower = np.bincount(of, minlength=len(gram)), t.p[some]
                return g
            back = np.log10(self.strength / (held[a] + self.strength))
            begins = at
            gram = a = b = its = seen = held = at = shard = None
            its, seen, held = self.find(level, g)
            g = None
            p = np.where(its >= 0, seen, back)[of]
            open_ = np.flatnonzero((its < 0)[of])
            p[open_] += t.p[tokens[open_]]
            t.p[tokens] = p
            p = open_ = None
            if level < top:
                # The next token's context is this n-gram, if it was ever seen and the text goes on.
                context = np.full(len(first) + 1, -1, np.int32)
                context[tokens + 1] = np.where(its >= 0, np.arange(len(its), dtype=np.int32), np.int32(-1))[of]
                context = context[:-1]
                context[first] = -1
        return None


def unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and which of them each value is; sorts values and places as one number where both fit."""
    bits = len(values).bit_length()
    if not len(values) or int(values.min()) < 0 or int(values.max()) >> (63 - bits):
        return np.unique(values, return_inverse=True)
    both = values << bits
    both |= np.arange(len(values))
    both.sort()
    place = both & ((1 << bits) - 1)
    both >>= bits
    new = np.ones(len(values), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    values, both = both[new], None
    rank = np.cumsum(new, dtype=np.int32 if bits < 32 else np.int64)
    rank -= 1
    which = np.empty_like(rank)
    which[place] = rank
    return values, which


def stretches(values: np.ndarray):
    """(value, slice) of each stretch of equal values."""
    cuts = [*np.flatnonzero(np.diff(values, prepend=-1)).tolist(), len(values)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(values[a]), slice(a, b)


def _training(fold: int, folds: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds != fold, F.lit(False))


def train(docs: DataFrame, fold: int = 2, folds: int = 7, shard_tokens: int = 1 << 20, strength: float = 50.0, order: int = 3) -> Model:
    """A model of all rows whose crc32(doc_id as text) mod `folds` is not `fold`.

    Rows without a doc_id don't train; null and empty texts train as their end
    alone; repeated rows count each time. Of an empty table the model knows
    nothing. Extra columns are not looked at. `order` is the longest n-gram, 2
    at least.
    """
    spark = docs.sparkSession
    texts = pick(docs, doc_id="bigint", text="string").where(_training(fold, folds)).select("text")

    def count(part):
        t = Tokens(part.column("text"))
        n = np.bincount(t.codes, minlength=len(t.hashes))
        return pa.RecordBatch.from_arrays([pa.array(t.hashes.view(np.int64)), pa.array(n)], ["hash", "n"])

    counts = cut(texts.mapInArrow(_by_parts(count), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    vocabulary, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    end = int(END_HASH.view(np.int64)[0])
    row = counts.where(F.col("hash") == end).first()
    n_docs = row.n if row else 0
    folder, word_shards = fresh_path(spark, "ngrams"), max(1, min(1 << 16, -(-vocabulary // shard_tokens)))

    def write_words(batches):
        held, at = [], None

        def close():
            h = np.concatenate([x[0] for x in held])
            order = np.argsort(h)
            n = np.concatenate([x[1] for x in held])[order]
            held.clear()
            save(f"{folder}/words-{at}", build(h[order], "hash") | build(np.concatenate([[0], np.cumsum(n)]), "sum"))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["shard", "size", "tokens"])

        for (k,), part in runs(batches, ["shard"]):
            if k != at:
                if held:
                    yield close()
                    release()
                held, at = [], k
            held.append((part.column("hash").to_numpy().view(np.uint64), part.column("n").to_numpy()))
        if held:
            yield close()
            release()

    shard = F.shiftright(F.shiftrightunsigned("hash", 48) * word_shards, 16)
    made = {r.shard: r for r in counts.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard").mapInArrow(write_words, "shard long, size long, tokens long").collect()}
    sizes = [made[k].size if k in made else 0 for k in range(word_shards)]
    below = np.concatenate([[0], np.cumsum([made[k].tokens if k in made else 0 for k in range(word_shards)])]).tolist()
    model = Model(Words(folder, sizes), below, int(tokens), int(n_docs), max(1, -(-(int(tokens)) // shard_tokens)), strength)
    if not tokens:
        return model

    def count_grams(level):
        def count(part):
            import zstandard

            squeeze = zstandard.ZstdCompressor(level=1)
            g = model.levels(Tokens(part.column("text")), level)
            lower, order = packed(g.lower), np.argsort(g.shard, kind="stable")
            shards, blobs = [], []
            for k, s in stretches(g.shard[order]):
                at = order[s]
                new, steps = np.diff(g.context[at], prepend=-1), np.diff(g.word[at], prepend=0)
                steps[new != 0] = g.word[at[new != 0]]
                columns = [new, steps, g.times[at].astype(np.uint32), *([lower[at]] if level > 2 else [])]
                planes = np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(len(at), -1) for c in columns], 1)
                shards.append(k)
                blobs.append(squeeze.compress(np.ascontiguousarray(planes.T).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "grams"])

        return _by_parts(count)

    def write_grams(level):
        def write(batches):
            import zstandard

            expand, w = zstandard.ZstdDecompressor(), model.words
            held, at = [], None

            def opened(blob):
                planes = np.frombuffer(expand.decompress(blob), np.uint8).reshape(20 if level == 2 else 22, -1).T
                new, steps, times, *lower = (np.ascontiguousarray(planes[:, i:j]).view(kind)[:, 0] for i, j, kind in ((0, 8, np.int64), (8, 16, np.int64), (16, 20, np.uint32), (20, 22, np.uint16))[: 3 if level == 2 else 4])
                total, starts = np.cumsum(steps), np.flatnonzero(new)
                word = total - np.repeat((total - steps)[starts], np.diff(np.append(starts, len(new))))
                return np.cumsum(new) - 1, word, times, *lower

            def close():
                context, word, times, *lower = [np.concatenate(c) for c in zip(*held)]
                held.clear()
                seen, rank = unique(context)
                word += rank * np.int64(w.total)
                key, same = unique(word)
                n = np.bincount(same, times).astype(np.int64)
                if level > 2:
                    # Every slice has found the same for an n-gram.
                    own = np.empty(len(key), np.uint16)
                    own[same] = lower[0]
                context = word = times = lower = same = None
                rank = key // w.total
                if level == 2:
                    counts = np.where(seen < w.total, w.counts(np.where(seen < w.total, seen, -1)), model.docs)
                    uniq, back = np.unique(key % w.total, return_inverse=True)
                    own = ((w.counts(uniq) + 1) / (model.tokens + w.total + 1))[back]
                else:
                    counts, own = model.counts(level - 1, seen), 10 ** unpacked(own)
                p = np.log10((n + strength * own) / (counts[rank] + strength))
                arrays = build(seen - seen[0], "context") | build(np.searchsorted(rank, np.arange(len(seen) + 1)), "child") | build(key, "word") | {"base": seen[:1], "p": packed(p)}
                save(model.path(level, at), arrays | ({"n": packed_counts(n)} if level < order else {}))
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([len(key)], pa.int64())], ["shard", "size"])

            for (k,), part in runs(batches, ["shard"]):
                if k != at:
                    if held:
                        yield close()
                        release()
                    held, at = [], k
                held.extend(map(opened, part.column("grams").to_pylist()))
            if held:
                yield close()
                release()

        return write

    for level in range(2, order + 1):
        written = texts.mapInArrow(count_grams(level), "shard long, grams binary").repartition("shard").sortWithinPartitions("shard").mapInArrow(write_grams(level), "shard long, size long")
        if written.agg(F.sum("size")).first()[0] is None and level == 2:
            raise RuntimeError("a model of tokens without pairs")
        model.built = level
    return model


def score(docs: DataFrame, model: Model, fold: int = 2, folds: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row, repeated rows included.

    A null or empty text is its end alone. held_out is false for rows without a
    doc_id, which don't train either. Without training rows all counts are 0.
    Equal texts score alike. An empty table gives an empty result; extra
    columns are not looked at.
    """

    def scored(part):
        t = Tokens(part.column("text"))
        model.levels(t, model.built)
        doc = t.doc
        total = lambda x: np.bincount(doc, x, minlength=t.n_docs)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("held_out"), pa.array(t.sizes, pa.int64()), pa.array(total((t.n > 0)[t.word]).astype(np.int64)), pa.array(np.full(t.n_docs, model.tokens, np.int64)), pa.array(total(t.base[t.word])), pa.array(total(t.p))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    rows = pick(docs, doc_id="bigint", text="string").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False)))
    return rows.mapInArrow(_by_parts(scored), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
