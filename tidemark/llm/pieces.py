"""A merge-type sentencepiece vocabulary: agenda encoding, decoding and exact prefix counts.

The vocabulary file is read with the sentencepiece library; what is done with
it is this module's own. No piece of the vocabularies taken here holds a space
mark behind another character, so no merge crosses a word's start and a text
is the concatenation of its words. Words repeat, so every worker keeps what it
found for a word, in two generations: when the young one is full it becomes the
old one, and a word met again moves over. `keep_bytes` bounds both together and
changes no result.

Words not met yet are merged many at a time: the agenda of each word is one
column of an array, and a step takes the first entry of every agenda. Texts are
cut into words, words into ids, and ids into texts by whole columns as well.
Words are held with plain spaces, as which a mark in a text counts too.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
END = 2
NEVER = float("inf")

# An agenda entry: the rank of the pair's piece, the pair's place, the piece.
RANK, PLACE = 28, 22
IDLE = np.iinfo(np.int64).max
#: Words of up to this many characters share arrays; a longer word has an agenda of its own.
SHARED = 48


class Strings:
    """Many byte strings or arrays in one array."""

    def __init__(self, values: list[bytes], kind=np.uint8):
        self.flat = np.frombuffer(b"".join(values), kind)
        self.sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.flat.itemsize
        self.starts = np.cumsum(self.sizes) - self.sizes

    def take(self, which: np.ndarray, step: int = 1 << 17) -> np.ndarray:
        """The strings of these numbers, one behind the other."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[which])])
        out = np.empty(int(ends[-1]), self.flat.dtype)
        for k in range(0, len(which), step):
            part, at = which[k : k + step], ends[k : k + step + 1]
            shift = np.repeat(self.starts[part] - at[:-1], np.diff(at))
            out[at[0] : at[-1]] = self.flat[shift + np.arange(at[0], at[-1])]
        return out

    def ends(self, which: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Where stretches of `which`, closed at `cuts`, end in what take() gives."""
        return np.concatenate([[0], np.cumsum(self.sizes[which])])[cuts]


def strings_of(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow array of the texts that end at these bytes; the first starts at 0."""
    return pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(flat)])


class Generations:
    """Results by word, bounded by the bytes they are charged with."""

    def __init__(self, keep_bytes: int):
        self.most, self.held = keep_bytes // 2, 0
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def missing(self, words) -> list[str]:
        """Those of some distinct words of which nothing is known; what the old generation knows moves over."""
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        away = [w for w in words if w not in self.young]
        again = {w: self.old[w] for w in away if w in self.old}
        self.add(again)
        return [w for w in away if w not in again] if again else away

    def add(self, found: dict) -> None:
        self.young.update(found)
        self.held += 240 * len(found) + 4 * sum(map(len, found)) + sum(map(len, found.values()))


class Pieces:
    """One vocabulary, loaded once a worker."""

    def __init__(self, path: str, keep_bytes: int = 192 << 20):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {self.names[i]: i for i in normal}
        self.rank = {self.names[i]: -sp.get_score(i) for i in normal}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("this vocabulary has pieces that cross words")
        self.alone = next(c for c in "\n\r\t\x0b\x0c" if not any(c in p for p in self.ids))
        self.split = re.compile(f" *[^ {self.alone}]+| +|{self.alone}").findall
        self.raw = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.names)]
        self.raw_of = {str(i): r for i, r in enumerate(self.raw)}
        #: By string: the id of a piece that is encoded as itself, and so may end a prefix; -1 for tails of such pieces.
        firm = {p: i for p, i in self.ids.items() if self.merge(p) == [p]}
        self.tails = {p[k:]: -1 for p in firm for k in range(1, len(p))} | firm
        self.stranger = n  # stands for a character outside the vocabulary
        self._pairs(n)
        self.decimals, self.plain = Strings([b" %d" % i for i in range(n)]), Strings(self.raw)
        self.encoded, self.counted = Generations(keep_bytes), Generations(keep_bytes)
        self.fits: dict[int, bool] = {}

    def _pairs(self, n: int) -> None:
        """All pairs of symbols that make a piece, by sorted number, with their rank and piece.

        A symbol is a piece or, past the pieces, any other single character.
        """
        ranks = {s: k for k, s in enumerate(sorted(set(self.rank.values())))}
        made = {}

        def code(s: str) -> int:
            return self.ids[s] if s in self.ids else n + ord(s)

        for p, i in self.ids.items():
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                if (k == 1 or left in self.ids) and (k == len(p) - 1 or right in self.ids):
                    made[code(left) << 32 | code(right)] = ranks[self.rank[p]] << RANK | i
        self.pair_keys = np.array(sorted(made), np.int64)
        self.pair_entries = np.array([made[k] for k in sorted(made)], np.int64)
        size = 1 << max(4, (4 * len(made)).bit_length())
        self.pair_shift, self.pair_slots, self.pair_at = np.uint64(64 - size.bit_length() + 1), size, np.full(size, len(made), np.int32)
        # Open addressing: a pair lies at its hash or the next free place behind it.
        for j, h in enumerate(self._slot(self.pair_keys).tolist()):
            while self.pair_at[h] != len(made):
                h = (h + 1) % size
            self.pair_at[h] = j
        self.pair_keys, self.pair_entries = np.append(self.pair_keys, -1), np.append(self.pair_entries, IDLE)
        self.codes = np.arange(0x110000, dtype=np.int32) + np.int32(n)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.codes[ord(c)] = i
        self.codes[ord(" ")] = self.codes[ord(MARK)]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.pair_shift).astype(np.int64)

    def entries(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Agenda entries, without their places, of pairs of symbols; IDLE for pairs that make no piece."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        at = self.pair_at[slot]
        last = len(self.pair_keys) - 1
        open_ = np.flatnonzero((self.pair_keys[at] != keys) & (at != last))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.pair_slots
            at[open_] = self.pair_at[slot[open_]]
            open_ = open_[(self.pair_keys[at[open_]] != keys[open_]) & (at[open_] != last)]
        return self.pair_entries[at]

    def spaced(self, text: str) -> str:
        """The text as it is cut into words."""
        return " " + text.replace(MARK, " ") if text else ""

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(where each text ends, counted in words; words by number; distinct words) of texts, null being empty."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        flat = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        space, alone = flat == 32, flat == ord(self.alone)
        first = alone.copy()
        first[1:] |= alone[:-1] | (space[1:] & ~space[:-1])
        first[ends[:-1][ends[:-1] < len(flat)]] = True
        starts = np.flatnonzero(first)
        found = strings_of(flat, np.append(starts[1:], len(flat)) if len(starts) else starts).dictionary_encode()
        return np.searchsorted(starts, ends[1:]), found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()

    def merge(self, word: str) -> list[str]:
        """The symbols left when the agenda of adjacent pairs is empty.

        The best-scoring pair goes first, the leftmost of equals. Short words
        keep the agenda as a list of pair scores, long ones as a heap.
        """
        if len(word) > 48:
            return self.merge_long(word)
        rank = self.rank.get
        symbols = list(word)
        agenda = [rank(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            pair = symbols[i] + symbols[i + 1]
            symbols[i : i + 2] = (pair,)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + pair, NEVER)
            if i < len(agenda):
                agenda[i] = rank(pair + symbols[i + 1], NEVER)
        return symbols

    def merge_long(self, word: str) -> list[str]:
        """The same with a heap; an entry whose symbols have changed meanwhile is passed over."""
        rank, n = self.rank, len(word)
        symbols = list(word)
        agenda = [(rank[pair], i, pair) for i in range(n - 1) if (pair := word[i : i + 2]) in rank]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left, j = symbols[i], after[i]
            if not left or j >= n or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (grown := pair + symbols[k]) in rank:
                    heapq.heappush(agenda, (rank[grown], i, grown))
            if (h := before[i]) >= 0 and (grown := symbols[h] + pair) in rank:
                heapq.heappush(agenda, (rank[grown], h, grown))
        return [s for s in symbols if s]

    def to_ids(self, symbols: list[str]) -> list[int]:
        """Ids of symbols; those outside the vocabulary fall back to bytes."""
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
        return out

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """Ids of words of up to SHARED characters, by agendas that take their steps together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n, width = len(words), int(sizes.max())
        flat = self.codes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        # Symbols by place and word, and the places before and behind that still hold one; place `width` holds none.
        row = np.repeat(np.arange(n), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbols = np.full((width + 1) * n, -1, np.int32)
        symbols[place * n + row] = flat
        after, before = (np.repeat(np.arange(width + 1, dtype=np.int8) + np.int8(d), n) for d in (1, -1))
        ends = symbols.reshape(-1, n)
        agenda = self.entries(ends[:-2].reshape(-1), ends[1:-1].reshape(-1)).reshape(width - 1, n)
        agenda += np.where(agenda == IDLE, 0, np.arange(len(agenda), dtype=np.int64)[:, None] << PLACE)
        live = np.arange(n)
        while len(live) and len(agenda):
            first = agenda.min(0)
            going = first != IDLE
            if not going.all():
                live, agenda, first = live[going], np.compress(going, agenda, axis=1), first[going]
            if not len(live):
                break
            col, here = np.arange(len(live)), (first >> PLACE) & ((1 << (RANK - PLACE)) - 1)
            made = (first & ((1 << PLACE) - 1)).astype(np.int32)
            at = here * n + live
            gone = after[at].astype(np.int64)
            nxt = after[gone * n + live].astype(np.int64)
            symbols[at], symbols[gone * n + live] = made, -1
            after[at] = nxt
            inside = nxt < width
            before[nxt[inside] * n + live[inside]] = here[inside]
            flat_agenda, m = agenda.reshape(-1), len(live)
            gone_in = gone < len(agenda)
            flat_agenda[gone[gone_in] * m + col[gone_in]] = IDLE
            right = np.where(inside, symbols[np.minimum(nxt, width) * n + live], -1)
            entry = self.entries(made, right)
            entry += np.where(entry == IDLE, 0, here << PLACE)
            here_in = here < len(agenda)
            flat_agenda[here[here_in] * m + col[here_in]] = entry[here_in]
            prev = before[at].astype(np.int64)
            has = np.flatnonzero(prev >= 0)
            entry = self.entries(symbols[prev[has] * n + live[has]], made[has])
            entry += np.where(entry == IDLE, 0, prev[has] << PLACE)
            flat_agenda[prev[has] * m + has] = entry
        by_word = symbols.reshape(-1, n).T
        left = by_word >= 0
        kept, cuts = by_word[left].tolist(), np.cumsum(left.sum(1)).tolist()
        out = [kept[a:b] for a, b in zip([0, *cuts], cuts)]
        pieces = len(self.names)
        for k in np.flatnonzero((by_word >= pieces).any(1)).tolist():
            out[k] = self.to_ids([self.names[i] if i < pieces else chr(i - pieces) for i in out[k]])
        return out

    def found(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words; those of about the same length share arrays."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list[list[int]] = [[]] * len(words)
        k = 0
        while k < len(order) and len(words[order[k]]) <= SHARED:
            most = min(SHARED, max(8, len(words[order[k]]) * 5 // 4))
            stop = k
            while stop < len(order) and stop < k + 16384 and len(words[order[stop]]) <= most:
                stop += 1
            for i, ids in zip(order[k:stop], self.merge_many([words[i] for i in order[k:stop]]), strict=True):
                out[i] = ids
            k = stop
        for i in order[k:]:
            out[i] = self.to_ids(self.merge_long(words[i].replace(" ", MARK)))
        return out

    def confirm(self, words: list[str], found: list[list[int]]) -> None:
        """Has the library encode the words, held apart by a character that no piece holds, and compares."""
        if not words:
            return
        apart = self.to_ids([self.alone])
        theirs = np.array(self.library.encode(self.alone + self.alone.join(words), num_threads=1), np.int32)
        ours = self.to_ids(self.merge(MARK)) + apart
        for ids in found:
            ours += ids
            ours += apart
        if not np.array_equal(theirs, np.array(ours[: -len(apart)], np.int32)):
            if len(words) == 1:
                raise ValueError(f"the library encodes {words[0]!r} as {theirs.tolist()}, not {ours}")
            half = len(words) // 2
            self.confirm(words[:half], found[:half])
            self.confirm(words[half:], found[half:])
            raise ValueError("the library encodes these words otherwise together than apart")

    def learn(self, words: list[str], check: bool = True) -> None:
        """Encodes distinct words not known yet; with `check` the library must agree on each."""
        found = self.found(words)
        if check:
            self.confirm(words, found)
        cuts = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) * 4
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(cuts[-1]) // 4 if len(cuts) else 0).tobytes()
        self.encoded.add({w: flat[a:b] for w, a, b in zip(words, [0, *cuts.tolist()], cuts.tolist())})

    def encode_texts(self, texts: pa.Array, check: bool = True) -> tuple[pa.Array, pa.Array, pa.Array]:
        """(ids joined by one space, how many, decoded text) of each text; the end id is the last."""
        ends, words, distinct = self.words(texts)
        self.learn(self.encoded.missing(distinct), check)
        known = Strings(list(map(self.encoded.young.__getitem__, distinct)), np.int32)
        at = known.ends(words, ends)
        ids, ends = np.insert(known.take(words), at, END), at + np.arange(1, len(at) + 1)
        # Every decimal has a space before it; that of a text's first goes. So does the one put before a text.
        decimals, stops = self.decimals.take(ids), self.decimals.ends(ids, ends)
        decimals = np.delete(decimals, np.append(0, stops[:-1])) if len(stops) else decimals
        plain, cuts = self.plain.take(ids), self.plain.ends(ids, ends)
        lead = np.append(0, cuts[:-1]) if len(cuts) else cuts
        lead, some = lead[lead < cuts], (lead < cuts).cumsum()
        return strings_of(decimals, stops - np.arange(1, len(stops) + 1)), pa.array(np.diff(ends, prepend=0)), strings_of(np.delete(plain, lead), cuts - some)

    def encode_batch(self, texts: list[str], check: bool = True) -> list[str]:
        """Ids of each text, joined by one space, with the end id."""
        return self.encode_texts(pa.array(texts, pa.string()), check)[0].to_pylist()

    def decode(self, ids: str) -> str:
        """The text of ids joined by one space; the mark put before it goes."""
        text = b"".join(map(self.raw_of.__getitem__, ids.split(" "))).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def agree(self, left: int, right: int) -> bool:
        """Whether these two pieces, put together, are encoded as these two."""
        if left == self.stranger:
            return True
        key = left << 20 | right
        if key not in self.fits:
            if len(self.fits) > 1 << 18:
                self.fits.clear()
            a, b = self.names[left], self.names[right]
            self.fits[key] = self.merge(a + b) == [a, b]
        return self.fits[key]

    def prefix_counts(self, word: str) -> bytes | np.ndarray:
        """Exact token counts of word[:1], word[:2], ..., word[:].

        The encoding of a prefix ends in the one piece that agrees with the
        last piece of the prefix before it, so each count is one more than a
        count to its left. No prefix is encoded again.
        """
        word = word.replace(" ", MARK)
        tails, fits, stranger, last, counts = self.tails.get, self.fits.get, self.stranger, [-1], [0]
        for end in range(1, len(word) + 1):
            start = end - 1
            piece = tails(word[start])
            if piece is None:
                same = not self.bytes and last[start] == stranger  # unknown characters in a row are one token
                last.append(stranger)
                counts.append(counts[start] + (len(word[start].encode()) if self.bytes else int(not same)))
                continue
            while piece is not None:
                if piece >= 0:
                    if not start:
                        break
                    good = fits(last[start] << 20 | piece)
                    if good or (good is None and self.agree(last[start], piece)):
                        break
                start -= 1
                piece = tails(word[start:end]) if start >= 0 else None
            if piece is None:
                # A character that only stands inside pieces: the long way for this word.
                counts = [0] + [len(self.to_ids(self.merge(word[:k]))) for k in range(1, len(word) + 1)]
                break
            last.append(piece)
            counts.append(counts[start] + 1)
        return bytes(counts[1:]) if counts[-1] < 256 and max(counts) < 256 else np.array(counts[1:], np.int32)

    def count_words(self, words: list[str]) -> list[bytes | np.ndarray]:
        """Prefix counts of each word."""
        self.counted.add({w: self.prefix_counts(w) for w in self.counted.missing(set(words))})
        return list(map(self.counted.young.__getitem__, words))

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each whole text: the counts at its words' ends."""
        ends, words, distinct = self.words(texts)
        last = np.fromiter((c[-1] for c in self.count_words(distinct)), np.int64, len(distinct))
        return np.diff(np.concatenate([[0], np.cumsum(last[words])])[ends], prepend=0)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The vocabulary at the path, once a worker."""
    return Pieces(path)


def slices(texts: pa.Array, most: int = 2 << 20):
    """(start, stop) over an Arrow array of texts; each slice holds about `most` bytes at most, or one text."""
    start, held = 0, 0
    for stop, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + size > most:
            yield start, stop
            start, held = stop, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
