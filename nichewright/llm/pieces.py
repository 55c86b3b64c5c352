"""SentencePiece encoding with seeded merge-dropout, and decoding.

The pieces and scores of a given SentencePiece BPE model are used; nothing is trained.  A text, its spaces written as the space mark
and one mark put before it, is cut in front of every run of marks that follows another character: no piece has a mark after another
character, so no merge crosses a cut.  Each part is merged by an agenda: the adjacent pair whose joined piece has the best score
goes first, the leftmost of equals; a candidate taken from the agenda is skipped for good with the chance ``dropout``.  The draws
come from the seed, the document's variant (a 32-bit hash of its id, and of its copy if given), the part's place in the text and
the number of skips so far, so every occurrence is segmented on its own and results don't depend on partitions or order.  Characters without a piece become byte pieces, and so does a space mark
that stands in the text itself: decoding gives back the text exactly.  Without dropout the ids equal the library's.

Scale: one pass over the texts without a shuffle.  Parts recur, so what a part becomes without skips is kept in a bounded table in
each Python worker; the occurrences that skip, about half of them, are merged one step at a time, all of a group of texts at once.

Cases: a null text counts as empty and has no ids; a null id has variant 0; rows that share an id share the variant; an empty table
gives an empty result; other columns are kept by ``encode_documents`` and ignored by ``round_trip``.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichewright.llm.shared import text_batches

MARK = "▁"
#: What a space mark of the text itself is written as until it becomes bytes: a code point that no text can hold.
OWN_MARK = "\ud800"
_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LINE_PARTS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n[^{MARK}\n]*")


NEVER = 1 << 40
#: Parts of more characters are merged anew wherever they occur.
SHORT = 48
#: Texts are encoded together up to so many characters.
TOGETHER = 200_000
_ALL, _ODD, _MORE = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _mixed(x):
    """A finaliser that spreads every bit over the word, of a Python integer below 2**64 or of an array."""
    if isinstance(x, int):
        x = (x ^ x >> 31) * 0x7FB5D329728EA185 & _ALL
        x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D & _ALL
        return x ^ x >> 33
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class PieceCoder:
    """Encodes and decodes with one model; what a part becomes without skips is merged once while it is kept."""

    def __init__(self, model_file: str, dropout: float = 0.1, seed: int = 23, most_parts: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        names = model.id_to_piece(list(range(size)))
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.ids = {names[i]: i for i in range(size) if i not in special and not model.is_byte(i)}
        crossing = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if crossing or len(self.bytes) != 256:
            raise ValueError("the model must have byte pieces and no piece with a space mark after another character")
        #: Joined piece -> its place in the agenda, by score; equal scores share it and go from the left.
        longer = {p: model.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        place = {score: n for n, score in enumerate(sorted(set(longer.values()), reverse=True))}
        self.rank = {p: place[score] for p, score in longer.items()}
        #: A line feed without a piece stands alone, so a part ends in front of it, and parts recur more often.
        self.cut = _PARTS if any("\n" in p for p in self.ids) else _LINE_PARTS
        back = {i: b"" for i in special} | {i: bytes([b]) for b, i in self.bytes.items()} | {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.back = [back[i] for i in range(size)]
        self.seed, self.most_parts = seed, most_parts
        # A candidate is skipped with the same chance whatever came before, so the number taken up to the next skip is
        # geometric: at least n + 1 where a draw of 53 bits is below chances[-1 - n].
        chances = [1 << 53] * 4096 if dropout <= 0 else []
        while not chances or 0 < dropout < 1 and chances[-1] > 0 and len(chances) < 1 << 20:
            chances.append(int((1 - dropout) ** (len(chances) + 1) * (1 << 53)) if dropout < 1 else 0)
        self.dropping, self.chances = dropout > 0, chances[::-1]
        self.table = np.array(self.chances, np.uint64)
        self.n_pieces = size
        self._index_pairs()
        self.back_bytes = np.frombuffer(b"".join(self.back), np.uint8)
        self.back_size = np.array([len(x) for x in self.back], np.int64)
        self.back_start = np.cumsum(self.back_size) - self.back_size
        self._forget()

    def _index_pairs(self) -> None:
        """A hash table of all pairs of symbols that merge.  A symbol is a piece's id, or stands for a character without a piece."""
        chars = {c: n for n, c in enumerate(sorted({c for p in self.rank for c in p} - self.ids.keys()), self.n_pieces)}
        symbol = {**chars, **self.ids}
        self.other = self.n_pieces + len(chars)
        self.of_char = np.arange(self.other, self.other + 0x110000)
        for c, n in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = n
        self.char_of = {n: c for c, n in chars.items()}
        pairs = [(symbol[p[:k]] << 21 | symbol[p[k:]], rank, symbol[p]) for p, rank in self.rank.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        bits = max(10, (8 * len(pairs)).bit_length())
        self.pair_shift, self.pair_mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pair_key, self.pair_rank, self.pair_joined = np.full(1 << bits, -1), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        for key, rank, joined in pairs:
            at = (key * _ODD & _ALL) >> 64 - bits
            while self.pair_key[at] >= 0:
                at = at + 1 & self.pair_mask
            self.pair_key[at], self.pair_rank[at], self.pair_joined[at] = key, rank, joined

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER: they don't merge) and joined symbol of pairs of symbols."""
        key = left << 21 | right
        with np.errstate(over="ignore"):
            at = (key.view(np.uint64) * np.uint64(_ODD) >> self.pair_shift).astype(np.int64)
        found = self.pair_key[at]
        wrong = np.flatnonzero((found != key) & (found >= 0))
        while len(wrong):
            at[wrong] = at[wrong] + 1 & self.pair_mask
            found[wrong] = again = self.pair_key[at[wrong]]
            wrong = wrong[(again != key[wrong]) & (again >= 0)]
        return np.where(found == key, self.pair_rank[at], np.int64(NEVER)), self.pair_joined[at]

    def _merge_all(self, symbols: np.ndarray, sizes: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges many short parts at once: their pieces' symbols, how many each has, and the candidates each took.

        ``at`` is the place of each part's first skip.  A step takes the best candidate of every part, skips it or merges it,
        and looks up the new pairs; the neighbours of a symbol are linked, so that nothing is moved.
        """
        first = np.cumsum(sizes) - sizes
        last, total = first + sizes - 1, len(symbols)
        symbols, at, taken, depth = symbols.copy(), at.copy(), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.uint64)
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        rank, joined = self._pairs(symbols, np.append(symbols[1:], 0))
        rank[last] = NEVER
        value = rank << 6 | np.arange(total) - np.repeat(first, sizes)
        rows, begin, width = np.arange(len(sizes)), first, sizes
        while len(rows):
            least = np.minimum.reduceat(value, begin)
            live = least < NEVER
            if live.sum() < 0.75 * len(rows):
                value, rows, least, width = value[np.repeat(live, width)], rows[live], least[live], width[live]
                begin, live = np.cumsum(width) - width, np.ones(len(rows), bool)
                if not len(rows):
                    break
            slot = np.flatnonzero(live)
            row, place = rows[slot], least[slot] & 63
            skip = taken[row] == at[row]
            taken[row] += 1
            if skip.any():
                own = row[skip]
                value[begin[slot[skip]] + place[skip]] = NEVER
                depth[own] += np.uint64(1)
                at[own] += 1 + self._gaps(keys[own], depth[own])
                slot, row, place = slot[~skip], row[~skip], place[~skip]
            i, shift = first[row] + place, begin[slot] - first[row]
            j = after[i]
            new, following = joined[i].astype(np.int64), after[j]
            symbols[i], symbols[j], after[i] = new, -1, following
            value[j + shift] = value[i + shift] = NEVER
            right = np.flatnonzero(following <= last[row])
            if len(right):
                k, q = i[right], following[right]
                before[q] = k
                found, joined[k] = self._pairs(new[right], symbols[q])
                value[k + shift[right]] = np.where(found < NEVER, found << 6 | place[right], NEVER)
            left = np.flatnonzero(place > 0)
            if len(left):
                h = before[i[left]]
                found, joined[h] = self._pairs(symbols[h], new[left])
                value[h + shift[left]] = np.where(found < NEVER, found << 6 | h - first[row[left]], NEVER)
        stays = symbols >= 0
        return symbols[stays], np.add.reduceat(stays.astype(np.int64), first) if total else sizes, taken

    def _spelled(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers: characters without a piece become bytes."""
        odd = np.flatnonzero(symbols >= self.n_pieces)
        if not len(odd):
            return symbols, sizes
        spelled = []
        for s in symbols[odd].tolist():
            c = self.char_of[s] if s < self.other else chr(s - self.other)
            spelled.append([self.bytes[b] for b in (MARK if c == OWN_MARK else c).encode()])
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(x) for x in spelled]
        ids = np.repeat(symbols, width)
        ids[np.repeat(symbols >= self.n_pieces, width)] = list(itertools.chain.from_iterable(spelled))
        return ids, np.add.reduceat(width, np.cumsum(sizes) - sizes)

    def _forget(self) -> None:
        """Nothing is kept any more but node 0, which stands for parts that are merged anew."""
        self.node_of: dict[str, int] = {}
        #: For each node the number of its candidates, where its ids begin, and how many it has.
        self.n, self.start, self.size = (_Grown(np.int64, 1) for _ in range(3))
        self.pool = _Grown(np.int32)

    def _base(self, variant: int) -> int:
        return _mixed(_mixed(self.seed & _ALL) + (variant & _ALL) * _ODD & _ALL)

    def _gap(self, key: int, depth: int) -> int:
        """How many candidates an occurrence takes between its skips number depth - 1 and depth."""
        draw = _mixed(key + depth * _MORE & _ALL) >> 11
        return len(self.chances) - bisect_right(self.chances, draw)

    def _gaps(self, keys: np.ndarray, depth: np.ndarray | np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            draws = _mixed(keys + depth * np.uint64(_MORE)) >> np.uint64(11)
        return len(self.table) - np.searchsorted(self.table, draws, side="right")

    def _skips(self, key: int) -> Iterator[int]:
        """The places, among the candidates as they come from the agenda, that an occurrence skips."""
        at = -1
        for depth in itertools.count():
            at += 1 + self._gap(key, depth)
            yield at

    def _merge(self, part: str, variant: int) -> list[str]:
        """The pieces of the first part of a text."""
        key = _mixed(self._base(variant) ^ int.from_bytes(part.encode("utf-8", "surrogatepass")[-8:], "little"))
        return self._merge_short(part, key) if len(part) <= SHORT else self._merge_long(part, key)

    def _merge_short(self, part: str, key: int) -> list[str]:
        return self._short(part, self._skips(key) if self.dropping else iter(()))[0]

    def _merge_long(self, part: str, key: int) -> list[str]:
        return self._long(part, self._skips(key) if self.dropping else iter(()))

    def _short(self, part: str, skips: Iterator[int]) -> tuple[list[str], int]:
        """The pieces and the number of candidates; the agenda is a list with a place for each adjacent pair."""
        text, get = list(part), self.rank.get
        skip, n = next(skips, NEVER), 0
        agenda = [get(a + b, NEVER) for a, b in zip(text, text[1:], strict=False)]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            n += 1
            if n > skip:
                agenda[i], skip = NEVER, next(skips, NEVER)
                continue
            text[i] += text.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(text[i] + text[i + 1], NEVER)
            if i:
                agenda[i - 1] = get(text[i - 1] + text[i], NEVER)
        return text, n

    def _long(self, part: str, skips: Iterator[int]) -> list[str]:
        """The agenda as a heap, for parts whose pairs are too many to look through for every merge."""
        text, n, get = list(part), len(part), self.rank.get
        skip, taken = next(skips, NEVER), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, 2) for i in range(n - 1) if (r := get(text[i] + text[i + 1], NEVER)) < NEVER]
        heapq.heapify(agenda)
        while agenda:
            best, i, size = heapq.heappop(agenda)
            if not text[i] or (j := after[i]) >= n or len(text[i]) + len(text[j]) != size or get(text[i] + text[j]) != best:
                continue  # one of the two has been merged since
            taken += 1
            if taken > skip:
                skip = next(skips, NEVER)
                continue
            text[i] += text[j]
            text[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(text[i] + text[k], NEVER)) < NEVER:
                    heapq.heappush(agenda, (r, i, len(text[i]) + len(text[k])))
            h = before[i]
            if h >= 0 and (r := get(text[h] + text[i], NEVER)) < NEVER:
                heapq.heappush(agenda, (r, h, len(text[h]) + len(text[i])))
        return [t for t in text if t]

    def _ids(self, pieces: list[str]) -> list[int]:
        get = self.ids.get
        ids = [get(p) for p in pieces]
        if None in ids:
            ids = []
            for piece in pieces:
                found = get(piece)
                ids += [found] if found is not None else [self.bytes[b] for c in piece for b in (MARK if c == OWN_MARK else c).encode()]
        return ids

    def _add(self, n: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New nodes with ``n`` candidates each and ``sizes`` of the ``ids``; returns their numbers."""
        at = self.n.used
        self.start.add(self.pool.used + np.cumsum(sizes) - sizes)
        self.pool.add(ids)
        self.n.add(n)
        self.size.add(sizes)
        return np.arange(at, self.n.used)

    def _learn(self, parts: list[str]) -> None:
        """Nodes of short parts without skips."""
        symbols, sizes = self._symbols(parts)
        found, counts, taken = self._merge_all(symbols, sizes, np.full(len(parts), NEVER), np.zeros(len(parts), np.uint64))
        ids, counts = self._spelled(found, counts)
        self.node_of.update(zip(parts, self._add(taken, counts, ids).tolist(), strict=True))

    def _symbols(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.of_char[codes], np.fromiter(map(len, parts), np.int64, len(parts))

    def _parts(self, text: str) -> list[str]:
        if not text:
            return []
        # Most texts have single spaces only: then their parts are found faster.
        if self.cut is _LINE_PARTS and MARK not in text and "  " not in text and text[0] != " ":
            return [p if p[:1] == "\n" else MARK + p for p in text.replace("\n", " \n").split(" ")]
        return self.cut.findall(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK))

    def encode_many(self, texts: list[str], variants: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one after the other, as signed 32-bit integers, and how many each text has.

        A node is what a part becomes without skips.  Each occurrence draws from the variant and its place: without a skip among
        its part's candidates it takes the part's node, else it is merged on its own, together with all others that skip.
        """
        if self.n.used > self.most_parts:
            self._forget()
        split = [self._parts(t) for t in texts]
        counts = np.array([len(x) for x in split], np.int64)
        parts = list(itertools.chain.from_iterable(split))
        if new := [p for p in set(parts).difference(self.node_of) if len(p) <= SHORT]:
            self._learn(new)
        kept_nodes, kept_pool = self.n.used, self.pool.used
        node = np.fromiter(map(self.node_of.get, parts, itertools.repeat(0)), np.int64, len(parts))
        keys = np.zeros(len(parts), np.uint64)
        if self.dropping:
            place = np.arange(len(parts)) - np.repeat(np.cumsum(counts) - counts, counts)
            with np.errstate(over="ignore"):
                base = np.array([self._base(v) for v in variants], np.uint64)
                keys = _mixed(np.repeat(base, counts) + place.astype(np.uint64) * np.uint64(_ODD))
            at = self._gaps(keys, np.uint64(0))
            skipping = np.flatnonzero(at < self.n.data[node])
            if len(skipping):
                found, sizes, taken = self._merge_all(*self._symbols(list(map(parts.__getitem__, skipping.tolist()))), at[skipping], keys[skipping])
                found, sizes = self._spelled(found, sizes)
                node[skipping] = self._add(taken, sizes, found)
        if len(alone := np.flatnonzero(node == 0)):
            merged = [self._ids(self._merge_long(parts[i], key)) for i, key in zip(alone.tolist(), keys[alone].tolist(), strict=True)]
            sizes = np.array([len(x) for x in merged], np.int64)
            node[alone] = self._add(sizes, sizes, np.array(list(itertools.chain.from_iterable(merged)), np.int32))
        ids = _gathered(self.pool.data, self.start.data[node], self.size.data[node])
        ends = np.cumsum(np.append(0, self.size.data[node]))[np.cumsum(np.append(0, counts))]
        self.n.used = self.start.used = self.size.used = kept_nodes
        self.pool.used = kept_pool
        return ids, np.diff(ends)

    def encode(self, text: str, variant: int = 0) -> np.ndarray:
        """The ids of a whole text as signed 32-bit integers."""
        return self.encode_many([text], [variant])[0]

    def decode(self, ids) -> str:
        """The text of a whole text's ids."""
        return b"".join(map(self.back.__getitem__, ids))[1:].decode()

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of the ids of several whole texts, of which each has as many as ``counts`` says."""
        sizes = self.back_size[ids]
        whole = _gathered(self.back_bytes, self.back_start[ids], sizes).tobytes()
        ends = np.cumsum(np.append(0, sizes))[np.cumsum(np.append(0, counts))].tolist()
        return [whole[a + 1 : b].decode() if b > a else "" for a, b in itertools.pairwise(ends)]


class _Grown:
    """An array that grows; ``data`` may be longer than what is ``used``."""

    def __init__(self, kind, zeros: int = 0):
        self.data, self.used = np.zeros(1024, kind), zeros

    def add(self, values: np.ndarray) -> None:
        end = self.used + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(end, 2 * len(self.data)) - self.used, self.data.dtype)])
        self.data[self.used : end] = values
        self.used = end


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of ``data`` one after the other."""
    before = np.cumsum(size) - size
    return data[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def together(texts: list[str], variants: list[int]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts and variants in groups of TOGETHER characters, or one longer text."""
    group, chars = 0, 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > TOGETHER:
            yield texts[group:i], variants[group:i]
            group, chars = i, 0
        chars += len(text)
    yield texts[group:], variants[group:]


@functools.cache
def coder_of(model_file: str, dropout: float, seed: int, most_parts: int) -> PieceCoder:
    """One coder for each Python worker, so that what it keeps serves its later tasks too."""
    return PieceCoder(model_file, dropout, seed, most_parts)


def variant_of(doc_id: Column, seed: int, copy: Column | None = None) -> Column:
    """The number, of 32 bits, from which a document (or its copy) draws."""
    return F.when(doc_id.isNull() if copy is None else F.lit(False), F.lit(0)).otherwise(F.xxhash64(doc_id, *([] if copy is None else [copy]), F.lit(seed)).bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast("int")


def encode_documents(documents: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 23, most_parts: int = 400_000, copy: Column | None = None) -> DataFrame:
    """The documents with a column ``piece_ids``; a column of that name is replaced.

    ``copy`` tells rows of one document apart, so that its copies are segmented anew.  ``most_parts`` bounds what a worker keeps, some 200 bytes each; fewer cost time, not results.
    """

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        coder = coder_of(model_file, dropout, seed, most_parts)
        for texts, chosen in batches:
            done = [coder.encode_many(t, v) for t, v in together(texts.to_pylist(), chosen.to_pylist())]
            offsets = np.cumsum(np.concatenate([[0], *(n for _, n in done)])).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x, _ in done)])))

    return text_batches(documents).withColumn("piece_ids", encoded(F.coalesce(documents["text"], F.lit("")), variant_of(documents["doc_id"], seed, copy)))


def round_trip(documents: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 23, most_parts: int = 1_200_000) -> DataFrame:
    """(doc_id, variant, n_pieces, ids_crc32, decoded_sha256, lossless) for every document: its ids and what they decode to."""
    rows = text_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), variant_of(F.col("doc_id"), seed).alias("variant"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(model_file, dropout, seed, most_parts)
        for batch in batches:
            texts, ids, back = batch.column("text").to_pylist(), [], []
            for some, chosen in together(texts, batch.column("variant").to_pylist()):
                flat, counts = coder.encode_many(some, chosen)
                back += coder.decode_many(flat, counts)
                ids += np.split(flat, np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "variant": batch.column("variant"),
                    "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
                    "lossless": [a == b for a, b in zip(texts, back, strict=True)],
                }
            )

    return rows.mapInArrow(run, "doc_id long, variant int, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
