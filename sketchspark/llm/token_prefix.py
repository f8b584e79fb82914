"""Exact token counts at every prefix, by dynamic programming over byte-pair merges.

For a pretoken, the encoding of its first i bytes ends in the one vocabulary token t that
is a suffix of them and forms a *compatible pair* with the last token of the encoding of
the i - len(t) bytes before (the two tokens' own merge trees let no merge cross).  So
``last[i]`` and ``count[i] = count[i - len(t)] + 1`` follow from shorter prefixes, without
running the merges.  The recurrence runs over many pretokens at once in numpy.

A text is cut before single spaces between non-blank characters, where no pretoken can
cross; distinct pieces are computed once and kept in a bounded cache.  Within a piece the
library's own pretokenizer gives the pretokens.  The prefix that ends inside a run of
blanks or inside a contraction pretokenizes otherwise than the whole text does, and is
counted as the library counts that prefix.  A special token's string counts 1.

A document's table holds count(i) - count(i - 1) for each byte i, compressed;
`tokens_at` and `longest_prefix` answer from it without encoding again.  At a cut inside a
UTF-8 character the count is that of the pretoken's bytes up to there.

Defined results: null or empty text has 0 bytes and 0 tokens.  Every row stands for itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROLLING, U64, byte_chunks, byte_view, mix64

CACHE_PIECES = 1 << 20
LONG_PRETOKEN = 4096
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")  # fixed values of the pretokenizer


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: visible Latin-1 bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class PrefixCounter:
    """The recurrence for one vocabulary; tokens are numbered by merge rank, single bytes first."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        number = {c: letters[c] for c in letters}
        self.left, self.right = list(range(256)), list(range(256))
        pairs = {}
        for a, b in merges:
            if a + b not in number:
                number[a + b] = len(self.left)
                self.left.append(number[a])
                self.right.append(number[b])
            pairs[number[a] << 20 | number[b]] = number[a + b]
        self.left, self.right = np.array(self.left), np.array(self.right)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        steps: dict[int, int] = {}
        token = [-1]
        for text, t in number.items():
            node = 0
            for c in text:
                key = node << 8 | letters[c]
                node = steps.setdefault(key, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = t
        self.step_keys = np.array(sorted(steps), np.int64)
        self.step_to = np.array([steps[k] for k in self.step_keys.tolist()], np.int64)
        self.token = np.array(token, np.int64)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._compatible: dict[int, bool] = {}
        self._joined, self._left, self._right = pairs, self.left.tolist(), self.right.tolist()
        self.keys = np.zeros(0, U64)  # known pieces, sorted; slot and hits go with them
        self.slot = self.hits = np.zeros(0, np.int64)
        self.pool, self.starts = np.zeros(0, np.int16), np.zeros(1, np.int64)

    @staticmethod
    def _find(keys: np.ndarray, to: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, to[at], -1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the byte-pair encoding of a's and b's joined bytes is just (a, b)."""
        both, back = np.unique(a << 20 | b, return_inverse=True)
        a, b = both >> 20, both & 0xFFFFF
        out = np.ones(len(both), bool)
        open_ = np.arange(len(both))
        limit = np.full(len(both), np.iinfo(np.int64).max)
        while len(open_):
            joined = self._find(self.pair_keys, self.pair_to, a << 20 | b)
            crossed = (joined >= 0) & (joined < limit)
            out[open_[crossed]] = False
            # undo the later of the two merges next to the border; the other one if that is a single byte
            turn_a = (a > b) & (a >= 256) | (b < 256)
            stop = crossed | ((a < 256) & (b < 256))
            limit = np.where(turn_a, a, b + 1)
            a, b = np.where(turn_a, self.right[a], a), np.where(turn_a, b, self.left[b])
            go = ~stop
            open_, a, b, limit = open_[go], a[go], b[go], limit[go]
        return out[back]

    def _fits(self, a: int, b: int) -> bool:
        """`compatible` of one pair."""
        limit = len(self.left) << 1
        while True:
            if self._joined.get(a << 20 | b, limit) < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b and a >= 256 or b < 256:
                limit, a = a, self._right[a]
            else:
                limit, b = b + 1, self._left[b]

    def counts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, offsets): for each pretoken data[start : start + size] the token counts of its prefixes of 1, 2, ... bytes."""
        offsets = np.r_[0, np.cumsum(size)]
        out = np.zeros(offsets[-1], np.int32)
        order = np.argsort(size, kind="stable")
        sizes, at = size[order], 0
        while at < len(order):  # blocks of about equal sizes and bounded area
            width = int(sizes[at])
            if width > LONG_PRETOKEN:
                out[offsets[order[at]] : offsets[order[at] + 1]] = self._long(data[start[order[at]] : start[order[at]] + width])
                at += 1
                continue
            end = int(np.searchsorted(sizes, min(LONG_PRETOKEN, width + width // 4 + 1), "right"))
            end = min(end, at + max(1, (1 << 18) // max(1, int(sizes[end - 1]))))
            rows = order[at:end]
            table = self._block(data, start[rows], size[rows])
            place = offsets[rows][:, None] + np.arange(table.shape[1])
            real = np.arange(table.shape[1]) < size[rows][:, None]
            out[place[real]] = table[real]
            at = end
        return out, offsets

    def _long(self, data: np.ndarray) -> np.ndarray:
        """One long pretoken: tokens are found at all places together, then the recurrence runs along it."""
        n, compatible = len(data), self._compatible
        count, last = np.zeros(n + 1, np.int32), [0] * (n + 1)
        for low in range(0, n, 1 << 18):  # tokens that begin in a stretch; those that end behind it are held over
            start = np.arange(low, min(n, low + (1 << 18)))
            node, depth, found = np.zeros(len(start), np.int64), 0, []
            while len(start):
                node = self._find(self.step_keys, self.step_to, node << 8 | data[start + depth].astype(np.int64))
                depth += 1
                token = self.token[np.maximum(node, 0)]
                hit = (node >= 0) & (token >= 0)
                found.append((start[hit] + depth, start[hit], token[hit]))
                alive = (node >= 0) & (start + depth < n)
                start, node = start[alive], node[alive]
            more = [np.concatenate(c) for c in zip(*found, strict=True)]
            ends, starts, tokens = more if not low else [np.r_[a, b] for a, b in zip(over, more, strict=True)]
            late = ends > low + (1 << 18)
            over = [c[late] for c in (ends, starts, tokens)]
            ends, starts, tokens = (c[~late] for c in (ends, starts, tokens))
            order = np.argsort(ends, kind="stable")
            for i, j, t in zip(ends[order].tolist(), starts[order].tolist(), tokens[order].tolist(), strict=True):
                if j:
                    pair = last[j] << 20 | t
                    fits = compatible.get(pair)
                    if fits is None:
                        if len(compatible) > CACHE_PIECES:
                            compatible.clear()
                        fits = compatible[pair] = self._fits(last[j], t)
                    if not fits:
                        continue
                last[i] = t
                count[i] = count[j] + 1
        return count[1:]

    def _block(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        width = int(size.max())
        column = np.arange(width)
        text = np.where(column < size[:, None], data[np.minimum(begin[:, None] + column, len(data) - 1)], 0).astype(np.int64)
        ending: list[list[tuple[np.ndarray, int, np.ndarray]]] = [[] for _ in range(width + 1)]
        for j in range(width):
            rows = np.flatnonzero(size > j)
            node = np.zeros(len(rows), np.int64)
            for i in range(j + 1, width + 1):
                node = self._find(self.step_keys, self.step_to, node << 8 | text[rows, i - 1])
                alive = (node >= 0) & (size[rows] >= i)
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                token = self.token[node]
                is_token = token >= 0
                ending[i].append((rows[is_token], j, token[is_token]))
        last = np.zeros((len(size), width + 1), np.int64)
        count = np.zeros((len(size), width + 1), np.int32)
        for i in range(1, width + 1):
            if not ending[i]:
                continue
            rows = np.concatenate([r for r, _, _ in ending[i]])
            start = np.concatenate([np.full(len(r), j) for r, j, _ in ending[i]])
            token = np.concatenate([t for _, _, t in ending[i]])
            fits = start == 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self.compatible(last[rows[inner], start[inner]], token[inner])
            rows, start, token = rows[fits], start[fits], token[fits]
            last[rows, i] = token
            count[rows, i] = count[rows, start] + 1
        return count[:, 1:]

    # --- pieces -------------------------------------------------------------------------------

    def _plan(self, piece: bytes) -> list[bytes | tuple]:
        """Pretokens of a piece without special strings, with marks where a prefix ends in blanks or in a contraction."""
        text = piece.decode()
        if not text:
            return []
        parts = [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        plan: list[bytes | tuple] = []
        for part, after in zip(parts, [*parts[1:], ""], strict=True):
            if part.isspace() and after[:1].isspace():
                plan.append(("blank", part.encode(), (part + after[0]).encode()))
            elif part in CONTRACTIONS:
                plan.append(("short", part.encode()))
            else:
                plan.append(part.encode())
        return plan

    def _special_parts(self, text: str) -> list[tuple[str, str]]:
        """(ordinary text, special string after it): leftmost and longest first, as the library splits; the last has none."""
        out, at = [], 0
        while True:
            found = min(((text.find(x, at), -len(x)) for x in self.specials if text.find(x, at) >= 0), default=None)
            if found is None:
                return [*out, (text[at:], "")]
            out.append((text[at : found[0]], text[found[0] : found[0] - found[1]]))
            at = found[0] - found[1]

    def _with_specials(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Prefix counts of pieces with special strings: ordinary up to a string's last byte, where it becomes one token."""
        parts = [self._special_parts(p.decode()) for p in pieces]
        known = self._mixed([(a + x[:-1]).encode() for part in parts for a, x in part], plain=True)
        out = []
        for part in parts:
            base, done = 0, []
            for a, x in part:
                c = known.pop(0) + base
                done.append(c)
                if x:
                    size = len(a.encode())
                    base = (int(c[size - 1]) if size else base) + 1
                    done.append(np.array([base], np.int32))
            out.append(np.concatenate(done))
        return out

    def _mixed(self, pieces: list[bytes], plain: bool = False) -> list[np.ndarray]:
        """Prefix counts of pieces of several pretokens; plain: none holds a special string."""
        special = [] if plain else [i for i, p in enumerate(pieces) if any(x.encode() in p for x in self.specials)]
        if special:
            held = dict(zip(special, self._with_specials([pieces[i] for i in special]), strict=True))
            rest = iter(self._mixed([p for i, p in enumerate(pieces) if i not in held], plain=True))
            return [held[i] if i in held else next(rest) for i in range(len(pieces))]
        plans = [self._plan(p) for p in pieces]
        words = list(dict.fromkeys(x for plan in plans for part in plan for x in ([part] if isinstance(part, bytes) else part[1:]) if isinstance(x, bytes)))
        size = np.array([len(w) for w in words], np.int64)
        flat, offsets = self.counts(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        known = {w: flat[a:b] for w, a, b in zip(words, offsets[:-1], offsets[1:], strict=True)}
        out = []
        for plan in plans:
            base, parts, first = 0, [], None
            for part in plan:
                if isinstance(part, bytes):
                    c = known[part] + base
                elif part[0] == "short":
                    c = known[part[1]] + base
                    c[:-1] = base + np.arange(1, len(c))
                else:
                    c = known[part[1]] + base
                end = int(c[-1])
                if first is not None:  # the blank that this pretoken begins with ends a longer run there
                    c[: len(first)] = first
                first = base + known[part[2]][len(part[1]) :] if isinstance(part, tuple) and part[0] == "blank" else None
                base = end
                parts.append(c)
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        return out

    def _learn(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, plain: np.ndarray) -> None:
        if len(self.keys) + len(keys) > CACHE_PIECES:  # keep what came again
            often = np.flatnonzero(self.hits > 1)
            often = often if len(often) < CACHE_PIECES // 2 else often[:0]
            sizes = np.diff(self.starts)[self.slot[often]]
            self.pool = self.pool[np.repeat(self.starts[self.slot[often]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            self.starts = np.r_[0, np.cumsum(sizes)]
            self.keys, self.slot, self.hits = self.keys[often], np.arange(len(often)), np.zeros(len(often), np.int64)
        flat, offsets = self.counts(data, begin[plain], size[plain])
        view = memoryview(data)
        rest = np.flatnonzero(~plain)
        more = self._mixed([bytes(view[begin[i] : begin[i] + size[i]]) for i in rest])
        flat = np.concatenate([flat, *more])
        sizes = np.r_[size[plain], size[rest]]
        edge = np.cumsum(sizes) - sizes
        delta = np.diff(flat, prepend=0)
        delta[edge] = flat[edge]
        slot = len(self.starts) - 1 + np.arange(len(sizes))
        self.pool = np.r_[self.pool, delta.astype(np.int16)]
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(sizes)]
        named = np.r_[self.keys, keys[plain], keys[rest]]
        order = np.argsort(named)
        self.keys, self.slot, self.hits = named[order], np.r_[self.slot, slot][order], np.r_[self.hits, np.zeros(len(slot), np.int64)][order]

    def deltas(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """count(i) - count(i - 1) of every byte of texts that lie one after another in data."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int16)
        special = any(s.encode() in memoryview(data).tobytes() for s in self.specials)
        cut, letter, mark = _safe_cuts(data, special)
        cut[offsets[:-1][offsets[:-1] < n]] = True
        begin = np.flatnonzero(cut)
        size = np.diff(np.r_[begin, n])
        keys = mix64(ROLLING.slices(ROLLING.sums(data), begin, begin + size) + size.astype(U64))
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool))
        if len(new):
            lead = (data[begin] == 0x20).astype(np.int64)
            one = (np.add.reduceat(letter, begin, dtype=np.int64) + lead == size) | (np.add.reduceat(mark, begin, dtype=np.int64) + lead == size) | (size == 1)
            pick = first[new]
            self._learn(distinct[new], data, begin[pick], size[pick], one[pick] if not special else np.zeros(len(pick), bool))
            at = np.searchsorted(self.keys, distinct)
        self.hits[at] += 1
        slot = self.slot[at][back]
        return self.pool[np.repeat(self.starts[slot] - begin, size) + np.arange(n)]


def _safe_cuts(data: np.ndarray, special: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, letters, marks): places before which every prefix's pretokens end, bytes of letters, ASCII marks.

    Cuts come before a single space between characters that are surely not blank; and, where no special
    token's string is about, before and after such a line end, and between a letter and an ASCII mark."""
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D)) | ((data >= 0x1C) & (data <= 0x1F))
    opens = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))  # lead bytes of the blanks outside ASCII
    low = data | 0x20
    letter = (low >= 0x61) & (low <= 0x7A)
    mark = (data > 0x20) & (data < 0x7F) & ~letter & ~((data >= 0x30) & (data <= 0x39))
    latin = data[:-1] == 0xC3
    latin &= (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter[:-1] |= latin
    letter[1:] |= latin
    cut = np.zeros(len(data), bool)
    if len(data) > 4:
        lone = ~blank[:-2] & ~blank[2:] & ~opens[2:]
        lone[1:] &= ~opens[:-3]  # a two-byte blank just before
        lone[2:] &= ~opens[:-4]  # a three-byte blank
        cut[1:-1] = lone & (data[1:-1] == 0x20)
        if not special:
            line = lone & (data[1:-1] == 0x0A)
            cut[1:-1] |= line
            cut[2:] |= line
            cut[1:] |= letter[:-1] & mark[1:] & (data[1:] != 0x27)
    return cut, letter, mark


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        count = counter(path)
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            for i, j in byte_chunks(offsets, 2 << 20):
                own = offsets[i : j + 1] - offsets[i]
                deltas = count.deltas(data[offsets[i] : offsets[j]], own)
                total = np.r_[0, np.cumsum(deltas, dtype=np.int64)]
                tables = [squeeze(deltas[a:b].tobytes()) for a, b in zip(own[:-1], own[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(own)), pa.array(total[own[1:]] - total[own[:-1]]), pa.array(tables, pa.binary())], ["id", "n_bytes", "n_tokens", "prefix"])

    return run


def token_prefixes(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, prefix): prefix is the document's table for `tokens_at` and `longest_prefix`."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(_run(path), "id long, n_bytes long, n_tokens long, prefix binary").withColumnRenamed("id", id_col)


def prefix_counts(table: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... bytes."""
    import zstandard

    return np.r_[0, np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(table), np.int16), dtype=np.int64)]


def tokens_at(table: bytes, n_bytes: int) -> int:
    """Tokens of the first n_bytes bytes."""
    return int(prefix_counts(table)[n_bytes])


def longest_prefix(table: bytes, budget: int) -> int:
    """Most bytes that a prefix of at most budget tokens has."""
    return int(np.flatnonzero(prefix_counts(table) <= budget)[-1])
