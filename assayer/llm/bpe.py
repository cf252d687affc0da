"""BPE encoding and decoding by speculation and verification.

Latin-1 texts are lower-cased, cut into the vocabulary's words and hashed word by word over
whole batches in numpy, so each distinct word is encoded once and then remembered by a 64-bit
hash, behind which its bytes are compared.  Other texts are cut at ASCII white space, which no token crosses, and each
distinct chunk goes through the library's own normaliser and pre-tokeniser.  For the
distinct words that are left:

1. *Speculate*: a greedy longest match over the vocabulary proposes tokens.
2. *Verify*: a proposal is the BPE encoding if and only if no merge of the vocabulary would
   act across any of its boundaries.  All adjacent pairs of a batch are tested at once:
   both spines of a pair are unwound together, latest merge first, in numpy.
3. Words with an incompatible pair alone go through exact merging by rank.

Decoding joins the token strings as the tokenizers library does for a vocabulary without a
decoder: with single spaces.

Defined results: null counts as empty text (0 tokens); repeated rows are rows of their own;
extra columns are carried along by :func:`encode_texts`, which replaces those of its results'
names; an empty table gives no rows.  Memory per task is bounded by one Arrow batch, its ids,
caches of ``KNOWN`` and ``CACHE`` entries, and tables of some tens of bytes for each of
``FAST_BYTES`` bytes: texts are encoded whole, whatever their length, but very long ones a piece
between blanks at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from assayer.llm.common import bounded_batches, exact_id, table

#: Words that a worker knows by their 64-bit hash, and bytes of text handled at a time.
KNOWN = 1_000_000
FAST_BYTES = 2 << 20
#: Chunks that a worker remembers for texts beyond Latin-1; emptied once it is full.
CACHE = 100_000
#: Failing words up to LONG symbols are merged MERGE_ROWS at a time; longer ones with a heap.
LONG = 32
MERGE_ROWS = 4096
#: Longer chunks are encoded but not remembered.
CACHE_CHARS = 64
#: Bytes of a word that are compared in lanes; _MASKS keep the first bytes of a lane.
LANES = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
END = "Ā"  # stands for the end-of-word suffix; other characters are bytes
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r\f\v]+")
#: The vocabulary's word pattern for lower-case Latin-1 text: letters, single numbers, the rest.
_LETTER, _NUMBER, _BLANK = "a-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \\t\\n\\r\\f\\v\x85\xa0"
_LATIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _gather(b: np.ndarray, lo: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes b[lo : lo + width] of each word end to end, and their ends; beyond b its last byte."""
    to = np.cumsum(width)
    n = int(to[-1]) if len(to) else 0
    pos = np.arange(n) - np.repeat(to - width, width) + np.repeat(lo, width)
    return b[np.minimum(pos, len(b) - 1)] if n else np.zeros(0, np.uint8), to


def same_bytes(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether the words a[a_at : a_at + a_size] equal the words b[b_at : b_at + b_size], eight bytes at a time."""
    same = a_size == b_size
    x, y = (np.concatenate([v, np.zeros(8, np.uint8)]) for v in (a, b))
    x, y = (np.ndarray(len(v) - 7, "<u8", v.data, 0, (1,)) for v in (x, y))
    live = np.flatnonzero(same & ((a_at != b_at) | (a is not b)))
    for lane in range(0, LANES, 8):
        left = a_size[live] - lane
        live = live[left > 0]
        if not len(live):
            return same
        mask = _MASKS[np.minimum(a_size[live] - lane, 8)]
        fits = (x[a_at[live] + lane] ^ y[b_at[live] + lane]) & mask == 0
        same[live[~fits]] = False
        live = live[fits]
    for k in live[a_size[live] > LANES]:
        same[k] = bool((a[a_at[k] : a_at[k] + a_size[k]] == b[b_at[k] : b_at[k] + b_size[k]]).all())
    return same


def _pieces(raw: bytes) -> list[bytes]:
    """A text in pieces of at most FAST_BYTES that end before a blank, or at the next blank."""
    out, at = [], 0
    while len(raw) - at > FAST_BYTES:
        cut = max(raw.rfind(c, at + 1, at + FAST_BYTES) for c in (b" ", b"\n"))
        if cut < 0:
            cut = min((k for c in (b" ", b"\n") if (k := raw.find(c, at + FAST_BYTES)) >= 0), default=len(raw))
        out.append(raw[at:cut])
        at = cut
    return [*out, raw[at:]]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordBpe:
    """Encoder and decoder of one vocabulary file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.shown = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.to_byte = {c: chr(b) for c, b in byte_chars().items()}
        self.ids = {self._inner(s): i for s, i in model["vocab"].items()}
        self.base = np.array([self.ids[chr(b)] for b in range(256)])
        self.base_end = np.array([self.ids[chr(b) + END] for b in range(256)])
        self.merged_id = np.array([model["vocab"][a + b] for a, b in model["merges"]])
        n = max(self.shown) + 1
        self.rank = np.full(n, -1, np.int64)
        self.left = np.arange(n)
        self.right = np.arange(n)
        keys = np.empty(len(model["merges"]), np.int64)
        self.width = np.int64(n)
        for r, (a, b) in enumerate(model["merges"]):
            i, j, k = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            keys[r] = i * n + j
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = {int(k): (r, model["vocab"][a + b]) for r, (k, (a, b)) in enumerate(zip(keys, model["merges"]))}
        self._keep_reachable()
        self._begin_fast()
        self.chunks: dict[str, bytes] = {}

    def _inner(self, shown: str) -> str:
        end = shown.endswith(self.suffix) and len(shown) > len(self.suffix)
        body = shown[: -len(self.suffix)] if end else shown
        return "".join(self.to_byte[c] for c in body) + (END if end else "")

    def _keep_reachable(self) -> None:
        """Only tokens that merging their own text yields may be proposed."""
        made = np.flatnonzero(self.rank >= 0)
        ok = np.ones(len(self.rank), bool)
        ok[made] = self.compatible(self.left[made], self.right[made], own=True)
        for k in made[np.argsort(self.rank[made])]:
            ok[k] &= ok[self.left[k]] and ok[self.right[k]]
        self.proposals = {s: i for s, i in self.ids.items() if ok[i]}
        self._build_trie()

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or a number above all ranks."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], np.int64(1) << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray, own: bool = False) -> np.ndarray:
        """Whether merging the joint text of each pair leaves the boundary between them.

        A token x on the left edge of the boundary lives until the merge that swallows it,
        and so does y on the right edge.  A merge (x, y) acts if it ranks before both of
        those; at equal rank the left side's own merge comes first, the right side's after.
        Going back in time, the later made of x and y is the one to unwind.  With ``own``
        the outermost merge of the pair itself is allowed.
        """
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        good = np.ones(len(a), bool)
        high = np.int64(1) << 41
        until_a, until_b = np.full(len(a), high), np.full(len(a), high)
        live = np.arange(len(a))
        first = own
        while len(live):
            x, y = a[live], b[live]
            if not first:
                r = self._pair_rank(x, y)
                acts = (r < until_a[live]) & (r <= until_b[live]) & (r < (np.int64(1) << 40))
                good[live[acts]] = False
                live, x, y = live[~acts], x[~acts], y[~acts]
            first = False
            rx, ry = self.rank[x], self.rank[y]
            more = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            undo_a = rx > ry
            at = live[undo_a]
            until_a[at], a[at] = rx[undo_a], self.right[x[undo_a]]
            at = live[~undo_a]
            until_b[at], b[at] = ry[~undo_a], self.left[y[~undo_a]]
        return good

    def _build_trie(self) -> None:
        """Sorted (node, byte) -> node edges of the proposals, and each node's token."""
        nodes, edges, tokens = 1, {}, [-1]
        for s, i in self.proposals.items():
            at = 0
            for c in s.encode("utf-16-le")[::2] if not s.endswith(END) else [*s[:-1].encode("latin-1"), 256]:
                key = at * 257 + c
                to = edges.get(key)
                if to is None:
                    to = edges[key] = nodes
                    nodes += 1
                    tokens.append(-1)
                at = to
            tokens[at] = i
        self.edges = np.sort(np.fromiter(edges, np.int64, len(edges)))
        self.edge_to = np.fromiter((edges[k] for k in self.edges.tolist()), np.int64, len(edges))
        self.node_token = np.array(tokens)

    def propose(self, syms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match over all words at once.

        syms holds the words' bytes, 256 behind each word.  Returns the proposed ids, the
        word of each id, both in text order, and which words got stuck before their end.
        """
        n = len(starts)
        stuck = np.zeros(n, bool)
        ids, owners = [], []
        live, at = np.arange(n), starts.copy()
        while len(live):
            node = np.zeros(len(live), np.int64)
            pos = at[live].copy()
            best, best_at = np.full(len(live), -1), pos.copy()
            go = np.arange(len(live))
            while len(go):
                key = node[go] * 257 + syms[pos[go]]
                where = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                hit = self.edges[where] == key
                go, where = go[hit], where[hit]
                node[go] = self.edge_to[where]
                pos[go] += 1
                token = self.node_token[node[go]]
                # the end marker alone is no token: a match may not stop right before it
                take = (token >= 0) & (pos[go] != ends[live[go]] - 1)
                best[go[take]], best_at[go[take]] = token[take], pos[go[take]]
                go = go[pos[go] < ends[live[go]]]
            found = best >= 0
            stuck[live[~found]] = True
            live, best, best_at = live[found], best[found], best_at[found]
            ids.append(best)
            owners.append(live)
            at[live] = best_at
            live = live[best_at < ends[live]]
        rounds = np.repeat(np.arange(len(ids)), [len(i) for i in ids]) if ids else np.zeros(0, np.int64)
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.lexsort((rounds, owners))
        return ids[order], owners[order], stuck

    def merge_all(self, syms: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Exact merging of many words side by side; rows of ids, unused places -1."""
        width = int(n.max())
        none = np.int64(1) << 40
        cols = np.arange(width + 1)
        used = cols[None, :] < n[:, None]
        ids = np.where(used, self.base[np.where(used, syms[np.minimum(starts[:, None] + cols, len(syms) - 1)], 0)], -1)
        rows = np.arange(len(n))
        ids[rows, n - 1] = self.base_end[syms[starts + n - 1]]
        rank = np.where((ids[:, :-1] >= 0) & (ids[:, 1:] >= 0), self._pair_rank(ids[:, :-1], ids[:, 1:]), none)
        live = rows
        while len(live):
            at = np.argmin(rank[live], axis=1)
            r = rank[live, at]
            live, at, r = live[r < none], at[r < none], r[r < none]
            if not len(live):
                break
            new = self.merged_id[r]
            shift = cols[None, :] + (cols[None, :] > at[:, None])
            block = np.concatenate([ids[live], np.full((len(live), 1), -1)], axis=1)
            block = np.take_along_axis(block, shift, axis=1)
            block[np.arange(len(live)), at] = new
            ids[live] = block
            ranks = np.concatenate([rank[live], np.full((len(live), 2), none)], axis=1)
            ranks = np.take_along_axis(ranks, shift[:, :-1], axis=1)
            k = np.arange(len(live))
            right = block[k, at + 1]
            ranks[k, np.minimum(at, width - 1)] = np.where(right >= 0, self._pair_rank(new, right), none)
            left = block[k, at - 1]
            ranks[k, at - 1] = np.where(at > 0, self._pair_rank(left, new), ranks[k, at - 1])
            rank[live] = ranks
        return ids

    def merge(self, word: list[int]) -> list[int]:
        """Exact merging of a word's bytes by rank, leftmost first, with a heap."""
        ids = self.base[word[:-1]].tolist() + [int(self.base_end[word[-1]])]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, width = self.merged.get, int(self.width)
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get(ids[i] * width + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get(new * width + ids[k]):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := get(ids[h] * width + new)):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def encode_symbols(self, syms: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words laid end to end as bytes with 256 behind each; flat, with bounds."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        ids, owner, bad = self.propose(syms, starts, ends)
        if len(ids) > 1:
            inside = owner[1:] == owner[:-1]
            pairs = ids[:-1][inside] * self.width + ids[1:][inside]
            distinct, where = np.unique(pairs, return_inverse=True)
            fails = ~self.compatible(distinct // self.width, distinct % self.width)
            bad[owner[1:][inside][fails[where]]] = True
        failing = np.flatnonzero(bad)
        if not len(failing):
            return ids, np.searchsorted(owner, np.arange(len(ends) + 1))
        size = (ends - starts)[failing]
        short = failing[np.argsort(size, kind="stable")][: int((size <= LONG).sum())]
        good = ~bad[owner]
        parts, owners = [ids[good]], [owner[good]]
        for i in range(0, len(short), MERGE_ROWS):
            some = short[i : i + MERGE_ROWS]
            rows = self.merge_all(syms, starts[some], ends[some] - starts[some] - 1)
            row, col = np.nonzero(rows >= 0)
            parts.append(rows[row, col])
            owners.append(some[row])
        for k in failing[size > LONG]:
            got = self.merge(syms[starts[k] : ends[k] - 1].tolist())
            parts.append(np.array(got))
            owners.append(np.full(len(got), k))
        ids, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(ends) + 1))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words given as byte characters with END behind them."""
        if not words:
            return []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        syms = np.frombuffer("".join(words).encode("utf-16-le"), "<u2").astype(np.int64)
        flat, cut = self.encode_symbols(syms, ends)
        flat, cut = flat.tolist(), cut.tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def _begin_fast(self) -> None:
        """Tables for whole batches of lower-case Latin-1 text, as UTF-8 bytes."""
        kinds = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 number, 3 other
        for code in range(256):
            for kind, text in enumerate((_BLANK, _LETTER, _NUMBER)):
                if re.fullmatch(f"[{text}]", chr(code)):
                    kinds[code] = kind
        self.kinds = kinds
        rng = np.random.default_rng(20240229)
        self.byte_value = rng.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base_power = np.uint64(int(rng.integers(1 << 40, 1 << 62)) * 2 + 1)
        self.power = np.ones(1, np.uint64)
        self.known_hash = np.zeros(0, np.uint64)
        self.known_at = np.zeros(1, np.int64)
        self.known_ids = np.zeros(0, np.int32)
        self.known_bytes = np.zeros(0, np.uint8)
        self.known_start = np.zeros(0, np.int64)
        self.known_size = np.zeros(0, np.int64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            inverse = pow(int(self.base_power), -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base_power)]))
                self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(inverse))]))
        return self.power, self.inverse

    def _word_bounds(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of lower-case Latin-1 text given as UTF-8 bytes."""
        kind = self.kinds[np.minimum(b, 127)]
        lead = np.flatnonzero(b >= 0xC2)
        lead = lead[lead + 1 < len(b)]
        code = ((b[lead] & 3).astype(np.int64) << 6) | (b[lead + 1] & 63)
        kind[lead] = kind[lead + 1] = self.kinds[code]
        start = np.empty(len(b), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == 2
        start[lead + 1] = False
        quote = np.flatnonzero((b == 39) & start)
        if len(quote):
            c = np.concatenate([b, np.zeros(3, np.uint8)])
            one, two = c[quote + 1], c[quote + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            take = quote[short | long]
            size = np.where(short, 2, 3)[short | long]
            start[take + 1] = False
            behind = take + size
            inside = behind < len(b)
            start[behind[inside]] = True
        starts = np.flatnonzero(start)
        ends = np.concatenate([starts[1:], [len(b)]])
        word = kind[starts] != 0
        return starts[word], ends[word]

    def _encode_bytes(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words of the bytes, bounds of each word in them, and the words' starts."""
        starts, ends = self._word_bounds(b) if len(b) else (np.zeros(0, np.int64),) * 2
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64), starts
        power, inverse = self._powers(len(b) + 1)
        with np.errstate(over="ignore"):
            upto = np.empty(len(b) + 1, np.uint64)
            upto[0] = 0
            np.cumsum(self.byte_value[b] * power[: len(b)], out=upto[1:])
            h = (upto[ends] - upto[starts]) * inverse[starts]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= (ends - starts).astype(np.uint64) << np.uint64(48)
        del upto
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        length = ends - starts
        # words whose bytes are not those of the first one with their hash stand for themselves
        odd = np.flatnonzero(~same_bytes(b, starts, length, b, starts[first][which], length[first][which]))
        which[odd] = len(distinct) + np.arange(len(odd))
        n = len(distinct)
        distinct, first = np.concatenate([distinct, h[odd]]), np.concatenate([first, odd])
        lo, width = starts[first], length[first]
        where = np.searchsorted(self.known_hash, distinct)
        hit = np.zeros(len(distinct), bool)
        inside = np.flatnonzero(where < len(self.known_hash))
        inside = inside[self.known_hash[where[inside]] == distinct[inside]]
        k = where[inside]
        hit[inside] = same_bytes(b, lo[inside], width[inside], self.known_bytes, self.known_start[k], self.known_size[k])
        keep = np.zeros(len(distinct), bool)
        keep[:n] = True
        keep[inside] &= hit[inside]  # another word is known by this hash
        miss = np.flatnonzero(~hit)
        at, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        at[hit] = self.known_at[where[hit]]
        size[hit] = self.known_at[where[hit] + 1] - at[hit]
        fresh = np.zeros(0, np.int32)
        if len(miss):
            syms, to = _gather(b, lo[miss], width[miss] + 1)
            syms = syms.astype(np.int64)
            syms[to - 1] = 256
            fresh, cut = self.encode_symbols(syms, to)
            fresh = fresh.astype(np.int32)
            at[miss] = cut[:-1] + len(self.known_ids)
            size[miss] = np.diff(cut)
        pool = np.concatenate([self.known_ids, fresh])
        count = size[which]
        bounds = np.concatenate([[0], np.cumsum(count)])
        flat = pool[np.arange(int(bounds[-1])) - np.repeat(bounds[:-1] - at[which], count)]
        self._remember(b, *(v[keep] for v in (distinct, at, size, lo, width)), pool, len(miss))
        return flat, bounds, starts

    def _remember(self, b, distinct, at, size, lo, width, pool, fresh: int) -> None:
        """Add new words; beyond KNOWN words only those of the last batch stay."""
        if not fresh:
            return
        if len(self.known_hash) + fresh <= KNOWN:
            isnew = at >= len(self.known_ids)
            old_at, old_size, old_start, old_width, old_bytes = self.known_at[:-1], np.diff(self.known_at), self.known_start, self.known_size, self.known_bytes
            distinct, at, size, lo, width = (v[isnew] for v in (distinct, at, size, lo, width))
            distinct, at, size = (np.concatenate(v) for v in ((self.known_hash, distinct), (old_at, at), (old_size, size)))
        else:
            old_start, old_width, old_bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        added, to = _gather(b, lo, width)
        self.known_bytes = np.concatenate([old_bytes, added])
        start = np.concatenate([old_start, to - width + len(old_bytes)])
        order = np.argsort(distinct, kind="stable")
        at, n = at[order], size[order]
        bounds = np.concatenate([[0], np.cumsum(n)])
        self.known_ids = pool[np.arange(int(bounds[-1])) - np.repeat(bounds[:-1] - at, n)]
        self.known_hash, self.known_at = distinct[order], bounds
        self.known_start, self.known_size = start[order], np.concatenate([old_width, width])[order]

    def encode_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        slow, group, held = [], [], 0

        def whole(raw: bytes) -> np.ndarray:
            got = [self._encode_bytes(np.frombuffer(piece, np.uint8))[0] for piece in _pieces(raw)]
            return np.concatenate(got)

        def flush():
            nonlocal group, held
            if group:
                b = np.frombuffer(b" ".join([x for _, x in group]), np.uint8)
                flat, bounds, starts = self._encode_bytes(b)
                ends = np.cumsum([len(x) + 1 for _, x in group])
                cut = bounds[np.searchsorted(starts, np.concatenate([[0], ends]))].tolist()
                for (k, _), lo, hi in zip(group, cut, cut[1:]):
                    out[k] = flat[lo:hi]
            group, held = [], 0

        for k, t in enumerate(texts):
            if "<|" in t or not (t.isascii() or _is_latin(t)):
                slow.append(k)
                continue
            raw = t.lower().encode()
            if len(raw) > FAST_BYTES:
                out[k] = whole(raw)
                continue
            group.append((k, raw))
            held += len(raw)
            if held > FAST_BYTES:
                flush()
        flush()
        for k, got in zip(slow, self.encode_chunked([texts[k] for k in slow])):
            out[k] = got
        return out

    def decode(self, ids: np.ndarray) -> str:
        shown = self.shown
        return " ".join([shown[i] for i in ids.tolist()])

    def _split(self, chunk: str) -> list:
        """Words of a chunk as byte characters with END, and ids of special tokens."""
        if "<|" in chunk:
            out: list = []
            for part in self.split_special.split(chunk):
                out += [self.special[part]] if part in self.special else self._split_plain(part)
            return out
        return self._split_plain(chunk)

    def _split_plain(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return [w + END for w in _LATIN_WORD.findall(chunk.lower())]
        try:
            chunk.encode("latin-1")
        except UnicodeEncodeError:
            lib = self.library
            words = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(chunk))
            return ["".join(self.to_byte[c] for c in w) + END for w, _ in words]
        return [w.encode().decode("latin-1") + END for w in _LATIN_WORD.findall(chunk.lower())]

    def encode_chunked(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, by way of its distinct chunks between ASCII white space."""
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        known = self.chunks
        cut = [_SPACE.split(t) if _ODD_SPACE.search(t) else t.split() for t in texts]
        new = list({x for c in cut for x in c if x not in known})
        split = [self._split(c) for c in new]
        words = list({w for s in split for w in s if isinstance(w, str)})
        ids = dict(zip(words, self.encode_words(words)))
        extra = {}
        for c, s in zip(new, split):
            got = np.array([i for w in s for i in (ids[w] if isinstance(w, str) else [w])], "<u4").tobytes()
            (known if len(c) <= CACHE_CHARS else extra)[c] = got
        return [np.frombuffer(b"".join([known[x] if x in known else extra[x] for x in c]), "<u4") for c in cut]


_LOADED: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def digest_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_tokens and the SHA-256 of ids and decoded text, without keeping either."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        bpe = encoder(path)
        for pdf in batches:
            done = bpe.encode_ids([t or "" for t in pdf["text"]])
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "n_tokens": np.fromiter(map(len, done), np.int64, len(done)),
                "ids_sha256": [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in done],
                "decoded_sha256": [hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in done],
            })

    rows = docs.selectExpr(exact_id(id_col, "doc_id"), f"`{text_col}` AS text")
    out = rows.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.selectExpr("CAST(doc_id AS LONG) AS doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def encode_texts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``token_ids`` (array of int) and ``decoded`` added, in place of any of those names."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    bounded_batches(docs.sparkSession)
    out = StructType([StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    @F.pandas_udf(out)
    def run(texts: pd.Series) -> pd.DataFrame:
        bpe = encoder(path)
        done = bpe.encode_ids([t or "" for t in texts])
        return pd.DataFrame({"token_ids": [i.astype(np.int32) for i in done], "decoded": [bpe.decode(i) for i in done]})

    got = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in out.names], run(F.col(f"`{text_col}`")).alias("_bpe_"))
    return got.select(*[F.col(f"`{c}`") for c in got.columns[:-1]], "_bpe_.token_ids", "_bpe_.decoded")


def decode_ids(ids: list[int], path: str) -> str:
    shown = encoder(path).shown
    return " ".join(shown[i] for i in ids)


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_report(spark, sf_dir: str) -> DataFrame:
    return digest_texts(table(spark, sf_dir, "documents"), public_path())
