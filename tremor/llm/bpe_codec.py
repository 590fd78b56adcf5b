"""Byte-pair encoding and decoding by speculation and verification.

Merging pairs step by step is only needed where a guess fails. For every distinct word

1. greedy longest match proposes tokens: all positions of all words walk a trie of the
   vocabulary side by side, and each word follows its longest matches from its start;
2. every adjacent pair of proposed tokens is tested at once: two tokens are compatible if,
   undoing their merges from the last to the first, no two pieces that meet at the border
   would have been merged there and then (``clashes``). A sequence of tokens that spell
   themselves, all of whose neighbours are compatible, is what merging yields;
3. words with a pair that fails are merged exactly, by rank, the leftmost of equal ranks first.

Only tokens that merging their own spelling gives back are proposed (worked out by the same
test). Texts are cut at ASCII white space, which always ends a word; what a task has encoded
once it keeps, up to KEEP entries. Words of ASCII and Latin letters are cut out here; all other
strings are normalised and cut by the tokenizer's own normaliser and splitter. Tokens of the
tokenizer's added list are recognised in the text, as the library does it.

Null is the empty text: no tokens, and the digests of nothing. Texts of any length are taken
PIECE code points at a time. Bytes that are no UTF-8 count as U+FFFD. Repeated rows and null
ids keep their rows; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_files, once, pieces, slices, split_words, table, texts

VOCABULARY = "word_bpe_49k.json"
#: Entries that a task keeps of what it has encoded; then it begins anew.
KEEP = 1 << 18
#: Code points of texts whose new words are encoded together.
TOGETHER = 1 << 21
#: Bytes from which on a word is merged by itself, with a heap.
LONG = 512
NEVER = np.int64(2**62)
#: Strings in which letters, digits and case are what Python says: visible ASCII and Latin letters that compose no further.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lookup:
    """Integers by integer keys, for whole arrays: open addressing in a table at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == -1)
            taken, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[taken], self.values[taken] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], self.missing)
        on = np.flatnonzero((there != keys) & (there != -1))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys[on]
            out[on[hit]] = self.values[slot[hit]]
            more = ~hit & (there != -1)
            on, slot = on[more], slot[more]
        return out


class Merges:
    """The vocabulary and merges of a BPE tokenizer as arrays; symbols are the ids of single bytes, within a word or at its end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.splitter = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.names = [""] * self.size
        for name, i in [*vocab.items(), *self.added.items()]:
            self.names[i] = name
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

        # the byte alphabet: visible characters stand for themselves, the others follow from 256 on
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(seen)]
        shown = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[shown[b] + suffix] for b in range(256)], np.int64)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, whole = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.born = np.full(self.size, -1, np.int64)
        self.left[whole], self.right[whole], self.born[whole] = left, right, np.arange(len(whole))
        if len(np.unique(whole)) < len(whole) or (self.born[left] >= np.arange(len(whole))).any() or (self.born[right] >= np.arange(len(whole))).any():
            raise ValueError("merges must make each token once, from tokens made before")
        self.pair, self.whole = left * self.size + right, whole
        self.rank_of = Lookup(self.pair, np.arange(len(whole), dtype=np.int64), NEVER)

        # a token spells itself if its two parts do and don't clash before they are merged
        apart = ~self.clashes(left, right, joined=True)
        self.sound = self.born < 0
        for k in range(len(whole)):
            self.sound[whole[k]] = apart[k] and self.sound[left[k]] and self.sound[right[k]]
        self._build_trie()

    def _build_trie(self) -> None:
        spelt: list[tuple[int, ...]] = [(i,) for i in range(self.size)]
        symbols = np.unique(np.concatenate([self.inner, self.last]))
        self.symbol = np.zeros(self.size, np.int64)
        self.symbol[symbols] = np.arange(len(symbols))
        self.width = len(symbols)
        code = self.symbol.tolist()
        edges: dict[int, int] = {}
        ends: list[int] = [-1]
        for i in [*symbols.tolist(), *self.whole.tolist()]:
            if self.born[i] >= 0:
                spelt[i] = spelt[self.left[i]] + spelt[self.right[i]]
            if not self.sound[i]:
                continue
            node = 0
            for s in spelt[i]:
                key = node * self.width + code[s]
                node = edges.get(key, -1)
                if node < 0:
                    node = edges[key] = len(ends)
                    ends.append(-1)
            ends[node] = i
        self.ends = np.array(ends, np.int64)
        self.next_node = Lookup(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)), -1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b, NEVER where there is none."""
        return self.rank_of(a * self.size + b)

    def clashes(self, a: np.ndarray, b: np.ndarray, joined: bool = False) -> np.ndarray:
        """Whether pieces of a and b would be merged across their border, for arrays of neighbours.

        Time runs backwards: of the two pieces at the border, the one made last (of equal
        ranks the right one) is undone. In between, their own merge must not come before the
        merge that took either of them away; of equal merges the left one comes first.
        ``joined``: the merge of a and b itself is wanted.
        """
        bad = np.zeros(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        gone_x, gone_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            if not joined:
                m = self.ranks(x, y)
                hit = (m < gone_x) & (m <= gone_y)
                bad[live[hit]] = True
            else:
                hit, joined = np.zeros(len(live), bool), False
            made_x, made_y = self.born[x], self.born[y]
            on = ~hit & ((made_x >= 0) | (made_y >= 0))
            live, x, y, gone_x, gone_y, made_x, made_y = (v[on] for v in (live, x, y, gone_x, gone_y, made_x, made_y))
            right = made_y >= made_x
            gone_y, gone_x = np.where(right, made_y, gone_y), np.where(right, gone_x, made_x)
            x, y = np.where(right, x, self.right[x]), np.where(right, self.left[y], y)
        return bad

    def propose(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the start of each word on: tokens in order, and each token's word."""
        n = len(symbols)
        stop = np.repeat(ends, ends - starts)
        best, size = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        code = self.symbol[symbols]
        while len(at):
            node = self.next_node(node * self.width + code[at + depth])
            ok = node >= 0
            at, node, depth = at[ok], node[ok], depth + 1
            token = self.ends[node]
            done = token >= 0
            best[at[done]], size[at[done]] = token[done], depth
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        chosen = np.zeros(n, bool)
        place = starts
        stop = ends
        while len(place):
            chosen[place] = True
            place = place + size[place]
            on = place < stop
            place, stop = place[on], stop[on]
        at = np.flatnonzero(chosen)
        return best[at], np.searchsorted(ends, at, side="right")

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging of one word, whatever its length."""
        n = len(symbols)
        ids, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
        rank = self.merge_ranks()
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.whole[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (q := rank.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (q, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def merge_ranks(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_merge_ranks"):
            self._merge_ranks = dict(zip(zip((self.pair // self.size).tolist(), (self.pair % self.size).tolist(), strict=True), range(len(self.pair)), strict=True))
        return self._merge_ranks

    def merge_all(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words side by side: symbols end to end and their numbers, before and after.

        A round merges in each word every occurrence of its least rank (of overlapping ones the
        left); what that makes has a greater rank, so the order is that of one merge at a time.
        """
        word = np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), NEVER)
            near = np.flatnonzero(word[1:] == word[:-1])
            rank[near] = self.ranks(symbols[near], symbols[near + 1])
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.concatenate([first, [len(word)]]))
            least = np.repeat(least, count)
            over = least == NEVER
            if over.any():
                done.append((word[over], symbols[over]))
                symbols, word, rank, least = symbols[~over], word[~over], rank[~over], least[~over]
            at = np.flatnonzero(rank == least)
            if not len(at):
                continue
            new = np.concatenate([[True], (np.diff(at) != 1) | (symbols[at[1:]] != symbols[at[:-1]])])
            run = np.flatnonzero(new)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate([run, [len(at)]])))) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.whole[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return symbols, lengths
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(lengths))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of non-empty words end to end, offsets, and how many words had to be merged exactly."""
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        tokens, word = self.propose(symbols, starts, ends)
        near = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(tokens[near] * self.size + tokens[near + 1], return_inverse=True)
        bad = self.clashes(pairs // self.size, pairs % self.size)[back]
        failed = np.unique(word[near[bad]])
        counts = np.bincount(word, minlength=len(words))
        if len(failed):
            long = failed[lengths[failed] > LONG]
            short = failed[lengths[failed] <= LONG]
            own = np.repeat(starts[short], lengths[short]) + np.arange(lengths[short].sum()) - np.repeat(np.cumsum(lengths[short]) - lengths[short], lengths[short])
            merged, times = self.merge_all(symbols[own], lengths[short])
            slow = [np.array(self.merge(symbols[starts[w] : ends[w]].tolist()), np.int64) for w in long]
            good = np.ones(len(words), bool)
            good[failed] = False
            tokens, word = tokens[good[word]], word[good[word]]
            counts[short], counts[long] = times, [len(m) for m in slow]
            order = np.argsort(np.concatenate([word, np.repeat(short, times), np.repeat(long, counts[long])]), kind="stable")
            tokens = np.concatenate([tokens, merged, *slow])[order]
        return tokens, np.concatenate([[0], np.cumsum(counts)]), len(failed)


class Spans:
    """Strings by number, each with its tokens, which stand end to end in the order of the strings."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.tokens, self.starts, self.counts = (np.empty(0, np.int64) for _ in range(3))

    def add(self, strings: list[str], tokens: np.ndarray, counts: np.ndarray) -> None:
        self.place.update(zip(strings, range(len(self.place), len(self.place) + len(strings)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(counts) - counts])
        self.tokens, self.counts = np.concatenate([self.tokens, tokens]), np.concatenate([self.counts, counts])

    def find(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, strings), np.int64, len(strings))

    def take(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the strings of these numbers, end to end, and where each string's begin."""
        counts = self.counts[own]
        first = np.cumsum(counts) - counts
        return self.tokens[np.repeat(self.starts[own] - first, counts) + np.arange(counts.sum())], first


class Codec:
    """Encodes and decodes texts; keeps what it has encoded."""

    #: After lower-casing: contractions, letters, one digit, other signs; fixed by the vocabulary's own pattern. Line ends part strings.
    PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\na-z0-9ß-öø-ſ]+")

    def __init__(self, path: str):
        self.merges = Merges(path)
        names = [(n + " ").encode() for n in self.merges.names]
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        self.name_sizes = np.array([len(n) for n in names], np.int64)
        self.name_starts = np.cumsum(self.name_sizes) - self.name_sizes
        self.strings, self.words = Spans(), Spans()
        self.exact = 0

    def _parts(self, string: str) -> list[str]:
        """Words of any string without white space; added tokens after a line end, which no word holds."""
        splitter, pattern = self.merges.splitter, self.merges.added_pattern
        found: list[str] = []
        for k, part in enumerate(pattern.split(string) if pattern else [string]):
            if k % 2:
                found.append("\n" + part)
            elif part:
                normal = splitter.normalizer.normalize_str(part)
                found += [normal[a:b] for _, (a, b) in splitter.pre_tokenizer.pre_tokenize_str(normal)]
        return found

    def learn(self, strings: set[str]) -> None:
        """Encode strings without white space that are not known yet."""
        if len(self.strings.place) > KEEP or len(self.words.place) > KEEP:
            self.strings, self.words = Spans(), Spans()
        new = list(strings.difference(self.strings.place))
        if not new:
            return
        pattern = self.merges.added_pattern
        odd = pattern.search if pattern and pattern.search("\n".join(new)) else lambda s: None
        hard = [s for s in new if PLAIN.fullmatch(s) is None or odd(s)]
        if hard:
            new = [*set(new).difference(hard), *hard]
        easy = new[: len(new) - len(hard)]
        parts = self.PARTS.findall("\n".join(easy).lower() + "\n") if easy else []
        for s in hard:
            parts += [*self._parts(s), "\n"]

        fresh = [w for w in dict.fromkeys(parts) if w not in self.words.place]
        words = [w for w in fresh if w[0] != "\n"]
        if words:
            tokens, offsets, exact = self.merges.encode_words([w.encode() for w in words])
            self.exact += exact
            self.words.add(words, tokens, np.diff(offsets))
        added = [w for w in fresh if w[0] == "\n"]
        ids = [self.merges.added[w[1:]] for w in added if len(w) > 1]
        self.words.add(added, np.array(ids, np.int64), np.array([len(w) > 1 for w in added], np.int64))

        own = self.words.find(parts)
        tokens, first = self.words.take(own)
        ends = first[own == self.words.place["\n"]]
        self.strings.add(new, tokens, np.diff(ends, prepend=0))

    def encode(self, strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per piece of text its ids and its decoded bytes with a blank after each token, TOGETHER code points at a time."""
        held: list[list[str]] = []
        size = 0

        def done() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            flat = [w for ws in held for w in ws]
            self.learn(set(flat))
            ids, first = self.strings.take(self.strings.find(flat))
            first = np.append(first, len(ids))
            bounds = first[np.cumsum([0, *map(len, held)])]
            shown, ends = self.show(ids)
            ends = np.append(0, ends)[bounds].tolist()
            bounds = bounds.tolist()
            for k in range(len(held)):
                yield ids[bounds[k] : bounds[k + 1]], shown[ends[k] : ends[k + 1]]

        for s in strings:
            held.append(split_words(s))
            size += len(s)
            if size >= TOGETHER:
                yield from done()
                held, size = [], 0
        yield from done()

    def show(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of tokens as bytes, a blank after each, and where each ends: the library's decoding where no decoder is set, but for the last blank."""
        sizes = self.name_sizes[ids]
        ends = np.cumsum(sizes)
        return self.name_bytes[np.repeat(self.name_starts[ids] - ends + sizes, sizes) + np.arange(sizes.sum())], ends

    def decode(self, ids: np.ndarray) -> str:
        return self.show(np.asarray(ids, np.int64))[0].tobytes()[:-1].decode()


def _encode(path: str, with_tokens: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(f"bpe:{path}", lambda: Codec(path))
        for part in (x for whole in parts for x in slices(whole)):
            strings = [t or "" for t in texts(part.column(1))]
            cut = [list(pieces(s)) for s in strings]
            found = codec.encode([p for c in cut for p in c])
            rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for c in cut:
                n = 0
                digests = hashlib.sha256(), hashlib.sha256()
                kept: list[tuple[np.ndarray, np.ndarray]] = []
                blank = b""
                for _ in c:
                    ids, shown = next(found)
                    n += len(ids)
                    digests[0].update(ids.astype("<u4"))
                    if len(shown):  # the last blank waits for what follows
                        digests[1].update(blank)
                        digests[1].update(shown[:-1])
                        blank = b" "
                    if with_tokens:
                        kept.append((ids, shown))
                rows["n_tokens"].append(n)
                rows["ids_sha256"].append(digests[0].hexdigest())
                rows["decoded_sha256"].append(digests[1].hexdigest())
                if with_tokens:
                    rows["ids"].append(np.concatenate([k[0] for k in kept]).astype(np.int32))
                    rows["decoded"].append(np.concatenate([k[1] for k in kept]).tobytes()[:-1].decode())
            cols = {"doc_id": part.column(0), "n_tokens": pa.array(rows["n_tokens"], pa.int64()), "ids_sha256": pa.array(rows["ids_sha256"], pa.string()), "decoded_sha256": pa.array(rows["decoded_sha256"], pa.string())}
            if with_tokens:
                cols |= {"ids": pa.array(rows["ids"], pa.list_(pa.int32())), "decoded": pa.array(rows["decoded"], pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def encode_documents(docs: DataFrame, path: str | None = None, with_tokens: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, the digests of its ids and of its decoded text and, where wanted, both themselves.

    ``path`` names a BPE tokenizer file that the executors have too.
    """
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_tokens else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(path or default_path(), with_tokens), kinds)


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(encode_documents(table(spark, sf_dir, "documents"), with_tokens=False))


QUERIES = {"op12_bpe_codec": op12_bpe_codec}
