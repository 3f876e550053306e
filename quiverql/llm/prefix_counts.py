"""Token counts: prefix dynamic programming keeps the exact token count of every prefix.

A token sequence is what byte-pair encoding makes of its bytes exactly if each two neighbours are what it
makes of theirs. So each prefix of a word has one last token: the token t ending there which agrees with the
last token of the prefix before t; its count is that prefix's count plus one. Words meet at the splitting
pattern's boundaries, so counts of whole words add up.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .base import documents, slices

#: Entries of a worker's tables of words, pieces and pairs; a full table is emptied (that costs time, not results).
MEMO = 250_000


class PrefixCounter:
    """Exact counts for byte-level BPE files. For other files (exact is False) each prefix is encoded by the library."""

    def __init__(self, path: str):
        self.tokenizer = bpe.load(path)
        self.exact = bpe.exact_core(path, self.tokenizer) is not None
        self.vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.longest = max(map(len, self.vocab), default=1)
        self.letters = bpe.Letters()
        self.pattern = regex.compile(bpe.PATTERN)
        special = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(special)) if special else None
        self.agree, self.words, self.pieces = Agreement(self.tokenizer.model.tokenize), Memo(self.last_count), {}
        self.table = ByteTable(self.tokenizer, path) if self.exact else None

    def states(self, word: str) -> list[int]:
        """The count of every byte prefix of one word of the splitting pattern; the first is 0."""
        word = word.translate(self.letters)
        vocab, agree = self.vocab, self.agree
        last, counts = [""], [0]
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                token = word[start:end]
                if token in vocab and (not start or agree[last[start], token]):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
        return counts

    def last_count(self, word: str) -> int:
        return self.states(word)[-1]

    def pieces_of(self, text: str) -> list[str]:
        """Parts that start at single spaces and stand between single line ends: there, words of the pattern end anyway."""
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[-1] in " \n" or not text.isprintable() and any(c in text for c in "\0\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0"):
            return self.pattern.findall(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def counts(self, texts: list[str | None]) -> list[int]:
        """The counts of whole texts."""
        return self.measured(texts, None)[0]

    def measured(self, texts: list[str | None], limit: int | None) -> tuple[list[int], list[list[int]]]:
        """The counts of whole texts, sums over pieces of which each new one goes through the table once, and their cuts (none without a limit)."""
        if not self.exact:
            counts = [len(self.tokenizer.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
            return counts, [cuts(self.prefixes(t), limit) if limit and n > limit else [] for t, n in zip(texts, counts, strict=True)]
        odd = [not t or bool(bpe.PLAIN.search(t) or self.special and self.special.search(t)) for t in texts]
        split = [[] if x else self.pieces_of(t) for t, x in zip(texts, odd, strict=True)]
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        self.learn(list(set().union(*split).difference(self.pieces)))
        self.words.tidy()
        self.agree.tidy()
        known, counts, found = self.pieces.__getitem__, [], []
        for text, x, own in zip(texts, odd, split, strict=True):
            if x:
                table = self.prefixes(text)
                counts.append(int(table[-1]))
                found.append(cuts(table, limit) if limit else [])
                continue
            each = list(map(known, own))
            counts.append(sum(each))
            found.append(self.piece_cuts(own, each, limit) if limit and counts[-1] > limit else [])
        return counts, found

    def piece_cuts(self, pieces: list[str], each: list[int], limit: int) -> list[int]:
        """The cuts of a text, from its pieces and their counts.

        A prefix that reaches into a piece has more tokens than the pieces before, but for one that ends in the
        first blank after a blank: it has more than those before both. So the longest prefix within a budget ends
        in the piece that goes beyond the budget or the next one, and the piece before has a say in it.
        """
        sums, ends, out = np.cumsum([0, *each]), np.cumsum([0, *map(len, pieces)]), []
        for budget in range(limit, int(sums[-1]), limit):
            over = int(np.searchsorted(sums, budget, "right")) - 1
            first = max(0, over - 1)
            table = self.prefixes("".join(pieces[first : over + 2]))
            out.append(int(ends[first] + np.flatnonzero(table <= budget - sums[first])[-1]))
        return out

    def learn(self, pieces: list[str]) -> None:
        words, ends = [], []
        for piece in pieces:
            words += (piece,) if piece[1:].isalpha() and (piece[0] == " " or piece.isalpha()) else self.pattern.findall(piece)
            ends.append(len(words))
        made = np.concatenate([[0], np.cumsum(self.table.last_counts(words, self.last_count))])
        self.pieces.update(zip(pieces, np.diff(made[[0, *ends]]).tolist(), strict=True))

    def count(self, text: str | None) -> int:
        return self.counts([text])[0]

    def prefixes(self, text: str | None) -> np.ndarray:
        """Counts of text[:0], text[:1], ... text[:len(text)], each what encoding that prefix would give."""
        text = text or ""
        out = np.zeros(len(text) + 1, np.int32)
        if not self.exact:
            for at in range(1, len(text) + 1):
                out[at] = len(self.tokenizer.encode(text[:at], add_special_tokens=False).ids)
            return out
        at, base = 0, 0
        for found in [*(self.special.finditer(text) if self.special else ()), None]:
            # a special string counts as one token once it is whole, and as plain text before
            stop = found.end() if found else len(text)
            out[at : stop + 1] = base + self.plain_prefixes(text[at:stop])
            if found:
                base += int(self.plain_prefixes(text[at : found.start()])[-1]) + 1
                out[stop] = base
                at = stop
        return out

    def plain_prefixes(self, text: str) -> np.ndarray:
        out, at, base, before, blank = np.zeros(len(text) + 1, np.int32), 0, 0, 0, ""
        for word in self.pattern.findall(text):
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word])
            counts = np.array(self.states(word), np.int32)[ends]
            if word[0] == "'":  # of a contraction, shorter prefixes are split otherwise
                counts[:-1] = [sum(self.words[w] for w in self.pattern.findall(word[:k])) for k in range(1, len(word))]
            out[at + 1 : at + 1 + len(word)] = base + counts
            if blank and word[0].isspace():  # a prefix that ends in this blank has it and those before as one word
                out[at + 1] = before + self.words[blank + word[0]]
            before, blank = base, word if word.isspace() else ""
            base += int(counts[-1])
            at += len(word)
        return out


def cuts(table: np.ndarray, limit: int) -> list[int]:
    """For each multiple of limit below the whole count the most code points whose prefix has at most so many tokens, from the table of all prefixes."""
    return [int(np.flatnonzero(table <= budget)[-1]) for budget in range(limit, int(table[-1]), limit)]


class Lookup:
    """From distinct 64-bit keys to small numbers, for whole arrays: a slot and a few that follow it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 3)
        self.keys, self.values, self.far = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 1
        for key, value, at in zip(keys.tolist(), values.tolist(), self.slot(keys).tolist(), strict=True):
            step = 0
            while self.values[(at + step) % len(self.keys)] >= 0:
                step += 1
            self.keys[(at + step) % len(self.keys)], self.values[(at + step) % len(self.keys)] = key, value
            self.far = max(self.far, step + 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for others."""
        at, out, mask = self.slot(keys), np.full(len(keys), -1, np.int32), len(self.keys) - 1
        todo = np.arange(len(keys))
        for _ in range(self.far):
            found = self.values[at]
            hit = (found >= 0) & (self.keys[at] == keys[todo])
            out[todo[hit]] = found[hit]
            more = (found >= 0) & ~hit
            if not more.any():
                break
            todo, at = todo[more], (at[more] + 1) & mask
        return out


class ByteTable:
    """The same dynamic programming for many short words at once, over arrays of their bytes."""

    #: Words of more bytes go one by one.
    WIDTH = 48

    def __init__(self, tokenizer, path: str):
        import json

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        back, vocab = {letter: b for b, letter in enumerate(bpe.byte_letters())}, model["vocab"]
        own = {at: np.frombuffer(bytes(back[c] for c in token), np.uint8) for token, at in vocab.items()}
        self.longest = min(self.WIDTH, max(map(len, own.values())))
        self.powers = np.cumprod(np.full(self.WIDTH + 1, 0x100000001B3, np.uint64)).astype(np.uint64)
        short = {at: b for at, b in own.items() if len(b) <= self.WIDTH}
        keys = np.array([((b.astype(np.uint64)[::-1] + np.uint64(1)) * self.powers[: len(b)]).sum(dtype=np.uint64) for b in short.values()], np.uint64)
        if len(set(keys.tolist())) != len(keys):
            raise ValueError("two tokens share a hash")
        self.tokens, self.bytes_of = Lookup(keys, np.array(list(short), np.int32)), own
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        self.left[ids[:, 2]], self.right[ids[:, 2]], self.rank[ids[:, 2]] = ids[:, 0], ids[:, 1], np.arange(len(ids))
        self.merges = Lookup((ids[:, 0].astype(np.uint64) << np.uint64(20)) | ids[:, 1].astype(np.uint64), np.arange(len(ids), dtype=np.int32))

    def agree(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of both in order leaves the two tokens: from the last merge back, no listed merge joined their facing parts while both stood."""
        good, todo = np.ones(len(one), bool), np.arange(len(one))
        one, two, limit = one.astype(np.int64), two.astype(np.int64), np.full(len(one), 1 << 40)
        while len(todo):
            merge = self.merges.get((one.astype(np.uint64) << np.uint64(20)) | two.astype(np.uint64))
            bad = (merge >= 0) & (merge < limit)
            good[todo[bad]] = False
            a, b = self.rank[one], self.rank[two]
            go = ~bad & ((a >= 0) | (b >= 0))
            todo, one, two, a, b = todo[go], one[go], two[go], a[go], b[go]
            first = a > b
            limit = np.where(first, a, b + 1)
            one, two = np.where(first, self.right[one], one), np.where(first, two, self.left[two])
        return good

    def last_counts(self, words: list[str], slow) -> np.ndarray:
        made = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes, out = np.array([len(b) for b in made], np.int64), np.zeros(len(words), np.int64)
        for low, high in ((0, 8), (8, 12), (12, 20), (20, self.WIDTH)):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(at), 20_000):
                part = at[k : k + 20_000]
                grid = np.zeros((len(part), high), np.uint8)
                grid[np.arange(high) < sizes[part][:, None]] = np.frombuffer(b"".join([made[i] for i in part]), np.uint8)
                out[part] = self.states(grid)[np.arange(len(part)), sizes[part]]
        for i in np.flatnonzero(sizes > self.WIDTH):
            out[i] = slow(words[i])
        return out

    def states(self, grid: np.ndarray) -> np.ndarray:
        """Counts of all byte prefixes of the rows."""
        rows, width = grid.shape
        values = grid.astype(np.uint64).T + np.uint64(1)
        last, counts = np.zeros((width + 1, rows), np.int32), np.zeros((width + 1, rows), np.int32)
        for end in range(1, width + 1):
            sums, found = np.zeros(rows, np.uint64), []
            for k in range(1, min(end, self.longest) + 1):
                sums = sums + values[end - k] * self.powers[k - 1]
                found.append(self.tokens.get(sums))
            todo = np.arange(rows)
            for k in range(len(found), 0, -1):
                token = found[k - 1][todo]
                fits = token >= 0
                if k < end:
                    at = np.flatnonzero(fits)
                    fits[at] = self.agree(last[end - k][todo[at]], token[at])
                at = todo[fits]
                last[end, at], counts[end, at] = token[fits], counts[end - k, at] + 1
                todo = todo[~fits]
                if not len(todo):
                    break
        return counts.T


class Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        out = self[key] = self.make(key)
        return out

    def tidy(self) -> None:
        if len(self) > MEMO:
            self.clear()


class Agreement(Memo):
    """Whether two tokens are what the model makes of their bytes together."""

    def __init__(self, tokenize):
        super().__init__(lambda pair: [t.value for t in tokenize(pair[0] + pair[1])] == list(pair))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(frame: DataFrame, path: str, limit: int = 512, index: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars, cuts and, with index, prefix_tokens.

    fit_chars is the most code points of the text whose prefix has at most limit tokens, cuts the same for every multiple
    of limit that the text has more tokens than; prefix_tokens are the counts of all code point prefixes, from the
    empty one on. All come from the prefix table, and no prefix is encoded again. A null or empty text has 0 bytes, tokens
    and fitting code points, no cuts and one prefix. Rows with a null doc_id or equal rows are kept as they are; other columns are
    left out. One pass, no shuffle; a text is held whole by one task.
    """
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint, cuts array<bigint>" + ", prefix_tokens array<int>" * index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(path)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            if index:
                tables = [made.prefixes(t) for t in texts]
                counts, found = [t[-1] for t in tables], [cuts(t, limit) for t in tables]
            else:
                counts, found = made.measured(texts, limit)
            counts = np.array(counts, np.int64)
            fit = [c[0] if c else len(t or "") for c, t in zip(found, texts, strict=True)]
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts), pa.array(counts > limit), pa.array(fit, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            if index:
                columns.append(pa.array(tables, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "cuts"] + ["prefix_tokens"] * index)

    sized = documents(frame).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    return sized.mapInArrow(run, schema)


def longest_prefix(prefix_tokens, budget) -> F.Column:
    """The most code points of a text whose prefix has at most budget tokens, from its prefix_tokens."""
    fits = F.transform(prefix_tokens, lambda n, at: F.when(n <= F.lit(budget), at).otherwise(F.lit(0)))
    return F.array_max(fits)
