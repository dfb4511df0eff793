"""Byte-level BPE: encode texts by a file of merge ranks, decode ids. Pending merges, of one match or of many at once, wait in a rank queue with a hierarchical bitmap."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.common import map_texts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
RANKS = "byte_bpe_multi_50k.tiktoken"
#: A task keeps the ids of up to twice so many short chunks of text, of a quarter as many other matches, and of those of one slice; it only saves time.
CACHED = 100_000
_LONG = 64
#: Texts are handled in slices of about so many bytes; new matches of a slice are merged together, so many at once, if they are FEW or more and short.
SLICE, TOGETHER, FEW = 3 << 19, 1 << 16, 512
#: A blank beside other white space.
_WIDE = re.compile(r" (?:\s|(?<=\s ))")


class RankQueue:
    """Positions by merge rank. Two levels of 256-bit words tell which ranks have any; find-first-set walks down from the top.

    A bucket is a position, or a heap of them; or, with push_all and pop_all alone, a list of arrays of positions.
    An entry isn't removed when its pair goes: the reader skips those that are stale."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, int | list[int]] = {}
        self.top, self.low = 0, [0] * (ranks // 256 + 1)
        self.bits = [1 << k for k in range(256)]

    def push(self, rank: int, position: int) -> None:
        buckets = self.buckets
        if rank in buckets:
            if type(bucket := buckets[rank]) is int:
                buckets[rank] = [bucket, position] if bucket < position else [position, bucket]
            else:
                heappush(bucket, position)
            return
        buckets[rank] = position
        a = rank >> 8
        if not self.low[a]:
            self.top |= 1 << a
        self.low[a] |= self.bits[rank & 255]

    def fill(self, ranks: list[int]) -> None:
        """Push the ranks, from left to right, that aren't -1. A place waits outside while the one to its left has a rank that goes first."""
        buckets, low, bits = self.buckets, self.low, self.bits
        left = -1
        for position, rank in enumerate(ranks):
            if rank >= 0 and not 0 <= left <= rank:
                if rank in buckets:
                    self.push(rank, position)
                else:
                    buckets[rank] = position
                    a = rank >> 8
                    if not low[a]:
                        self.top |= 1 << a
                    low[a] |= bits[rank & 255]
            left = rank

    def pop(self) -> tuple[int, int]:
        """The least rank and its leftmost position; (-1, -1) if there is none."""
        top = self.top
        if not top:
            return -1, -1
        a = (top & -top).bit_length() - 1
        word = self.low[a]
        bit = word & -word
        rank = a << 8 | bit.bit_length() - 1
        bucket = self.buckets[rank]
        if type(bucket) is list:
            position = heappop(bucket)
            if bucket:
                return rank, position
        else:
            position = bucket
        del self.buckets[rank]
        if word == bit:
            self.top = top ^ (1 << a)
        self.low[a] = word ^ bit
        return rank, position

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Push the positions, each with its rank, but those of rank -1."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        first = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *first.tolist(), len(ranks)]
        buckets, low, bits = self.buckets, self.low, self.bits
        for rank, a, b in zip(ranks[starts[:-1]].tolist() if len(ranks) else (), starts, starts[1:]):
            if rank < 0:
                continue
            if rank in buckets:
                buckets[rank].append(positions[a:b])
                continue
            buckets[rank] = [positions[a:b]]
            if not low[rank >> 8]:
                self.top |= 1 << (rank >> 8)
            low[rank >> 8] |= bits[rank & 255]

    def pop_all(self) -> tuple[int, np.ndarray]:
        """The least rank and all its positions, from left to right, as often as they were pushed; there must be one."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.low[a]
        bit = word & -word
        rank = a << 8 | bit.bit_length() - 1
        if word == bit:
            self.top ^= 1 << a
        self.low[a] = word ^ bit
        positions = self.buckets.pop(rank)
        return rank, np.sort(np.concatenate(positions) if len(positions) > 1 else positions[0])


def packed(ids: list[int]) -> bytes:
    """Ids as an array of C's int."""
    return array("i", ids).tobytes()


class Codec:
    """Ranks of a vocabulary in which every single byte is a token."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        tokens = {b: a for a, b in self.ranks.items()}
        # By id, for whole arrays of ids; an id that no token has is null. Offsets have 64 bits, so a text of any length fits.
        self.tokens = pa.array(map(tokens.get, range(max(tokens) + 1)), pa.large_binary())
        self.names = pa.array([b"%d," % k for k in range(max(tokens) + 1)], pa.large_binary())
        # The rank of each pair of bytes, by both as one number.
        self.bytes = [self.ranks.get(k.to_bytes(2), -1) for k in range(1 << 16)]
        # For arrays: the same, the id of each byte, and the rank of each pair of tokens, the pairs as sorted numbers.
        self.byte_pairs = np.array(self.bytes, np.int32)
        self.byte_ids = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        ids = self.ranks.get
        found = ((a << 32 | b, r) for t, r in self.ranks.items() for k in range(1, len(t)) if (a := ids(t[:k])) is not None and (b := ids(t[k:])) is not None)
        pairs = np.sort(np.fromiter(found, [("key", np.int64), ("rank", np.int32)]), order="key")
        self.pair_keys = np.append(pairs["key"], np.int64(1 << 62))
        self.pair_ranks = np.append(pairs["rank"], np.int32(-1))
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(tokens))
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: merge the pair of least rank, leftmost first, until no pair is a token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        # Part i is piece[i:after[i]]; before[i] starts the part in front of it. rank[i] is that of part i with the next, -1 if it is none or has gone.
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pairs = self.bytes
        rank = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
        rank.append(-1)
        # The loop pops the queue in place, which is most of the time of short pieces; it leaves the queue empty.
        get, queue, push = ranks.get, self.queue, self.queue.push
        buckets, low = queue.buckets, queue.low
        queue.fill(rank)
        while top := queue.top:
            a = (top & -top).bit_length() - 1
            word = low[a]
            bit = word & -word
            r = a << 8 | bit.bit_length() - 1
            bucket = buckets[r]
            i = bucket if type(bucket) is int else heappop(bucket)
            if i is bucket or not bucket:
                del buckets[r]
                low[a] = word = word ^ bit
                if not word:
                    queue.top = top & (top - 1)
            if rank[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            gone, rank[j] = rank[j], -1
            if k < n:
                before[k] = i
                if 0 <= gone <= rank[k]:
                    push(rank[k], k)  # it may have waited for the pair that has gone
                rank[i] = new = get(piece[i : after[k]], -1)
                if new >= 0:
                    push(new, i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                rank[h] = new = get(piece[h:k], -1)
                if new >= 0:
                    push(new, h)
        ids = []
        i = 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 if it is none."""
        keys = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """What merge() gives for each of the pieces, none of them empty, packed. All are merged at once, with one queue and linked lists in arrays.

        A bucket is worked on as a whole, but of each piece only its leftmost position; the others go back, as a merge may bring a pair of a lower rank."""
        n = sum(map(len, pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        # The last place of each array stands for what lies outside of all pieces; -1 is that place, too.
        piece = np.append(np.repeat(np.arange(len(pieces), dtype=np.int32), [len(x) for x in pieces]), np.int32(-1))
        own = np.append(self.byte_ids[data], np.int32(0))
        after = np.minimum(np.arange(1, n + 2, dtype=np.int32), n)
        before = np.arange(-1, n, dtype=np.int32)
        rank = np.full(n + 1, -1, np.int32)
        inside = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inside] = self.byte_pairs[data[inside].astype(np.int32) << 8 | data[inside + 1]]
        left = np.ones(n + 1, bool)
        left[n] = False
        queue = self.queue
        queue.push_all(rank[inside], inside.astype(np.int32))
        while queue.top:
            r, i = queue.pop_all()
            i = i[rank[i] == r]
            of = piece[i]
            if len(i) > 1 and (again := of[1:] == of[:-1]).any():
                queue.push_all(np.full(np.count_nonzero(again), r, np.int32), i[1:][again])
                i = i[np.append(True, ~again)]
                of = piece[i]
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            h = before[i]
            after[i], before[k], own[i] = k, i, r
            left[j], rank[j] = False, -1
            rank[i] = to_right = np.where(piece[k] == of, self.pair_rank(own[i], own[k]), np.int32(-1))
            has = piece[h] == of
            h = h[has]
            rank[h] = to_left = self.pair_rank(own[h], own[i[has]])
            queue.push_all(np.concatenate((to_right, to_left)), np.concatenate((i, h)))
        ids = own[left].tobytes()
        ends = np.cumsum(4 * np.bincount(piece[left], minlength=len(pieces))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merged(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of distinct matches, packed: short ones that are many all together, others one by one."""
        out, todo = {}, []
        for piece in pieces:
            data = piece.encode()
            if (whole := self.ranks.get(data)) is not None:
                out[piece] = packed([whole])
            elif len(piece) > _LONG:
                out[piece] = packed(self.merge(data))
            else:
                todo.append((piece, data))
        for k in range(0, len(todo), TOGETHER):
            names, parts = zip(*todo[k : k + TOGETHER])
            out |= zip(names, self.merge_all(parts) if len(parts) >= FEW else (packed(self.merge(x)) for x in parts))
        return out

    def chunk(self, text: str) -> list[int]:
        """The ids of a text, each match of the pattern separately."""
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.merge(piece.encode())
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return array("i", self.encode_all([text])[0]).tolist()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, packed, which takes half the memory of a list.

        No match of the pattern crosses the place before a blank between other characters, so texts whose blanks stand so are split there, and
        ids of short chunks are kept for the next time. Of other texts, those of matches are."""
        if len(self.recent) >= CACHED:
            self.older, self.recent = self.recent, {}
        if len(self.inner) >= CACHED // 4:
            self.inner = {}
        rows, words, others = [], set(), set()
        for text in texts:
            if wide := bool(_WIDE.search(text)):
                head, tail = [], self.pattern.findall(text)
            else:
                # What stands before the first blank has none before it, so its matches are looked up as others inside of words are.
                first, *tail = text.split(" ")
                others.update(head := self.pattern.findall(first))
            got = list(map((self.inner if wide else self.recent).get, tail))
            if None in got:
                (others if wide else words).update([c for c, ids in zip(tail, got) if ids is None])
            rows.append((wide, head, tail, got))
        of_words, of_others = self.learnt(words, others)
        out = []
        for wide, head, tail, got in rows:
            new = of_others if wide else of_words
            out.append(b"".join([of_others[c] for c in head] + [new[c] if ids is None else ids for c, ids in zip(tail, got)]))
        return out

    def learnt(self, words: set[str], others: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """The ids of words, each with a blank before it, and of other matches, packed; they are kept if they are short.

        Those of a word's first match are kept too: the same word with other marks behind it starts with them."""
        recent, older, inner = self.recent, self.older, self.inner
        of_words = {w: ids for w in words if (ids := older.get(w)) is not None}
        # Words of split texts have no white space at their start, so side by side with a blank before each they match as alone; a match with a blank starts a word.
        fresh = [w for w in words if w not in of_words]
        pieces = self.pattern.findall(" " + " ".join(fresh)) if fresh else []
        starts = [k for k, c in enumerate(pieces) if c[0] == " "]
        known, new = {}, []
        for c in others.union(pieces):
            ids = (recent.get(c[1:]) or older.get(c[1:])) if c[0] == " " else inner.get(c)
            if ids is None:
                new.append(c)
            else:
                known[c] = ids
        made = self.merged(new)
        for c, ids in made.items():
            if len(c) <= _LONG:
                if c[0] == " ":
                    recent[c[1:]] = ids
                else:
                    inner[c] = ids
        known |= made
        ids = [known[c] for c in pieces]
        of_words |= zip(fresh, [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)])], strict=True)
        for w, ids in of_words.items():
            if len(w) <= _LONG:
                recent[w] = ids
        return of_words, known

    def decode(self, ids: list[int]) -> bytes:
        return bytes(joined(self.tokens, np.asarray(ids, np.int32))[0])


def joined(values: pa.LargeBinaryArray, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of values[id] for all ids, one after the other, and where each starts, with the end."""
    taken = values.take(pa.array(ids))
    _, starts, data = taken.buffers()
    return memoryview(data or b""), np.frombuffer(starts, np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)


@cache
def codec(path: str, pattern: str) -> Codec:
    """One per task's process; its vocabulary has a fixed size."""
    return Codec(path, pattern)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, and SHA-256 digests of the ids (decimal, joined by commas) and of the bytes decoded from them.

    with_ids adds ids (array of int) and decoded (string). path is where each executor finds the file of ranks; where it isn't given, each looks it up itself.
    Null texts are empty: no token, the digests of nothing. Repeated rows are encoded alone; other columns are not read."""

    def rows(ids: pa.Array, texts: pa.Array) -> dict:
        own = codec(path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN)
        out = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        parts = own.encode_all([x or "" for x in texts.to_pylist()])
        ends = np.cumsum([len(x) // 4 for x in parts]).tolist()
        got = np.frombuffer(b"".join(parts), np.int32)
        (back, back_at), (names, names_at) = joined(own.tokens, got), joined(own.names, got)
        for a, b in zip([0, *ends], ends):
            text = back[back_at[a] : back_at[b]]
            out["n_tokens"].append(b - a)
            out["ids_sha256"].append(hashlib.sha256(names[names_at[a] : max(names_at[a], names_at[b] - 1)]).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
            if with_ids:
                out["ids"].append(got[a:b])
                out["decoded"].append(bytes(text).decode())
        return out | ({"ids": pa.array(out["ids"], pa.list_(pa.int32()))} if with_ids else {})

    return map_texts(df, id_col, text_col, SCHEMA + ", ids array<int>, decoded string" * with_ids, rows, SLICE)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: doc_id, n_tokens and digests of each document that the mix took, as often as it took it."""
    return encode_texts(docs)
