"""Token counts by heap-and-linked-list byte-pair merging.

A piece (pre-token) starts as a linked list of its bytes. A heap holds every adjacent
pair that has a rank, by rank and place; the lowest is popped, its two symbols become one, and
the pairs with both new neighbours are pushed. A popped pair whose symbols have changed since
is skipped. The count of tokens is the number of bytes minus the number of merges; no token
identifiers are kept. Ranks are looked up by the bytes of the merged symbol's two halves.

Cases: a null or empty text has 0 bytes and 0 tokens; a long piece without breaks costs
n log n; repeated rows are counted alike; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed value: how byte-level vocabularies of this family cut a text into pieces
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: fixed values: letters and numbers assigned after Unicode 16, which the vocabulary's library takes as symbols
LATER = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3"
    r"\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191"
    r"\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96"
    r"\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4"
    r"\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
#: pieces whose counts a worker remembers before it starts afresh
REMEMBERED = 400_000
#: longer pieces are counted each time, so the memory of remembered ones is bounded
REMEMBERED_CHARS = 64
TOKEN_LIMIT = 1024


def byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabulary files write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merge ranks of a vocabulary file, and counts of pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        letters = byte_letters()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"])
        self.ranks = {tuple(bytes(letters[c] for c in half) for half in pair): i for i, pair in enumerate(pairs)}
        special = [t["content"] for t in content["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PIECES)
        self.later = regex.compile(f"[{LATER}]")
        letters_then = PIECES.replace(r"[^\s\p{L}\p{N}]", rf"[^\s[\p{{L}}\p{{N}}--[{LATER}]]]").replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{LATER}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{LATER}]]+")
        self.older_pieces = regex.compile("(?V1)" + letters_then)
        self.known: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Number of symbols that are left of ``data`` when no ranked pair is left."""
        n = len(data)
        if n < 2:
            return n
        symbol: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, size = heapq.heappop(heap)
            here = symbol[left]
            right = after[left] if here is not None else n
            if right >= n or len(here) + len(symbol[right]) != size:
                continue  # one of the two has been merged meanwhile
            symbol[left] = here = here + symbol[right]
            symbol[right] = None
            merges += 1
            follower = after[left] = after[right]
            if follower < n:
                before[follower] = left
                if (r := rank((here, symbol[follower]))) is not None:
                    heapq.heappush(heap, (r, left, len(here) + len(symbol[follower])))
            leader = before[left]
            if leader >= 0 and (r := rank((symbol[leader], here))) is not None:
                heapq.heappush(heap, (r, leader, len(symbol[leader]) + len(here)))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string in it is one token."""
        if self.special is None or self.special.search(text) is None:
            return self.count_plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.count_plain, parts))

    def count_plain(self, text: str) -> int:
        known, total = self.known, 0
        for piece in self.pieces.findall(text):
            n = known.get(piece)
            if n is None:
                if self.later.search(piece):  # such a piece is never remembered, so it is always met here
                    return sum(self.merged(p.encode()) for p in self.older_pieces.findall(text))
                n = self.merged(piece.encode())
                if len(piece) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = n
            total += n
        return total


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    """Read once in a worker."""
    return Merges(path)


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabularies keep ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _count(vocabulary: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merges = merges_of(vocabulary if "/" in vocabulary else vocabulary_path(vocabulary))
    for rows in batches:
        texts = rows.column(1).to_pylist()
        tokens = [merges.count(t) if t else 0 for t in texts]
        sizes = [len(t.encode()) if t else 0 for t in texts]
        yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "over_limit": [n > limit for n in tokens]})


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = TOKEN_LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; ``vocabulary``: a byte-level BPE file by its path or installed name."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(partial(_count, vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
