"""Token counts by byte-pair merging with a heap and a linked list; no token identifier is made."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Of a vocabulary file, which is sent to every task.
MOST_FILE_BYTES = 64 << 20
#: Fixed value: the split of byte-level vocabularies into pieces that are merged on their own.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MEMO_PIECES, _MEMO_CHARS = 200_000, 40


def _byte_of_char() -> dict[str, int]:
    """Byte-level files write a printable byte as itself and the others, in order, from code point 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[tuple[bytes, bytes], int], list[str]]:
    """Ranks of the merges and the special strings of a byte-level ``tokenizers`` file."""
    with open(path, "rb") as f:
        raw = f.read(MOST_FILE_BYTES + 1)
    if len(raw) > MOST_FILE_BYTES:
        raise ValueError(f"{path} has more than {MOST_FILE_BYTES} bytes")
    file = json.loads(raw)
    pre, model, added = file.get("pre_tokenizer") or {}, file["model"], file.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    odd = any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain or odd or file.get("normalizer") or model["type"] != "BPE" or model.get("ignore_merges"):
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    byte_of = _byte_of_char()
    symbol = lambda s: bytes(byte_of[c] for c in s)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return {(symbol(a), symbol(b)): rank for rank, (a, b) in enumerate(pairs)}, [t["content"] for t in added]


def merged_length(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols left of ``piece``: its bytes less the merges, lowest rank first and leftmost among equals."""
    symbols: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # an entry is stale once either symbol has changed; its pair then has another rank or none
        if symbols[i] is None or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i], symbols[j] = symbols[i] + symbols[j], None
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return left


class _Lengths(dict):
    """Symbols by piece; short pieces are remembered, up to a fixed number of them."""

    def __init__(self, ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        n = merged_length(piece.encode(), self.ranks)
        if len(piece) <= _MEMO_CHARS:
            if len(self) >= _MEMO_PIECES:
                self.clear()
            self[piece] = n
        return n


def counter(ranks: dict[tuple[bytes, bytes], int], special: list[str]):
    """A function from a text to its number of tokens."""
    pieces, lengths = regex.compile(PIECES), _Lengths(ranks)
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(text: str) -> int:
        parts = cut.split(text) if cut else [text]
        return len(parts) - 1 + sum(sum(map(lengths.__getitem__, pieces.findall(part))) for part in parts)

    return count


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row, in one pass without a shuffle.

    Rows stand for themselves: repeated and null ids give a row each, further columns are not read.
    A null text counts as empty: no bytes, no tokens. A special string inside a text is one token. The heap keeps
    a piece without any break at n log n, so long texts need no cut. An empty table gives no rows.
    """
    ranks, special = read_vocabulary(vocabulary)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((ranks, special))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*sent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    counted = slim.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)
