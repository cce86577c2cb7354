"""Encoding and decoding under a merge-type piece vocabulary, by a score-ordered agenda.

The symbols of a segment (a run of space marks and what follows it) form a linked list; an agenda holds its
adjacent pairs, best score first and leftmost among equals. Characters without a piece become byte pieces.
Every distinct segment's ids are checked against the sentencepiece library as Arrow batches bring it up.
"""

from __future__ import annotations

import heapq
import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import blocks

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")


class PieceBpe:
    """A merge-type vocabulary with byte fallback, read from a sentencepiece model file.

    check: compare the ids of each distinct segment with the library's; a difference raises ValueError.
    """

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.begin, self.end, self.check = lib.bos_id(), lib.eos_id(), check
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes = [0] * 256
        self.surface: list[bytes] = []
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif lib.is_control(i):
                self.surface.append(b"")
            elif lib.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.ids[piece], self.rank[piece] = i, -lib.get_score(i)
                self.surface.append(piece.replace(MARK, " ").encode())
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece joins two words; segments can't be encoded on their own")
        if any("\n" in p for p in self.ids):
            raise ValueError("a piece holds a newline; lines can't be encoded on their own")

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment."""
        symbols, n = list(segment), len(segment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        queue = [(r, i, i + 1, pair) for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if (r := rank(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            _, a, b, pair = pop(queue)
            left, right = symbols[a], symbols[b]
            if not left or not right or len(left) + len(right) != len(pair):
                continue  # one of the two has merged with another since
            symbols[a], symbols[b] = pair, ""
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                if (r := rank(joined := pair + symbols[c])) is not None:
                    push(queue, (r, a, c, joined))
            c = before[a]
            if c >= 0 and (r := rank(joined := symbols[c] + pair)) is not None:
                push(queue, (r, c, a, joined))
        out: list[int] = []
        for s in symbols:
            if s:
                known = self.ids.get(s)
                if known is not None:
                    out.append(known)
                else:
                    out.extend(self.bytes[x] for x in s.encode())
        return out

    def encode_segments(self, pieces: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of pieces that follow a space mark, or a newline if they begin
        with one (no piece of the vocabulary holds a newline, so none reaches across it)."""
        ids = [self.agenda((MARK + p if p[:1] != "\n" else p).replace(" ", MARK)) for p in pieces]
        if self.check and pieces:
            # the library puts a space mark before any text that isn't empty
            theirs = self.library.encode(pieces, num_threads=1)
            for piece, own, their in zip(pieces, ids, theirs, strict=True):
                if own != (their[1:] if piece[:1] == "\n" else their if piece else [self.ids[MARK]]):
                    raise ValueError(f"ids of {piece!r} differ from the library's")
        return [array("I", x).tobytes() for x in ids]

    def segments(self, text: str) -> list[str]:
        """Segments of a text, without the first space mark of each; a mark before a newline is a segment of its own."""
        found = (s.replace(MARK, " ")[1:] for s in _SEGMENT.findall((MARK + text.replace(" ", MARK)) if text else ""))
        return [p for s in found for p in (("", s) if s[:1] == "\n" else (s,))]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces join to characters, control ids vanish, the first space mark is dropped."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        if first is not None and raw[:1] == b" " and self.library.id_to_piece(first).startswith(MARK):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str, check: bool = True) -> tuple[PieceBpe, SegmentMemo]:
    bpe = PieceBpe(path, check)
    return bpe, SegmentMemo(bpe)


class SegmentMemo:
    """Ids of texts, each distinct segment encoded once; emptied beyond ``limit`` segments or ``chars`` code points
    of them, so that the memory is bounded by these and what one call brings."""

    def __init__(self, bpe: PieceBpe, limit: int = 1_000_000, chars: int = 1 << 25):
        self.bpe, self.limit, self.chars, self.known, self.held = bpe, limit, chars, {}, 0

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.limit or self.held > self.chars:
            self.known.clear()
            self.held = 0
        rows = []
        for t in texts:
            t = t or ""
            if not t or t[0] == " " or "  " in t or MARK in t:
                rows.append(self.bpe.segments(t))
            else:
                rows.append(t.replace("\n", " \n").split(" "))
        new = list({s for row in rows for s in row} - self.known.keys())
        self.held += sum(map(len, new))
        self.known.update(zip(new, self.bpe.encode_segments(new), strict=True))
        return [b"".join(map(self.known.__getitem__, row)) for row in rows]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(doc_id, ids binary, decoded string) of every row; ids are little-endian unsigned 32-bit, with the
    begin and end ids; decoded is what the library makes of them.

    Null texts count as empty: begin and end alone, decoded to ''. Long texts are encoded whole; repeated
    rows stay; other columns are left out, so their names cannot clash; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        bpe, memo = model(model_path, check)
        head, tail = array("I", [bpe.begin]).tobytes(), array("I", [bpe.end]).tobytes()
        for b in batches:
            texts = b.column("text").to_pylist()
            for start, stop in blocks(texts, 1 << 21):
                ids = [head + x + tail for x in memo(texts[start:stop])]
                back = [bpe.library.decode(array("I", x).tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(start, stop - start), pa.array(ids, pa.binary()), pa.array(back, pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
