"""SentencePiece encoding and decoding with N-best segmentation.

A text, with spaces shown as U+2581 and one before it, is a lattice: each vocabulary piece that matches at a place is an edge
with the piece's score; a character that no piece covers is one edge of its UTF-8 byte pieces. The forward Viterbi scores
are the exact cost of the best way back to the start, so an A-star search from the end takes out whole segmentations in order
of score and expands no state that is not on one of them. Pieces never reach over certain pairs of characters (no piece
holds the pair), so the lattice falls into independent parts there, each searched once and remembered; the N best of a text
are merged from the parts' own N best by the same kind of search.

The N best differ from the best in at most N - 1 of the parts with the smallest loss of a second-best way, so only those are
searched beyond the best. Scores are sums of the model's piece scores; equal scores rank by the earlier change in the text.

Defined results: a null or empty text has no pieces, score 0 and one segmentation; a text with fewer than N segmentations
returns all it has; a U+2581 in the text itself is spelled in bytes, so decoding gives the very text back; a null id is kept;
repeated rows are encoded one by one; an empty table gives an empty result; other columns are not read unless asked for.
"""

from __future__ import annotations

import gc
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, coded, memory, slices, tidied

SPACE = "▁"
#: Stands for a U+2581 of the text itself; a lone surrogate, so no text holds it.
OWN = "\udc81"
N_BEST = 4
#: What a character spelled in bytes loses against the worst piece.
UNKNOWN = 10.0
#: Bytes of each generation of remembered chunks; parts and N-best ways have a quarter of it.
REMEMBERED = 96 << 20


class Pieces:
    """A model's pieces as a lattice vocabulary."""

    def __init__(self, path: str, most: int = REMEMBERED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_ids = [0] * 256
        size = model.get_piece_size()
        spelled: list[bytes] = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece], self.id[piece] = model.get_score(i), i
                spelled[i] = piece.replace(SPACE, " ").encode()
        #: Pieces by their characters: a node for each beginning of a piece, under "" the score of the piece that ends there.
        self.begun: dict = {}
        for piece, score in self.score.items():
            node = self.begun
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.longest = max(map(len, self.score))
        self.pairs = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.unknown = min(s for s in self.score.values() if s > -1e6) - UNKNOWN
        self.kind, self.code = (np.uint16, "H") if size <= 1 << 16 else (np.uint32, "I")
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        #: Ids, score and the loss of a second-best way: of a chunk between spaces, and of a part of a chunk that has several.
        self.chunks = Recent(self._chunk, most=most)
        self.parts = Recent(self._part, most=most // 4)
        self.ways: dict[int, Recent] = {}

    def spell(self, piece: str) -> list[int]:
        """Ids of an edge: a piece, or a character's bytes. OWN marks a U+2581 of the text."""
        if piece in self.id:
            return [self.id[piece]]
        return [self.byte_ids[b] for b in (SPACE if piece == OWN else piece).encode("utf-8", "surrogatepass")]

    def forward(self, part: str, n_best: int) -> tuple[list[float], list[list[tuple[int, float]]]]:
        """Best score up to each place, and the edges into it as (from, score): the N best, for no other is on one of the N
        best ways."""
        n, score = len(part), self.score
        best, edges = [float("-inf")] * (n + 1), [[] for _ in range(n + 1)]
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            edges[i] = heapq.nlargest(n_best, edges[i], key=lambda e: best[e[0]] + e[1])
            if part[i] not in score:
                edges[i + 1].append((i, self.unknown))
                if here + self.unknown > best[i + 1]:
                    best[i + 1] = here + self.unknown
            for j in range(i + 1, min(n, i + self.longest) + 1):
                s = score.get(part[i:j])
                if s is not None:
                    edges[j].append((i, s))
                    if here + s > best[j]:
                        best[j] = here + s
        edges[n] = heapq.nlargest(n_best, edges[n], key=lambda e: best[e[0]] + e[1])
        return best, edges

    def search(self, part: str, n_best: int) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a part as (score, ids), by A-star from its end.

        Of equal scores the state nearest to the start goes first, so ties are not searched side by side. States of one place
        come out by their score so far; beyond the first N none is on one of the N best ways, so a run of one character, whose
        segmentations nearly all tie, takes at most N steps a place."""
        best, edges = self.forward(part, n_best)
        heap, pushed, out, taken = [(-best[-1], len(part), 0, 0.0, None)], 0, [], [0] * (len(part) + 1)
        while heap and len(out) < n_best:
            _, at, _, done, way = heapq.heappop(heap)
            taken[at] += 1
            if taken[at] > n_best:
                continue
            if not at:
                ids: list[int] = []
                while way:
                    a, b, way = way
                    ids += self.spell(part[a:b])
                out.append((done, ids))
                continue
            for i, s in edges[at]:
                pushed += 1
                heapq.heappush(heap, (-(done + s + best[i]), i, pushed, done + s, (i, at, way)))
        return out

    def _part(self, part: str) -> tuple[bytes, float, float]:
        """Ids and score of the best segmentation, and what the second best loses against it."""
        begun, unknown, n = self.begun, self.unknown, len(part)
        # Best and second-best score into each place over the edges there, with the best edge's start.
        best, other, back = [-1e300] * (n + 1), [-1e300] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, j = best[i], i + 1
            node = begun.get(part[i])
            s = here + (unknown if node is None else node.get("", unknown))
            if s > best[j]:
                other[j], best[j], back[j] = best[j], s, i
            elif s > other[j]:
                other[j] = s
            while node is not None and j < n:
                node = node.get(part[j])
                j += 1
                if node is not None and "" in node:
                    s = here + node[""]
                    if s > best[j]:
                        other[j], best[j], back[j] = best[j], s, i
                    elif s > other[j]:
                        other[j] = s
        at, loss, ids = n, 1e300, []
        while at:  # the second best leaves the best way for the last time at one of its places
            loss = min(loss, best[at] - other[at])
            piece = part[back[at] : at]
            ids += [self.id[piece]] if piece in self.id else self.spell(piece)[::-1]
            at = back[at]
        return array(self.code, ids[::-1]).tobytes(), best[-1], loss if loss < 1e290 else float("inf")

    def cut(self, text: str) -> list[str]:
        """Parts of a text at the pairs that no piece holds."""
        held = list(map(self.pairs.__contains__, map(add, text, text[1:])))
        if all(held):
            return [text]
        cuts = [k for k, one in enumerate(held, 1) if not one]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    @staticmethod
    def _shown(chunk: str) -> str:
        return SPACE + (chunk if chunk.isascii() and " " not in chunk else chunk.replace(SPACE, OWN).replace(" ", SPACE))

    def _chunk(self, chunk: str) -> tuple[bytes, float, float]:
        parts = self.cut(self._shown(chunk))
        if len(parts) == 1:
            return self._part(parts[0])
        known = [self.parts[p] for p in parts]
        return b"".join(k[0] for k in known), sum(k[1] for k in known), min(k[2] for k in known)

    def encode_all(self, texts: pa.Array, n_best: int = 1) -> Iterator[tuple[np.ndarray, list[tuple[float, np.ndarray]]]]:
        """For every text its best ids, and its N best segmentations as (score, ids)."""
        if pc.any(pc.match_substring(texts, "  ")).as_py():
            # Pieces of several spaces reach over a single one: a run of spaces stays with what follows it.
            lists = pa.array([[c[1:] for c in re.findall(" +[^ ]*", " " + t)] for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(texts, " ")
        chunks, codes, starts = coded(lists)
        # What is learnt are plain tuples without cycles; the collector would walk all of them again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            known = list(map(self.chunks.__getitem__, chunks))
        finally:
            if collecting:
                gc.enable()
        score, loss = (np.array([k[c] for k in known], np.float64) for c in (1, 2))
        lengths = np.fromiter((len(k[0]) for k in known), np.int64, len(known)) // np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(k[0] for k in known), self.kind)
        ids, ends = ragged(flat, lengths, codes)
        bounds = np.concatenate([[0], ends])
        for t, text in enumerate(texts):
            a, b = starts[t], starts[t + 1]
            if not len(text.as_py()):  # an empty text has no pieces, not even the leading space
                yield ids[:0], [(0.0, ids[:0])]
                continue
            own = ids[bounds[a] : bounds[b]]
            best = float(score[codes[a:b]].sum())
            found = [(best, own)]
            if n_best > 1:
                mine = loss[codes[a:b]]
                most = np.partition(mine, n_best - 2)[n_best - 2] if len(mine) >= n_best else np.inf
                near = np.flatnonzero(mine <= most)
                near = near[np.argsort(mine[near], kind="stable")[: n_best - 1]]
                near = np.sort(near[np.isfinite(mine[near])])
                found = self._merge(best, own, [(int(bounds[a + k] - bounds[a]), int(bounds[a + k + 1] - bounds[a]), chunks[codes[a + k]]) for k in near], n_best)
            yield own, found

    def _ways(self, chunk: str, n_best: int) -> list[tuple[float, np.ndarray]]:
        """The N best ways of a chunk: (loss against the best, ids)."""
        ways: list[tuple[float, list[int]]] = [(0.0, [])]
        for part in self.cut(self._shown(chunk)):
            found = self.search(part, n_best)
            ways = sorted(((w[0] + found[0][0] - f[0], w[1] + f[1]) for w in ways for f in found), key=lambda w: w[0])[:n_best]
        return [(w[0], np.array(w[1], self.kind)) for w in ways]

    def _merge(self, best: float, own: np.ndarray, near: list[tuple[int, int, str]], n_best: int) -> list[tuple[float, np.ndarray]]:
        """The N best of a whole text, from the ways of the chunks (begin, end, chunk) that can matter, by least loss."""
        known = self.ways.setdefault(n_best, Recent(lambda c: self._ways(c, n_best), 200 * n_best, self.parts.most))
        ways = [known[c] for _, _, c in near]
        heap, seen, out = [(0.0, (0,) * len(ways))], {(0,) * len(ways)}, []
        while heap and len(out) < n_best:
            loss, pick = heapq.heappop(heap)
            cuts, at = [], 0
            for (a, b, _), w, k in zip(near, ways, pick, strict=True):
                if k:
                    cuts += [own[at:a], w[k][1]]
                    at = b
            out.append((best - loss, np.concatenate([*cuts, own[at:]]) if cuts else own))
            for k in range(len(ways)):
                nxt = (*pick[:k], pick[k] + 1, *pick[k + 1 :])
                if nxt[k] < len(ways[k]) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (sum(w[i][0] for w, i in zip(ways, nxt, strict=True)), nxt))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text that ids spell, without the space put before it."""
        out, _ = ragged(self.flat, self.lengths, ids.astype(np.int64))
        return out.tobytes()[1:]


def ragged(flat: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged table (stored one after another) in the order asked for, and the end of each in the result."""
    begins = np.cumsum(lengths) - lengths
    n = lengths[rows]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.arange(total, dtype=kind)
    at += np.repeat((begins[rows] - ends + n).astype(kind), n)
    return flat[at], ends


def model(path: str, most: int = REMEMBERED) -> Pieces:
    return memory("pieces", path, most, make=lambda: Pieces(path, most))


def _encoder(path: str, n_best: int, keep_ids: bool, most: int = REMEMBERED):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path, most)
        for batch in (part for whole in rows for part in slices(whole, "__text", (8 if most >= REMEMBERED else 4) << 20)):
            texts = pc.fill_null(batch.column("__text").cast(pa.string()), "")
            cols: dict[str, list] = {n: [] for n in ("ids", "n_tokens", "score", "nbest_scores", "nbest_crc32", "round_trip")}
            for text, (ids, found) in zip(texts, pieces.encode_all(texts, n_best), strict=True):
                cols["n_tokens"].append(len(ids))
                cols["score"].append(found[0][0])
                cols["nbest_scores"].append([s for s, _ in found])
                cols["nbest_crc32"].append([zlib.crc32(x.astype("<u4").tobytes()) for _, x in found])
                cols["round_trip"].append(pieces.decode(ids) == text.as_py().encode())
                if keep_ids:
                    cols["ids"].append(ids.astype(np.int32))
            kept = [n for n in batch.schema.names if n != "__text"]
            types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "score": pa.float64(), "nbest_scores": pa.list_(pa.float64()), "nbest_crc32": pa.list_(pa.int64()), "round_trip": pa.bool_()}
            made = [n for n in cols if keep_ids or n != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(cols[n], types[n]) for n in made)], names=[*kept, *made])

    return run


def encoded(docs: DataFrame, path: str, n_best: int = N_BEST, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), keep_ids: bool = True, remember: bool = True) -> DataFrame:
    """Each row's carried columns with ids (of the best segmentation), n_tokens, score, nbest_scores, nbest_crc32 and
    round_trip: whether decoding the ids gave the text back. Workers remember parts from task to task unless told not to,
    and then less within a task, which takes a third of the memory and more time."""
    rows = docs.select(*carry, F.col(text_col).cast("string").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text"]
    made = ["ids array<int>"] * keep_ids + ["n_tokens long", "score double", "nbest_scores array<double>", "nbest_crc32 array<long>", "round_trip boolean"]
    return rows.mapInArrow(tidied(_encoder(path, n_best, keep_ids, REMEMBERED if remember else REMEMBERED // 3), remember), ", ".join([*fields, *made]))


def default_model(spark: SparkSession) -> str:
    import public_tokenizers

    return spark.conf.get("dcbspark.tokenizer.pieces", None) or public_tokenizers.path("piece_bpe_32k.model")
