"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat array. A round finds the best-scored adjacent pair of each word (a segmented
minimum), merges its leftmost occurrences at once, and compacts the array; words without a pair leave. Spark deals
the texts out; a task keeps the words it has met, so each distinct word is merged once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellwise.llm.common import chunked, extended, spread_ranges

SPACE = "▁"
NONE = np.int32(2**31 - 1)


class PieceModel:
    """The vocabulary as arrays: symbol of each character, merged symbol and rank of each pair, bytes of each piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        own = {p: i for i, (p, s) in enumerate(zip(pieces, special, strict=True)) if not s}
        if any(SPACE in p.lstrip(SPACE) for p in own):
            raise ValueError("a piece has a space mark after another character: words can't be cut at spaces")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        #: Characters have symbols of their own: the piece's id, or an id from n on.
        extra = sorted({c for p in own for c in p} - own.keys())
        self.first_other = n + len(extra)
        self.char_symbol = np.arange(self.first_other, self.first_other + 0x110000, dtype=np.int32)
        symbols = own | {c: n + i for i, c in enumerate(extra)}
        for piece, i in symbols.items():
            if len(piece) == 1:
                self.char_symbol[ord(piece)] = i
        self.extra = [ord(c) for c in extra]
        self.pieces = n
        scores = {p: model.get_score(i) for p, i in own.items() if len(p) > 1}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        keys, merged, ranks = [], [], []
        for piece, score in scores.items():
            for cut in range(1, len(piece)):
                if (a := symbols.get(piece[:cut])) is not None and (b := symbols.get(piece[cut:])) is not None:
                    keys.append(a << 32 | b)
                    merged.append(own[piece])
                    ranks.append(rank_of[score])
        self._index(np.array(keys, np.uint64), np.array(merged, np.int32), np.array(ranks, np.int32))
        # Runs of spaces share the last rank, so they come last: the leftmost pair of a run, again and again.
        runs = {len(p): i for p, i in own.items() if set(p) == {SPACE}}
        last = len(rank_of) - 1
        alone = all(set(p) == {SPACE} for p, s in scores.items() if rank_of[s] == last)
        self.space, self.run_rank = symbols.get(SPACE, -1), -1
        if alone and 1 in runs and len(runs) > 1:
            whole = {k: self._run(k, runs) for k in range(1, max(runs) + 1)}
            if whole[max(runs)] == [max(runs)]:
                self.run_rank, self.run_ids = last, {k: [runs[x] for x in cut] for k, cut in whole.items()}
        #: Characters inside no longer piece: words are cut around them.
        self.cut_lines = not any("\n" in p for p in scores)
        raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.piece_sizes = np.array([len(r) for r in raw], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_data = np.frombuffer(b"".join(raw), np.uint8)

    @staticmethod
    def _run(spaces: int, known: dict[int, int]) -> list[int]:
        cut = [1] * spaces
        while (at := next((i for i in range(len(cut) - 1) if cut[i] + cut[i + 1] in known), None)) is not None:
            cut[at : at + 2] = [cut[at] + cut[at + 1]]
        return cut

    def _index(self, keys: np.ndarray, merged: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressing table of the pairs."""
        self.bits = max(4, int(len(keys) * 6).bit_length())
        size = 1 << self.bits
        self.slot_keys = np.full(size, 2**64 - 1, np.uint64)
        self.slot_at = np.full(size, -1, np.int32)
        left = np.arange(len(keys))
        place = self._place(keys)
        while len(left):
            free = self.slot_at[place] < 0
            self.slot_at[place[free]] = left[free]  # of several on one place, the last stays
            won = self.slot_at[place] == left
            self.slot_keys[place[won]] = keys[left[won]]
            left, place = left[~won], (place[~won] + 1) % size
        self.merged, self.ranks = np.append(merged, 0), np.append(ranks, NONE)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair in merged and ranks; the last entry there stands for none."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        place = self._place(keys)
        at = self.slot_at[place]
        open_ = np.flatnonzero((at >= 0) & (self.slot_keys[place] != keys))
        while len(open_):
            place[open_] = (place[open_] + 1) % len(self.slot_at)
            at[open_] = self.slot_at[place[open_]]
            open_ = open_[(at[open_] >= 0) & (self.slot_keys[place[open_]] != keys[open_])]
        return at

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the offsets of the words."""
        text = "".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.char_symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        while len(sym):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            of = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(sym)]))
            pair = np.full(len(sym), -1, np.int32)
            same = np.flatnonzero(of[1:] == of[:-1])
            pair[same] = self.pairs(sym[same], sym[same + 1])
            rank = self.ranks[pair]
            best = np.minimum.reduceat(rank, heads)
            if self.run_rank >= 0 and (best == self.run_rank).any():
                sym, word = self._join_runs(sym, word, (best == self.run_rank)[of])
                continue
            if (best == NONE).any():
                out = (best == NONE)[of]
                done_sym.append(sym[out])
                done_word.append(word[out])
                stay = ~out
                sym, word, pair, rank = sym[stay], word[stay], pair[stay], rank[stay]
                if not len(sym):
                    break
                best = best[best != NONE]
                heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                of = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(sym)]))
            hit = np.flatnonzero(rank == best[of])
            # Of overlapping occurrences, every second one of a run from its left.
            at = np.arange(len(hit))
            opens = np.r_[True, hit[1:] != hit[:-1] + 1]
            run = np.maximum.accumulate(np.where(opens, at, 0))
            hit = hit[(at - run) % 2 == 0]
            new = self.merged[pair[hit]]
            # A merge that makes a pair as good as its own or better ends the word's round: that pair comes first.
            chosen = np.full(len(sym) + 2, -1, np.int32)
            chosen[hit] = new
            before = sym[hit - 1]
            joined = (hit >= 2) & (chosen[hit - 2] >= 0) & (of[hit - 2] == of[hit])
            before = np.where(joined, chosen[hit - 2], before)
            has_left = (hit >= 1) & (of[hit - 1] == of[hit])
            after_at = np.minimum(hit + 2, len(sym) - 1)
            has_right = (hit + 2 < len(sym)) & (of[after_at] == of[hit])
            near = np.minimum(
                np.where(has_left, self.ranks[self.pairs(before, new)], NONE),
                np.where(has_right, self.ranks[self.pairs(new, sym[after_at])], NONE),
            )
            ends = near <= best[of[hit]]
            if ends.any():
                limit = np.full(len(heads), len(sym))
                np.minimum.at(limit, of[hit[ends]], hit[ends])
                ok = hit <= limit[of[hit]]
                hit, new = hit[ok], new[ok]
            sym[hit] = new
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int32)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        sym, word = self._to_ids(sym[order], word[order])
        return sym, np.searchsorted(word, np.arange(len(words) + 1))

    def _join_runs(self, sym: np.ndarray, word: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of spaces of the words marked in here, cut into run pieces from the left."""
        longest = max(self.run_ids)
        space = here & (sym == self.space)
        opens = space & ~np.r_[False, space[:-1] & (word[1:] == word[:-1])]
        at = np.arange(len(sym))
        place = at - np.maximum.accumulate(np.where(opens, at, 0))
        heads = np.flatnonzero(space & (place % longest == 0))
        sizes = np.minimum(np.add.reduceat(space.astype(np.int64), heads), longest)
        sym, keep = sym.copy(), ~space
        for size in np.unique(sizes).tolist():
            for j, piece in enumerate(self.run_ids[size]):
                sym[heads[sizes == size] + j] = piece
                keep[heads[sizes == size] + j] = True
        return sym[keep], word[keep]

    def _to_ids(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the pieces of their UTF-8 bytes."""
        odd = np.flatnonzero(sym >= self.pieces)
        if not len(odd):
            return sym, word
        chars = [self.extra[s - self.pieces] if s < self.first_other else s - self.first_other for s in sym[odd].tolist()]
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars]
        times = np.ones(len(sym), np.int64)
        times[odd] = [len(r) for r in raw]
        out = np.repeat(sym, times)
        starts = np.cumsum(times) - times
        where = spread_ranges(starts[odd], times[odd])
        out[where] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.repeat(word, times)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 text of each range of ids; the space that encoding put in front goes."""
        sizes = self.piece_sizes[ids]
        data = self.piece_data[spread_ranges(self.piece_starts[ids], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][offsets]
        data = data.tobytes()
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Encoder:
    """Encodes texts of one task; distinct words are kept up to a bound, then forgotten together."""

    def __init__(self, model: PieceModel, most_words: int = 400_000) -> None:
        self.model, self.most = model, most_words
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if model.cut_lines else f"{SPACE}+[^{SPACE}]*").findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.said: list[str] = []
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids, the offsets of the texts, and each text's ids as decimals joined by commas."""
        cut = [self.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > self.most:
            self._forget()
        new = list(set().union(*cut) - self.known.keys())
        if new:
            ids, offsets = self.model.merge(new)
            self.starts = np.append(self.starts, offsets[:-1] + len(self.ids))
            self.sizes = np.append(self.sizes, np.diff(offsets))
            self.ids = np.append(self.ids, ids)
            told = list(map(str, ids.tolist()))
            ends = offsets.tolist()
            self.said += [",".join(told[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        at = [list(map(self.known.__getitem__, c)) for c in cut]
        said = self.said.__getitem__
        joined = [",".join(map(said, a)) for a in at]
        counts = np.fromiter(map(len, at), np.int64, len(at))
        flat = np.fromiter((x for a in at for x in a), np.int64, int(counts.sum()))
        sizes = self.sizes[flat]
        ids = self.ids[spread_ranges(self.starts[flat], sizes)]
        offsets = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]]
        return ids, offsets, joined


def encode_decode(docs: DataFrame, model_path: str, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """Each text encoded and decoded: keep's columns, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no tokens. with_text also returns ids (array) and decoded. Every row of docs gives a
    row, so repeated rows repeat; an empty table gives none; columns outside keep are not carried. The model
    (a vocabulary file of fixed size) is read on the driver and sent with the tasks.
    """
    keep = ["doc_id"] if keep is None else keep
    broadcast = docs.sparkSession.sparkContext.broadcast(PieceModel(model_path))
    rows = docs.select(*keep, docs["text"].alias("_text"))
    extra = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    extra += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_text else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(broadcast.value)
        for part in chunked(batches, 1 << 21):
            texts = [t or "" for t in part.column("_text").to_pylist()]
            ids, offsets, joined = encoder(texts)
            decoded = encoder.model.decode(ids, offsets)
            columns = [
                pa.array(np.diff(offsets)),
                pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            ]
            if with_text:
                columns += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array([d.decode() for d in decoded], pa.string())]
            out = part.select(keep)
            for (name, kind), column in zip(extra, columns, strict=True):
                out = out.append_column(pa.field(name, kind), column)
            yield from out.combine_chunks().to_batches()

    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_text
    return rows.mapInArrow(run, extended(rows.select(*keep), ddl))
