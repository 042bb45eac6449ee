"""SentencePiece encoding with seeded merge-dropout, and decoding.

Words (runs of ``▁`` and what follows) are segmented by merges: the agenda holds every pair of neighbouring
symbols whose concatenation is a piece, best score first, then leftmost. Each candidate that comes up
is skipped with probability ``dropout``, decided by a keyed hash of (seed, document, place of the word,
place in the word, piece): every occurrence is cut by draws of its own, and the same seed always gives
the same segmentation. A worker remembers, from task to task, for each word the candidates that come up when given ones are
skipped, and the outcome: an occurrence follows its draws through what is known, and only where they
lead to skips not met twice before it is merged by itself. Long words are merged at every occurrence.
Without dropout the result is that of the library itself.

Characters that are no piece become byte pieces, and so does a literal ``▁``, which else would read as a
blank: decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termscan.llm.common import mix64, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 20261201
#: Segmentations a task remembers before it starts again, and words before it forgets those without any: there is
#: one worker per core, and with other stages' memory all of them share an executor.
CACHE = 300_000
#: Name under which a worker process keeps them between its tasks.
MEMORY = "_subword_segmentations"
#: Symbols up to which a word's segmentations are remembered, and occurrences looked at together.
SHORT, TOGETHER = 24, 1 << 18
#: Symbols of a word that is merged together with others; longer words are merged one by one.
WIDE = 48
_MARK = "▁"
_WORDS = re.compile(f"{_MARK}+[^{_MARK}]*|[^{_MARK}]+")
_MASK = (1 << 64) - 1
_FAR = np.int32(1 << 30)
_GONE = np.int64(-2)


def _gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` in another order, and their lengths."""
    start, count = start[order], count[order]
    total = np.cumsum(count)
    return flat[np.repeat(start - total + count, count) + np.arange(total[-1] if len(total) else 0)], count


class Pieces:
    """A merge vocabulary, read from a model's bytes, and the segmentations worked out with it so far."""

    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = SEED):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        own = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        name = {lib.id_to_piece(i): i for i in own}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b""] * n
        for i in own:
            self.raw[i] = lib.id_to_piece(i).replace(_MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])
        # symbols: pieces, and after them the characters that only stand within pieces
        self.n_pieces = n
        letters = {c for p in name for c in p}
        symbol = name | {c: n + k for k, c in enumerate(sorted(letters - set(name)))}
        self.of_char = np.full(0x110000, -1, np.int64)
        for c in letters:
            self.of_char[ord(c)] = symbol[c]
        order = {i: k for k, i in enumerate(sorted(own, key=lambda i: -lib.get_score(i)))}
        pairs = {
            (symbol[p[:k]] << 20) + symbol[p[k:]]: (order[i], i)
            for p, i in name.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol
        }
        self.pair = np.array(sorted(pairs), np.int64)
        rank, piece = (np.array([pairs[k][x] for k in self.pair.tolist()], np.int64) for x in (0, 1))
        # the agenda's order of all pairs: by score, then by symbols
        order = np.lexsort((np.arange(len(rank)), rank))
        self.pair_rank = np.empty(len(rank), np.int32)
        self.pair_rank[order] = np.arange(len(rank))
        self.piece_at = piece[order]
        self.limit = np.uint64(min(int(dropout * (1 << 64)), _MASK))
        self.seed = mix64(np.array([(seed * 2 + 1) & _MASK], np.uint64))[0]
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.words: list[str] = []
        self.root, self.size = np.full(1024, -1, np.int64), np.empty(0, np.int64)
        # nodes: a word, the skips that lead there (by the slot above), its pieces, its accepted candidates
        self.nodes = 0
        self.word, self.above, self.start, self.count, self.first, self.choices = np.zeros((6, 1024), np.int64)
        self.pool, self.used = np.empty(1 << 16, np.int32), 0
        # slots: one per node and accepted candidate; the node that skipping it leads to
        self.slots = 0
        self.candidate, self.owner, self.child = np.zeros((3, 1024), np.int64)

    def _forget_single(self) -> None:
        """Forgets the words that have no segmentation to remember, most of all words."""
        kept = np.flatnonzero(self.root[: len(self.words)] >= 0)
        number = np.full(len(self.words), -1, np.int64)
        number[kept] = np.arange(len(kept))
        self.words = [self.words[k] for k in kept.tolist()]
        self.index = {word: k for k, word in enumerate(self.words)}
        self.root, self.size = self.root[kept], self.size[kept]
        self.word[: self.nodes] = number[self.word[: self.nodes]]

    @staticmethod
    def _room(table: np.ndarray, size: int) -> np.ndarray:
        return table if size <= len(table) else np.concatenate([table, np.empty(max(size - len(table), len(table)), table.dtype)])

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of the piece that two neighbours make in the agenda, above ``_FAR`` if there is none."""
        key = np.where((left < 0) | (right < 0), -1, (left << 20) + right)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], _FAR)

    def _skipped(self, key: np.ndarray, candidate: np.ndarray) -> np.ndarray:
        """Whether a candidate that comes up at an occurrence is dropped."""
        return mix64(key ^ (candidate.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) < self.limit

    def _merged(self, words: list[str], key: np.ndarray | None, skips: np.ndarray) -> tuple[np.ndarray, ...]:
        """Agenda processing of many words at once, all of one length: each step takes every word's best candidate.

        Skipped is what the occurrences' keys drop, or without keys the candidates in each row of
        ``skips``. Returned are the ids of all words in a row and their numbers, and without keys the accepted
        candidates with their words' numbers, by word.
        """
        taken: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2]
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, numbers of their ids, ids
        width = chars.shape[1]
        # a symbol stands at its first character's place; a merge only relinks its neighbours
        sym = np.full((len(words), width + 1), _GONE)
        sym[:, :width] = self.of_char[chars]
        after = np.broadcast_to(np.arange(1, width + 2), sym.shape).copy()
        before = np.broadcast_to(np.arange(-1, width), sym.shape).copy()
        rank = np.full((len(words), width), _FAR, np.int32)
        rank[:, :-1] = self._ranked(sym[:, : width - 1], sym[:, 1:width])
        row = np.arange(len(words))
        while len(row):
            best = rank.argmin(axis=1)
            each = np.arange(len(row))
            found = rank[each, best]
            over = found >= _FAR
            if over.any():
                ended, who = sym[over, :width], row[over]
                spelt = ((ended == -1) | (ended >= self.n_pieces)).any(axis=1)
                for k, symbols in zip(who[spelt].tolist(), ended[spelt].tolist(), strict=True):
                    ids = [x for i, y in enumerate(symbols) if y != _GONE for x in (
                        [y] if 0 <= y < self.n_pieces else [self.bytes[b] for b in words[k][i].encode()])]
                    done.append((np.array([k]), np.array([len(ids)]), np.array(ids, np.int32)))
                stays = (ended != _GONE) & ~spelt[:, None]
                done.append((who[~spelt], stays.sum(axis=1)[~spelt], ended[stays].astype(np.int32)))
                go = ~over
                if not go.any():
                    break
                sym, after, before, rank, row = sym[go], after[go], before[go], rank[go], row[go]
                best, found = best[go], found[go]
                each = np.arange(len(row))
            piece = self.piece_at[found]
            candidate = (best << 20) + piece
            skip = self._skipped(key[row], candidate) if key is not None else (skips[row] == candidate[:, None]).any(axis=1)
            if key is None:
                taken.append((row[~skip], candidate[~skip]))
            rank[each[skip], best[skip]] = _FAR
            go = np.flatnonzero(~skip)
            if not len(go):
                continue
            at = best[go]
            gone = after[go, at]
            next_ = after[go, gone]
            sym[go, at], sym[go, gone] = piece[~skip], _GONE
            after[go, at], before[go, np.minimum(next_, width)] = next_, at
            rank[go, gone] = _FAR
            # the two pairs that the new symbol is part of
            inner = next_ < width
            rank[go, at] = _FAR
            rank[go[inner], at[inner]] = self._ranked(sym[go[inner], at[inner]], sym[go[inner], next_[inner]])
            prev = before[go, at]
            inner = prev >= 0
            rank[go[inner], prev[inner]] = self._ranked(sym[go[inner], prev[inner]], sym[go[inner], at[inner]])
        rows, candidates = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.argsort(rows, kind="stable")
        who, counts, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        return *_gathered(flat, np.cumsum(counts) - counts, counts, np.argsort(who)), rows[order], candidates[order]

    def _add(self, words: np.ndarray, above: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
        """New nodes: of words, under the skips that the slots ``above`` (-1: none) stand for, or that the keys drop."""
        node = self.nodes + np.arange(len(words))
        self.nodes += len(words)
        for name in ("word", "above", "start", "count", "first", "choices"):
            setattr(self, name, self._room(getattr(self, name), self.nodes))
        self.word[node], self.above[node], self.choices[node] = words, above, 0
        names = [self.words[k] for k in words.tolist()]
        skips = {}  # of the nodes that have any
        for k in np.flatnonzero(above >= 0).tolist():
            slot, own = int(above[k]), skips.setdefault(k, [])
            while slot >= 0:
                own.append(int(self.candidate[slot]))
                slot = int(self.above[self.owner[slot]])
        deep = max(map(len, skips.values()), default=1)
        length = np.array([len(w) for w in names])
        for n in np.unique(length).tolist():
            same = np.flatnonzero(length == n)
            step = max(1, (1 << 16) // max(1, n)) if n <= WIDE else 1
            for at in range(0, len(same), step):
                some = same[at : at + step]
                if n:
                    table = np.full((len(some), deep), -1, np.int64)
                    for k, which in enumerate(some.tolist() if skips else ()):
                        own = skips.get(which, ())
                        table[k, : len(own)] = own
                    flat, counts, rows, candidates = self._merged([names[k] for k in some.tolist()], None if key is None else key[some], table)
                else:  # a literal mark
                    mark = [self.bytes[b] for b in _MARK.encode()]
                    flat, counts = np.array(mark * len(some), np.int32), np.full(len(some), len(mark))
                    rows, candidates = (np.empty(0, np.int64),) * 2
                self.pool = self._room(self.pool, self.used + len(flat))
                self.pool[self.used : self.used + len(flat)] = flat
                self.start[node[some]] = self.used + np.cumsum(counts) - counts
                self.count[node[some]] = counts
                self.used += len(flat)
                if key is None and self.limit:
                    slot = self.slots + np.arange(len(rows))
                    self.slots += len(rows)
                    for name in ("candidate", "owner", "child"):
                        setattr(self, name, self._room(getattr(self, name), self.slots))
                    self.candidate[slot], self.owner[slot], self.child[slot] = candidates, node[some][rows], -1
                    choices = np.bincount(rows, minlength=len(some))
                    self.first[node[some]], self.choices[node[some]] = slot[0] + np.cumsum(choices) - choices if len(slot) else 0, choices
        return node

    def _followed(self, node: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The node that each occurrence's draws lead to from its word's first node."""
        active = np.arange(len(node))
        while len(active):
            n = self.choices[node[active]]
            total = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            slot = np.repeat(self.first[node[active]] - total[:-1], n) + np.arange(total[-1])
            who = np.repeat(np.arange(len(active)), n)
            at = np.flatnonzero(self._skipped(key[active][who], self.candidate[slot]))
            # the first accepted candidate that the draws drop
            at = at[np.concatenate([[True], who[at][1:] != who[at][:-1]])] if len(at) else at
            active, slot = active[who[at]], slot[at]
            new = self._again(self.child, slot)
            if len(new):
                made = self._add(self.word[self.owner[new]], new)
                self.child[new] = made
            node[active] = self.child[slot]
            active = active[node[active] >= 0]
        return node

    @staticmethod
    def _again(table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the places that lead to no node yet, those met a second time; the others are marked by -2."""
        new, times = np.unique(at[table[at] < 0], return_counts=True)
        more = (times > 1) | (table[new] == -2)
        table[new[~more]] = -2
        return new[more]

    def encode_all(self, texts: list[str], names: list[int]) -> list[np.ndarray]:
        """The ids of each text; a name stands for the document in the draws."""
        if max(self.nodes, self.slots // 4) > CACHE:
            self._forget()
        elif len(self.index) > CACHE:
            self._forget_single()
        index, known, codes, ends = self.index, self.words, [], []
        get = index.get
        for text in texts:
            # the blank before the first word is the library's; a literal mark is one word of bytes
            for k, stretch in enumerate(text.split(_MARK)):
                found = _WORDS.findall((_MARK if not k and text else "") + stretch.replace(" ", _MARK))
                if k:
                    found.insert(0, "")
                seen = list(map(get, found))
                if None in seen:
                    for word in found:
                        if word not in index:
                            index[word] = len(known)
                            known.append(word)
                    seen = list(map(get, found))
                codes += seen
            ends.append(len(codes))
        code = np.array(codes, np.int64)
        ends = np.array(ends, np.int64)
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        number = np.repeat(np.array([n & _MASK for n in names], np.uint64), ends - begin)
        place = (np.arange(len(code)) - np.repeat(begin, ends - begin)).astype(np.uint64)
        key = mix64(place + mix64(number ^ self.seed))
        if len(known) > len(self.root):
            self.root = np.concatenate([self.root, np.full(len(known), -1, np.int64)])
        self.size = np.concatenate([self.size, np.array([len(word) for word in known[len(self.size) :]], np.int64)])
        short = self.size[code] <= SHORT if self.limit else np.ones(len(code), bool)
        new = self._again(self.root, code[short]) if self.limit else np.unique(code[self.root[code] < 0])
        if len(new):
            made = self._add(new, np.full(len(new), -1))
            self.root[new] = made
        node = self.root[code]
        for at in range(0, len(code) if self.limit else 0, TOGETHER):
            some = at + np.flatnonzero(short[at : at + TOGETHER] & (node[at : at + TOGETHER] >= 0))
            node[some] = self._followed(node[some], key[some])
        nodes, used = self.nodes, self.used
        rest = np.flatnonzero(~short | (node < 0))
        if len(rest):
            node[rest] = self._add(code[rest], np.full(len(rest), -1), key[rest])
        count = self.count[node]
        total = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        flat = self.pool[np.repeat(self.start[node] - total[:-1], count) + np.arange(total[-1])]
        self.nodes, self.used = nodes, used  # what was merged for one occurrence is not remembered
        return np.split(flat, total[ends[:-1]]) if len(ends) else []

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode()


def _remembered(model: bytes, settings: tuple) -> tuple[tuple, Pieces]:
    """What this worker process worked out in earlier tasks with the same model and settings, if anything.

    It is taken out meanwhile, so that a task that breaks off leaves nothing half done behind. Draws are keyed by
    occurrence, so what is remembered changes no result.
    """
    key = (hashlib.sha256(model).digest(), *settings)
    memory = sys.modules.setdefault(MEMORY, types.ModuleType(MEMORY))
    kept = vars(memory).pop("kept", None)
    return key, kept[1] if kept and kept[0] == key else Pieces(model, *settings)


def _encoded(shared, settings):
    def run(batches):
        key, pieces = _remembered(shared.value, settings)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = pieces.encode_all(texts, [n or 0 for n in batch.column(0).to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            exact = [pieces.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
            flat = np.concatenate([np.empty(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k) for k in range(2, batch.num_columns)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(exact, pa.bool_()),
            ], [*(batch.schema.names[2:]), "ids", "lossless"])
        vars(sys.modules[MEMORY])["kept"] = key, pieces

    return run


def _decoded(shared):
    def run(batches):
        pieces = Pieces(shared.value, 0.0)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL,
    dropout: float = DROPOUT, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_tokens, ids, lossless`` for each row: the ids, and whether they decode to the text.

    A null text counts as empty and has no ids. Equal rows get equal ids; equal texts under other ids
    may be cut in another way. A null id counts as 0. An empty table gives no rows. Only the two named
    columns are read. ``model`` is read on the driver and sent to the tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Path(model).read_bytes())
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias(id_col))
    rows = own.mapInArrow(_encoded(shared, (dropout, seed)), f"`{id_col}` long, ids array<int>, lossless boolean")
    return rows.select(id_col, F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with ``decoded`` added, the text of its ``ids``; null where they are null."""
    spark = encoded.sparkSession
    small_batches(spark)
    rest = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    shared = spark.sparkContext.broadcast(Path(model).read_bytes())
    return rest.mapInArrow(_decoded(shared), f"{schema}, decoded string")
