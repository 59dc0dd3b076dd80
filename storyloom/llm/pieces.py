"""Encoding and decoding with merge-type (BPE) piece vocabularies.

The encoder keeps, for each run of text, an agenda of adjacent symbol pairs ordered by the score of the piece
they would make (ties: the leftmost), and merges until no pair makes a piece. Symbols that are no piece become
byte pieces. No piece of such a vocabulary crosses from text to the word mark, so a text is dealt with in runs
"marks + characters", and a run's ids are kept in a memo of bounded bytes, which ends with the task. Every run that is
new to a memo is checked against the sentencepiece library, for its ids and for its decoding, a batch at a time.

Defined cases: a null or empty text has the end id alone and decodes to the empty text; very long texts are
encoded whole; other columns pass by untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from storyloom.llm._common import map_batches

MARK = "▁"
_RUNS = re.compile(" +[^ ]*")
#: Runs up to this length go through the agenda together, longer ones alone.
SHORT_RUN = 40
#: Bytes that each of the two memo generations holds, about, and what a run takes besides its characters and digits.
MEMO_BYTES, RUN_BYTES = 24_000_000, 250
#: Characters of text that are encoded at once, and new runs.
SLICE_CHARS, SLICE_RUNS = 1_000_000, 20_000
_NEVER = np.int64(1) << 40


class PieceCodec:
    """The vocabulary of one model file, an encoder by agenda and a decoder.

    A run is written with spaces for marks: " word".
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i).replace(MARK, " ") for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i))]
        if any(re.search("[^ ] ", pieces[i]) for i in plain):
            raise ValueError("a piece crosses from text to the word mark; runs can't be encoded alone")
        self.ids = {pieces[i]: i for i in plain}
        self.text = {i: pieces[i] for i in plain}
        #: Of each piece: its place in the agenda, the best score first; equal scores share a place.
        place = {score: k for k, score in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        self.order = {pieces[i]: place[lib.get_score(i)] for i in plain}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        #: By id: its decimal digits, and its text, null where it has none of its own.
        self.decimal = pa.array([str(i) for i in range(n)])
        self.own_text = pa.array([self.text.get(i) for i in range(n)], pa.string())
        # symbols as numbers: a piece's id, or size + code point for a character that is no piece
        self.span = n + 0x110000
        made = sorted(
            (self.symbol(p[:k]) * self.span + self.symbol(p[k:]), i, self.order[p])
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if (k == 1 or p[:k] in self.ids) and (k == len(p) - 1 or p[k:] in self.ids)
        )
        self.pairs = np.array([x[0] for x in made], np.int64)
        self.pair_id = np.array([x[1] for x in made], np.int64)
        self.pair_order = np.array([x[2] for x in made], np.int64)
        #: The id at each place of the agenda, -1 where several ids share it.
        ids, places = np.array(plain), np.array([self.order[pieces[i]] for i in plain])
        self.at_place = np.full(len(place), -1, np.int64)
        self.at_place[places] = ids
        self.at_place[np.bincount(places) > 1] = -1
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.forget()

    def forget(self) -> None:
        """Empties the memo: of each run its ids as decimals, the generation before, and decodings that aren't the run itself."""
        self.memo: dict[str, str] = {}
        self.elder: dict[str, str] = {}
        self.changed: dict[str, str] = {}
        self.held = 0

    def _remember(self, found: dict[str, str]) -> None:
        """Adds runs to the memo; a generation that is full becomes the elder one, and the one before it goes."""
        if self.held > MEMO_BYTES:
            self.memo, self.elder, self.held = {}, self.memo, 0
            self.changed = {r: t for r, t in self.changed.items() if r in self.elder}
        self.memo.update(found)
        self.held += sum(RUN_BYTES + len(r) + len(i) for r, i in found.items())

    def symbol(self, s: str) -> int:
        return self.ids[s] if s in self.ids else self.size + ord(s)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair would make: its place in the agenda (_NEVER: no piece) and its id."""
        keys = left * self.span + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        hit = self.pairs[at] == keys
        return np.where(hit, self.pair_order[at], _NEVER), self.pair_id[at]

    def merge_short(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All runs' symbols in one row after another, and how many each has.

        Runs of one length are a matrix; in every round, the best pair of each row's agenda is merged.
        """
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        chars = self.of_char[np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)]
        starts = np.concatenate(([0], np.cumsum(lengths)))
        rows, counts = np.full((len(runs), int(lengths.max(initial=1))), -1, np.int64), lengths.copy()
        for n in np.unique(lengths):
            where = np.flatnonzero(lengths == n)
            symbols = chars[starts[where][:, None] + np.arange(n)]
            rows[where, :n] = symbols
            if n == 1:
                continue
            agenda, _ = self._pairs(symbols[:, :-1], symbols[:, 1:])
            while len(where):
                best = agenda.argmin(1)
                r = np.arange(len(where))
                open_ = agenda[r, best] < _NEVER
                if not open_.all():
                    done = where[~open_]
                    rows[done] = -1
                    rows[done, : symbols.shape[1]] = symbols[~open_]
                    counts[done] = symbols.shape[1]
                    where, symbols, agenda, best = where[open_], symbols[open_], agenda[open_], best[open_]
                    r = np.arange(len(where))
                    if not len(where):
                        break
                made = self.at_place[agenda[r, best]]
                tied = np.flatnonzero(made < 0)
                made[tied] = self._pairs(symbols[tied, best[tied]], symbols[tied, best[tied] + 1])[1]
                width = symbols.shape[1]
                if width == 2:
                    rows[where] = -1
                    rows[where, 0] = made
                    counts[where] = 1
                    break
                symbols[r, best] = made
                left = np.arange(width - 1)
                symbols = np.take_along_axis(symbols, left + (left > best[:, None]), 1)
                left = left[:-1]
                agenda = np.take_along_axis(agenda, left + (left >= best[:, None]), 1)
                inner = np.flatnonzero(best > 0)
                agenda[inner, best[inner] - 1] = self._pairs(symbols[inner, best[inner] - 1], symbols[inner, best[inner]])[0]
                inner = np.flatnonzero(best < width - 2)
                agenda[inner, best[inner]] = self._pairs(symbols[inner, best[inner]], symbols[inner, best[inner] + 1])[0]
        return rows[rows >= 0], counts

    def merge_long(self, run: str) -> list[int]:
        """One run of any length, its agenda a heap; entries that a merge has made void are passed over."""
        symbols, order, n = list(run), self.order, len(run)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(order[run[i : i + 2]], i, i + 1, run[i : i + 2]) for i in range(n - 1) if run[i : i + 2] in order]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            for x, y in ((before[left], left), (left, after[left])):
                if x >= 0 and y < n and (pair := symbols[x] + symbols[y]) in order:
                    heapq.heappush(agenda, (order[pair], x, y, pair))
        return [self.symbol(s) for s in symbols if s]

    def _spell(self, symbol: int) -> list[int]:
        """The ids of a symbol: its own, or its bytes where it is a character without a piece."""
        if symbol < self.size:
            return [symbol]
        return [self.bytes[b] for b in chr(symbol - self.size).encode("utf-8")] if self.bytes else [self.unknown]

    def encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All runs' ids, one run after another, and how many each run has."""
        flat, counts = self.merge_short([r for r in runs if len(r) <= SHORT_RUN])
        odd = flat >= self.size
        if odd.any():
            spelled = [self._spell(s) for s in flat[odd].tolist()]
            width = np.ones(len(flat), np.int64)
            width[odd] = list(map(len, spelled))
            ends = np.concatenate(([0], np.cumsum(width)))[np.cumsum(counts)]
            flat, odd = np.repeat(flat, width), np.repeat(odd, width)
            flat[odd] = list(chain.from_iterable(spelled))
            counts = np.diff(ends, prepend=0)
        long = np.fromiter((len(r) > SHORT_RUN for r in runs), bool, len(runs))
        if long.any():
            own = [[i for s in self.merge_long(runs[k]) for i in self._spell(s)] for k in np.flatnonzero(long)]
            every = np.empty(len(runs), np.int64)
            every[~long], every[long] = counts, list(map(len, own))
            where = np.repeat(long, every)
            ids = np.empty(len(where), np.int64)
            ids[~where], ids[where] = flat, list(chain.from_iterable(own))
            flat, counts = ids, every
        return flat, counts

    def run_text(self, ids: list[int]) -> str:
        """The text of a run's ids, its leading mark as a space."""
        text = self.text
        try:
            return "".join([text[i] for i in ids])
        except KeyError:
            pass
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            out.append(pending.decode("utf-8", "replace") + (" \u2047 " if i == self.unknown else text.get(i, "")))
            pending.clear()
        return "".join(out) + pending.decode("utf-8", "replace")

    @staticmethod
    def runs(text: str) -> list[str]:
        return _RUNS.findall(" " + text.replace(MARK, " ")) if text else []

    def learn(self, runs: list[str]) -> tuple[dict[str, str], dict[str, str]]:
        """Encodes and decodes new runs; the library gets the same runs as one text, and must agree."""
        flat, counts = self.encode_runs(runs)
        edges = np.concatenate(([0], np.cumsum(counts)))

        def joined(strings: pa.Array, between: str) -> list[str | None]:
            return pc.binary_join(pa.ListArray.from_arrays(edges.astype(np.int32), strings.take(pa.array(flat))), between).to_pylist()

        ids, whole = flat.tolist(), "".join(runs)[1:]
        texts = [self.run_text(ids[a:z]) if t is None else t for t, a, z in zip(joined(self.own_text, ""), edges, edges[1:])]
        theirs = self.library.encode(whole, num_threads=1)
        if ids != theirs or "".join(texts)[1:] != self.library.decode(theirs):
            for r, text, a, z in zip(runs, texts, edges, edges[1:]):
                own, theirs = ids[a:z], self.library.encode(r[1:])
                if own != theirs and r != " " or text[1:] != self.library.decode(theirs):
                    raise AssertionError(f"{r!r}: the agenda gives {own}, {text!r}; the library {theirs}, {self.library.decode(theirs)!r}")
        return dict(zip(runs, joined(self.decimal, " "))), {r: t for r, t in zip(runs, texts) if r != t}

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """Of each text: its ids (no end id) as decimals joined by spaces, and the text that they decode to."""
        cut = [self.runs(t) for t in texts]
        need = set(chain.from_iterable(cut))
        known = {r: self.memo[r] for r in need if r in self.memo}
        again = {r: self.elder[r] for r in need if r not in known and r in self.elder}
        known |= again
        changed = {r: self.changed[r] for r in need if r in self.changed} if self.changed else {}
        unseen = [r for r in need if r not in known]
        for at in range(0, len(unseen), SLICE_RUNS):
            learned, odd = self.learn(unseen[at : at + SLICE_RUNS])
            known |= learned
            changed |= odd
            short = {r: i for r, i in learned.items() if len(r) <= SHORT_RUN}
            self._remember(short)
            self.changed |= {r: t for r, t in odd.items() if r in short}
        self._remember(again)
        self.changed |= {r: changed[r] for r in again if r in changed}
        out = []
        for c, text in zip(cut, texts):
            decoded = text.replace(MARK, " ")
            if changed and not changed.keys().isdisjoint(c):
                decoded = "".join(changed.get(r, r) for r in c).removeprefix(" ")
            out.append((" ".join(map(known.__getitem__, c)), decoded))
        return out

    def encode(self, text: str | None) -> list[int]:
        ids, _ = self.encode_batch([text or ""])[0]
        return [int(x) for x in ids.split()] + [self.end]

    def decode(self, ids: list[int]) -> str:
        out = self.run_text([i for i in ids if i != self.end])
        return out[1:] if out[:1] == " " else out


_CODECS: dict[str, PieceCodec] = {}


def codec(model: str) -> PieceCodec:
    """One codec for each model and worker process."""
    if model not in _CODECS:
        _CODECS[model] = PieceCodec(model)
    return _CODECS[model]


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def encode_documents(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", tokens: bool = False) -> DataFrame:
    """Per row: id, n_tokens (with the end id), ids_sha256, decoded_sha256, and ids with `tokens`.

    One narrow pass over the two columns; memory holds one Arrow batch, the vocabulary and the memo, which ends with the task.
    """
    id_type = docs.schema[id_column].dataType
    schema = f"{id_column} {id_type.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * tokens

    def encoded(c: PieceCodec, whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        end = str(c.end)
        lengths = pc.fill_null(pc.utf8_length(whole.column(1)), 0).to_pylist()
        at = 0
        while at < len(lengths):
            upto, chars = at, 0
            while upto < len(lengths) and (upto == at or chars + lengths[upto] <= SLICE_CHARS):
                chars += lengths[upto]
                upto += 1
            batch = whole.slice(at, upto - at)
            at = upto
            found = c.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            ids = [f"{i} {end}" if i else end for i, _ in found]
            columns = [
                batch.column(0),
                pa.array([i.count(" ") + 1 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i.encode("ascii")).hexdigest() for i in ids]),
                pa.array([_sha(t) for _, t in found]),
            ]
            if tokens:
                columns.append(pa.array([[int(x) for x in i.split()] for i in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [id_column, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        try:
            for whole in batches:
                yield from encoded(c, whole)
        finally:
            c.forget()

    return docs.select(id_column, text_column).transform(map_batches, run, schema)
