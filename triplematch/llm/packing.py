"""Order-preserving packing: dynamic programming over cut positions, with a monotone queue."""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplematch.llm.common import id_text

#: Characters of text whose distinct words are encoded together; a longer text is encoded whole. It changes no result.
GROUP = 16 << 20
#: Texts whose ids are put together at once.
STEP = 64
#: Penalty, in tokens of padding, for a cut at a sentence end inside a document, and for a cut inside a sentence.
SENTENCE_CUT = 1
HARD_CUT = 4

_SPECIAL = "<|endoftext|>"
# A blank inside or at the end of a run of white space: there, cutting before blanks is not safe.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")


class Encoder:
    """Ids of the public byte-level BPE vocabulary, equal to those of the ``tokenizers`` library.

    The vocabulary's splitting pattern never lets a piece reach from a visible character across a blank, so a text
    may be cut before each single blank. Each distinct word of a group of texts, with its blank, is encoded once, and
    the ids are put together by place. Nothing is kept from one group to the next. Texts with runs of white space
    where such a cut would be wrong are encoded whole, and texts that spell a special token go through the
    ``tokenizers`` library itself.
    """

    def __init__(self, path: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                      special_tokens={})
        self._load, self._full = (lambda: Tokenizer.from_file(path)), None
        #: ids that end a sentence: their bytes end in a full stop, question or exclamation mark, or hold a line end
        self.ends = np.zeros(max(table.values()) + 2, bool)
        for b, i in table.items():
            if b.rstrip(b" \"')")[-1:] in (b".", b"!", b"?") or b"\n" in b:
                self.ends[i] = True
        self.ends[0] = True
        self.widths = np.zeros(len(self.ends), np.int64)     # bytes that each id stands for
        for b, i in table.items():
            self.widths[i] = len(b)

    def _whole(self, text: str) -> np.ndarray:
        if _SPECIAL in text:
            if self._full is None:
                self._full = self._load()
            return np.array(self._full.encode(text, add_special_tokens=False).ids, np.uint16)
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(text), np.uint16)

    def _table(self, words: pa.Array, firsts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) of a blank and each of ``words``, then of each of ``firsts``, in one array of ids.

        Words that start with a visible character are encoded as one string and told apart by the byte lengths of
        the ids; the others, and ``firsts``, one by one.
        """
        apart = pc.or_(pc.equal(pc.binary_length(words), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(words, 0, 1)))
        visible = words.filter(pc.invert(apart))
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(visible)], visible), " ")[0].as_py()
        ids = self._plain(" " + joined if len(visible) else "")
        ends = np.cumsum(np.asarray(pc.binary_length(visible)).astype(np.int64) + 1)
        stops = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
        rest, sizes = [], []
        for c in [" " + w for w in words.filter(apart).to_pylist()] + firsts:
            one = self.fast.encode_ordinary(c)
            rest += one
            sizes.append(len(one))
        alone = np.append(apart.to_numpy(zero_copy_only=False), np.ones(len(firsts), bool))
        length, start = np.empty(len(alone), np.int64), np.empty(len(alone), np.int64)
        length[~alone], length[alone] = np.diff(stops, prepend=0), sizes
        start[~alone], start[alone] = stops - length[~alone], len(ids) + np.cumsum(sizes) - sizes
        return np.append(ids, np.array(rest, np.uint16)), start, length

    def _cut(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of texts that may be cut before each blank."""
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        at, chunks = np.asarray(cut.offsets), cut.values
        inner = np.ones(len(chunks), bool)
        inner[at[:-1]] = False                               # the chunk that starts a text has no blank before it
        words = chunks.filter(pa.array(inner)).dictionary_encode()
        ids, start, length = self._table(words.dictionary, chunks.take(pa.array(at[:-1])).to_pylist())
        entry = np.empty(len(chunks), np.int64)
        entry[inner] = words.indices
        entry[at[:-1]] = np.arange(len(texts)) + len(words.dictionary)
        for a in range(0, len(texts), STEP):
            z = min(a + STEP, len(texts))
            e = entry[at[a]:at[z]]
            n = length[e]
            ends = np.cumsum(n)
            out = ids[np.repeat(start[e] - ends + n, n) + np.arange(ends[-1])]
            yield from np.split(out, ends[at[a + 1:z] - at[a] - 1])

    def batch(self, texts: list[str], group: int = 4096) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        a = 0
        while a < len(texts):
            z, held = a, 0
            while z < len(texts) and z - a < group and (z == a or held + len(texts[z]) <= GROUP):
                held += len(texts[z])
                z += 1
            part = texts[a:z]
            whole = [len(t) > GROUP or _SPECIAL in t or _UNSAFE.search(t) is not None for t in part]
            ids = self._cut([t for t, w in zip(part, whole) if not w])
            for t, w in zip(part, whole):
                yield self._whole(t) if w else next(ids)
            a = z


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str | None, ranks: str | None) -> Encoder:
    """One encoder per worker process: what the vocabulary files say, nothing of the texts."""
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = Encoder(path, ranks)
    return _ENCODERS[path, ranks]


def plan_cuts(bounds: list[int], costs: list[int], size: int, hard: int) -> list[int]:
    """Cut positions (ending at ``bounds[-1]``) of least cost, for a stream whose allowed cuts are ``bounds``.

    ``bounds`` ascends; ``costs`` are the penalties of a cut there. A window (i, j] of length n <= size costs its
    padding (size - n, or 0 if n is a power of two) plus the penalty at j. Where two neighbouring bounds lie
    further apart than ``size``, hard cuts (penalty ``hard``) are added between them; besides, from every
    position a full window may be closed by one hard cut when the next bound lies beyond it.

    f[j] = costs[j] + size - b[j] + min over i in reach of (f[i] + b[i]): the minimum slides with j, so a queue
    of candidates with ascending values gives it in amortised constant time.
    """
    pos, pen = [0], [0]
    last = 0
    for b, c in zip(bounds, costs):
        while b - last > size:          # a sentence longer than a window: cut at full windows
            last += size
            pos.append(last)
            pen.append(hard)
        if b > last:
            pos.append(b)
            pen.append(c)
            last = b
    n = len(pos)
    best = [0] * n
    come = [0] * n                       # predecessor state
    via = [0] * n                        # a hard cut between predecessor and state, or 0
    at = {0: 0}
    queue: deque[tuple[int, int]] = deque([(0, 0)])     # (f + b, state), values ascend
    wide: deque[tuple[int, int]] = deque([(0, 0)])      # the same over the reach of two windows
    powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    tail = n - 1
    for j in range(1, n):
        b = pos[j]
        low = b - size
        while pos[queue[0][1]] < low:
            queue.popleft()
        v, i = queue[0]
        f, k, h = v + size - b, i, 0
        while pos[wide[0][1]] < low - size:
            wide.popleft()
        w, i2 = wide[0]
        if pos[i2] + size < b and w + 2 * size - b + hard < f:   # a full window, a hard cut, then the rest
            f, k, h = w + 2 * size - b + hard, i2, pos[i2] + size
        if j == tail or pen[j] == 0:                             # short windows without padding end documents
            for p in powers:
                i = at.get(b - p)
                if i is not None and best[i] < f:
                    f, k, h = best[i], i, 0
        f += pen[j]
        best[j], come[j], via[j] = f, k, h
        at[b] = j
        v = f + b
        while queue and queue[-1][0] >= v:
            queue.pop()
        queue.append((v, j))
        while wide and wide[-1][0] >= v:
            wide.pop()
        wide.append((v, j))
    cuts, j = [], tail
    while j > 0:
        cuts.append(pos[j])
        if via[j]:
            cuts.append(via[j])
        j = come[j]
    return cuts[::-1]


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary")


def pack(docs: DataFrame, size: int = 1024, block: int = 128, with_ids: bool = False, path: str | None = None,
         ranks: str | None = None) -> DataFrame:
    """Packs documents into sequences of at most ``size`` tokens; one row per piece.

    Columns: doc_id, start (ids of its document before it), length, ids_crc32 (of the little-endian unsigned
    32-bit ids), doc_tokens (with the closing id 0), sequence_id, offset in the sequence; ``with_ids`` adds the
    ids themselves (``ids``, little-endian 32 bit).

    Documents keep their order within a partition (sorted by doc_id there). Each partition streams its documents
    through the dynamic programme in runs of at least ``block`` windows: a run is planned, its windows but the last are
    final, and the rest joins the next run. So a task holds one run and one document in memory, no row crosses
    partitions, and a partition wastes at most one unfilled sequence. ``sequence_id`` is the partition number and
    a counter, the same when a lost task runs again over the same rows.

    A null or empty text is one id 0. Rows without a doc_id are left out. Rows that repeat a doc_id are packed one
    by one, each with its own pieces. An empty table gives no rows.
    """
    schema = SCHEMA if with_ids else SCHEMA.rsplit(",", 1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, ranks)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        goal = block * size
        made = 0
        held: list[tuple[int, int, int, np.ndarray]] = []   # (doc_id, ids before, ids in all, ids)
        held_n = 0
        out: list[tuple] = []

        def plan(final: bool) -> None:
            nonlocal held, held_n, made
            stream = np.concatenate([h[3] for h in held])
            ends = np.cumsum([len(h[3]) for h in held])
            marks = enc.ends[stream]
            marks[ends - 1] = True
            bounds = np.flatnonzero(marks) + 1
            costs = np.full(len(bounds), SENTENCE_CUT)
            done = np.searchsorted(bounds, [e for h, e in zip(held, ends) if h[1] + len(h[3]) == h[2]])
            costs[done] = 0
            cuts = plan_cuts(bounds.tolist(), costs.tolist(), size, HARD_CUT)
            if not final:
                cuts = cuts[:-1] if len(cuts) > 1 else cuts   # the last window waits for what follows
            wide = stream.astype("<u4")
            d, seen, at = 0, 0, 0                              # document, ids of the stream before it, position
            for cut in cuts:
                offset = 0
                while at < cut:
                    doc, before, total, ids = held[d]
                    upto = min(cut, seen + len(ids))
                    raw = wide[at:upto].tobytes()
                    row = (doc, before + at - seen, upto - at, zlib.crc32(raw), total, base + made, offset)
                    out.append(row + (raw,) if with_ids else row)
                    offset += upto - at
                    at = upto
                    if at == seen + len(ids):
                        seen += len(ids)
                        d += 1
                made += 1
            rest = held[d:]
            if rest and at > seen:
                doc, before, total, ids = rest[0]
                rest[0] = (doc, before + at - seen, total, ids[at - seen:])
            held, held_n = rest, sum(len(h[3]) for h in rest)

        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in names]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            out.clear()
            return batch

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), enc.batch(texts)):
                ids = np.append(ids, np.uint16(0))
                total = len(ids)
                for a in range(0, total, goal):             # a very long document enters in parts
                    part = ids[a:a + goal]
                    held.append((doc, a, total, part))
                    held_n += len(part)
                    if held_n >= goal:
                        plan(False)
            yield flush()
        if held:
            plan(True)
            yield flush()

    rows = id_text(docs).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return rows.mapInArrow(run, schema)
