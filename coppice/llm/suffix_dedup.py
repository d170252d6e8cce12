"""Suffix-array dedup: remove every byte covered by a SPAN-byte string that also starts anywhere else.

How it scales.  A full suffix array of the corpus cannot be shuffled, so suffixes are sorted only at *anchors*:
the leftmost smallest GRAM-byte hash of each SPAN-byte window.  Equal windows choose the same anchor at the same
offset, so two windows can be equal only if their anchors' grams are equal.

1. `_anchors` (map side): anchors with a 48-bit gram hash and a 128-bit hash of their whole context (the bytes that
   windows through the anchor can reach).  Contexts repeated within a task are settled there and go on as one row;
   grams with many contexts in a task are salted by context, so no gram's rows meet in one task.
2. `_match` (after a shuffle of hashes only): drops grams that occur once, settles contexts that repeat, and leaves
   one row for each distinct context of the other grams.
3. `_contexts` (joined to the texts): reports documents with nothing open; ships the context bytes of open anchors,
   once each.  A gram with more than GROUP contexts is dealt by context into groups of about GROUP.
4. `_sort_groups`: **deep-shallow sorting** of the contexts' suffixes, to the right of the anchor and (mirrored) to
   its left: multikey quicksort on eight-byte characters to SHALLOW bytes, then a blind trie for each group that
   still shares that prefix.  Neighbours' common-prefix lengths give the longest repeated window each way.
5. Groups that were dealt from one gram are compared in two rounds of 128-bit digests (`_repeated`, `_windows`,
   `_across`): first of the bytes that BLOCK neighbouring windows share, then, in blocks that two groups have, of the
   windows.  A group gives one row for each distinct string, however many of its contexts hold it, and a context of
   a passage's edge only has a few that no other has.
6. The spans found go back to the open documents.

Rows are told apart by a 128-bit digest of id and text, which any task can compute again.

Defined cases: null text counts as empty; texts under SPAN bytes keep all; repeated rows (same id, same text) are
copies of each other; rows that share an id but not a text are separate; null ids are kept; an empty table gives an
empty result; other columns are passed through whatever their names (names are compared as Spark does, without case).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm._arrow import limit_batches, long_hash, other_columns, schema
from coppice.plans.lineage import cut

SPAN = 200
GRAM = 40
SHALLOW = 32
GROUP = 4096  # contexts of a gram that are sorted together, about
BUFFER = 16 << 20  # bytes of text that a task holds while it looks for local repeats
OUT = 4 << 20  # bytes of contexts and texts that go out together
BLOCK = 13  # windows that are compared together at first
ROWS = 8192  # contexts that are sorted in one call, or those of one group
HOT = 32  # contexts of a gram within a task from which its rows are salted
SALTS = 64
_PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    m = 1
    while m < n:
        s = min(m, n - m)
        out[m : m + s] = out[:s] * np.uint64(pow(base, m, 2**64))
        m += s
    return out


_tables: dict[str, np.ndarray] = {}


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, from prefix sums of a polynomial modulo 2^64."""
    if not _tables:
        _tables["up"] = _powers(_BASE, _PIECE + 1)
        _tables["down"] = _powers(pow(_BASE, -1, 2**64), _PIECE + 1)
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * _tables["down"][: len(b)], out=s[1:])
    h = (s[GRAM:] - s[:-GRAM]) * _tables["up"][: len(b) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchor_positions(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the leftmost smallest gram of each window of `text`, with their 48-bit gram hashes."""
    b, at, grams = np.frombuffer(text, np.uint8), [], []
    width, low = SPAN - GRAM + 1, np.uint64((1 << 21) - 1)
    for start in range(0, max(1, len(b) - SPAN + 1), _PIECE - SPAN + 1):  # pieces overlap: each window is in one
        piece = b[start : start + _PIECE]
        if len(piece) < SPAN:
            break
        h = _gram_hashes(piece)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        w = 1
        while w * 2 <= width:
            key = np.minimum(key[:-w], key[w:])
            w *= 2
        if w < width:
            key = np.minimum(key[: len(key) - (width - w)], key[width - w :])
        p = (key & low).astype(np.int64)
        p = p[np.concatenate(([True], p[1:] != p[:-1]))]
        at.append(p + start)
        grams.append((h[p] >> np.uint64(16)).astype(np.int64))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos, first = np.unique(np.concatenate(at), return_index=True)
    return pos, np.concatenate(grams)[first]


_MATCH = schema("__k long, __g long, __c1 long, __c2 long, __r1 long, __r2 long, __pos int, __end int, __kind byte")
# kinds of rows between the first steps
OPEN, MARK, SPANNED, SETTLED = 0, 1, 2, 3


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open runs as maximal runs (runs that touch are joined)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((new[1:], [True]))]


def _runs(*cols: np.ndarray) -> np.ndarray:
    """True where a run of equal rows begins."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _anchors(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for r1, r2, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text is None or len(b := text.encode()) < SPAN:
                    continue
                pos, g = anchor_positions(b)
                reach = SPAN - GRAM
                digest = b"".join([xxhash.xxh3_128_digest(b[max(0, p - reach) : p + SPAN], min(p, reach)) for p in pos.tolist()])
                held.append((r1, r2, len(b), pos, g, np.frombuffer(digest, "<i8").reshape(-1, 2)))
                size += len(b)
                if size >= BUFFER:
                    yield _settle(held, hot)
                    held, size = [], 0
        if held:
            yield _settle(held, hot)

    return run


def _settle(held: list[tuple], least: int) -> pa.RecordBatch:
    """Rows for the shuffle: what repeats within the task is settled, each distinct context goes on once."""
    doc = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
    pos, g = (np.concatenate([x[i] for x in held]) for i in (3, 4))
    c = np.concatenate([x[5] for x in held])
    length = np.array([x[2] for x in held])
    order = np.lexsort((c[:, 1], c[:, 0], g))
    doc, pos, g, c = doc[order], pos[order], g[order], c[order]
    new_c = _runs(g, c[:, 0], c[:, 1])
    run = np.cumsum(new_c) - 1
    n = np.bincount(run)
    full = n[run] >= 2
    new_g = _runs(g)
    gram = np.cumsum(new_g) - 1
    contexts = np.bincount(gram, weights=new_c)
    hot = contexts[gram] >= least
    key = np.where(hot, long_hash(g, c[:, 0] % SALTS + 1), g)
    rows = [pa.array([x[i] for x in held], pa.int64()) for i in (0, 1)]
    out = []

    def add(k, gg, c1, c2, docs, at, end, kind) -> None:
        take = pa.array(docs, mask=docs < 0)
        out.append([pa.array(k), pa.array(gg), pa.array(c1), pa.array(c2), *(r.take(take) for r in rows), pa.array(at.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(np.full(len(k), kind, np.int8) if np.isscalar(kind) else kind.astype(np.int8))])

    add(key[new_c], g[new_c], c[new_c, 0], c[new_c, 1], doc[new_c], pos[new_c], length[doc[new_c]], np.where(full[new_c], SETTLED, OPEN) + np.where(hot[new_c], 4, 0))
    marks = g[new_g & hot]
    zero = np.zeros(len(marks), np.int64)
    add(marks, marks, zero, zero, zero - 1, zero, zero, MARK)
    starts, ends = np.maximum(pos - (SPAN - GRAM), 0)[full], np.minimum(pos + SPAN, length[doc])[full]
    room = int(length.max()) + 2  # one line for all documents, with gaps between them
    s, e = _merge(doc[full] * room + starts, doc[full] * room + ends)
    d = s // room
    zero = np.zeros(len(s), np.int64)
    add(long_hash(d, s), zero, zero, zero, d, s - d * room, e - d * room, SPANNED)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out)], names=_MATCH.names)


_FOUND = schema("__r1 long, __r2 long, __pos int, __end int, __g long, __kind byte, __salt int")


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, gram and context: spans that are settled, and open or settled contexts of grams with several."""
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if carry is None else pa.concat_tables([carry, table])
        k, g = (table.column(i).to_numpy() for i in (0, 1))
        last = int(np.flatnonzero(_runs(k, g))[-1])  # the last gram may go on in the next batch
        carry = table.slice(last)
        if last:
            yield from _matched(table.slice(0, last))
    if carry is not None and carry.num_rows:
        yield from _matched(carry)


def _matched(table: pa.Table) -> Iterator[pa.RecordBatch]:
    kind = table.column("__kind").to_numpy()
    passed = table.filter(pa.array(kind == SPANNED))
    table = table.filter(pa.array(kind != SPANNED))
    kind = table.column("__kind").to_numpy()
    parts = [[passed.column(x) for x in ("__r1", "__r2", "__pos", "__end", "__g")] + [pa.array(np.full(passed.num_rows, SPANNED, np.int8)), pa.array(np.zeros(passed.num_rows, np.int32))]]
    if table.num_rows:
        k, g, c1, c2, pos, length = (table.column(x).to_numpy() for x in ("__k", "__g", "__c1", "__c2", "__pos", "__end"))
        known, mark, base = kind >= 4, kind == MARK, kind & 3
        new_g = _runs(k, g)
        new_c = _runs(k, g, c1, c2, mark)
        gram, run = np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
        full = (np.bincount(run)[run] >= 2) & ~mark | (np.bincount(run, weights=base == SETTLED)[run] > 0) & ~mark
        several = (np.bincount(gram, weights=new_c)[gram] >= 2) | (np.bincount(gram, weights=known | mark)[gram] > 0)
        settle = full & (base == OPEN) & ~mark
        start, end = np.maximum(pos - (SPAN - GRAM), 0), np.minimum(pos + SPAN, length)
        salt = np.where(known, c1 % SALTS, 0).astype(np.int32)
        for chosen, at, to, what in ((settle, start, end, SPANNED), (several & new_c & ~mark, pos, end, None)):
            i = pa.array(np.flatnonzero(chosen))
            what = np.where(full, SETTLED, OPEN)[chosen] if what is None else np.full(len(i), what)
            parts.append([table.column("__r1").take(i), table.column("__r2").take(i), pa.array(at[chosen].astype(np.int32)), pa.array(to[chosen].astype(np.int32)), pa.array(g[chosen]), pa.array(what.astype(np.int8)), pa.array(salt[chosen])])
    yield from pa.concat_tables([pa.table(x, names=_FOUND.names) for x in parts]).combine_chunks().to_batches()


class _Rows:
    """Builds the mixed rows of `_contexts`: contexts, open documents and finished ones."""

    names = ["__g", "__sub", "__split", "__pos", "__left", "__open", "__blob", "__starts", "__ends", "__n_bytes", "__n_removed", "__n_spans", "__kept"]
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    ddl = "__g long, __sub int, __split boolean, __pos int, __left int, __open boolean, __blob binary, __starts array<int>, __ends array<int>, __n_bytes long, __n_removed long, __n_spans long, __kept binary"

    def __init__(self) -> None:
        self.cols: list[list] = [[] for _ in self.names]
        self.kind: list[int] = []
        self.row: list[int] = []
        self.size = 0

    def add(self, kind: int, row: int, **values) -> None:
        self.kind.append(kind)
        self.row.append(row)
        for name, col in zip(self.names, self.cols):
            col.append(values.get(name[2:]))
        self.size += 100 + len(values.get("blob") or b"") + len(values.get("kept") or b"")

    def batch(self, r1, r2, rest, names: list[str]) -> pa.RecordBatch:
        row, doc = pa.array(self.row), pa.array([None if k == 0 else r for k, r in zip(self.kind, self.row)], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(self.kind, pa.int8()), r1.take(row), r2.take(row), rest.take(doc), *(pa.array(c, t) for c, t in zip(self.cols, self.types))], names=names)


def _finish(text: bytes, starts: np.ndarray, ends: np.ndarray, digest: bool) -> dict:
    s, e = _merge(starts, ends)
    kept = b"".join(text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)]))
    return {"n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(s), "kept": hashlib.sha256(kept).digest() if digest else kept}


def _contexts(digest: bool, names: list[str], group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2, rest, texts, founds = (batch.column(i) for i in range(5))
            out = _Rows()
            for i, found in enumerate(founds.to_pylist()):
                text = (texts[i].as_py() or "").encode()
                spans = [(x["pos"], x["end"]) for x in found or () if x["kind"] == SPANNED]
                starts, ends = (np.array(x, np.int64) for x in (zip(*spans) if spans else ((), ())))
                opened = False
                for x in found or ():
                    if x["kind"] == SPANNED:
                        continue
                    pos, split = x["pos"], -(-x["m"] // group)
                    left = min(pos, SPAN - GRAM)
                    blob = text[pos - left : pos + SPAN]
                    sub = xxhash.xxh3_64_intdigest(blob, left) % split if split > 1 else 0
                    out.add(0, i, g=x["g"], sub=sub, split=split > 1, pos=pos, left=left, open=x["kind"] == OPEN, blob=blob)
                    opened |= x["kind"] == OPEN
                if opened:
                    out.add(1, i, blob=text, starts=starts.tolist(), ends=ends.tolist())
                else:
                    out.add(2, i, **_finish(text, starts, ends, digest))
                if out.size > OUT:
                    yield out.batch(r1, r2, rest, names)
                    out = _Rows()
            if out.kind:
                yield out.batch(r1, r2, rest, names)

    return run


# ---- deep-shallow sorting -------------------------------------------------------------------------------------


def _multikey(words: np.ndarray, idx: np.ndarray, depth: int, out: list[tuple[np.ndarray, bool]]) -> None:
    """Ternary quicksort of rows `idx` on the eight-byte characters `words[:, depth:]`; appends runs in order.

    A run comes with True if its rows still share all of the shallow depth.
    """
    stack = [(idx, depth)]
    while stack:
        idx, depth = stack.pop()
        if len(idx) == 1 or depth == words.shape[1]:
            out.append((idx, depth == words.shape[1]))
            continue
        w = words[idx, depth]
        pivot = sorted((w[0], w[len(w) // 2], w[-1]))[1]
        less, more = w < pivot, w > pivot
        parts = [(idx[less], depth), (idx[~(less | more)], depth + 1), (idx[more], depth)]
        stack.extend(p for p in reversed(parts) if len(p[0]))


class _Node:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int, kids: dict) -> None:
        self.depth, self.kids = depth, kids


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of `strings` from a blind trie: inner nodes hold only a depth and the bytes that branch there."""
    root: _Node | list[int] = [0]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while isinstance(node, _Node):  # blind descent: only branching bytes are looked at
            c = s[node.depth] if node.depth < len(s) else -1
            node = node.kids.get(c) or next(iter(node.kids.values()))
        other = strings[node[0]]
        lcp = _common(s, other)
        if lcp == len(s) == len(other):
            node.append(i)
            continue
        above, node = None, root
        while isinstance(node, _Node) and node.depth < lcp:
            above, node = node, node.kids[s[node.depth]]
        c = s[lcp] if lcp < len(s) else -1
        if isinstance(node, _Node) and node.depth == lcp:
            node.kids[c] = [i]
            continue
        fresh = _Node(lcp, {(other[lcp] if lcp < len(other) else -1): node, c: [i]})
        if above is None:
            root = fresh
        else:
            above.kids[s[above.depth]] = fresh
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack.extend(node.kids[c] for c in sorted(node.kids, reverse=True))
        else:
            order.extend(node)
    return order


def deep_shallow(strings: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of `strings` within each run of `group` (ascending), and the prefix each shares with the one before it.

    The first string of a group has -1 in the second array.
    """
    n, depth = len(strings), SHALLOW // 8
    flat = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(n, width)
    words = np.ascontiguousarray(flat[:, :SHALLOW]).view(">u8").reshape(n, depth).astype(np.uint64)
    bounds = np.append(np.flatnonzero(_runs(group)), n)
    order: list[np.ndarray] = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        runs: list[tuple[np.ndarray, bool]] = []
        _multikey(words, np.arange(a, b), 0, runs)
        for idx, deep in runs:
            if deep and len(idx) > 1:
                idx = idx[blind_trie_order([strings[i] for i in idx.tolist()])]
            order.append(idx)
    ranked = np.concatenate(order)
    lcp = np.full(n, -1)
    lengths = np.array([len(s) for s in strings])[ranked]
    differ = flat[ranked[1:]] != flat[ranked[:-1]]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp[1:] = np.where(group[ranked[1:]] == group[ranked[:-1]], np.minimum(same, np.minimum(lengths[1:], lengths[:-1])), -1)
    return ranked, lcp


class _Sides:
    """The contexts' suffixes to the left (mirrored) and right of their anchors, sorted within each group."""

    def __init__(self, blobs: list[bytes], left: np.ndarray, group: np.ndarray) -> None:
        self.n = len(blobs)
        rights = [b[a + GRAM :] for b, a in zip(blobs, left.tolist())]
        lefts = [b[a - 1 :: -1] if a else b"" for b, a in zip(blobs, left.tolist())]
        self.sorted = [(*deep_shallow(x, group, SPAN - GRAM), np.array([len(y) for y in x])) for x in (lefts, rights)]

    def _classes(self, side: int, length: int) -> np.ndarray:
        ranked, lcp, _ = self.sorted[side]
        out = np.empty(self.n, np.int64)
        out[ranked] = np.cumsum(lcp < length)
        return out

    def strings(self, left: int, right: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the strings from `left` bytes before the anchor's gram to `right` bytes after it: the contexts that have
        one (of `some`), whether another context of the group has the same, and whether a context is the first."""
        able = (self.sorted[0][2] >= left) & (self.sorted[1][2] >= right)
        able = np.flatnonzero(able if some is None else able & some)
        key = self._classes(0, left)[able] * (self.n + 1) + self._classes(1, right)[able]
        order = np.argsort(key, kind="stable")
        new = _runs(key[order])
        first, several = np.empty(len(able), bool), np.empty(len(able), bool)
        first[order] = new
        run = np.cumsum(new) - 1
        several[order] = np.bincount(run)[run] > 1 if len(run) else new
        return able, several, first

    def windows(self, i: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the windows with `i` bytes to the gram's left."""
        return self.strings(i, SPAN - GRAM - i, some)


def repeated_reach(sides: _Sides) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows through each context's anchor that another context of its group has too: the most and the
    fewest bytes to the anchor's left (-1: none)."""
    most, least = np.full(sides.n, -1), np.full(sides.n, -1)
    for i in range(SPAN - GRAM + 1):
        able, several, _ = sides.windows(i)
        hit = able[several]
        most[hit] = i
        least[hit] = np.where(least[hit] < 0, i, least[hit])
    return most, least


def blocks() -> Iterator[tuple[int, int]]:
    """(fewest, most) bytes that the windows of a block have to the gram's left."""
    for low in range(0, SPAN - GRAM + 1, BLOCK):
        yield low, min(low + BLOCK, SPAN - GRAM + 1) - 1


def _digests(blobs: list[bytes], left: np.ndarray, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Digests of the strings from `before` bytes before the gram to `after` bytes after it."""
    out = [xxhash.xxh3_128_digest(blobs[k][left[k] - before : left[k] + GRAM + after], before) for k in at.tolist()]
    return np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)


_SPANS = schema("__r1 long, __r2 long, __start int, __end int, __w1 long, __w2 long, __g long, __sub int")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by gram and part, about ROWS rows or one group at a time."""
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        carry = table if carry is None else pa.concat_tables([carry, table])
        if carry.num_rows < ROWS:
            continue
        last = int(np.flatnonzero(_runs(carry.column("__g").to_numpy(), carry.column("__sub").to_numpy()))[-1])
        if last:
            yield carry.slice(0, last)
            carry = carry.slice(last).combine_chunks()
    if carry is not None and carry.num_rows:
        yield carry


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by gram and part: the repeated reach of each open one (rows without __w1), and for grams with
    several parts the digests of each part's blocks."""
    for table in _groups(batches):
        yield from _sorted(table)


def _sorted(table: pa.Table) -> Iterator[pa.RecordBatch]:
    group = np.cumsum(_runs(table.column("__g").to_numpy(), table.column("__sub").to_numpy()))
    split = table.column("__split").to_numpy(zero_copy_only=False)
    live = (np.bincount(group)[group] > 1) | split
    table, group, split = table.filter(pa.array(live)).combine_chunks(), group[live], split[live]
    if not table.num_rows:
        return
    blobs, left = table.column("__blob").to_pylist(), table.column("__left").to_numpy().astype(np.int64)
    sides = _Sides(blobs, left, group)
    most, least = repeated_reach(sides)
    hit = np.flatnonzero((most >= 0) & table.column("__open").to_numpy(zero_copy_only=False))
    pos, i, none = table.column("__pos").to_numpy()[hit], pa.array(hit), pa.nulls(len(hit), pa.int64())
    start, end = (pos - most[hit]).astype(np.int32), (pos - least[hit] + SPAN).astype(np.int32)
    yield pa.RecordBatch.from_arrays([*(table.column(c).take(i).combine_chunks() for c in ("__r1", "__r2")), pa.array(start), pa.array(end), none, none, none, none.cast(pa.int32())], names=_SPANS.names)
    for low, high in blocks() if split.any() else ():
        able, _, first = sides.strings(low, SPAN - GRAM - high, split)
        at = able[first]
        w, i = _digests(blobs, left, at, low, SPAN - GRAM - high), pa.array(at)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, *[none.cast(pa.int32())] * 2, pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), *(table.column(c).take(i).combine_chunks() for c in ("__g", "__sub"))], names=_SPANS.names)


_WINDOWS = schema("__r1 long, __r2 long, __start int, __end int, __w1 long, __w2 long, __alone boolean")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram and part, each part's contexts behind the digests of those of its blocks that other parts
    have too: the windows of these blocks."""
    for tables in _groups(batches):
        bounds = np.append(np.flatnonzero(_runs(tables.column("__g").to_numpy(), tables.column("__sub").to_numpy())), tables.num_rows)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            table = tables.slice(a, b - a).combine_chunks()
            digest = table.column("__w1").is_valid().to_numpy(zero_copy_only=False)
            if not digest.any():
                continue
            known = set(zip(*(table.column(c).filter(pa.array(digest)).to_pylist() for c in ("__w1", "__w2"))))
            table = table.filter(pa.array(~digest)).combine_chunks()
            blobs, left = table.column("__blob").to_pylist(), table.column("__left").to_numpy().astype(np.int64)
            sides = _Sides(blobs, left, np.zeros(len(blobs), np.int64))
            is_open, pos = table.column("__open").to_numpy(zero_copy_only=False), table.column("__pos").to_numpy()
            for low, high in blocks():
                able, _, _ = sides.strings(low, SPAN - GRAM - high)
                w = _digests(blobs, left, able, low, SPAN - GRAM - high)
                some = np.zeros(len(blobs), bool)
                some[able[[x in known for x in zip(*w.T.tolist())]]] = True
                for i in range(low, high + 1) if some.any() else ():
                    able, several, first = sides.windows(i, some)
                    at, alone = able[first], (~several & is_open[able])[first]
                    w, k, start = _digests(blobs, left, at, i, SPAN - GRAM - i), pa.array(at), (pos[at] - i).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(table.column(c).take(k).combine_chunks() for c in ("__r1", "__r2")), pa.array(start), pa.array(start + np.int32(SPAN)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), pa.array(alone)], names=_WINDOWS.names)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, those whose digest others have too."""
    held = None  # the last row of the batch before, until it is known whether its digest goes on
    met = False  # whether that row's digest had another row before it
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        new = _runs(table.column("__w1").to_numpy(), table.column("__w2").to_numpy())
        same = ~new
        same[0] |= met
        same[:-1] |= ~new[1:]
        held, met = table.slice(table.num_rows - 1).combine_chunks(), bool(same[-1])
        yield from table.slice(0, table.num_rows - 1).filter(pa.array(same[:-1])).combine_chunks().to_batches()
    if held is not None and met:
        yield from held.to_batches()


def _close(digest: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, texts, starts, ends, more = (batch.column(i) for i in range(5))
            done = []
            for i, found in enumerate(more.to_pylist()):
                s, e = starts[i].as_py(), ends[i].as_py()
                s, e = s + [x["start"] for x in found or ()], e + [x["end"] for x in found or ()]
                done.append(_finish(texts[i].as_py(), np.array(s, np.int64), np.array(e, np.int64), digest))
            cols = [pa.array([x[k] for x in done], t) for k, t in (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()))]
            yield pa.RecordBatch.from_arrays([rest, *cols], names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """All columns of `docs` but the text, then n_bytes, n_removed, n_spans (long) and `kept`, the remaining bytes
    (binary; with `digest` their SHA-256).  Result columns replace input columns of the same names."""
    limit_batches(docs.sparkSession)
    results = ("n_bytes", "n_removed", "n_spans", "kept")
    others = other_columns(docs, text_col, *results)
    text = F.col(f"`{text_col}`").cast("string")
    marks = [F.xxhash64(text).alias("__r1"), F.xxhash64(F.lit(1), F.col(f"`{id_col}`").cast("string"), F.col(f"`{id_col}`").isNull(), text).alias("__r2")]
    named = docs.select(*marks, F.struct(*(F.col(f"`{c}`") for c in others)).alias("__rest"), text.alias("__text"))
    row = ["__r1", "__r2"]

    found = cut(
        named.select(*row, "__text").where(F.octet_length("__text") >= SPAN).mapInArrow(_anchors(hot), _MATCH)
        .repartition("__k").sortWithinPartitions("__k", "__g", "__c1", "__c2", "__kind").mapInArrow(_match, _FOUND)
    )
    several = found.where(F.col("__kind") != SPANNED)
    contexts = several.groupBy("__g").agg(F.count(F.lit(1)).alias("__m"), F.max("__salt").alias("__most")).where("__m > 1")
    # rows of common grams are salted, so that the count of a gram meets its rows in SALTS places
    contexts = contexts.select("__g", "__m", F.explode(F.when(F.col("__most") > 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("__salt"))
    spanned = found.where(F.col("__kind") == SPANNED).withColumn("__m", F.lit(1).cast("long"))
    with_m = several.join(contexts, ["__g", "__salt"]).unionByName(spanned)
    by_doc = with_m.groupBy(*row).agg(F.collect_list(F.struct(F.col("__pos").alias("pos"), F.col("__end").alias("end"), F.col("__g").alias("g"), F.col("__kind").alias("kind"), F.col("__m").alias("m"))).alias("__found"))

    rest_type = named.schema["__rest"].dataType
    mixed = T.StructType([T.StructField("__kind", T.ByteType()), *(T.StructField(c, T.LongType()) for c in row), T.StructField("__rest", rest_type), *schema(_Rows.ddl)])
    state = cut(named.join(by_doc, row, "left").select(*row, "__rest", "__text", "__found").mapInArrow(_contexts(digest, mixed.names, group), mixed))

    groups = state.where("__kind = 0").select("__g", "__sub", "__split", *row, "__pos", "__left", "__open", "__blob")
    spans = cut(groups.repartition("__g", "__sub").sortWithinPartitions("__g", "__sub").mapInArrow(_sort_groups, _SPANS))
    place = ["__r1", "__r2", "__start", "__end"]

    def repeated(df: DataFrame, kind: T.StructType) -> DataFrame:
        return df.repartition("__w1", "__w2").sortWithinPartitions("__w1", "__w2").mapInArrow(_repeated, kind)

    digests = ["__g", "__sub", "__w1", "__w2"]
    of_blocks = repeated(spans.where("__w1 is not null").select(*digests), T.StructType([_SPANS[c] for c in digests]))
    both = groups.where("__split").unionByName(of_blocks, allowMissingColumns=True)
    of_windows = both.repartition("__g", "__sub").sortWithinPartitions("__g", "__sub").mapInArrow(_windows, _WINDOWS)
    across = repeated(of_windows, _WINDOWS).where("__alone").select(*place)
    spans = spans.where("__w1 is null").select(*place).unionByName(across)
    spans = spans.groupBy(*row).agg(F.collect_list(F.struct(F.col("__start").alias("start"), F.col("__end").alias("end"))).alias("__more"))
    opened = state.where("__kind = 1").select(*row, "__rest", "__blob", "__starts", "__ends")
    closed_schema = T.StructType([T.StructField("__rest", rest_type), *schema("__n_bytes long, __n_removed long, __n_spans long, __kept binary")])
    closed = opened.join(spans, row, "left").select("__rest", "__blob", "__starts", "__ends", "__more").mapInArrow(_close(digest, closed_schema.names), closed_schema)
    done = state.where("__kind = 2").select(*closed_schema.names).unionByName(closed)
    return done.select(*(F.col("__rest").getField(c).alias(c) for c in others), *(F.col(f"__{c}").alias(c) for c in results))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
