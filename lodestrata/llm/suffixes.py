"""Exact substring removal: every byte inside a 50-byte string that also starts in a document with a smaller doc_id.

Suffixes are compared through prefix polynomial hashes, which give the hash of any 50-byte prefix of a suffix in constant
time. Not all suffixes move. A minimizer picks one anchor for each run of neighbouring windows of 50 bytes, by their
content alone, so equal windows have equal anchors. Three exchanges settle all windows:

1. Each chunk of documents sends its distinct (anchor, block) hashes, a block being the bytes of an anchor's windows, with
   the smallest doc_id; what is common costs a chunk one entry however often it stands there. Blocks known from a smaller
   document are settled.
2. Where an anchor has several blocks, the first holder of each block sends its bytes. There the suffixes from the anchor
   are merge-sorted; a comparison finds the common extension by binary search on prefix hashes, then looks at one byte.
   The orders to both sides of the anchor, with the extensions that neighbours have in common, tell which windows are equal;
   these are compared byte by byte, and windows that a smaller document has too are settled.
3. An anchor of more than MANY_BLOCKS blocks, such as a common line amid ever new text, isn't compared in one place: its
   blocks' windows are dealt by their own bytes' hashes (112 bits: those of both halves), as only equal windows have to meet,
   and those of larger documents are settled.
4. Settled spans go back to their chunk, which cuts them out.

Entries are told apart by 32 bits of the anchor's hash, those that choose the bucket (8 or more) and 48 of the block's: among
n blocks two unlike ones agree with a chance under n * n / 2^89, which is one in five million for 10^10 blocks.

Null text counts as empty. Documents shorter than the string lose nothing. Rows with equal doc_ids aren't smaller than one
another; a null doc_id is larger than all others. An empty table gives an empty result. Columns besides doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .chunks import BUCKET_BYTES, bucket_count, bucket_of, chunk_table, each_row, marked, opened, slices, small_batches
from .common import stow

LENGTH, GRAM = 50, 16
#: Buckets of sent bytes for each bucket of entries, from some size on: a byte sent stands for a window of many numbers.
FINER = 8
#: Bytes of blocks that are compared at once; those of one key stay together.
PIECE_BYTES = 1 << 20
#: Blocks of a key that are compared with one another; the windows of keys with more are dealt out.
MANY_BLOCKS = 4096
_LOW = np.uint64((1 << 24) - 1)
_SEGMENT = 1 << 23
NOTHING, SETTLED, SEND, DEAL = 0, 1, 2, 3
HERE, BLOCKS, WINDOWS = 0, 1, 2


def _anchors(texts: W.Texts, prefix: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """key, first and last window start, and place of each anchor."""
    n, span = len(texts.data), length - gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    counts = np.maximum(np.diff(texts.at) - length + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(bounds[-1]) + np.repeat(texts.at[:-1] - bounds[:-1], counts)
    for low in range(0, n, _SEGMENT):
        s = starts[np.searchsorted(starts, low) : np.searchsorted(starts, low + _SEGMENT)]
        if not len(s):
            continue
        high = min(n, low + _SEGMENT + length)
        grams = W.rolling_hashes(prefix, low, high, gram)
        least = grams & ~_LOW
        least |= np.arange(len(grams), dtype=np.uint64)  # ties go to the left
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: width - span], least[span - width :])
        place = (least[s - low] & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (s[1:] != s[:-1] + 1)]))
        found.append((grams[place[first]], s[first], s[np.append(first[1:], len(s)) - 1], place[first] + low))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Chunk:
    """A chunk's anchors, and its distinct (key, block) entries in order."""

    def __init__(self, texts: W.Texts, ids: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        self.texts, self.ids, self.length = texts, ids, length
        self.prefix = prefix = texts.prefix_hashes()
        key, self.first, self.last, self.place = _anchors(texts, prefix, length, gram)
        block = W.span_hashes(prefix, self.first, self.last + length) >> np.uint64(16)
        self.row = np.searchsorted(texts.at, self.first, side="right") - 1
        self.doc = ids[self.row] if len(ids) else np.zeros(0, np.int64)
        order = np.lexsort((self.doc, block, key))
        k, b = key[order], block[order]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (b[1:] != b[:-1])]) if len(k) else np.zeros(0, bool)
        self.key, self.block, self.least = k[fresh], b[fresh], self.doc[order][fresh]
        self.entry = np.empty(len(k), np.int64)  # of each anchor
        self.entry[order] = np.cumsum(fresh) - 1

    def buckets(self, n: int) -> np.ndarray:
        return bucket_of(self.key, n)

    def windows(self, anchors: np.ndarray) -> dict[str, np.ndarray]:
        """start, row, doc and entry of each window of some anchors; key, block and least document of the entries, in order of keys."""
        count = self.last[anchors] - self.first[anchors] + 1
        bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        start = np.arange(bounds[-1]) + np.repeat(self.first[anchors] - bounds[:-1], count)
        row, doc, half = np.repeat(self.row[anchors], count), np.repeat(self.doc[anchors], count), start + self.length // 2
        key, block = W.span_hashes(self.prefix, start, half), W.span_hashes(self.prefix, half, start + self.length) >> np.uint64(16)
        order = np.lexsort((doc, block, key))
        k, b = key[order], block[order]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (b[1:] != b[:-1])]) if len(k) else np.zeros(0, bool)
        entry = np.empty(len(k), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        return {"start": start, "row": row, "doc": doc, "entry": entry, "key": k[fresh], "block": b[fresh], "least": doc[order][fresh]}


def _packed(key: np.ndarray, block: np.ndarray, doc: np.ndarray, base: int) -> bytes:
    """14 bytes an entry, or 18 if doc_ids lie far apart."""
    far = doc - base
    wide = len(far) and (int(far.max()) >= 1 << 32)
    return b"".join((key.astype("<u4").tobytes(), (block & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (block >> np.uint64(32)).astype("<u2").tobytes(), far.astype("<i8" if wide else "<u4").tobytes()))


def _unpacked(n: int, base: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    block = np.frombuffer(data, "<u4", n, 4 * n).astype(np.uint64) | np.frombuffer(data, "<u2", n, 8 * n).astype(np.uint64) << np.uint64(32)
    doc = np.frombuffer(data, "<i8" if len(data) == 18 * n else "<u4", n, 10 * n).astype(np.int64) + base
    return np.frombuffer(data, "<u4", n), block, doc


def _entries(chunks: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """bucket, chunk, n, base, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            c = Chunk(*opened(r["ids"], r["sizes"], r["body"]), length, gram)
            base = int(c.least.min()) if len(c.least) else 0
            out = [(b, r["chunk"], j - i, base, _packed(c.key[i:j], c.block[i:j], c.least[i:j], base)) for b, i, j in slices(c.buckets(buckets))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["bucket", "chunk", "n", "base", "data"])

    return chunks.mapInArrow(run, "bucket long, chunk long, n long, base long, data binary")


def _codes(rows: dict, many: int = MANY_BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a bucket: settled by a smaller document, to be sent with its bytes, to be dealt by windows, or neither; bounds of the rows in them."""
    parts = [_unpacked(n, base, data) for n, base, data in zip(rows["n"], rows["base"], rows["data"], strict=True)]
    key, block, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((doc, block, key))
    k, b, d = key[order], block[order], doc[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new_block = new_key | np.concatenate([[True], b[1:] != b[:-1]])
    first = d[np.flatnonzero(new_block)][np.cumsum(new_block) - 1]
    of_key = np.cumsum(new_key) - 1
    blocks = np.bincount(of_key[new_block])[of_key]
    codes = np.empty(len(k), np.uint8)
    codes[order] = np.where(d > first, SETTLED, np.where(blocks > many, DEAL, np.where(blocks > 1, SEND, NOTHING)))
    return codes, np.cumsum([0, *rows["n"]])


def _settle(many: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        codes, ends = _codes(rows, many)
        return pa.table({"chunk": pa.array(rows["chunk"], pa.int64()), "bucket": pa.array(rows["bucket"], pa.int64()), "codes": pa.array([zstandard.ZstdCompressor(level=1).compress(codes[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    return run


_SPAN = np.dtype([("row", "<u4"), ("start", "<i8"), ("end", "<i8")])
_PLACE = np.dtype([("entry", "<u4"), ("row", "<u4"), ("start", "<i8")])
_SENT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("start", "<i8"), ("size", "<u2"), ("anchor", "<u2")])


def _answers(coded: DataFrame, finer: int, length: int, gram: int) -> DataFrame:
    """Rows by kind: spans settled in the chunk; heads and bytes of the blocks that it sends; entries and places of the windows that it deals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            texts, ids = opened(r["ids"], r["sizes"], r["body"])
            c = Chunk(texts, ids, length, gram)
            codes = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x["codes"]) for x in sorted(r["answers"], key=lambda x: x["bucket"])), np.uint8)
            code = codes[c.entry]
            gone = (code == SETTLED) | (c.doc > c.least[c.entry])
            dealt = c.windows(np.flatnonzero((code == DEAL) & ~gone))
            own = dealt["doc"] > dealt["least"][dealt["entry"]]  # this chunk itself holds a smaller document's
            starts, ends, at = texts.tokens(marked(len(texts.data), np.concatenate([c.first[gone], dealt["start"][own]]), np.concatenate([c.last[gone], dealt["start"][own]]) + length))
            spans = np.empty(len(starts), _SPAN)
            spans["row"] = W.owner(at)
            spans["start"], spans["end"] = starts - texts.at[spans["row"]], ends - texts.at[spans["row"]]
            out = [(HERE, None, r["chunk"], spans.tobytes(), b"", 0, 0)]
            sent = np.flatnonzero((code == SEND) & ~gone)
            sent = sent[np.argsort(c.key[c.entry[sent]], kind="stable")]
            heads = np.empty(len(sent), _SENT)
            heads["doc"], heads["row"], heads["start"] = c.doc[sent], c.row[sent], c.first[sent] - texts.at[c.row[sent]]
            heads["size"], heads["key"], heads["anchor"] = c.last[sent] + length - c.first[sent], c.key[c.entry[sent]], c.place[sent] - c.first[sent]
            for b, i, j in slices(bucket_of(c.key[c.entry[sent]], finer)):
                data = b"".join(texts.data[p : p + n].tobytes() for p, n in zip(c.first[sent[i:j]].tolist(), heads["size"][i:j].tolist(), strict=True))
                out.append((BLOCKS, b, r["chunk"], heads[i:j].tobytes(), data, 0, 0))
            order = np.flatnonzero(~own)[np.argsort(dealt["entry"][~own], kind="stable")]
            base = int(dealt["least"].min()) if len(dealt["least"]) else 0
            for b, i, j in slices(bucket_of(dealt["key"], finer)):
                part = order[np.searchsorted(dealt["entry"][order], i) : np.searchsorted(dealt["entry"][order], j)]
                places = np.empty(len(part), _PLACE)
                places["entry"], places["row"] = dealt["entry"][part] - i, dealt["row"][part]
                places["start"] = dealt["start"][part] - texts.at[dealt["row"][part]]
                out.append((WINDOWS, b, r["chunk"], places.tobytes(), _packed(dealt["key"][i:j], dealt["block"][i:j], dealt["least"][i:j], base), j - i, base))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["kind", "bucket", "chunk", "heads", "data", "n", "base"])

    return coded.mapInArrow(run, "kind int, bucket long, chunk long, heads binary, data binary, n long, base long")


def _dealt(length: int):
    """Of the windows of a bucket, the spans of those that a smaller document has."""

    def run(table: pa.Table) -> pa.Table:
        rows, out = table.to_pydict(), []
        codes, ends = _codes(rows)
        for chunk, heads, first in zip(rows["chunk"], rows["heads"], ends.tolist(), strict=False):
            places = np.frombuffer(heads, _PLACE)
            places = places[codes[first + places["entry"].astype(np.int64)] == SETTLED]
            spans = np.empty(len(places), _SPAN)
            spans["row"], spans["start"], spans["end"] = places["row"], places["start"], places["start"] + length
            out.append((chunk, spans.tobytes()))
        return pa.table({"chunk": pa.array([o[0] for o in out], pa.int64()), "heads": pa.array([o[1] for o in out], pa.binary())})

    return run


class Extensions:
    """Suffixes of a buffer from their starts up to a limit, or the reversed prefixes before them, compared by hash and binary search."""

    def __init__(self, texts: W.Texts, prefix: np.ndarray, start: np.ndarray, limit: np.ndarray, back: bool = False):
        self.data, self.prefix, self.down = texts.data, prefix, W._power("down", len(prefix))
        self.start, self.limit, self.back = start, limit, back

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the first n bytes of i and j have one prefix hash."""
        a, b = (self.start[i] - n, self.start[j] - n) if self.back else (self.start[i], self.start[j])
        return (self.prefix[a + n] - self.prefix[a]) * self.down[a] == (self.prefix[b + n] - self.prefix[b]) * self.down[b]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of i and j."""
        high = np.minimum(self.limit[i], self.limit[j])
        whole = self.same(i, j, high)  # many are equal: one look is enough for those
        low, high = np.where(whole, high, 0), np.where(whole, high, high - 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.same(i[open_], j[open_], middle)
            low[open_[same]], high[open_[~same]] = middle[same], middle[~same] - 1
            open_ = open_[low[open_] < high[open_]]
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether i comes before j: at the first byte after their common extension, or as the shorter one."""
        n = self.common(i, j)
        inside = n < np.minimum(self.limit[i], self.limit[j])
        at = np.where(inside, n, 0)
        a, b = (self.start[i] - 1 - at, self.start[j] - 1 - at) if self.back else (self.start[i] + at, self.start[j] + at)
        last = len(self.data) - 1
        if last < 0:
            return np.zeros(len(i), bool)
        return np.where(inside, self.data[np.clip(a, 0, last)] < self.data[np.clip(b, 0, last)], self.limit[i] < self.limit[j])

    def heads(self) -> np.ndarray:
        """The first eight bytes of each as one number; beyond the limit they count as 0."""
        found = np.zeros(len(self.start), np.uint64)
        for k in range(8 if len(self.data) else 0):
            at = self.start - 1 - k if self.back else self.start + k
            found = found << np.uint64(8) | np.where(k < self.limit, self.data[np.clip(at, 0, len(self.data) - 1)], 0).astype(np.uint64)
        return found

    def merge_sorted(self, group: np.ndarray) -> np.ndarray:
        """Order by group, and by suffix within a group; equal ones keep their order.

        Runs of suffixes that agree in their first bytes are merged by rank.
        """
        if not len(group):
            return np.zeros(0, np.int64)
        heads = self.heads()
        order = np.lexsort((heads, group))
        held, word = group[order], heads[order]
        new = np.concatenate([[True], (held[1:] != held[:-1]) | (word[1:] != word[:-1])])
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        width = 1
        active = np.flatnonzero(size > 1)
        while len(active):
            place = active - begin[active]
            run = place // width
            other = begin[active] + (run ^ 1) * width
            end = np.minimum(other + width, begin[active] + size[active])
            low, high, mine, right = np.minimum(other, end), end.copy(), order[active], run % 2 == 1
            first = low.copy()
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) // 2
                theirs, own, r = order[middle], mine[open_], right[open_]
                less = self.less(np.where(r, own, theirs), np.where(r, theirs, own))
                before = less ^ r  # theirs before mine; of equal ones the left run's
                low[open_[before]], high[open_[~before]] = middle[before] + 1, middle[~before]
                open_ = open_[low[open_] < high[open_]]
            order[begin[active] + (run - run % 2) * width + place - run * width + low - first] = mine
            width *= 2
            active = active[size[active] > width]
        return order

    def neighbours(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order, and how long the extension is that each has in common with the one before; -1 at a group's first."""
        order = self.merge_sorted(group)
        common = np.full(len(order), -1)
        beside = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        common[beside] = self.common(order[beside - 1], order[beside])
        return order, common


def longest(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of each, the longest extension in common with any other of its group: one beside it in the sorted order has it."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(np.maximum(common, np.append(common[1:], -1)), 0)
    return out


def parted(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Numbers that are equal where at least so many bytes are: one for each stretch of the sorted order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum((common < least) | (common < 0))
    return out


def equal_windows(texts: W.Texts, doc: np.ndarray, key: np.ndarray, anchor: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the blocks (one document each) that also stand in a block of a smaller document: block, first and last start.

    The suffixes from the blocks' anchors, and the reversed prefixes before them, are merge-sorted beside those of the same
    key. Windows at one distance before the anchor are equal where the prefixes agree over that distance and the suffixes
    over the rest, that is, in one stretch of either order. Equal ones are compared byte by byte.
    """
    prefix, size = texts.prefix_hashes(), np.diff(texts.at)
    middle = texts.at[:-1] + anchor
    group = np.unique(key, return_inverse=True)[1]
    ahead = Extensions(texts, prefix, middle + gram, np.minimum(size - anchor, length) - gram).neighbours(group)  # a key is a hash of the first bytes
    behind = Extensions(texts, prefix, middle, anchor, back=True).neighbours(group)
    low, high = np.maximum(anchor - longest(*behind), 0), np.minimum(anchor + gram + longest(*ahead), size) - length  # first and last window start
    found = []
    for before in range(length - gram + 1):
        block = np.flatnonzero((low <= anchor - before) & (anchor - before <= high))
        if not len(block):
            continue
        right, left = parted(*ahead, length - before - gram)[block], parted(*behind, before)[block]
        order = np.lexsort((doc[block], left, right))
        new = np.concatenate([[True], (right[order[1:]] != right[order[:-1]]) | (left[order[1:]] != left[order[:-1]])])
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.flatnonzero(~new)
        found.append((block[order[later]], block[head[later]], np.full(len(later), before)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    block, head, before = (np.concatenate(x) for x in zip(*found, strict=True))
    at, head_at = anchor[block] - before, anchor[head] - before
    start, head_start = texts.at[block] + at, texts.at[head] + head_at
    offsets, held, clash = np.arange(length), np.zeros(len(block), bool), np.zeros(0, np.int64)
    for i in range(0, len(block), 50_000):
        part = slice(i, i + 50_000)
        same = (texts.data[start[part][:, None] + offsets] == texts.data[head_start[part][:, None] + offsets]).all(1)
        held[part] = same & (doc[block[part]] > doc[head[part]])
        clash = np.append(clash, head_start[part][~same])
    for place in set(clash.tolist()):  # different bytes with one hash: settle them by the bytes themselves
        members = np.flatnonzero(head_start == place)
        bytes_of = [texts.data[p : p + length].tobytes() for p in [place, *start[members].tolist()]]
        least: dict[bytes, int] = {}
        docs = [int(doc[head[members[0]]]), *doc[block[members]].tolist()]
        for w, d in sorted(zip(bytes_of, docs, strict=True), key=lambda x: x[1]):
            least.setdefault(w, d)
        held[members] = [d > least[w] for w, d in zip(bytes_of[1:], docs[1:], strict=True)]
    order = np.flatnonzero(held)
    order = order[np.lexsort((at[order], block[order]))]
    block, at = block[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (block[1:] != block[:-1])])) if len(block) else np.zeros(0, int)
    last = np.append(first[1:], len(block)) - 1 if len(block) else first
    return block[first], at[first], at[last]


def pieces(key: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks in pieces of about PIECE_BYTES that hold all blocks of their keys."""
    order = np.argsort(key, kind="stable")
    k, ends = key[order], np.cumsum(size[order], dtype=np.int64)
    edges = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))  # ends of keys
    first = 0
    while first < len(k):
        limit = np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE_BYTES, side="right")
        last = edges[max(np.searchsorted(edges, first, side="right"), np.searchsorted(edges, limit, side="right") - 1)]
        yield order[first:last]
        first = int(last)


def _compare(length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        heads = [np.frombuffer(x, _SENT) for x in rows["heads"]]
        head = np.concatenate(heads)
        data, at = np.frombuffer(b"".join(rows["data"]), np.uint8), np.concatenate([[0], np.cumsum(head["size"], dtype=np.int64)])
        found, chunks = [], np.repeat(np.arange(len(heads)), [len(x) for x in heads])
        for part in pieces(head["key"], head["size"]):
            texts = W.Texts(np.concatenate([data[at[k] : at[k + 1]] for k in part.tolist()]), np.concatenate([[0], np.cumsum(head["size"][part], dtype=np.int64)]))
            block, low, high = equal_windows(texts, head["doc"][part], head["key"][part], head["anchor"][part].astype(np.int64), length, gram)
            spans = np.empty(len(block), _SPAN)
            block = part[block]
            spans["row"], spans["start"], spans["end"] = head["row"][block], head["start"][block] + low, head["start"][block] + high + length
            found.append((chunks[block], spans))
        chunk, spans = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(chunk, kind="stable")
        out = [(rows["chunk"][k], spans[order[i:j]].tobytes()) for k, i, j in slices(chunk[order])]
        return pa.table({"chunk": pa.array([o[0] for o in out], pa.int64()), "heads": pa.array([o[1] for o in out], pa.binary())})

    return run


def _cut(table: pa.Table) -> pa.Table:
    """Of one chunk."""
    (r,) = table.to_pylist()
    texts, _ = opened(r["ids"], r["sizes"], r["body"])
    spans = np.frombuffer(b"".join(r["spans"] or []), _SPAN)
    base = texts.at[spans["row"]]
    covered = marked(len(texts.data), base + spans["start"], base + spans["end"])
    _, _, at = texts.tokens(covered)
    kept, bounds = texts.data[~covered], texts.at - np.concatenate([[0], np.cumsum(covered)])[texts.at]
    left = [kept[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    shas = [hashlib.sha256(x).hexdigest() for x in left]
    return pa.table([pa.array(r["ids"], pa.int64()), pa.array(np.diff(texts.at)), pa.array(W.sums(covered, texts.at)), pa.array(np.diff(at).astype(np.int64)), pa.array(shas, pa.string()), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    texts = chunk_table(docs).drop("rest")
    buckets, finer = bucket_count(texts), bucket_count(texts, BUCKET_BYTES // FINER)
    codes = _entries(texts, buckets, length, gram).groupBy("bucket").applyInArrow(_settle(MANY_BLOCKS), "chunk long, bucket long, codes binary")
    answers = codes.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "codes")).alias("answers"))
    with small_batches(docs.sparkSession):
        found = stow(_answers(texts.join(answers, "chunk"), finer, length, gram))
    here = found.where(F.col("kind") == HERE).select("chunk", "heads")
    by_block = found.where(F.col("kind") == BLOCKS).select("bucket", "chunk", "heads", "data").groupBy("bucket").applyInArrow(_compare(length, gram), "chunk long, heads binary")
    by_window = found.where(F.col("kind") == WINDOWS).groupBy("bucket").applyInArrow(_dealt(length), "chunk long, heads binary")
    spans = here.unionByName(by_block).unionByName(by_window).groupBy("chunk").agg(F.collect_list("heads").alias("spans"))
    return texts.join(spans, "chunk", "left").groupBy("chunk").applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
